"""KPI statistics, ON against OFF and over all records.

All KPIs go through one unpivot and every statistic is one grouping by KPI and state,
so a further KPI costs rows in the same pass and not another job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlytics.functions import scalars as S
from plantlytics.operators.filters import ready_filter
from plantlytics.operators.ordering import written
from plantlytics.operators.quantiles import approximate, quantiles, sketch
from plantlytics.roles import CONTROL_CATEGORY, CONTROL_WORDS, PROCESS_CATEGORY, Roles, col, quoted

QUARTILES = (0.25, 0.5, 0.75)
QUARTILE_NAMES = ("q1", "median", "q3")
FENCE = 1.5  # whiskers end within this many interquartile ranges of the box
RANGE_PADDING = 0.1
GROUP = ["kpi", "on"]


def unpivot_numeric(df: DataFrame, kpis: Sequence[str], ids: Sequence[Column] = ()) -> DataFrame:
    """``ids`` plus ``(kpi, value)``: every KPI as DOUBLE, unusable values as NULL."""
    wide = df.select(*ids, *[S.num(df, k).alias(k) for k in kpis])
    names = wide.columns[: len(ids)]
    return wide.unpivot([quoted(n) for n in names], [quoted(k) for k in kpis], "kpi", "value")


def ready_values(df: DataFrame, roles: Roles, kpis: Sequence[str], ids: Sequence[Column] = ()) -> DataFrame:
    """Long form of the ready rows: ``ids``, ``on`` (0/1), ``kpi``, ``value``."""
    if roles.on is None:  # no state, so nothing to compare
        return unpivot_numeric(df.limit(0), kpis, [*ids, F.lit(0).alias("on")])
    ready = ready_filter(df, roles.ready)
    return unpivot_numeric(ready, kpis, [*ids, S.to01(ready, roles.on).alias("on")])


def split_kpis(df: DataFrame, kpis: Sequence[str]) -> tuple[list[str], list[str]]:
    """KPIs the table has, and those it lacks: one bad KPI must not stop the others."""
    return [k for k in kpis if k in df.columns], [k for k in kpis if k not in df.columns]


def _states(df: DataFrame, kpis: Sequence[str]) -> DataFrame:
    """Every (kpi, on) pair: two rows per KPI."""
    pairs = [F.struct(F.lit(k).alias("kpi"), F.lit(s).alias("on")) for k in kpis for s in (0, 1)]
    return df.sparkSession.range(1).select(F.inline(F.array(*pairs)))


def _with_all_states(stats: DataFrame, kpis: Sequence[str], counts: Sequence[str]) -> DataFrame:
    # Two rows per KPI on both sides, so the broadcast is bounded by the KPI list.
    return _states(stats, kpis).join(F.broadcast(stats), GROUP, "left").fillna(0, list(counts))


def _quartiles(long: DataFrame, keys: Sequence[str], method: str = "exact") -> DataFrame:
    if method not in ("exact", "approximate"):
        raise ValueError(f"unknown method {method!r}")
    return (quantiles if method == "exact" else approximate)(long, keys, "value", QUARTILES, QUARTILE_NAMES)


def onoff_quartiles(df: DataFrame, roles: Roles, kpis: Sequence[str], method: str = "exact") -> DataFrame:
    """Quartiles per KPI and state on ready rows: pass them on where several tables need them.

    ``method="approximate"`` takes them from one scan's sketch, for a look at a large table.
    """
    return _quartiles(ready_values(df, roles, kpis), GROUP, method)


def onoff_stats(
    df: DataFrame,
    roles: Roles,
    kpis: Sequence[str],
    quartiles: DataFrame | None = None,
) -> DataFrame:
    """Per KPI and state on ready rows: records, values, mean, sample deviation, min, quartiles, max.

    Both states always have a row; a state without values has counts and NULLs.
    """
    long = ready_values(df, roles, kpis)
    v = F.col("value")
    basic = long.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(v).alias("valid_n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    if quartiles is None:
        quartiles = _quartiles(long, GROUP)
    return _full(basic, quartiles, kpis)


def _full(basic: DataFrame, quartiles: DataFrame, kpis: Sequence[str]) -> DataFrame:
    stats = basic.join(F.broadcast(quartiles), GROUP, "left")
    return _with_all_states(stats, kpis, ["n", "valid_n"]).select(
        *GROUP, "n", "valid_n", "mean", "std", "min", *QUARTILE_NAMES, "max"
    )


def onoff_delta(df: DataFrame, roles: Roles, kpis: Sequence[str]) -> DataFrame:
    """Per KPI the mean ON minus the mean OFF, also in percent of the OFF mean.

    The text reads "N/A" unless both numbers exist.
    """
    long = ready_values(df, roles, kpis)
    return _deltas(long.groupBy("kpi").agg(
        F.avg(F.when(F.col("on") == 1, F.col("value"))).alias("mean_on"),
        F.avg(F.when(F.col("on") == 0, F.col("value"))).alias("mean_off"),
    ))


def _deltas(means: DataFrame) -> DataFrame:
    deltas = means.withColumn("delta", F.col("mean_on") - F.col("mean_off")).withColumn(
        "delta_pct", 100.0 * F.try_divide(F.col("delta"), F.col("mean_off"))
    )
    text = F.format_string("%+.2f (%+.2f%%)", "delta", "delta_pct")
    return deltas.withColumn("delta_text", F.when(F.col("delta_pct").isNull(), "N/A").otherwise(text))


def onoff_means(df: DataFrame, roles: Roles, kpis: Sequence[str]) -> DataFrame:
    """Mean lines: per KPI and state the mean and the time extent of all ready rows."""
    long = ready_values(df, roles, kpis, [S.time_of(df, roles.time).alias("t")])
    # Four columns per state and one row per KPI: the extent spans both states.
    return _mean_lines(long.groupBy("kpi").agg(
        F.min("t").alias("t_min"),
        F.max("t").alias("t_max"),
        F.avg(F.when(F.col("on") == 0, F.col("value"))).alias("mean_off"),
        F.avg(F.when(F.col("on") == 1, F.col("value"))).alias("mean_on"),
    ))


def _mean_lines(one: DataFrame) -> DataFrame:
    rows = [F.struct(F.lit(s).alias("on"), F.col(m).alias("mean")) for s, m in ((0, "mean_off"), (1, "mean_on"))]
    return one.select("kpi", F.inline(F.array(*rows)), "t_min", "t_max").where(F.col("mean").isNotNull())


def onoff_stats_compact(df: DataFrame, roles: Roles, kpis: Sequence[str]) -> DataFrame:
    """Short form of the statistics, four decimals, without rows for absent states."""
    full = onoff_stats(df, roles, kpis).where(F.col("n") > 0)
    return full.select(*GROUP, "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "median")])


def describe_profile(df: DataFrame, kpis: Sequence[str], method: str = "exact") -> DataFrame:
    """Per column: values, missing, mean, deviation, min, quartiles (exact or ``approximate``), max over all rows."""
    long = unpivot_numeric(df, kpis)
    v = F.col("value")
    basic = long.groupBy("kpi").agg(
        F.count(v).alias("count"),
        (F.count(F.lit(1)) - F.count(v)).alias("null_count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    joined = basic.join(F.broadcast(_quartiles(long, ["kpi"], method)), "kpi", "left")
    return joined.select("kpi", "count", "null_count", "mean", "std", "min", *QUARTILE_NAMES, "max")


def _fences(long: DataFrame, quartiles: DataFrame | None) -> DataFrame:
    spread = F.col("q3") - F.col("q1")
    if quartiles is None:
        quartiles = _quartiles(long, GROUP)
    return (
        quartiles.withColumn("fence_lo", F.col("q1") - FENCE * spread)
        .withColumn("fence_hi", F.col("q3") + FENCE * spread)
    )


def box_summary(
    df: DataFrame,
    roles: Roles,
    kpis: Sequence[str],
    quartiles: DataFrame | None = None,
) -> DataFrame:
    """Per KPI and state on ready rows: records, quartiles, mean, whiskers, number of outliers."""
    long = ready_values(df, roles, kpis)
    fences = _fences(long, quartiles)
    v = F.col("value")
    inside = v.between(F.col("fence_lo"), F.col("fence_hi"))
    # The fences have two rows per KPI.
    basic = (
        long.join(F.broadcast(fences.select(*GROUP, "fence_lo", "fence_hi")), GROUP, "left")
        .groupBy(*GROUP)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(v).alias("mean"),
            F.min(F.when(inside, v)).alias("whisker_lo"),
            F.max(F.when(inside, v)).alias("whisker_hi"),
            F.count_if(~inside).alias("outliers"),
        )
    )
    return _boxes(basic, fences, kpis)


def _boxes(basic: DataFrame, quartiles: DataFrame, kpis: Sequence[str]) -> DataFrame:
    stats = basic.join(F.broadcast(quartiles.select(*GROUP, *QUARTILE_NAMES)), GROUP, "left")
    return _with_all_states(stats, kpis, ["n", "outliers"]).select(
        *GROUP, "n", *QUARTILE_NAMES, "mean", "whisker_lo", "whisker_hi", "outliers"
    )


def box_outliers(
    df: DataFrame,
    roles: Roles,
    kpis: Sequence[str],
    quartiles: DataFrame | None = None,
) -> DataFrame:
    """Every ready row whose value lies beyond the fences of its state."""
    ids = [col(c) for c in roles.order]
    long = ready_values(df, roles, kpis, ids)
    fences = _fences(long, quartiles).select(*GROUP, "fence_lo", "fence_hi")
    outside = ~F.col("value").between(F.col("fence_lo"), F.col("fence_hi"))
    return (
        long.join(F.broadcast(fences), GROUP).where(outside).select(*ids, *GROUP, "value")
    )


def padded_range(df: DataFrame, kpis: Sequence[str]) -> DataFrame:
    """Shared value range of all series, widened by a tenth of its span at both ends.

    No row if there is no value or only one.
    """
    ends = unpivot_numeric(df, kpis).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    pad = RANGE_PADDING * (F.col("hi") - F.col("lo"))
    return ends.where(F.col("hi") > F.col("lo")).select(
        (F.col("lo") - pad).alias("y_min"), (F.col("hi") + pad).alias("y_max")
    )


@dataclass(frozen=True)
class Comparison:
    """ON against OFF of several KPIs, from three scans: every table but ``outliers`` has a row or two per KPI."""

    statistics: DataFrame
    box: DataFrame
    outliers: DataFrame
    means: DataFrame
    delta: DataFrame
    groups: DataFrame
    all_curved: bool


def compare_states(df: DataFrame, roles: Roles, kpis: Sequence[str]) -> Comparison:
    """All ON/OFF tables of the ready rows at once.

    One scan gives the sums and a sketch of the ranks, the second the exact quartiles, the third the rows beyond the
    fences, which are written, and on its way what the box still needs. ``groups`` is what the distribution asks for.
    """
    spark = df.sparkSession
    ids = [col(c) for c in roles.order]
    long = ready_values(df, roles, kpis, ids)
    v, t = F.col("value"), col(roles.time)
    sums = long.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(t).alias("t_min"), F.max(t).alias("t_max"), *sketch(v, QUARTILES),
    )
    found = sums.collect()  # two rows per KPI
    kinds = T.StructType([f for f in sums.schema if f.name != "marks"])
    sums = spark.createDataFrame([tuple(r[f.name] for f in kinds) for r in found], kinds)
    quartiles = quantiles(long, GROUP, "value", QUARTILES, QUARTILE_NAMES, found)

    fences = _fences(long, quartiles).select(*GROUP, "fence_lo", "fence_hi")
    fenced = long.join(F.broadcast(fences), GROUP)
    inside = v.between(F.col("fence_lo"), F.col("fence_hi"))
    states = [(r.kpi, r.on) for r in found if r.total]
    seen = Observation()
    own = [F.when((F.col("kpi") == k) & (F.col("on") == s), True) for k, s in states]
    metrics = [x for i, mine in enumerate(own) for x in (
        F.min(F.when(mine & inside, v)).alias(f"lo{i}"), F.max(F.when(mine & inside, v)).alias(f"hi{i}"), F.count_if(mine & ~inside).alias(f"n{i}"))]
    watched = fenced.observe(seen, *metrics) if metrics else fenced
    outliers = written(watched.where(~inside).select(*ids, *GROUP, "value"), "outliers")
    got = seen.get if metrics else {}
    whiskers = spark.createDataFrame(
        [(k, s, got[f"lo{i}"], got[f"hi{i}"], got[f"n{i}"]) for i, (k, s) in enumerate(states)],
        "kpi string, on int, whisker_lo double, whisker_hi double, outliers long")
    basic = sums.select(*GROUP, "n", F.col("total").alias("valid_n"), "mean", "std", F.col("lo").alias("min"), F.col("hi").alias("max"))
    means = sums.groupBy("kpi").agg(
        F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"),
        F.max(F.when(F.col("on") == 0, F.col("mean"))).alias("mean_off"), F.max(F.when(F.col("on") == 1, F.col("mean"))).alias("mean_on"),
    )
    return Comparison(
        statistics=_full(basic, quartiles, kpis),
        box=_boxes(basic.select(*GROUP, "n", "mean").join(F.broadcast(whiskers), GROUP, "left"), quartiles, kpis),
        outliers=outliers,
        means=_mean_lines(means),
        delta=_deltas(means.select("kpi", "mean_on", "mean_off")),
        groups=sums.select(*GROUP, F.col("n").alias("n_rows"), F.col("total").alias("n"), "std", F.col("lo").alias("smallest"), F.col("hi").alias("largest")),
        all_curved=all(r.total > 1 and r.std > 0 for r in found if r.total),
    )


def binary_signal_profile(df: DataFrame, signals: Sequence[str]) -> DataFrame:
    """``(kpi, is_binary, category)`` of every signal.

    Binary means at most three different values that all round to 0 or 1; a signal
    without values is not binary. Three values or fewer means that those strictly
    between the smallest and the largest are all equal, which takes two scans with
    tiny exchanges and no set of distinct values.
    """
    long = unpivot_numeric(df, signals)
    v = F.col("value")
    ends = long.groupBy("kpi").agg(
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.bool_and(F.rint(v).isin(0.0, 1.0)).alias("near")
    )
    inner = F.when((v > F.col("lo")) & (v < F.col("hi")), v)
    # One row per signal.
    middle = long.join(F.broadcast(ends), "kpi").groupBy("kpi").agg(
        F.first("near").alias("near"), F.min(inner).alias("mid_lo"), F.max(inner).alias("mid_hi")
    )
    few = F.col("mid_lo").isNull() | (F.col("mid_lo") == F.col("mid_hi"))
    control = F.lower("kpi").rlike("|".join(CONTROL_WORDS))
    category = F.when(control, CONTROL_CATEGORY).otherwise(PROCESS_CATEGORY)
    return middle.select(
        "kpi", F.coalesce(F.col("near") & few, F.lit(False)).alias("is_binary"), category.alias("category")
    )


def period_summary(df: DataFrame, time: str | None) -> DataFrame:
    """First and last day, number of days with both counted, and records."""
    day = F.to_date(S.time_of(df, time)) if time else F.lit(None).cast("date")
    return df.agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("records")
    ).withColumn("days", F.datediff("last_day", "first_day") + 1)
