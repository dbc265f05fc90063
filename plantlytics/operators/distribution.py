"""Value distribution per state: smooth curves, and bars where no curve exists."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlytics.operators.stats import GROUP, ready_values
from plantlytics.roles import Roles

GRID = 300
BINS = 40
FINE_CELLS = 1 << 14
NEGLECTED = 1e-13  # of a point's height: what all values beyond a kernel's reach may add at most
_MERGE = 1 << 20  # rows a task holds before it merges equal values and adds up


def _groups(long: DataFrame) -> DataFrame:
    """Per KPI and state: counts, bandwidth ``h``, and the value range of both states of the KPI."""
    v = F.col("value")
    states = long.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(v).alias("n"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("smallest"),
        F.max(v).alias("largest"),
    )
    return _scaled(states)


def _scaled(states: DataFrame) -> DataFrame:
    both = Window.partitionBy("kpi")  # two rows
    # Scott's rule: the spread shrinks with the fifth root of the number of values.
    h = F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    return (
        states.withColumn("lo", F.min("smallest").over(both))
        .withColumn("hi", F.max("largest").over(both))
        .where(F.col("n") > 0)
        .withColumn("h", h)
    )


def _has_curve() -> Column:
    return (F.col("n") > 1) & (F.col("h") > 0)


def _weights(long: DataFrame, groups: DataFrame, method: str) -> DataFrame:
    """Values with their weights: each row as it is, or spread over fine cells."""
    valued = long.where(F.col("value").isNotNull())
    if method == "exact":
        return valued.select(*GROUP, "value", F.lit(1.0).alias("weight"))
    step = (F.col("hi") - F.col("lo")) / (FINE_CELLS - 1)
    position = (F.col("value") - F.col("lo")) / step
    cell = F.least(F.floor(position), F.lit(FINE_CELLS - 2))
    share = position - cell
    pair = F.array(
        F.struct(cell.alias("cell"), (1 - share).alias("part")),
        F.struct((cell + 1).alias("cell"), share.alias("part")),
    )
    # Two rows per KPI: bounded by the KPI list.
    ends = F.broadcast(groups.where(_has_curve()).select(*GROUP, "lo", "hi"))
    return (
        valued.join(ends, GROUP)
        .select(*GROUP, "lo", step.alias("step"), F.inline(pair))
        .groupBy(*GROUP, "cell")
        .agg(F.sum("part").alias("weight"), F.first("lo").alias("lo"), F.first("step").alias("step"))
        .select(*GROUP, (F.col("lo") + F.col("cell") * F.col("step")).alias("value"), "weight")
    )


def kde_counts(
    df: DataFrame,
    roles: Roles,
    kpis: Sequence[str],
    method: str = "exact",
    scale: str = "valid",
    states: DataFrame | None = None,
) -> DataFrame:
    """``(kpi, on, i, x, y)``: Gaussian density on 300 points, scaled to a number of records.

    The points span the values of both states. A state without spread or with fewer
    than two values has no curve. ``scale="rows"`` scales to all ready records of the
    state, missing values included. ``method="binned"`` first spreads the values over
    fine cells: an approximation whose cost no longer grows with the distinct values.

    Each task merges equal values, adds up their kernels at the points within reach and hands on one
    row per point and state, straight from the scan: no value is shuffled. A kernel reaches as far as it can
    change the result: beyond, all values together add less than :data:`NEGLECTED`. ``states`` are the groups' counts,
    deviations and ends, if an earlier scan has found them.
    """
    if method not in ("exact", "binned") or scale not in ("valid", "rows"):
        raise ValueError(f"unknown method {method!r} or scale {scale!r}")
    long = ready_values(df, roles, kpis)
    groups = _groups(long) if states is None else _scaled(states)
    # Two rows per KPI.
    curves = F.broadcast(groups.where(_has_curve()).select(*GROUP, "n", "n_rows", "h", "lo", "hi"))
    span = F.col("hi") - F.col("lo")
    factor = F.lit(1.0) if scale == "valid" else F.col("n_rows") / F.col("n")
    standard = _weights(long, groups, method).join(curves, GROUP).select(
        *GROUP,
        "weight",
        ((F.col("value") - F.col("lo")) / F.col("h")).alias("at"),
        (span / (GRID - 1) / F.col("h")).alias("step"),
        F.sqrt(2 * F.log(F.greatest(F.col("n") * span * factor / (F.col("h") * GRID * NEGLECTED), F.lit(math.e)))).alias("reach"),
    )
    density = F.col("total") / F.col("h") / math.sqrt(2 * math.pi)
    return (
        standard.mapInArrow(_kernel_sums, "kpi string, on int, i int, part double")
        .groupBy(*GROUP, "i")
        .agg(F.sum("part").alias("total"))
        .join(curves, GROUP)
        .select(
            *GROUP, "i",
            (F.col("lo") + F.col("i") * (span / (GRID - 1))).alias("x"),
            (density * span / GRID * factor).alias("y"),
        )
    )


def _kernel_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted kernel sums of one task at the grid points, per KPI and state.

    Values are sorted, so those within reach of a point are a slice.
    """
    sums: dict[tuple, np.ndarray] = {}
    held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
    scales: dict[tuple, tuple[float, float]] = {}

    def add_up() -> None:
        for group, parts in held.items():
            at, place = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
            weight = np.bincount(place, np.concatenate([w for _, w in parts]))
            step, reach = scales[group]
            points = np.arange(GRID) * step
            total = sums.setdefault(group, np.zeros(GRID))
            first, end = np.searchsorted(at, points - reach), np.searchsorted(at, points + reach, "right")
            for i in np.flatnonzero(end > first):
                z = at[first[i] : end[i]] - points[i]
                total[i] += np.exp(-0.5 * z * z) @ weight[first[i] : end[i]]
        held.clear()

    rows_held = 0
    for batch in batches:
        for group, rows in batch.to_pandas().groupby(GROUP):
            scales[group] = rows["step"].iloc[0], rows["reach"].iloc[0]
            held.setdefault(group, []).append((rows["at"].to_numpy(), rows["weight"].to_numpy()))
        rows_held += len(batch)
        if rows_held >= _MERGE:
            add_up()
            rows_held = 0
    add_up()
    for (kpi, on), total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([kpi] * GRID), pa.array([on] * GRID, pa.int32()), pa.array(range(GRID), pa.int32()),
             pa.array(total)],
            names=["kpi", "on", "i", "part"],
        )


def histogram_counts(df: DataFrame, roles: Roles, kpis: Sequence[str], bins: int = BINS) -> DataFrame:
    """``(kpi, on, bin, x, n)``: records per state in equal bins over the range of both states.

    The largest value belongs to the last bin; values that are all equal fill bin 1.
    Empty bins are left out.
    """
    long = ready_values(df, roles, kpis)
    return _bars(long, _groups(long), bins)


def _bars(long: DataFrame, groups: DataFrame, bins: int) -> DataFrame:
    ends = F.broadcast(groups.select(*GROUP, "lo", "hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.floor((F.col("value") - F.col("lo")) / F.when(width > 0, width)).cast("int") + 1
    return (
        long.where(F.col("value").isNotNull())
        .join(ends, GROUP)
        .withColumn("bin", F.least(F.coalesce(number, F.lit(1)), F.lit(bins)))
        .groupBy(*GROUP, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        .select(*GROUP, "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("x"), "n")
    )


def distribution(
    df: DataFrame, roles: Roles, kpis: Sequence[str], method: str = "exact", scale: str = "valid",
    states: DataFrame | None = None, all_curved: bool = False,
) -> DataFrame:
    """Curves where a state has one, bars for the other states: ``(kpi, on, shape, i, x, y)``.

    ``all_curved``: the states are known to have a curve each, so no row is looked at for bars.
    """
    curve = kde_counts(df, roles, kpis, method, scale, states).select(*GROUP, F.lit("curve").alias("shape"), "i", "x", "y")
    if all_curved:
        return curve
    long = ready_values(df, roles, kpis)
    groups = _groups(long) if states is None else _scaled(states)
    bars = _bars(long, groups.where(~F.coalesce(_has_curve(), F.lit(False))), BINS)
    return curve.unionByName(
        bars.select(*GROUP, F.lit("bars").alias("shape"), F.col("bin").alias("i"), "x", F.col("n").cast("double").alias("y"))
    )
