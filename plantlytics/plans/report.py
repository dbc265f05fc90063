"""KPI report as tidy tables: efficiency, header, and every KPI's analyses.

The source is read once: what all KPI sections need, the ready rows with their KPIs as numbers, is
written to the shared folder, and the counts of all rows are taken as they pass. The sections then take five scans of that
table: sums and rank sketch, exact quartiles, outliers, density, and the ordered blocks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlytics.functions import scalars as S
from plantlytics.operators import distribution, filters, states, stats
from plantlytics.operators.ordering import written
from plantlytics.roles import Roles, col

ERROR_LENGTH = 300  # characters of an error's first line that are kept
WRITERS = 4  # sections written at a time
OUTCOMES = "outcomes"
_KEYS = ("state", "kpi", "on", "shape", "i", "row_id", "section")


def report_header(
    df: DataFrame, kpis: Sequence[str], start: dt.date | None = None, end: dt.date | None = None,
    title: str = "", dataset: str = "", ready: str | None = None,
) -> DataFrame:
    """One row: title, dataset, KPIs, records, those of a ready plant (all without such a flag) and the days the filter spans."""
    return _titled(df.agg(*_header_counts(df, ready)), kpis, start, end, title, dataset)


def _header_counts(df: DataFrame, ready: str | None):
    flagged = ready is not None and ready in df.columns
    count = F.count(F.lit(1))
    return [count.alias("records"), (F.count_if(S.is_set(df, ready)) if flagged else count).alias("ready_records")]


def _titled(counts: DataFrame, kpis: Sequence[str], start: dt.date | None, end: dt.date | None, title: str, dataset: str) -> DataFrame:
    both = start is not None and end is not None
    return counts.select(
        F.lit(title).alias("title"),
        F.lit(dataset).alias("dataset"),
        F.lit(len(kpis)).alias("kpi_count"),
        F.lit(", ".join(kpis)).alias("kpis"),
        "records",
        "ready_records",
        F.lit(start.isoformat() if both else None).cast("date").alias("start_date"),
        F.lit(end.isoformat() if both else None).cast("date").alias("end_date"),
        F.lit((end - start).days + 1 if both else None).cast("int").alias("days"),
    )


def _first_line(error: Exception) -> str:
    return (str(error).strip().splitlines() or [type(error).__name__])[0][:ERROR_LENGTH]


def _ready_set(df: DataFrame, roles: Roles, kpis: Sequence[str]) -> DataFrame:
    """Time, ``row_id``, ``on`` and the KPIs as numbers of the ready rows; none without an ON flag."""
    ready = filters.ready_filter(df, roles.ready) if roles.on else df.where(F.lit(False))
    ids = [S.time_of(df, roles.time).alias(roles.time), *([col(roles.row_id)] if roles.row_id else [])]
    on = S.to01(ready, roles.on) if roles.on else F.lit(0)
    return ready.select(*ids, on.alias("on"), *[S.num(df, k).alias(k) for k in kpis])


def _failing(df: DataFrame, roles: Roles, kpis: Sequence[str]) -> dict[str, str]:
    """KPIs that can't be read, each tried by itself, with the error."""
    failed = {}
    for kpi in kpis:
        try:
            _ready_set(df, roles, [kpi]).write.format("noop").mode("overwrite").save()
        except Exception as error:  # whatever one KPI raises must not stop the others
            failed[kpi] = _first_line(error)
    return failed


def report_tables(
    df: DataFrame,
    roles: Roles,
    kpis: Sequence[str],
    start: dt.date | None = None,
    end: dt.date | None = None,
    title: str = "",
    dataset: str = "",
    efficiency_df: DataFrame | None = None,
    efficiency_roles: Roles | None = None,
) -> dict[str, DataFrame]:
    """Section name to table. KPI sections use ready rows, the efficiency section all rows.

    The efficiency section may come from another dataset; both get the same date
    filter. A KPI the table lacks, or whose values can't be read when the job runs, is listed under ``errors``
    and stops no other.
    """
    same = (efficiency_df is None or efficiency_df is df) and (efficiency_roles is None or efficiency_roles == roles)
    efficiency_df = df if efficiency_df is None else efficiency_df
    efficiency_roles = efficiency_roles or roles
    if start is not None and end is not None:
        df = filters.date_range_filter(df, start, end, roles.time)
        efficiency_df = filters.date_range_filter(efficiency_df, start, end, efficiency_roles.time)
    known, missing = stats.split_kpis(df, kpis)
    errors = {k: "no such column" for k in missing}

    def prepared(names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        counts = [*_header_counts(df, roles.ready), *states.efficiency_counts(df, roles)]
        seen = Observation()
        table = written(_ready_set(df.observe(seen, *counts), roles, names), "report-set")
        if not roles.on:  # nothing was read
            return table, df.agg(*counts)
        kinds = df.agg(*counts).schema
        return table, df.sparkSession.createDataFrame([tuple(seen.get[f.name] for f in kinds)], kinds)

    try:
        table, counts = prepared(known)
    except Exception:
        failed = _failing(df, roles, known)
        if not failed:
            raise
        errors |= failed
        known = [k for k in known if k not in failed]
        table, counts = prepared(known)

    efficiency = counts.drop("records", "ready_records") if same else efficiency_df.agg(*states.efficiency_counts(efficiency_df, efficiency_roles))
    tables = {
        "header": _titled(counts, kpis, start, end, title, dataset),
        "efficiency": states.with_efficiency(efficiency),
        "state_shares": states.shares_of(efficiency),
    }
    if known:
        own = Roles(roles.time, "on", None, roles.row_id)
        compared = stats.compare_states(table, own, known)
        tables |= {
            "series": states.state_blocks(table, own, known),
            "means": compared.means,
            "box": compared.box,
            "outliers": compared.outliers,
            "distribution": distribution.distribution(table, own, known, states=compared.groups, all_curved=compared.all_curved),
            "statistics": compared.statistics,
            "delta": compared.delta,
        }
    if errors:
        tables["errors"] = df.sparkSession.createDataFrame([*errors.items()], "kpi string, error string")
    return tables


def write_report(tables: dict[str, DataFrame], path: str) -> dict[str, str | None]:
    """Each section as a Parquet table below ``path/section=<name>``; what became of each goes to the section ``outcomes``.

    A section whose write fails stops no other: it leaves no table, and its error is in the outcomes
    (``section, written, error``), which are also returned.
    """

    def write(item: tuple[str, DataFrame]) -> str | None:
        section, table = item
        try:
            table.write.mode("errorifexists").parquet(f"{path}/section={section}")
        except Exception as error:  # one section must not stop the others
            return _first_line(error)
        return None

    with ThreadPoolExecutor(WRITERS) as pool:
        outcomes = dict(zip(tables, pool.map(write, tables.items())))
    spark = next(iter(tables.values())).sparkSession
    rows = [(section, error is None, error) for section, error in outcomes.items()]
    spark.createDataFrame(rows, "section string, written boolean, error string").coalesce(1).write.parquet(f"{path}/section={OUTCOMES}")
    return outcomes


def long_form(spark: SparkSession, path: str, sections: Iterable[str]) -> DataFrame:
    """All numbers of a written report: ``section, item, name, value``; times in seconds, dates in days, truth as 0 and 1."""
    parts = []
    for section in sections:
        table = spark.read.parquet(f"{path}/section={section}")
        keys = [k for k in _KEYS if k in table.columns and isinstance(table.schema[k].dataType, (T.StringType, T.IntegralType))]
        values = []
        for f in table.schema:
            x = col(f.name)
            if f.name in keys or isinstance(f.dataType, T.StringType):
                continue
            if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
                x = S.micros(x) / 1e6
            elif isinstance(f.dataType, T.DateType):
                x = F.unix_date(x)
            elif isinstance(f.dataType, T.BooleanType):
                x = x.cast("int")
            values.append(F.struct(F.lit(f.name).alias("name"), x.cast("double").alias("value")))
        if not values:
            values = [F.struct(F.lit("listed").alias("name"), F.lit(1.0).alias("value"))]
        item = F.concat_ws("|", *[col(k).cast("string") for k in keys])
        parts.append(table.select(F.lit(section).alias("section"), item.alias("item"), F.inline(F.array(*values))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
