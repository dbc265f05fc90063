"""Filter, export and register in one go."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plantlytics.operators import filters
from plantlytics.session import fresh_path
from plantlytics.sinks.export import write_csv
from plantlytics.sources.datasets import FILTERED, Datasets


@dataclass(frozen=True)
class PipelineResult:
    summary: DataFrame
    filtered: DataFrame | None
    name: str | None
    csv_path: str | None


def filter_and_export(
    datasets: Datasets,
    name: str,
    ranges: Mapping[str, tuple[float, float]] | None = None,
    needle: str | None = None,
    search_columns: Sequence[str] = (),
    use_regex: bool = False,
    case_sensitive: bool = False,
    csv_path: str | None = None,
    order: Sequence[str] = (),
) -> PipelineResult:
    """Apply the filters to a dataset, write the cleaned rows as CSV, register the rows themselves.

    The source is read twice, for the bounds of the ranges and for the write, which counts the rows before and after
    the filter as they pass. The filtered rows are written once, to the shared folder, and everything after
    reads them there: no step filters again, and a lost executor costs no recomputation.
    With ``order``, the time columns for instance, the CSV parts are sorted. An empty
    result writes and registers nothing.
    """
    spark, source = datasets.spark, datasets.get(name)
    clamped = filters.clamp_ranges(_bounds(source, ranges), ranges or {})
    predicate = filters.range_predicate(source, clamped)
    text = filters.text_predicate(source, needle, search_columns, use_regex, case_sensitive)
    if text is not None:
        predicate = predicate & text
    path = fresh_path(spark, "filtered")
    before, after = Observation(), Observation()
    rows = F.count(F.lit(1)).alias("rows")
    source.observe(before, rows).where(predicate).observe(after, rows).write.parquet(path)
    filtered = spark.read.schema(source.schema).parquet(path)
    summary = _summary(spark, before.get["rows"], after.get["rows"])
    if not after.get["rows"]:
        return PipelineResult(summary, None, None, None)
    csv_path = csv_path or fresh_path(spark, f"{name}_filtrado")
    write_csv(filtered, csv_path, order)
    new_name = f"{name}_exportado_{datetime.now():%Y%m%d_%H%M%S}"
    datasets.register(FILTERED, filtered)
    datasets.register(new_name, filtered)
    return PipelineResult(summary, filtered, new_name, csv_path)


def _bounds(source: DataFrame, ranges) -> dict[str, tuple[float, float]]:
    names = [c for c in ranges or {} if c in source.columns]
    if not names:
        return {}
    return {r.variable: (r.lo, r.hi) for r in filters.range_bounds(source, names).collect()}


def _summary(spark: SparkSession, before: int, after: int) -> DataFrame:
    """Same columns as ``filter_summary``, from the counts that the write observed."""
    reduction = 100.0 * (before - after) / before if before else 0.0
    return spark.createDataFrame([(before, after, reduction)], "rows_before long, rows_after long, reduction_pct double")
