"""Row filters. Each is one predicate, so Catalyst can push it into the scan."""

from __future__ import annotations

import datetime as dt
import math
import re
import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlytics.functions import scalars as S
from plantlytics.roles import Roles, col, quoted

PREVIEW_ROWS = 1000  # fixed value: most rows a preview shows


def date_range_filter(df: DataFrame, start: dt.date, end: dt.date, time: str | None = "datetime") -> DataFrame:
    """Rows from the first instant of ``start`` to the last of ``end``.

    A table without the time column passes unchanged, with a warning. When the table is stored by
    ``day``, that column is filtered too, so whole folders are skipped.
    """
    if time is None or time not in df.columns:
        warnings.warn(f"no time column {time!r}: the date filter can't be applied", stacklevel=2)
        return df
    after = end + dt.timedelta(days=1)
    at = S.time_of(df, time)
    kept = df.where(
        (at >= F.lit(start.isoformat()).cast("timestamp_ntz")) & (at < F.lit(after.isoformat()).cast("timestamp_ntz"))
    )
    if "day" in df.columns and isinstance(df.schema["day"].dataType, T.DateType):
        kept = kept.where(F.col("day").between(F.lit(start), F.lit(end)))
    return kept


def _in_range(df: DataFrame, name: str, lo: float, hi: float) -> Column:
    """Inclusive range test. NaN sorts above every number, so finite ends keep it out."""
    plain = isinstance(df.schema[name].dataType, T.NumericType) and math.isfinite(lo) and math.isfinite(hi)
    return (col(name) if plain else S.num(df, name)).between(lo, hi)


def range_predicate(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> Column:
    """AND of inclusive ranges; unknown columns are ignored, unusable values never pass."""
    tests = [_in_range(df, name, lo, hi) for name, (lo, hi) in ranges.items() if name in df.columns]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def range_filter(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.where(range_predicate(df, ranges)) if ranges else df


def range_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(variable, lo, hi)`` of the usable values of each column, in one pass.

    Columns without values or with a single value have no range and are left out.
    """
    long = df.select(*[S.num(df, c).alias(c) for c in columns]).unpivot(
        [], [quoted(c) for c in columns], "variable", "value"
    )
    return (
        long.groupBy("variable")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        .where(F.col("lo") < F.col("hi"))
    )


def clamp_ranges(
    bounds: Mapping[str, tuple[float, float]], wanted: Mapping[str, tuple[float, float]]
) -> dict[str, tuple[float, float]]:
    """Wanted ranges moved into the bounds.

    A crossed range collapses onto its upper end. The full range is no filter at all,
    so rows without a value stay.
    """
    result = {}
    for name, (low, high) in wanted.items():
        if name not in bounds:
            continue
        lo, hi = bounds[name]
        high = min(max(high, lo), hi)
        low = min(max(low, lo), hi, high)
        if (low, high) != (lo, hi):
            result[name] = (low, high)
    return result


def clamped_range_filter(df: DataFrame, wanted: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Range filter after a look at the real bounds (one row per wanted column)."""
    names = [c for c in wanted if c in df.columns]
    if not names:
        return df
    bounds = {r.variable: (r.lo, r.hi) for r in range_bounds(df, names).collect()}
    return range_filter(df, clamp_ranges(bounds, wanted))


def is_valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Patterns are tried up front, on one literal: otherwise only the running job would fail."""
    try:
        spark.sql("SELECT '' RLIKE :pattern", {"pattern": pattern}).collect()
    except PySparkException:
        return False
    return True


def java_pattern(pattern: str) -> str:
    """Named groups as Java writes them; its group names have letters and digits only."""
    def name(m: re.Match) -> str:
        return "".join(c if c.isascii() and c.isalnum() else f"x{ord(c):x}x" for c in m[1])

    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{name(m)}>", pattern)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{name(m)}>", pattern)


def text_predicate(
    df: DataFrame,
    needle: str | None,
    columns: Sequence[str],
    use_regex: bool = False,
    case_sensitive: bool = False,
    null_as_text: str | None = None,
) -> Column | None:
    """OR over the columns of "its text contains the needle"; ``None`` means no filter.

    A broken pattern is searched literally. Missing values never match unless
    ``null_as_text`` says what they read as.
    """
    needle = (needle or "").strip()
    columns = [c for c in columns if c in df.columns]
    if not needle or not columns:
        return None
    pattern = java_pattern(needle) if use_regex else needle
    regex = use_regex and is_valid_pattern(df.sparkSession, pattern)
    if use_regex and not regex:
        warnings.warn(f"not a pattern, searched literally: {needle}", stacklevel=2)

    def hit(name: str) -> Column:
        text = S.as_text(df, name)
        if null_as_text is not None:
            text = F.coalesce(text, F.lit(null_as_text))
        if regex:
            return text.rlike(("(?U)" if case_sensitive else "(?iuU)") + pattern)
        if case_sensitive:
            return text.contains(needle)
        return F.upper(text).contains(F.upper(F.lit(needle)))

    return reduce(lambda a, b: a | b, [F.coalesce(hit(c), F.lit(False)) for c in columns])


def text_search(df: DataFrame, needle: str | None, columns: Sequence[str], **options) -> DataFrame:
    predicate = text_predicate(df, needle, columns, **options)
    return df if predicate is None else df.where(predicate)


def ready_filter(df: DataFrame, ready: str | None) -> DataFrame:
    """Rows of a ready plant; every row when there is no such flag."""
    return df if ready is None or ready not in df.columns else df.where(S.is_set(df, ready))


def filter_summary(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows before and after a filter and the reduction in percent, in one pass."""
    before, after = F.count(F.lit(1)), F.count_if(predicate)
    return df.agg(
        before.alias("rows_before"),
        after.alias("rows_after"),
        F.coalesce(100.0 * F.try_divide(before - after, before), F.lit(0.0)).alias("reduction_pct"),
    )


def preview(df: DataFrame, roles: Roles, rows: int = PREVIEW_ROWS) -> DataFrame:
    """First rows by time, as a top-k: no full sort."""
    return df.orderBy(*[col(c) for c in roles.order]).limit(rows)
