"""Time buckets for plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlytics.functions import scalars as S
from plantlytics.roles import TIME, Roles, col

# Bucket width in seconds for spans above so many days.
WIDTHS = ((60, 3600), (10, 900), (2, 300))
SMALLEST_WIDTH = 60


def bucket_width(df: DataFrame, time: str = TIME) -> DataFrame:
    """One row: span in days and the bucket width in seconds that suits it."""
    first, last = F.min(S.micros(col(time))), F.max(S.micros(col(time)))
    span = df.agg(((last - first) / F.lit(86_400_000_000.0)).alias("span_days"))
    width = F.lit(SMALLEST_WIDTH)
    for days, seconds in reversed(WIDTHS):
        width = F.when(F.col("span_days") > days, seconds).otherwise(width)
    return span.withColumn("width_seconds", width)


def bucket_ohlc(
    df: DataFrame, roles: Roles, main: str, others: Sequence[str] = (), width_seconds: int | None = None
) -> DataFrame:
    """Per bucket: open, high, low, close of the main KPI, largest flags, means of the others.

    Without a width it is chosen from the time span, which takes one small job. First
    and last follow time and ``row_id``. Buckets without rows are absent.
    """
    if width_seconds is None:
        width_seconds = bucket_width(df, roles.time).first()["width_seconds"]
    v = F.col("__main")
    order = F.col("__order")
    rows = df.where(col(roles.time).isNotNull()).select(
        S.num(df, main).alias("__main"),
        _order(df, roles).alias("__order"),
        col(roles.time).alias("__o0"),
        *[S.flag_int(df, c).alias(f"__f_{c}") for c in _flags(df, roles)],
        *[S.num(df, c).alias(f"__k{i}") for i, c in enumerate(others)],
    )
    aggs: list[Column] = [
        F.min_by(v, order).alias("open"),
        F.max(v).alias("high"),
        F.min(v).alias("low"),
        F.max_by(v, order).alias("close"),
        *[F.max(col(f"__f_{c}")).alias(c) for c in _flags(df, roles)],
        *[F.avg(F.col(f"__k{i}")).alias(c) for i, c in enumerate(others)],
    ]
    # A number as key sorts faster than the pair of times of a window.
    at = S.micros(F.col("__o0"))
    start = at - F.pmod(at, F.lit(int(width_seconds) * 1_000_000))
    out = rows.groupBy(start.alias("__start")).agg(*aggs)
    time = F.timestamp_micros("__start").cast(df.schema[roles.time].dataType).alias(roles.time)
    return out.select(time, *[col(c) for c in out.columns if c != "__start"])


def _order(df: DataFrame, roles: Roles) -> Column:
    """Time and ``row_id`` as one number of fixed width, which a hash aggregate can hold; a struct would need a sort.

    Ids that are no whole numbers keep the struct.
    """
    at = S.micros(col(roles.time))
    if roles.row_id is None:
        return at
    if not isinstance(df.schema[roles.row_id].dataType, T.IntegralType):
        return F.struct(at, col(roles.row_id))
    # Ids span less than 2e19 and microseconds of dates up to the year 9999 less than 1e18. A row without an id comes
    # before all others of its time, as it does in a sort.
    rid = F.coalesce(col(roles.row_id).cast("decimal(20,0)"), F.lit(str(-(10**19))).cast("decimal(20,0)"))
    return (at.cast("decimal(18,0)") * F.lit(str(2 * 10**19)).cast("decimal(20,0)") + rid).cast("decimal(38,0)")


def _flags(df: DataFrame, roles: Roles) -> list[str]:
    return [c for c in (roles.on, roles.ready) if c and c in df.columns]
