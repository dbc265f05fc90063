"""Raw text table to typed telemetry, and cleanup before an export. One projection each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlytics.functions import scalars as S
from plantlytics.roles import TIME, col, converted_flags, drop_duplicate_time, load_time_column


def typed_projection(
    raw: DataFrame, prefix: str | None = None, flags: tuple[str, ...] | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Type every column: the time strictly, the flags as INT, all else as DOUBLE.

    Source order is kept and ``datetime`` appended as the canonical time; it takes the
    place of a source column of that very name. ``keep`` names columns passed through.
    """
    columns = [c for c in raw.columns if c not in keep]
    time = load_time_column(columns)
    flags = converted_flags(columns, prefix) if flags is None else flags

    def typed(name: str):
        if name in keep:
            return col(name)
        if name in (time, TIME):
            return S.parse_log_time(col(time)).alias(name)
        return (S.flag_int(raw, name) if name in flags else S.num(raw, name)).alias(name)

    typed_columns = [typed(c) for c in raw.columns]
    if TIME not in raw.columns:
        typed_columns.append(S.parse_log_time(col(time)).alias(TIME))
    return raw.select(*typed_columns)


def drop_null_time(df: DataFrame) -> DataFrame:
    """Rows without a usable time are dropped.

    No global sort: operators that need an order sort inside their own windows, and
    ``write_silver`` orders the files.
    """
    return df.where(col(TIME).isNotNull())


def prepare(raw: DataFrame, prefix: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    return drop_null_time(typed_projection(raw, prefix, keep=keep))


def write_silver(df: DataFrame, path: str, time: str = TIME, row_id: str | None = None) -> None:
    """Typed table as Parquet, range-split and sorted by time, so date filters skip files.

    An instant of any number of rows is split too: by ``row_id``, or without one by a hash of the row's content, which a
    task that runs again finds alike. Only rows that agree in everything stay together.
    """
    order = [col(time), col(row_id) if row_id else F.xxhash64(*[col(c) for c in df.columns])]
    (
        df.withColumn("day", F.to_date(col(time)))
        .repartitionByRange(*order)
        .sortWithinPartitions("day", *order)
        .write.mode("errorifexists")
        .partitionBy("day")
        .parquet(path)
    )


def parse_times(df: DataFrame, name: str, formats: Sequence[str]) -> DataFrame:
    """A text column of times read by an ordered list of formats, unreadable ones NULL."""
    return df.withColumn(name, S.time_of(df, name, formats))


def time_audit(df: DataFrame, name: str, formats: Sequence[str] | None = None) -> DataFrame:
    """One row: how many times are ``readable``, ``missing`` (NULL, blank) and ``unreadable``."""
    read = S.time_of(df, name, formats).isNotNull()
    missing = col(name).isNull() | F.coalesce(col(name).cast("string").rlike(S.BLANK_PATTERN), F.lit(False))
    return df.agg(
        F.count_if(read).alias("readable"),
        F.count_if(~read & missing).alias("missing"),
        F.count_if(~read & ~missing).alias("unreadable"),
    )


def clean_null_tokens(df: DataFrame) -> DataFrame:
    """Blank text and spelled-out null tokens become NULL in text columns."""

    def clean(field: T.StructField):
        x = col(field.name)
        if not isinstance(field.dataType, T.StringType):
            return x
        return F.when(~x.rlike(S.NULL_TOKEN_PATTERN), x).alias(field.name)

    return df.select(*[clean(f) for f in df.schema])


def clean_for_export(df: DataFrame) -> DataFrame:
    return clean_null_tokens(drop_duplicate_time(df))
