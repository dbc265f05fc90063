"""Coercions and predicates on single values, all built-in expressions.

Missing values are NULL everywhere. NaN and infinities become NULL on the way in,
because Spark orders NaN above every number and equal to itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlytics.roles import col

LOG_TIME_PATTERN = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d{0,9})?$"
#: Stands for the log time above among other formats; day-first formats, most detailed first.
ISO = "ISO"
DAY_FIRST = (
    "d/M/yyyy H:mm:ss[.SSSSSSSSS]", "d/M/yyyy H:mm", "d/M/yyyy", "d-M-yyyy H:mm:ss[.SSSSSSSSS]", "d-M-yyyy H:mm", "d-M-yyyy",
    "d.M.yyyy H:mm:ss[.SSSSSSSSS]", "d.M.yyyy H:mm", "d.M.yyyy",
)
# Text that stands for a missing value in an export.
NULL_TOKEN_PATTERN = r"(?i)^\s*(?:nan|null|none|nat)?\s*$"
BLANK_PATTERN = r"^\s*$"

_INFINITY = float("inf")


def finite(x: Column) -> Column:
    """NaN and infinities to NULL: Spark sorts NaN above infinity, so one test finds both."""
    return F.when(F.abs(x) < F.lit(_INFINITY), x)


#: What a cast strips from the ends of a text: blanks and control characters.
_STRIPPED = "".join(map(chr, [*range(33), *range(127, 160)]))


def text_to_num(x: Column) -> Column:
    """Plain decimal numbers, blanks around them allowed.

    ``try_cast`` also takes Java's '1d', '1f' and '0x1p3', which are no numbers here.
    """
    java_suffix = F.substring(F.rtrim(x, F.lit(_STRIPPED)), -1, 1).isin("d", "D", "f", "F")
    java_hex = x.contains("x") | x.contains("X")
    value = x.try_cast("double")
    return F.when((F.abs(value) < F.lit(_INFINITY)) & ~java_suffix & ~java_hex, value)


def to_num(x: Column, data_type: T.DataType) -> Column:
    """Value as DOUBLE, anything unusable as NULL."""
    if isinstance(data_type, T.StringType):
        return text_to_num(x)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return finite(x.cast("double"))
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return x.cast("double")
    return F.lit(None).cast("double")


def num(df: DataFrame, name: str) -> Column:
    """``to_num`` of a named column."""
    return to_num(col(name), df.schema[name].dataType)


def is_set(df: DataFrame, name: str) -> Column:
    """Flag of at least 1, NULL or false otherwise; plain enough to be pushed into a scan."""
    x, data_type = col(name), df.schema[name].dataType
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return (x >= 1) & ~F.isnan(x)
    if isinstance(data_type, T.NumericType):
        return x >= 1
    return to_num(x, data_type) >= 1


def to01(df: DataFrame, name: str) -> Column:
    """Truncate to an integer and clip to 0..1, unusable values count as 0.

    That is 1 exactly for values of at least 1 (an infinite number included).
    """
    return F.coalesce(is_set(df, name).cast("int"), F.lit(0))


def flag_int(df: DataFrame, name: str) -> Column:
    """Flag as INT, truncated but not clipped, missing as 0."""
    integral = isinstance(df.schema[name].dataType, T.IntegralType)
    value = col(name) if integral else num(df, name)
    return F.coalesce(value.try_cast("int"), F.lit(0))


def parse_log_time(x: Column) -> Column:
    """Strict log time ``Y-m-d H:M:S`` with up to nine fraction digits.

    The cast alone would also take a bare date or a zone; it is much faster than parsing
    by a format.
    """
    return F.when(x.rlike(LOG_TIME_PATTERN), x.try_cast("timestamp_ntz"))


def to_datetime(x: Column, data_type: T.DataType | None = None, formats: Sequence[str] | None = None) -> Column:
    """Lenient time: whatever Spark can read as a wall-clock time, else NULL.

    With ``formats``, datetime patterns of Spark, a text is read by the first that fits the whole of it, blanks around it
    aside, and by nothing else: name :data:`ISO` among them where such times occur too. Their order settles
    texts that fit several, such as day-first and month-first dates.
    """
    if isinstance(data_type, T.TimestampNTZType):
        return x
    if formats is None:
        return x.try_cast("timestamp_ntz")
    text = F.btrim(x, F.lit(_STRIPPED))
    readings = [parse_log_time(text) if f == ISO else F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*readings)


def time_of(df: DataFrame, name: str, formats: Sequence[str] | None = None) -> Column:
    """A time column; text is read leniently or by formats, unreadable text is NULL."""
    is_text = isinstance(df.schema[name].dataType, T.StringType)
    return to_datetime(col(name), formats=formats) if is_text else col(name)


def micros(x: Column) -> Column:
    """Microseconds since the epoch of a wall-clock time (session zone UTC)."""
    return F.unix_micros(x.cast("timestamp"))


def float_text(x: Column) -> Column:
    """Shortest decimal text of a DOUBLE the way Python prints it.

    Plain digits from 1e-4 up to 1e16, else an exponent of at least two digits.
    """
    java = x.cast("string")
    plain = F.regexp_replace(java.try_cast("decimal(38,21)").cast("string"), r"(?<=\.\d{1,30})0+$", "")
    parts = F.split(java, "E")
    exponent = F.get(parts, F.lit(1)).try_cast("int")
    mantissa = F.regexp_replace(F.get(parts, F.lit(0)), r"\.0$", "")
    scientific = F.concat(
        mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0")
    )
    size = F.abs(x)
    return (
        F.when(F.isnan(x), "nan")
        .when(size == F.lit(_INFINITY), F.when(x > 0, "inf").otherwise("-inf"))
        .when((size >= 1e-3) & (size < 1e7) | (size == 0), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .when(F.abs(exponent) >= 100, F.concat(mantissa, F.when(exponent < 0, "e-").otherwise("e+"),
                                               F.abs(exponent).cast("string")))
        .otherwise(scientific)
    )


def as_text(df: DataFrame, name: str) -> Column:
    """Any column as the text a search looks at; NULL stays NULL."""
    x, data_type = col(name), df.schema[name].dataType
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return float_text(x.cast("double"))
    if isinstance(data_type, T.BooleanType):
        return F.when(x, "True").otherwise(F.when(~x, "False"))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_trunc("second", x) == x
        return F.when(whole, F.date_format(x, "yyyy-MM-dd HH:mm:ss")).otherwise(
            F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        )
    return x.cast("string")


def interval_literal(seconds: int) -> Column:
    return F.expr(f"INTERVAL {int(seconds)} SECOND")
