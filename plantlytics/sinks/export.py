"""Text exports: a folder of part files, written by all tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plantlytics.functions import scalars as S
from plantlytics.operators.prepare import clean_for_export
from plantlytics.roles import col

MISSING_IN_CSV = "Null"  # fixed value: how an export spells a missing value


def _text_form(df: DataFrame) -> DataFrame:
    """Numbers and times in the text form users of the export read."""
    kinds = (T.FloatType, T.DoubleType, T.TimestampNTZType, T.TimestampType, T.BooleanType)
    return df.select(
        *[S.as_text(df, f.name).alias(f.name) if isinstance(f.dataType, kinds) else col(f.name) for f in df.schema]
    )


def _ordered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Part files in the order of their names, if an order is given: a distributed sort."""
    return df.orderBy(*[col(c) for c in order]) if order else df


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Cleaned table with a header; missing values read ``Null``."""
    (
        _text_form(clean_for_export(_ordered(df, order)))
        .write.mode("errorifexists")
        .options(header=True, nullValue=MISSING_IN_CSV, emptyValue="", escape='"')
        .csv(path)
    )


def write_tsv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Table as it is, tab-separated with a header; missing values are empty."""
    (
        _text_form(_ordered(df, order))
        .write.mode("errorifexists")
        .options(header=True, sep="\t", nullValue="", emptyValue="", escape='"')
        .csv(path)
    )
