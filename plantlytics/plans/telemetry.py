"""Telemetry tables made from the driver's test tables, at their full size."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlytics.operators.ordering import checkpointed
from plantlytics.roles import Roles, col

ROLES = Roles("datetime", "on_flag", "ready", "row_id")
PREAMBLE = 10
LOG_FILES = 8
ROWS_PER_LOG = 2_000_000
LINEITEM_KPIS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def tele(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as telemetry of one plant."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("ts").alias("datetime"),
        F.col("user_id").alias("unit"),
        _flag(k % 4 != 0).alias("on_flag"),
        _flag(F.col("event_type") != "error").alias("ready"),
        F.col("value").alias("kpi"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as telemetry with four KPIs and many rows per instant."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("datetime"),
        _flag(F.col("l_linestatus") == "O").alias("on_flag"),
        _flag(F.col("l_returnflag") != "R").alias("ready"),
        *LINEITEM_KPIS,
    )


def hot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as telemetry where one instant holds a third of all rows."""
    hot = F.lit("1998-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderkey") % 3 == 0, hot).otherwise(F.col("o_orderdate")).alias("datetime"),
        _flag(F.col("o_orderstatus") == "O").alias("on_flag"),
        _flag(F.col("o_orderpriority") != "5-LOW").alias("ready"),
        F.col("o_totalprice").alias("kpi"),
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text form of ``tele`` with broken times, blanks, null tokens and odd numbers."""
    rid = F.col("row_id")
    text = F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return tele(spark, sf_dir).select(
        "row_id",
        F.when(rid % 97 == 0, "bad-date").when(rid % 89 == 0, "").otherwise(text).alias("Date"),
        F.when(rid % 53 == 0, "").otherwise(F.col("on_flag").cast("string")).alias("X_ON"),
        F.when(rid % 59 == 0, "null").otherwise(F.col("ready").cast("string")).alias("X_READY"),
        F.when(rid % 17 == 0, "NaN")
        .when(rid % 19 == 0, "  ")
        .when(rid % 23 == 0, "abc")
        .when(rid % 29 == 0, "1d")
        .otherwise(F.col("kpi").cast("string"))
        .alias("kpi_txt"),
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch of lines as one text of several lines."""
    for batch in batches:
        if len(batch):
            text = "\n".join(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["value"])


def write_logs(
    df: DataFrame, path: str, columns: Sequence[str], order: str = "row_id", header: Sequence[str] | None = None,
    files: int | None = None, kind: str = "text", pad: int = 0,
) -> None:
    """Write text columns as plant logs in the order of ``order``, several files below ``path`` (added to what is there).

    ``header`` gives other names, ``kind`` text or csv the extension, ``pad`` makes the preamble longer by so many characters a line.
    Fewer files than asked for by the number of rows are sorted in parts; a task then copies its parts one after the other.
    """
    parts = max(LOG_FILES, math.ceil(df.select(order).count() / ROWS_PER_LOG))
    files = files or parts
    rest = "x" * pad
    top = [f"plant log{rest}", "\t".join(header or columns), *[f"preamble {i}{rest}" for i in range(PREAMBLE - 2)]]

    def with_preamble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string())], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], names=["value"])

    lines = (
        df.repartitionByRange(max(files, parts), col(order))
        .sortWithinPartitions(col(order))
        .select(F.concat_ws("\t", *[F.coalesce(col(c), F.lit("")) for c in columns]).alias("value"))
    )
    if files < parts:
        lines = checkpointed(lines.mapInArrow(_joined, "value string") if kind == "text" else lines).coalesce(files)
    lines = lines.mapInArrow(with_preamble, "value string")
    plain = {"sep": "\x01", "quote": "", "escape": "", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.write.mode("append").format(kind).options(**plain if kind == "csv" else {}).save(path)


def day_first(df: DataFrame) -> DataFrame:
    """``row_id`` and its time as text in one of three forms, or as no time at all."""
    rid, t = F.col("row_id"), F.col("datetime")
    forms = [F.date_format(t, f) for f in ("dd/MM/yyyy HH:mm:ss", "d-M-yyyy HH:mm", "yyyy-MM-dd HH:mm:ss.SSSSSS")]
    text = F.when(rid % 3 == 0, forms[0]).when(rid % 3 == 1, forms[1]).otherwise(forms[2])
    return df.select("row_id", F.when(rid % 101 == 0, "31/02/2024").when(rid % 103 == 0, " ").otherwise(text).alias("when"))
