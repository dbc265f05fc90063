"""Column selection, stored intermediate tables and small aggregates shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Just the named columns, cast; a missing one is NULL.

    Names are matched exactly and by place, so other columns whose names differ only by case, or
    that repeat a name, do no harm (of repeated names the first counts).
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select([
        (F.col(f"c{names.index(n)}") if n in names else F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()
    ])


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder, a cluster an error."""
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set(key, folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to a new table in the shared folder and read them back: cuts the lineage and
    outlives executors. The files stay for whoever still reads the result; remove them with the folder."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: the same partitions, in the same order, for every later read."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def fold(key: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; NULL ids count as fold 0 of an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def line(text: Column) -> Column:
    """The text, empty if NULL, with a line feed at its end: texts stay apart in one byte buffer."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\n"))


def schema(**kinds: str) -> str:
    return ", ".join(f"`{n}` {k}" for n, k in kinds.items())
