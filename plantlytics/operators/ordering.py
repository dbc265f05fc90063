"""Time-ordered chunks: how ordered operators run on many tasks.

A window over the whole table would sort it in one task. Instead Spark range-partitions the
rows by time, an ordered operator works inside each sorted partition, a chunk, and a small
table with one row per chunk carries state across the borders. What Spark cuts at is Spark's
own affair: the chunks are written once, with their numbers, and everything after reads
them there, so no cut point passes the driver and a lost task can't see other chunks.

The small table is scanned in levels of :data:`WIDTH` rows: inside groups of so many chunks,
then inside groups of so many groups, and so on. No task gets more than that many rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlytics.roles import Roles, col
from plantlytics.session import fresh_path, shared_dir

CHUNK, LOCAL, NEXT, WEIGHT = "__chunk", "__local", "__next", "__weight"
WIDTH = 256
#: Rows of a table that may be broadcast: one row per chunk, or per file, of a few numbers each.
FEW = 1_000_000
#: Chunks that a number of rows per chunk can lead to, if Spark isn't set to more: what is shuffled to them is chunks times tasks blocks.
MOST_CHUNKS = 512


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a new table below the shared folder."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint below the shared folder: the same partitions, in the same order, for every later read."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL; our own, which begin with two underscores, never are."""
    other = right.withColumnsRenamed({k: f"__other_{k}" for k in keys})
    same = [(col(k) == col(f"__other_{k}")) if k.startswith("__") else col(k).eqNullSafe(col(f"__other_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"__other_{k}" for k in keys])


def few(df: DataFrame, label: str) -> DataFrame:
    """Written table, to be broadcast if it has at most :data:`FEW` rows."""
    table = written(df, label)
    return F.broadcast(table) if table.count() <= FEW else table


def in_order(df: DataFrame, order: Sequence[Column | str], rows_per_chunk: int | None = None) -> DataFrame:
    """Sorted range partitions: as many as Spark is set to, or one per ``rows_per_chunk`` rows.

    These are larger where there would be more than :data:`MOST_CHUNKS` and than Spark is set to.
    """
    if rows_per_chunk is None:
        return df.repartitionByRange(*order).sortWithinPartitions(*order)
    most = max(MOST_CHUNKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = min(most, max(1, math.ceil(df.count() / rows_per_chunk)))
    return df.repartitionByRange(chunks, *order).sortWithinPartitions(*order)


def time_order(df: DataFrame, roles: Roles) -> tuple[DataFrame, list[Column]]:
    """Rows with a :data:`WEIGHT`, and what orders them: unit, time and ``row_id``.

    Without a ``row_id`` rows of one time follow a hash of their content, then the content, so there is one
    order and an instant of any number of rows can be split. Rows that agree in everything become one of that weight.
    """
    names = [col(k) for k in roles.keys]
    if roles.row_id:
        return df.withColumn(WEIGHT, F.lit(1).cast("long")), [*names, *[col(c) for c in roles.order]]
    merged = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias(WEIGHT))
    content = [col(c) for c in df.columns]
    return merged, [*names, col(roles.time), F.xxhash64(*content), *content]


def _changed(column: pa.Array, last: pa.Array | None) -> np.ndarray:
    """Which values differ from the one before; the first is compared with ``last``."""
    before = pa.concat_arrays([last if last is not None else column[:1], column[:-1]])
    differ = pc.fill_null(pc.not_equal(column, before), False)
    return pc.or_(differ, pc.not_equal(pc.is_null(column), pc.is_null(before))).to_numpy(zero_copy_only=False)


def _numbered(units: int, state: int, batch: pa.RecordBatch, last: pa.RecordBatch | None, number: int) -> np.ndarray:
    """Number of the block of equal unit and state that each row belongs to, counted on from ``number``."""
    new = np.zeros(len(batch), bool)
    for i in [*range(units), state]:
        new |= _changed(batch.column(i), None if last is None else last.column(i))
    return number + np.cumsum(new)


def run_pieces(units: int):
    """Sorted rows ``unit ..., time, state, weight`` to stretches of equal state, at least one per Arrow batch:
    ``unit ..., chunk, local, state, x0, x1, n``. Pieces with the same ``local`` belong together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, last, number = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not len(batch):
                continue
            local = _numbered(units, units + 1, batch, last, number)
            first = np.flatnonzero(np.diff(local, prepend=local[0] - 1))
            end = np.append(first[1:], len(batch)) - 1
            time, weight = batch.column(units), batch.column(units + 2).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(pa.array(first)) for i in range(units)], pa.array(np.full(len(first), chunk, np.int64)),
                 pa.array(local[first]), batch.column(units + 1).take(pa.array(first)), time.take(pa.array(first)), time.take(pa.array(end)),
                 pa.array(np.add.reduceat(weight, first))],
                [*batch.schema.names[:units], CHUNK, LOCAL, "state", "x0", "x1", "n"])
            last, number = batch.slice(len(batch) - 1), int(local[-1])

    return run


def row_blocks(units: int, state: int):
    """Sorted rows with ``unit ...`` first to the same rows with chunk, ``local`` number and the state of the unit's next row in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, number, last, held = TaskContext.get().partitionId(), 0, None, None

        def out(rows: pa.RecordBatch, local: np.ndarray, following: pa.RecordBatch | None) -> pa.RecordBatch:
            column = rows.column(state)
            after = pa.concat_arrays([column[1:], following.column(state) if following is not None else pa.nulls(1, column.type)])
            for i in range(units):
                unit = rows.column(i)
                ends = np.append(_changed(unit, None)[1:], following is None or _changed(following.column(i), unit[-1:])[0])
                after = pc.if_else(pa.array(ends), pa.scalar(None, column.type), after)
            return pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(np.full(len(rows), chunk, np.int64)), pa.array(local), after], [*rows.schema.names, CHUNK, LOCAL, NEXT])

        for batch in batches:
            if not len(batch):
                continue
            local = _numbered(units, state, batch, last, number)
            if held is not None:
                yield out(*held, batch.slice(0, 1))
            held, last, number = (batch, local), batch.slice(len(batch) - 1), int(local[-1])
        if held is not None:
            yield out(*held, None)

    return run


def with_fields(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


def neighbours(ends: DataFrame, keys: Sequence[str], chunks: int) -> DataFrame:
    """To ``first`` and ``last`` of each chunk the ``last`` of the chunk before (``previous``) and the ``first`` of the one behind
    (``following``), of the same keys; NULL at the ends. Chunks are counted from 0 to ``chunks``, some may be missing."""
    names = [col(k) for k in keys]
    inside = Window.partitionBy(*names, "__group").orderBy(CHUNK)
    table = ends.withColumn("__group", F.floor(F.col(CHUNK) / WIDTH))
    table = table.withColumn("previous", F.lag("last").over(inside)).withColumn("following", F.lead("first").over(inside))
    if chunks <= WIDTH:
        return table.drop("__group")
    over = table.groupBy(*names, F.col("__group")).agg(F.min_by("first", CHUNK).alias("first"), F.max_by("last", CHUNK).alias("last"))
    over = neighbours(over.withColumnRenamed("__group", CHUNK), keys, math.ceil(chunks / WIDTH))
    over = over.select(*names, F.col(CHUNK).alias("__group"), F.col("previous").alias("__p"), F.col("following").alias("__f"))
    wide = joined(table, over, [*keys, "__group"])
    return wide.withColumn("previous", F.coalesce("previous", "__p")).withColumn("following", F.coalesce("following", "__f")).drop("__group", "__p", "__f")


def totals_before(table: DataFrame, keys: Sequence[str], chunks: int, value: str) -> DataFrame:
    """The table with ``before``: the sum of ``value`` over the chunks of the same keys that come earlier."""
    names = [col(k) for k in keys]
    inside = Window.partitionBy(*names, "__group").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    grouped = table.withColumn("__group", F.floor(F.col(CHUNK) / WIDTH))
    here = grouped.withColumn("before", F.coalesce(F.sum(value).over(inside), F.lit(0).cast("long")))
    if chunks <= WIDTH:
        return here.drop("__group")
    over = grouped.groupBy(*names, F.col("__group").alias(CHUNK)).agg(F.sum(value).alias(value))
    over = totals_before(over, keys, math.ceil(chunks / WIDTH), value).select(*names, F.col(CHUNK).alias("__group"), F.col("before").alias("__more"))
    return joined(here, over, [*keys, "__group"]).withColumn("before", F.col("before") + F.col("__more")).drop("__group", "__more")


def last_chunk(table: DataFrame) -> int:
    """How many chunks there can be, for the number of levels."""
    return (table.agg(F.max(CHUNK).alias("m")).first().m or 0) + 1


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "number", rows_per_chunk: int | None = None, value: str | None = None) -> DataFrame:
    """Running number of each row from 1 on (or, with ``value``, the sum of it over the rows before) in the order of unique columns."""
    chunked = in_order(df, [col(c) for c in order], rows_per_chunk).withColumn(CHUNK, F.spark_partition_id().cast("long"))
    chunked = written(chunked, "chunks")
    amount = F.lit(1).cast("long") if value is None else col(value)
    sizes = chunked.groupBy(CHUNK).agg(F.sum(amount).alias("__size"))
    offsets = few(totals_before(sizes, [], last_chunk(chunked), "__size"), "offsets").select(CHUNK, "before")
    frame = Window.partitionBy(CHUNK).orderBy(*[col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0 if value is None else -1)
    running = F.coalesce(F.sum(amount).over(frame), F.lit(0).cast("long"))
    return chunked.withColumn(name, running).join(offsets, CHUNK).withColumn(name, F.col(name) + F.col("before")).drop(CHUNK, "before")
