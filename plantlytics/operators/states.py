"""Plant states: how long in each, when they change, and the stretches in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlytics.functions import scalars as S
from plantlytics.operators.filters import ready_filter
from plantlytics.operators.ordering import (
    CHUNK, LOCAL, NEXT, WEIGHT, few, in_order, joined, last_chunk, neighbours, row_blocks, run_pieces, time_order, totals_before, with_fields, written,
)
from plantlytics.roles import Roles, col

# Names of the three shares and codes of the three states.
ON_READY, OFF_READY, NOT_READY = "ON & Ready", "OFF & Ready (Desperdiciado)", "OFF & No Ready"
STATUS_ON, STATUS_OFF_READY, STATUS_OTHER = 2, 1, 0
ZERO_LENGTH_SECONDS = 60  # a run of one instant is drawn one minute long


def efficiency_counts(df: DataFrame, roles: Roles) -> list[Column]:
    """Aggregates: records, time span and records per state; without both flags the states are zero."""
    if roles.on in df.columns and roles.ready in df.columns:
        on, ready = S.flag_int(df, roles.on), S.flag_int(df, roles.ready)
        on_ready, off_ready = F.count_if((on == 1) & (ready == 1)), F.count_if((on == 0) & (ready == 1))
        not_ready = F.count_if(ready == 0)
    else:
        on_ready = off_ready = not_ready = F.sum(F.lit(0).cast("long"))
    return [
        F.count(F.lit(1)).alias("total_records"),
        F.min(col(roles.time)).alias("date_min"),
        F.max(col(roles.time)).alias("date_max"),
        *[F.coalesce(x, F.lit(0).cast("long")).alias(n) for n, x in (("on_ready", on_ready), ("off_ready", off_ready), ("not_ready", not_ready))],
    ]


def with_efficiency(counts: DataFrame) -> DataFrame:
    share = 100.0 * F.try_divide(F.col("on_ready"), F.col("total_records"))
    return counts.withColumn("efficiency_pct", F.coalesce(share, F.lit(0.0)))


def state_efficiency(df: DataFrame, roles: Roles) -> DataFrame:
    """One row: records, time span, records per state and ON share of all records.

    Each record stands for one minute. The share is of *all* records, and records
    whose flags are neither 0 nor 1 count in no state. Without both flags the counts
    are zero. One pass, partial sums before the exchange.
    """
    return with_efficiency(df.agg(*efficiency_counts(df, roles)))


def state_shares(df: DataFrame, roles: Roles) -> DataFrame:
    """``(state, records, share_pct)`` of the three states among themselves."""
    return shares_of(state_efficiency(df, roles))


def shares_of(counts: DataFrame) -> DataFrame:
    whole = F.col("on_ready") + F.col("off_ready") + F.col("not_ready")
    rows = [
        F.struct(F.lit(label).alias("state"), F.col(name).alias("records"),
                 (100.0 * F.try_divide(F.col(name), whole)).alias("share_pct"))
        for label, name in ((ON_READY, "on_ready"), (OFF_READY, "off_ready"), (NOT_READY, "not_ready"))
    ]
    return counts.select(F.inline(F.array(*rows)))


def status(df: DataFrame, roles: Roles) -> Column:
    """Timeline status: ON is 2 whatever the readiness, OFF and ready is 1, all else 0.

    This differs from the counts above on purpose: there ON needs readiness too.
    """
    if roles.on is None:
        return F.lit(None).cast("int")
    on = S.flag_int(df, roles.on)
    ready = S.flag_int(df, roles.ready) if roles.ready else F.lit(0)
    return (
        F.when(on == 1, STATUS_ON)
        .when((on == 0) & (ready == 1), STATUS_OFF_READY)
        .otherwise(STATUS_OTHER)
        .cast("int")
    )


def status_timeline(df: DataFrame, roles: Roles) -> DataFrame:
    """Without an ON flag there is no status and no row."""
    return (df if roles.on else df.limit(0)).withColumn("status", status(df, roles))


def _offsets(ends: DataFrame, keys: list[str], chunks: int) -> DataFrame:
    """To ``lo, hi`` (local block numbers), ``first`` and ``last`` state of each chunk: the number of its first block (``base``)
    and the state that follows the chunk."""
    linked = neighbours(ends, keys, chunks)
    joint = F.coalesce((F.col("previous") != F.col("first")).cast("long"), F.lit(0))
    linked = linked.withColumn("joint", joint).withColumn("steps", F.col("hi") - F.col("lo") + F.col("joint"))
    return totals_before(linked, keys, chunks, "steps").withColumn("base", F.col("before") + F.col("joint") + 1 - F.col("lo"))


def _ends(rows: DataFrame, keys: list[str], state: str) -> DataFrame:
    names = [col(k) for k in [*keys, CHUNK]]
    return rows.groupBy(*names).agg(
        F.min(LOCAL).alias("lo"), F.max(LOCAL).alias("hi"), F.min_by(state, LOCAL).alias("first"), F.max_by(state, LOCAL).alias("last"))


def _numbered(df: DataFrame, roles: Roles, rows_per_chunk: int | None) -> DataFrame:
    """Add the running ``block`` number of equal ``state``, the state of the next row and the weight of the row.

    The rows are shuffled once, sorted, numbered inside their chunks and written. One row per chunk (and unit) says how many
    blocks came before; it is broadcast to the rows unless there are too many.
    """
    weighed, order = time_order(df, roles)
    names = [*roles.keys, *[c for c in weighed.columns if c not in roles.keys]]
    rows = in_order(weighed, order, rows_per_chunk).select(*[col(c) for c in names])
    kinds = with_fields(rows, *[T.StructField(n, T.LongType()) for n in (CHUNK, LOCAL)], T.StructField(NEXT, rows.schema["state"].dataType))
    stepped = written(rows.mapInArrow(row_blocks(len(roles.keys), names.index("state")), kinds), "blocks")
    offsets = few(_offsets(_ends(stepped, roles.keys, "state"), roles.keys, last_chunk(stepped)), "offsets")
    offsets = offsets.select(*[col(k) for k in roles.keys], CHUNK, "base", F.col("following").alias("__following"))
    return (
        joined(stepped, offsets, [*roles.keys, CHUNK])
        .withColumn("block", F.col("base") + F.col(LOCAL))
        .withColumn(NEXT, F.coalesce(NEXT, "__following"))
    )


def status_runs(df: DataFrame, roles: Roles, rows_per_chunk: int | None = None) -> DataFrame:
    """``(block, status, x0, x1, n)``: maximal stretches of equal status.

    ``x1`` is the last time inside the run, one minute later for a run of one instant.
    A table without readiness has no runs. The rows are shuffled and sorted once and give the runs of each
    chunk; only these are written, numbered and stitched across chunks.
    """
    d = _timed(df, roles, [status(df, roles).alias("status")])
    if roles.ready is None or roles.on is None:
        d = d.limit(0)
    weighed, order = time_order(d, roles)
    names = [*roles.keys, roles.time, "status", WEIGHT]
    rows = in_order(weighed, order, rows_per_chunk).select(*[col(c) for c in names])
    time, long = rows.schema[roles.time].dataType, T.LongType()
    kinds = T.StructType([*[rows.schema[k] for k in roles.keys], *[T.StructField(n, kind) for n, kind in (
        (CHUNK, long), (LOCAL, long), ("state", T.IntegerType()), ("x0", time), ("x1", time), ("n", long))]])
    keys = [col(k) for k in [*roles.keys, CHUNK]]
    pieces = written(rows.mapInArrow(run_pieces(len(roles.keys)), kinds), "runs")
    offsets = _offsets(_ends(pieces, roles.keys, "state"), roles.keys, last_chunk(pieces)).select(*keys, "base")
    runs = (
        joined(pieces, offsets, [*roles.keys, CHUNK])
        .withColumn("block", F.col("base") + F.col(LOCAL))
        .groupBy(*[col(k) for k in roles.keys], "block")
        .agg(
            F.max("state").alias("status"),
            F.min("x0").alias("x0"),
            F.max("x1").alias("__end"),
            F.sum("n").alias("n"),
        )
    )
    x1 = F.when(F.col("__end") == F.col("x0"), F.col("__end") + S.interval_literal(ZERO_LENGTH_SECONDS))
    return runs.select(
        *[col(k) for k in roles.keys], "block", "status", "x0", x1.otherwise(F.col("__end")).alias("x1"), "n"
    )


def _timed(df: DataFrame, roles: Roles, columns: list[Column]) -> DataFrame:
    """Unit, time and ``row_id`` with further columns, without rows that have no time."""
    ids = [*roles.keys, *([roles.row_id] if roles.row_id else [])]
    d = df.select(*[col(c) for c in ids], S.time_of(df, roles.time).alias(roles.time), *columns)
    return d.where(col(roles.time).isNotNull())


def _ready_series(df: DataFrame, roles: Roles, kpis: list[str]) -> DataFrame:
    """Ready rows with a time: ``state`` and the KPIs as numbers."""
    ready = ready_filter(df, roles.ready) if roles.on else df.limit(0)
    state = S.to01(ready, roles.on) if roles.on else F.lit(0)
    return _timed(ready, roles, [state.alias("state"), *[S.num(ready, k).alias(k) for k in kpis]])


def state_blocks(
    df: DataFrame, roles: Roles, kpis: list[str], rows_per_chunk: int | None = None
) -> DataFrame:
    """Ready rows with the running number of their ON/OFF block.

    Numbering follows the ready filter, so a block runs on across gaps of readiness.
    """
    series = _ready_series(df, roles, kpis)
    numbered = _numbered(series, roles, rows_per_chunk)
    if roles.row_id is None:  # one row per weight
        numbered = numbered.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col(WEIGHT))).alias("__copy"))
    return numbered.select(*[col(c) for c in series.columns], "block")


def block_points(
    df: DataFrame, roles: Roles, kpis: list[str], rows_per_chunk: int | None = None
) -> DataFrame:
    """Points to draw per block: its own rows and the last row before it.

    The last row of each block is emitted a second time for the block that follows;
    ``block_state`` is the state of the block the point is drawn with.
    """
    series = _ready_series(df, roles, kpis)
    numbered = _numbered(series, roles, rows_per_chunk)
    own = F.struct(F.col("block").alias("block"), F.col("state").alias("block_state"))
    carried = F.struct((F.col("block") + 1).alias("block"), F.col(NEXT).alias("block_state"))
    is_last = F.col(NEXT).isNotNull() & (F.col(NEXT) != F.col("state"))
    copies = F.array(own) if roles.row_id else F.array_repeat(own, F.col(WEIGHT).cast("int"))
    return numbered.select(
        *[col(c) for c in series.columns],
        F.inline(F.when(is_last, F.concat(copies, F.array(carried))).otherwise(copies)),
    )
