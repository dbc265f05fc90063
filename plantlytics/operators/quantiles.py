"""Exact quantiles of groups of any size, in two scans.

``percentile`` keeps every distinct value of a group in one task. Here

1. a mergeable sketch of ranks (Spark's own, of :data:`ACCURACY`) brackets each wanted rank by two values,
2. a second scan counts the values inside the brackets one by one, and those between them in one number each.

So what is shuffled is sketches, and then the values of a few ten-thousandths of the rows, counted before. If
a bracket of a huge group would still hold more than :data:`FEW` rows, it is sketched once more by itself, which
makes it some hundred times narrower. The sketch only saves work: the result follows from exact counts, and
a rank that lies outside its bracket is looked for where the counts say it is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A rank is sketched to within one part in so many.
ACCURACY = 10_000
#: Rows that a bracket may hold, and the steps in which a wider one is sketched again.
FEW, STEPS = 1 << 22, 1000
_V = "__v"
_BEYOND = float("inf")


@dataclass(frozen=True)
class _Span:
    """Value range of one group that should hold the wanted ranks, and about how many rows it has."""

    group: tuple
    lo: float
    hi: float
    ranks: tuple[int, ...]
    rows: float


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], sketches: Sequence[Row] | None = None
) -> DataFrame:
    """``keys`` and one column per probability, linearly interpolated, missing values left out.

    The jobs run here, and the result is a small local table that later steps can use
    many times. ``keys`` must have few distinct values, such as KPI and state. ``sketches`` are rows of the keys and the
    aggregates of :func:`sketch`, if an earlier scan has found them.
    """
    keys = list(keys)
    base = df.select(*keys, F.col(value).alias(_V)).where(F.col(_V).isNotNull())
    found: dict[tuple, float] = {}
    totals, spans = _sketched(base, keys, probs, sketches)
    while wide := [s for s in spans if s.rows > FEW and s.lo < s.hi]:
        spans = [s for s in spans if s not in wide] + _narrowed(base, keys, wide)
    while spans:
        exact, spans = _exact(base, keys, spans)
        found |= exact
    if not totals:
        return base.sparkSession.createDataFrame(
            [], T.StructType([df.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in names])
        )

    def between(group: tuple, p: float) -> float:
        position = (totals[group] - 1) * p
        a, b = math.floor(position), math.ceil(position)
        return found[group, a] * (1 - position + a) + found[group, b] * (position - a)

    values = [[between(group, p) for p in probs] for group in totals]
    return _table(base, keys, list(totals), **dict(zip(names, zip(*values))))


def _table(df: DataFrame, keys: list[str], groups: list[tuple], **columns: Sequence) -> DataFrame:
    """Small local table: one row per group with further columns."""
    key_columns = dict(zip(keys, zip(*groups)))
    data = {name: list(column) for name, column in {**key_columns, **columns}.items()}
    kinds = {f.name: f.dataType for f in df.schema}
    table = df.sparkSession.createDataFrame(pa.table(data))
    return table.select(*[F.col(k).cast(kinds[k]) for k in keys], *columns)


def approximate(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """The same columns from the sketch alone: one scan, lazily, each a value within one part in :data:`ACCURACY` of the wanted rank."""
    marks = df.groupBy(*keys).agg(F.percentile_approx(value, list(probs), ACCURACY).alias("__marks"))
    return marks.where("__marks IS NOT NULL").select(*keys, *[F.get("__marks", F.lit(i)).alias(n) for i, n in enumerate(names)])


def sketch(value: Column, probs: Sequence[float]) -> list[Column]:
    """Aggregates that bracket the probabilities: ``total``, ``lo``, ``hi`` and ``marks``, two per probability."""
    margin = 2 / ACCURACY  # one part for the sketch, one for the next whole rank
    marks = [min(max(p + m, 0.0), 1.0) for p in probs for m in (-margin, margin)]
    return [
        F.count(value).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.percentile_approx(value, marks, ACCURACY).alias("marks"),
    ]


def _sketched(
    base: DataFrame, keys: list[str], probs: Sequence[float], sketches: Sequence[Row] | None
) -> tuple[dict[tuple, int], list[_Span]]:
    """Rows of each group, and its brackets."""
    totals, spans = {}, []
    if sketches is None:
        sketches = base.groupBy(*keys).agg(*sketch(F.col(_V), probs)).collect()
    for r in sketches:
        if not r.total:
            continue
        group = tuple(r[k] for k in keys)
        totals[group] = r.total
        for i, p in enumerate(probs):
            position = (r.total - 1) * p
            # A small group is counted as a whole: its ranks may be off by one in the sketch.
            lo, hi = (r.lo, r.hi) if r.total <= ACCURACY else (r.marks[2 * i], r.marks[2 * i + 1])
            lo, hi = (r.lo if p * ACCURACY <= 2 else lo), (r.hi if (1 - p) * ACCURACY <= 2 else hi)
            spans.append(_Span(group, lo, hi, (math.floor(position), math.ceil(position)), min(1.0, 6 / ACCURACY) * r.total))
    return totals, spans


def _narrowed(base: DataFrame, keys: list[str], spans: list[_Span]) -> list[_Span]:
    """Each rank's own part of a bracket, from a sketch of the rows inside."""
    wanted = _table(base, keys, [s.group for s in spans], span=list(range(len(spans))), lo=[s.lo for s in spans], hi=[s.hi for s in spans])
    v, lo, hi = F.col(_V), F.col("lo"), F.col("hi")
    inside = F.when(v.between(lo, hi), v)
    rows = base.join(F.broadcast(wanted), keys).groupBy("span").agg(
        F.count_if(v < lo).alias("below"), F.count(inside).alias("rows"),
        F.percentile_approx(inside, [i / STEPS for i in range(STEPS + 1)], ACCURACY).alias("marks"),
    )
    out = []
    for r in rows.collect():
        s = spans[r.span]
        for rank in s.ranks:
            at = math.floor((rank - r.below) * STEPS / max(r.rows, 1))
            a, b = at - 1, at + 2
            out.append(_Span(
                s.group, r.marks[a] if 0 < a <= STEPS else s.lo, r.marks[b] if 0 <= b < STEPS else s.hi, (rank,), r.rows * 3 / STEPS))
    return out


def _counted(rows: DataFrame, ids: Sequence[Column | str], part: Column) -> DataFrame:
    return rows.groupBy(*ids, part.alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(_V).alias("part_lo"), F.max(_V).alias("part_hi")
    )


def _disjoint(spans: list[_Span]) -> list[_Span]:
    """Spans of one group in order, overlapping ones as one."""
    out: list[_Span] = []
    for s in sorted(spans, key=lambda s: (s.lo, s.hi)):
        if out and s.lo <= out[-1].hi:
            out[-1] = replace(out[-1], hi=max(out[-1].hi, s.hi), ranks=(*out[-1].ranks, *s.ranks))
        else:
            out.append(s)
    return out


def _exact(base: DataFrame, keys: list[str], spans: list[_Span]) -> tuple[dict[tuple, float], list[_Span]]:
    """Values at the wanted ranks from counts of the single values inside the spans, and spans for ranks that lie elsewhere."""
    groups: dict[tuple, list[_Span]] = {}
    for s in spans:
        groups.setdefault(s.group, []).append(s)
    groups = {g: _disjoint(own) for g, own in groups.items()}
    most = max(map(len, groups.values()))
    ends = {f"{end}{i}": [getattr(own[i], end) if i < len(own) else _BEYOND for own in groups.values()] for i in range(most) for end in ("lo", "hi")}
    wanted = _table(base, keys, list(groups), group=list(range(len(groups))), ranks=[sorted({r for s in own for r in s.ranks}) for own in groups.values()], **ends)
    v = F.col(_V)
    zone, inside = F.lit(0), F.lit(False)
    for i in range(most):
        zone = zone + (v > F.col(f"hi{i}")).cast("int")
        inside = inside | v.between(F.col(f"lo{i}"), F.col(f"hi{i}"))
    # Groups are few, so the table is small. Between two spans all values are one cell.
    cells = _counted(base.join(F.broadcast(wanted), keys), ["group", zone.alias("zone")], F.when(inside, v))
    earlier = Window.partitionBy("group").orderBy("zone", F.col("part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("from", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    ranks = F.broadcast(wanted.select("group", "ranks"))
    start, end = F.col("from"), F.col("from") + F.col("rows")
    held = cells.join(ranks, "group").withColumn("held", F.filter("ranks", lambda r: (r >= start) & (r < end))).where(F.size("held") > 0)
    names, found, elsewhere = list(groups), {}, []
    for r in held.collect():
        if r.part is None and r.part_lo != r.part_hi:
            elsewhere.append(_Span(names[r.group], r.part_lo, r.part_hi, tuple(r.held), r.rows))
        else:
            found |= {(names[r.group], rank): r.part_lo for rank in r.held}
    return found, elsewhere
