"""Hard negatives: exact nearest rows of another label inside a band of scores, by length buckets and coordinate pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlytics.llm.common import pick, read, schema, stored
from plantlytics.llm.kernels import gather

#: Positives of an anchor, negatives of each, and the band of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Steps of a unit that components are counted in.
STEPS = 256
#: Rows and bytes of a bucket, and of the anchors that one task searches for; buckets it searches.
ROWS, BYTES, RUN = 1024, 1 << 22, 16
#: Focus coordinates of an anchor; its candidates are verified one by one if a range leaves less than this share of a bucket.
FOCUS, SHARE = 3, 0.25
#: More than the rounding errors of cosines and angles.
SLACK = 1e-6
#: Scores are cut off here; beyond is what an anchor without any window needs.
LEAST, MOST, NONE = -(2**63) + 2, 2**63 - 2, 2**63 - 1

ROW = schema(vec_id="bigint", label="bigint", length="double", vector="binary")
BUCKET = schema(b="bigint", longest="double", size="int", ids="binary", anon="binary", labels="binary", matrix="binary", lists="binary")
FOUND = schema(vec_id="bigint", label="bigint", key="bigint", w="int", id="bigint", score="bigint")


def _whole_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``vec_id, label, embedding`` to rows with ``floor(256 x)`` as doubles in ``vector``, and the vector's length. Repeats in a batch go."""
    for batch in batches:
        for a in range(0, len(batch), ROWS):
            part = batch.slice(a, ROWS)
            ids, labels, lists = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)
            off = lists.offsets.to_numpy()
            with np.errstate(over="ignore"):
                x = np.floor(np.nan_to_num(STEPS * lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]])) + 0.0
                length = np.sqrt(np.bincount(np.repeat(np.arange(len(ids)), np.diff(off)), x * x, len(ids)))
            rows = {}
            for i, (key, label) in enumerate(zip(ids, labels, strict=True)):
                rows.setdefault((key, label, x[off[i] - off[0] : off[i + 1] - off[0]].tobytes()), length[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([*rows.values()], pa.float64()),
                 pa.array([r[2] for r in rows], pa.binary())], ["vec_id", "label", "length", "vector"])


def _matrix(vectors: list[bytes]) -> np.ndarray:
    """Vectors side by side; shorter ones end in zeros."""
    dims = max(map(len, vectors)) // 8
    return np.frombuffer(b"".join(v.ljust(8 * dims, b"\0") for v in vectors), np.float64).reshape(len(vectors), dims)


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((matrix * matrix).sum(1))
        return length, np.nan_to_num(matrix / np.where(length > 0, length, 1)[:, None])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of label and falling length to buckets: the vectors, and per coordinate the places sorted by its share of the length."""
    number, held, last = TaskContext.get().partitionId() << 33, [], None

    def flush() -> pa.RecordBatch:
        nonlocal number
        ids, labels, vectors = zip(*held, strict=True)
        matrix = _matrix(vectors)
        length, unit = _unit(matrix)
        lists = np.argsort(unit.T, axis=1, kind="stable").astype(np.int16)
        number += 1
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([number - 1], pa.int64()), pa.array([length.max()], pa.float64()), pa.array([len(ids)], pa.int32()),
             *(pa.array([x.tobytes()], pa.binary()) for x in (
                 np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids]), np.array(labels, np.int64), matrix, lists))],
            ["b", "longest", "size", "ids", "anon", "labels", "matrix", "lists"])

    room = BYTES
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if row == last:
                continue
            if len(held) >= ROWS or held and room < len(row[2]):
                yield flush()
                room = BYTES
            held.append(row)
            room -= len(row[2])
            last = row
    if held:
        yield flush()


def _exact(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows by Python's whole numbers, cut off at 64 bits."""
    whole = [[int(v) for v in row] for row in x]
    out = [[min(max(sum(p * q for p, q in zip(row, y, strict=True)), LEAST), MOST) for y in whole] for row in ([int(v) for v in row] for row in a)]
    return np.array(out, np.int64).reshape(len(a), len(x))


class Bucket:
    """One length bucket with its sorted coordinate lists."""

    def __init__(self, row: dict):
        n = row["size"]
        self.ids, self.anon = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["anon"], bool)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.matrix = np.frombuffer(row["matrix"], np.float64).reshape(n, -1)
        self.longest, self.places = row["longest"], np.frombuffer(row["lists"], np.int16).reshape(-1, n)
        self.lists = None

    def ranges(self, focus: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end place, in the sorted list of each focus coordinate, of the values from low to high."""
        if self.lists is None:
            self.unit = _unit(self.matrix)[1]
            spread = np.take_along_axis(self.unit.T, self.places.astype(np.int64), 1) + 4.0 * np.arange(self.unit.shape[1])[:, None]
            self.lists = spread.ravel()  # all lists in one rising row, each four beyond the last
        first = np.searchsorted(self.lists, low + 4.0 * focus, "left") - focus * len(self.ids)
        end = np.searchsorted(self.lists, high + 4.0 * focus, "right") - focus * len(self.ids)
        return first, end


class Best:
    """The ``k`` best candidates so far of each anchor in one window of scores: higher first, ties by smaller id, NULL ids last."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]

    def needed(self) -> np.ndarray:
        """Least score that can still matter to each anchor; anchors with an empty window need none."""
        a, score = self.rows[:2]
        least = self.low.copy()
        full = np.flatnonzero(np.bincount(a, minlength=len(least)) == self.k)
        last = np.searchsorted(a, full, "right") - 1
        least[full] = np.maximum(least[full], score[last])
        return np.where(self.low > self.high, NONE, least)

    def add(self, a: np.ndarray, score: np.ndarray, anon: np.ndarray, ids: np.ndarray) -> None:
        inside = (score >= self.low[a]) & (score <= self.high[a])
        if not inside.any():
            return
        a, score, anon, ids = (np.concatenate((x, y[inside])) for x, y in zip(self.rows, (a, score, anon, ids), strict=True))
        order = np.lexsort((ids, anon, -score, a))
        a = a[order]
        place = np.arange(len(a)) - np.searchsorted(a, a, "left")
        order = order[place < self.k]
        self.rows = [a[place < self.k], score[order], anon[order], ids[order]]


def candidates(matrix: np.ndarray, needed: np.ndarray, bucket: Bucket, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, places in the bucket and scores of all pairs whose score is at least what the anchor needs.

    An anchor passes a bucket over if the product of lengths is too small. In the others a row ``x`` must have a cosine of at least
    ``t = needed / (|a| longest)``; with ``a_f = cos(beta)`` and ``t = cos(gamma)`` its share ``x_f`` then lies between ``cos(beta + gamma)``
    and ``cos(beta - gamma)``. Rows inside the ranges of all focus coordinates are verified; where no range is short, the whole bucket is.
    ``wide``: numbers so large that doubles are not exact; nothing is passed over, all is verified by whole numbers.
    """
    dims = max(matrix.shape[1], bucket.matrix.shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, dims - m.shape[1])))
    a, x = pad(matrix), pad(bucket.matrix)
    if wide:
        score = _exact(a, x)
        i, j = np.nonzero(score >= needed[:, None])
        return i, j, score[i, j]
    length, unit = _unit(matrix)
    bound = length * bucket.longest
    alive = bound * (1 + SLACK) >= needed
    narrow = np.flatnonzero(alive & (needed > 0) & (bound > 0)) if bucket.matrix.shape[1] == matrix.shape[1] and matrix.shape[1] else np.zeros(0, np.int64)
    parts, whole = [], alive.copy()
    if len(narrow):
        focus = np.argsort(-np.abs(unit[narrow]), axis=1, kind="stable")[:, :FOCUS]
        beta = np.arccos(np.clip(np.take_along_axis(unit[narrow], focus, 1), -1, 1))
        gamma = np.arccos(np.clip(needed[narrow] / bound[narrow], -1, 1))[:, None]
        low = np.cos(np.minimum(beta + gamma, math.pi)) - SLACK
        high = np.cos(np.maximum(beta - gamma, 0)) + SLACK
        first, end = bucket.ranges(focus, low, high)
        short = (end - first).argmin(1)
        pick_ = np.arange(len(narrow)), short
        few = end[pick_] - first[pick_] < SHARE * len(bucket.ids)
        whole[narrow[few]] = False
        n, pick_, short = np.flatnonzero(few), (pick_[0][few], short[few]), short[few]
        count = np.maximum(end[pick_] - first[pick_], 0)
        at = np.repeat(n, count)
        place = bucket.places[np.repeat(focus[pick_], count), gather(first[pick_], count)].astype(np.int64)
        value = bucket.unit[place[:, None], focus[at]]
        good = ((value >= low[at]) & (value <= high[at])).all(1)
        at, place = narrow[at[good]], place[good]
        for s in range(0, len(at), 1 << 16):
            i, j = at[s : s + (1 << 16)], place[s : s + (1 << 16)]
            parts.append((i, j, np.einsum("ij,ij->i", a[i], x[j])))
    rest = np.flatnonzero(whole)
    if len(rest):
        score = a[rest] @ x.T
        i, j = np.nonzero(score >= needed[rest][:, None])
        parts.append((rest[i], j, score[i, j]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    score = score.astype(np.int64)
    enough = score >= needed[i]
    return i[enough], j[enough], score[enough]


def _search(k: int, same: bool):
    """Cogroup of anchors ``vec_id, label, key, vector, low, high`` (one window or several) and buckets, to the best of each anchor and window."""
    names = ["vec_id", "label", "key", "w", "id", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in names]
        if left.num_rows and right.num_rows:
            ids, labels, keys = (left[c].to_numpy() for c in ("vec_id", "label", "key"))
            matrix = _matrix(left["vector"].to_pylist())
            low, high = left["low"].to_pylist(), left["high"].to_pylist()
            best = []
            for w in range(max(map(len, low))):  # an anchor with fewer windows has empty ones
                best.append(Best(np.array([x[w] if w < len(x) else MOST for x in low], np.int64), np.array([x[w] if w < len(x) else LEAST for x in high], np.int64), k))
            most = float(np.abs(matrix).max(initial=0))
            for row in sorted(right.to_pylist(), key=lambda r: (-r["longest"], r["b"])):
                bucket = Bucket(row)
                needed = np.minimum.reduce([b.needed() for b in best])
                own = (labels >= bucket.labels.min()) & (labels <= bucket.labels.max()) if same else np.ones(len(ids), bool)
                own = np.flatnonzero(own & (needed < NONE))
                if not len(own):
                    continue
                wide = most * float(np.abs(bucket.matrix).max(initial=0)) * max(matrix.shape[1], 1) >= 2.0**52
                i, j, score = candidates(matrix[own], needed[own], bucket, wide)
                i = own[i]
                good = (labels[i] == bucket.labels[j]) == same
                if same:  # not the anchor itself
                    own_id = np.flatnonzero(good & (ids[i] == bucket.ids[j]) & ~bucket.anon[j])
                    for at in own_id:
                        x, y = matrix[i[at]], bucket.matrix[j[at]]
                        n = max(len(x), len(y))
                        good[at] = not np.array_equal(np.pad(x, (0, n - len(x))), np.pad(y, (0, n - len(y))))
                i, j, score = i[good], j[good], score[good]
                for b in best:
                    b.add(i, score, bucket.anon[j], bucket.ids[j])
            for w, b in enumerate(best):
                a, score, anon, found = b.rows
                for column, values in zip(out, (ids[a], labels[a], keys[a], np.full(len(a), w), pa.array(found, mask=anon), score), strict=True):
                    column.append(pa.array(values))
        return pa.table([pa.chunked_array([x.cast(kind) for x in column], kind) for column, kind in zip(out, kinds, strict=True)], names=names)

    return run


def search(anchors: DataFrame, buckets: DataFrame, groups: int, runs: int, k: int, same: bool) -> DataFrame:
    """The ``k`` best rows of each anchor and window: ``vec_id, label, key, w, id, score, place``.

    Anchors in ``groups`` blocks meet buckets in ``runs`` shares: each task has some :data:`ROWS` anchors and :data:`RUN` buckets.
    What an anchor's tasks found is ranked again; a task hands on no more than ``k`` rows per anchor and window.
    """
    left = anchors.withColumn("g", F.expr(f"pmod(xxhash64(vec_id, key), {groups})")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    right = buckets.withColumn("p", F.expr(f"CAST(pmod(xxhash64(b), {runs}) AS INT)")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    found = left.groupBy("g", "p").cogroup(right.groupBy("g", "p")).applyInArrow(_search(k, same), FOUND)
    order = Window.partitionBy("vec_id", "label", "key", "w").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows ``vec_id, label, embedding`` where ``anchor`` holds.

    A component counts as ``floor(256 x)``; a score is the whole inner product (cut off at 64 bits). An anchor's positives are the
    ``positives`` best other rows of its label; each has the ``negatives`` best rows of other labels with ``low`` to ``high`` hundredths of
    its score. Higher scores come first, ties by smaller ``vec_id``.

    All rows are an index of length buckets (:data:`ROWS` rows of one label, or of neighbouring labels, by falling length) with a
    sorted list per coordinate. Blocks of anchors go through all buckets, first for positives, then for the negatives of all their
    windows at once; what an anchor needs rises as it finds better rows, and prunes by length and by coordinate ranges (:func:`candidates`).

    Rows with a NULL label or vector or a NULL or non-finite component take no part. A row with a NULL id is no anchor and comes last among ties.
    Rows that agree in id, label and vector are one; others with one id are rows of their own. Shorter vectors end in zeros.
    Other columns are ignored; an empty table or no anchor gives no row.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = pick(vectors, vec_id="bigint", label="bigint", embedding="array<double>").where("label IS NOT NULL AND embedding IS NOT NULL").where(fine)
    whole = lambda df: df.mapInArrow(_whole_numbers, ROW).withColumn("key", F.xxhash64("vector"))
    anchors = stored(whole(rows.where(anchor)).select("vec_id", "label", "key", "vector").dropDuplicates(["vec_id", "label", "key"]), "anchors")
    order = ["label", F.desc("length"), "vec_id", "key"]
    buckets = stored(whole(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "label", "length", "vector").mapInArrow(_buckets, BUCKET), "buckets")
    size = anchors.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("vector")), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-size.n // ROWS), -(-size.bytes // BYTES))
    runs = max(1, -(-buckets.count() // RUN))

    every = anchors.withColumn("low", F.array(F.lit(LEAST))).withColumn("high", F.array(F.lit(MOST)))
    found = stored(search(every, buckets, groups, runs, positives, True).drop("w"), "positives")
    score = F.col("score").cast("decimal(38,0)")
    band = found.where("score >= 0").select("vec_id", "label", "key", "place", F.struct(
        "place", F.ceil(score * low / 100).cast("bigint").alias("low"), F.floor(score * high / 100).cast("bigint").alias("high")).alias("band"))
    windows = band.groupBy("vec_id", "label", "key").agg(F.array_sort(F.collect_list("band")).alias("bands"))
    windows = windows.select("vec_id", "label", "key", F.col("bands.low").alias("low"), F.col("bands.high").alias("high"), F.col("bands.place").alias("places"))
    wanted = anchors.join(windows, ["vec_id", "label", "key"])
    out = search(wanted.drop("places"), buckets, groups, runs, negatives, False)
    out = out.join(windows.select("vec_id", "label", "key", "places"), ["vec_id", "label", "key"])
    out = out.select("vec_id", "label", "key", F.expr("places[w]").alias("which"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").alias("rank"))
    known = found.select("vec_id", "label", "key", F.col("place").alias("which"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return out.join(known, ["vec_id", "label", "key", "which"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_coordinate_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = pick(read(spark, sf_dir, "embeddings"), vec_id="bigint", label="bigint", embedding="array<double>")
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(rows.withColumn("label", label), F.expr("vec_id % 50 = 0"))


OP13_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({STEPS} * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
