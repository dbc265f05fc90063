"""Removal of repeated passages: every byte inside a 100-byte string that starts earlier too goes, the first copy stays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlytics.llm.common import line, pick, read, schema, stored
from plantlytics.llm.kernels import _CODES, _powers, blocks, byte_codes, mix, u64

#: Length of a repeated string, of the grams that anchor it, and how many grams such a string has.
LENGTH, GRAM = 100, 32
GRAMS = LENGTH - GRAM + 1
#: Contexts of one gram that a task compares at once; more frequent grams go the way of window rows.
HOT = 50_000
#: Stands for a NULL doc_id: such documents come last.
NO_ID = 2**63 - 1

_GRAM_CODES = byte_codes(23)
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``."""
    step = 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if step < width else h


def _gram_hash(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place (last axis); never 0."""
    h, step = _GRAM_CODES[raw], 1
    for m in _STEPS:
        h = h[..., :-step] * u64(m) + h[..., step:]
        h ^= h >> u64(29)
        step *= 2
    return h | u64(1)


def anchors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the texts in a buffer: gram hash, hash of the context, text, place in the text.

    An anchor is a gram with the least hash of some LENGTH-byte string of its text, so equal strings have
    equal anchors at equal places. Its context reaches as far as any such string that holds it.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none
    h = _gram_hash(raw)
    low = _least(h, GRAMS)
    stop = off[1:] - 1
    whole = np.zeros(len(low) + 1, np.int64)
    long = stop - off[:-1] >= LENGTH
    np.add.at(whole, off[:-1][long], 1)
    np.add.at(whole, stop[long] - LENGTH + 1, -1)
    low = np.where(np.cumsum(whole[:-1]) > 0, low, u64(0))
    edge = np.zeros(GRAMS - 1, np.uint64)
    at = np.flatnonzero(~_least(~np.concatenate((edge, low, edge)), GRAMS) == h)
    row = np.searchsorted(off, at, "right") - 1
    begin, end = np.maximum(at - (GRAMS - 1), off[row]), np.minimum(at + LENGTH, stop[row])
    power, inverse = _powers(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_CODES[raw] * power[: len(raw)], out=total[1:])
    context = mix(mix((total[end] - total[begin]) * inverse[begin]) + ((at - begin) * 1000 + (end - at)).astype(np.uint64))
    return h[at], context, row, at - off[row]


def _pairs(spans: np.ndarray) -> np.ndarray:
    """Union of half-open ranges (n, 2) as sorted disjoint ranges."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    far = np.maximum.accumulate(spans[:, 1])
    fresh = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > far[:-1])))
    return np.stack((spans[fresh, 0], far[np.append(fresh[1:] - 1, len(spans) - 1)]), 1)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, doc, ver, pos, packed): anchors, but of those with one context in a batch only the first; the others'
    contexts are repeats for certain and go along as packed ranges, a row per document."""
    for batch in batches:
        doc, ver = _ids(batch.column(0)), batch.column(1).to_numpy()
        parts, length = [], np.zeros(len(batch), np.int64)
        for a, b, raw, off in blocks(batch.column(2)):
            h, c, row, pos = anchors(raw, off)
            length[a:b] = np.diff(off) - 1
            parts.append((h, c, row + a, pos))
        if not parts:
            continue
        h, c, row, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        key = mix(h) ^ c
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(np.diff(key[order]) == 0)
        again = np.zeros(len(h), bool)
        if len(same):
            some = order[np.unique(np.concatenate((same, same + 1)))]
            some = some[np.lexsort((pos[some], ver[row[some]], doc[row[some]], key[some]))]
            fresh = np.concatenate(([True], key[some[1:]] != key[some[:-1]]))
            lead = some[fresh][np.cumsum(fresh) - 1]
            # A repeated row is the same document, not a repeat of itself.
            twin = (doc[row[lead]] == doc[row[some]]) & (ver[row[lead]] == ver[row[some]]) & (pos[lead] == pos[some])
            again[some[~twin]] = True
        left = np.flatnonzero(~again)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[left].view(np.int64)), pa.array(c[left].view(np.int64)), pa.array(doc[row[left]]), pa.array(ver[row[left]]),
             pa.array(pos[left]), pa.nulls(len(left), pa.binary())], ["h", "c", "doc", "ver", "pos", "packed"])
        gone = np.flatnonzero(again)
        if len(gone):
            gone = gone[np.argsort(row[gone], kind="stable")]
            cut = np.flatnonzero(np.diff(row[gone], prepend=-1))
            rows = row[gone[cut]]
            packed = []
            for r, x, y in zip(rows, cut, np.append(cut[1:], len(gone)), strict=True):
                p = pos[gone[x:y]]
                packed.append(_pairs(np.stack((np.maximum(p - GRAMS + 1, 0), np.minimum(p + LENGTH, length[r])), 1)).astype(np.int64).tobytes())
            spread = mix(doc[rows].astype(np.uint64) + u64(77)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread), pa.array(np.zeros(len(rows), np.int64)), pa.array(doc[rows]), pa.array(ver[rows]),
                 pa.array(np.full(len(rows), -1)), pa.array(packed, pa.binary())], ["h", "c", "doc", "ver", "pos", "packed"])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (h, c, doc, ver, pos) to marks (doc, ver, pos, h, packed).

    Later rows of one context repeat its first row, whole: marks without h. The first rows of the contexts of
    a gram that has several are compared later: marks with h. What lies at the edge of a batch may
    have neighbours unseen here and is compared later too, which does no harm.
    """
    last = None
    for batch in batches:
        if not len(batch):
            continue
        h, c, doc, ver, pos = (batch.column(i).to_numpy() for i in range(5))
        packed = batch.column(5)
        new_h = np.concatenate(([last is None or last[0] != h[0]], h[1:] != h[:-1]))
        new_c = new_h | np.concatenate(([last is None or last[1] != c[0]], c[1:] != c[:-1]))
        twin = ~new_c & np.concatenate((
            [last is not None and (doc[0], ver[0], pos[0]) == last[2:]],
            (doc[1:] == doc[:-1]) & (ver[1:] == ver[:-1]) & (pos[1:] == pos[:-1])))
        group = np.cumsum(new_h)
        anchor = pos >= 0
        classes = np.bincount(group, new_c)
        unsure = (classes[group] > 1) | (group == group[-1]) | (group == group[0])
        mark = np.where(new_c, anchor & unsure, ~twin) | ~anchor
        at = np.flatnonzero(mark)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[at]), pa.array(ver[at]), pa.array(pos[at]), pa.array(h[at], mask=~(new_c & anchor)[at]), packed.take(pa.array(at))],
            ["doc", "ver", "pos", "h", "packed"])
        last = h[-1], c[-1], doc[-1], ver[-1], pos[-1]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, ver, packed text, places) to a row per place: (h, doc, ver, pos, left, context)."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        doc, ver = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i in range(len(batch)):
            raw = np.frombuffer(unpack.decompress(batch.column(2)[i].as_py()), np.uint8)[:-1]
            pos = np.unique(np.array(batch.column(3)[i].as_py(), np.int64))
            h = _gram_hash(raw[pos[:, None] + np.arange(GRAM)])[:, 0]
            text = raw.tobytes()
            begin = np.maximum(pos - GRAMS + 1, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(np.full(len(pos), doc[i])), pa.array(np.full(len(pos), ver[i])), pa.array(pos), pa.array(pos - begin),
                 pa.array([text[a : p + LENGTH] for a, p in zip(begin.tolist(), pos.tolist(), strict=True)], pa.binary())],
                ["h", "doc", "ver", "pos", "left", "context"])


def _order(group: np.ndarray, part: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the rows of ``part`` within their groups, and each row's longest common prefix with the row before."""
    m, width = part.shape
    wide = np.zeros((m, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = part
    keys = wide.view(">u8")
    order = np.lexsort((*(keys[:, j] for j in range(keys.shape[1] - 1, -1, -1)), group))
    sorted_part = part[order]
    differ = sorted_part[1:] != sorted_part[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common = np.minimum(common, np.minimum(size[order[1:]], size[order[:-1]]))
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate(([-1], common))


def earlier_cover(group: np.ndarray, left: np.ndarray, context: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts given in order of position (within groups): least and greatest start before the anchor of the
    LENGTH-byte strings that an earlier context of the group has at the same place; -1 if none.

    The suffixes that start ``o`` bytes before the anchor agree in LENGTH bytes if the texts after it agree in
    LENGTH - o and those before it in o. Both suffix orders, with their common prefixes, cut the rows into classes for
    each ``o``. Within a class (a stretch of the suffix order whose longest previous factor, cut off at LENGTH, is
    LENGTH) rows stand by position: the previous smaller position is the row before, and the next smaller one lies
    outside of the class with a shorter match. So all but the first have an earlier match.
    """
    m = len(left)
    right = size - left
    low, high = np.full(m, -1), np.full(m, -1)
    after = np.zeros((m, LENGTH), np.uint8)
    before = np.zeros((m, GRAMS - 1), np.uint8)
    column = np.arange(context.shape[1])
    place = left[:, None] + np.arange(LENGTH)
    after[:] = np.where(np.arange(LENGTH) < right[:, None], context[np.arange(m)[:, None], np.minimum(place, column[-1])], 0)
    place = left[:, None] - 1 - np.arange(GRAMS - 1)
    before[:] = np.where(place >= 0, context[np.arange(m)[:, None], np.maximum(place, 0)], 0)
    order_r, lcp_r = _order(group, after, right)
    order_l, lcp_l = _order(group, before, left)
    near_r, near_l = np.zeros(m, np.int64), np.zeros(m, np.int64)
    near_r[order_r] = np.maximum(lcp_r, np.append(lcp_r[1:], -1))
    near_l[order_l] = np.maximum(lcp_l, np.append(lcp_l[1:], -1))
    class_r, class_l = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for o in range(GRAMS):
        some = np.flatnonzero((near_r >= LENGTH - o) & (near_l >= o) & (left >= o) & (right >= LENGTH - o))
        if len(some) < 2:
            continue
        class_r[order_r] = np.cumsum(lcp_r < LENGTH - o)
        class_l[order_l] = np.cumsum(lcp_l < o)
        code = class_r[some] * (m + 1) + class_l[some]
        _, first, member = np.unique(code, return_index=True, return_inverse=True)
        late = some[np.arange(len(some)) != first[member]]
        low[late] = np.where(low[late] < 0, o, low[late])
        high[late] = o
    return low, high


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in order of (h, doc, ver, pos) to ranges (doc, ver, start, stop) that repeat something earlier."""
    def cover(table: pa.Table) -> pa.RecordBatch:
        place = [table.column(i).to_numpy() for i in range(4)]
        # Repeated rows bring a context twice; it is one place all the same.
        table = table.filter(pa.array(np.logical_or.reduce([np.concatenate(([True], x[1:] != x[:-1])) for x in place])))
        h, doc, ver, pos, left = (table.column(i).to_numpy() for i in range(5))
        texts = table.column(5).to_pylist()
        size = np.array([len(t) for t in texts])
        width = int(size.max())
        context = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(-1, width)
        low, high = earlier_cover(np.cumsum(np.diff(h, prepend=h[0]) != 0), left, context, size)
        at = np.flatnonzero(low >= 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[at]), pa.array(ver[at]), pa.array(pos[at] - high[at]), pa.array(pos[at] - low[at] + LENGTH)],
            ["doc", "ver", "start", "stop"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) >= HOT:
            table = pa.Table.from_batches(held)
            h = table.column(0).to_numpy()
            whole = int(np.max(np.flatnonzero(h != h[-1]), initial=-1)) + 1
            if whole:
                yield cover(table.slice(0, whole))
                held = table.slice(whole).to_batches()
    if held:
        yield cover(pa.Table.from_batches(held))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts to one row per LENGTH-byte string in them: (h, o, w, doc, ver, pos)."""
    for batch in batches:
        h, doc, ver, pos, left = (batch.column(i).to_numpy() for i in range(5))
        rows, offs, sums = [], [], []
        for i, text in enumerate(batch.column(5).to_pylist()):
            for o in range(max(0, LENGTH - len(text) + int(left[i])), int(left[i]) + 1):
                a = int(left[i]) - o
                rows.append(i)
                offs.append(o)
                sums.append(hashlib.blake2b(text[a : a + LENGTH], digest_size=16).digest())
        at = np.array(rows, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[at]), pa.array(np.array(offs, np.int64)), pa.array(sums, pa.binary()), pa.array(doc[at]), pa.array(ver[at]), pa.array(pos[at])],
            ["h", "o", "w", "doc", "ver", "pos"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, packed text, places, packed ranges, starts, stops) to the result columns."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for i in range(len(batch)):
            text = unpack.decompress(batch.column(1)[i].as_py())[:-1]
            pos = np.array(batch.column(2)[i].as_py() or [], np.int64)
            parts = [np.stack((np.maximum(pos - GRAMS + 1, 0), np.minimum(pos + LENGTH, len(text))), 1)]
            parts += [np.frombuffer(x, np.int64).reshape(-1, 2) for x in batch.column(3)[i].as_py() or []]
            parts.append(np.array([batch.column(4)[i].as_py() or [], batch.column(5)[i].as_py() or []], np.int64).T)
            spans = _pairs(np.concatenate(parts))
            kept, at = hashlib.sha256(), 0
            for a, b in spans.tolist():
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            for column, value in zip(out, (len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), kept.hexdigest(), spans.tolist()), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = []
        for _, _, raw, off in blocks(batch.column(2)):
            packed += [press.compress(raw[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "ver", "packed"])


def repeated_passages(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the removed ``spans`` (byte ranges).

    Removed is each byte of a LENGTH-byte string that also starts earlier: in a smaller doc_id, or before in the same text.

    Sorting all suffixes of a corpus is out of reach, so suffixes are taken at anchors only: a string's 32-byte gram of least
    hash, found alike wherever the string occurs. A sort of the anchors by gram and context (range partitions, so no
    gram fills a task) tells the places whose whole context has an earlier copy. The different contexts of one
    gram are then put in suffix order, to either side of the anchor, and matched as in :func:`earlier_cover`. Grams
    with more than ``hot`` contexts are matched by one row per string and a grouped minimum instead. Texts move compressed.

    NULL and empty texts: no bytes, nothing removed. NULL ids come last. Rows with one id are told apart by their
    text, ordered by its hash; repeated rows are one document and all get its result. Other columns are ignored.
    """
    rows = pick(docs, doc_id="bigint", text="string").select("doc_id", F.hash(F.coalesce("text", F.lit(""))).alias("ver"), line(F.col("text")).alias("text"))
    found = rows.mapInArrow(_emit_anchors, schema(h="bigint", c="bigint", doc="bigint", ver="int", pos="bigint", packed="binary"))
    found = found.repartitionByRange("h", "c").sortWithinPartitions("h", "c", "doc", "ver", "pos")
    marks = stored(found.mapInArrow(_sweep, schema(doc="bigint", ver="int", pos="bigint", h="bigint", packed="binary")), "marks")
    packed = rows.mapInArrow(_pack, schema(doc_id="bigint", ver="int", packed="binary"))
    texts = packed.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "ver", F.col("packed").alias("text"))

    def contexts(of: DataFrame):
        places = of.groupBy("doc", "ver").agg(F.collect_set("pos").alias("places"))
        kinds = schema(h="bigint", doc="bigint", ver="int", pos="bigint", left="bigint", context="binary")
        one = texts.join(places, ["doc", "ver"]).select("doc", "ver", "text", "places")
        return one.mapInArrow(_contexts, kinds)

    open_marks = marks.where("h IS NOT NULL")
    crowded = stored(open_marks.groupBy("h").count().where(F.col("count") > hot).select("h"), "hot")
    cold = contexts(open_marks.join(crowded, "h", "left_anti"))
    cold = cold.repartition("h").sortWithinPartitions("h", "doc", "ver", "pos")
    ranges = cold.mapInArrow(_compare, schema(doc="bigint", ver="int", start="bigint", stop="bigint"))
    if crowded.limit(1).count():
        each = stored(contexts(open_marks.join(crowded, "h", "left_semi")).mapInArrow(
            _windows, schema(h="bigint", o="bigint", w="binary", doc="bigint", ver="int", pos="bigint")), "windows")
        firsts = each.groupBy("h", "o", "w").agg(F.min(F.struct("doc", "ver", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        late = each.join(firsts, ["h", "o", "w"]).where(F.struct("doc", "ver", "pos") != F.col("first"))
        ranges = ranges.union(late.groupBy("doc", "ver", "pos").agg(F.max("o").alias("hi"), F.min("o").alias("lo"))
                              .select("doc", "ver", F.expr("pos - hi").alias("start"), F.expr(f"pos - lo + {LENGTH}").alias("stop")))

    none = F.lit(None)
    sure = marks.where("h IS NULL").select("doc", "ver", F.when(F.col("pos") >= 0, F.col("pos")).alias("pos"), "packed",
                                           none.cast("bigint").alias("start"), none.cast("bigint").alias("stop"))
    more = ranges.select("doc", "ver", none.cast("bigint").alias("pos"), none.cast("binary").alias("packed"), "start", "stop")
    per_doc = sure.union(more).groupBy("doc", "ver").agg(*[F.collect_list(c).alias(c) for c in ("pos", "packed", "start", "stop")])
    whole = packed.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumnRenamed("packed", "text")
    whole = whole.join(per_doc, ["doc", "ver"], "left").select("doc_id", "text", "pos", "packed", "start", "stop")
    return whole.mapInArrow(_removed, schema(doc_id="bigint", n_bytes="bigint", n_removed="bigint", n_spans="bigint", kept_sha256="string",
                                             spans="array<array<bigint>>"))


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents")).drop("spans")
