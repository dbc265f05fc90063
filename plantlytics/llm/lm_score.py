"""Language-model scores by deleted interpolation of word n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlytics.llm.common import fold, line, pick, read, schema, stored
from plantlytics.llm.kernels import NOT_BLANK, blocks, mix, row_of, u64, words

#: Text of one group of documents, whose distinct n-grams are counted together before they travel.
GROUP_BYTES = 16 << 20
#: Documents with crc32(doc_id) mod FOLDS = HELD_OUT never train; of the others, fold DELETED gives the held-out counts of the mixture.
FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Buckets of context frequency (powers of two) and cells per probability in the held-out counts (12 a decade, 0 apart).
BUCKETS, CELLS, PER_DECADE = 32, 150, 12

_END, _START = u64(0x5851F42D4C957F2D), u64(0x14057B7EF767814F)


def _group(deleted: bool):
    """Number documents within groups of about GROUP_BYTES: (doc_id, fold, pid, sub, seq, packed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, sub, seq, size = TaskContext.get().partitionId() * 2 + deleted, 0, 0, 0
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            subs, seqs, packed = [], [], []
            for _, _, raw, off in blocks(batch.column(2)):
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    if size >= GROUP_BYTES:
                        sub, seq, size = sub + 1, 0, 0
                    subs.append(sub)
                    seqs.append(seq)
                    packed.append(press.compress(raw[a:b].tobytes()))
                    seq, size = seq + 1, size + b - a
            n = len(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.full(n, pid)), pa.array(subs, pa.int64()), pa.array(seqs, pa.int64()),
                 pa.array(packed, pa.binary())], ["doc_id", "fold", "pid", "sub", "seq", "packed"])

    return run


class Grams:
    """Tokens of some documents: keys of each token and of the pair it ends, and the key of the token before."""

    def __init__(self, packed: list[bytes]):
        unpack = zstandard.ZstdDecompressor()
        token, pair, ends, at = [], [], [0], 0
        while at < len(packed):  # about a megabyte at a time
            texts, size = [], 0
            while at < len(packed) and (not texts or size < 1 << 20):
                texts.append(unpack.decompress(packed[at]))
                size, at = size + len(texts[-1]), at + 1
            off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            h, _, _, ptr = words(np.frombuffer(b"".join(texts), np.uint8), off, NOT_BLANK)
            t = np.insert(h, ptr[1:], _END)
            stop = ptr[1:] + np.arange(1, len(ptr))
            before = np.concatenate((u64(0).reshape(1), t[:-1]))
            before[np.concatenate(([0], stop[:-1]))] = _START
            token.append(mix(t) | u64(1))
            pair.append(mix(mix(before * u64(0x9E3779B97F4A7C15) + t)) & ~u64(1))
            ends += (stop + ends[-1]).tolist()
        self.token = np.concatenate(token) if token else np.zeros(0, np.uint64)
        self.pair = np.concatenate(pair) if pair else np.zeros(0, np.uint64)
        self.ptr = np.array(ends)

    def keys(self) -> np.ndarray:
        return np.unique(np.concatenate((self.token, self.pair)))


def _bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys; buckets are even ranges of keys."""
    width = (1 << 64) // buckets + 1
    return np.searchsorted(keys, np.array([i * width for i in range(buckets)], np.uint64)).tolist() + [len(keys)]


def _press(a: np.ndarray) -> bytes:
    """Bytes of an integer array, equal places together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"")


def _unpress(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b) if b else b"", np.uint8)
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(wide, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def _emit(buckets: int):
    """Rows of documents to the distinct keys of each run of one group, cut by key range, with training counts."""
    def flush(pid: int, sub: int, part: int, folds: list[int], packed: list[bytes]) -> pa.RecordBatch:
        g = Grams(packed)
        keys = g.keys()
        trains = np.array(folds)[row_of(g.ptr)] != HELD_OUT
        own, n = np.unique(np.concatenate((g.token[trains], g.pair[trains])), return_counts=True)
        count = np.zeros(len(keys), np.uint32)
        count[np.searchsorted(keys, own)] = n
        edge = _bucket_edges(keys, buckets)
        # Sorted keys change little in their upper bytes: differences pack well.
        step = np.diff(keys, prepend=u64(0))
        rows = [(i, a, b) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
        packed_keys = []
        for _, a, b in rows:
            d = step[a:b].copy()
            d[0] = keys[a]
            packed_keys.append(_press(d))
        m = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _, _ in rows], pa.int64()), pa.array(np.full(m, pid)), pa.array(np.full(m, sub)), pa.array(np.full(m, part)),
             pa.array(packed_keys, pa.binary()), pa.array([_press(count[a:b]) for _, a, b in rows], pa.binary())],
            ["bucket", "pid", "sub", "part", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, folds, packed = None, [], []
        for batch in batches:
            pids, subs, seqs, fold_, texts = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4))
            for p, s, q, f, t in zip(pids, subs, seqs, fold_, texts, strict=True):
                if now is None or now[:2] != (p, s) or q != now[2] + len(packed):
                    if packed:
                        yield flush(*now, folds, packed)
                    now, folds, packed = (p, s, q), [], []
                folds.append(f)
                packed.append(t)
        if packed:
            yield flush(*now, folds, packed)

    return run


def _count(table: pa.Table) -> pa.Table:
    """All blocks of one key range to total counts in the order of each block's keys; a row with pid -1 has the range's
    distinct training tokens (part) and training tokens (sub)."""
    blocks_ = [np.cumsum(_unpress(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    own = [_unpress(x, np.uint32) for x in table.column("counts").to_pylist()]
    every = np.concatenate(blocks_)
    keys, place = np.unique(every, return_inverse=True)
    total = np.bincount(place, np.concatenate(own), len(keys)).astype(np.int64)
    token = (keys & u64(1)).astype(bool) & (total > 0)
    cut = np.concatenate(([0], np.cumsum([len(b) for b in blocks_])))
    packed = [_press(total[place[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    n = len(packed)
    extra = lambda name, x: pa.array(table.column(name).to_pylist() + [int(x)], pa.int64())
    return pa.table({"pid": extra("pid", -1), "sub": extra("sub", total[token].sum()), "part": extra("part", token.sum()),
                     "bucket": extra("bucket", n), "totals": pa.array([*packed, b""], pa.binary())})


def _with_totals(docs: pa.Table, totals: pa.Table):
    """Each run of documents of a group with the total counts of its tokens and pairs."""
    docs = docs.sort_by("seq")
    parts: dict[int, list[tuple[int, bytes]]] = {}
    for part, bucket, packed in zip(*(totals.column(c).to_pylist() for c in ("part", "bucket", "totals")), strict=True):
        parts.setdefault(part, []).append((bucket, packed))
    seq = docs.column("seq").to_numpy()
    starts = sorted(parts)
    ends = np.searchsorted(seq, [*starts[1:], 2**62]).tolist()
    for part, a, b in zip(starts, np.searchsorted(seq, starts).tolist(), ends, strict=True):
        some = docs.slice(a, b - a)
        g = Grams(some.column("packed").to_pylist())
        keys = g.keys()
        total = np.concatenate([_unpress(x, np.int64) for _, x in sorted(parts[part])])
        yield some, g, total[np.searchsorted(keys, g.token)], total[np.searchsorted(keys, g.pair)]


def _before(token: np.ndarray, ptr: np.ndarray, first: int) -> np.ndarray:
    """Count of the token before each token, ``first`` at the start of a text."""
    out = np.concatenate(([0], token[:-1]))
    out[ptr[:-1]] = first
    return out


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(context + 1)).astype(np.int64), BUCKETS - 1)


def _cell(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(CELLS - 1 + np.round(PER_DECADE * np.log10(np.maximum(p, 1e-300))), 1, CELLS - 1), 0).astype(np.int64)


def _held_out_counts(tokens: int, texts: int):
    """Cells (bucket, pair probability, token probability) of the tokens of the deleted fold, each document's own counts taken away."""
    def run(key: tuple, docs: pa.Table, totals: pa.Table) -> pa.Table:
        cells = np.zeros(BUCKETS * CELLS * CELLS, np.int64)
        for some, g, token, pair in _with_totals(docs, totals):
            row = row_of(g.ptr)
            context = _before(token, g.ptr, texts)

            def own(keys: np.ndarray, row: np.ndarray = row) -> np.ndarray:
                """How often the document itself has each key."""
                code = mix(keys) ^ mix(row.astype(np.uint64) + u64(1))
                _, place, n = np.unique(code, return_inverse=True, return_counts=True)
                return n[place]

            t, p = own(g.token), own(g.pair)
            left = context - _before(t, g.ptr, 1)
            two = np.where(left > 0, (pair - p) / np.maximum(left, 1), 0)
            one = (token - t) / max(tokens, 1)
            code = (_bucket(left) * CELLS + _cell(np.clip(two, 0, 1))) * CELLS + _cell(np.clip(one, 0, 1))
            cells += np.bincount(code, minlength=len(cells))
        at = np.flatnonzero(cells)
        return pa.table({"cell": pa.array(at), "n": pa.array(cells[at])})

    return run


def mixture(cells: list[tuple[int, int]], vocabulary: int, rounds: int = 60) -> np.ndarray:
    """Weights of pair, token and uniform probability per bucket, by expectation-maximisation on held-out counts."""
    weights = np.tile([0.0, 0.5, 0.5], (BUCKETS, 1))
    code = np.array([c for c, _ in cells], np.int64)
    n = np.array([c for _, c in cells], float)
    value = np.concatenate(([0.0], 10.0 ** ((np.arange(1, CELLS) - CELLS + 1) / PER_DECADE)))
    probs = np.stack((value[code // CELLS % CELLS], value[code % CELLS], np.full(len(code), 1 / (vocabulary + 1))), 1)
    bucket = code // CELLS**2
    for b in np.unique(bucket):
        own = bucket == b
        p, c, w = probs[own], n[own], np.full(3, 1 / 3)
        for _ in range(rounds):
            part = w * p
            part = part / part.sum(1, keepdims=True) * c[:, None]
            w = part.sum(0) / c.sum()
        weights[b] = w
    # A little mass stays on every part, so that no text is impossible; unseen contexts have no pairs.
    weights = 0.9999 * weights + 0.0001 * np.array([0.0, 0.5, 0.5])
    return weights / weights.sum(1, keepdims=True)


def _score(tokens: int, vocabulary: int, texts: int, weights: np.ndarray):
    def run(key: tuple, docs: pa.Table, totals: pa.Table) -> pa.Table:
        out = []
        for some, g, token, pair in _with_totals(docs, totals):
            context = _before(token, g.ptr, texts)
            w = weights[_bucket(context)]
            two = np.where(context > 0, pair / np.maximum(context, 1), 0)
            p = w[:, 0] * two + w[:, 1] * (token / max(tokens, 1)) + w[:, 2] / (vocabulary + 1)
            first = g.ptr[:-1]
            folds = some.column("fold").to_numpy()
            out.append(pa.table({
                "doc_id": some.column("doc_id"), "held_out": pa.array(folds == HELD_OUT),
                "n_tokens": pa.array(np.diff(g.ptr)), "n_known": pa.array(np.add.reduceat((token > 0).astype(np.int64), first)),
                "train_tokens": pa.array(np.full(len(folds), tokens)),
                "base_score": pa.array(np.add.reduceat(np.log10((token + 1) / (tokens + vocabulary + 1)), first)),
                "score": pa.array(np.add.reduceat(np.log10(p), first))}))
        return pa.concat_tables(out)

    return run


RESULT = schema(doc_id="bigint", held_out="boolean", n_tokens="bigint", n_known="bigint", train_tokens="bigint", base_score="double", score="double")


def interpolated_scores(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words between blanks, A-Z lower-cased, and one end per text. ``base_score`` is the sum of
    log10((c + 1) / (N + V + 1)); ``score`` sums log10 of w2 c(v w) / c(v) + w1 c(w) / N + w0 / (V + 1), the
    weights depending on the bucket of c(v) and learned by expectation-maximisation on a training fold, from whose
    counts each document's own are deleted.

    Documents are packed into groups of some 16 MB. A group's distinct tokens and pairs go, with their
    training counts, to the tasks that own their key ranges; total counts come back in the same order. So what is
    shuffled are distinct keys per group, a frequent word no more often than a rare one, and every n-gram is counted: nothing is
    pruned. The driver gets sums per key range and the held-out cells (at most 32 x 150 x 150 numbers).

    NULL and empty texts have the end token alone. NULL ids hash as an empty text. Repeated rows are documents
    of their own. An empty table, or one without training rows, gives an empty result or the uniform model.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id="bigint", text="string").select("doc_id", fold(F.col("doc_id"), FOLDS).cast("bigint").alias("fold"), line(F.col("text")).alias("text"))
    kinds = schema(doc_id="bigint", fold="bigint", pid="bigint", sub="bigint", seq="bigint", packed="binary")
    deleted = stored(rows.where(F.col("fold") == DELETED).mapInArrow(_group(True), kinds), "groups")
    table = deleted.union(stored(rows.where(F.col("fold") != DELETED).mapInArrow(_group(False), kinds), "groups"))
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = table.select("pid", "sub", "seq", "fold", "packed").mapInArrow(
        _emit(buckets), schema(bucket="bigint", pid="bigint", sub="bigint", part="bigint", keys="binary", counts="binary"))
    totals = stored(keys.groupBy("bucket").applyInArrow(
        lambda t: _count(t), schema(pid="bigint", sub="bigint", part="bigint", bucket="bigint", totals="binary")), "totals")
    sums = totals.where("pid = -1").agg(F.sum("sub"), F.sum("part")).first()
    tokens, vocabulary = int(sums[0] or 0), int(sums[1] or 0)
    texts = table.where(F.col("fold") != HELD_OUT).count()
    answers = totals.where("pid >= 0").groupBy("pid", "sub")

    asked = totals.where("pid >= 0 AND pid % 2 = 1").groupBy("pid", "sub")
    counted = deleted.groupBy("pid", "sub").cogroup(asked).applyInArrow(_held_out_counts(tokens, texts), schema(cell="bigint", n="bigint"))
    cells = [(r.cell, r.n) for r in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect()]
    weights = mixture(cells, vocabulary)
    return table.groupBy("pid", "sub").cogroup(answers).applyInArrow(_score(tokens, vocabulary, texts, weights), RESULT)


def op10_deleted_interpolation_lm(spark, sf_dir: str) -> DataFrame:
    return interpolated_scores(read(spark, sf_dir, "documents"))
