"""Benchmark passages in training text: an FM-index per shard, searched backwards for all test phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlytics.llm.common import pick, read
from plantlytics.llm.kernels import ALNUM, blocks, gather, row_of, words
from plantlytics.llm.textmap import map_text

#: Benchmark text carried to the tasks at once; a larger benchmark is searched in blocks of this size.
BLOCK_BYTES = 8 << 20
#: Text of one shard, and every how many places its suffix array is kept.
SHARD_BYTES, SAMPLE = 4 << 20, 8


class FMIndex:
    """Index of a sequence of symbols 1.. in runs, each ended by a 0: wavelet-matrix ranks over its BWT."""

    def __init__(self, s: np.ndarray, sigma: int):
        n = len(s)
        stop = s == 0
        ends = int(stop.sum())
        rank = np.where(stop, np.cumsum(stop) - 1, s + ends)  # every end differs, so no comparison passes one
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1
            code = rank * (n + sigma + 2) + after
            order = np.argsort(code, kind="stable")
            fresh = np.empty(n, np.int64)
            fresh[order] = np.concatenate(([0], np.cumsum(np.diff(code[order]) != 0)))
            rank = fresh
            if rank[order[-1]] == n - 1 or step >= n:
                break
            step *= 2
        bwt = s[order - 1]
        count = np.bincount(s, minlength=sigma + 1)
        self.first = np.concatenate(([0], np.cumsum(count)))
        self.bits = max(1, int(sigma).bit_length())
        self.zeros, self.bwt = [], bwt
        v = bwt
        for b in range(self.bits - 1, -1, -1):
            one = (v >> b) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - one))))
            v = np.concatenate((v[one == 0], v[one == 1]))
        marked = (order % SAMPLE == 0) | (bwt == 0)
        self.marks, self.kept = marked, np.where(marked, order, -1)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol ``c`` occurs in the first ``i`` places of the BWT."""
        low = np.zeros_like(i)
        for level, z in enumerate(self.zeros):
            one = (c >> (self.bits - 1 - level)) & 1 == 1
            zi, zl = z[i], z[low]
            i = np.where(one, z[-1] + i - zi, zi)
            low = np.where(one, z[-1] + low - zl, zl)
        return i - low

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval of each row of ``phrases`` (equal lengths), by backward search."""
        n = len(phrases)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.bwt))
        alive = np.arange(n)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            lo[alive] = self.first[c] + self.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text places of suffixes: step back until a sampled one."""
        at, out, steps = at.copy(), np.full(len(at), -1), np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        while len(open_):
            done = self.marks[at[open_]]
            out[open_[done]] = self.kept[at[open_[done]]] + steps[open_[done]]
            open_ = open_[~done]
            c = self.bwt[at[open_]]
            at[open_] = self.first[c] + self.rank(c, at[open_])
            steps[open_] += 1
        return out


class Phrases:
    """Windows of benchmark items as rows of word numbers, one table per length, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        texts = [(t or "").encode() + b"\n" for _, t in items]
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        h, _, _, ptr = words(np.frombuffer(b"".join(texts), np.uint8), off, ALNUM)
        self.vocabulary = np.unique(h)
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        number = np.searchsorted(self.vocabulary, h) + 1
        found: dict[tuple[int, ...], set[int]] = {}
        for i, (a, b) in enumerate(zip(ptr[:-1], ptr[1:], strict=True)):
            m = min(size, b - a)
            for j in range(a, b - m + 1) if m else ():
                found.setdefault(tuple(number[j : j + m].tolist()), set()).add(i)
        self.names = [i for i, _ in items]
        self.tables = []
        for m in sorted({len(p) for p in found}):
            rows = [p for p in found if len(p) == m]
            self.tables.append((np.array(rows), [sorted(found[p]) for p in rows]))
        self.least = min((t.shape[1] for t, _ in self.tables), default=0)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Word numbers from 1, 0 for words of no item."""
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.quick[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == h[maybe]
        out[maybe[known]] = at[known] + 1
        return out


def _search(p: Phrases, number: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, list[set]]:
    """Hit flag of each word of a shard, and the items found in each of its texts."""
    hit, items = np.zeros(len(number), bool), [set() for _ in range(rows)]
    # Runs of benchmark words within a text, long enough for a window; all else can hold none.
    known = number > 0
    edge = np.flatnonzero(np.concatenate(([True], (known[1:] != known[:-1]) | (row[1:] != row[:-1])))) if len(number) else np.zeros(0, int)
    length = np.diff(np.append(edge, len(number)))
    good = known[edge] & (length >= p.least)
    first, length = edge[good], length[good]
    if not len(first):
        return hit, items
    place = gather(first, length + 1)
    last = np.cumsum(length + 1) - 1
    s = number[np.minimum(place, len(number) - 1)]
    s[last] = 0
    index = FMIndex(s, len(p.vocabulary))
    cover = np.zeros(len(s) + 1, np.int64)
    for table, owners in p.tables:
        lo, hi = index.find(table)
        some = np.flatnonzero(lo < hi)
        if not len(some):
            continue
        which = np.repeat(some, (hi - lo)[some])
        at = index.locate(gather(lo[some], (hi - lo)[some]))
        np.add.at(cover, at, 1)
        np.add.at(cover, at + table.shape[1], -1)
        for r, q in np.unique(np.stack((row[place[at]], which), 1), axis=0).tolist():
            items[r].update(owners[q])
    inside = np.cumsum(cover[:-1]) > 0
    inside[last] = False
    hit[place[inside]] = True
    return hit, items


def _worker(blocks_of_items: list, size: int):
    def make():
        phrases = [Phrases(items.value, size) for items in blocks_of_items]

        def work(text: pa.Array) -> list[pa.Array]:
            n_words, n_hit, found, spans, cut = [], [], [], [], []
            for a, b, raw, off in blocks(text, SHARD_BYTES):
                h, begin, end, ptr = words(raw, off, ALNUM)
                row = row_of(ptr)
                hit, items = np.zeros(len(h), bool), [set() for _ in range(b - a)]
                for p in phrases:
                    if p.least:
                        more, names = _search(p, p.numbers(h), row, b - a)
                        hit |= more
                        for r, s in enumerate(names):
                            items[r].update(p.names[i] for i in s if p.names[i] is not None)
                for r in range(b - a):
                    mine = hit[ptr[r] : ptr[r + 1]]
                    n_words.append(len(mine))
                    n_hit.append(int(mine.sum()))
                    found.append(sorted(items[r]))
                    pieces, runs, at = [], [], off[r]
                    if n_hit[-1]:
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.astype(np.int8), [0]))))
                        for x, y in zip(edge[0::2] + ptr[r], edge[1::2] + ptr[r] - 1, strict=True):
                            runs.append([int(begin[x] - off[r]), int(end[y] - off[r])])
                            pieces.append(raw[at : begin[x]].tobytes())
                            at = end[y]
                        pieces.append(raw[at : off[r + 1] - 1].tobytes())
                        cut.append(b"".join(pieces).decode())
                    else:
                        cut.append(None)
                    spans.append(runs)
            return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(cut, pa.string())]

        return work

    return make


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, str]]]:
    part, size = [], 0
    for r in pick(benchmark, item_id="string", text="string").toLocalIterator():
        part.append((r.item_id, r.text or ""))
        size += 4 * len(part[-1][1])
        if size >= BLOCK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, keep: list[str] | None = None,
                   plain_names: bool = False) -> DataFrame:
    """``docs`` with what it shares with the benchmark: ``n_words, n_hit, items, spans, cut``.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. A window is
    ``size`` consecutive words of an item, or all words of a shorter one; a document word inside an
    occurrence of any window is hit. ``items`` are the ids with occurring windows, sorted as strings;
    ``spans`` the maximal runs of hit words as byte ranges; ``cut`` the text without them (NULL without hits).

    Each task cuts its documents into shards of some 4 MB and builds an FM-index over those runs of benchmark
    words that are long enough to hold a window (nothing else can match). All windows are searched
    backwards at once through wavelet ranks and located by sampled suffix places. No row is
    shuffled. The benchmark goes to the tasks as broadcast blocks of at most about 8 MB each, searched one after the other.

    NULL and empty texts have no words. Items without words are never found; items with a NULL id
    hit but are not listed; repeated items and documents are each judged alone. An empty benchmark hits nothing.
    """
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(part) for part in _item_blocks(benchmark)]
    return map_text(docs, _worker(shared, size), keep=keep, plain_names=plain_names, n_words="bigint", n_hit="bigint", items="array<string>",
                    spans="array<array<bigint>>", cut="string")


def op3_fm_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    found = benchmark_hits(docs, read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item, least(10, len(w)) AS m, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM bw),
lengths AS (SELECT DISTINCT m FROM windows),
dw AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m),
hits AS (SELECT doc_id, item, dw.m AS m, i FROM dw JOIN windows ON windows.m = dw.m AND windows.win = array_to_string(w[i:i + dw.m - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(found.items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def cut_benchmark_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: benchmark passages are cut out of the texts; a text left without words goes.

    ``n_chars`` follows a changed text. Rows that share or lack an id are cut each by itself, repeated rows alike; NULL and empty texts stay as
    they are. Other columns, and further ones of the same names, come back as they were; an empty table gives an empty result.
    """
    names = docs.columns
    found = benchmark_hits(docs, read(spark, sf_dir, "benchmark"), plain_names=True).where("n_hit = 0 OR n_hit < n_words")
    changed = {"text": F.col("cut"), "n_chars": F.length("cut")}
    return found.select([
        (F.when(F.col("n_hit") > 0, changed[n]).otherwise(F.col(f"c{i}")) if n in changed and names.index(n) == i
         else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])
