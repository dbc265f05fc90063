"""Source divergence: how far the terms of each source of a language stray from other sources and from the whole language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlytics.llm.common import pick, read, schema, stored

#: Documents of a language that a term must be in, parts in which shares are counted, and the ranks of terms that are reported.
LEAST_DOCS, PARTS, TOP = 3, 1_000_000_000, 200
#: Maximal runs of ASCII letters and non-ASCII characters, as bytes of lower-cased text, and what stands between them.
TERM, BETWEEN = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of a text, different terms, rows and pairs that a task takes at a time.
SLICE, HELD, ROWS, PAIRS = 1 << 22, 1 << 20, 1 << 19, 1 << 20
#: Partitions' skybands of one group are merged in so many tasks.
MERGERS = 8


def slices(text: bytes) -> Iterator[bytes]:
    """The text in parts that end between terms."""
    at = 0
    while at < len(text):
        cut = BETWEEN.search(text, at + SLICE)
        end = cut.end() if cut else len(text)
        yield text[at:end] if at or end < len(text) else text
        at = end


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, text`` to ``lang, source, term, n, docs``: occurrences and documents among the rows read so far."""
    found: dict[tuple[str, str], tuple[dict[bytes, int], dict[bytes, int]]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, more) in found.items():
            n_docs, n = np.fromiter(docs.values(), np.int64, len(docs)), np.fromiter(map(more.get, docs, repeat(0)), np.int64, len(docs))
            terms = pa.array([*docs], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(docs)), pa.repeat(source, len(docs)), terms, pa.array(n + n_docs), pa.array(n_docs)],
                ["lang", "source", "term", "n", "docs"])
        found.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            docs, more = found.setdefault((lang, source), (Counter(), {}))
            own: Counter = Counter()
            for part in slices(text.encode().translate(LOWER)):
                own.update(TERM.findall(part))
            docs.update(own.keys())
            if own.total() > len(own):
                for term, n in own.items():
                    if n > 1:
                        more[term] = more.get(term, 0) + n - 1
        if sum(len(docs) for docs, _ in found.values()) > HELD:
            yield from flush()
    yield from flush()


def _kept_terms(least_docs: int):
    """``lang, term, source, n, docs`` in order of language and term to ``lang, term, total, per`` (a list of source and n) of the terms in enough documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):  # the last term of a batch may go on in the next
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            if held is None or not held.num_rows:
                continue
            lang, term, source, n, docs = (held[i].combine_chunks() for i in range(5))
            new = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], new)))
            if batch is not None:
                held, done, first = held.slice(first[-1]), first[-1], first[:-1]
            else:
                done = held.num_rows
            if not done:
                continue
            good = np.add.reduceat(docs.to_numpy()[:done], first) >= least_docs
            size = np.diff(np.append(first, done))
            rows, lead = np.flatnonzero(np.repeat(good, size)), pa.array(first[good])
            per = pa.StructArray.from_arrays([source.take(pa.array(rows)), n.take(pa.array(rows))], ["source", "n"])
            off = pa.array(np.concatenate(([0], np.cumsum(size[good]))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [lang.take(lead), term.take(lead), pa.array(np.add.reduceat(n.to_numpy()[:done], first)[good]), pa.ListArray.from_arrays(off, per)],
                ["lang", "term", "total", "per"])

    return run


def skyband(count: np.ndarray, total: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the terms of one group that fewer than ``k`` others dominate: by a count as high, a total as low and an earlier name.

    In order of falling count, rising total and name, whatever dominates a term stands before it. A term with ``k`` dominators
    has ``k`` inside the skyband too, so blocks are compared with the skyband of what came before, and within themselves.
    """
    order = np.lexsort((rank, total, -count))
    if len(order) <= k:
        return order
    c, t = count[order], total[order]
    place = np.arange(len(order))
    new = np.concatenate(([True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])))
    order = order[place - np.maximum.accumulate(np.where(new, place, 0)) < k]  # of equal numbers the first k names
    t, r = np.unique(total[order], return_inverse=True)[1].astype(np.int32), np.argsort(np.argsort(rank[order])).astype(np.int32)
    count_true = lambda there: np.bitwise_count(np.packbits(there, axis=1)).sum(1, dtype=np.int64)
    kept, kept_t, kept_r = [], t[:0], r[:0]
    for a in range(0, len(order), 512):
        tt, rr = t[a : a + 512], r[a : a + 512]
        over = count_true((kept_t <= tt[:, None]) & (kept_r < rr[:, None]))
        over += count_true(np.tril((tt <= tt[:, None]) & (rr < rr[:, None]), -1))
        good = over < k
        kept.append(order[a : a + 512][good])
        kept_t, kept_r = np.concatenate((kept_t, tt[good])), np.concatenate((kept_r, rr[good]))
    return np.concatenate(kept)


def _reduced(table: pa.Table, k: int) -> pa.Table:
    """Skyband of each ``(lang, source)`` of a table ``lang, source, term, n, total``."""
    table = table.combine_chunks()
    lang, source = (table[c].chunk(0).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    n, total = table["n"].to_numpy(), table["total"].to_numpy()
    rank = pc.rank(table["term"].chunk(0), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    kept = [g[skyband(n[g], total[g], rank[g], k)] for g in np.split(order, cuts)]
    return table.take(pa.array(np.concatenate(kept)))


def _flat(batch: pa.RecordBatch) -> pa.Table:
    """``lang, term, total, per`` (a list of source and n) to one row per source."""
    at, per = pc.list_parent_indices(batch.column(3)), pc.list_flatten(batch.column(3))
    return pa.table({"lang": batch.column(0).take(at), "source": pc.struct_field(per, 0), "term": batch.column(1).take(at),
                     "n": pc.struct_field(per, 1), "total": batch.column(2).take(at)})


def _skybands(k: int, nested: bool):
    """What the rows of a partition leave of each group, its skyband, found anew as rows come in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, new, rows = None, [], 0
        for batch in batches:
            new.append(_flat(batch) if nested else pa.Table.from_batches([batch]))
            rows += new[-1].num_rows
            if rows >= max(ROWS, kept.num_rows if kept else 0):
                kept = _reduced(pa.concat_tables([*([kept] if kept else []), *new]), k)
                new, rows = [], 0
        if rows:
            kept = _reduced(pa.concat_tables([*([kept] if kept else []), *new]), k)
        if kept is not None:
            yield from kept.to_batches(max_chunksize=1 << 16)

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, term, total, per`` to ``lang, s, cs, t, ct, k``: ``k`` terms have the counts ``cs`` in source s and ``ct`` in the later t.

    Pairs of sources are counted in blocks, and a task hands on one row per combination, not per term.
    """
    names: dict[str, int] = {}
    by = ["lang", "s", "cs", "t", "ct"]

    def coded(column: pa.Array) -> np.ndarray:
        column = column.dictionary_encode()
        return np.array([names.setdefault(x, len(names)) for x in column.dictionary.to_pylist()], np.int64)[column.indices.to_numpy()]

    def total(frames: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(frames).groupby(by, sort=False, as_index=False)["k"].sum()

    def named(frame: pd.DataFrame) -> pa.RecordBatch:
        text = np.array([*names], object)
        late = text[frame["s"]] > text[frame["t"]]  # by code point, as UTF-8 sorts
        s, t = np.where(late, frame["t"], frame["s"]), np.where(late, frame["s"], frame["t"])
        cs, ct = np.where(late, frame["ct"], frame["cs"]), np.where(late, frame["cs"], frame["ct"])
        column = lambda x: pa.DictionaryArray.from_arrays(pa.array(x), pa.array([*names], pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [column(frame["lang"].to_numpy()), column(s), pa.array(cs), column(t), pa.array(ct), pa.array(frame["k"].to_numpy())], [*by, "k"])

    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        at, per = pc.list_parent_indices(batch.column(3)).to_numpy(), pc.list_flatten(batch.column(3))
        if not len(at):
            continue
        code, lang = coded(pc.struct_field(per, 0)), coded(batch.column(0))
        count = pc.struct_field(per, 1).to_numpy(zero_copy_only=False)
        order = np.lexsort((code, at))
        at, code, count = at[order], code[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        m = np.diff(np.append(first, len(at)))
        for width in np.unique(m[m > 1]):
            begin = first[m == width]
            lines = max(1, PAIRS // (width * (width - 1) // 2))
            across = max(1, PAIRS // width)
            for a in range(0, len(begin), lines):
                own = begin[a : a + lines]
                for i in range(0, width - 1, across):
                    x, y = np.nonzero(np.triu(np.ones((min(across, width - 1 - i), width), bool), i + 1))
                    one, two = (own[:, None] + x + i).ravel(), (own[:, None] + y).ravel()
                    held.append(pd.DataFrame({"lang": lang[at[one]], "s": code[one], "cs": count[one], "t": code[two], "ct": count[two], "k": 1}))
                    size += len(one)
                    if size > 2 * PAIRS:
                        held = [total(held)]
                        size = len(held[0])
                        if size > PAIRS:
                            yield named(held[0])
                            held, size = [], 0
    if held:
        yield named(total(held))


def share(count: str, whole: str) -> Column:
    """Parts of a count, with one added to each term's; exact beyond 64 bits."""
    return F.expr(f"1 + (CAST({count} + 1 AS DECIMAL(20, 0)) * {PARTS}BD) div CAST({whole} AS DECIMAL(20, 0))")


def stray(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Per group of language and source the divergence from every other source of the language (``part`` pair) and the ``top`` terms
    that are more frequent than in the language (``part`` term): ``lang, source, part, item, value, rank``.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a language keeps those in ``least_docs`` of its documents.
    With ``count`` in a group or language and ``N`` their sum over its ``V`` kept terms, ``p = 1 + floor(10^9 (count + 1) / (N + V))``.
    A value is ``floor((p - q)^2 / q)``: for pairs summed over all kept terms with the other source's ``q``, for terms with the
    language's, where the group has the term and ``p > q``. Ranks fall with the value, ties rise with the item's UTF-8 bytes.

    Pairs: only terms that two sources share need both counts; these meetings are counted per pair of counts where the terms lie, and
    counts of one source alone per count. A sum over all terms follows from both. Terms: a value rises with the group's count and falls
    with the language's, so each partition keeps, per group, terms dominated by fewer than ``top`` others; merged skybands are ranked exactly.

    NULL texts, languages and sources are empty; a group without terms has counts of 0; a language without kept terms has
    pairs of value 0. Repeated rows are documents of their own; other columns are ignored; an empty table gives no row.
    """
    rows = pick(docs, lang="string", source="string", text="string").fillna("")
    counts = rows.mapInArrow(_counts, schema(lang="string", source="string", term="string", n="bigint", docs="bigint"))
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kinds = schema(lang="string", term="string", total="bigint", per="array<struct<source: string, n: bigint>>")
    terms = counts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_kept_terms(least_docs), kinds)
    terms = stored(terms, "terms")

    # How many kept terms have a count in a group; all sizes follow from it.
    alone = stored(terms.select("lang", F.inline("per")).groupBy("lang", "source", "n").agg(F.count("*").alias("k")), "counts")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    sizes = alone.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("k")).alias("n"))
    groups = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
    groups = stored(groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.expr("coalesce(n, 0) + v").alias("whole"),
                                  F.expr("n_lang + v").alias("whole_lang")), "groups")

    ranked = [*_pair_part(terms, alone, groups), *_term_part(terms, groups, top)]
    return ranked[0].union(ranked[1])


def _rank(df: DataFrame) -> DataFrame:
    within = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.withColumn("rank", F.row_number().over(within))


def _pair_part(terms: DataFrame, alone: DataFrame, groups: DataFrame) -> list[DataFrame]:
    """Sum over all terms = V terms with no count in either, corrected for counts in one, and again for counts in both."""
    one = groups.select("lang", F.col("source").alias("s"), "v", F.col("whole").alias("ws"), share("0", "whole").alias("s0"))
    two = groups.select("lang", F.col("source").alias("t"), F.col("whole").alias("wt"), share("0", "whole").alias("t0"))
    both_ways = lambda there, back: F.inline(F.array(
        F.struct(F.col("s").alias("source"), F.col("t").alias("item"), F.expr(there).alias("x")),
        F.struct(F.col("t").alias("source"), F.col("s").alias("item"), F.expr(back).alias("x"))))
    k = "CAST(k AS DECIMAL(20, 0))"

    base = one.join(two, "lang").where("s <> t").select(
        "lang", F.col("s").alias("source"), F.col("t").alias("item"), F.expr(f"CAST(v AS DECIMAL(20, 0)) * coalesce({stray('s0', 't0')}, 0)").alias("x"))
    single = alone.join(one.withColumnRenamed("s", "source"), ["lang", "source"]).withColumn("p", share("n", "ws"))
    single = single.withColumnRenamed("source", "s").join(two, "lang").where("s <> t").select("lang", both_ways(
        f"{k} * ({stray('p', 't0')} - {stray('s0', 't0')})", f"{k} * ({stray('t0', 'p')} - {stray('t0', 's0')})"))
    met = terms.mapInArrow(_meetings, schema(lang="string", s="string", cs="bigint", t="string", ct="bigint", k="bigint"))
    met = met.groupBy("lang", "s", "cs", "t", "ct").agg(F.sum("k").alias("k"))
    met = met.join(one, ["lang", "s"]).join(two, ["lang", "t"]).withColumn("p", share("cs", "ws")).withColumn("q", share("ct", "wt"))
    met = met.select("lang", both_ways(
        f"{k} * ({stray('p', 'q')} - {stray('p', 't0')} - {stray('s0', 'q')} + {stray('s0', 't0')})",
        f"{k} * ({stray('q', 'p')} - {stray('q', 's0')} - {stray('t0', 'p')} + {stray('t0', 's0')})"))
    wide = [df.select("lang", "source", "item", F.col("x").cast("decimal(38,0)").alias("x")) for df in (base, single, met)]
    value = wide[0].union(wide[1]).union(wide[2]).groupBy("lang", "source", "item").agg(F.sum("x").cast("bigint").alias("value"))
    return [_rank(value).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")]


def _term_part(terms: DataFrame, groups: DataFrame, top: int) -> list[DataFrame]:
    kinds = schema(lang="string", source="string", term="string", n="bigint", total="bigint")
    local = terms.mapInArrow(_skybands(top, nested=True), kinds)
    merged = local.repartition("lang", "source", F.expr(f"pmod(xxhash64(term), {MERGERS})")).mapInArrow(_skybands(top, nested=False), kinds)
    value = merged.join(groups, ["lang", "source"]).withColumn("p", share("n", "whole")).withColumn("q", share("total", "whole_lang"))
    value = value.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(stray("p", "q")).alias("value"))
    return [_rank(value).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")]


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT lang, source, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, l.v, coalesce(x.n, 0) AS n, l.n AS n_lang FROM g JOIN l USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) x USING (lang, source)),
p AS (SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n, 1 + ({PARTS}::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + s.v) AS p,
  1 + ({PARTS}::HUGEINT * (kept.n + 1)) // (s.n_lang + s.v) AS q
  FROM s JOIN kept USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= {TOP}
"""
