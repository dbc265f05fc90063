"""Source divergence against plain integers over every term and every pair of sources."""

import collections
import random
import re

import numpy as np
import pytest
from corpus_data import lower

from plantlytics.llm import divergence

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def plain(rows, least=3, top=200):
    """``rows``: (lang, source, text)."""
    found, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for lang, source, text in rows:
        lang, source, words = lang or "", source or "", re.findall(TERM, lower(text or ""))
        groups.add((lang, source))
        found[lang, source].update(words)
        docs[lang].update(set(words))
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in docs.items()}

    def shares(count, terms):
        whole = sum(count[t] for t in terms) + len(terms)
        return {t: 1 + 10**9 * (count[t] + 1) // whole for t in terms}

    out = set()
    for lang in {g[0] for g in groups}:
        terms, sources = kept[lang], [s for g, s in groups if g == lang]
        p = {s: shares(found[lang, s], terms) for s in sources}
        q = shares(sum((found[lang, s] for s in sources), collections.Counter()), terms)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in terms), o) for o in sources if o != s]
            best = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in terms if found[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", best, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def texts(seed, n, words):
    r = random.Random(seed)
    vocabulary = [f"{''.join(r.choice('abcdeéß日') for _ in range(r.randrange(1, 5)))}" for _ in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    rows = []
    for _ in range(n):
        lang, source = r.choice(["en", "en", "de", None]), r.choice(["a", "a", "a", "b", "c", "é", None])
        rows.append((lang, source, r.choice([" ", "1", ", "]).join(r.choices(vocabulary, weights, k=r.randrange(40))).title()))
    return [*rows, (None, None, None), ("fr", "x", "Une fois"), ("fr", "y", ""), ("it", None, None)] + [("de", "rep", "gleich gleich wort")] * 5


def collected(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed,words,top", [(1, 30, 200), (2, 400, 200), (3, 400, 5), (4, 60, 1)])
def test_against_plain_integers(spark, monkeypatch, seed, words, top):
    for name, value in (("SLICE", 20), ("HELD", 50), ("ROWS", 40), ("PAIRS", 3)):
        monkeypatch.setattr(divergence, name, value)
    rows = texts(seed, 150, words)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    out = divergence.divergence(docs, top=top)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = out.collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == plain(rows, top=top)


def test_whole_blocks(spark):
    rows = texts(7, 400, 2000)
    assert collected(divergence.divergence(spark.createDataFrame(rows, "lang string, source string, text string"))) == plain(rows)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_skyband_is_that_of_every_pair(k):
    r = np.random.default_rng(k)
    n, total, rank = r.integers(1, 9, 1500), r.integers(1, 30, 1500), r.permutation(1500)
    over = (n >= n[:, None]) & (total <= total[:, None]) & (rank < rank[:, None])
    assert sorted(divergence.skyband(n, total, rank, k)) == sorted(np.flatnonzero(over.sum(1) < k))


def test_odd_and_empty(odd):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert collected(divergence.divergence(odd)) == plain(rows)
    assert divergence.divergence(odd.limit(0)).count() == 0


def test_shares_beyond_64_bits(spark):
    got = spark.range(1).selectExpr("12345678901234 AS n", "98765432109876543 AS whole").select(divergence.share("n", "whole").alias("p")).first().p
    assert got == 1 + 10**9 * 12345678901235 // 98765432109876543


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_terms_that_go_on_in_the_next_batch(size):
    import pyarrow as pa

    r = random.Random(size)
    rows = sorted((r.choice(["de", "en"]), r.choice("abcdeé"), f"s{i}", r.randrange(1, 5), 1) for i in range(60))
    table = pa.table(dict(zip(["lang", "term", "source", "n", "docs"], map(list, zip(*rows)))))
    out = divergence._kept_terms(4)(iter([b for b in table.to_batches(max_chunksize=size)]))
    got = {(x["lang"], x["term"]): (x["total"], sorted((p["source"], p["n"]) for p in x["per"])) for b in out for x in b.to_pylist()}
    want = collections.defaultdict(list)
    for lang, term, source, n, _ in rows:
        want[lang, term].append((source, n))
    assert got == {k: (sum(n for _, n in v), sorted(v)) for k, v in want.items() if len(v) >= 4}
