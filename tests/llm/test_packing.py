"""Packing: token round trips, exact sequences, and the assignment against a plain search over all sequences."""

import random
import zlib

import numpy as np
import pytest
from corpus_data import SF, prose
from tokenizers import Tokenizer

from plantlytics.llm import packing
from plantlytics.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_file())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_parts_give_the_tokens_of_the_whole_text(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 40)
    monkeypatch.setattr(packing, "KNOWN", 50)
    encode, r = packing.tokens_of.__wrapped__(packing.tokenizer_file()), random.Random(1)
    signs = [" ", "  ", "a", "bc", "'s", "'", "é", "\n", "\t", "\r", "<|endoftext|>", "1", "23", ".", "!!", "日本", " ", "　", "don't",
             "‍", "😀", "\x00", "\x0b", "\x85", ", ", "-", "I'll", "\U00010400", "\x1c", "\xa0", "Ġ", "\ufeff", " the", " of,", "Ç", "×", "ñ"]
    for n in range(6000):
        text = "".join(r.choice(signs[n % 9 :]) for _ in range(r.randrange(60)))
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def plain_pack(lengths, capacity, width):
    """The same rule, looking at every sequence for every piece."""
    room = packing.capacities(sum(lengths), capacity)
    cost, fill, out, full, todo = [0] * len(room), [0] * len(room), [], 0, []

    def put(d, start, n, s):
        out.append((d, start, n, s, fill[s]))
        fill[s], room[s], cost[s] = fill[s] + n, room[s] - n, cost[s] + 6 * width * n + n * n

    for d, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            put(d, start, capacity, full)
            full += 1
        if n % capacity:
            todo.append((n % capacity, d, n - n % capacity))
    while todo:
        n, d, start = todo.pop(max(range(len(todo)), key=lambda i: (todo[i][0], -i)))
        fits = [s for s in range(full, len(room)) if room[s] >= n]
        if fits:
            put(d, start, n, min(fits, key=lambda s: (cost[s], -room[s], s)))
        else:
            s = min(range(full, len(room)), key=lambda s: (-room[s], cost[s], s))
            part = room[s]
            put(d, start, part, s)
            todo.append((n - part, d, start + part))
    return out, cost


@pytest.mark.parametrize("seed", range(40))
def test_assignment_is_the_plain_rule(seed):
    r = random.Random(seed)
    capacity = r.choice([8, 12, 64])
    lengths = [r.choice([1, 2, 3, r.randrange(1, capacity), r.randrange(1, 4 * capacity)]) for _ in range(r.randrange(60))]
    if seed % 4 == 0:
        lengths = [capacity * 2 // 3] * len(lengths)
    assert packing.pack(lengths, capacity, 3) == plain_pack(lengths, capacity, 3)


def test_costs_are_even():
    r = random.Random(3)
    pieces, cost = packing.pack([r.randrange(1, 900) for _ in range(3000)])
    assert max(cost[:-10]) < 1.1 * min(cost[:-10])
    assert len(pieces) <= 3000 + len(cost)


def check(rows, texts, tokenizer, capacity):
    """``texts``: of each document its id and text; the pieces must give back every id once, in sequences without padding."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_cost))
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
        assert {c for _, _, c in parts} == {sum(packing.attention_cost(n, packing.WIDTH) for _, n, _ in parts)}
    documents = {}
    for r in rows:
        documents.setdefault(r.doc_id, []).append(r)
    assert documents.keys() == texts.keys()
    for key, text in texts.items():
        ids, at = ids_of(tokenizer, text), 0
        for r in sorted(documents[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_query_gives_back_every_token(spark, tokenizer):
    rows = QUERIES["op11_cost_balanced_packing"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(rows, texts, tokenizer, 1024)


def test_small_groups_and_odd_texts(spark, tokenizer, table):
    from pyspark.sql import functions as F

    texts = {i: prose(i, 1 + i * 7) for i in range(60)} | {100: None, 101: "", 102: " \n", 103: "a" * 3000, 104: prose(9, 4000), 105: "é日本 <|endoftext|> x"}
    out = packing.pack_documents(table(list(texts.items())), packing.tokenizer_file(), capacity=64, group=500)
    check(out.withColumn("ids_crc32", F.crc32("ids")).collect(), texts, tokenizer, 64)


def test_odd_rows(spark, odd, tokenizer):
    rows = packing.pack_documents(odd, packing.tokenizer_file()).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(tokenizer, r.text)) for r in odd.collect())
    assert sum(r.start == 0 for r in rows) == odd.count()
    assert packing.pack_documents(odd.limit(0), packing.tokenizer_file()).count() == 0
