"""Token sequences of fixed capacity packed so that their attention costs are even and nothing is padded."""

from __future__ import annotations

import functools
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlytics.llm.common import pick, read, schema

#: Production parameters: tokens of a sequence, the token that ends a document, and the model width that weighs the two costs.
CAPACITY, END, WIDTH = 1024, 0, 1024
#: Tokens that are packed together, in one task: some two thousand sequences.
GROUP = 1 << 21
#: Whatever else the text holds, a token ends between a visible character of these and a blank or line feed (white space is only at a
#: token's beginning), between a letter and one of these signs, and between a lone line feed and a letter.
BETWEEN_WORDS = re.compile(r"(?<=[!-~À-ÖØ-öø-ÿ])(?=[ \n])|(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[,.;:!?])|(?<=[!-~]\n)(?=[A-Za-z])")
#: A blank behind something that may count as white space; before every other blank a token ends.
DOUBTFUL = re.compile("[\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u206f\u3000\ufeff] ")
#: These parts are one word to the tokenizer, so its model is asked without cutting them up once more.
ONE_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
#: Characters of a text that are cut into words at a time, and words and parts whose tokens a worker keeps.
SLICE, KNOWN = 1 << 20, 1 << 20


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the blank and Latin letters: visible bytes as they are, the others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    names = {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in (32, *range(0xC0, 0x100))}


class Parts(dict):
    """Tokens of parts of texts, as little-endian unsigned 32-bit numbers; a part that is not yet known is tokenized."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model, self.letters = tokenizer.encode, tokenizer.model.tokenize, byte_letters()

    def tokens(self, part: str) -> bytes:
        if ONE_WORD.match(part):
            written = part.replace(" ", self.letters[32]) if part.isascii() else part.translate(self.letters)
            return array("I", [t.id for t in self.model(written)]).tobytes()
        return array("I", self.encode(part, add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= KNOWN:
            self.clear()
        found = self[part] = self.tokens(part)
        return found


class Words(dict):
    """Tokens of a blank and what stands behind it up to the next."""

    def __init__(self, parts: Parts):
        self.parts, self.whole = parts.__getitem__, parts.tokens

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN:
            self.clear()
        text = " " + word
        found = self[word] = self.whole(text) if word.isalpha() else b"".join(map(self.parts, BETWEEN_WORDS.split(text)))
        return found


@functools.cache
def tokens_of(path: str):
    """Function from a text to its token ids; the text is cut where a token ends in any case. A worker keeps it for all its tasks."""
    parts = Parts(path)
    words = Words(parts).__getitem__

    def encode(text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = BETWEEN_WORDS.search(text, at + SLICE)
            end = cut.start() if cut else len(text)
            piece, at = text[at:end], end
            if DOUBTFUL.search(piece):
                out += map(parts.__getitem__, BETWEEN_WORDS.split(piece))
            else:
                first, *rest = piece.split(" ")
                out += map(parts.__getitem__, BETWEEN_WORDS.split(first))
                out += map(words, rest)
        return b"".join(out)

    return encode


def capacities(total: int, capacity: int) -> list[int]:
    """Sequences that hold exactly ``total`` tokens: full ones, and for the remainder one per power of two in it.

    A sequence is padded to the capacity unless its length is a power of two, so none of these is.
    """
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]


def attention_cost(length: int, width: int) -> int:
    """Linear plus quadratic cost of attention within a piece, in units of which a token's matrix products cost ``6 * width``."""
    return 6 * width * length + length * length


def pack(lengths: list[int], capacity: int = CAPACITY, width: int = WIDTH) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents of these lengths, and each sequence's cost.

    Documents of a capacity or more first fill sequences of their own. What is left is assigned by descending length, each to the
    sequence of lowest cost that has room for all of it. If none has, it is cut: its first tokens fill the sequence with the most room
    (of these the cheapest), and the rest is assigned when its length comes up. Ties: more room, then the earlier sequence;
    documents of one length in their given order.
    """
    room = capacities(sum(lengths), capacity)
    cost, fill, pieces, full = [0] * len(room), [0] * len(room), [], 0
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(capacity)]  # documents by what is left of them
    aside: list[list[tuple[int, int]]] = [[] for _ in range(capacity)]  # sequences by room, too little for any document seen so far

    def put(document: int, start: int, length: int, sequence: int) -> None:
        pieces.append((document, start, length, sequence, fill[sequence]))
        fill[sequence] += length
        room[sequence] -= length
        cost[sequence] += attention_cost(length, width)

    for document, length in enumerate(lengths):
        for start in range(0, length - capacity + 1, capacity):
            put(document, start, capacity, full)
            full += 1
        if length % capacity:
            waiting[length % capacity].append((document, length - length % capacity))
    ready = [(0, -room[i], i) for i in range(full, len(room))]
    heapq.heapify(ready)
    for length in range(capacity - 1, 0, -1):
        for c, i in aside[length]:
            heapq.heappush(ready, (c, -length, i))
        aside[length] = []
        most = length - 1
        for document, start in waiting[length]:
            while ready and -ready[0][1] < length:
                c, r, i = heapq.heappop(ready)
                heapq.heappush(aside[-r], (c, i))
            if ready:
                _, _, i = heapq.heappop(ready)
                put(document, start, length, i)
            else:
                most = max([most, *(-r for _, r, _ in ready)])
                while not aside[most]:
                    most -= 1
                _, i = heapq.heappop(aside[most])
                put(document, start, most, i)
                waiting[length - most].append((document, start + most))
                continue
            if room[i] >= length:
                heapq.heappush(ready, (cost[i], -room[i], i))
            elif room[i]:
                heapq.heappush(aside[room[i]], (cost[i], i))
                most = max(most, room[i])
    return pieces, cost


def _packed(path: str, capacity: int, width: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens_of(path), np.array([END], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        keys, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            lengths = [len(t) // 4 for t in texts]
            pieces, cost = pack(lengths, capacity, width)
            d, start, length, s, offset = (np.array(x, np.int64) for x in (zip(*pieces, strict=True) if pieces else [[]] * 5))
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()).take(pa.array(d)), pa.array(start), pa.array(length), pa.array(np.array(lengths, np.int64)[d]),
                 pa.array(s + sequence), pa.array(offset), pa.array(np.array(cost, np.int64)[s]),
                 pa.array([texts[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p in pieces], pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_cost", "ids"])
            sequence += len(cost)
            keys.clear()
            texts.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                texts.append(encode(text.as_py() or "") + end)
                held += len(texts[-1]) // 4
                if held >= group:
                    yield flush()
                    held = 0
        if texts:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """Sequences of at most ``capacity`` tokens made of all documents, one row per piece:
    ``doc_id, start, length, doc_tokens, sequence_id, offset, sequence_cost, ids``.

    A document is the ids of the ``tokenizer`` file for its whole text and an end token; ``ids`` are little-endian unsigned 32-bit
    numbers. Groups of some ``group`` tokens are packed where their rows are read, so nothing is shuffled, a lost task is packed
    anew without the others, and a task holds one group (or one document, if that is longer). Every sequence is full or, in the
    remainder of a group, as long as a power of two: there is no padding. ``sequence_id`` is unique, not dense.

    NULL and empty texts are the end token alone; NULL ids and repeated rows are documents of their own; other columns are
    ignored; an empty table gives no sequence.
    """
    kinds = schema(doc_id="bigint", start="bigint", length="bigint", doc_tokens="bigint", sequence_id="bigint", offset="bigint",
                   sequence_cost="bigint", ids="binary")
    return pick(docs, doc_id="bigint", text="string").mapInArrow(_packed(tokenizer, capacity, width, group), kinds)


def op11_cost_balanced_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read(spark, sf_dir, "documents"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_cost")
