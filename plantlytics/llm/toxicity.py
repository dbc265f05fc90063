"""Toxicity of texts after noisy-channel deobfuscation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlytics.llm import linear
from plantlytics.llm.common import fold, line, pick, read, schema
from plantlytics.llm.kernels import ALNUM, LOWER, NOT_BLANK, blocks, row_of, words
from plantlytics.llm.textmap import map_text

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
        "+": "t", "(": "c"}
#: Signs that may stand between the letters of a word.
GAPS = ".-_*~'"
#: Channel costs in nats: a sign read as a letter, a sign dropped, a letter of a run dropped, a word ended at a gap sign.
READ, DROP, THIN, BREAK = 1.0, 6.0, 0.5, 4.0
#: Symbols of the language model: 0 is outside words, 1 to 26 are letters, 27 any non-ASCII byte.
SYMBOLS = 28
#: Byte lengths of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6)
#: Readings of tokens up to this many bytes are remembered; longer ones are decoded each time.
LONG = 64

_BLANKS = rb"[\x20\x09-\x0D]+"
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27
_LETTER = _CLASS > 0
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in GAPS]] = True


def character_model(docs: DataFrame) -> np.ndarray:
    """Costs -ln P(c | a, b) of letter trigrams, from counts over all texts (28^3 numbers, whatever the input)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, _, raw, _ in blocks(batch.column(0)):
                c = _CLASS[LOWER[raw]]
                c = np.concatenate(([0, 0], c))
                total += np.bincount(c[:-2] * SYMBOLS**2 + c[1:-1] * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["g", "n"])

    rows = (docs.select(line(F.col("text")).alias("text")).mapInArrow(count, schema(g="bigint", n="bigint"))
            .groupBy("g").agg(F.sum("n").alias("n")).collect())
    n = np.zeros(SYMBOLS**3)
    for r in rows:
        n[r.g] = r.n
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = n.sum((0, 1)) + 1
    one = one / one.sum()
    two = n.sum(0)
    two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
    three = (n + 5 * two) / (n.sum(2, keepdims=True) + 5)
    return -np.log(three)


def decode(token: bytes, cost: list | np.ndarray, whole: bool = False) -> bytes:
    """Cheapest reading of a lower-case token: Viterbi over its lattice, the state being the last two symbols.

    Letters read as themselves, the third and later of a run may go (and the second of a run that long);
    LEET signs read as one of their letters or go; gap signs go or end a word, and so does a blank, at no cost. Other bytes
    end a word; so may any sign, but with ``whole`` no LEET sign.
    Tokens may have any length: outputs are chains of shared links, so work and memory grow with the length.
    """
    size = len(token)
    run = [0] * size
    i = 0
    while i < size:
        j = i
        while j < size and token[j] == token[i]:
            j += 1
        for x in range(i, j):
            run[x] = x - i if j - i >= 3 and _LETTER[token[i]] else 0
        i = j
    # state -> (cost, output as a chain of (chain before, byte))
    beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for x in range(size):
        byte = token[x]
        options: list[tuple[float, bytes]] = []
        if _LETTER[byte]:
            options.append((0.0, token[x : x + 1]))
            if run[x]:
                options.append((THIN if run[x] == 1 else 0.0, b""))
        elif byte == 32:
            options += [(0.0, b""), (0.0, b" ")]
        else:
            sign = chr(byte)
            for letter in LEET.get(sign, ""):
                options.append((READ, letter.encode()))
            if sign in LEET or sign in GAPS:
                options.append((DROP if sign in LEET else 0.0, b""))
            if not (whole and sign in LEET):
                options.append((BREAK if sign in GAPS else 0.0, b" "))
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (so_far, chain) in beam.items():
            for price, out in options:
                if out:
                    c = int(_CLASS[out[0]])
                    if c == 0 and b == 0:
                        state, total = (a, b), so_far + price
                    else:
                        state, total = (b, c), so_far + price + cost[a][b][c]
                else:
                    state, total = (a, b), so_far + price
                old = after.get(state)
                if old is None or total < old[0]:
                    after[state] = (total, (chain, out) if out else chain)
        beam = after
    ends = [(so_far + cost[a][b][0], chain) for (a, b), (so_far, chain) in beam.items()]
    least = min(total for total, _ in ends)
    return min(_unlinked(chain) for total, chain in ends if total == least).strip()


def _unlinked(chain: tuple | None) -> bytes:
    out = []
    while chain is not None:
        chain, byte = chain
        out.append(byte)
    return b"".join(reversed(out))


def noisy_spans(raw: np.ndarray, off: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Byte ranges worth decoding in lower-cased bytes: blank-separated tokens that hold a letter and a LEET sign, a gap
    sign between other bytes, or a letter three times in a row; and spelled-out words.

    Gap signs at the ends of a token of letters always go, so these alone need no decoding. Spelled out are two or more tokens of one
    letter or LEET sign each, with any gap signs and blanks between them: a letter must be among them unless they
    are four. ``off`` are the places where texts begin; nothing is spelled across them.
    """
    letter, sign, gap = _LETTER[raw], _SIGN[raw], _GAP[raw]
    token = NOT_BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], token, [False])).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return []

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[end] - total[begin]

    same = np.zeros(len(raw), bool)
    if len(raw) > 2:
        same[:-2] = letter[2:] & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])
    solid = token & ~gap
    pieces = solid & ~np.concatenate(([False], solid[:-1]))
    letters, signs, gaps = count(letter), count(sign), count(gap)
    flagged = (letters > 0) & ((signs > 0) | (count(pieces) > 1) | (count(same) > 0))

    one = (letters + signs == 1) & (gaps + 1 == end - begin)
    member = one | (gaps == end - begin)
    text = np.searchsorted(off, begin, "right") if off is not None else np.zeros(len(begin), np.int64)
    fresh = member & ~np.concatenate(([False], member[:-1] & (text[1:] == text[:-1])))
    run = np.cumsum(fresh)
    at = np.flatnonzero(one)
    spelled = []
    if len(at):
        cut = np.flatnonzero(np.diff(run[at], prepend=-1))
        size = np.diff(np.append(cut, len(at)))
        worth = (size >= 4) | (size >= 2) & (np.add.reduceat(letters[at], cut) > 0)
        for x, n in zip(cut[worth].tolist(), size[worth].tolist(), strict=True):
            first, last = int(at[x]), int(at[x + n - 1])
            spelled.append((int(begin[first]), int(end[last])))
            flagged[first : last + 1] = False
    return list(zip(begin[flagged].tolist(), end[flagged].tolist(), strict=True)) + spelled


def _readable(part: bytes) -> bytes:
    """A token as it is; of a spelled-out word the least blanks become a gap sign and wider ones a blank."""
    gaps = re.findall(_BLANKS, part)
    if not gaps:
        return part
    narrow = min(map(len, gaps))
    return re.sub(_BLANKS, lambda m: b"." if len(m[0]) == narrow else b" ", part)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of whole words and of their beginnings, and the text each belongs to."""
    h, begin, end, ptr = words(raw, off, ALNUM)
    row = row_of(ptr)
    slots, rows = [_slots(h)], [row]
    low = LOWER[raw].astype(np.uint64)
    for k in BEGINNINGS:
        at = np.flatnonzero(end - begin >= k)
        s = np.full(len(at), k, np.uint64)
        for j in range(k):
            s = s * np.uint64(0x100000001B3) + low[begin[at] + j]
            s = s * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
        slots.append(_slots(s * np.uint64(0xD6E8FEB86659FD93)))
        rows.append(row[at])
    return np.concatenate(slots), np.concatenate(rows)


def restored_slots(cost: np.ndarray):
    """Make a function from texts to the distinct feature slots of each, its noisy parts decoded first."""
    def make():
        memo: dict[tuple[bytes, bool], bytes] = {}
        costs = cost.tolist()

        def reading(key: bytes, whole: bool) -> bytes:
            if len(key) > LONG:
                return decode(key, costs, whole)
            if (key, whole) not in memo:
                if len(memo) >= 50_000:
                    memo.clear()
                memo[key, whole] = decode(key, costs, whole)
            return memo[key, whole]

        def restore(raw: np.ndarray, off: np.ndarray) -> list[tuple[int, bytes]]:
            low, out = LOWER[raw], []
            for a, b in noisy_spans(low, off):
                token = low[a:b].tobytes()
                # Letters spelled out count as one word as well as by the cheapest reading.
                ways = {(_readable(token), False), (b"".join(token.split()), False)}
                # A sign that opens a token ends a word that never began, at no cost: it is read as a letter as well.
                if _SIGN[token[0]]:
                    ways.add((_readable(token), True))
                out += [(a, plain) for plain in sorted({reading(*way) for way in ways}) if plain != token]
            return out

        def work(text: pa.Array) -> list[np.ndarray]:
            result = []
            for a, b, raw, off in blocks(text):
                slots, rows = _features(raw, off)
                extra = restore(raw, off)
                if extra:
                    at = np.searchsorted(off, [x for x, _ in extra], "right") - 1
                    order = np.argsort(at, kind="stable")
                    joined = [extra[i][1] + b"\n" for i in order]
                    ends = np.concatenate(([0], np.cumsum([len(x) for x in joined])))
                    s, r = _features(np.frombuffer(b"".join(joined), np.uint8), ends)
                    slots, rows = np.concatenate((slots, s)), np.concatenate((rows, at[order][r]))
                code = np.unique(rows * linear.SLOTS + slots)
                cut = np.searchsorted(code, np.arange(b - a + 1) * linear.SLOTS)
                code %= linear.SLOTS
                result += [code[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
            return result

        return work

    return make


def restore_text(text: str, cost: np.ndarray) -> str:
    """The text in lower case (A-Z) with its noisy parts replaced by their cheapest reading."""
    raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
    out, at = [], 0
    for a, b in sorted(noisy_spans(raw)):
        if a >= at:
            out += [raw[at:a].tobytes(), decode(_readable(raw[a:b].tobytes()), cost)]
            at = b
    return b"".join([*out, raw[at:].tobytes()]).decode()


def toxicity_model(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Character model over all texts, and weights from at most ``max_rows`` labelled rows outside fold 0 of 5."""
    cost = character_model(docs)
    sample = linear.sample_labels(pick(labels, doc_id="bigint", toxic="int"), "toxic", max_rows)
    return cost, *linear.fit(pick(docs, doc_id="bigint", text="string"), sample, restored_slots(cost))


def toxicity(docs: DataFrame, model: tuple, keep: list[str] | None = None, plain_names: bool = False) -> DataFrame:
    """``docs`` with ``score``: the probability that the restored text is toxic.

    A text is lower-cased; tokens of letters and signs, letters thrice in a row and spelled-out words are decoded by the
    cheapest path through the lattice of their readings under a letter trigram model; words and word
    beginnings as written and as restored are the features of a logistic model. Rows are scored where they are
    read, whole. NULL, empty and blank texts have no features and score the model's bias;
    repeated rows score alike; other columns are never looked at.
    """
    cost, slots, w, bias = model
    make_slots = restored_slots(cost)

    def make():
        work, dense = make_slots(), linear.dense_weights(slots, w)
        return lambda text: [pa.array(linear.scores(work(text), dense, bias), pa.float64())]

    return map_text(docs, make, keep=keep, plain_names=plain_names, score="double")


def op4_noisy_channel_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    found = toxicity(docs, toxicity_model(docs, read(spark, sf_dir, "labels")), keep=["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored 0.5 or more go.

    The verdict is the text's: rows that share or lack an id are judged each by itself, repeated rows alike. NULL and empty texts get the
    score of a text without signs and stay unless labels say otherwise. All columns come back as they were, whatever their
    names; an empty table gives an empty result.
    """
    model = toxicity_model(pick(docs, doc_id="bigint", text="string"), read(spark, sf_dir, "labels"))
    names = docs.columns
    kept = toxicity(docs, model, plain_names=True).where("score < 0.5")
    return kept.select([F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
