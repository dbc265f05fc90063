"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plantlytics.llm.common import line, pick, read, schema, stored
from plantlytics.llm.components import components
from plantlytics.llm.kernels import NOT_BLANK, blocks, mix, shingles, u64, words

#: 40 bands of 5 bins: a pair of similarity 0.8 shares no bucket with probability (1 - 0.8^5)^40, some 1e-7.
BANDS, ROWS = 40, 5
#: Bands whose stars are confirmed at once; those of the others only where their ends are not linked by then.
FIRST = 4
#: Sets a task keeps at hand while it checks pairs.
RECENT = 4000
#: One-bit bins, and bits of a plain bitmap of the set, by which pairs left over by the stars are sifted before the exact check.
BITS, MAP = 1024, 2048
#: Members of an open bucket that are compared with as many at once.
MEMBERS = 256


def _sets(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    h, _, _, ptr = words(raw, off, NOT_BLANK)
    s, out = shingles(h, ptr, k)
    return [np.unique(s[a:b]) for a, b in zip(out[:-1], out[1:], strict=True)]


def _probes(bins: int) -> np.ndarray:
    """For each bin an order of all bins in which an empty one borrows from the first that is full."""
    rng = np.random.default_rng(5)
    return np.stack([rng.permutation(bins) for _ in range(bins)]).astype(np.int16)


def sketch(sets: list[np.ndarray], probes: np.ndarray) -> np.ndarray:
    """Least shingle of each bin (bins cut the hash range evenly); empty bins densified. Needs non-empty sets."""
    bins = len(probes)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    s = np.concatenate(sets)
    slot = row * bins + ((s >> u64(32)) * u64(bins) >> u64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    out = np.zeros(len(sets) * bins, np.uint64)
    full = np.zeros(len(out), bool)
    out[slot[first]], full[slot[first]] = s[first], True
    out, full = out.reshape(-1, bins), full.reshape(-1, bins)
    r, c = np.nonzero(~full)
    for step in range(bins):
        if not len(r):
            break
        j = probes[c, step]
        ok = full[r, j]
        out[r[ok], c[ok]] = out[r[ok], j[ok]]
        r, c = r[~ok], c[~ok]
    return out


def _signatures(k: int):
    """Columns ``doc_id, text`` and any further ones to a number of the row, set size, key, bands and packed text, and the further ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, press = _probes(BANDS * ROWS), zstandard.ZstdCompressor(level=3)
        order = np.arange(1, BANDS + 1, dtype=np.uint64)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, raw, off in blocks(batch.column(1)):
                sets = _sets(raw, off, k)
                at = [i for i, s in enumerate(sets) if len(s)]
                n, key, band, text = np.zeros(b - a, np.int64), [None] * (b - a), [None] * (b - a), [None] * (b - a)
                if at:
                    sk = sketch([sets[i] for i in at], probes)
                    h = np.repeat(order[None, :], len(at), 0)
                    for j in range(ROWS):
                        h = mix(h * u64(0x9E3779B97F4A7C15) + sk[:, j::ROWS])
                    for i, hh in zip(at, h.view(np.int64), strict=True):
                        n[i] = len(sets[i])
                        key[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                        band[i] = hh
                        text[i] = press.compress(raw[off[i] : off[i + 1]].tobytes())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.arange(row, row + b - a)), pa.array(n), pa.array(key, pa.binary()),
                     pa.array(band, pa.list_(pa.int64())), pa.array(text, pa.binary()), *part.columns[2:]],
                    ["doc_id", "row", "n_shingles", "key", "bands", "packed", *part.schema.names[2:]])
                row += b - a

    return run


def _bits(k: int):
    """Columns ``key, packed`` to ``key``, one bit of each of the BITS bins and the bitmap of the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, unpack = _probes(BITS), zstandard.ZstdDecompressor()
        salt = mix(np.arange(1, BITS + 1, dtype=np.uint64))
        for batch in batches:
            for a in range(0, len(batch), 64):
                part = batch.slice(a, 64)
                texts = [unpack.decompress(x) for x in part.column(1).to_pylist()]
                off = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
                sets = _sets(np.frombuffer(b"".join(texts), np.uint8), off, k)
                bits = np.packbits((mix(sketch(sets, probes) ^ salt) & u64(1)).astype(np.uint8), axis=1)
                there = np.zeros((len(sets), MAP), np.uint8)
                for row, s in zip(there, sets, strict=True):
                    row[(s % u64(MAP)).astype(np.int64)] = 1
                maps = np.packbits(there, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array([x.tobytes() for x in maps], pa.binary())],
                    ["key", "bits", "map"])

    return run


def _sift(percent: int):
    """Pairs of blocks of one bucket, columns ``h, same, one, two``, to the pairs of keys worth an exact check.

    Sifted are pairs of one component, of sizes too different, with fewer equal bits than six standard deviations below what
    the wanted similarity gives, and whose bitmaps show too few common shingles (each bit that one set has and the
    other lacks is a shingle of its own). A pair that shares several buckets comes out of the first.
    """
    alike = (1 + percent / 100) / 2
    most = int(BITS * (1 - alike) + 6 * (BITS * alike * (1 - alike)) ** 0.5)

    def members(block: pa.Scalar) -> dict[str, np.ndarray]:
        rows = block.values
        fixed = lambda name: np.frombuffer(b"".join(rows.field(name).to_pylist()), np.uint64).reshape(len(rows), -1)
        bands = np.array(rows.field("bands").to_pylist(), np.int64)
        return {"keys": rows.field("key").to_pylist(), "n": rows.field("n").to_numpy(), "label": fixed("label"), "bits": fixed("bits"),
                "map": fixed("map"), "bands": bands}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                x, y = members(batch.column(2)[r]), members(batch.column(3)[r])
                small, large = np.minimum.outer(x["n"], y["n"]), np.maximum.outer(x["n"], y["n"])
                fits = (100 * small >= percent * large) & (x["label"][:, None] != y["label"]).any(2)
                i, j = np.nonzero(np.triu(fits, 1) if batch.column(1)[r].as_py() else fits)
                near = np.bitwise_count(x["bits"][i] ^ y["bits"][j]).sum(1) <= most
                i, j = i[near], j[near]
                n, m, one, two = x["n"][i], y["n"][j], x["map"][i], y["map"][j]
                shared = np.minimum(n - np.bitwise_count(one & ~two).sum(1, dtype=np.int64), m - np.bitwise_count(two & ~one).sum(1, dtype=np.int64))
                common = x["bands"][i] == y["bands"][j]
                first = x["bands"][i, common.argmax(1)] if len(i) else np.zeros(0, np.int64)
                good = ((100 + percent) * shared >= percent * (n + m)) & (first == batch.column(0)[r].as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["keys"][t] for t in i[good]], pa.binary()), pa.array([y["keys"][t] for t in j[good]], pa.binary())], ["a", "b"])

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        recent: dict[bytes, np.ndarray] = {}

        def shingle_set(key: bytes, packed: pa.Scalar) -> np.ndarray:
            found = recent.pop(key, None)
            if found is None:
                raw = np.frombuffer(unpack.decompress(packed.as_py()), np.uint8)
                found = _sets(raw, np.array([0, len(raw)]), k)[0]
            recent[key] = found
            if len(recent) > RECENT:
                recent.pop(next(iter(recent)))
            return found

        for batch in batches:
            left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            one, two = batch.column(2), batch.column(3)
            keep = []
            for i in range(len(batch)):
                x, y = shingle_set(left[i], one[i]), shingle_set(right[i], two[i])
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([left[i] for i in keep], pa.binary()), pa.array([right[i] for i in keep], pa.binary())],
                ["a", "b"])

    return run


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``(key, label)`` after further links ``(a, b)`` between keys: only links between two components count."""
    one, two = (labels.select(F.col("key").alias(x), F.col("label").alias(y)) for x, y in (("a", "la"), ("b", "lb")))
    across = stored(links.join(one, "a").join(two, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "across")
    if across.isEmpty():
        return labels
    up = components(across).select(F.col("v").alias("label"), F.col("label").alias("up"))
    return stored(labels.join(up, "label", "left").select("key", F.coalesce("up", "label").alias("label")), "labels")


def _grouped(rows: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``doc_id, text`` ending in a line feed, and any others) with their numbers, sets and keys; and per key its component's
    least ``doc_id`` (``component``) and the number of the row that it has it from (``first``)."""
    kinds = StructType.fromDDL(schema(doc_id="bigint", row="bigint", n_shingles="bigint", key="binary", bands="array<bigint>", packed="binary"))
    signed = stored(rows.mapInArrow(_signatures(k), StructType(kinds.fields + rows.schema.fields[2:])), "signatures")
    some = signed.where("key IS NOT NULL").withColumn("v", F.xxhash64("key"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    classes = stored(some.groupBy("key", "v").agg(least), "classes")  # equal sets are one vertex

    # Merge joins at every size: a broadcast that only small tables get would hide what large ones shuffle.
    once = some.join(classes.select("least.row").hint("merge"), "row", "left_semi")
    bucket = once.select("v", F.posexplode("bands").alias("band", "h"))
    star = bucket.groupBy("h").agg(F.min(F.expr("v ^ h")).alias("c"), F.max(F.expr("v ^ h")).alias("hi")).where("c <> hi")
    star = star.select("h", F.expr("c ^ h").alias("c"))
    arms = stored(bucket.join(star, "h").where("v <> c"), "arms")
    ends = arms.select("v").union(arms.select("c")).distinct()
    wanted = classes.join(ends, "v", "left_semi").select("least.row")
    reps = stored(some.join(wanted.hint("merge"), "row", "left_semi").select("key", "v", F.col("n_shingles").alias("n"), "bands", "packed"), "reps")

    def confirmed(pairs: DataFrame, on: str) -> DataFrame:
        """Pairs ``(a, b)``, given by the column ``on`` of reps, whose sets are as alike as wanted."""
        two = reps.select(F.col(on).alias("b"), F.col("key").alias("kb"), F.col("n").alias("nb"), F.col("packed").alias("tb"))
        one = reps.select(F.col(on).alias("a"), F.col("key").alias("ka"), F.col("n").alias("na"), F.col("packed").alias("ta"))
        full = pairs.join(two.hint("merge"), "b").join(one.hint("merge"), "a").where(f"ka <> kb AND 100 * least(na, nb) >= {percent} * greatest(na, nb)")
        return stored(full.select("ka", "kb", "ta", "tb").mapInArrow(_confirm(k, percent), schema(a="binary", b="binary")), "links")

    edges = arms.select(F.col("c").alias("a"), F.col("v").alias("b"), "band")
    links = confirmed(edges.where(F.col("band") < FIRST).select("a", "b").distinct(), "v")
    up = components(links, rounds=2).withColumnRenamed("v", "key")
    first = stored(reps.select("key").join(up, "key", "left").select("key", F.coalesce("label", "key").alias("label")), "labels")
    by_v = reps.select("key", "v").join(first, "key").select("v", "label")
    apart = edges.where(F.col("band") >= FIRST).select("a", "b").distinct()
    apart = apart.join(by_v.toDF("b", "lb"), "b").join(by_v.toDF("a", "la"), "a").where("la <> lb").select("a", "b").distinct()
    labels = _merged(first, links.union(confirmed(apart, "v")))

    known = reps.select("v", "key", "n").join(labels, "key")
    members = arms.select("v", "h").join(known, "v")  # without the centres: all pairs with these are told
    open_h = members.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h")
    rest = stored(members.join(open_h, "h").select("h", "key", "n", "label"), "open")
    marked = stored(reps.join(rest.select("key").distinct(), "key", "left_semi").select("key", "packed")
                    .mapInArrow(_bits(k), schema(key="binary", bits="binary", map="binary")), "bits")
    marked = marked.join(reps.select("key", "bands"), "key")
    sizes = rest.groupBy("h").agg(F.ceil(F.count("*") / MEMBERS).alias("cuts"))
    block = rest.join(marked, "key").join(sizes, "h").groupBy("h", F.expr("pmod(xxhash64(key), cuts)").alias("i")).agg(
        F.collect_list(F.struct("key", "n", "label", "bits", "map", "bands")).alias("two"))
    pairs = block.select("h", F.col("i").alias("j"), F.col("two").alias("one")).join(block, "h").where("j <= i").select("h", F.expr("i = j").alias("same"), "one", "two")
    sifted = stored(pairs.mapInArrow(_sift(percent), schema(a="binary", b="binary")), "pairs")
    labels = _merged(labels, confirmed(sifted.distinct(), "key"))

    named = classes.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    roots = named.groupBy("label").agg(F.min("least").alias("root"))
    return signed, named.join(roots, "label").select("key", F.col("root.doc_id").alias("component"), F.col("root.row").alias("first"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Component of each document under "shingle sets at least ``percent`` per cent alike": one row per input row.

    Texts are lower-cased (A-Z) and cut at blanks; a set is the distinct ``k``-word shingles, or the
    whole sequence of a shorter text. Returns ``doc_id, n_shingles, component_id, kept``.

    Equal sets are one vertex. A set is sketched by one permutation into 200 bins; empty bins borrow from
    full ones in an order fixed per bin (optimal densification). Each band bucket sends only a star of edges
    to the exact check on full sets, its centre chosen by hash: first those of :data:`FIRST` bands, then, of the other bands, those whose ends
    are not linked by then, so a large group of copies costs a few edges per document. Where a bucket's
    members still end in several components, the pairs between these are left over: a join inside the bucket sifts them by
    set size, by 1024 one-bit bins (six standard deviations below what the wanted similarity gives) and by the
    most shingles that two bitmaps can share, and the exact check decides on the rest, so no link is lost.

    NULL, empty and blank texts: ``n_shingles`` 0, a component of their own. A NULL ``doc_id`` is never
    the least; a component of such rows alone has a NULL id and all are kept. Repeated rows and other rows
    with one ``doc_id`` share their fate if their texts do. Other columns are ignored; an empty table gives an empty result.
    """
    rows = pick(docs, doc_id="bigint", text="string").select("doc_id", line(F.col("text")).alias("text"))
    signed, found = _grouped(rows, k, percent)
    out = signed.select("doc_id", "n_shingles", "key").join(found.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.expr("doc_id <=> component_id"))


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=4)


def keep_one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: exactly one row of each group of near copies (five-word shingles), that of the least ``doc_id``.

    The verdict belongs to the row, not to its id: of rows that share an id, only those in one group replace each other, and of repeated rows
    one stays. A NULL id comes last; a group of such rows alone keeps one. Rows without words (NULL, empty, blank texts) are in no group and all
    stay. All columns come back as they were, whatever their names; an empty table gives an empty result.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    whole = F.struct(*plain.columns).alias("doc")
    at = {n: f"c{names.index(n)}" if n in names else None for n in ("doc_id", "text")}
    key = (F.col(at["doc_id"]) if at["doc_id"] else F.lit(None)).cast("bigint").alias("doc_id")
    text = line((F.col(at["text"]) if at["text"] else F.lit(None)).cast("string")).alias("text")
    signed, found = _grouped(plain.select(key, text, whole), 5, 80)
    stay = signed.where("key IS NULL").select("row").union(found.select("first").distinct())
    return signed.join(stay.withColumnRenamed("row", "first"), F.col("row") == F.col("first"), "left_semi").select("doc.*").toDF(*names)
