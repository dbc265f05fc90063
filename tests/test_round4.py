"""Work that would grow faster than the input: many small splits, many small chunks, one large file."""

import pytest
from pyspark.sql import functions as F
from test_sources_sinks import log, put

from plantlytics.operators import ordering
from plantlytics.operators.ordering import CHUNK
from plantlytics.plans import telemetry
from plantlytics.sources import plantlog as P

HEADER = ["Date", "n"]


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "400")
    yield
    spark.conf.set(key, before)


def lines_of(part, n):
    return [f"2025-01-01 00:00:00.{part:03}\t{part * n + i}" for i in range(n)]


def test_many_small_splits_share_tasks(spark, tmp_path, monkeypatch, small_splits):
    """Their rows are those of one split a task, numbered in file order; preambles shorter and longer than a split."""
    monkeypatch.setattr(P, "TASKS_PER_CORE", 1)
    n = 1500
    for part in range(3):
        data = log(HEADER, lines_of(part, n)).replace(b"title", b"title" * (1 if part else 300))
        put(tmp_path, f"p{part}.tsv", data)
    put(tmp_path, "p3.tsv", log(HEADER, []) + b"\n" * 900)
    paths = P.uploads(str(tmp_path))
    raw = P.read_plant_log(spark, paths)
    tasks = max(spark.sparkContext.defaultParallelism, 4)
    assert P._text(spark, paths).rdd.getNumPartitions() > 300 and raw.rdd.getNumPartitions() <= 2 * tasks
    for rows in (raw.collect(), P.read_plant_log(spark, paths, allow_missing=True).collect()):
        assert [int(r.n) for r in sorted(rows, key=lambda r: r.row_id)] == list(range(3 * n))
        assert len({r.row_id for r in rows}) == 3 * n
    assert P.load_summary(spark, paths).first().records == 3 * n


def test_only_long_preambles_are_listed(spark, tmp_path, small_splits):
    put(tmp_path, "a.tsv", log(HEADER, lines_of(0, 100)))
    short = P.uploads(str(tmp_path))
    assert P._long_preambles(spark, short, None) is None
    path = put(tmp_path, "b.tsv", log(HEADER, lines_of(1, 100)).replace(b"title", b"title" * 300))
    late = P._long_preambles(spark, short, HEADER).collect()
    names = {r.file_id for r in P._text(spark, path).select("file_id").distinct().collect()}
    assert {r.file_id for r in late} == names and late[0].header == "Date\tn" and not late[0].differs
    assert P.read_plant_log(spark, short).count() == 200


def test_chunks_are_bounded(spark, monkeypatch):
    """More rows lead to larger chunks at some point; their numbers stay right."""
    monkeypatch.setattr(ordering, "MOST_CHUNKS", 16, raising=False)
    df = spark.range(3000).repartition(4)
    chunks = ordering.in_order(df, ["id"], 10).select(F.spark_partition_id().alias(CHUNK)).distinct().count()
    assert 8 < chunks <= 16
    assert all(r.number == r.id + 1 for r in ordering.row_numbers(df, ["id"], rows_per_chunk=10).collect())


def test_one_large_file_is_sorted_in_parts(spark, tmp_path, monkeypatch):
    """No task sorts all rows; the file holds one preamble and all lines in order."""
    frame, parts = type(spark.range(0)), []
    real = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *cols: parts.append(n) or real(self, n, *cols))
    monkeypatch.setattr(telemetry, "ROWS_PER_LOG", 1000)
    n = 25_000
    df = spark.range(n).repartition(3).select(F.col("id").alias("k"), F.col("id").cast("string").alias("a"), F.when(F.col("id") % 3 > 0, "é x").alias("b"))
    for kind in ("text", "csv"):
        telemetry.write_logs(df, str(tmp_path / kind), ["a", "b"], order="k", files=1, kind=kind)
        files = list((tmp_path / kind).glob("part-*"))
        top = ["plant log", "a\tb", *[f"preamble {i}" for i in range(8)]]
        assert [f.read_text() for f in files] == ["".join(f"{x}\n" for x in [*top, *[f"{i}\t{'é x' if i % 3 else ''}" for i in range(n)]])]
    assert parts == [25, 25]
    telemetry.write_logs(df.limit(0), str(tmp_path / "none"), ["a", "b"], order="k", files=1)
    assert all(f.read_text().splitlines() == top for f in (tmp_path / "none").glob("part-*"))
