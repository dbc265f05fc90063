import datetime as dt

import pytest
from pyspark.sql import functions as F

from plantlytics.operators import prepare
from plantlytics.plans import pipeline, report
from plantlytics.roles import resolve_roles
from plantlytics.sinks import export
from plantlytics.sources import plantlog as P
from plantlytics.sources.datasets import FILTERED, MAIN, Datasets


def log(header, rows, end="\n", bom=False):
    lines = ["title", "\t".join(header), *["# note\t2025-01-01 00:00:00"] * 8, *rows]
    return (b"\xef\xbb\xbf" if bom else b"") + end.join(lines).encode() + end.encode()


def put(folder, name, data):
    path = folder / name
    path.write_bytes(data)
    return str(path)


HEADER = ["Date", "X_ON", "X_READY", "Feed", "Feed", " Temp SP "]
ROW = "2025-03-01 23:56:00.5\t1\t1\t10.0\tNaN\tabc"


def test_scan(spark, tmp_path):
    path = put(tmp_path, "a.txt", log(HEADER, [ROW, "", "2025-03-01 23:57:00\t0", "bad\t1\t1\t2\t3\t4\tsurplus"], bom=True))
    raw = P.read_plant_log(spark, path)
    assert raw.columns == ["Date", "X_ON", "X_READY", "Feed", "Feed_1", "Temp SP", "row_id"]
    rows = [tuple(r)[:-1] for r in raw.orderBy("row_id").collect()]
    assert rows == [
        ("2025-03-01 23:56:00.5", "1", "1", "10.0", None, "abc"),
        ("2025-03-01 23:57:00", "0", None, None, None, None),
        ("bad", "1", "1", "2", "3", "4"),
    ]
    assert P.surplus_fields(spark, path, raw.columns[:-1]).first()[0] == 1
    typed = P.load_logs(spark, path)
    assert typed.orderBy("datetime").select("datetime", "X_ON", "X_READY", "Feed").collect() == [
        (dt.datetime(2025, 3, 1, 23, 56, 0, 500000), 1, 1, 10.0), (dt.datetime(2025, 3, 1, 23, 57), 0, 0, None)]


def test_crlf_quotes_and_bad_bytes(spark, tmp_path):
    data = log(["Date", "v", "w"], ['2025-01-01 00:00:00\t"1.5"\t"a\tb"'], end="\r\n").replace(b"title", b"t\xff")
    path = put(tmp_path, "a.txt", data + b"2025-01-01 00:01:00\t2\t\xff\xfe\r\n")
    rows = P.read_plant_log(spark, path).orderBy("row_id").collect()
    assert [(r.v, r.w) for r in rows] == [("1.5", "a\tb"), ("2", "��")]


def test_short_and_blank_files_give_nothing(spark, tmp_path):
    put(tmp_path, "b.txt", log(["Date", "v"], ["2025-01-01 00:00:00\t1"]))
    put(tmp_path, "c.txt", log(["other"], []))
    put(tmp_path, "d.txt", log(["another"], ["", ""]))
    put(tmp_path, "e.txt", b"one line\n")
    paths = [str(tmp_path / f"{x}.txt") for x in "bcde"]
    raw = P.read_plant_log(spark, paths)
    assert [(r.Date, r.v) for r in raw.collect()] == [("2025-01-01 00:00:00", "1")]
    summary = P.load_summary(spark, paths, P.load_logs(spark, paths)).first()
    assert (summary.file_count, summary.records) == (4, 1)
    assert summary.total_mb == pytest.approx((tmp_path / "b.txt").stat().st_size / (1 << 20))


def test_headers_must_agree(spark, tmp_path):
    a = put(tmp_path, "a.txt", log(["Date", "v"], ["2025-01-01 00:00:00\t1"]))
    b = put(tmp_path, "b.txt", log(["Date", "w"], ["2025-01-01 00:00:00\t2"]))
    with pytest.raises(Exception, match="differs from"):
        P.read_plant_log(spark, [a, b]).collect()
    both = P.read_plant_log(spark, [a, b], allow_missing=True)
    assert {(r.v, r.w) for r in both.collect()} == {("1", None), (None, "2")}


def test_no_time_column(spark, tmp_path):
    path = put(tmp_path, "a.txt", log(["when", "v"], ["2025-01-01 00:00:00\t1"]))
    with pytest.raises(ValueError, match="no time column"):
        P.load_logs(spark, path)


def test_split_files(spark, tmp_path):
    """Many splits per file: each data line once, numbered in file order."""
    start = dt.datetime(2025, 1, 1)
    names = ["Date", "n"]
    for part in range(3):
        rows = [f"{start + dt.timedelta(minutes=i)}\t{part * 5000 + i}" for i in range(5000)]
        put(tmp_path, f"p{part}.tsv", log(names, rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = P.read_plant_log(spark, P.uploads(str(tmp_path)))
        assert raw.rdd.getNumPartitions() > 50
        rows = raw.select("n", "row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(int(r.n) for r in rows) == list(range(15000))
    assert len({r.row_id for r in rows}) == 15000
    for part in range(3):
        mine = sorted((r.row_id, int(r.n)) for r in rows if int(r.n) // 5000 == part)
        assert [n for _, n in mine] == list(range(part * 5000, part * 5000 + 5000))


@pytest.fixture
def split_bytes(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("size,end", [(30, "\r\n"), (41, "\r"), (120, "\n"), (1000, "\n"), (100_000, "\r\n")])
def test_preambles_longer_than_a_split(spark, tmp_path, split_bytes, end, size):
    """No line of a preamble becomes a row, whatever the size of the splits."""
    names, want = ["Date", "v", "long name " * 3], []
    for part, rows in enumerate([3, 1, 0]):
        lines = [f"2025-01-01 00:{i:02}:00\t{part * 100 + i}\té" for i in range(rows)]
        want += [str(part * 100 + i) for i in range(rows)]
        put(tmp_path, f"f{part}.txt", log(names, lines, end=end, bom=part == 1))
    put(tmp_path, "f9.txt", log(["Date", "v", "other"], [], end=end))
    split_bytes(size)
    rows = P.read_plant_log(spark, P.uploads(str(tmp_path))).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.row_id)] == want
    assert len({r.row_id for r in rows}) == len(want)
    both = P.read_plant_log(spark, P.uploads(str(tmp_path)), allow_missing=True).collect()
    assert [r.v for r in sorted(both, key=lambda r: r.row_id)] == want
    summary = P.load_summary(spark, P.uploads(str(tmp_path))).first()
    assert (summary.file_count, summary.records, summary.replaced) == (4, len(want), 0)


def test_headers_behind_a_split_border(spark, tmp_path, split_bytes):
    a = put(tmp_path, "a.txt", log(["Date", "v"], ["2025-01-01 00:00:00\t1"]))
    b = put(tmp_path, "b.txt", log(["Date", "w"], ["2025-01-01 00:00:00\t2"]))
    split_bytes(40)
    with pytest.raises(Exception, match="differs from"):
        P.read_plant_log(spark, [a, b]).collect()
    assert {(r.v, r.w) for r in P.read_plant_log(spark, [a, b], allow_missing=True).collect()} == {("1", None), (None, "2")}


def test_smaller_splits_than_planned_are_an_error(spark, tmp_path, split_bytes):
    path = put(tmp_path, "a.txt", log(["Date"] + [f"s{i}" for i in range(600)], ["2025-01-01 00:00:00\t1"]))
    raw = P.read_plant_log(spark, path)
    split_bytes(2000)
    with pytest.raises(Exception, match="preamble reaches"):
        raw.collect()


def test_large_files_are_only_looked_into(spark, tmp_path, split_bytes):
    """The look at the heads reads a batch of each task's first split, not the files."""
    rows = [f"2025-01-01 00:00:00\t{i}" for i in range(60_000)]
    path = put(tmp_path, "a.txt", log(["Date", "v"], rows))
    split_bytes(400_000)
    heads = P._text(spark, path).mapInArrow(P._first_of_partition, "file_id long, start long, length long, lines long").collect()
    assert len(heads) > 3 and sorted((r.start, r.lines) for r in heads)[0] == (0, 10)
    assert P._long_preambles(spark, path, None) is None
    assert P.read_plant_log(spark, path).count() == 60_000


def test_places_of_many_and_large_files(spark, monkeypatch):
    """Row ids of 100,000 files of three terabytes don't meet, in one task or in chunks."""
    size = 3 << 40
    files = spark.range(100_000).select(F.format_string("f%06d", "id").alias("file"), (F.lit(size) + F.col("id")).alias("bytes"))
    monkeypatch.setattr(P, "_listing", lambda spark, paths: files)
    for limit in (P.FEW_FILES, 30_000):
        monkeypatch.setattr(P, "FEW_FILES", limit)
        places = P._places(spark, "").join(files.withColumn("file_id", F.xxhash64("file")), "file_id").orderBy("file").collect()
        assert len(places) == 100_000
        assert all(a.base + a.bytes + 1 == b.base for a, b in zip(places, places[1:])) and places[0].base == 0
        assert places[-1].base + places[-1].bytes < 2**63


def test_replaced_bytes_are_counted(spark, tmp_path):
    data = log(["Date", "v"], []) + b"2025-01-01 00:00:00\t\xff\n2025-01-01 00:01:00\t\xef\xbf\xbd\n2025-01-01 00:02:00\tx\xfe\xffy\xef\xbf\xbd\nbad\t1\n"
    path = put(tmp_path, "a.txt", data.replace(b"title", b"t\xff"))
    row = P.load_summary(spark, path).first()
    assert (row.file_count, row.records, row.replaced) == (1, 3, 3)
    same = P.load_summary(spark, path, allow_missing=True).first()
    assert (same.file_count, same.records, same.replaced, same.total_mb) == (row.file_count, row.records, row.replaced, row.total_mb)


def test_quotes_leave_the_other_lines_alone(spark, tmp_path):
    rows = [f'2025-01-01 00:00:00\t{i}\t"a\tb"' if i % 7 == 0 else f"2025-01-01 00:00:00\t{i}" for i in range(100)]
    path = put(tmp_path, "a.txt", log(["Date", "v", "w"], rows))
    got = {int(r.v): r.w for r in P.read_plant_log(spark, path).collect()}
    assert got == {i: "a\tb" if i % 7 == 0 else None for i in range(100)}


def test_discover(spark, tmp_path):
    for name in ("2025-01_STATISTICS.txt", "2025-02_STATISTICS.csv", "2024-01_STATISTICS.txt", "2025-03_other.txt",
                 "2025-04_STATISTICS.osf"):
        put(tmp_path, name, b"x\n")
    found = P.discover(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in found] == ["2025-01_STATISTICS.txt", "2025-02_STATISTICS.csv"]
    assert [f.rsplit("/", 1)[1] for f in P.discover(spark, str(tmp_path), "2024-")] == ["2024-01_STATISTICS.txt"]


def test_csv_export(spark, tmp_path):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ'2025-01-01 00:00:00' AS Date, 1.5D AS a, CAST(NULL AS DOUBLE) AS b, ' nan ' AS c,"
        " 'say \"hi\", you' AS d, TIMESTAMP_NTZ'2025-01-01 00:00:00' AS datetime"
    )
    export.write_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == 'Date,a,b,c,d\n2025-01-01 00:00:00,1.5,Null,Null,"say ""hi"", you"\n'


def test_tsv_export(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS DOUBLE) AS b, '' AS c, 1e-5D AS d, 'x' AS e")
    export.write_tsv(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == "a\tb\tc\td\te\n1\t\t\t1e-05\tx\n"


def test_ordered_export(spark, golden, tmp_path):
    export.write_tsv(golden.orderBy(F.rand(1)), str(tmp_path / "out"), ["datetime", "row_id"])
    parts = sorted((tmp_path / "out").glob("part-*"))
    ids = [int(x.split("\t")[0]) for p in parts for x in p.read_text().splitlines() if not x.startswith("row_id")]
    assert ids == list(range(1, 13))


def test_datasets(spark, golden):
    datasets = Datasets(spark)
    datasets.register("other", golden.withColumnRenamed("datetime", "Date"))
    datasets.register("empty", golden.limit(0))
    datasets.register(MAIN, golden)
    assert datasets.available() == [MAIN, "other"]
    assert "datetime" in datasets.get("other").columns
    with pytest.raises(KeyError):
        datasets.get("unknown")


def test_pipeline(spark, golden, tmp_path):
    datasets = Datasets(spark)
    datasets.register(MAIN, golden)
    path = str(tmp_path / "csv")
    done = pipeline.filter_and_export(datasets, MAIN, {"kpi": (10, 24)}, "1", ["ready"], csv_path=path)
    assert (done.summary.first().rows_before, done.summary.first().rows_after) == (12, 6)
    assert done.name.startswith(f"{MAIN}_exportado_")
    assert datasets.available() == [MAIN, FILTERED, done.name]
    assert datasets.get(done.name).count() == 6
    assert spark.read.option("header", True).csv(path).count() == 6


def test_pipeline_without_hits(spark, golden, tmp_path):
    datasets = Datasets(spark)
    datasets.register(MAIN, golden)
    path = tmp_path / "csv"
    done = pipeline.filter_and_export(datasets, MAIN, needle="nothing", search_columns=["kpi"], csv_path=str(path))
    assert (done.filtered, done.name, done.csv_path) == (None, None, None)
    assert done.summary.first().reduction_pct == 100.0
    assert datasets.available() == [MAIN] and not path.exists()


def test_report(spark, golden, roles, tmp_path):
    day = dt.date(2025, 3, 2)
    tables = report.report_tables(golden, roles, ["kpi", "lost"], day, day, "T", "D", efficiency_df=golden)
    report.write_report(tables, str(tmp_path / "r"))
    read = lambda name: spark.read.parquet(str(tmp_path / "r" / f"section={name}"))
    header = read("header").first()
    assert (header.records, header.days, header.kpi_count, header.kpis) == (8, 1, 2, "kpi, lost")
    assert read("efficiency").first().total_records == 8
    assert {r.kpi for r in read("statistics").collect()} == {"kpi"}
    assert [tuple(r) for r in read("errors").collect()] == [("lost", "no such column")]
    assert report.report_header(golden, ["kpi"]).first().days is None


def test_logs_to_report_roles(spark, tmp_path):
    path = put(tmp_path, "a.txt", log(HEADER, [ROW]))
    typed = P.load_logs(spark, path)
    found = resolve_roles(typed.columns, row_id=P.ROW_ID)
    assert (found.time, found.on, found.ready) == ("datetime", "X_ON", "X_READY")
    assert prepare.clean_for_export(typed).columns == ["Date", "X_ON", "X_READY", "Feed", "Feed_1", "Temp SP", "row_id"]
