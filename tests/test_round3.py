"""Reports that survive failures, kernels that end, times of several forms, one scan where one is enough."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plantlytics.functions import scalars as S
from plantlytics.operators import distribution, filters, prepare, stats
from plantlytics.plans import pipeline, report
from plantlytics.roles import Roles
from plantlytics.sources.datasets import MAIN, Datasets

DAY = dt.date(2025, 3, 2)


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_failing_kpi_is_listed_and_the_others_are_as_without_it(spark, golden, roles, tmp_path):
    bad = golden.withColumn("broken", F.expr("CASE WHEN row_id = 5 THEN raise_error('no signal') ELSE kpi END").cast("double"))
    tables = report.report_tables(bad, roles, ["broken", "kpi", "lost"], DAY, DAY)
    errors = {r.kpi: r.error for r in tables["errors"].collect()}
    assert errors.keys() == {"broken", "lost"} and "no signal" in errors["broken"] and errors["lost"] == "no such column"
    alone = report.report_tables(golden, roles, ["kpi"], DAY, DAY)
    assert alone.keys() == tables.keys() - {"errors"}
    for section in alone.keys() - {"header"}:
        assert rows(tables[section]) == rows(alone[section]), section
    with pytest.raises(Exception, match="nothing works"):
        report.report_tables(golden.where(F.raise_error(F.lit("nothing works")).cast("boolean")), roles, ["kpi"])


def test_a_failing_section_leaves_the_others(spark, golden, roles, tmp_path):
    tables = report.report_tables(golden, roles, ["kpi"])
    tables["means"] = tables["means"].withColumn("mean", F.raise_error(F.lit("disk full")).cast("double"))
    outcomes = report.write_report(tables, str(tmp_path / "r"))
    assert {s for s, e in outcomes.items() if e} == {"means"} and "disk full" in outcomes["means"]
    told = {r.section: (r.written, r.error) for r in spark.read.parquet(str(tmp_path / "r" / "section=outcomes")).collect()}
    assert told == {s: (e is None, e) for s, e in outcomes.items()}
    for section in tables.keys() - {"means"}:
        assert spark.read.parquet(str(tmp_path / "r" / f"section={section}")).count() >= 0
    assert not (tmp_path / "r" / "section=means" / "_SUCCESS").exists()


def test_sections_read_the_prepared_set(spark, golden, roles, tmp_path):
    """Once the tables are there, none of them reads the source."""
    golden.write.parquet(str(tmp_path / "thesource"))
    tables = report.report_tables(spark.read.parquet(str(tmp_path / "thesource")), roles, ["kpi"], DAY, DAY)
    assert not [s for s, t in tables.items() if "thesource" in t._jdf.queryExecution().toString()]


@pytest.mark.parametrize("shape", ["golden", "one state", "empty", "no flag", "flat"])
def test_compared_states_are_the_single_tables(golden, roles, shape):
    df = golden.withColumn("gone", F.lit(None).cast("double")).withColumn("two", F.col("kpi") * 2)
    df = {"one state": df.where("on = 0"), "empty": df.limit(0), "flat": df.withColumn("kpi", F.lit(3.0))}.get(shape, df)
    own = Roles("datetime", None if shape == "no flag" else "on", "ready", "row_id")
    kpis = ["kpi", "gone", "two"]
    got = stats.compare_states(df, own, kpis)
    for mine, single in ((got.statistics, stats.onoff_stats), (got.box, stats.box_summary), (got.outliers, stats.box_outliers),
                         (got.means, stats.onoff_means), (got.delta, stats.onoff_delta)):
        assert rows(mine.select(*single(df, own, kpis).columns)) == rows(single(df, own, kpis))
    curves = distribution.distribution(df, own, kpis, states=got.groups, all_curved=got.all_curved)
    assert rows(curves) == rows(distribution.distribution(df, own, kpis))


def test_report_header_counts_ready_records(golden):
    row = report.report_header(golden, ["kpi"], ready="ready").first()
    assert (row.records, row.ready_records) == (12, 9)
    assert report.report_header(golden, ["kpi"], ready="missing").first().ready_records == 12


def test_kernels_end_where_they_change_nothing(spark, monkeypatch):
    """Only values near a point are added up, and the sums are those of all."""
    df = spark.range(60_000).select(F.lit(1).alias("on"), F.lit(1).alias("ready"), F.expr("CASE WHEN id = 3 THEN 400 ELSE randn(5) END").alias("v")).cache()
    roles = Roles("t", "on", "ready")
    near = {r.i: r.y for r in distribution.kde_counts(df, roles, ["v"]).collect()}
    monkeypatch.setattr(distribution, "NEGLECTED", 1e-300)
    far = {r.i: r.y for r in distribution.kde_counts(df, roles, ["v"]).collect()}
    assert near.keys() == far.keys() and max(abs(near[i] - far[i]) for i in far) < 1e-9
    assert sum(near.values()) > 1000


def test_times_by_formats(spark):
    texts = ["13/02/2024 10:11:12", "03/02/2024", " 3/2/2024 7:05 ", "2024-02-03 04:05:06.7", "31/02/2024", "02/13/2024", "soon", "", None, "13-02-2024 1:02:03.25", "13/02/2024 10:11:12 x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, when string")
    at = dt.datetime
    want = [at(2024, 2, 13, 10, 11, 12), at(2024, 2, 3), at(2024, 2, 3, 7, 5), at(2024, 2, 3, 4, 5, 6, 700000), None, None, None, None, None, at(2024, 2, 13, 1, 2, 3, 250000), None]
    assert [r.when for r in prepare.parse_times(df, "when", [*S.DAY_FIRST, S.ISO]).orderBy("i").collect()] == want
    month_first = prepare.parse_times(df, "when", ["M/d/yyyy", *S.DAY_FIRST]).orderBy("i").collect()
    assert (month_first[1].when, month_first[5].when, month_first[3].when) == (at(2024, 3, 2), at(2024, 2, 13), None)
    audit = prepare.time_audit(df, "when", [*S.DAY_FIRST, S.ISO]).first()
    assert (audit.readable, audit.missing, audit.unreadable) == (5, 2, 4)
    plain = prepare.time_audit(df, "when").first()
    assert plain.readable + plain.missing + plain.unreadable == len(texts)


def test_a_date_filter_without_time_column_warns(golden):
    with pytest.warns(UserWarning, match="no time column"):
        assert filters.date_range_filter(golden, DAY, DAY, "missing").count() == 12


def test_counts_are_observed_by_the_write(spark, golden, tmp_path, monkeypatch):
    """The source is read for the bounds and for the write; the summary holds no scan."""
    golden.write.parquet(str(tmp_path / "thesource"))
    datasets = Datasets(spark)
    datasets.register(MAIN, spark.read.parquet(str(tmp_path / "thesource")))
    done = pipeline.filter_and_export(datasets, MAIN, {"kpi": (10, 24)}, "1", ["ready"], csv_path=str(tmp_path / "csv"))
    assert "thesource" not in done.summary._jdf.queryExecution().toString()
    assert tuple(done.summary.first()) == (12, 6, 50.0)


def test_sorted_files_split_a_hot_instant_without_row_id(spark, tmp_path):
    df = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("2025-01-01")).otherwise(F.date_add(F.lit("2025-01-01"), (F.col("id") % 50).cast("int"))).cast("timestamp_ntz").alias("datetime"),
        F.rand(3).alias("kpi"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # the table is small enough for one file
    try:
        prepare.write_silver(df, str(tmp_path / "s"))
    finally:
        spark.conf.unset(key)
    back = spark.read.parquet(str(tmp_path / "s"))
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 2 * 40_000 / 8


def test_approximate_quartiles_are_an_option(spark, golden, roles):
    df = spark.range(50_000).select(F.lit(1).alias("on"), F.lit(1).alias("ready"), F.rand(2).alias("v"), F.lit(None).cast("double").alias("none"))
    own = Roles("t", "on", "ready")
    near = stats.onoff_quartiles(df, own, ["v", "none"], "approximate").collect()
    assert [(r.kpi, r.on) for r in near] == [("v", 1)]
    assert (near[0].q1, near[0].median, near[0].q3) == pytest.approx((0.25, 0.5, 0.75), abs=0.01)
    told = {r.kpi: r for r in stats.describe_profile(df, ["v", "none"], "approximate").collect()}
    assert told["v"].median == pytest.approx(0.5, abs=0.01) and told["none"].median is None
    assert stats.onoff_stats(golden, roles, ["kpi"], stats.onoff_quartiles(golden, roles, ["kpi"], "approximate")).count() == 2
    with pytest.raises(ValueError, match="unknown method"):
        stats.onoff_quartiles(df, own, ["v"], "rough")


def test_empty_and_flagless_tables_give_reports(spark, golden, roles, tmp_path):
    for name, df, own in (("empty", golden.limit(0), roles), ("bare", golden, Roles("datetime", None, None, "row_id")), ("never", golden.where("ready = 5"), roles)):
        tables = report.report_tables(df, own, ["kpi"], DAY, DAY)
        assert set(report.write_report(tables, str(tmp_path / name)).values()) == {None}
        assert tables["series"].count() == 0 and tables["outliers"].count() == 0 and tables["distribution"].count() == 0
    datasets = Datasets(spark)
    datasets.register(MAIN, golden.limit(0))
    done = pipeline.filter_and_export(datasets, MAIN, {"kpi": (1, 2)}, "1", ["ready"], csv_path=str(tmp_path / "csv"))
    assert tuple(done.summary.first()) == (0, 0, 0.0) and done.filtered is None
