import datetime as dt

import pytest
from pyspark.sql import functions as F

from plantlytics.functions import scalars as S
from plantlytics.operators import filters, prepare, stats
from plantlytics.roles import Roles


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def results(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_numbers_from_text(spark):
    texts = ["1.5", " 1e3 ", "+.5", "7.", "1d", "1f", "NaN", "inf", "", "  ", "abc", None, "0x10", "1,5", "0x1p3", "2.5D ", "1e999",
             "Infinity", "1e", ".", "-3"]
    df = column(spark, texts, "string")
    assert results(df, S.num(df, "x")) == [1.5, 1000.0, 0.5, 7.0] + [None] * 16 + [-3.0]


def test_nan_is_missing(spark):
    df = column(spark, [float("nan"), float("inf"), float("-inf"), 2.0, None], "double")
    assert results(df, S.num(df, "x")) == [None, None, None, 2.0, None]
    assert results(df, S.to01(df, "x")) == [0, 1, 0, 1, 0]
    assert filters.range_filter(df, {"x": (-1e308, 1e308)}).count() == 1
    row = stats.describe_profile(df, ["x"]).first()
    assert (row["count"], row.null_count, row["max"], row["mean"]) == (1, 4, 2.0, 2.0)


def test_to01_and_flags(spark):
    df = column(spark, [0.7, 1.0, 1.9, -3.0, 2.0, None], "double")
    assert results(df, S.to01(df, "x")) == [0, 1, 1, 0, 1, 0]
    assert results(df, S.flag_int(df, "x")) == [0, 1, 1, -3, 2, 0]
    flags = column(spark, [True, False, None], "boolean")
    assert results(flags, S.to01(flags, "x")) == [1, 0, 0]


@pytest.mark.parametrize(
    "text, micros",
    [
        ("2025-03-01 23:56:00", 0), ("2025-03-01 23:56:00.5", 500000), ("2025-03-01 23:56:00.123", 123000),
        ("2025-03-01 23:56:00.123456", 123456), ("2025-03-01 23:56:00.1234567", 123456),
        ("2025-03-01", None), ("2025-03-01T23:56:00", None), ("2025-3-1 23:56:00", None), ("x", None), ("", None),
    ],
)
def test_log_time(spark, text, micros):
    value = column(spark, [text], "string").select(S.parse_log_time(F.col("x"))).first()[0]
    assert value == (None if micros is None else dt.datetime(2025, 3, 1, 23, 56, 0, micros))


def test_lenient_time(spark):
    df = column(spark, ["2025-03-01", "2025-03-01T01:00:00", "x"], "string")
    assert results(df, S.to_datetime(F.col("x"))) == [dt.datetime(2025, 3, 1), dt.datetime(2025, 3, 1, 1), None]


def test_float_text_reads_like_python(spark):
    values = [0.0, 1.0, -2.5, 123456789.5, 1e15, 1e16, 1.5e16, 2.5e300, 1e-4, 0.00012345, 1e-5, 1.25e-7, 1e-3,
              9999999.0, 1e7, 1e22, -1e-9, 100.0, 3e-120]
    df = column(spark, values, "double")
    assert results(df, S.as_text(df, "x")) == [str(v) for v in values]


def test_time_text(spark):
    df = column(spark, [dt.datetime(2025, 1, 2, 3, 4, 5), dt.datetime(2025, 1, 2, 3, 4, 5, 500000)], "timestamp_ntz")
    assert results(df, S.as_text(df, "x")) == ["2025-01-02 03:04:05", "2025-01-02 03:04:05.500000"]


def test_null_tokens(spark):
    texts = ["", "  ", "nan", " NULL ", "nat", "None", "nano", "x", None]
    df = column(spark, texts, "string")
    assert [r.x for r in prepare.clean_null_tokens(df).orderBy("i").collect()] == [None] * 6 + ["nano", "x", None]


def hits(df, *args, **options):
    return [r.i for r in filters.text_search(df, *args, **options).orderBy("i").collect()]


def test_text_search(spark):
    df = column(spark, ["Alarm on", "no alarm", "a.b", "axb", None, "É", "x(y"], "string")
    assert hits(df, " ALARM ", ["x"]) == [0, 1]
    assert hits(df, "Alarm", ["x"], case_sensitive=True) == [0]
    assert hits(df, "a.b", ["x"]) == [2]
    assert hits(df, "a.b", ["x"], use_regex=True) == [2, 3]
    assert hits(df, "é", ["x"]) == [5]
    assert hits(df, "é", ["x"], use_regex=True) == [5]
    assert hits(df, "x(", ["x"], use_regex=True) == [6]
    assert hits(df, "", ["x"]) == list(range(7))
    assert hits(df, "z", ["unknown"]) == list(range(7))
    assert hits(df, "nan", ["x"]) == []
    assert hits(df, "nan", ["x"], null_as_text="nan") == [4]
    assert hits(df, "3", ["x", "i"]) == [3]


def test_typed_projection(spark):
    raw = spark.createDataFrame(
        [("2025-03-01 00:00:01", "1.9", "abc", "5", "7.5"), ("bad", None, "1", "x", "")],
        "Datetime string, X_ON string, X_READY string, `Feed.1` string, `Temp SP` string",
    )
    typed = prepare.typed_projection(raw)
    assert typed.columns == ["Datetime", "X_ON", "X_READY", "Feed.1", "Temp SP", "datetime"]
    assert dict(typed.dtypes)["X_ON"] == "int" and dict(typed.dtypes)["datetime"] == "timestamp_ntz"
    rows = [tuple(r) for r in typed.collect()]
    time = dt.datetime(2025, 3, 1, 0, 0, 1)
    assert rows == [(time, 1, 0, 5.0, 7.5, time), (None, 0, 1, None, None, None)]
    assert prepare.prepare(raw).count() == 1


def test_source_time_named_datetime(spark):
    raw = spark.createDataFrame([("2025-03-01 00:00:01", "1")], "datetime string, a string")
    assert prepare.typed_projection(raw).columns == ["datetime", "a"]


def test_canonical_time_replaces_a_column_of_its_name(spark):
    raw = spark.createDataFrame([("x", "2025-03-01 00:00:01")], "datetime string, Date string")
    assert prepare.typed_projection(raw.select("Date", "datetime")).columns == ["Date", "datetime"]
    row = prepare.typed_projection(raw.select("Date", "datetime")).first()
    assert row.datetime == row.Date == dt.datetime(2025, 3, 1, 0, 0, 1)


def test_silver_keeps_rows_and_prunes_days(spark, golden, tmp_path):
    path = str(tmp_path / "silver")
    prepare.write_silver(golden, path, row_id="row_id")
    back = spark.read.parquet(path)
    assert back.count() == 12
    day = filters.date_range_filter(back, dt.date(2025, 3, 2), dt.date(2025, 3, 2))
    assert day.count() == 8
    assert "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString()


def test_roles_without_row_id(golden):
    assert Roles("datetime").order == ["datetime"]


def pushed(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("PushedFilters: [")[1].split("]")[0]


def test_filters_reach_the_scan(spark, golden, tmp_path):
    path = str(tmp_path / "t")
    golden.write.parquet(path)
    df = spark.read.parquet(path)
    day = dt.date(2025, 3, 1)
    assert "GreaterThanOrEqual(datetime" in pushed(filters.date_range_filter(df, day, day))
    assert "GreaterThanOrEqual(kpi,10.0), LessThanOrEqual(kpi,24.0)" in pushed(filters.range_filter(df, {"kpi": (10, 24)}))
    assert "GreaterThanOrEqual(ready,1)" in pushed(filters.ready_filter(df, "ready"))


def test_only_needed_columns_are_read(spark, golden, tmp_path):
    path = str(tmp_path / "t")
    golden.withColumn("other", F.lit(1.0)).write.parquet(path)
    plan = stats.onoff_delta(spark.read.parquet(path), Roles("datetime", "on", "ready"), ["kpi"])
    schema = plan._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]
    assert schema.startswith("struct<on:int,ready:int,kpi:double>")
