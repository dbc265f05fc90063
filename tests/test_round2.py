"""Input that the first queries did not hold."""

import warnings

import pytest

from plantlytics import roles as R
from plantlytics.functions import scalars as S
from plantlytics.operators import filters, prepare, states, stats
from plantlytics.roles import Roles


def test_numbers_end_at_control_characters(spark):
    df = spark.createDataFrame([(x,) for x in ("1d\t", "1f\n", "2d\r", "2D\x7f", " 3.5\t", "4")], "x string")
    assert [r.v for r in df.select(S.text_to_num(df.x).alias("v")).collect()] == [None, None, None, None, 3.5, 4.0]


def test_only_a_pair_of_flags_is_converted(spark):
    raw = spark.createDataFrame([("2025-03-01 10:00:00", "0.7", "1")], "Date string, VALVE_ON string, kpi string")
    assert prepare.typed_projection(raw).first().VALVE_ON == 0.7
    two = spark.createDataFrame([("2025-03-01 10:00:00", "1", "1", "0.5", "1")], "Date string, A_ON string, A_READY string, PUMP_ON string, PUMP_READY string")
    assert prepare.typed_projection(two).first().PUMP_ON == 0.5
    assert prepare.typed_projection(two, "A").schema["A_ON"].dataType.simpleString() == "int"


def test_datetime_stays_beside_its_namesake(spark):
    df = spark.sql("SELECT 1 AS Datetime, 2 AS datetime")
    assert R.drop_duplicate_time(df).columns == ["Datetime", "datetime"]


def test_named_groups(spark):
    df = spark.createDataFrame([("xc1c1",), ("c2",)], "t string")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert filters.text_search(df, r"(?P<a_n>c\d)(?P=a_n)", ["t"], use_regex=True).count() == 1
    with pytest.warns(UserWarning, match="literally"):
        assert filters.text_search(df, "c(", ["t"], use_regex=True).count() == 0


def test_no_on_flag_gives_empty_results(golden):
    roles = Roles("datetime", None, "ready", "row_id")
    assert states.status_timeline(golden, roles).count() == 0
    assert states.status_runs(golden, roles).count() == 0
    assert states.state_blocks(golden, roles, ["kpi"]).count() == 0
    assert stats.onoff_stats(golden, roles, ["kpi"]).agg({"n": "sum"}).first()[0] == 0
    assert filters.preview(golden, Roles("datetime", row_id="row_id"), 5000).count() == 12
