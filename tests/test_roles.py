import pytest
from pyspark.sql import types as T

from plantlytics import roles as R


def test_unique_names():
    assert R.unique_names(["A", "A", "A_1"]) == ["A", "A_1", "A_1_1"]
    assert R.unique_names(["A", "A_1", "A"]) == ["A", "A_1", "A_2"]
    assert R.unique_names([]) == []
    assert R.parse_header(" Date\tFeed\tFeed\t Temp SP \r") == ["Date", "Feed", "Feed_1", "Temp SP"]


def test_time_columns():
    assert R.load_time_column(["a", "Fecha", "time"]) == "Fecha"
    with pytest.raises(ValueError):
        R.load_time_column(["update_date"])
    assert R.analysis_time_column(["update_date", "datetime"]) == "datetime"
    assert R.analysis_time_column(["a", "update_date"]) == "update_date"
    assert R.analysis_time_column(["a"]) is None


def test_flags():
    assert R.primary_flags(["X_ON", "X_READY", "P_ON"]) == ("X_ON", "X_READY")
    assert R.primary_flags(["X_ON"]) == ("X_ON", None)
    assert R.primary_flags(["a"]) == (None, None)
    with pytest.raises(ValueError):
        R.primary_flags(["X_ON", "X_READY", "Y_ON", "Y_READY"])
    assert R.primary_flags(["X_ON", "X_READY", "Y_ON", "Y_READY"], "Y") == ("Y_ON", "Y_READY")
    assert R.ready_column(["Ready", "Flag_Ready"]) == "Flag_Ready"
    assert R.ready_column(["Flag_Ready", "X_READY"]) == "X_READY"
    assert R.ready_column(["a"]) is None
    assert R.on_column(["a", "concentration"]) == "concentration"
    assert R.on_column(["concentration", "X_ON", "X_READY"]) == "X_ON"
    assert R.resolve_roles(["datetime", "X_ON", "X_READY"], row_id="r") == R.Roles(
        "datetime", "X_ON", "X_READY", "r")


def test_schema_rules():
    schema = T.StructType().add("datetime", T.TimestampNTZType()).add("X_ON", T.IntegerType())
    schema = schema.add("kpi", T.DoubleType()).add("name", T.StringType())
    assert R.numeric_columns(schema) == ["X_ON", "kpi"]
    assert R.kpi_candidates(schema, R.Roles("datetime", "X_ON")) == ["kpi"]
    assert R.signal_category("Temp_SP") == "Control"
    assert R.signal_category("Feed") == "Proceso"
    assert R.search_scope(["a", "b"]) == ["a", "b"]
    assert R.search_scope(["a", "b"], "numeric", ["b"]) == ["b"]
    assert R.search_scope(["a", "b"], "numeric") == ["a", "b"]
    assert R.search_scope(["a", "b"], "explicit", explicit=["a"]) == ["a"]


def test_time_column_renaming(spark):
    df = spark.sql("SELECT 1 AS Date, 2 AS b")
    assert R.rename_date_column(df).columns == ["datetime", "b"]
    both = spark.sql("SELECT 1 AS Date, 2 AS datetime")
    assert R.rename_date_column(both).columns == ["Date", "datetime"]
    assert R.drop_duplicate_time(both).columns == ["Date"]
    assert R.drop_duplicate_time(spark.sql("SELECT 1 AS datetime")).columns == ["datetime"]
