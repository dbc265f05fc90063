"""Twelve rows worked out by hand."""

import datetime as dt

import pytest
from golden_rows import at
from pyspark.sql import functions as F

from plantlytics.operators import distribution, filters, rollup, series, states, stats
from plantlytics.roles import Roles, primary_roles, resolve_roles

CHUNKS = [1, 2, 3, 5, 1000]


def test_efficiency(golden, roles):
    row = states.state_efficiency(golden, roles).first()
    assert (row.total_records, row.on_ready, row.off_ready, row.not_ready) == (12, 3, 5, 3)
    assert row.efficiency_pct == 25.0
    assert (row.date_min, row.date_max) == (at("01 23:56"), at("02 00:06"))


def test_efficiency_without_flags_or_rows(golden, roles):
    row = states.state_efficiency(golden.drop("ready"), roles).first()
    assert (row.total_records, row.on_ready, row.off_ready, row.not_ready, row.efficiency_pct) == (12, 0, 0, 0, 0.0)
    row = states.state_efficiency(golden.limit(0), roles).first()
    assert (row.total_records, row.date_min, row.efficiency_pct) == (0, None, 0.0)


def test_shares(golden, roles):
    shares = [round(r.share_pct, 6) for r in states.state_shares(golden, roles).collect()]
    assert shares == [27.272727, 45.454545, 27.272727]


@pytest.mark.parametrize("rows", CHUNKS)
def test_status_runs(golden, roles, rows):
    runs = states.status_runs(golden, roles, rows).orderBy("block").collect()
    assert [(r.block, r.status, r.x0, r.x1, r.n) for r in runs] == [
        (1, 2, at("01 23:56"), at("01 23:57"), 2),
        (2, 1, at("01 23:58"), at("02 00:00"), 3),
        (3, 2, at("02 00:01"), at("02 00:02"), 1),
        (4, 0, at("02 00:02"), at("02 00:03"), 2),
        (5, 2, at("02 00:04"), at("02 00:05"), 1),
        (6, 0, at("02 00:05"), at("02 00:06"), 1),
        (7, 1, at("02 00:06"), at("02 00:07"), 2),
    ]


@pytest.mark.parametrize("rows", CHUNKS)
def test_state_blocks(golden, roles, rows):
    blocks = states.state_blocks(golden, roles, ["kpi"], rows).orderBy("row_id").collect()
    assert {r.row_id: r.block for r in blocks} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 9: 3, 10: 3, 11: 4, 12: 4}


@pytest.mark.parametrize("rows", CHUNKS)
def test_block_points(golden, roles, rows):
    points = states.block_points(golden, roles, ["kpi"], rows).collect()
    own = {(1, 1), (1, 2), (2, 3), (2, 4), (2, 5), (3, 9), (3, 10), (4, 11), (4, 12)}
    assert {(p.block, p.row_id) for p in points} == own | {(2, 2), (3, 5), (4, 10)}
    assert len(points) == 12
    assert {(p.block, p.block_state) for p in points} == {(1, 1), (2, 0), (3, 1), (4, 0)}


def test_onoff_stats(golden, roles):
    off, on = stats.onoff_stats(golden, roles, ["kpi"]).orderBy("on").collect()
    assert (off.n, off.valid_n, off.mean, off["min"], off.q1, off.median, off.q3, off["max"]) == (
        5, 4, 23.0, 20.0, 21.5, 23.0, 24.5, 26.0)
    assert off.std == pytest.approx(2.581988897, abs=1e-9)
    assert (on.n, on.valid_n, on.mean, on["min"], on.q1, on.median, on.q3, on["max"]) == (
        4, 4, 31.5, 10.0, 11.5, 13.0, 33.0, 90.0)
    assert on.std == pytest.approx(39.034173062, abs=1e-9)


def test_absent_state_and_empty_kpi(golden, roles):
    df = golden.where("on = 0").withColumn("gone", F.lit(None).cast("double"))
    rows = {(r.kpi, r.on): r for r in stats.onoff_stats(df, roles, ["kpi", "gone"]).collect()}
    assert len(rows) == 4
    assert (rows["kpi", 1].n, rows["kpi", 1].valid_n, rows["kpi", 1].mean) == (0, 0, None)
    assert (rows["gone", 0].n, rows["gone", 0].valid_n, rows["gone", 0].median) == (5, 0, None)
    compact = stats.onoff_stats_compact(df, roles, ["kpi", "gone"]).collect()
    assert {(r.kpi, r.on) for r in compact} == {("kpi", 0), ("gone", 0)}
    box = {(r.kpi, r.on): r for r in stats.box_summary(df, roles, ["kpi"]).collect()}
    assert (box["kpi", 1].n, box["kpi", 1].median, box["kpi", 1].outliers) == (0, None, 0)


def test_delta(golden, roles):
    row = stats.onoff_delta(golden, roles, ["kpi"]).first()
    assert row.delta == 8.5
    assert row.delta_pct == pytest.approx(36.956522, abs=1e-6)
    assert row.delta_text == "+8.50 (+36.96%)"
    row = stats.onoff_delta(golden.withColumn("kpi", F.col("on") * 1.0), roles, ["kpi"]).first()
    assert (row.delta, row.delta_pct, row.delta_text) == (1.25, None, "N/A")


def test_box(golden, roles):
    off, on = stats.box_summary(golden, roles, ["kpi"]).orderBy("on").collect()
    assert (off.n, off.whisker_lo, off.whisker_hi, off.outliers) == (5, 20.0, 26.0, 0)
    assert (on.n, on.whisker_lo, on.whisker_hi, on.outliers) == (4, 10.0, 14.0, 1)
    outliers = stats.box_outliers(golden, roles, ["kpi"]).collect()
    assert [(r.row_id, r.on, r.value) for r in outliers] == [(10, 1, 90.0)]


def test_means(golden, roles):
    rows = stats.onoff_means(golden, roles, ["kpi"]).orderBy("on").collect()
    assert [(r.on, r["mean"], r.t_min, r.t_max) for r in rows] == [
        (0, 23.0, at("01 23:56"), at("02 00:06")), (1, 31.5, at("01 23:56"), at("02 00:06"))]


def test_density(golden, roles):
    curves = distribution.kde_counts(golden, roles, ["kpi"]).collect()
    y = {(r.on, r.i): r.y for r in curves}
    assert len(y) == 600
    assert sum(v for (on, _), v in y.items() if on == 0) == pytest.approx(3.986667, abs=1e-6)
    assert sum(v for (on, _), v in y.items() if on == 1) == pytest.approx(2.065105, abs=1e-6)
    assert [y[1, i] for i in (0, 150, 299)] == pytest.approx([0.010841, 0.006155, 0.003933], abs=1e-6)
    x = {r.i: r.x for r in curves}
    assert (x[0], x[299]) == pytest.approx((10.0, 90.0))


def test_binned_density_is_close(golden, roles):
    exact = {(r.on, r.i): r.y for r in distribution.kde_counts(golden, roles, ["kpi"]).collect()}
    binned = {(r.on, r.i): r.y for r in distribution.kde_counts(golden, roles, ["kpi"], method="binned").collect()}
    assert binned.keys() == exact.keys()
    assert max(abs(binned[k] - exact[k]) for k in exact) < 1e-5


def test_density_scaled_to_rows(golden, roles):
    exact = {(r.on, r.i): r.y for r in distribution.kde_counts(golden, roles, ["kpi"]).collect()}
    rows = {(r.on, r.i): r.y for r in distribution.kde_counts(golden, roles, ["kpi"], scale="rows").collect()}
    assert rows[0, 10] == pytest.approx(exact[0, 10] * 5 / 4)
    assert rows[1, 10] == pytest.approx(exact[1, 10])


def test_bars_for_states_without_curve(golden, roles):
    df = golden.withColumn("kpi", F.expr("CASE WHEN on = 0 THEN 7.0D ELSE kpi END"))
    rows = distribution.distribution(df, roles, ["kpi"]).collect()
    bars = [(r.on, r.i, r.x, r.y) for r in rows if r["shape"] == "bars"]
    assert bars == [(0, 1, 7.0, 5.0)]
    assert {r.on for r in rows if r["shape"] == "curve"} == {1}
    flat = golden.withColumn("kpi", F.lit(3.0))
    assert [(r.on, r.bin, r.n) for r in distribution.histogram_counts(flat, roles, ["kpi"]).orderBy("on").collect()] == [
        (0, 1, 5), (1, 1, 4)]


def test_histogram_counts_every_value(golden, roles):
    bars = distribution.histogram_counts(golden, roles, ["kpi"]).collect()
    assert sum(r.n for r in bars) == 8
    assert max(r.bin for r in bars) == 40


def test_width_and_period(golden):
    assert rollup.bucket_width(golden).first().width_seconds == 60
    row = stats.period_summary(golden, "datetime").first()
    assert (row.first_day, row.last_day, row.days, row.records) == (dt.date(2025, 3, 1), dt.date(2025, 3, 2), 2, 12)
    assert stats.period_summary(golden, None).first().days is None


@pytest.mark.parametrize("days, width", [(61, 3600), (60, 900), (11, 900), (10, 300), (3, 300), (2, 60)])
def test_width_by_span(spark, days, width):
    df = spark.sql(f"SELECT explode(array(TIMESTAMP_NTZ'2025-01-01', TIMESTAMP_NTZ'2025-01-01' + INTERVAL {days} DAY)) datetime")
    assert rollup.bucket_width(df).first().width_seconds == width


def test_ohlc(golden, roles):
    rows = rollup.bucket_ohlc(golden, roles, "kpi", ["row_id"], 300).orderBy("datetime").collect()
    assert [(r.datetime, r.open, r.high, r.low, r.close, r.on, r.ready, r.row_id) for r in rows] == [
        (at("01 23:55"), 10.0, 20.0, 10.0, None, 1, 1, 2.5),
        (at("02 00:00"), 22.0, 22.0, 5.0, 14.0, 1, 1, 7.0),
        (at("02 00:05"), 90.0, 90.0, 24.0, 26.0, 2, 1, 11.0),
    ]


def test_binary_signals(golden):
    df = golden.withColumn("none_sp", F.lit(None).cast("double"))
    rows = stats.binary_signal_profile(df, ["on", "ready", "kpi", "none_sp"]).collect()
    assert {r.kpi: (r.is_binary, r.category) for r in rows} == {
        "on": (False, "Proceso"), "ready": (True, "Proceso"), "kpi": (False, "Proceso"), "none_sp": (False, "Control")}


def test_date_filter(golden):
    kept = filters.date_range_filter(golden, dt.date(2025, 3, 1), dt.date(2025, 3, 1)).collect()
    assert [r.row_id for r in kept] == [1, 2, 3, 4]
    assert filters.date_range_filter(golden, dt.date(2025, 3, 1), dt.date(2025, 3, 1), "missing").count() == 12


def ids(df):
    return sorted(r.row_id for r in df.collect())


def test_range_filters(golden):
    assert ids(filters.range_filter(golden, {"kpi": (10, 24), "x": (0, 0)})) == [1, 2, 3, 5, 6, 9, 11]
    assert len(ids(filters.range_filter(golden, {}))) == 12
    assert len(ids(filters.clamped_range_filter(golden, {"kpi": (5, 90)}))) == 12
    assert len(ids(filters.clamped_range_filter(golden, {"kpi": (-1, 1e9)}))) == 12
    assert ids(filters.clamped_range_filter(golden, {"kpi": (60, 24)})) == [11]


def test_clamp():
    bounds = {"a": (0.0, 10.0)}
    clamp = filters.clamp_ranges
    assert clamp(bounds, {"a": (-5, 20), "b": (0, 1)}) == {}
    assert clamp(bounds, {"a": (2, 20)}) == {"a": (2, 10.0)}
    assert clamp(bounds, {"a": (8, 3)}) == {"a": (3, 3)}
    assert clamp(bounds, {"a": (20, 30)}) == {"a": (10.0, 10.0)}
    once = clamp(bounds, {"a": (-1, 4)})
    assert clamp(bounds, once) == once


def test_ready_filter_and_summary(golden):
    assert ids(filters.ready_filter(golden, "ready")) == [1, 2, 3, 4, 5, 9, 10, 11, 12]
    assert len(ids(filters.ready_filter(golden, None))) == 12
    row = filters.filter_summary(golden, filters.range_predicate(golden, {"kpi": (10, 24)})).first()
    assert (row.rows_before, row.rows_after, round(row.reduction_pct, 6)) == (12, 7, 41.666667)
    assert filters.filter_summary(golden.limit(0), F.lit(True)).first().reduction_pct == 0.0


def test_preview(golden, roles):
    assert [r.row_id for r in filters.preview(golden, roles, 3).collect()] == [1, 2, 3]


def test_series(golden, roles):
    rows = series.series_extract(golden, roles, ["kpi", "on", "missing", "ready"], {"ready"}).collect()
    assert {r.kpi for r in rows} == {"kpi", "ready"}
    assert len(rows) == 24
    fractions = golden.withColumn("f", F.expr("CASE row_id WHEN 1 THEN NULL WHEN 2 THEN 0.4 WHEN 3 THEN 1.7 ELSE -2 END"))
    values = {r.row_id: r.value for r in series.series_extract(fractions, roles, ["f"], {"f"}).collect()}
    assert (values[1], values[2], values[3], values[4]) == (0.0, 0.4, 1.0, 0.0)
    split = series.series_split(golden, roles, ["kpi"]).collect()
    assert len(split) == 9 and {r.on for r in split if r.row_id == 10} == {1}


def test_padded_range(golden):
    row = stats.padded_range(golden, ["kpi", "ready"]).first()
    assert (row.y_min, row.y_max) == (-9.0, 99.0)
    assert stats.padded_range(golden.withColumn("kpi", F.lit(1.0)), ["kpi"]).count() == 0


def test_units_are_separate(golden, roles):
    two = golden.withColumn("unit", F.lit("a")).unionAll(golden.withColumn("unit", F.lit("b")))
    by_unit = Roles("datetime", "on", "ready", "row_id", "unit")
    for rows in (2, 1000):
        runs = states.status_runs(two, by_unit, rows).collect()
        assert sorted((r.unit, r.block) for r in runs) == [(u, b) for u in "ab" for b in range(1, 8)]


def test_time_as_text(golden, roles):
    text = golden.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))
    broken = text.unionAll(text.limit(1).withColumn("datetime", F.lit("soon")))
    runs = states.status_runs(broken, roles, 3).orderBy("block").collect()
    assert [(r.status, r.n) for r in runs] == [(2, 2), (1, 3), (2, 1), (0, 2), (2, 1), (0, 1), (1, 2)]
    assert states.state_blocks(broken, roles, ["kpi"], 3).count() == 9
    assert filters.date_range_filter(broken, dt.date(2025, 3, 1), dt.date(2025, 3, 1)).count() == 4
    assert stats.period_summary(broken, "datetime").first().days == 2


def test_tables_without_readiness(golden):
    bare = golden.select("row_id", "datetime", F.col("on").alias("X_ON"), "kpi")
    found = resolve_roles(bare.columns, row_id="row_id")
    assert (found.on, found.ready) == ("X_ON", None)
    assert states.status_runs(bare, found).count() == 0
    assert states.state_blocks(bare, found, ["kpi"]).agg(F.max("block")).first()[0] == 6
    off, on = stats.onoff_stats(bare, found, ["kpi"]).orderBy("on").collect()
    assert (off.n, on.n) == (7, 5)
    named = golden.withColumnRenamed("ready", "Ready")
    assert resolve_roles(named.columns).ready == "Ready"
    counts = states.state_efficiency(named, primary_roles(named.columns)).first()
    assert (counts.total_records, counts.on_ready, counts.not_ready) == (12, 0, 0)
