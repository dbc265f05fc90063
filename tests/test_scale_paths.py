"""The ways large tables take, against plain Spark on small ones."""

import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from plantlytics.operators import distribution, ordering, quantiles, rollup, states
from plantlytics.operators.ordering import CHUNK
from plantlytics.roles import Roles

PROBS, NAMES = (0.25, 0.5, 0.75), ("q1", "median", "q3")


def exact(df):
    got = quantiles.quantiles(df, ["g"], "v", PROBS, NAMES).collect()
    return {r.g: (r.q1, r.median, r.q3) for r in got}


def assert_same(df):
    want = df.where("v IS NOT NULL").groupBy("g").agg(F.percentile("v", list(PROBS)).alias("q")).collect()
    got = exact(df)
    assert got.keys() == {r.g for r in want}
    for r in want:
        assert got[r.g] == pytest.approx(tuple(r.q), rel=1e-12, abs=1e-300)


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, v double")


def test_quantiles_of_uneven_groups(spark):
    rng = random.Random(3)
    rows = [("glitch", rng.gauss(50, 1)) for _ in range(2000)] + [("glitch", 1e300), ("glitch", -1e12)]
    rows += [("ties", float(rng.randint(0, 3))) for _ in range(3000)]
    rows += [("one", 4.5), ("same", 2.0), ("same", 2.0), ("gap", 1.0), ("gap", 2.0), ("gap", None), ("none", None)]
    rows += [("wide", s * 10.0**e) for e in range(-300, 308, 7) for s in (1, -1)]
    rows += [("tiny", k * 5e-324) for k in range(9)]
    rows += [("ends", -1.7e308), ("ends", 1.7e308), ("ends", 3.0), ("ends", 3.5), ("ends", -2.0)]
    assert_same(frame(spark, rows))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=1, max_size=60))
def test_quantiles_of_any_floats(spark, values):
    values = [v for v in values if abs(v) < 1e300] or [0.0]
    assert_same(frame(spark, [("g", v) for v in values]))


def test_quantile_pass_shuffles_no_rows(spark):
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.rand(5).alias("v"))
    assert_same(df)


@pytest.mark.parametrize("spread", [1, 300])
def test_quantiles_take_three_scans_at_most(spark, spread, monkeypatch):
    rng = random.Random(4)
    rows = [("g", rng.choice([-1, 1]) * 10.0 ** rng.uniform(-spread, spread)) for _ in range(20_000)]
    counted, scans = quantiles._counted, []
    monkeypatch.setattr(quantiles, "_counted", lambda *a: scans.append(1) or counted(*a))
    one = exact(frame(spark, rows))
    assert len(scans) <= 3
    assert exact(frame(spark, rows).repartition(7)) == one
    assert_same(frame(spark, rows))


def scans_of(monkeypatch):
    """Names of the scans that quantiles make."""
    made = []
    for name in ("_sketched", "_narrowed", "_exact"):
        real = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda *a, real=real, name=name: made.append(name) or real(*a))
    return made


def narrow_signal(spark, n):
    """All in one part in a thousand, with ties, a far outlier and few missing values."""
    return spark.range(n).select(F.lit("g").alias("g"), F.expr(
        "CASE WHEN id % 1000 = 7 THEN NULL WHEN id = 5 THEN 1e18 WHEN id % 10 = 3 THEN 20.01 ELSE 20 + 0.02 * rand(4) END").alias("v"))


def test_quantiles_take_two_scans_and_shuffle_few_values(spark, monkeypatch):
    scans, cells, counted = scans_of(monkeypatch), [], quantiles._counted
    monkeypatch.setattr(quantiles, "_counted", lambda *a: cells.append(counted(*a)) or cells[-1])
    df = narrow_signal(spark, 300_000).cache()
    assert_same(df)
    assert scans == ["_sketched", "_exact"]
    assert cells[0].count() < 300_000 * 3 * 8 / quantiles.ACCURACY
    df.unpersist()


def test_wide_brackets_are_sketched_again(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 20)
    scans = scans_of(monkeypatch)
    assert_same(narrow_signal(spark, 100_000).cache())
    assert scans[0] == "_sketched" and "_narrowed" in scans and scans[-1] == "_exact"


def test_a_rank_outside_its_bracket_is_found(spark, monkeypatch):
    """Whatever the sketch says, the counts decide."""
    real = quantiles._sketched

    def wrong(*a):
        totals, spans = real(*a)
        return totals, [quantiles.replace(s, lo=s.lo + 1, hi=s.hi + 1) for s in spans]

    monkeypatch.setattr(quantiles, "_sketched", wrong)
    assert_same(spark.range(30_000).select(F.lit("g").alias("g"), F.rand(3).alias("v")).cache())


def telemetry(spark, rows):
    return spark.createDataFrame(rows, "row_id long, t timestamp_ntz, on int, ready int")


def random_rows(seed, n, hot_share=0.4, instants=50):
    import datetime as dt

    rng = random.Random(seed)
    base = dt.datetime(2025, 1, 1)
    ids = list(range(n))
    rng.shuffle(ids)
    return [
        (i, base + dt.timedelta(minutes=7 if rng.random() < hot_share else rng.randint(0, instants)),
         rng.choice([0, 0, 1, 2]), rng.choice([0, 1, 1]))
        for i in ids
    ]


ROLES = Roles("t", "on", "ready", "row_id")


def plain_runs(df):
    w = Window.orderBy("t", "row_id")
    s = df.select("t", "row_id", states.status(df, ROLES).alias("status"))
    s = s.withColumn("c", F.coalesce((F.lag("status").over(w) != F.col("status")).cast("int"), F.lit(1)))
    s = s.withColumn("block", F.sum("c").over(w))
    return sorted(
        (r.block, r.status, r.x0, r.n)
        for r in s.groupBy("block").agg(F.max("status").alias("status"), F.min("t").alias("x0"), F.count("*").alias("n")).collect()
    )


@pytest.mark.parametrize("rows_per_chunk", [7, 40, 300, 10_000])
@pytest.mark.parametrize("hot_share", [0.0, 0.4, 1.0])
def test_runs_match_one_big_window(spark, rows_per_chunk, hot_share):
    df = telemetry(spark, random_rows(rows_per_chunk, 1200, hot_share))
    got = states.status_runs(df, ROLES, rows_per_chunk).collect()
    assert sorted((r.block, r.status, r.x0, r.n) for r in got) == plain_runs(df)
    assert sum(r.n for r in got) == 1200
    ordered = sorted(got, key=lambda r: r.block)
    assert all(a.status != b.status for a, b in zip(ordered, ordered[1:]))


def chunked(df, roles, rows_per_chunk):
    weighed, order = ordering.time_order(df, roles)
    return ordering.in_order(weighed, order, rows_per_chunk).withColumn(CHUNK, F.spark_partition_id())


def test_hot_instant_is_split(spark):
    df = telemetry(spark, random_rows(1, 4000, 0.5))
    rows = chunked(df, ROLES, 100).select(CHUNK, "t", "row_id").collect()
    sizes = Counter(r[CHUNK] for r in rows)
    assert len(sizes) > 30 and max(sizes.values()) < 400
    order = [(r.t, r.row_id) for r in sorted(rows, key=lambda r: (r[CHUNK], r.t, r.row_id))]
    assert order == sorted(order)


def test_chunks_follow_the_rows(spark):
    df = telemetry(spark, random_rows(2, 1000, 0.0, 400))
    small, many = (chunked(df, ROLES, n).select(CHUNK).distinct().count() for n in (100, 10))
    assert small <= 11 and many > 50


def test_hot_instant_without_row_ids_is_split(spark):
    """Rows of one time follow their content; rows that agree in everything count as one."""
    df = telemetry(spark, random_rows(1, 4000, 0.5)).withColumn("kpi", F.col("row_id") * 0.5)
    roles = Roles("t", "on", "ready")
    sizes = Counter(r[CHUNK] for r in chunked(df.drop("row_id"), roles, 100).select(CHUNK).collect())
    assert len(sizes) > 30 and max(sizes.values()) < 400
    blocks = states.state_blocks(df.drop("row_id"), roles, ["kpi"], 100)
    assert blocks.count() == df.where("ready = 1").count()
    bare = df.select("t", "on", "ready")
    assert sum(r.n for r in states.status_runs(bare, roles, 50).collect()) == 4000
    again = states.state_blocks(bare, roles, [], 50).collect()
    assert len(again) == df.where("ready = 1").count()
    points = states.block_points(bare, roles, [], 50).collect()
    assert len(points) == len(again) + max(r.block for r in again) - 1


def one_big_scan(rows, value):
    """Per key, over chunks in order: previous last, following first, and the sum before."""
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for i, r in enumerate(mine):
            out[key, r[1]] = (mine[i - 1][3] if i else None, mine[i + 1][2] if i + 1 < len(mine) else None, sum(x[4] for x in mine[:i]))
    return out


@pytest.mark.parametrize("width", [2, 3, 256])
def test_scan_in_levels(spark, monkeypatch, width):
    monkeypatch.setattr(ordering, "WIDTH", width)
    rng = random.Random(width)
    rows = [(k, c, rng.randrange(3), rng.randrange(3), rng.randrange(9)) for k in ("a", "b", None) for c in range(40) if rng.random() < 0.6]
    table = spark.createDataFrame(rows, "unit string, __chunk long, first int, last int, v long")
    linked = ordering.neighbours(table, ["unit"], 40).select("unit", CHUNK, "previous", "following", "v")
    got = ordering.totals_before(linked, ["unit"], 40, "v").collect()
    assert {(r.unit, r[CHUNK]): (r.previous, r.following, r.before) for r in got} == one_big_scan(rows, 4)


def test_runs_and_blocks_over_many_levels(spark, monkeypatch):
    """Chunks of a few rows, levels of three, small Arrow batches, and units, one of them NULL."""
    monkeypatch.setattr(ordering, "WIDTH", 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = telemetry(spark, random_rows(9, 600, 0.3, 200)).withColumn("unit", F.expr("CASE WHEN row_id % 5 < 3 THEN 'a' WHEN row_id % 5 = 3 THEN 'b' END"))
        df = df.withColumn("kpi", F.col("row_id") * 1.0)
        got = states.status_runs(df.drop("unit"), ROLES, 20).collect()
        assert sorted((r.block, r.status, r.x0, r.n) for r in got) == plain_runs(df)
        by_unit = Roles("t", "on", "ready", "row_id", "unit")
        runs = states.status_runs(df, by_unit, 20).collect()
        blocks = states.state_blocks(df, by_unit, ["kpi"], 20).collect()
        points = states.block_points(df, by_unit, ["kpi"], 20).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for unit in ("a", "b", None):
        own = df.where(F.col("unit").eqNullSafe(F.lit(unit)))
        assert sorted((r.block, r.status, r.x0, r.n) for r in runs if r.unit == unit) == plain_runs(own)
        series, block, last = {}, 0, None
        for r in own.where("ready >= 1").orderBy("t", "row_id").collect():
            state = int(r.on >= 1)
            block += state != last
            last = state
            series[r.row_id] = (block, state)
        assert {r.row_id: (r.block, r.state) for r in blocks if r.unit == unit} == series
        ends = {b: max((r.t, r.row_id) for r in blocks if r.unit == unit and r.block == b)[1] for b, _ in series.values()}
        want = {(i, b, s) for i, (b, s) in series.items()} | {(ends[b], b + 1, 1 - s) for b, s in series.values() if b + 1 in ends}
        assert {(r.row_id, r.block, r.block_state) for r in points if r.unit == unit} == want


def test_rows_are_shuffled_once_and_no_cut_point_passes_the_driver(spark, monkeypatch):
    """The rows' one exchange is Spark's own range partitioning; what is read afterwards are the chunks' tables."""
    plans = []
    written = ordering.written
    monkeypatch.setattr(states, "written", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, label))
    df = telemetry(spark, random_rows(5, 3000, 0.5, 400)).withColumn("kpi", F.lit(1.0))
    states.state_blocks(df, ROLES, ["kpi"], 100).collect()
    states.status_runs(df, ROLES, 100).collect()
    assert len(plans) == 2
    for plan in plans:
        plan = plan.split("Initial Plan")[-1]
        assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan and "SinglePartition" not in plan


def test_row_numbers(spark, monkeypatch):
    monkeypatch.setattr(ordering, "WIDTH", 2)
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), (F.col("id") % 7).alias("v"))
    assert {r.k: r.number for r in ordering.row_numbers(df, ["k"], rows_per_chunk=20).collect()} == {k: k + 1 for k in range(500)}
    rows = sorted((r.k, r.v) for r in df.collect())
    sums = {r.k: r.s for r in ordering.row_numbers(df, ["k"], "s", 20, "v").collect()}
    assert sums == {k: sum(v for _, v in rows[:k]) for k, _ in rows}


def test_ties_without_row_id_have_one_order(spark):
    df = telemetry(spark, random_rows(3, 1000, 0.0, 400)).drop("row_id")
    roles = Roles("t", "on", "ready")
    one, two = (sorted(states.status_runs(d, roles, 100).collect()) for d in (df, df.repartition(5)))
    assert one == two


def test_empty_table(spark):
    df = telemetry(spark, random_rows(2, 10)).limit(0)
    assert states.status_runs(df, ROLES).count() == 0
    assert states.state_blocks(df, ROLES, []).count() == 0


def test_density_shuffles_no_value_and_buckets_need_no_sort(spark, golden):
    roles = Roles("datetime", "on", "ready", "row_id")
    curve = distribution.kde_counts(golden, roles, ["kpi"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*value", curve)
    ohlc = rollup.bucket_ohlc(golden, roles, "kpi", [], 3600)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in ohlc and "SortAggregate" not in ohlc
