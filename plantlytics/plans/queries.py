"""One query per operator on the driver's test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlytics.functions import scalars as S
from plantlytics import roles
from plantlytics.operators import distribution, filters, ordering, prepare, rollup, series, states, stats
from plantlytics.plans import pipeline, report
from plantlytics.plans import telemetry as tm
from plantlytics.plans.telemetry import LINEITEM_KPIS, ROLES
from plantlytics.roles import Roles
from plantlytics.session import configure, fresh_path
from plantlytics.sinks import export
from plantlytics.sources import plantlog
from plantlytics.sources.datasets import MAIN, Datasets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

START, END = dt.date(2024, 1, 5), dt.date(2024, 1, 14)
RANGES = {"l_quantity": (10.0, 24.0), "l_discount": (0.02, 0.08), "no_such_column": (0.0, 1.0)}
WANTED = {"l_quantity": (-5.0, 20.0), "l_extendedprice": (-1.0, 1e12), "l_tax": (0.05, 0.02)}
# A low limit, so that the queries take the way large tables take.
CHUNK_ROWS = 2_000


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """DOUBLE columns rounded, negative zero removed: engines add in different orders."""
    return df.select(
        *[
            (F.round(c, digits) + 0.0).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType) else c
            for c in df.columns
        ]
    )


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(function(configure(spark), sf_dir))

    QUERIES[function.__name__] = run
    return run


# States


@query
def state_efficiency(spark, sf_dir):
    return states.state_efficiency(tm.tele(spark, sf_dir), ROLES)


@query
def state_shares(spark, sf_dir):
    return states.state_shares(tm.tele(spark, sf_dir), ROLES)


@query
def status_timeline(spark, sf_dir):
    return states.status_timeline(tm.tele(spark, sf_dir), ROLES).select("row_id", "datetime", "status")


@query
def status_runs(spark, sf_dir):
    return states.status_runs(tm.tele(spark, sf_dir), ROLES, CHUNK_ROWS)


@query
def status_runs_no_row_id(spark, sf_dir):
    return states.status_runs(tm.tele(spark, sf_dir), Roles("datetime", "on_flag", "ready"), CHUNK_ROWS)


@query
def status_runs_hot_instant(spark, sf_dir):
    return states.status_runs(tm.hot_orders(spark, sf_dir), ROLES, CHUNK_ROWS)


@query
def status_runs_by_unit(spark, sf_dir):
    by_unit = Roles("datetime", "on_flag", "ready", "row_id", "unit")
    return states.status_runs(tm.tele(spark, sf_dir), by_unit, CHUNK_ROWS)


@query
def state_blocks(spark, sf_dir):
    return states.state_blocks(tm.tele(spark, sf_dir), ROLES, ["kpi"], CHUNK_ROWS)


@query
def block_points(spark, sf_dir):
    return states.block_points(tm.tele(spark, sf_dir), ROLES, ["kpi"], CHUNK_ROWS)


# Filters


@query
def date_range_filter(spark, sf_dir):
    return filters.date_range_filter(tm.tele(spark, sf_dir), START, END)


@query
def range_filter(spark, sf_dir):
    return filters.range_filter(tm.table(spark, sf_dir, "lineitem"), RANGES).select(
        "l_orderkey", "l_linenumber", *LINEITEM_KPIS
    )


@query
def range_bounds(spark, sf_dir):
    return filters.range_bounds(tm.table(spark, sf_dir, "lineitem"), LINEITEM_KPIS)


@query
def clamped_range_filter(spark, sf_dir):
    return filters.clamped_range_filter(tm.table(spark, sf_dir, "lineitem"), WANTED).select(
        "l_orderkey", "l_linenumber", *LINEITEM_KPIS
    )


@query
def text_search_literal(spark, sf_dir):
    return filters.text_search(tm.table(spark, sf_dir, "documents"), " LICENSE ", ["text"]).select("doc_id", "n_chars")


@query
def text_search_regex(spark, sf_dir):
    documents = tm.table(spark, sf_dir, "documents")
    found = filters.text_search(documents, r"licen[cs]e|copy(right|left)", ["text"], use_regex=True)
    return found.select("doc_id", "n_chars")


@query
def text_search_regex_case(spark, sf_dir):
    documents = tm.table(spark, sf_dir, "documents")
    found = filters.text_search(documents, r"The [a-z]+ ", ["text"], use_regex=True, case_sensitive=True)
    return found.select("doc_id", "n_chars")


@query
def text_search_columns(spark, sf_dir):
    """Two columns, and a pattern that is no valid regex: searched literally."""
    customers = tm.table(spark, sf_dir, "customer")
    broken = filters.text_search(customers, "#00000001(", ["c_name"], use_regex=True)
    found = filters.text_search(customers, "e7", ["c_name", "c_mktsegment", "c_acctbal"], case_sensitive=True)
    both = filters.text_search(customers, "u", ["c_mktsegment", "unknown"])
    return broken.unionAll(found).unionAll(both).select("c_custkey", "c_mktsegment")


@query
def text_search_numeric(spark, sf_dir):
    return filters.text_search(tm.tele(spark, sf_dir), "9.1", ["kpi", "on_flag"]).select("row_id", "kpi")


@query
def ready_filter(spark, sf_dir):
    return filters.ready_filter(tm.tele(spark, sf_dir), ROLES.ready)


@query
def filter_summary(spark, sf_dir):
    lineitem = tm.table(spark, sf_dir, "lineitem")
    return filters.filter_summary(lineitem, filters.range_predicate(lineitem, RANGES))


@query
def preview_topk(spark, sf_dir):
    return filters.preview(tm.tele(spark, sf_dir), ROLES)


@query
def dataset_registry(spark, sf_dir):
    """Rows, sums and times of every dataset that is offered: an empty one is not."""
    datasets, main = Datasets(spark), tm.tele(spark, sf_dir)
    datasets.register("ready_rows", filters.ready_filter(main, ROLES.ready))
    datasets.register("nothing", main.where("row_id < 0"))
    datasets.register(MAIN, main)
    counts = [
        datasets.get(name).agg(
            F.lit(name).alias("name"), F.lit(i).alias("place"), F.count(F.lit(1)).alias("rows"), F.sum("kpi").alias("kpi_sum"),
            F.min("datetime").alias("first"), F.max("datetime").alias("last"))
        for i, name in enumerate(datasets.available())
    ]
    return reduce(DataFrame.unionAll, counts)


@query
def filter_pipeline(spark, sf_dir):
    """Summary of the whole pipeline with the rows read back from its CSV and its dataset."""
    datasets = Datasets(spark)
    datasets.register(MAIN, tm.tele(spark, sf_dir))
    done = pipeline.filter_and_export(datasets, MAIN, {"kpi": (5.0, 60.0)}, "1", ["on_flag"])
    csv = spark.read.option("header", True).csv(done.csv_path).agg(F.count(F.lit(1)).alias("csv_rows"))
    kept = datasets.get(done.name).agg(F.count(F.lit(1)).alias("dataset_rows"), F.sum("kpi").alias("kpi_sum"))
    return plantlog.side_by_side(done.summary, csv, kept)


# Statistics


@query
def onoff_stats(spark, sf_dir):
    return stats.onoff_stats(tm.tele(spark, sf_dir), ROLES, ["kpi"])


@query
def onoff_stats_by_kpi(spark, sf_dir):
    return stats.onoff_stats(tm.shipments(spark, sf_dir), ROLES, LINEITEM_KPIS)


@query
def onoff_delta(spark, sf_dir):
    return stats.onoff_delta(tm.tele(spark, sf_dir), ROLES, ["kpi"])


@query
def onoff_delta_by_kpi(spark, sf_dir):
    return stats.onoff_delta(tm.shipments(spark, sf_dir), ROLES, LINEITEM_KPIS)


@query
def onoff_means(spark, sf_dir):
    return stats.onoff_means(tm.tele(spark, sf_dir), ROLES, ["kpi"])


@query
def onoff_stats_compact(spark, sf_dir):
    return stats.onoff_stats_compact(tm.tele(spark, sf_dir), ROLES, ["kpi"])


@query
def describe_profile(spark, sf_dir):
    return stats.describe_profile(tm.table(spark, sf_dir, "lineitem"), LINEITEM_KPIS)


@query
def describe_profile_dirty(spark, sf_dir):
    return stats.describe_profile(tm.dirty(spark, sf_dir), ["kpi_txt", "X_ON", "X_READY"])


@query
def box_summary(spark, sf_dir):
    return stats.box_summary(tm.tele(spark, sf_dir), ROLES, ["kpi"])


@query
def box_summary_by_kpi(spark, sf_dir):
    return stats.box_summary(tm.shipments(spark, sf_dir), ROLES, LINEITEM_KPIS)


@query
def box_outliers(spark, sf_dir):
    return stats.box_outliers(tm.tele(spark, sf_dir), ROLES, ["kpi"])


@query
def padded_range(spark, sf_dir):
    return stats.padded_range(tm.table(spark, sf_dir, "lineitem"), LINEITEM_KPIS)


@query
def binary_signal_profile(spark, sf_dir):
    df = tm.tele(spark, sf_dir).select(
        "*",
        (F.col("on_flag") + F.lit(0.25)).alias("opt_level"),
        F.when(F.col("row_id") < 0, 1.0).alias("empty_sp"),
        (F.col("row_id") % 4 * 0.4).alias("four_steps"),
    )
    return stats.binary_signal_profile(df, ["kpi", "on_flag", "ready", "opt_level", "empty_sp", "four_steps"])


@query
def period_summary(spark, sf_dir):
    return stats.period_summary(tm.tele(spark, sf_dir), "datetime")


# Distribution


@query
def kde_counts(spark, sf_dir):
    return distribution.kde_counts(tm.tele(spark, sf_dir), ROLES, ["kpi"])


@query
def kde_counts_by_kpi(spark, sf_dir):
    return distribution.kde_counts(tm.shipments(spark, sf_dir), ROLES, LINEITEM_KPIS)


@query
def kde_counts_row_scale(spark, sf_dir):
    df = tm.dirty(spark, sf_dir)
    return distribution.kde_counts(df, Roles("Date", "X_ON", "X_READY"), ["kpi_txt"], scale="rows")


@query
def kde_counts_binned(spark, sf_dir):
    return distribution.kde_counts(tm.tele(spark, sf_dir), ROLES, ["kpi"], method="binned")


@query
def histogram_counts(spark, sf_dir):
    return distribution.histogram_counts(tm.tele(spark, sf_dir), ROLES, ["kpi"])


@query
def distribution_curves(spark, sf_dir):
    """A state without spread gets bars, the other its curve."""
    df = tm.tele(spark, sf_dir).withColumn("kpi", F.when(F.col("on_flag") == 0, 7.5).otherwise(F.col("kpi")))
    return distribution.distribution(df, ROLES, ["kpi"])


# Rollup


@query
def bucket_ohlc(spark, sf_dir):
    return rollup.bucket_ohlc(tm.tele(spark, sf_dir), ROLES, "kpi", ["unit"], 3600)


@query
def bucket_ohlc_adaptive(spark, sf_dir):
    return rollup.bucket_ohlc(tm.tele(spark, sf_dir), ROLES, "kpi")


@query
def bucket_width(spark, sf_dir):
    return rollup.bucket_width(tm.tele(spark, sf_dir))


# Preparation


@query
def typed_projection(spark, sf_dir):
    return prepare.typed_projection(tm.dirty(spark, sf_dir), keep=("row_id",))


@query
def drop_null_time(spark, sf_dir):
    return prepare.prepare(tm.dirty(spark, sf_dir), keep=("row_id",)).select("row_id", "datetime")


@query
def silver_date_range(spark, sf_dir):
    """Typed table written by day and read back through a date filter."""
    path = fresh_path(spark, "silver")
    prepare.write_silver(prepare.prepare(tm.dirty(spark, sf_dir), keep=("row_id",)), path, row_id="row_id")
    return filters.date_range_filter(spark.read.parquet(path), START, END)


@query
def to01(spark, sf_dir):
    df = tm.dirty(spark, sf_dir)
    return df.select("row_id", *[S.to01(df, c).alias(c) for c in ("X_ON", "X_READY", "kpi_txt")])


@query
def numeric_coerce(spark, sf_dir):
    df = tm.dirty(spark, sf_dir)
    return df.select("row_id", S.num(df, "kpi_txt").alias("kpi"), S.num(df, "X_READY").alias("ready"))


@query
def datetime_coerce(spark, sf_dir):
    """The lenient way, and day-first texts of several forms by an ordered list of formats."""
    df = tm.dirty(spark, sf_dir).select("row_id", S.to_datetime(F.col("Date")).alias("datetime"))
    texts = prepare.parse_times(tm.day_first(tm.tele(spark, sf_dir)), "when", [*S.DAY_FIRST, S.ISO])
    return df.join(texts.withColumnRenamed("when", "day_first"), "row_id")


@query
def datetime_audit(spark, sf_dir):
    """Times that can't be read are counted apart from missing ones."""
    strict = prepare.time_audit(tm.dirty(spark, sf_dir), "Date", [S.ISO])
    listed = prepare.time_audit(tm.day_first(tm.tele(spark, sf_dir)), "when", [*S.DAY_FIRST, S.ISO])
    return strict.withColumn("source", F.lit("Date")).unionByName(listed.withColumn("source", F.lit("when")))


@query
def clean_null_tokens(spark, sf_dir):
    return prepare.clean_null_tokens(tm.dirty(spark, sf_dir))


@query
def series_extract(spark, sf_dir):
    df = tm.tele(spark, sf_dir).withColumn("steps", F.when(F.col("row_id") % 7 != 0, F.col("row_id") % 3 * 0.75))
    return series.series_extract(df, ROLES, ["kpi", "steps", "on_flag"], binary={"steps"})


@query
def series_split(spark, sf_dir):
    return series.series_split(tm.tele(spark, sf_dir), ROLES, ["kpi"])


# Sources and sinks


def _log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tm.dirty(spark, sf_dir).select(
        "row_id", "Date", "X_ON", "X_READY", F.col("kpi_txt").alias("Feed"), F.col("row_id").cast("string").alias("Id")
    )


def _write_logs(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_path(spark, "logs")
    tm.write_logs(_log_text(spark, sf_dir), path, ["Date", "X_ON", "X_READY", "Feed", "Id"])
    return path


@query
def plant_log_scan(spark, sf_dir):
    return plantlog.read_plant_log(spark, _write_logs(spark, sf_dir)).drop("row_id")


@query
def plant_log_split(spark, sf_dir):
    """Preambles longer than a split, their headers too; the rows' ids, numbered, follow the files."""
    path, key = fresh_path(spark, "logs"), "spark.sql.files.maxPartitionBytes"
    tm.write_logs(_log_text(spark, sf_dir), path, ["Date", "X_ON", "X_READY", "Feed", "Id"], pad=50_000)
    before = spark.conf.get(key)
    spark.conf.set(key, "40k")
    try:  # written while the splits are small
        rows = ordering.written(plantlog.read_plant_log(spark, path), "split-log")
    finally:
        spark.conf.set(key, before)
    return ordering.row_numbers(rows, ["row_id"], "number", CHUNK_ROWS).drop("row_id")


@query
def header_unique(spark, sf_dir):
    """Names are stripped and repeated ones get a suffix that is free."""
    path = fresh_path(spark, "logs")
    names = ["Date", "X_ON", "X_ON", " Feed ", "Feed", "Feed_1"]
    tm.write_logs(_log_text(spark, sf_dir).withColumn("Copy", F.col("Id")), path, ["Date", "X_ON", "X_READY", "Feed", "Id", "Copy"], header=names)
    return plantlog.read_plant_log(spark, path).drop("row_id")


def _typed_logs(spark, paths):
    return plantlog.load_logs(spark, paths).select("datetime", "X_ON", "X_READY", "Feed", F.col("Id").cast("long").alias("row_id"))


@query
def discover_logs(spark, sf_dir):
    """Files found by prefix, word and extension, among others in the folder."""
    path = _write_logs(spark, sf_dir)
    tm.dirty(spark, sf_dir).write.mode("append").parquet(path)
    return _typed_logs(spark, plantlog.discover(spark, path, prefix="part-", word="-c000"))


@query
def single_path_load(spark, sf_dir):
    path = fresh_path(spark, "logs")
    tm.write_logs(_log_text(spark, sf_dir), path, ["Date", "X_ON", "X_READY", "Feed", "Id"], files=1)
    return _typed_logs(spark, plantlog.discover(spark, path, prefix="part-", word="-c000")[0])


@query
def accepted_extensions(spark, sf_dir):
    """Logs of two accepted extensions in one folder with files of another."""
    path, text = fresh_path(spark, "logs"), _log_text(spark, sf_dir)
    for kind, rest in (("text", 0), ("csv", 1)):
        tm.write_logs(text.where(F.col("row_id") % 2 == rest), path, ["Date", "X_ON", "X_READY", "Feed", "Id"], kind=kind)
    text.write.mode("append").parquet(path)
    return _typed_logs(spark, plantlog.uploads(path))


@query
def multi_file_union(spark, sf_dir):
    """Two sets of files, one without the readiness flag, stacked and typed."""
    text = _log_text(spark, sf_dir)
    paths = [fresh_path(spark, "logs-a"), fresh_path(spark, "logs-b")]
    tm.write_logs(text.where(F.col("row_id") % 2 == 0), paths[0], ["Date", "X_ON", "X_READY", "Feed", "Id"])
    tm.write_logs(text.where(F.col("row_id") % 2 == 1), paths[1], ["Date", "X_ON", "Feed", "Id"])
    return plantlog.load_logs(spark, paths, allow_missing=True).select(
        "datetime", "X_ON", "X_READY", "Feed", F.col("Id").cast("long").alias("row_id")
    )


@query
def load_summary(spark, sf_dir):
    """Some values hold an invalid byte."""
    path = fresh_path(spark, "logs")
    broken = F.when(F.col("row_id") % 31 == 0, F.concat("Feed", F.expr("CAST(X'FF' AS STRING)"))).otherwise(F.col("Feed"))
    tm.write_logs(_log_text(spark, sf_dir).withColumn("Feed", broken), path, ["Date", "X_ON", "X_READY", "Feed", "Id"])
    return plantlog.load_summary(spark, path)


@query
def csv_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "csv")
    export.write_csv(tm.dirty(spark, sf_dir), path)
    return spark.read.options(header=True, inferSchema=False).csv(path)


@query
def tsv_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "tsv")
    typed = prepare.prepare(tm.dirty(spark, sf_dir), keep=("row_id",))
    export.write_tsv(filters.date_range_filter(typed, START, END), path)
    back = spark.read.options(header=True, sep="\t", inferSchema=False).csv(path)
    return back.withColumn("row_id", F.col("row_id").cast("long"))


# Column roles


@query
def role_resolution(spark, sf_dir):
    """Roles found by name, and what the columns found hold."""
    tele, orders = tm.tele(spark, sf_dir), tm.hot_orders(spark, sf_dir)
    named = {
        "events": tele.withColumnsRenamed({"on_flag": "X_ON", "ready": "X_READY"}),
        "orders": orders.withColumnsRenamed({"datetime": "Order Date", "on_flag": "Season", "ready": "Flag_Ready"}),
        "plain": tele.drop("ready").withColumnsRenamed({"datetime": "Fecha", "on_flag": "Running_ON"}),
    }
    parts = []
    for name, df in named.items():
        found = roles.resolve_roles(df.columns)
        flags = [F.sum(S.to01(df, c)) if c else F.count(F.lit(1)) for c in (found.on, found.ready)]
        parts.append(df.agg(
            F.lit(name).alias("name"), F.lit(found.time).alias("time"), F.lit(found.on).alias("on"), F.lit(found.ready).cast("string").alias("ready"),
            F.max(S.time_of(df, found.time)).alias("last"), flags[0].alias("on_rows"), flags[1].alias("ready_rows")))
    return reduce(DataFrame.unionAll, parts)


@query
def kpi_listing(spark, sf_dir):
    """Every numeric column that is neither flag nor key, with its category, values and ends."""
    df = tm.table(spark, sf_dir, "lineitem").withColumnRenamed("l_tax", "tax_setpoint")
    names = roles.kpi_candidates(df.schema, Roles("l_shipdate", row_id="l_orderkey"))
    kind = F.create_map(*[F.lit(x) for n in names for x in (n, roles.signal_category(n))])
    ends = stats.unpivot_numeric(df, names).groupBy("kpi").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return ends.withColumn("category", kind[F.col("kpi")])


@query
def rename_date(spark, sf_dir):
    """A dataset without ``datetime`` but with ``Date``."""
    datasets = Datasets(spark)
    datasets.register("renamed", tm.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("Date"), "o_totalprice"))
    return datasets.get("renamed")


@query
def drop_duplicate_time(spark, sf_dir):
    return roles.drop_duplicate_time(prepare.prepare(tm.dirty(spark, sf_dir), keep=("row_id",)))


@query
def search_scope(spark, sf_dir):
    """Chosen numeric columns, all columns where none is chosen, and an explicit list."""
    df = tm.table(spark, sf_dir, "customer")
    searches = [("77", "numeric", ["c_custkey", "c_nationkey"], []), ("machinery", "numeric", [], []), ("#0000000", "explicit", [], ["c_name"]), ("BUILDING", "all", [], [])]
    found = [
        filters.text_search(df, needle, roles.search_scope(df.columns, scope, numeric, explicit)).select(F.lit(needle).alias("needle"), "c_custkey")
        for needle, scope, numeric, explicit in searches
    ]
    return reduce(DataFrame.unionAll, found)


# Report


@query
def report_header(spark, sf_dir):
    df = filters.date_range_filter(tm.tele(spark, sf_dir), START, END)
    return report.report_header(df, ["kpi", "unit"], START, END, "Weekly report", "events", ROLES.ready)


@query
def report_tables(spark, sf_dir):
    """All numbers of every written report section, read back from the report folder."""
    path = fresh_path(spark, "report")
    tables = report.report_tables(tm.tele(spark, sf_dir), ROLES, ["kpi", "lost"], START, END, "Weekly report", "events")
    report.write_report(tables, path)
    return report.long_form(spark, path, tables)


@query
def report_isolation(spark, sf_dir):
    """A KPI that fails when it is read: it is listed, and everything else is written."""
    path = fresh_path(spark, "report")
    df = tm.tele(spark, sf_dir).withColumn("broken", F.raise_error(F.lit("no signal")).cast("double"))
    tables = report.report_tables(df, ROLES, ["broken", "kpi", "lost"], START, END)
    report.write_report(tables, path)
    return report.long_form(spark, path, ["errors", "statistics", report.OUTCOMES])
