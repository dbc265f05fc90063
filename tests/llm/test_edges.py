"""Odd and empty tables through every operator and every stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plantlytics.llm import (decontaminate, lm_score, mixing, near_dup, quality_classifier, quality_rules, secrets, suffix_dedup, toxicity,
                             url_rules)
from plantlytics.llm.common import pick


@pytest.fixture(scope="module", autouse=True)
def folding_names(spark):
    """The operators don't rely on the case-sensitive names that the rest of the library asks for."""
    spark.conf.set("spark.sql.caseSensitive", "false")
    yield
    spark.conf.set("spark.sql.caseSensitive", "true")


@pytest.fixture(scope="module")
def benchmark(spark):
    from corpus_data import prose

    return spark.createDataFrame([(1, prose(3, 14)), (2, None), (None, "the"), (3, ""), (3, "zzz")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (9, 0, 1), (9, 0, 1), (None, 1, 1), (4, None, None), (10, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "mixing": lambda d, b, l: mixing.mix(mixing.with_tokens(pick(d, doc_id="long", text="string", source="string", lang="string")), mixing.TARGETS),
    "suffix_dedup": lambda d, b, l: suffix_dedup.repeated_passages(d),
    "decontaminate": lambda d, b, l: decontaminate.benchmark_hits(d, b, keep=["doc_id"]),
    "toxicity": lambda d, b, l: toxicity.toxicity(d, toxicity.toxicity_model(pick(d, doc_id="long", text="string"), l), keep=["doc_id"]),
    "near_dup": lambda d, b, l: near_dup.near_duplicates(d),
    "secrets": lambda d, b, l: secrets.find_secrets(pick(d, doc_id="long", text="string")),
    "quality_rules": lambda d, b, l: quality_rules.judge_quality(d),
    "quality_classifier": lambda d, b, l: quality_classifier.quality_scores(d, l),
    "lm_score": lambda d, b, l: lm_score.interpolated_scores(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_each_give_a_row(name, odd, benchmark, labels):
    clash = odd.withColumnRenamed("c0", "Text_") if name == "secrets" else odd
    got = OPERATORS[name](clash, benchmark, labels).collect()
    assert len(got) == odd.count()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(name, odd, benchmark, labels):
    assert OPERATORS[name](odd.limit(0), benchmark.limit(0), labels.limit(0)).count() == 0


def test_empty_benchmark_and_labels(odd, benchmark, labels):
    assert not any(r.n_hit for r in decontaminate.benchmark_hits(odd, benchmark.limit(0)).select("n_hit").collect())
    assert quality_classifier.quality_scores(odd, labels.limit(0)).where("score IS NULL OR isnan(score)").count() == 0
    model = toxicity.toxicity_model(pick(odd, doc_id="long", text="string"), labels.limit(0))
    assert {r.score for r in toxicity.toxicity(odd, model, keep=["doc_id"]).collect()} == {0.5}


def test_clashing_column_names(spark, odd):
    """Names that differ by case only: read with case-sensitive names, then used without."""
    spark.conf.set("spark.sql.caseSensitive", "true")
    clash = odd.withColumn("Text", F.lit("other")).withColumn("DOC_ID", F.lit(-1))
    spark.conf.set("spark.sql.caseSensitive", "false")
    got = decontaminate.benchmark_hits(clash, odd.select(F.col("doc_id").alias("item_id"), "text").limit(0), plain_names=True)
    assert got.count() == odd.count()
    assert near_dup.near_duplicates(clash).where("component_id = -1").count() == 0


def test_urls(pages, spark):
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules).collect()), key=str)
    want = [
        (1, "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "net", "", None, "allow"),
        (5, "net", "/", "net/", "block"), (6, "x.org", "/fr/a", "org/fr/", "allow"), (7, "example.com", "/de/", "example.com/de/", "block"),
        (8, "example.com", "/de", None, "allow"), (None, "b.example.net", "/en/", "example.net/en/", "allow"), (9, "notexample.net", "/en/", "net/", "block"),
        (10, "", "/en/", None, "allow"), (10, "", "/en/", None, "allow"), (11, "example.net:80", "/en/", None, "allow"), (12, "b:", "//c.net/x", None, "allow"),
        (13, "", "", None, "allow"), (14, "x.net", "", None, "allow"), (15, "a.org", "", None, "allow"), (16, "a.net", "", None, "allow"),
        (17, "a.net", "", None, "allow"), (18, "a.net", "/", "net/", "block")]
    assert got == sorted(want, key=str)
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert url_rules.judge_urls(pages, rules.limit(0)).where("rule IS NOT NULL").count() == 0


def parsed(url):
    """Host and path by string search alone."""
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    stop = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    slash = rest.find("/", 0, stop)
    host, path = (rest[:stop], "") if slash < 0 else (rest[:slash], rest[slash:stop])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def test_urls_against_string_search(spark):
    r = random.Random(4)
    urls = ["".join(r.choice(["http", "://", ":", "/", "?", "#", "a.Net", "example.net", "/en/", "B", "é", "\n", " "]) for _ in range(r.randrange(9)))
            for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = rows.select("page_id", url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {i: parsed(u) for i, u in enumerate(urls)}


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_stages(spark, odd, rows, tmp_path):
    from corpus_data import SF

    docs = odd if rows == "odd" else odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "mixture":
            assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if rows == "empty":
            assert docs.count() == 0
    if rows == "odd":
        assert docs.where("text IS NULL OR text = ''").count() == 0
