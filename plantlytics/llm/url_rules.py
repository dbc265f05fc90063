"""URL filters: allow and block rules matched by a sort-merge range join over reversed-host keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlytics.llm.common import checkpointed, pick, read, schema

#: Production rules (host, path, verdict) and the verdict of urls that no rule fits.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
OTHERWISE = "allow"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    return F.when(at > 0, F.substr(text, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without."""
    host = F.regexp_extract(rest_of(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or where the host ends at these."""
    return F.regexp_extract(rest_of(url), r"^[^/?#]*(/?[^?#]*)", 1)


def _key(labels: Column, path: Column) -> Column:
    """Canonical key: labels of the host last to first, each ended by \\x01, then \\x02 and the path.

    A rule fits a url if its key is a prefix of the key of the url with the host cut to one of its suffixes, and
    the keys with one prefix are an interval of the sort order.
    """
    return F.concat(F.array_join(F.reverse(labels), "\x01"), F.lit("\x01\x02"), path)


def _sweep(start: dict[int, list[tuple[str, str, str]]], report: bool):
    """Sweep over rows (key, rule, verdict, host, path) in order of key, rules before urls, with a stack of the nested
    rules whose intervals hold the current key. ``report``: give just the last key of the partition and the stack there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        stack = list(start.get(part, []))
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for last, rule, given, host, path in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                while stack and not last.startswith(stack[-1][0]):
                    stack.pop()
                if rule is not None:
                    if not stack or stack[-1][0] != last:
                        stack.append((last, rule, given))
                elif stack and not report:
                    for column, value in zip(out, (host, path, stack[-1][1], stack[-1][2]), strict=True):
                        column.append(value)
            if not report:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["host", "path", "rule", "verdict"])
        if report and last is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([last]), pa.array([[x for row in stack for x in row]], pa.list_(pa.string()))],
                ["part", "key", "stack"])

    return run


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each distinct ``(host, path)`` of ``urls``: ``host, path, rule, verdict``; none without a rule.

    ``rules`` has ``host, path, verdict``; a rule fits its host and all subdomains if the path starts with the rule's. Each
    url gives one key per suffix of its host. These and the rules' keys are range-partitioned (the urls of one host
    spread by path) and swept in order, nested rules forming a stack. The rules open at the start of a partition come
    from the partitions before it: one row per partition, with a stack no deeper than a key is long, passes the driver. Of
    equal rules the verdict that sorts first counts (allow before block); NULL parts of a rule are empty, and
    a rule without a host is left out. No rules, no urls: an empty result.
    """
    named = rules.select(F.coalesce("host", F.lit("")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict").where("h <> ''")
    none = F.lit(None).cast("string")
    named = named.select(_key(F.split("h", r"\."), F.col("p")).alias("key"), F.concat("h", "p").alias("rule"), "verdict", none.alias("host"), none.alias("path"))
    labels = F.split("host", r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: _key(F.slice(labels, F.size(labels) - n + 1, n), F.col("path")))
    points = urls.select("host", "path").where("host <> ''").distinct().select(F.explode(keys).alias("key"), none.alias("rule"), none.alias("verdict"), "host", "path")
    order = ["key", F.col("host").asc_nulls_first(), "verdict"]
    swept = checkpointed(named.union(points).repartitionByRange(*order[:2]).sortWithinPartitions(*order))
    ends = {r.part: r for r in swept.mapInArrow(_sweep({}, True), schema(part="int", key="string", stack="array<string>")).collect()}
    start: dict[int, list[tuple[str, str, str]]] = {}
    stack: list[tuple[str, str, str]] = []
    for part in range(max(ends, default=-1) + 1):
        start[part] = stack
        if part in ends:
            own = ends[part].stack
            stack = [s for s in stack if ends[part].key.startswith(s[0])]
            stack = sorted({s[0]: s for s in [*(tuple(own[i : i + 3]) for i in range(0, len(own), 3)), *stack]}.values(), key=lambda s: len(s[0]))
    found = swept.mapInArrow(_sweep(start, False), schema(host="string", path="string", rule="string", verdict="string"))
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")
    return found.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = OTHERWISE) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages`` (``page_id, url``); ``rule`` is NULL without one.

    NULL urls and those without ``://`` have empty host and path, no rule, and the verdict ``otherwise``. Repeated rows are
    judged alike, each with its own row; rules are matched once per distinct host and path.
    """
    rows = pick(pages, page_id="bigint", url="string").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = match_rules(rows, rules)
    out = rows.join(found, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


def op5_interval_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP5_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
c AS (SELECT page_id, split_part(split_part(coalesce(rest, ''), '#', 1), '?', 1) AS place FROM u),
p AS (SELECT page_id, translate(split_part(place, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  substr(place, length(split_part(place, '/', 1)) + 1) AS path FROM c),
r(h, pre, given) AS (VALUES {", ".join(str(x) for x in RULES)}),
m AS (SELECT page_id, host, path, h || pre AS rule, given, row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC, h || pre DESC) AS k
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT page_id, host, path, rule, coalesce(given, '{OTHERWISE}') AS verdict FROM m WHERE k = 1
"""
