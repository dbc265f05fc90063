"""Mixing sources to target weights: raking of token masses, then sampling by calibrated probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlytics.llm.common import pick, read, stored

#: Production targets. Values that no target names keep their natural share; all shares are scaled to 1.
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
TOPICS = {"prose": 0.9, "table": 0.03, "legal": 0.04, "noise": 0.02, "shouted": 0.01}
#: Sources get shares by their tokens to this power; rounds of raking; wanted share of all tokens; rounds of calibration.
TEMPERATURE, ROUNDS, BUDGET, CAPS = 0.7, 8, 0.4, 6
DIMENSIONS = ("source", "lang", "topic")

_TOPIC = """CASE WHEN {t} IS NULL OR trim({t}) = '' THEN 'empty' WHEN {has_bar} THEN 'table'
 WHEN {has_law} THEN 'legal' WHEN {has_signs} THEN 'noise' WHEN {has_shout} THEN 'shouted' ELSE 'prose' END"""


def topic_of(text: str = "text") -> Column:
    """Kind of a text by plain marks: empty, table, legal, noise, shouted or prose."""
    return F.expr(_TOPIC.format(
        t=text, has_bar=f"contains({text}, ' | ')", has_law=f"contains({text}, 'icense') OR contains({text}, 'rights reserved')",
        has_signs=f"contains({text}, '###') OR contains({text}, '$$$')", has_shout=f"contains({text}, '!! ')"))


def with_tokens(docs: DataFrame) -> DataFrame:
    """Adds ``source, lang, topic`` (NULL read as empty) and ``tokens``, the words between blanks."""
    return docs.select(
        "doc_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("source", "lang")], topic_of().alias("topic"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("tokens"))


def cell_rates(rows: DataFrame, targets: dict[str, dict[str, float]], temperature: float = TEMPERATURE,
               rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """Sampling probability of each cell ``(source, lang, topic)`` of ``rows`` (with a column ``tokens``).

    Iterative proportional fitting: each round scales the cells' token masses to the shares of one dimension after the
    other. A cell's rate is its fitted mass over its tokens; one factor for all rates, found by a few rounds
    over capped cells, makes the expected sample ``budget`` of all tokens. The cells stay a table: sums per value are
    grouped and joined back, each round is written to the shared folder, and only single sums reach the driver.
    """
    spark = rows.sparkSession
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0").withColumn("w", F.col("t")), "cells")
    total = cells.agg(F.sum("t")).first()[0] or 0.0
    for d in DIMENSIONS:
        own = cells.groupBy(d).agg(F.sum("t").alias("s"))
        if d in targets:
            wanted = spark.createDataFrame(list(targets[d].items()), f"`{d}` string, share double")
            own = own.join(F.broadcast(wanted), d, "left").withColumn("raw", F.coalesce("share", F.col("s") / F.lit(total)))
        else:
            own = own.withColumn("raw", F.pow("s", F.lit(temperature)))
        scale = own.agg(F.sum("raw")).first()[0] or 1.0
        cells = stored(cells.join(own.select(d, (F.col("raw") / F.lit(scale) * F.lit(total)).alias(f"goal_{d}")), d), "cells")
    for _ in range(rounds):
        for d in DIMENSIONS:
            sums = cells.groupBy(d).agg(F.sum("w").alias("s"))
            cells = cells.join(sums, d).withColumn("w", F.col("w") * (F.col(f"goal_{d}") / F.col("s"))).drop("s")
        cells = stored(cells, "cells")
    factor = budget
    for _ in range(CAPS):
        capped = F.col("w") * F.lit(factor) >= F.col("t")
        full, rest = cells.agg(F.sum(F.when(capped, F.col("t")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w")))).first()
        if not rest:
            break
        factor = max(factor, (budget * total - full) / rest)
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("w") * F.lit(factor) / F.col("t"))).select(*DIMENSIONS, "probability")


def draw(doc_id: Column) -> Column:
    """Number in [0, 1) fixed by the id: 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def mix(rows: DataFrame, targets: dict[str, dict[str, float]], budget: float = BUDGET) -> DataFrame:
    """``rows`` (of :func:`with_tokens`, other columns may follow) with ``probability`` and ``sampled``.

    Expected token shares meet the targets as long as no cell needs more than its tokens; such cells are taken whole.
    Rows without tokens are in no cell: probability 0, never sampled. NULL source or language is the value ''. Repeated
    rows and rows with one id share a draw. An empty table gives an empty result.
    """
    rates = cell_rates(rows, targets, budget=budget)
    out = rows.join(rates, list(DIMENSIONS), "left").withColumn("probability", F.when(F.col("tokens") > 0, F.col("probability")).otherwise(0.0))
    return out.withColumn("sampled", draw(F.col("doc_id")) < F.col("probability"))


TARGETS = {"lang": LANGUAGES, "topic": TOPICS}


def op1_mixture_raking(spark, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), doc_id="bigint", text="string", source="string", lang="string")
    rows = stored(with_tokens(docs), "tokens")
    return mix(rows, TARGETS).select("doc_id", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled")


def sample_to_targets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sampled documents, with their tokens, topic and probability.

    The draw is fixed by the id, so rows that share an id, or lack one, share a draw, and repeated rows go or stay together. NULL source
    and language are the value ''; texts without tokens are never sampled. All columns come back as they were, whatever their
    names, before ``mix_topic, mix_tokens, mix_probability``; an empty table gives an empty result.
    """
    names = docs.columns
    own = {"doc_id": "bigint", "text": "string", "source": "string", "lang": "string"}
    base = pick(docs, **own)
    rates = cell_rates(stored(with_tokens(base), "tokens"), TARGETS)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    place = {n: F.col(f"c{names.index(n)}").cast(k) if n in names else F.lit(None).cast(k) for n, k in own.items()}
    whole = plain.select("*", *[e.alias(n) for n, e in place.items()])
    told = whole.select("*", topic_of().alias("_topic"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("_tokens"))
    told = told.join(
        rates.select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"), "probability"),
        F.expr("coalesce(source, '') = _s AND coalesce(lang, '') = _l AND _topic = _t"))
    told = told.where((F.col("_tokens") > 0) & (draw(F.col("doc_id")) < F.col("probability")))
    return told.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.col("_topic").alias("mix_topic"),
                       F.col("_tokens").alias("mix_tokens"), F.round("probability", 6).alias("mix_probability"))


def _sql() -> str:
    topic = _TOPIC.format(t="text", has_bar="contains(text, ' | ')", has_law="contains(text, 'icense') OR contains(text, 'rights reserved')",
                          has_signs="contains(text, '###') OR contains(text, '$$$')", has_shout="contains(text, '!! ')")
    ctes = [f"""r AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents)""",
            "c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS t, CAST(sum(tokens) AS DOUBLE) AS w FROM r GROUP BY ALL HAVING sum(tokens) > 0)",
            "tot AS MATERIALIZED (SELECT sum(t) AS total FROM c0)"]
    for d in DIMENSIONS:
        if d in TARGETS:
            case = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in TARGETS[d].items())
            raw = f"CASE {d} {case} ELSE sum(t) / (SELECT total FROM tot) END"
        else:
            raw = f"pow(sum(t), {TEMPERATURE!r})"
        ctes.append(f"g_{d} AS MATERIALIZED (SELECT {d}, raw / sum(raw) OVER () * (SELECT total FROM tot) AS goal FROM (SELECT {d}, {raw} AS raw FROM c0 GROUP BY {d}))")
    n = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT source, lang, topic, t, w * goal / sum(w) OVER (PARTITION BY {d}) AS w FROM c{n} JOIN g_{d} USING ({d}))")
            n += 1
    ctes.append(f"f0 AS (SELECT CAST({BUDGET!r} AS DOUBLE) AS f)")
    for k in range(CAPS):
        ctes.append(f"""f{k + 1} AS MATERIALIZED (SELECT coalesce(greatest(max(f), ({BUDGET!r} * (SELECT total FROM tot) - sum(CASE WHEN w * f >= t THEN t ELSE 0 END))
  / nullif(sum(CASE WHEN w * f >= t THEN 0 ELSE w END), 0)), max(f)) AS f FROM c{n}, f{k})""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, topic, tokens, round(p, 6) AS probability, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < p AS sampled
FROM (SELECT doc_id, topic, tokens, CASE WHEN tokens > 0 THEN least(1.0, w * f / t) ELSE 0 END AS p
      FROM r LEFT JOIN c{n} USING (source, lang, topic) CROSS JOIN f{CAPS})
"""


OP1_SQL = _sql()
