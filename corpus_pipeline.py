"""Pipeline over ``documents``: toxic documents go, one of each near-duplicate group stays, benchmark passages and
secrets are cut out, and the rest is sampled to the target mixture.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet to the shared folder and read again
as the next one's docs. All but the last return the columns of ``documents``; the last adds ``mix_topic,
mix_tokens, mix_probability``. NULL texts pass the first four stages and are never sampled; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantlytics.llm.common import stored
from plantlytics.llm.decontaminate import cut_benchmark_passages
from plantlytics.llm.mixing import sample_to_targets
from plantlytics.llm.near_dup import keep_one_of_each_group
from plantlytics.llm.secrets import redact_secrets
from plantlytics.llm.toxicity import reject_toxic

STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", keep_one_of_each_group),
    ("benchmark decontamination", cut_benchmark_passages),
    ("secrets", redact_secrets),
    ("mixture", sample_to_targets),
]

#: The learned toxicity score and the near-duplicate components are no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
