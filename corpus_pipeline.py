"""From documents to a training mix: the stages in order, each one operator on what the stage before kept.

A stage takes (spark, docs, sf_dir); what it returns is written and reread as the next one's docs. All but the last
return the columns of docs. A null or empty text weighs 0 in the first stage and passes the other filters. Repeated rows are
one group in near_dedup, which keeps one of them. Extra columns, whatever their names, come along until the last stage;
an empty table passes through as such. Long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.decontaminate import find_contamination
from marlstone.llm.minhash import near_duplicates
from marlstone.llm.mixing import mix_sources
from marlstone.llm.quality import select_quality
from marlstone.llm.secrets import redact_secrets
from marlstone.llm.shared import remove, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what importance resampling selects."""
    return select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_row=True).filter("selected").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at five words and a similarity of 0.8."""
    return near_duplicates(docs, keep_row=True).filter("first").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a twentieth or more of benchmark words."""
    return find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_row=True).filter("NOT contaminated").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every document stays."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix_sources(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
        if before is not None:
            remove(spark, before)  # only the last stage's table is read from here on
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
