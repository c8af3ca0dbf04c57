"""A corpus pipeline over ``documents``: five stages, each on all that the stage before kept.

Every stage but the last returns the columns of ``documents``.

Defined results: a null or empty text has no words, so the quality rules reject it;
a null id, language, source or count goes along as it is (null is a source of its
own in the mix); of rows that repeat an id and a text, or are near duplicates, one
stays; texts are read whole, however long; an empty table gives empty results;
columns of other names go along until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landtide.llm import crf_secrets, mixing, pieces, repetition, simhash
from landtide.llm.queries import tokenizer_path
from landtide.llm.store import drop, settle
from landtide.session import reach_workers


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the repetition rules reject go."""
    return repetition.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id."""
    return simhash.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no document goes."""
    return crf_secrets.mask(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources come to their target weights."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document of the mix, and the text that they decode to."""
    return pieces.encode(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("target_mix", target_mix),
    ("tokenize", tokenize),
]

#: Fingerprints, the random field and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written as Parquet and read again."""
    reach_workers(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        after = settle(stage(spark, docs, sf_dir), name)
        if k:
            drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
