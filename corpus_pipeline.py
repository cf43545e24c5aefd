"""The corpus pipeline: from all documents to the tokens of those worth training on.

Each stage reads what the one before it wrote, works on all of it, and returns the columns of
``documents``, the last one the tokens' digests per document.

Defined results: a null text is clean, has no lines, shares the fingerprint of empty texts and has
no tokens; near copies without an id all stay; rows of one id stay or go together; an empty table
gives no rows; further columns of any name are kept as they are until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm import decontaminate, lines, queries, simhash, toxicity
from offerlake.llm.common import bound_batches, table
from offerlake.session import materialize


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return counted(lines.keep_one_of_each(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return simhash.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return queries.token_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("bpe", to_tokens),
]

#: SQL cannot express the trained classifier, the fuzzy lines or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
