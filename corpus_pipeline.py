"""From raw documents to token ids: the stages of one corpus run.

Every stage but the last returns the columns of ``documents`` for the rows it keeps. Rows
without doc_id pass the deduplication and benchmark stages, whose decisions name ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellweave.llm import bpe, toxicity as grammar
from cellweave.llm.common import stage, table, without
from cellweave.llm.components import components
from cellweave.llm.decontaminate import contaminated_words
from cellweave.llm.exact_dedup import exact_duplicates
from cellweave.llm.near_copies import similar_links
from cellweave.llm.simhash import near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOXIC = 0.5
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = grammar.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(grammar.score_of(F.col("text"), model) < TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, exact_duplicates(docs).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is similar by 5-word shingles; SimHash companions are candidates like those of shared keys."""
    companions = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    return without(docs, components(similar_links(docs, companions)).select(F.col("u").alias("doc_id")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, contaminated_words(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") > 0))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated), ("bpe", to_tokens),
]
#: Scores, components and merges have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
