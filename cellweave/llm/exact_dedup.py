"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own characters say so, every chunk gets an identifier, and the
ordered list of identifiers (the recipe) stands for the text from then on. Identifiers that
occur more than once are verified against the chunk texts, which are moved once each;
documents themselves are never moved.

Defined cases: null text counts as empty; texts that differ in white space only are equal;
the smallest id of a group stays, and all rows repeated under that id stay with it; rows
without id stay only if no row of their group has one; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, maybe_in, stage

#: A chunk ends after a space that follows one letter of each class, or at the longest length.
CHUNK = r"(?s).{256,8192}?[g-m\x{df}-\x{ff}][a-e] |.{1,8192}"

Identifier = Callable[[Column], Column]
#: Tried in turn until verification finds no two chunk texts under one identifier.
IDENTIFIERS: tuple[Identifier, ...] = (
    lambda chunk: F.unhex(F.md5(chunk)),
    lambda chunk: F.unhex(F.sha2(chunk, 256)),
)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def chunks(text: Column) -> Column:
    """The chunks of a normalised text; joined they give the text again."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """doc_id, text_sha256 and the ordered chunk identifiers of every document."""
    texts = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    return texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform(chunks(F.col("text")), identifier).alias("recipe"))


def clashes(docs: DataFrame, recipe_table: DataFrame, identifier: Identifier) -> DataFrame:
    """Identifiers that stand for more than one chunk text.

    Only chunks whose identifier is repeated can clash; each such text moves once per task.
    """
    repeated = recipe_table.select(F.explode("recipe").alias("id")).groupBy("id").count().where("count > 1").select("id")
    parts = docs.select(F.explode(chunks(normalised(F.col("text")))).alias("chunk")).select(identifier(F.col("chunk")).alias("id"), "chunk")
    texts = maybe_in(parts, F.col("id"), repeated, F.col("id")).distinct()
    return texts.groupBy("id").count().where("count > 1").select("id")


def exact_duplicates(docs: DataFrame, identifiers: Sequence[Identifier] = IDENTIFIERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = docs.select("doc_id", "text")
    for identifier in identifiers:
        table = stage(recipes(docs, identifier), "recipes")
        if clashes(docs, table, identifier).isEmpty():
            break
    else:
        raise ValueError("no identifier tells all chunks apart")
    groups = table.groupBy("recipe").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = stage(groups, "copies")  # Spark can then split the join where a group is large
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    return table.join(groups, "recipe", "left").select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")
