"""Awkward inputs that every operator has to take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "hits int, items int, fp string, mask int, score string, label string, site int, id int, anchors int, kept string, starts int, cw_word string, text_key int")


def row(doc_id: int | None, text: str | None, source: str | None = "s") -> tuple:
    return (doc_id, text, None, source, None, 1, None, "x", 2, None, "y", 3, 4, None, "z", 5, None, 6)


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([row(*r) for r in rows], SCHEMA)


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
AWKWARD = [
    (5, "a b  c\td"), (3, "a b c d"), (9, "a b c d"), (9, "a b c d"), (None, "a b c d"), (None, "alone without id"),
    (1, None), (2, ""), (4, None), (6, " \n\t "), (7, LONG), (8, LONG), (10, LONG + " end"), (11, "é漢字🙂 " * 30), (12, "\x00\x01 odd \x7f"), (13, "one"), (14, "ONE"),
    (15, "x" * 50_000),
]
