"""Boilerplate lines by site-relative frequency, in DataFrame operations.

A line is boilerplate on a site when more than ``RATIO`` of the site's pages hold it, and at
least ``PAGES`` pages do. Pages of one text are one page, so that copies of a document can't
make its body boilerplate, and pages count a line once. Lines are first counted as hashes
over all rows, before the exchange, so that neither a large site nor a common line meets in
one task; what rows can't bring over the level, different texts can't either. The few lines
left are counted again over different texts. A site has at most (lines per page) / RATIO such
lines, which go back to its pages as one short list.

Defined cases: null text has no lines and stays null; empty lines are never boilerplate; null
sites form one site; null texts of a site are one page; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

RATIO = 0.01
PAGES = 3
#: Lists are broadcast up to this size in all, measured first; beyond it Spark joins by site.
BROADCAST_BYTES = 8 << 20


def key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(docs: DataFrame, ratio: float, pages: int) -> DataFrame:
    """site and the keys of its boilerplate lines."""
    lines = docs.select("site", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("line <> ''")
    counts = lines.select("site", key(F.col("line")).alias("key")).groupBy("site", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= pages)
    totals = stage(docs.select("site", key(F.col("text")).alias("page")).distinct().groupBy("site").agg(F.count(F.lit(1)).alias("pages")), "site-pages")
    over = lambda n: n.join(totals, n.site.eqNullSafe(totals.site)).where(F.col("n") > ratio * F.col("pages")).select(n.site, "key")
    maybe = stage(over(counts).groupBy("site").agg(F.collect_set("key").alias("maybe")), "frequent-lines")
    joined = docs.where("text is not null").join(short(maybe, "maybe"), docs.site.eqNullSafe(maybe.site))
    held = F.array_intersect(F.transform(F.split("text", "\n"), key), "maybe")
    texts = joined.select(docs.site, key(F.col("text")).alias("page"), held.alias("held")).where(F.size("held") > 0).groupBy("site", "page").agg(F.first("held").alias("held"))
    once = texts.select("site", F.explode("held").alias("key")).groupBy("site", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= pages)
    return over(once).groupBy("site").agg(F.collect_set("key").alias("drops"))


def short(lists: DataFrame, column: str) -> DataFrame:
    """The lists of all sites, broadcast where they are small."""
    size = lists.agg(F.sum(F.size(column) * 24 + F.coalesce(F.octet_length("site"), F.lit(0)) + 48)).first()[0] or 0
    return F.broadcast(lists) if size <= BROADCAST_BYTES else lists


def without_boilerplate(docs: DataFrame, ratio: float = RATIO, pages: int = PAGES, id_column: str = "doc_id", site_column: str = "source") -> DataFrame:
    """One row per page: the id, site, n_lines, n_dropped, kept_text."""
    docs = docs.select(F.col(id_column).alias("id"), F.col(site_column).alias("site"), "text")
    drops = stage(boilerplate(docs, ratio, pages), "boilerplate")
    lines, drop = F.split("text", "\n"), F.coalesce("drops", F.array().cast("array<binary>"))
    joined = docs.join(short(drops, "drops"), docs.site.eqNullSafe(drops.site), "left").select("id", docs.site, "text", drop.alias("drops"))
    kept = F.filter(lines, lambda line: (line == "") | ~F.array_contains(F.col("drops"), key(line)))
    out = joined.select("id", "site", F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select(F.col("id").alias(id_column), F.col("site").alias(site_column), "n_lines",
                      (F.col("n_lines") - F.when(F.col("kept").isNotNull(), F.size("kept")).otherwise(0)).cast("long").alias("n_dropped"),
                      F.array_join("kept", "\n").alias("kept_text"))
