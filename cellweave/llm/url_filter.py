"""URL verdicts by host and path rules, and by gradient-boosted trees where no rule fits.

Trees see lexical features only: lengths, depth, digit share, entropy, parameter counts and
statistics of the host's suffix. The labelled URLs are those that a rule decides; trees and
suffix statistics are fitted on at most ``SAMPLE`` of them, in hash order. Everything runs in
DataFrame expressions and the JVM's tree learner.

Defined cases: null urls and urls without ``://`` have empty host and path and fit no rule;
the longest fitting rule wins; where labelled URLs are all of one kind the trees are replaced
by that verdict, and by "allow" where there are none; repeated rows get equal verdicts; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

SAMPLE = 5_000
TREES, DEPTH = 10, 4
#: (verdict, host/path) of every rule.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
FEATURES = ("url_length", "host_length", "path_length", "query_length", "labels", "depth", "digits", "path_digits", "capitals", "signs", "entropy", "parameters",
            "has_fragment", "secure", "suffix_length", "suffix_rate", "suffix_count")


def located(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    rest = F.when(F.col("url").contains("://"), F.substring_index(F.col("url"), "://", 1))
    after = F.when(rest.isNotNull(), F.expr("substring(url, length(substring_index(url, '://', 1)) + 4)"))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(cw_after, length(cw_host) + 1)"), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (pages.select("page_id", "url").withColumn("cw_after", after).withColumn("cw_host", F.coalesce(host, F.lit("")))
            .select("page_id", "url", F.translate("cw_host", upper, lower).alias("host"), F.coalesce(path, F.lit("")).alias("path")))


def rule_of(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = F.col("path").startswith(slash + path) & ((F.col("host") == host) | F.col("host").endswith("." + host))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def suffix() -> Column:
    return F.regexp_extract("host", r"[^.]*$", 0)


def lexical(pages: DataFrame) -> DataFrame:
    """The features that need no statistics, as doubles."""
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda c, cls: F.length(c) - F.length(F.regexp_replace(c, cls, ""))
    letters = F.filter(F.split(url, ""), lambda c: c != "")
    # distinct characters by how often they occur
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, c: acc - (
        (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / F.length(url)) * F.log2((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / F.length(url)))
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    columns = {
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"), "query_length": F.length(query),
        "labels": count(F.col("host"), "[.]") + 1, "depth": count(F.col("path"), "/"),
        "digits": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)), "path_digits": count(F.col("path"), "[0-9]"),
        "capitals": count(url, "[A-Z]"), "signs": count(url, "[-_%~+]"), "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1), "has_fragment": F.when(url.contains("#"), 1).otherwise(0),
        "secure": F.when(url.startswith("https"), 1).otherwise(0), "suffix_length": F.length(suffix()),
    }
    return pages.select("*", suffix().alias("suffix"), *[c.cast("double").alias(k) for k, c in columns.items()])


def verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, size: int = SAMPLE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (of the trees; null by rule)."""
    rule, decided = rule_of(rules)
    placed = located(pages).select("page_id", "url", "host", "path", rule.alias("rule"), decided.alias("decided"))
    labelled = placed.where("decided is not null")
    sample = stage(labelled.orderBy(F.xxhash64("url"), "page_id").limit(size), "labelled-urls")
    counts = {r["decided"]: r["count"] for r in sample.groupBy("decided").count().collect()}
    if len(counts) < 2:
        score = F.lit(1.0 if "block" in counts else 0.0)
        scored = placed.withColumn("score", score)
    else:
        base = counts["block"] / sum(counts.values())
        # no more suffixes than the sample has rows
        stats = sample.groupBy(suffix().alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("decided") == "block", 1).otherwise(0)).alias("b"))
        stats = stats.select("suffix", ((F.col("b") + 5 * base) / (F.col("n") + 5)).alias("suffix_rate"), F.log1p("n").alias("suffix_count"))

        def features(df: DataFrame) -> DataFrame:
            known = lexical(df).join(F.broadcast(stats), "suffix", "left")
            return known.fillna({"suffix_rate": base, "suffix_count": 0.0}).drop("suffix")

        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="cw_features")
        train = assemble.transform(features(sample)).select("cw_features", F.when(F.col("decided") == "block", 1.0).otherwise(0.0).alias("label"))
        trees = GBTClassifier(featuresCol="cw_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False).fit(train.coalesce(1))
        scored = trees.transform(assemble.transform(features(placed))).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("decided", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
