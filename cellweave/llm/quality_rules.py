"""Quality rules: a table of thresholds compiled into one projection.

A rule is a named ratio of measured counts with the least and greatest value it may have.
``compiled`` turns a table of rules into one boolean column, and ``judged`` selects counts,
ratios and verdict of every document in one pass of built-in functions, without user functions
and without an exchange. Counts are made once from the words and lines of the whole text.

The thresholds of ``RULES`` lie in gaps measured on the labelled rows of sf0.1 that pass the base
rule: good rows have no symbols, bad ones 0.32 a word at least or under 13 % function words of
the four languages, where good rows have 12 to 39 % (the rule asks for 2 %).

Defined cases: null text has no words and counts 0; an empty text and one of white space too;
such texts fail the base rule; rows without doc_id and repeated rows are judged like others; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE

SPACES = " \t\n\x0b\x0c\r"
NON_WHITE = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
CAPITAL_WORD = r"\p{Lu}{2}" + NON_WHITE + "*"
LETTER_WORD = r"\p{L}" + NON_WHITE + "*"
LIST_LINE = r"^[\x20\x09]*(?:[-*•>|]|[0-9]+[.)])[\x20\x09]"
CUT_LINE = r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"
#: Words of a window whose repetition counts.
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 0.5

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "a", "to", "in", "is", "that", "it", "for", "was", "on", "are", "with", "as", "at", "be", "this", "by", "from", "or", "an", "not",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch",
    "le", "la", "les", "et", "des", "un", "une", "du", "dans", "est", "que", "pour", "qui", "sur", "pas", "plus", "par", "au", "de",
    "el", "los", "las", "y", "en", "por", "con", "una", "su", "para", "es", "al", "lo", "como", "más", "del", "se",
)


class Rule(NamedTuple):
    """``part`` over ``whole`` (named counts) has to lie within ``least`` and ``most``."""
    name: str
    part: str
    whole: str
    least: float
    most: float


RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.15),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.02, 1.0),
    Rule("capital_word_share", "n_capital_words", "n_words", 0.0, 0.5),
    Rule("letter_word_share", "n_letter_words", "n_words", 0.7, 1.0),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", 0.0, 0.6),
    Rule("list_line_share", "n_list_lines", "n_lines", 0.0, 0.9),
    Rule("cut_line_share", "n_cut_lines", "n_lines", 0.0, 0.5),
)


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE))


def counts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and every count that a rule may name, as longs."""
    # each step names arrays that the next one reads more than once, so they are made once
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = texts.select("doc_id", "text", words_of(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(NON_WHITE)).alias("ls"))
    n = F.size("w")
    starts = F.slice("w", 1, F.greatest(n - WINDOW + 1, F.lit(0)))
    parts = parts.select("doc_id", "text", "w", "ls", F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get("w", i + k) for k in range(1, WINDOW)])).alias("gs"))
    # sorted with their places only where some window is repeated
    placed = F.sort_array(F.transform("gs", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    parts = parts.select("doc_id", "text", "w", "ls", F.when(F.size("gs") > F.size(F.array_distinct("gs")), placed).alias("s"))
    twins = F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s") - 1), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    repeated = F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda i: F.array(*[i + k for k in range(WINDOW)])))))
    some = lambda array, test: F.size(F.filter(array, test))
    matches = lambda pattern: F.regexp_count("text", F.lit(pattern))
    named = {
        "n_words": n,
        "word_chars": F.length(F.array_join("w", "")),
        "n_symbols": matches(SYMBOL),
        "n_dup_lines": F.size("ls") - F.size(F.array_distinct("ls")),
        "n_repeat_words": F.when(F.col("s").isNotNull(), covered).otherwise(0),
        "n_lines": F.size("ls"),
        "n_stop_words": some("w", lambda x: x.isin(*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS])),
        "n_capital_words": matches(CAPITAL_WORD),
        "n_letter_words": matches(LETTER_WORD),
        "n_list_lines": some("ls", lambda x: x.rlike(LIST_LINE)),
        "n_cut_lines": some("ls", lambda x: x.rlike(CUT_LINE)),
    }
    return parts.select("doc_id", *[c.cast("long").alias(k) for k, c in named.items()])


def ratio(rule: Rule) -> Column:
    """Null where the whole is nothing."""
    return F.col(rule.part) / F.nullif(F.col(rule.whole), F.lit(0))


def compiled(rules: Sequence[Rule]) -> Column:
    """Whether every rule holds; a rule without a whole holds."""
    held = [F.coalesce(ratio(r).between(r.least, r.most), F.lit(True)) for r in rules]
    return reduce(lambda a, b: a & b, held, F.lit(True))


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, least_words: int = LEAST_WORDS, most_repeated: float = MOST_REPEATED) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept and a column for each ratio."""
    base_failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > F.col("n_words") * F.lit(most_repeated))
    return counts(docs).select("*", *[ratio(r).alias(r.name) for r in rules], base_failed.alias("base_failed"), (~base_failed & compiled(rules)).alias("kept"))
