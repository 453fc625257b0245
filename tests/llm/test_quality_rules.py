"""Counts and verdicts of the quality rules against a plain loop."""

import random
import re

from cellweave.llm.quality_rules import RULES, Rule, compiled, judged

from cases import AWKWARD, SCHEMA, documents


def brute(doc_id, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(3)
    vocabulary = ["the", "of", "word", "and", "é漢", "🙂", "x#", "a|b", "\x00", "Ünder", "NO"]
    out = [" ".join(rng.choice(vocabulary[:k]) for _ in range(n)) for k in (1, 2, 4, 11) for n in (1, 2, 3, 4, 49, 50, 51, 400)]
    return out + ["\n".join(rng.choice(["one line", "two", " ", "", "one line\r", "...", "- item"]) for _ in range(60)) for _ in range(5)] + ["a b c x a b c", "\x0b\x0c a\x0bb \r\n", "a b c"]


def test_counts(spark):
    rows = [*AWKWARD, *[(100 + k, t) for k, t in enumerate(texts())]]
    found = judged(documents(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted([tuple(r)[:-1] for r in found], key=repr) == sorted([brute(*r) for r in rows], key=repr)
    assert not any(r.kept and r.base_failed for r in found)
    assert judged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_rule_decides_and_prose_stays(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    clean = "\n".join(f"In year {k} the {word()} of {word()} and {word()} came to {word()} with {word()} {k * 7} for {word()}." for k in range(12))
    bad = {
        "symbols_per_word": clean.replace(" ", "# "), "stop_word_share": re.sub(r"(?m)\S+", lambda m: m[0][::-1] + "q", clean), "capital_word_share": clean.upper(),
        "letter_word_share": " ".join(f"{k}" for k in range(200)) + " " + clean, "mean_word_length": re.sub(r"\S+", lambda m: m[0] + "abcdefghijklmnop", clean) + " the of and" * 2,
        "list_line_share": "\n".join("- " + x for x in clean.split("\n")), "cut_line_share": clean.replace("\n", "...\n") + "...",
        "duplicate_line_share": clean + "\nshort" * 40,
    }
    rows = {r.doc_id: r for r in judged(documents(spark, [(0, clean), *[(k, t) for k, t in enumerate(bad.values(), 1)]])).collect()}
    assert rows[0].kept
    rules = {r.name: r for r in RULES}
    for k, name in enumerate(bad, 1):
        assert not rules[name].least <= rows[k][name] <= rules[name].most, name
        assert not rows[k].kept


def test_table_of_rules_is_one_condition(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (1, 0)], "a long, b long")
    rule = compiled([Rule("x", "a", "b", 0.0, 1.0)])
    assert [r.k for r in df.select(rule.alias("k")).collect()] == [True, False, True]
