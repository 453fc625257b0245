"""Learning a lexicon where near copies of one toxic text bring many frequent patterns."""

from cellweave.llm import toxicity


def name(n):
    out = ""
    for _ in range(9):
        n = (n * 48271 + 11) % 2147483647
        out += chr(97 + n % 26)
    return out


def test_near_copies_hide_no_insult(spark):
    body = " ".join(name(k) for k in range(900))
    rows = [(k, f"{body} {name(2000 + k)}", 1) for k in range(12)]
    rows += [(100 + k, f"{name(3000 + k)} zorblat {name(4000 + k)}", 1) for k in range(8)]
    rows += [(200 + k, f"{name(5000 + k)} {name(6000 + k)}", 0) for k in range(180)]
    texts = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, label int")
    lexicon = toxicity.learn_lexicon(texts, len(rows), 20)
    assert lexicon.insult("zorblat") > 0
