"""Page text, quality, toxicity, URL verdicts, token ids and the pipeline."""

import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from cellweave.llm import bpe, quality, toxicity
from cellweave.llm.html_text import extract, main_text
from cellweave.llm.queries import ORACLES, QUERIES
from cellweave.llm.url_filter import RULES, verdicts

from cases import AWKWARD, LONG, documents

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
NO_LABELS = "doc_id long, quality int, toxic int"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="with-sidebar">
<header><p>Site name</p></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies, many of them, on this very long line of text here.</div>
%s<div id="comments"><p>A reader says a lot of things about this story, at great length.</p></div><aside>More</aside><form><p>Mail me</p></form><footer>&copy; site</footer></body></html>"""


@pytest.mark.parametrize("open_tag,close_tag", [("<article>", "</article>"), ('<div id="content">', "</div>"), ("<main>", "")])
def test_page_text(open_tag, close_tag):
    body = f"{open_tag}<h1>A title of some length for the story told here</h1><p><b>First &amp; best\n  paragraph, caf&eacute;.<br><p class=x>Second <a href='y'>linked</a> one.</p><!-- <p>hidden</p> --><div class='ad'>Buy</div><p>Third.{close_tag}"
    assert main_text(PAGE % body) == "A title of some length for the story told here\nFirst & best paragraph, café.\nSecond linked one.\nThird."


def test_odd_pages(spark):
    for page in (None, "", "<", "<p", "<p class='x", "<script>never closed", "&am", "<article></article>"):
        assert main_text(page) in ("", "&am")
    rows = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<article><p>x</p>", "t"), (2, "u", "<article><p>" + "word " * 200_000, "t"), (2, "u", "", "t")], "page_id long, url string, html string, text string")
    got = {(r.page_id, len(r.text)) for r in extract(rows).collect()}
    assert got == {(1, 0), (None, 1), (2, 999_999), (2, 0)}
    assert extract(rows.limit(0)).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    pair, sizes = rng.normal(size=(2, 2)), [3, 1, 4]
    evidence = rng.normal(size=sum(sizes))
    chance, expected = quality.marginals(evidence, np.array(sizes), pair)
    at, total = 0, np.zeros((2, 2))
    for n in sizes:
        weight, good, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2 ** n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(evidence[at + k] for k in range(n) if y[k]) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            weight += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w
        assert np.allclose(chance[at:at + n], good / weight)
        total += pairs / weight
        at += n
    assert np.allclose(expected, total)


def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(300):
        toxic, bad = k % 4 == 0, k % 3 == 0
        words = [f"word{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(40)]
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["rotter", "blagnut" + rng.choice("abcdef"), "nitwit"])
        text = " ".join(words[:20]) + ".\n" + " ".join(words[20:]) + "."
        rows.append((k, text.upper().replace(" ", "!! ") if bad else text))
        labels.append((k, int(not bad), int(toxic)))
    return documents(spark, rows + [(None, "no id")]), spark.createDataFrame(labels + [(5, None, None), (None, 1, 1), (9999, 0, 1)], NO_LABELS)


def test_quality_and_toxicity_learn(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.where("quality is not null").collect()}
    good = quality.line_quality(docs, quality.train(docs, labels)).where("doc_id is not null").collect()
    assert np.mean([(r.score >= 0.3) == (truth[r.doc_id].quality == 1) for r in good]) > 0.99
    model = toxicity.train(docs, labels)
    assert any("blagnut".startswith(s) for s in model.lexicon.stems)
    harm = toxicity.toxicity(docs, model).where("doc_id is not null").collect()
    assert np.mean([(r.score >= 0.5) == (truth[r.doc_id].toxic == 1) for r in harm]) > 0.98
    assert docs.where("doc_id is not null").count() == len(harm)


def test_classifiers_take_anything(spark):
    docs, labels = labelled(spark)
    odd, none = documents(spark, AWKWARD), spark.createDataFrame([], NO_LABELS)
    for known in (labels, none):
        for make in (lambda d, m: quality.line_quality(d, m), lambda d, m: toxicity.toxicity(d, m)):
            model = quality.train(docs, known) if make(docs, quality.train(docs, none)) is None else None
        q, t = quality.train(docs, known), toxicity.train(docs, known)
        for scored in (quality.line_quality(odd, q), toxicity.toxicity(odd, t)):
            rows = scored.collect()
            assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
        assert quality.line_quality(odd.limit(0), q).count() == toxicity.toxicity(odd.limit(0), t).count() == 0


def test_grammar():
    lexicon = toxicity.Lexicon({"fool": 4.0}, {"nitw": 3.0})
    weight = lambda text: toxicity.text_weight(text, lexicon)
    assert weight("a fool") == 4.0 == weight("fool fool fool")
    assert weight("not a fool") < weight("fool") < weight("you fool")
    assert weight("they said a fool") < weight("fool") and weight("they said. a fool") == weight("fool")
    assert weight("nitwitted fool") == 7.0
    assert weight("i will kill you") == toxicity.THREATENED and weight("i will kill time") == 0 == weight("you will not kill you")


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for what, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (what, rule)
    return host, path, best and best[1], best and best[0]


URLS = [None, "", "no scheme", "http://", "http://org", "http://ORG/", "https://a.example.org/es/1", "https://example.org/en/12?x=1#y", "http://xexample.org/en/1", "http://b.com/fr/", "http://b.com/de/a",
        "http://b.com?/fr/", "ftp://x.net/en/1://org/", "http://x.org#/a", "http://b.com/DE/", "http://É.com/de/", "http://a.com/fr"] + [f"http://h{k % 7}.{s}/{p}/{k}" for k in range(60) for s in ("com", "org", "net") for p in ("fr", "de", "en")]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(URLS)] + [(None, None, None, None), (3, "http://org/", None, None)], "page_id long, url string, host string, path string")
    got = verdicts(pages).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.page_id is not None and r.page_id != 3:
            host, path, rule, verdict = brute_rule(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
            assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    # the trees have learned what the rules say of paths
    rate = [r.verdict == ("block" if "/de/" in URLS[r.page_id] else "allow") for r in got if r.page_id is not None and ".net/fr" in (URLS[r.page_id] or "")]
    assert rate and np.mean(rate) > 0.5
    assert verdicts(pages.limit(0)).count() == 0
    assert {r.verdict for r in verdicts(pages.where("url like 'http://h1.org%' or url like '%net/en%'")).collect()} == {"allow"}


def test_tokens_equal_the_library(spark):
    tok = tokenizers.Tokenizer.from_file(VOCABULARY)
    tok.no_truncation()
    tok.no_padding()
    rng = random.Random(9)
    letters = "etaoinshrdlu" * 3 + "bcfgjkmpqvwxyz0123456789.,'!?#éßñüœ中文字🙂\n ΣΑ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["<|endoftext|>a<|startoftext|> b<|endoftext", "I'M don't they'll 've", "aaaaaaaaaaaa" * 30, "ΑΣ ΣΑΣ", "İ", None] + [t for _, t in AWKWARD]
    got = {r.doc_id: r for r in bpe.encode(documents(spark, list(enumerate(texts))), VOCABULARY).collect()}
    for k, text in enumerate(texts):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids and got[k].n_tokens == len(ids), ascii(text)
        assert got[k].decoded == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode(documents(spark, AWKWARD).limit(0), VOCABULARY).count() == 0


def test_pipeline(spark, tmp_path):
    docs, labels = labelled(spark)
    rng = random.Random(10)
    item = " ".join(f"bench{rng.randrange(99)}" for _ in range(14))
    base = [f"w{rng.randrange(4000)}" for _ in range(900)]
    near = base[:-1] + ["changed"]
    extra = [(1001, " ".join(base)), (1002, "  ".join(base)), (1003, " ".join(near)), (1004, "intro " + item + " outro"), (1005, "a rotter and a nitwit"), (1006, LONG), (1007, None), (1008, "")]
    docs.union(documents(spark, extra)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        f(spark, step, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "bpe" or step.columns == columns
    ids = {r.doc_id for r in step.collect()}
    assert {1001, 1006, 1007} <= ids and not {1002, 1004, 1005, 1008} & ids
    toxic = {r.doc_id for r in labels.where("toxic = 1 and doc_id < 1000").collect()}
    assert len(toxic & ids) <= 2 and None in ids
    assert ids == {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}


def test_registered_queries():
    numbers = sorted(int(k[2:].split("_")[0]) for k in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
