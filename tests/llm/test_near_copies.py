"""Near copies of the pipeline by 5-word shingles against brute force."""

import random

import pytest

import corpus_pipeline
from cellweave.llm.components import components
from cellweave.llm.near_copies import similar_links

from cases import AWKWARD, documents


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return bool(a | b) and 5 * len(a & b) >= 4 * len(a | b)


def brute_removed(rows):
    """Rows that lead to a smaller id over similar pairs."""
    own = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            if similar(a, b) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i for i in root if find(i) != i}


def with_changes(words, n, rng):
    words = list(words)
    for k in rng.sample(range(len(words) // 6), n):
        words[6 * k + 3] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("small", [32, 4])
def test_links_equal_brute_force(spark, small):
    rng = random.Random(11)
    rows = []
    for k in range(24):
        base = [f"b{k}w{rng.randrange(10**6)}" for _ in range(150 + 20 * k)]
        rows += [(1000 + 20 * k + c, with_changes(base, rng.randrange(1 + len(base) // 60), rng)) for c in range(10)]
    rows += [(5000, "Four words of text"), (5001, "four WORDS of  text"), (5002, "four words of another"), (5003, rows[0][1].upper()), (5003, "one id, two texts"), (None, rows[0][1])] + AWKWARD
    got = {r.u for r in components(similar_links(documents(spark, rows), small=small)).collect()}
    assert got == brute_removed(rows) and len(got) > 40
    assert similar_links(documents(spark, rows).limit(0)).count() == 0


def test_large_families_equal_brute_force(spark):
    rng = random.Random(21)
    base, crowd = [f"f{rng.randrange(10**6)}" for _ in range(300)], [f"c{rng.randrange(10**6)}" for _ in range(300)]
    # members are near some others but near no common one
    rows = [(k, with_changes(base, 4, rng)) for k in range(400)]
    # much of the text in common, but no two of them similar
    rows += [(1000 + k, " ".join(crowd[:260] + [f"own{rng.randrange(10**9)}" for _ in range(80)])) for k in range(150)]
    want = brute_removed(rows)
    got = {r.u for r in components(similar_links(documents(spark, rows))).collect()}
    assert len(want) > 380 and got == want


def test_two_clusters_that_touch_in_one_pair(spark):
    rng = random.Random(31)
    base = [f"t{rng.randrange(10**6)}" for _ in range(300)]
    far = [w if k % 100 < 80 else f"far{k}" for k, w in enumerate(base)]
    between = lambda n: " ".join(f if k >= n else b for k, (b, f) in enumerate(zip(base, far)))
    rows = [(k, with_changes(base, 1, rng)) for k in range(60)] + [(100 + k, with_changes(far, 1, rng)) for k in range(60)] + [(500, between(200)), (501, between(100))]
    got = {(r.u, r.v) for r in components(similar_links(documents(spark, rows), small=8, centres=(1, 2))).collect()}
    assert {u for u, _ in got} == brute_removed(rows)


def test_pipeline_stage_removes_what_is_similar_and_nothing_else(spark, tmp_path):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(1, " ".join(base))] + [(10 + k, with_changes(base, 5, rng)) for k in range(8)]
    # one SimHash, as the repeated words outweigh the rest, but not similar
    menu = "home news sport weather " * 200
    rows += [(30 + k, menu + " ".join(f"own{rng.randrange(10**6)}" for _ in range(40))) for k in range(2)]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents(spark, rows), str(tmp_path)).collect()}
    assert kept == {1, 30, 31}
