"""Exact copies, near copies, passages, benchmark passages and site lines against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from cellweave.llm.components import components
from cellweave.llm.decontaminate import contaminated_words
from cellweave.llm.exact_dedup import IDENTIFIERS, chunks, exact_duplicates, normalised
from cellweave.llm.line_dedup import without_boilerplate
from cellweave.llm.passages import without_repeats
from cellweave.llm.simhash import near_duplicates

from cases import AWKWARD, LONG, documents

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_copies(rows):
    norm = [WHITE.sub(" ", t or "") for _, t in rows]
    out = []
    for (i, _), t in zip(rows, norm):
        own = [j for (j, _), x in zip(rows, norm) if x == t]
        keep = min((j for j in own if j is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_copies(spark):
    assert sorted_rows(exact_duplicates(documents(spark, AWKWARD))) == brute_copies(AWKWARD)
    assert exact_duplicates(documents(spark, AWKWARD).limit(0)).count() == 0


def test_chunks_join_to_the_text_and_shift_with_it(spark):
    rng = random.Random(4)
    prose = " ".join("".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(9000))
    texts = [prose, "shifted " + prose, LONG, "x" * 20_000, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chunks(normalised(F.col("text"))).alias("c")).collect()
    assert all("".join(r.c) == r.text for r in rows)
    assert len(set(rows[0].c) & set(rows[1].c)) > 0.9 * len(rows[0].c) > 10


def test_identifiers_are_verified(spark):
    weak = lambda c: F.unhex(F.substring(F.md5(c), 1, 1))
    # an identifier only clashes where it is repeated; the next one is then used
    rows = [(i, f"text number {i}") for i in range(40)] + [(50, "text number 3")]
    assert sorted_rows(exact_duplicates(documents(spark, rows), (weak, *IDENTIFIERS))) == brute_copies(rows)
    with pytest.raises(ValueError):
        exact_duplicates(documents(spark, rows), (weak,))


def brute_near(rows, bits=2):
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    fps = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, fps[k], least.get(root(k))) for k, (i, _) in enumerate(rows)), key=repr)


def near_rows(df):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in df.collect()), key=repr)


def edited(rng, words):
    words = list(words)
    for _ in range(rng.randint(0, 2)):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("bucket", [50_000, 4])
def test_near_copies(spark, bucket):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(12)]
    rows = [(1000 + k, edited(rng, base[k % 12])) for k in range(240)] + AWKWARD
    got = near_rows(near_duplicates(documents(spark, rows), bucket=bucket))
    assert got == brute_near(rows)
    assert len({c for _, _, c in got}) < 200


def test_near_copies_of_nothing(spark):
    assert near_duplicates(documents(spark, AWKWARD).limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (100, 300)], "u long, v long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {i: 0 for i in range(1, 61)} | {200: 100, 300: 100}


def brute_passages(rows, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - size + 1):
            if i is not None:
                g = tuple(w[s:s + size])
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - size + 1):
            if i is not None and first[tuple(w[s:s + size])] < i:
                gone.update(range(s, s + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_passages(spark):
    rng = random.Random(6)
    passages = [" ".join(f"p{rng.randrange(300)}" for _ in range(70)) for _ in range(4)]
    rows = [(k, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(80))) + " " + passages[k % 4] + "\n" + passages[(k // 3) % 4]) for k in range(30)]
    # one id with two texts, the same word over and over, and whole repeated rows
    rows += [(7, "other text " + passages[0]), (40, "same " * 200), (41, "same " * 120), (None, passages[0]), (42, passages[1]), (42, passages[1])] + AWKWARD
    for size, anchor in ((50, 20), (12, 4)):
        got = without_repeats(documents(spark, rows), size, anchor).select("doc_id", "n_words", "n_removed", "kept_text")
        assert sorted_rows(got) == brute_passages(rows, size)
    spans = without_repeats(documents(spark, rows)).collect()
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in spans)
    assert all(a.end < b.start for r in spans for a, b in zip(r.spans, r.spans[1:]))
    assert without_repeats(documents(spark, rows).limit(0)).count() == 0


def brute_benchmark(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            wins = {tuple(v[s:s + n]) for s in range(len(v) - n + 1)} if v and item is not None else set()
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in wins:
                    hit.update(range(s, s + n))
                    found.add(item)
        out.append((i, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slice_bytes", [1 << 24, 300])
def test_benchmark_passages(spark, slice_bytes):
    rng = random.Random(7)
    items = [(k, " ".join(f"v{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 3, 7, 10, 11, 25])))) for k in range(24)]
    items += [(3, items[5][1]), (None, "nobody asks this"), (30, None), (31, "a A a a"), (31, "a A a a"), (32, items[5][1])]
    rows = [(k, " ".join(f"v{rng.randrange(60)}" for _ in range(30)) + "! " + (items[k % 24][1].upper() or "") + " tail") for k in range(60)] + AWKWARD + [(70, "a, a; A a a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated_words(documents(spark, rows), bench, slice_bytes=slice_bytes)
    assert sorted(((r.doc_id, r.n_words, list(r.hits), sorted(r["items"])) for r in got.collect()), key=repr) == brute_benchmark(rows, items)
    assert all(not r.hits for r in contaminated_words(documents(spark, rows), bench.limit(0)).collect())
    assert contaminated_words(documents(spark, rows).limit(0), bench).count() == 0


def test_site_lines(spark):
    rows = [(k, f"menu\nstory {k}\n\nfoot {k % 2}", "a" if k < 20 else None) for k in range(30)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "menu\nmenu", "b"), (103, "story 1\nmenu", "a"), (None, "menu", None)]
    got = without_boilerplate(documents(spark, rows), ratio=0.3)
    want = []
    for i, t, s in rows:
        own = [x for _, x, y in rows if y == s]
        n = {line: sum(line in (x or "").split("\n") for x in own if x is not None) for line in (t or "").split("\n")}
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if x == "" or not (n[x] >= 3 and n[x] > 0.3 * len(own))]
        want.append((i, s, len(lines), len(lines) - len(kept), "\n".join(kept) if t is not None else None))
    assert sorted_rows(got) == sorted(want, key=repr)
    assert without_boilerplate(documents(spark, rows).limit(0)).count() == 0
