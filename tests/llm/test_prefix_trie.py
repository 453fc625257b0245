"""The trie of conversations against a plain count of every prefix."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from math import fmod

import pytest

from cellweave.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, head string, above int, n string, depth string"


def brute(rows):
    """rows: conv_id, turn, role, text."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(fmod(c, 20)), [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[k] for k in kids[p])
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(nodes[p]) if whole[c] == p).encode()).hexdigest() for p in nodes}
    return sorted(((min(v), len(p), min(nodes[p[:-1]]) if p else None, len(v), len(kids[p]), leaves[p], saved[p], ends[p]) for p, v in nodes.items()), key=repr)


def found(spark, rows, container):
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)
    return sorted(map(tuple, prefix_trie(df, container).collect()), key=repr)


@pytest.mark.parametrize("container", [1, 7, 100, 100_000])
def test_trie_is_the_count_of_prefixes(spark, container):
    rng = random.Random(container)
    rows = []
    for c in range(400):
        turns = ["hello there"] * rng.randrange(3) + [rng.choice(["a b", "c", "", None, "d  e\tf"]) for _ in range(rng.randrange(1, 6))]
        rows += [(c, k, rng.choice(["user", "user", None]), t) for k, t in enumerate(turns)]
    rows += [(c, k, "user", f"same {k}") for c in range(400, 900) for k in range(4)]
    rng.shuffle(rows)
    assert found(spark, rows, container) == brute(rows)


def test_awkward_conversations(spark):
    rows = [(None, 0, "user", "no id"), (20, None, "user", "null first"), (20, 0, "user", "then"), (20, 0, None, "tie"), (20, 0, None, "tie"), (21, 5, None, None), (-3, 0, "a", "b"), (-20, 0, "a", "c"), (7, 1, "user", "x" * 50_000)]
    rows += [(100, k, "user", f"turn {k % 3}") for k in range(3000)] + [(101, k, "user", f"turn {k % 3}") for k in range(2990)]
    assert found(spark, rows, 50) == brute(rows)
    assert found(spark, rows[:1], 50) == []
    assert found(spark, rows[1:2], 50) == brute(rows[1:2])
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prefix_of_others_ends_at_a_burst_head(spark):
    rows = [(c, k, "u", t) for c in range(300, 340) for k, t in enumerate(["p", "q", "r"] + [f"s{c}"] * (c % 3))]
    for container in (2, 3, 20):
        assert found(spark, rows, container) == brute(rows)
