"""The manifest against a plain loop over every node, and the kept states against whole hashes."""

import hashlib
import random
import zlib

import pytest

from cellweave.llm.manifest import Bundle, Parent, manifest

from cases import AWKWARD, SCHEMA, documents


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """Digest at the top, and the siblings (before, after) of every lowest node, level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, k in zip(ways, at):
            run = nodes[k // 16 * 16:k // 16 * 16 + 16]
            way.append((run[:k % 16], run[k % 16 + 1:]))
        at = [k // 16 for k in at]
        nodes = [h(nodes[k:k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], ways


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted([r for r in rows if r[1] == s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in sources}
    sub = {s: climb([leaf(*r) for r in leaves[s]]) for s in sources}
    root, source_ways = climb([sub[s][0] for s in sources])
    out = []
    for s, source_way in zip(sources, source_ways):
        for r, way in zip(leaves[s], sub[s][1]):
            way = way + source_way
            own = leaf(*r)
            folded = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                folded = leaf(*r[:4], "".join([c.lower() if "A" <= c <= "Z" else c for c in r[4]]))
            for before, after in way:
                folded = h([*before, folded, *after])
            out.append((r[0], own, sub[s][0], root, h([x for b, a in way for x in (*b, *a)]), folded, folded == root))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, None: 17, "": 1, "é": 2}, {"a": 700, "b": 257, "c": 256, "d": 5000}, {f"s{k}": 1 + k % 3 for k in range(300)}])
def test_manifest_is_the_plain_tree(spark, sizes):
    rng = random.Random(1)
    ids = list(range(sum(sizes.values())))
    rng.shuffle(ids)
    rows = [(ids.pop(), s, rng.choice(["en", None]), rng.choice([None, 7]), rng.choice(["Some Text", "lower", "Ünï", None])) for s, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(manifest(df.select("text", "n_chars", "lang", "source", "doc_id"))) == brute(rows)


def test_awkward_rows(spark):
    df = documents(spark, [(*r, None if k % 3 == 0 else "s") for k, r in enumerate(AWKWARD)])
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert found(manifest(df)) == brute(rows)
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_kept_states_fold_like_whole_hashes():
    nodes = [h([str(k)]) for k in range(256)]
    parent = Parent(nodes[:16])
    assert all(parent.folded(k, "x") == h([*nodes[:k], "x", *nodes[k + 1:16]]) for k in range(16))
    for count, number, depth in ((1, 0, 0), (2, 0, 1), (16, 0, 1), (17, 0, 2), (256, 0, 2), (1, 3, 2), (40, 3, 2)):
        bundle = Bundle(number, nodes[:count])
        assert len(bundle.levels) == depth
        assert all(bundle.folded(k, nodes[k]) == bundle.top for k in range(count))
