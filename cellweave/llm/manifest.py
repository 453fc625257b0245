"""A Merkle manifest of a document table, with folding from kept hash states.

Every row is a leaf, the SHA-256 of its fields. The leaves of a source, by doc_id, are the
lowest level of a tree of 16 children a node; the roots of the sources, by source, are the
lowest level of one more such tree. A parent keeps a copy of its hash state before each child
slot, so that a changed child is folded in by resuming the state of its slot with the
replacement and the siblings to its right; what stands left of it is never hashed again.

Two levels are worked on at a time: a bundle is a run of 256 nodes of one source, whatever the
size of the source. Bundles give their tops, tops are bundled again, and once one node is left the
siblings on the way up (a few KB for each bundle of leaves) are joined back downwards. Only the
last step looks at single documents, and it has all it needs in one row for each bundle.

Defined cases: null fields are ``-``; leaves without doc_id come first; rows repeated under one
id stand by leaf digest; rows without source are a source of their own, the first; a source of
one row has its leaf as root, and so has a table of one row; rows without doc_id aren't tampered
with; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import ordinal
from .common import stage

FAN = 16
#: Levels of a bundle; a bundle has at most FAN ** LEVELS nodes.
LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before string, after string>>"


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of the fields, each with its length in bytes before it."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def changed(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Which rows the check tampers with, and what their text becomes."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False)), F.translate(text, UPPER, LOWER)


class Parent:
    """A node with the hash states before each child slot."""

    def __init__(self, children: Sequence[str]):
        state, self.states, self.children = hashlib.sha256(), [], children
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def sides(self, slot: int) -> tuple[str, str]:
        return "".join(self.children[:slot]), "".join(self.children[slot + 1:])

    def folded(self, slot: int, replacement: str) -> str:
        state = self.states[slot].copy()
        state.update((replacement + "".join(self.children[slot + 1:])).encode())
        return state.hexdigest()


class Bundle:
    """The tree over one run of nodes; ``number`` is the run's place among its source's."""

    def __init__(self, number: int, digests: Sequence[str]):
        # a run after the first, or of more than FAN nodes, has neighbours to be joined with two levels up
        depth = LEVELS if number > 0 else next(d for d in range(LEVELS + 1) if FAN ** d >= len(digests))
        self.levels: list[list[Parent]] = []
        for _ in range(depth):
            self.levels.append([Parent(digests[k:k + FAN]) for k in range(0, len(digests), FAN)])
            digests = [p.digest for p in self.levels[-1]]
        self.top = digests[0]

    def path(self, place: int) -> list[tuple[str, str]]:
        """The siblings left and right of a node and of what stands above it in the bundle."""
        return [level[place // FAN ** (k + 1)].sides(place // FAN ** k % FAN) for k, level in enumerate(self.levels)]

    def folded(self, place: int, replacement: str) -> str:
        for level in self.levels:
            replacement = level[place // FAN].folded(place % FAN, replacement)
            place //= FAN
        return replacement


class Way:
    """From the top of a bundle to the root: one kept state for each level."""

    def __init__(self, sides: Sequence[tuple[str, str]]):
        self.steps = [(hashlib.sha256(before.encode()), after) for before, after in sides]
        self.siblings = "".join([before + after for before, after in sides]).encode()

    def folded(self, replacement: str) -> str:
        for kept, after in self.steps:
            state = kept.copy()
            state.update((replacement + after).encode())
            replacement = state.hexdigest()
        return replacement


def top_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops = [Bundle(n, [x["digest"] for x in nodes]).top for n, nodes in zip(batch.column("number").to_pylist(), batch.column("nodes").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("number"), pa.array(tops, pa.string())], ["key", "pos", "digest"])


def path_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in ("key", "number", "nodes")}
            bundle, nodes = Bundle(row["number"], [x["digest"] for x in row["nodes"]]), row["nodes"]
            paths = [[{"before": a, "after": b} for a, b in bundle.path(place)] for place in range(len(nodes))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["key"]] * len(nodes)), pa.array([row["number"]] * len(nodes), pa.int64()), pa.array([x["pos"] for x in nodes], pa.int64()), pa.array(paths, kind)],
                ["key", "number", "pos", "own"])


def bundled(nodes: DataFrame) -> DataFrame:
    """Runs of nodes (key, pos, ...) as rows key, number, nodes."""
    others = [c for c in nodes.columns if c not in ("key", "pos")]
    size = FAN ** LEVELS
    rows = nodes.groupBy("key", F.floor(F.col("pos") / size).cast("long").alias("number"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("pos", *others))).alias("nodes"))


def tops(bundles: DataFrame) -> DataFrame:
    return bundles.select("key", "number", "nodes").mapInArrow(top_rows, "key string, pos long, digest string")


def climbed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last node of each key (key, digest), and the way of every node to it (key, pos, path).

    ``nodes`` (key, pos, digest) is a written table.
    """
    levels: list[DataFrame] = []
    while True:
        bundles = stage(bundled(nodes), "manifest-bundles")
        levels.append(stage(bundles.mapInArrow(path_rows, f"key string, number long, pos long, own {PATH}"), "manifest-paths"))
        nodes = stage(tops(bundles), "manifest-tops")
        if nodes.where("pos > 0").isEmpty():
            break
    way = levels[-1].select("key", "pos", F.col("own").alias("path"))
    for level in reversed(levels[:-1]):
        above = way.select("key", F.col("pos").alias("number"), "path")
        way = level.join(above, ["key", "number"]).select("key", "pos", F.concat("own", "path").alias("path"))
    return nodes.select("key", "digest"), way


def proof_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            nodes = row["nodes"]
            bundle = Bundle(row["number"], [x["digest"] for x in nodes])
            way = Way([(s["before"], s["after"]) for s in row["path"]])
            proofs, folded = [], []
            for place, x in enumerate(nodes):
                proof = hashlib.sha256("".join([a + b for a, b in bundle.path(place)]).encode())
                proof.update(way.siblings)
                proofs.append(proof.hexdigest())
                folded.append(way.folded(bundle.folded(place, x["tampered"] or x["digest"])))
            n = len(nodes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["doc_id"] for x in nodes], pa.int64()), *[pa.array(v, pa.string()) for v in ([x["digest"] for x in nodes], [row["subroot"]] * n, [row["root"]] * n, proofs, folded)]], names)


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    fields = [F.col(c) for c in FIELDS]
    tampered, lowered = changed(F.col("doc_id"), F.col("text"))
    # the key puts null before every source and compares bytes
    leaves = docs.select(*FIELDS).select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf(fields).alias("digest"), F.when(tampered, leaf([*fields[:-1], lowered])).alias("tampered"))
    placed = ordinal(leaves, [F.col("doc_id").asc_nulls_first(), "digest"], "pos", keys=["key"])
    bundles = stage(bundled(placed), "manifest-leaves")
    subroots, ways = climbed(stage(tops(bundles), "manifest-tops"))
    sources = stage(ordinal(subroots.select("key", "digest"), ["key"], "pos").select(F.lit("").alias("key"), "pos", "digest", F.col("key").alias("source_key")), "manifest-sources")
    root, source_ways = climbed(sources.select("key", "pos", "digest"))
    of_source = sources.join(source_ways.drop("key"), "pos").join(root.select("key", F.col("digest").alias("root")), "key").select(
        F.col("source_key").alias("key"), F.col("digest").alias("subroot"), "root", F.col("path").alias("source_path"))
    whole = ways.join(of_source, "key").select("key", F.col("pos").alias("number"), "subroot", "root", F.concat("path", "source_path").alias("path"))
    rows = bundles.join(stage(whole, "manifest-ways"), ["key", "number"])
    found = rows.mapInArrow(proof_rows, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
