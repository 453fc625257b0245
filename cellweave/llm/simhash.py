"""Near duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Documents with one fingerprint are one class from the start. Fingerprints that may link
agree on one of three bit blocks whenever they differ in at most two bits, so each goes to
three buckets; a bucket with too many is divided again by blocks of its remaining bits, and
after two divisions its size has a bound. Inside its buckets a task sorts fingerprints by
Gray rank, builds nodes that hold the bits all their members share, and searches from the
roots: a node adds the differences on the bits it shares beyond its parent, and is left with
all its members as soon as the sum passes the limit, or when the search can add no new link.
Every bucket gives a spanning forest, never its pairs; forests join to components in Spark.

Defined cases: null or empty texts have fingerprint zero and link like any other; texts of
fewer words than a shingle have one shingle; a set bit needs more than half of the shingles;
repeated rows fall into one class; rows without id get the smallest id of their component;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import pieces, stage
from .components import components

SHINGLE = 3
BITS = 2
SEED = 42
#: Buckets above this many fingerprints are divided; tasks search about this many at a time.
BUCKET = 50_000
FAN = 8
U = np.uint64
FULL = (1 << 64) - 1


def blocks(free: int, parts: int) -> list[int]:
    """The bits of ``free`` dealt to ``parts`` masks in runs."""
    bits = [i for i in range(64) if free >> i & 1]
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def levels(limit: int = BITS, depth: int = 3) -> list[dict[int, list[int]]]:
    """Masks a bucket fixes, level by level, and the masks that divide it further."""
    out, open_masks = [], [0]
    for _ in range(depth):
        step = {m: [m | b for b in blocks(FULL & ~m, limit + 1)] for m in open_masks}
        out.append(step)
        open_masks = [m for ms in step.values() for m in ms]
    return out


def fingerprint_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hash64 = xxhash.xxh64_intdigest
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            values, counts = [], []
            for text in part.column("text").to_pylist():
                words = (text or "").encode().lower().split()
                if len(words) <= size:
                    values.append(hash64(b" ".join(words), SEED)) if words else None
                    counts.append(bool(words))
                    continue
                line = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])[:len(ends) - size + 1]
                values.extend([hash64(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1:].tolist())])
                counts.append(len(starts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(majority(np.array(values, U), np.array(counts, np.int64)).view(np.int64))], ["doc_id", "fp"])


def majority(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits set in over half of each run of values; zero for an empty run."""
    out = np.zeros(len(counts), U)
    some = counts > 0
    if not some.any():
        return out
    begin = (np.cumsum(counts) - counts)[some]
    for bit in range(64):
        ones = np.add.reduceat((values >> U(bit) & U(1)).astype(np.int64), begin)
        out[some] |= (2 * ones > counts[some]).astype(U) << U(bit)
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed number."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda b: fingerprint_rows(b, size), "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the Gray sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U(shift)
    return rank


class GrayIndex:
    """Nodes over fingerprints sorted by bucket and Gray rank; one root for each bucket."""

    def __init__(self, fp: np.ndarray, bucket: np.ndarray):
        self.fp = fp
        # a level: pattern and mask of each node, bits beyond its parent's, first child, number of children
        self.levels: list[dict[str, np.ndarray]] = []
        ones, zeros, owner = fp, ~fp, bucket
        while True:
            head = np.concatenate([[True], owner[1:] != owner[:-1]])
            order = np.arange(len(owner)) - np.maximum.accumulate(np.where(head, np.arange(len(owner)), 0))
            first = np.flatnonzero(order % FAN == 0)
            ones, zeros, owner = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first), owner[first]
            self.levels.append({"ones": ones, "mask": ones | zeros, "first": first, "size": np.diff(np.append(first, len(order)))})
            if len(np.unique(owner)) == len(owner):
                break
        self.roots = np.searchsorted(owner, bucket)
        for lower, upper in zip(self.levels, self.levels[1:]):
            lower["extra"] = lower["mask"] & ~np.repeat(upper["mask"], upper["size"])
        self.levels[-1]["extra"] = self.levels[-1]["mask"]

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level, the component all members of a node are in, or -1."""
        low = high = label
        out = []
        for level in self.levels:
            low, high = np.minimum.reduceat(low, level["first"]), np.maximum.reduceat(high, level["first"])
            out.append(np.where(low == high, low, -1))
        return out

    def links(self, query: np.ndarray, label: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) within ``limit`` bits for the rows ``query``, without those in one component already."""
        same = self.uniform(label)
        node, sums, i = self.roots[query], np.zeros(len(query), np.int64), query
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            sums = sums + np.bitwise_count((self.fp[i] ^ level["ones"][node]) & level["extra"][node])
            go = (sums <= limit) & (same[depth][node] != label[i])
            node, sums, i = node[go], sums[go], i[go]
            n = level["size"][node]
            child = np.repeat(level["first"][node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            i, sums, node = np.repeat(i, n), np.repeat(sums, n), child
        near = (np.bitwise_count(self.fp[i] ^ self.fp[node]) <= limit) & (label[i] != label[node])
        return i[near], node[near]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking the components of rows a and b; a label is its smallest row."""
    while True:
        x, y = label[a], label[b]
        open_pairs = x != y
        if not open_pairs.any():
            return label
        a, b, x, y = a[open_pairs], b[open_pairs], x[open_pairs], y[open_pairs]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def forest(fp: np.ndarray, bucket: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of linked members and of the row that stands for their component in the bucket."""
    _, place, size = np.unique(bucket, return_inverse=True, return_counts=True)
    more = size[place] > 1
    fp, bucket = fp[more], place[more]
    if not len(fp):
        return fp, fp
    order = np.lexsort((gray_rank(fp), bucket))
    fp, bucket = fp[order], bucket[order]
    index, label = GrayIndex(fp, bucket), np.arange(len(fp))
    step = 4096
    for start in range(0, len(fp), step):
        label = joined(label, *index.links(np.arange(start, min(start + step, len(fp))), label, limit))
    moved = label != np.arange(len(fp))
    return fp[moved], fp[label[moved]]


def search(batches: Iterator[pa.RecordBatch], limit: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Forests of the buckets of a task, whose rows come sorted by bucket."""
    rest: list[np.ndarray] = []

    def flush(rows: list[np.ndarray], all_of_it: bool) -> tuple[np.ndarray, np.ndarray]:
        table = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        end = len(table)
        if not all_of_it and end:
            end = int(np.flatnonzero((table[:, :2] != table[-1, :2]).any(axis=1)).max(initial=-1)) + 1
        rest[:] = [table[end:]]
        table = table[:end]
        new = np.concatenate([[True], (table[1:, :2] != table[:-1, :2]).any(axis=1)])[:len(table)]
        return forest(table[:, 2].astype(U), np.cumsum(new), limit)

    held = 0
    for batch in batches:
        rest.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "value", "fp")], axis=1))
        held += batch.num_rows
        if held >= at_once:
            u, v = flush(rest, False)
            held = len(rest[0])
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
    u, v = flush(rest, True)
    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def divided(rows: DataFrame, step: dict[int, list[int]]) -> DataFrame:
    """Rows (mask, fp) in the buckets that divide theirs: mask, value, fp."""
    children: Column | None = None
    for mask, parts in step.items():
        value = F.array(*[F.lit(signed(p)).cast("long") for p in parts])
        children = F.when(F.col("mask") == signed(mask), value) if children is None else children.when(F.col("mask") == signed(mask), value)
    out = rows.select(F.explode(children).alias("mask"), "fp")
    return out.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def near_links(distinct: DataFrame, limit: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect what lies within ``limit`` bits; ``distinct`` has column fp."""
    parts, links = levels(limit), None
    rows = distinct.select(F.lit(0).cast("long").alias("mask"), "fp")
    for depth, step in enumerate(parts):
        rows = stage(divided(rows, step), "buckets")
        large = stage(rows.groupBy("mask", "value").count().where(F.col("count") > bucket).select("mask", "value"), "large-buckets")
        last = depth == len(parts) - 1 or large.isEmpty()
        fit = rows if last else rows.join(large, ["mask", "value"], "left_anti")
        sorted_rows = fit.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value")
        found = sorted_rows.mapInArrow(lambda b: search(b, limit, bucket), "u long, v long")
        links = found if links is None else links.union(found)
        if last:
            return links
        rows = rows.join(large, ["mask", "value"], "left_semi").select("mask", "fp")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, limit: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id that links lead to)."""
    table = stage(fingerprints(docs, size), "fingerprints")
    classes = table.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    roots = components(near_links(classes.select("fp"), limit, bucket)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    linked = roots.select("fp").union(roots.select("root")).distinct()
    placed = linked.join(classes, "fp").join(roots, "fp", "left").select("fp", "class_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("class_id").alias("least_id"))
    alone = classes.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("class_id").alias("least_id"))
    # documents without companions need no row; Spark can split the join where a class is large
    by_class = stage(placed.join(least, "root").select("fp", "least_id").union(alone), "classes").withColumn("met", F.lit(True))
    component = F.when(F.col("met"), F.col("least_id")).otherwise(F.col("doc_id"))
    return table.join(by_class, "fp", "left").select("doc_id", "fp", component.alias("component_id"))
