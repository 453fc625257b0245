"""Repeated passages: Rabin-Karp hashes of every window of words, counted in Spark.

A word is removed when a window of 50 words that covers it also starts in a document with a
smaller id. All windows are hashed. What has to be exchanged is first cut down without loss:
equal windows have the same smallest 20-word hash inside them (their anchor), and
neighbouring windows share anchors, so that one anchor stands for about 15 windows. Only
windows whose anchor occurs in two documents or more are then counted, by 128-bit hashes.

Defined cases: null or empty texts have no words; texts shorter than a window lose nothing;
rows without id lose nothing and cause no removal; repeated rows under one id are told apart
by their text, and windows repeated under one id only stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import maybe_in, pieces, stage

WINDOW = 50
ANCHOR = 20
PIECE_BYTES = 2 << 20
U = np.uint64
#: Odd multipliers of the two hashes: for bytes in a word, and for words in a window.
BASES = ((0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4F), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    up, down = np.full(n, base, U), np.full(n, pow(base, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def grown(n: int) -> int:
    return 1 << max(12, int(n).bit_length())


def scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return (h ^ (h >> U(29))) * U(0xFF51AFD7ED558CCD) ^ (h >> U(31))


class Words:
    """Borders of the words of one or more texts laid end to end, and their hashes."""

    def __init__(self, data: np.ndarray):
        space = SPACE[data]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.data = data

    def hashes(self, which: int) -> np.ndarray:
        """Polynomial hash of every word, scrambled with its length."""
        up, down = powers(BASES[which][0], grown(len(self.data) + 1))
        total = np.concatenate([np.zeros(1, U), np.cumsum((self.data.astype(U) + U(1)) * up[:len(self.data)], dtype=U)])
        value = (total[self.end] - total[self.start]) * down[self.start]
        return scrambled(value + (self.end - self.start).astype(U) * U(0x9E3779B97F4A7C15))


def rolling(words: np.ndarray, size: int, which: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = powers(BASES[which][1], grown(len(words) + 1))
    total = np.concatenate([np.zeros(1, U), np.cumsum(words * up[:len(words)], dtype=U)])
    return scrambled((total[size:] - total[:-size]) * down[:n])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    pad = -len(values) % width
    block = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


class Texts:
    """The texts of a piece of a batch: words of all, and the rows they belong to."""

    def __init__(self, column: pa.Array):
        texts = [(t or "").encode() for t in column.to_pylist()]
        self.words = Words(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.first = np.searchsorted(self.words.start, np.cumsum(sizes) - sizes)
        self.count = np.diff(np.append(self.first, len(self.words.start)))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of every window that lies inside one text, and the text's row."""
        n = np.maximum(self.count - size + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[row], row

    def anchors(self, size: int, anchor: int) -> np.ndarray:
        return smallest(rolling(self.words.hashes(0), anchor, 0), size - anchor + 1)


def find_anchors(batches: Iterator[pa.RecordBatch], size: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", PIECE_BYTES):
            texts = Texts(part.column("text"))
            at, row = texts.windows(size)
            if len(at):
                value = texts.anchors(size, anchor)[at]
                new = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(value[new].view(np.int64)), part.column("doc_id").take(pa.array(row[new]))], ["anchor", "doc_id"])


def find_windows(batches: Iterator[pa.RecordBatch], size: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows whose anchor is among the row's ``anchors``."""
    for batch in batches:
        for part in pieces(batch, "text", PIECE_BYTES):
            texts = Texts(part.column("text"))
            at, row = texts.windows(size)
            if not len(at):
                continue
            value = texts.anchors(size, anchor)[at].view(np.int64)
            wanted = part.column("anchors")
            keep = np.zeros(len(at), bool)
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            for i in range(part.num_rows):
                keep[bounds[i]:bounds[i + 1]] = np.isin(value[bounds[i]:bounds[i + 1]], wanted[i].values.to_numpy())
            at, row = at[keep], row[keep]
            if not len(at):
                continue
            one, two = rolling(texts.words.hashes(0), size, 0)[at], rolling(texts.words.hashes(1), size, 1)[at]
            owner = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), part.column("doc_id").take(owner), part.column("text_key").take(owner),
                 pa.array((at - texts.first[row]).astype(np.int32))], ["h1", "h2", "doc_id", "text_key", "at"])


def cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Texts without the words under the windows at ``starts``; windows merge into intervals."""
    for batch in batches:
        for part in pieces(batch, "text", PIECE_BYTES):
            texts = Texts(part.column("text"))
            data, spans, kept, removed = texts.words.data.tobytes(), [], [], []
            for i, starts in enumerate(part.column("starts").to_pylist()):
                begin, end = texts.words.start[texts.first[i]:texts.first[i] + texts.count[i]], texts.words.end[texts.first[i]:texts.first[i] + texts.count[i]]
                keep = np.ones(len(begin), bool)
                own: list[list[int]] = []
                for s in sorted(starts or []):
                    if own and s <= own[-1][1]:
                        own[-1][1] = s + size
                    else:
                        own.append([s, s + size])
                for a, b in own:
                    keep[a:b] = False
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(b" ".join([data[a:b] for a, b in zip(begin[keep].tolist(), end[keep].tolist())]).decode())
                removed.append(int((~keep).sum()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(texts.count, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "kept_text"])


def repeated_windows(docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, text_key, at: windows that also start in a document with a smaller id."""
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    found = stage(docs.mapInArrow(lambda b: find_anchors(b, size, anchor), "anchor long, doc_id long"), "anchors")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    lists = stage(found.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "shared-anchors")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    near = maybe_in(keyed, F.col("doc_id"), lists, F.col("doc_id")).join(lists, "doc_id")
    windows = stage(near.mapInArrow(lambda b: find_windows(b, size, anchor), "h1 long, h2 long, doc_id long, text_key long, at int"), "windows")
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    first = stage(first, "first-ids")  # both sides of the join are then dealt by Spark, which splits what a common passage makes large
    return windows.join(first, ["h1", "h2"]).where("first_id < doc_id").select("doc_id", "text_key", "at")


def without_repeats(docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (of word places), kept_text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    starts = repeated_windows(docs, size, anchor).groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("starts"))
    starts = stage(starts, "repeats")
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    hit = maybe_in(keyed, F.col("doc_id"), starts, F.col("doc_id")).join(starts, ["doc_id", "text_key"], "left")
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string"
    none = F.array().cast("array<int>")
    free = maybe_in(keyed, F.col("doc_id"), starts, F.col("doc_id"), negate=True).withColumn("starts", none)
    return free.unionByName(hit).mapInArrow(lambda b: cut(b, size), schema)

