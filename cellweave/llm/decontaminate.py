"""Benchmark passages in documents, by a prefix-filtered set join.

Every window of an item (10 consecutive words, or the whole of a shorter item) is a record
whose tokens are its shingles of up to 5 words. Full containment needs all of them, so the
necessary prefix is one shingle: the window's rarest by document frequency, counted over all
documents. A document shingle that meets a prefix gives a candidate place; length and
position bounds discard places that don't fit in the document, and the words of the whole
window are compared there.

The benchmark's word numbers and windows are broadcast in slices of a measured size; more
slices mean more passes inside the same task, never a larger broadcast.

Defined cases: null or empty texts have no words and no hits; items without words or without
id are left out; repeated items count once; an empty benchmark hits nothing; other columns
of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces

WINDOW = 10
SHINGLE = 5
SLICE_BYTES = 16 << 20
#: Bytes that are no part of a word become spaces, A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Stands between documents; folding leaves no such byte in a text.
BORDER = b"\x01"
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Windows:
    """The windows of some items as rows of word numbers, with the items they come from."""

    def __init__(self, items: list[tuple[int, str]], width: int, shingle: int):
        self.shingle = shingle
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            for start in range(max(1, len(ids) - width + 1) if ids else 0):
                owners[tuple(ids[start:start + width])].add(item)
        self.rows = list(owners)
        self.owners = [np.array(sorted(s), np.int64) for s in owners.values()]
        self.prefix: dict[int, tuple[np.ndarray, ...]] = {}

    def keys(self, row: tuple[int, ...]) -> list[tuple[int, int]]:
        """(size, key) of the row's shingles by offset."""
        s = min(self.shingle, len(row))
        table = np.lib.stride_tricks.sliding_window_view(np.array(row, np.int64), s)
        return [(s, int(k)) for k in mixed(table)]

    def all_keys(self) -> dict[int, np.ndarray]:
        found: dict[int, set[int]] = defaultdict(set)
        for row in self.rows:
            for s, k in self.keys(row):
                found[s].add(k)
        return {s: np.array(sorted(v), np.uint64) for s, v in found.items()}

    def choose(self, frequency: dict[tuple[int, int], int]) -> None:
        """Keep of every window its rarest shingle; ties go to the smaller key."""
        entries: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for number, row in enumerate(self.rows):
            keys = self.keys(row)
            offset = min(range(len(keys)), key=lambda o: (frequency.get(keys[o], 0), keys[o][1], o))
            entries[keys[offset][0]].append((keys[offset][1], offset, number))
        for s, rows in entries.items():
            rows.sort()
            cut = np.array([(o, n) for _, o, n in rows], np.int64)
            self.prefix[s] = (np.array([k for k, _, _ in rows], np.uint64), cut[:, 0], cut[:, 1])
        self.lengths = np.array([len(row) for row in self.rows], np.int64)
        self.table = np.full((len(self.rows), int(self.lengths.max(initial=1))), -1, np.int64)
        for number, row in enumerate(self.rows):
            self.table[number, :len(row)] = row


def mixed(table: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row of word numbers."""
    key = np.full(len(table), table.shape[1], np.uint64)
    for column in table.T:
        key = (key ^ (column.astype(np.uint64) + np.uint64(1))) * MIX
        key ^= key >> np.uint64(29)
    return key


def numbered(texts: list[str | None], vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the texts one after the other (-1: not in any item), and their borders."""
    words = (b" " + BORDER + b" ").join([(t or "").encode().translate(FOLD) for t in texts]).split()
    ids = np.fromiter(map(vocab.get, words, repeat(-1)), np.int64, len(words))
    borders = np.array([i for i in np.flatnonzero(ids < 0).tolist() if words[i] == BORDER], np.int64)
    return ids, borders


def shingles_at(ids: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``s`` words in a row are known, and the keys there."""
    known = np.concatenate([[0], np.cumsum(ids >= 0)])
    at = np.flatnonzero(known[s:] - known[:-s] == s) if len(ids) >= s else np.zeros(0, np.int64)
    return at, mixed(ids[at[:, None] + np.arange(s)]) if len(at) else np.zeros(0, np.uint64)


def count_shingles(batches: Iterator[pa.RecordBatch], vocab: dict[bytes, int], keys: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """How many documents hold each shingle of the items."""
    totals = {s: np.zeros(len(k), np.int64) for s, k in keys.items()}
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            ids, borders = numbered(part.column("text").to_pylist(), vocab)
            for s, known in keys.items():
                at, got = shingles_at(ids, s)
                place = np.minimum(np.searchsorted(known, got), len(known) - 1)
                hit = known[place] == got
                once = np.unique(np.stack([np.searchsorted(borders, at[hit]), place[hit]]), axis=1)
                np.add.at(totals[s], once[1], 1)
    for s, known in keys.items():
        some = np.flatnonzero(totals[s])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), s, np.int32)), pa.array(known[some].view(np.int64)), pa.array(totals[s][some])], ["s", "k", "n"])


def places(ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(start, window number) of every window that occurs among the word numbers."""
    starts, numbers = [], []
    for s, (known, offsets, rows) in windows.prefix.items():
        at, got = shingles_at(ids, s)
        low, high = np.searchsorted(known, got), np.searchsorted(known, got, "right")
        n = high - low
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if n.sum() else np.zeros(0, np.int64)
        start, number = np.repeat(at, n) - offsets[entry], rows[entry]
        fits = (start >= 0) & (start + windows.lengths[number] <= len(ids))
        starts.append(start[fits])
        numbers.append(number[fits])
    start, number = np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(numbers or [np.zeros(0, np.int64)])
    same = np.ones(len(start), bool)
    for k in range(windows.table.shape[1] if len(start) else 0):
        want = windows.table[number, k]
        same &= (want < 0) | (ids[np.minimum(start + k, len(ids) - 1)] == want)
    return start[same], number[same]


def mark(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[pa.RecordBatch]:
    """Add the hit places and items of one slice of the benchmark to what earlier slices found."""
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            ids, borders = numbered(part.column("text").to_pylist(), windows.vocab)
            begin = np.concatenate([[0], borders + 1])
            n_words = np.concatenate([borders, [len(ids)]]) - begin
            start, number = places(ids, windows)
            row = np.searchsorted(borders, start)
            hits, items = part.column("hits").to_pylist(), part.column("items").to_pylist()
            for i in np.unique(row).tolist():
                own = row == i
                covered = np.zeros(int(n_words[i]), bool)
                covered[np.array(hits[i], np.int64)] = True
                for a, k in zip((start[own] - begin[i]).tolist(), number[own].tolist()):
                    covered[a:a + int(windows.lengths[k])] = True
                hits[i] = np.flatnonzero(covered).tolist()
                items[i] = np.unique(np.concatenate([np.array(items[i], np.int64), *[windows.owners[k] for k in set(number[own].tolist())]])).tolist()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text"), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))],
                ["doc_id", "text", "n_words", "hits", "items"])


def contaminated_words(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, shingle: int = SHINGLE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, hits (positions of hit words), items (their ids)."""
    spark = docs.sparkSession
    kept = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = kept.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    slices = int(total // slice_bytes) + 1
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<int>").alias("hits"), F.array().cast("array<long>").alias("items"))
    texts = docs.select("text")
    for number in range(slices):
        part = kept.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == number).collect()
        windows = Windows([(r.item_id, r.text) for r in part], width, shingle)
        shared = spark.sparkContext.broadcast((windows.vocab, windows.all_keys()))
        counts = texts.mapInArrow(lambda b, x=shared: count_shingles(b, *x.value), "s int, k long, n long")
        rows = counts.groupBy("s", "k").agg(F.sum("n").alias("n")).collect()  # no more than the slice has shingles
        windows.choose({(r.s, r.k & 0xFFFFFFFFFFFFFFFF): r.n for r in rows})
        index = spark.sparkContext.broadcast(windows)
        out = out.mapInArrow(lambda b, x=index: mark(b, x.value), "doc_id long, text string, n_words long, hits array<int>, items array<long>")
    return out.select("doc_id", "n_words", "hits", "items")
