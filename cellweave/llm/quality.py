"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its evidence is a vector of counts of its own and its two
neighbours' letters and words; the chain adds how labels follow each other. Forward and
backward sums give every line's chance to be good, and the document's score is their mean
weighted by length.

The field is fitted on a bounded sample: ``SAMPLE`` labelled rows in hash order and the
first ``SAMPLE_LINES`` lines of each, all of which take the document's label. Scoring reads
all lines of all documents.

Defined cases: null counts as empty, and an empty text is one empty line; labels without
value or without document are ignored, and an id labelled twice is good only if all its
labels say so; without labels of both kinds every line is as likely good as not; repeated rows get
equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, pieces
from .passages import Words

SAMPLE = 4_000
SAMPLE_LINES = 48
PIECE_BYTES = 2 << 20
#: Byte classes: upper case, lower case, digit, white space, sentence signs, other signs, beyond ASCII.
KINDS = 7
KIND = np.full(256, 5, np.int8)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = 0, 1, 2, 6
KIND[[0x20, *range(0x09, 0x0E)]] = 3
KIND[[ord(c) for c in ".,'"]] = 4


def line_table(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the number of lines of each text."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    stop = np.flatnonzero(data == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    n_lines = np.array([t.count(b"\n") + 1 for t in raw], np.int64)
    length = stop - start
    share = np.empty((len(start), KINDS))
    kinds = KIND[data]
    for k in range(KINDS):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        share[:, k] = (total[stop] - total[start]) / np.maximum(length, 1)
    words = Words(data)
    line = np.searchsorted(stop, words.start)
    value = words.hashes(0)
    n_words = np.bincount(line, minlength=len(start))
    again = np.bincount(line[1:][(value[1:] == value[:-1]) & (line[1:] == line[:-1])], minlength=len(start))
    order = np.lexsort((value, line))
    v, own = value[order], line[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (own[1:] != own[:-1])])[:len(v)]
    distinct = np.bincount(own[new], minlength=len(start))
    some = np.maximum(n_words, 1)
    own_table = np.column_stack([
        share, again / some, distinct / some, np.log1p(n_words), np.log1p(length), length / some / 10, n_words == 0,
        np.minimum(share[:, 5] * 5, 1), np.minimum(share[:, 0] * 2, 1)])
    first = np.zeros(len(start), bool)
    first[np.cumsum(n_lines) - n_lines] = True
    last = np.roll(first, -1)
    before, after = np.roll(own_table[:, :9], 1, axis=0), np.roll(own_table[:, :9], -1, axis=0)
    before[first], after[last] = 0, 0
    return np.column_stack([own_table, before, after, first, last]), length, n_lines


@dataclass
class Field:
    """Weights of the evidence for good over bad, its scale, and of label pairs."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    pair: np.ndarray

    def evidence(self, table: np.ndarray) -> np.ndarray:
        return (table - self.mean) / self.scale @ self.weight + self.bias


def log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(evidence: np.ndarray, n_lines: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of good for every line, and the expected number of each label pair over all chains.

    Chains stand one after the other in ``evidence``; all chains move along together.
    """
    begin = np.cumsum(n_lines) - n_lines
    order = np.argsort(-n_lines, kind="stable")
    begin, size = begin[order], n_lines[order]
    steps = int(size.max(initial=0))
    ahead, back = np.zeros((len(evidence), 2)), np.zeros((len(evidence), 2))
    alive = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    for t in range(steps):
        at = begin[:alive[t]] + t
        if t:
            prior = ahead[at - 1]
            ahead[at, 0] = log_sum(prior[:, 0] + pair[0, 0], prior[:, 1] + pair[1, 0])
            ahead[at, 1] = log_sum(prior[:, 0] + pair[0, 1], prior[:, 1] + pair[1, 1])
        ahead[at, 1] += evidence[at]
    for t in range(steps - 2, -1, -1):
        at = begin[:alive[t + 1]] + t
        bad, good = back[at + 1, 0], back[at + 1, 1] + evidence[at + 1]
        back[at, 0] = log_sum(pair[0, 0] + bad, pair[0, 1] + good)
        back[at, 1] = log_sum(pair[1, 0] + bad, pair[1, 1] + good)
    both = ahead + back
    chance = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.ones(len(evidence), bool)
    inner[np.cumsum(n_lines) - 1] = False
    i = np.flatnonzero(inner)
    total = log_sum(both[i, 0], both[i, 1])
    expected = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            expected[a, b] = np.exp(ahead[i, a] + pair[a, b] + back[i + 1, b] + b * evidence[i + 1] - total).sum()
    return chance, expected


def fit(table: np.ndarray, n_lines: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.1) -> Field:
    """Maximum likelihood of the line labels by gradient steps of adaptive size."""
    mean, scale = table.mean(axis=0), np.maximum(table.std(axis=0), 1e-3)
    x = np.column_stack([(table - mean) / scale, np.ones(len(table))])
    y = np.repeat(label, n_lines)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(n_lines) - 1] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inner[:-1]], y[1:][inner[:-1]]), 1)
    w = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        pair = w[-4:].reshape(2, 2)
        chance, expected = marginals(x @ w[:-4], n_lines, pair)
        gradient = np.concatenate([x.T @ (y - chance), (seen - expected).ravel()]) / len(y) - 1e-4 * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient ** 2
        w = w + rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return Field(mean, scale, w[:-5], float(w[-5]), w[-4:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, lines: int = SAMPLE_LINES) -> Field:
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                table, _, n_lines = line_table(part.column("text").to_pylist())
                begin = np.cumsum(n_lines) - n_lines
                blobs = [table[a:a + min(int(n), lines)].astype(np.float32).tobytes() for a, n in zip(begin, n_lines)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(np.minimum(n_lines, lines), pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "label", "n", "lines"])

    found = rows.mapInArrow(features, "doc_id long, label int, n long, lines binary").collect()  # ``size`` rows of bounded length
    found = sorted(found, key=lambda r: (r.doc_id, bytes(r.lines)))
    width = line_table([""])[0].shape[1]
    if len({r.label for r in found}) < 2:
        return Field(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)))
    table = np.concatenate([np.frombuffer(r.lines, np.float32).reshape(-1, width) for r in found]).astype(float)
    return fit(table, np.array([r.n for r in found]), np.array([r.label for r in found]))


def line_quality(docs: DataFrame, model: Field) -> DataFrame:
    """One row per document: doc_id, score, line_scores (the chance of good, line by line)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                table, length, n_lines = line_table(part.column("text").to_pylist())
                chance, _ = marginals(shared.value.evidence(table), n_lines, shared.value.pair)
                begin, weight = np.cumsum(n_lines) - n_lines, np.maximum(length, 1).astype(float)
                score = np.add.reduceat(chance * weight, begin) / np.add.reduceat(weight, begin)
                lines = pa.ListArray.from_arrays(pa.array(np.append(begin, len(chance)), pa.int32()), pa.array(chance))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.clip(score, 0, 1)), lines], ["doc_id", "score", "line_scores"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double, line_scores array<double>")
