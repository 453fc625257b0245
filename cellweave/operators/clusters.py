"""K-means of many starts and cluster numbers at once, and silhouettes without pairs.

The centres of all models (cluster number, start) stand side by side, so that one pass over
the rows moves every one of them; a task returns counts and sums for each centre, nothing for
each row. What the driver holds is the centres: starts x the sum of the cluster numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import attach_scalars
from ..session import write_stage

PIECE = 4096
U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(29))


def _uniform(z: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each row, from its values alone: however rows are dealt, it is the same."""
    h = np.full(len(z), salt, U)
    for column in (z + 0.0).T:
        h = _mixed(h * U(0xD6E8FEB86659FD93) + np.ascontiguousarray(column).view(U) + U(1))
    return ((_mixed(h) >> U(11)).astype(float) + 0.5) / 2.0 ** 53


def _squared(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((z * z).sum(1)[:, None] - 2.0 * z @ centres.T + (centres * centres).sum(1)[None, :], 0.0)


def _passes(rows: DataFrame, fn: Callable[[np.ndarray], Iterator[tuple]], names: Sequence[str], schema: str) -> DataFrame:
    """``fn`` over pieces of the matrix ``z``; it yields one tuple of arrays for each piece."""
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                z = np.array(batch.column("z").slice(at, PIECE).to_pylist(), float)
                for arrays in fn(z):
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], list(names))

    return rows.mapInArrow(over, schema)


def _next_seeds(rows: DataFrame, centres: dict[int, np.ndarray], seed: int) -> dict[int, np.ndarray]:
    """One more centre for each model, drawn with weight squared distance, as the winner of an exponential race."""
    def race(z: np.ndarray) -> Iterator[tuple]:
        names, keys, picks = [], [], []
        for m, c in centres.items():
            weight = _squared(z, c).min(1) if len(c) else np.ones(len(z))
            weight[weight < 1.0e-12 * (1.0 + (z * z).sum(1))] = 0.0
            with np.errstate(divide="ignore"):
                key = -np.log(_uniform(z, (seed * 1009 + m) * 1009 + len(c))) / weight
            best = int(np.argmin(key))
            if np.isfinite(key[best]):
                names.append(m), keys.append(key[best]), picks.append(z[best].tolist())
        if names:
            yield names, keys, picks

    won = _passes(rows, race, ("m", "key", "z"), "m long, key double, z array<double>").groupBy("m").agg(F.min_by("z", F.struct("key", "z")).alias("z"))
    return {r.m: np.array(r.z) for r in won.collect()}


def _moved(rows: DataFrame, centres: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """Centres after one pass, and the cost of those before it. Empty clusters keep their centre."""
    ids = list(centres)
    every = np.concatenate([centres[m] for m in ids])
    edges = np.cumsum([0, *[len(centres[m]) for m in ids]])

    def sums(z: np.ndarray) -> Iterator[tuple]:
        d2 = _squared(z, every)
        n, cost, total = np.zeros(len(every)), np.zeros(len(every)), np.zeros(every.shape)
        for lo, hi in zip(edges, edges[1:]):
            label = d2[:, lo:hi].argmin(1)
            n[lo:hi] = np.bincount(label, minlength=hi - lo)
            cost[lo:hi] = np.bincount(label, d2[:, lo:hi].min(1), hi - lo)
            for i in range(z.shape[1]):
                total[lo:hi, i] = np.bincount(label, z[:, i], hi - lo)
        yield np.arange(len(every)), n, cost, total.tolist()

    dims = every.shape[1]
    parts = _passes(rows, sums, ("c", "n", "cost", "s"), "c long, n double, cost double, s array<double>")
    got = parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dims)]).collect()
    moved, cost = every.copy(), np.zeros(len(every))
    for r in got:
        cost[r.c] = r.cost
        if r.n > 0:
            moved[r.c] = [r[f"s{i}"] / r.n for i in range(dims)]
    cut = list(zip(ids, edges, edges[1:]))
    return {m: moved[lo:hi] for m, lo, hi in cut}, {m: float(cost[lo:hi].sum()) for m, lo, hi in cut}


def fit(matrix: DataFrame, ks: Sequence[int], starts: int, seed: int, limit: int = 300, tolerance: float = 1.0e-4) -> dict[int, np.ndarray]:
    """The best centres of ``starts`` seeded runs, by cost, for each number of clusters.

    Rows without ``z`` are passed over. Where there are fewer different rows than clusters, the
    remaining centres repeat the first one and stay empty. No rows give no centres.
    """
    rows = write_stage(matrix.select(F.col("z").cast("array<double>").alias("z")).filter("z is not null"), "kmeans")
    one = rows.first()
    if one is None:
        return {}
    # a model is numbered by its own k and start, so that its seeds don't depend on the other ks
    size = {k * starts + start: k for k in ks for start in range(starts)}
    centres = {m: np.empty((0, len(one.z))) for m in size}
    for step in range(max(size.values())):
        open_ = {m: c for m, c in centres.items() if len(c) == step and size[m] > step}
        new = _next_seeds(rows, open_, seed)
        for m, c in open_.items():
            centres[m] = np.vstack([c, new.get(m, c[0] if len(c) else None)])
    going = dict(centres)
    for _ in range(limit):
        moved, _cost = _moved(rows, going)
        centres |= moved
        going = {m: c for m, c in moved.items() if np.abs(c - going[m]).max() > tolerance}
        if not going:
            break
    cost = _moved(rows, centres)[1]
    best = {k: min((m for m in size if size[m] == k), key=lambda m: (cost[m], m)) for k in ks}
    return {k: centres[m] for k, m in best.items()}


def nearest(z: Column, centres: np.ndarray) -> Column:
    """Number of the nearest centre, the first one on ties; null without ``z``."""
    if len(centres) == 1:
        return F.when(z.isNotNull(), F.lit(0))
    table = F.array(*[F.struct(*[F.lit(float(v)).alias(f"c{i}") for i, v in enumerate(c)], F.lit(j).alias("j")) for j, c in enumerate(centres)])
    distance = lambda c: sum(((z[i] - c[f"c{i}"]) * (z[i] - c[f"c{i}"]) for i in range(centres.shape[1])), F.lit(0.0))
    return F.when(z.isNotNull(), F.array_min(F.transform(table, lambda c: F.struct(distance(c).alias("d"), c["j"].alias("j"))))["j"])


def silhouettes(labelled: DataFrame, dims: int) -> DataFrame:
    """(model, label, n_rows, silhouette_score), the mean silhouette of each cluster over squared distances.

    A row's mean squared distance to a cluster follows from the cluster's size, mean and mean square,
    so no pair is made. Rows alone in their cluster count 0, and so does everything where there is
    one cluster only. Rows without label or ``z`` are left out. All clusters' moments of all models
    are one constant: their number must stay small.
    """
    z = F.col("z")
    rows = labelled.filter("label is not null and z is not null").select("model", "label", "z", sum((z[i] * z[i] for i in range(dims)), F.lit(0.0)).alias("_sq"))
    moments = rows.groupBy("model", "label").agg(F.count("*").alias("n"), F.array(*[F.avg(z[i]) for i in range(dims)]).alias("mean"), F.avg("_sq").alias("sq"))
    packed = moments.agg(F.collect_list(F.struct("model", "label", "n", "mean", "sq")).alias("_all"))
    dot = lambda c: sum((z[i] * c["mean"][i] for i in range(dims)), F.lit(0.0))
    far = F.transform(F.filter("_all", lambda c: c["model"] == F.col("model")), lambda c: F.struct(
        (c["label"] == F.col("label")).alias("own"), c["n"].alias("n"), F.greatest(F.col("_sq") + c["sq"] - 2.0 * dot(c), F.lit(0.0)).alias("d")))
    each = attach_scalars(rows, packed).select("model", "label", far.alias("_far")).select(
        "model", "label", F.filter("_far", lambda c: c["own"])[0].alias("_own"), F.array_min(F.transform(F.filter("_far", lambda c: ~c["own"]), lambda c: c["d"])).alias("_b"))
    a = F.col("_own.d") * F.col("_own.n") / F.greatest(F.col("_own.n") - 1, F.lit(1))
    top = F.greatest(a, F.col("_b"))
    score = F.when((F.col("_own.n") > 1) & F.col("_b").isNotNull() & (top > 0), (F.col("_b") - a) / F.when(top > 0, top)).otherwise(F.lit(0.0))
    return each.groupBy("model", "label").agg(F.count("*").alias("n_rows"), F.avg(score).alias("silhouette_score"))
