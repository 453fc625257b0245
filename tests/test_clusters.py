"""K-means of many starts and silhouettes against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import clusters, shape as sh


def table(spark, z, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(z)], "i long, z array<double>").repartition(parts)


def lloyd(z, k, rng):
    c = z[rng.choice(len(z), k, replace=False)]
    for _ in range(100):
        label = ((z[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([z[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
    return ((z[:, None] - c[None]) ** 2).sum(2).min(1).sum()


def cost(z, c):
    return ((z[:, None] - c[None]) ** 2).sum(2).min(1).sum()


def test_ten_starts_reach_the_best_of_plain_runs(spark):
    rng = np.random.default_rng(4)
    z = np.vstack([rng.normal(m, 0.6, (40, 3)) for m in ((0, 0, 0), (3, 0, 1), (0, 3, 2), (3, 3, 0), (1.5, 1.5, 4))])
    got = clusters.fit(table(spark, z), [2, 5], 10, 7)
    for k in (2, 5):
        best = min(lloyd(z, k, rng) for _ in range(40))
        assert got[k].shape == (k, 3) and cost(z, got[k]) <= best * 1.001
    again = clusters.fit(table(spark, z, 1), [2, 5], 10, 7)
    assert all(np.allclose(got[k], again[k]) for k in got)
    labels = {r.i: r.shape_cluster for r in sh.kmeans_clusters(table(spark, z), 5).collect()}
    want = ((z[:, None] - got[5][None]) ** 2).sum(2).argmin(1)
    assert labels == {i: f"cluster_{j:02d}" for i, j in enumerate(want)}


def test_fewer_different_rows_than_clusters(spark):
    z = np.array([[1.0, 2.0]] * 5 + [[3.0, 2.0]] * 4)
    got = clusters.fit(table(spark, z), [4], 3, 1)[4]
    assert cost(z, got) == pytest.approx(0.0) and len(got) == 4
    assert {r.shape_cluster for r in sh.kmeans_clusters(table(spark, z), 4, n_init=2).collect()} <= {f"cluster_{j:02d}" for j in range(4)}
    none = table(spark, z).filter("false")
    assert clusters.fit(none, [2], 2, 1) == {} and sh.kmeans_clusters(none, 2).count() == 0 and sh.choose_k(none, range(2, 4)).count() == 0
    with_null = table(spark, z).withColumn("z", F.when(F.col("i") > 0, F.col("z")))
    assert [r.shape_cluster for r in sh.kmeans_clusters(with_null, 2, n_init=2).filter("i = 0").collect()] == [None]


def plain_silhouettes(z, label):
    out = []
    for i, l in enumerate(label):
        d = ((z - z[i]) ** 2).sum(1)
        own = label == l
        others = [d[label == o].mean() for o in sorted(set(label)) if o != l]
        if own.sum() == 1 or not others:
            out.append(0.0)
            continue
        a, b = d[own].sum() / (own.sum() - 1), min(others)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.array(out)


def test_silhouettes_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(9)
    z = np.vstack([rng.normal(size=(60, 3)), [[9.0, 9.0, 9.0]]])
    first = np.array(["abc"[i % 3] for i in range(60)] + ["alone"])
    second = np.array(["x"] * 61)
    rows = [(m, str(l), [float(v) for v in row]) for m, labels in ((1, first), (2, second)) for l, row in zip(labels, z)]
    rows += [(1, None, [1.0, 1.0, 1.0]), (1, "a", None)]
    got = {(r.model, r.label): r for r in clusters.silhouettes(spark.createDataFrame(rows, "model int, label string, z array<double>").repartition(4), 3).collect()}
    for m, labels in ((1, first), (2, second)):
        want = plain_silhouettes(z, labels)
        for l in set(labels):
            assert got[(m, l)].n_rows == (labels == l).sum() and got[(m, l)].silhouette_score == pytest.approx(want[labels == l].mean(), abs=1e-9)


def test_choice_follows_the_silhouette(spark):
    rng = np.random.default_rng(2)
    z = np.vstack([rng.normal(10 * m, 0.3, (20, 2)) for m in range(4)])
    scores = {r.n_clusters: (r.rank, r.silhouette_score) for r in sh.choose_k(table(spark, z), range(2, 7)).collect()}
    assert scores[4][0] == 1 and set(scores) == {2, 3, 4, 5, 6}
    label = np.repeat(np.arange(4), 20)
    assert scores[4][1] == pytest.approx(plain_silhouettes(z, label).mean(), abs=1e-9)
