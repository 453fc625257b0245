"""Owner timelines: coded, written, read and rebuilt against the replay of the log."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import logs as lg
from cellweave.sources import timeline as tl
from cellweave.sources.patch_documents import documents, read_documents, read_trajectories, write_documents


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(11)
    log = [(e, i, f"b{rng.randrange(5)}", rng.choice([1, 2, 3, None]), rng.random() < 0.7) for e, n in ((1, 41), (2, 8), (3, 1), (5, 20)) for i in range(1, n + 1)]
    initial = [(e, f"b{j}", 90 + j) for e in (1, 2, 4) for j in (0, 3, 7)]
    return (spark.createDataFrame(initial, "episode_id long, barcode string, cell_id long"),
            spark.createDataFrame(log, "episode_id long, step_index long, barcode string, cell_id long, applied boolean").repartition(3))


def as_set(df):
    return sorted((r[0], r[1], r[2] is None, r[2] or 0) for r in df.collect())


@pytest.mark.parametrize("every", [1, 8, 100])
def test_owners_after_any_step(spark, inputs, every, tmp_path):
    initial, log = inputs
    path = str(tmp_path / "lines")
    tl.write_timeline(tl.timeline(initial, log, every), path)
    segments = tl.read_timeline(spark, path)
    longest = segments.agg(F.max(F.size("changes"))).first()[0]
    assert longest <= every
    assert {r.episode_id: r.n for r in segments.groupBy("episode_id").agg(F.count("*").alias("n")).collect()} == {e: -(-n // every) for e, n in ((1, 41), (2, 8), (3, 1), (4, 1), (5, 20))}
    for k in (0, 1, 8, 9, 40, 41, 1000):
        want = lg.owners_at_step(initial, log, k).select("episode_id", "barcode", "cell_id")
        assert as_set(tl.owners_after(segments, k)) == as_set(want)


def test_empty_inputs(spark, inputs):
    initial, log = inputs
    assert tl.timeline(initial.filter("false"), log.filter("false"), 4).count() == 0
    only = tl.timeline(initial, log.filter("false"), 4)
    assert as_set(tl.owners_after(only, 7)) == as_set(initial)


def test_trajectory_in_patch_documents(spark, inputs, tmp_path):
    initial, log = inputs
    named = lambda df: df.withColumn("patch_id", F.concat(F.lit("p"), "episode_id")).drop("episode_id")
    segments = tl.timeline(named(initial), named(log), 8, ["patch_id"])
    ids = spark.createDataFrame([("p1",), ("p2",), ("p9",)], "patch_id string")
    box = [f"{a}_{b}_{c}" for a in ("outer", "core") for b in "xy" for c in ("min", "max")]
    patches = ids.select("patch_id", *[F.lit(0.0).alias(c) for c in box])
    members = ids.select("patch_id", F.lit("core").alias("role"), F.lit(1).alias("cell_id"))
    one = ids.select("patch_id", F.lit(1.0).alias("foreground_iou"))
    docs = documents(patches, members, one, one, one, segments)
    write_documents(docs, str(tmp_path / "docs"))
    read = read_documents(spark, str(tmp_path / "docs"))
    assert {r.patch_id: r.n for r in read.select("patch_id", F.coalesce(F.size("trajectory"), F.lit(-1)).alias("n")).collect()} == {"p1": 6, "p2": 1, "p9": -1}
    for k in (3, 17, 41):
        want = lg.owners_at_step(named(initial), named(log), k, ["patch_id"]).filter("patch_id in ('p1', 'p2')").select("patch_id", "barcode", "cell_id")
        assert as_set(tl.owners_after(read_trajectories(spark, str(tmp_path / "docs")), k, ["patch_id"]).select("patch_id", "barcode", "cell_id")) == as_set(want)
