"""Ordered computations and logs against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions.ordered import exact_quantiles, ordinal, previous_value, running
from cellweave.functions import recurrence
from cellweave.functions.recurrence import backward_scan
from cellweave.operators import logs as lg
from cellweave.session import write_stage


def make_log(spark, n_by_episode, seed=3):
    rng = random.Random(seed)
    rows = []
    for e, n in n_by_episode.items():
        for i in range(1, n + 1):
            rows.append((e, i, rng.choice(["add", "replace", "noop"]), rng.randrange(5), f"b{rng.randrange(6)}", rng.random() < 0.7,
                         round(rng.uniform(-1, 1), 3), round(rng.random(), 2), rng.random() < 0.03))
    df = spark.createDataFrame(rows, "episode_id long, step_index long, action string, cell_id long, barcode string, applied boolean, reward double, value_est double, done boolean")
    return rows, df.repartition(7)


def test_running_and_ordinal_on_one_hot_group(spark):
    rows, df = make_log(spark, {1: 900, 2: 30})
    out = {(r.episode_id, r.step_index): r for r in running(df, ["episode_id"], ["step_index"], sums={"s": F.col("reward")}, maxes={"m": F.col("reward")}, rank="k").collect()}
    for e in (1, 2):
        vals = [r[6] for r in rows if r[0] == e]
        assert np.allclose(np.cumsum(vals), [out[(e, i + 1)].s for i in range(len(vals))])
        assert np.allclose(np.maximum.accumulate(vals), [out[(e, i + 1)].m for i in range(len(vals))])
        assert [out[(e, i + 1)].k for i in range(len(vals))] == list(range(1, len(vals) + 1))
    pos = sorted((r.p, r.episode_id, r.step_index) for r in ordinal(df, ["episode_id", "step_index"], "p").collect())
    assert [p for p, *_ in pos] == list(range(930)) and [x[1:] for x in pos] == sorted(x[1:] for x in pos)


def test_previous_value(spark):
    df = spark.createDataFrame([(k, i, float(i * i)) for k in "ab" for i in range(40)], "k string, i int, v double").repartition(5)
    out = {(r.k, r.i): r.p for r in previous_value(df, ["k"], ["i"], "v", "p").collect()}
    assert all(out[(k, i)] == (None if i == 0 else float((i - 1) ** 2)) for k in "ab" for i in range(40))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.integers(0, 9, 200).astype(float), "b": rng.normal(size=31)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    out = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"m": 0.5, "h": 0.9}).collect()}
    for k, vs in data.items():
        assert out[k].m == pytest.approx(np.quantile(vs, 0.5)) and out[k].h == pytest.approx(np.quantile(vs, 0.9))
    whole = exact_quantiles(df, [], "v", {"m": 0.25}).first()
    assert whole.m == pytest.approx(np.quantile(np.concatenate(list(data.values())), 0.25))


@pytest.mark.parametrize("block", [4, 64])
def test_backward_sum_with_and_without_stops(spark, block):
    rows, df = make_log(spark, {1: 150, 2: 7})
    for stop in (None, "done"):
        out = {(r.episode_id, r.step_index): r.g for r in lg.backward_sum(df, ["episode_id"], "step_index", "reward", 0.9, stop, "g", block=block).collect()}
        for e in (1, 2):
            g, want = 0.0, {}
            for r in reversed([r for r in rows if r[0] == e]):
                g = r[6] + (0.0 if stop and r[8] else 0.9 * g)
                want[r[1]] = g
            assert all(out[(e, i)] == pytest.approx(v, abs=1e-9) for i, v in want.items())


def test_advantages_with_lambda_one_are_returns_minus_values(spark):
    df = spark.createDataFrame([(1, i + 1, r, v, False) for i, (r, v) in enumerate(zip((1.0, 2.0, 3.0), (0.5, 0.25, -0.5)))], "episode_id long, step_index long, reward double, value_est double, done boolean")
    ret = {r.step_index: r.discounted_return for r in lg.discounted_returns(df, 0.99).collect()}
    for r in lg.advantages(df, 0.99, 1.0).collect():
        assert r.return_est == pytest.approx(ret[r.step_index]) and r.advantage == pytest.approx(ret[r.step_index] - r.value_est)


def test_advantages_match_a_loop(spark):
    rows, df = make_log(spark, {1: 700, 2: 3, 3: 256})
    for gamma, lam in ((0.99, 0.95), (0.9, 0.0), (0.0, 0.5)):
        out = {(r.episode_id, r.step_index): r for r in lg.advantages(df, gamma, lam).collect()}
        assert len(out) == len(rows)
        for e in (1, 2, 3):
            adv = nxt = 0.0
            for r in reversed([r for r in rows if r[0] == e]):
                live = 0.0 if r[8] else 1.0
                adv = r[6] + gamma * nxt * live - r[7] + gamma * lam * live * adv
                nxt = r[7]
                got = out[(e, r[1])]
                assert got.advantage == pytest.approx(adv, abs=1e-9) and got.return_est == pytest.approx(adv + r[7], abs=1e-9)


def test_backward_scan_of_any_maps(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, rng.uniform(-2, 2)]), rng.choice([None, 0.0, 1.0, -0.5, 1.0e-300, 1.5]))
            for k in (None, "a", "b") for i in range(300) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "k string, i long, a double, m double").repartition(5)
    for chunk in (2, 16, 512):
        out = {(r.k, r.i): (r.h, r.n) for r in backward_scan(df, ["k"], "i", F.col("a"), F.col("m"), "h", "n", chunk=chunk).collect()}
        assert len(out) == len(rows)
        for k in (None, "a", "b"):
            h = 0.0
            for _, i, a, m in reversed([r for r in rows if r[0] == k]):
                n, h = h, (a or 0.0) + (m or 0.0) * h
                assert out[(k, i)] == (pytest.approx(h, rel=1e-9, abs=1e-9), pytest.approx(n, rel=1e-9, abs=1e-9))
    assert backward_scan(df.filter("false"), ["k"], "i", F.col("a"), F.col("m"), "h", "n").count() == 0
    with pytest.raises(ValueError):
        backward_scan(df.withColumn("i", F.col("i") - 9), ["k"], "i", F.col("a"), F.col("m"), "h", "n")


def test_scan_forgets_infinities(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, float("inf"), 1.0), (3, 2.0, 1.0)], "i long, a double, m double")
    assert {r.i: r.h for r in backward_scan(df, [], "i", F.col("a"), F.col("m"), "h", "n").collect()} == {1: 1.0, 2: float("inf"), 3: 2.0}


def test_one_long_episode_fills_all_tasks_evenly(spark, monkeypatch):
    written = []
    monkeypatch.setattr(recurrence, "write_stage", lambda df, label: written.append(write_stage(df, label)) or written[-1])
    df = spark.range(1, 200_001).select(F.lit(1).alias("e"), F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("v"))
    out = lg.backward_sum(df, ["e"], "i", "v", 0.5, None, "g")
    sizes = sorted(r["count"] for r in written[0].groupBy(F.input_file_name()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    assert set(written[0].columns) == {"e", "i", "_chunk", "_add", "_mul", "_next_add", "_next_mul", "_head"}
    got = {r.i: r.g for r in out.filter("i > 199990 or i < 10 or abs(i - 65536) < 3").collect()}
    h = 0.0
    for i in range(200_000, 0, -1):
        h = i % 7 + 0.5 * h
        assert i not in got or got[i] == pytest.approx(h, abs=1e-12)


def test_group_relative(spark):
    df = spark.createDataFrame(list(enumerate((1.0, 3.0, 2.0, 6.0))), "i long, s double")
    out = [r.advantage for r in lg.group_relative(df, "i", "s", 2, 1.0e-6).orderBy("i").collect()]
    assert out == pytest.approx([-0.999999, 0.999999, -0.9999995, 0.9999995], abs=1e-9)
    with pytest.raises(ValueError):
        lg.group_relative(df, "i", "s", 3, 1.0e-6)


def test_early_stopping_matches_a_loop(spark):
    rows, df = make_log(spark, {1: 120, 2: 40})
    out = {(r.episode_id, r.step_index): r for r in lg.early_stopping(df, 4, 0.05, 12).collect()}
    for e in (1, 2):
        vals, best, stale, stop = [], None, 0, None
        for r in [r for r in rows if r[0] == e]:
            vals.append(r[6])
            if len(vals) >= 4:
                ma = float(np.mean(vals[-4:]))
                if best is None or ma > best + 0.05:
                    best, stale = ma, 0
                else:
                    stale += 1
                if stale >= 12 and stop is None:
                    stop = r[1]
            got = out[(e, r[1])]
            assert got.no_improve_count == stale and (got.best_moving_average or 0) == pytest.approx(best or 0)
        assert {out[(e, i + 1)].stop_step for i in range(len(vals))} == {stop}


def test_action_fold_and_replay(spark):
    kinds = [("a", "add"), ("a", "add"), ("b", "remove"), ("a", "remove"), ("b", "add"), ("z", "stop"), ("a", "add")]
    df = spark.createDataFrame([(1, i + 1, b, k) for i, (b, k) in enumerate(kinds)], "episode_id long, step_index long, barcode string, action string")
    member, bad = lg.fold_actions(df)
    assert {r.barcode: r.is_member for r in member.collect()} == {"a": False, "b": True}
    assert sorted(r.step_index for r in bad.collect()) == [2, 3]


def test_streaks(spark):
    rows, df = make_log(spark, {1: 200})
    out = {r.step_index: r.streak for r in lg.streaks(df, F.col("action") == "add").collect()}
    run = 0
    for r in rows:
        run = run + 1 if r[2] == "add" else 0
        assert out[r[1]] == run


def test_null_keys_are_a_group(spark):
    from cellweave.functions import ordered as o
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 4.0), ("a", 1, 3.0)], "g string, i int, v double")
    rows = {(r.g, r.i): (r.s, r.n) for r in o.running(df, ["g"], ["i"], sums={"s": F.col("v")}, rank="n").collect()}
    assert rows == {(None, 1): (2.0, 1), (None, 2): (6.0, 2), ("a", 1): (3.0, 1)}
    before = {(r.g, r.i): r.p for r in o.previous_value(df, ["g"], ["i"], "v", "p").collect()}
    assert before == {(None, 1): None, (None, 2): 2.0, ("a", 1): None}
    assert {(r.g, r.m) for r in o.exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()} == {(None, 3.0), ("a", 3.0)}
