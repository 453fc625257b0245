"""Action logs: returns, advantages, running statistics and replays.

An episode can be any length, so nothing here sorts a whole episode in one task: running
values use ordered range blocks, recurrences compose affine maps chunk by chunk, and "last
action before" questions are max-by aggregates. What is written holds keys, order and the
values asked for, not the whole log.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ordered import BLOCK, previous_value, running, with_halo
from ..functions.recurrence import CHUNK, backward_scan
from ..functions.stats import zscore_shifted
from ..session import write_stage

STEP_BLOCK = 256


def backward_sum(log: DataFrame, keys: Sequence[str], index: str, value: str, factor: float, stop: str | None, out: str, block: int = CHUNK) -> DataFrame:
    """(keys, index, ``out``): G_t = value_t + factor * G_(t+1), restarting after rows where ``stop`` is true."""
    kept = F.lit(float(factor))
    mul = F.when(F.col(stop), F.lit(0.0)).otherwise(kept) if stop else kept
    return backward_scan(log, keys, index, F.col(value), mul, out, "_after", chunk=block).drop("_after")


RewardFunction = Callable[[DataFrame], Column]


def zero_reward(log: DataFrame) -> Column:
    return F.lit(0.0)


def with_rewards(log: DataFrame, reward: RewardFunction = zero_reward, out: str = "reward") -> DataFrame:
    """Attach the reward of every transition; any expression over the log's columns can be the reward."""
    return log.withColumn(out, reward(log))


def discounted_returns(log: DataFrame, gamma: float, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    return backward_sum(log, keys, "step_index", "reward", gamma, None, "discounted_return")


def advantages(log: DataFrame, gamma: float, lam: float, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """(keys, step_index, reward, value_est, ``advantage``, ``return_est``), generalised advantages and returns.

    With X_t = (1 - lam) * value_t + lam * return_t, the return is reward_t + gamma * X_(t+1) and X
    itself follows an affine recurrence, so that the next step's value needs no look-up of its own.
    """
    live = F.when(F.col("done"), F.lit(0.0)).otherwise(F.lit(float(gamma)))
    mixed = (1.0 - lam) * F.col("value_est") + lam * F.col("reward")
    out = backward_scan(log, keys, "step_index", mixed, lam * live, "_mixed", "_after", carry=["reward", "value_est", "done"])
    out = out.withColumn("return_est", F.col("reward") + F.when(F.col("done"), F.lit(0.0)).otherwise(gamma * F.col("_after")))
    return out.select(*keys, "step_index", "reward", "value_est", (F.col("return_est") - F.col("value_est")).alias("advantage"), "return_est")


def group_relative(scores: DataFrame, index: str, value: str, group_size: int, eps: float) -> DataFrame:
    """Standardise within consecutive fixed-size groups; an incomplete last group is an error."""
    if scores.count() % group_size:
        raise ValueError("row count must be a multiple of the group size")
    g = scores.withColumn("group_id", F.floor(F.col(index) / group_size).cast("long"))
    stats = g.groupBy("group_id").agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return g.join(stats, "group_id").withColumn("advantage", zscore_shifted(F.col(value), F.col("_m"), F.col("_s"), eps)).drop("_m", "_s")


def cumulative(log: DataFrame, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """(keys, step_index) with running reward and applied / rejected counts."""
    return running(log, keys, ["step_index"], keep=(), sums={
        "cumulative_reward": F.col("reward"), "n_applied": F.col("applied").cast("long"), "n_rejected": (~F.col("applied")).cast("long")})


def moving_average(log: DataFrame, value: str, n: int, out: str, keys: Sequence[str] = ("episode_id",), block: int = STEP_BLOCK) -> DataFrame:
    """Mean of the last ``n`` rows, null until ``n`` exist; blocks carry a copy of the rows before them."""
    cut = with_halo(log, "step_index", block, n - 1)
    w = Window.partitionBy(*keys, BLOCK).orderBy("step_index").rowsBetween(-(n - 1), 0)
    mean = F.when(F.count(value).over(w) == n, F.avg(value).over(w))
    return cut.withColumn(out, mean).filter("not _halo").select(*log.columns, out)


def improvements(log: DataFrame, value: str, min_gain: float, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Steps at which a sticky best is replaced: value > best + ``min_gain``.

    Only new running maxima can replace it. For each of those the next replacing maximum
    is one ordered lookup; the chain from the first maximum is then followed by doubling
    the jump length, so the number of rounds is logarithmic in the chain.
    """
    keys = list(keys)
    peaks = running(log.filter(F.col(value).isNotNull()).select(*keys, "step_index", value), keys, ["step_index"], maxes={"_top": F.col(value)})
    records = write_stage(peaks.groupBy(*keys, "_top").agg(F.min("step_index").alias("i")), "records")
    looks = records.select(*keys, F.col("_top").alias("v"), "i", F.lit(1).alias("kind")).unionByName(
        records.select(*keys, (F.col("_top") + min_gain).alias("v"), "i", F.lit(0).alias("kind")))
    seen = running(looks.withColumn("_neg", -F.col("v")), keys, ["_neg", "kind", "i"], maxes={"_next": F.when(F.col("kind") == 1, -F.col("i"))})
    jump = write_stage(seen.filter("kind = 0 and _next is not null").select(*keys, "i", (-F.col("_next")).alias("j")), "jump")
    reached = records.groupBy(*keys).agg(F.min("i").alias("i"))
    while jump.limit(1).count():
        reached = write_stage(reached.union(reached.join(jump, [*keys, "i"]).select(*keys, F.col("j").alias("i"))), "reached")
        far = jump.select(*keys, F.col("i").alias("j"), F.col("j").alias("k"))
        jump = write_stage(jump.join(far, [*keys, "j"]).select(*keys, "i", F.col("k").alias("j")), "jump")
    return reached.withColumnRenamed("i", "step_index")


def early_stopping(log: DataFrame, n: int, min_gain: float, patience: int, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Per step: moving average, best so far, steps without improvement, and the first stopping step."""
    keys = list(keys)
    narrow = log.select(*keys, "step_index", "reward")
    ma = write_stage(moving_average(narrow, "reward", n, "moving_average", keys).drop("reward"), "moving")
    hits = improvements(ma, "moving_average", min_gain, keys).withColumn("improved", F.lit(True))
    marked = ma.select(*keys, "step_index", "moving_average").join(hits, [*keys, "step_index"], "left")
    hit = F.col("improved").isNotNull()
    run = running(marked, keys, ["step_index"], maxes={
        "_last": F.when(hit, F.col("step_index")), "best_moving_average": F.when(hit, F.col("moving_average"))})
    stale = F.when(F.col("moving_average").isNull(), F.lit(0)).otherwise(F.col("step_index") - F.col("_last"))
    out = run.select(*keys, "step_index", "moving_average", "best_moving_average", hit.alias("improved"), stale.alias("no_improve_count"))
    stop = out.filter((F.col("no_improve_count") >= patience) & F.col("moving_average").isNotNull()).groupBy(*keys).agg(F.min("step_index").alias("stop_step"))
    return out.join(stop, keys, "left")


def streaks(log: DataFrame, match: Column, keys: Sequence[str] = ("episode_id",), carry: Sequence[str] = ()) -> DataFrame:
    """(keys, step_index, ``carry``, ``streak``): length of the current run of matching rows, up to the last row that did not match."""
    named = [*keys, "step_index", *carry]
    run = running(log.select(*named, match.alias("_match")), keys, ["step_index"], maxes={"_gap": F.when(~F.col("_match"), F.col("step_index"))})
    length = F.when(F.col("_match"), F.col("step_index") - F.coalesce("_gap", F.lit(0))).otherwise(F.lit(0))
    return run.select(*named, length.alias("streak"))


def owners_at_step(initial: DataFrame, log: DataFrame, k: int, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Owner per bin after step ``k``: the last applied action up to it, else the initial owner."""
    acts = log.filter((F.col("step_index") <= k) & F.col("applied")).select(*keys, "barcode", "cell_id", "step_index")
    start = initial.select(*keys, "barcode", "cell_id", F.lit(0).cast("bigint").alias("step_index"))
    return acts.unionByName(start).groupBy(*keys, "barcode").agg(F.max_by("cell_id", "step_index").alias("cell_id"))


def fold_actions(log: DataFrame, keys: Sequence[str] = ("episode_id",)) -> tuple[DataFrame, DataFrame]:
    """(membership, invalid actions) of an add / remove / stop log.

    Actions after the first stop are ignored; the last action on a bin decides. Repeating
    the kind of the previous action on a bin, or removing an unassigned bin, is invalid.
    """
    keys = list(keys)
    stop = log.filter("action = 'stop'").groupBy(*keys).agg(F.min("step_index").alias("_stop"))
    live = log.join(stop, keys, "left").filter((F.col("_stop").isNull() | (F.col("step_index") < F.col("_stop"))) & F.col("action").isin("add", "remove"))
    final = live.groupBy(*keys, "barcode").agg((F.max_by("action", "step_index") == "add").alias("is_member"), F.count("*").alias("n_actions"))
    prev = previous_value(live.select(*keys, "barcode", "step_index", "action"), [*keys, "barcode"], ["step_index"], "action", "_prev")
    bad = prev.filter(F.col("action") == F.coalesce("_prev", F.lit("remove"))).select(*keys, "barcode", "step_index", "action")
    return final, bad


def landmarks(log: DataFrame, truth: DataFrame, cell_truth: DataFrame) -> DataFrame:
    """Notable steps per episode: biggest drop and gain, first rejection, first wrong replace, busiest step.

    ``log`` has one row per action with the step's reward; a step may hold several actions.
    """
    judged = log.join(truth.select("barcode", F.col("gt_id").alias("_gt")), "barcode", "left").join(
        cell_truth.select("cell_id", F.col("gt_id").alias("_match")), "cell_id", "left")
    wrong = F.col("applied") & (F.col("action") == "replace") & F.col("_gt").isNotNull() & ~F.col("_match").eqNullSafe(F.col("_gt"))
    steps = judged.groupBy("episode_id", "step").agg(
        F.sum("reward").alias("reward"), F.count("*").alias("n"), F.bool_or(~F.col("applied")).alias("rejected"), F.bool_or(wrong).alias("wrong"))
    rw = F.round("reward", 6)
    return steps.groupBy("episode_id").agg(
        F.when(F.min(rw) < 0, F.min_by("step", F.struct(rw.alias("v"), "step"))).alias("largest_drop"),
        F.when(F.max(rw) > 0, F.min_by("step", F.struct((-rw).alias("v"), "step"))).alias("largest_gain"),
        F.min(F.when(F.col("rejected"), F.col("step"))).alias("first_rollback"), F.min(F.when(F.col("wrong"), F.col("step"))).alias("first_wrong_replace"),
        F.min_by("step", F.struct((-F.col("n")).alias("v"), "step")).alias("busiest_step"))


def cell_landmarks(cells: DataFrame) -> DataFrame:
    """Most over- and under-grown cell (if positive) and lowest-IoU cell per patch; first cell on ties."""
    d = F.col("predicted_bins") - F.col("gt_bins")
    first = lambda key, when: F.min_by("cell_id", F.when(when, F.struct(key.alias("v"), F.col("cell_id").cast("bigint").alias("c"))))
    return cells.groupBy("patch_id").agg(
        first(-d, d > 0).alias("most_overgrown_cell"), first(d, d < 0).alias("most_undersegmented_cell"),
        first(F.round("patch_iou", 9), F.col("patch_iou").isNotNull()).alias("lowest_iou_cell"))


def first_finite(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    v = F.col(value).cast("double")
    ok = rows.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return ok.groupBy(key).agg(F.min_by(value, order).alias(value))


def replay_consistency(log: DataFrame, stored: DataFrame, tolerance: float = 1.0e-5) -> DataFrame:
    """Whether replayed totals equal the stored metrics of each episode."""
    again = log.groupBy("episode_id").agg(F.sum("reward").alias("r"), F.count("*").alias("n"), F.countDistinct(F.when(F.col("applied"), F.col("barcode"))).alias("b"))
    j = stored.join(again, "episode_id")
    return j.select("episode_id", (F.abs(F.col("r") - F.col("total_reward")) <= tolerance).alias("reward_matches"), (F.col("n") == F.col("n_steps")).alias("steps_match"),
                    (F.col("b") == F.col("n_bins")).alias("bins_match"))
