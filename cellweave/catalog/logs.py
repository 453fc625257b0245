"""Queries: action logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as lg
from . import steps
from .evaluation import cell_truth
from .registry import R, RS, big, bigs, cte, query, r, rs


@query("s10_step_log_payload", """
select event_id, cast(json_extract(props, '$.k') as int) as k, event_type as event, strftime(ts, '%Y-%m-%dT%H:%M:%S') as timestamp_utc from events""")
def _(ws):
    from ..sources.step_log import LOG_SCHEMA, append_log, log_rows, read_log
    from .growth import scratch
    path = scratch(ws, "log")
    tagged = ws["events"].withColumn("payload", F.to_json(F.struct("event_id", F.from_json("props", "k int")["k"].alias("k"))))
    append_log(log_rows(tagged, "ts", "event_type", "payload"), path)
    return read_log(ws.spark, path, "event_id bigint, k int").select("payload.event_id", "payload.k", "event", "timestamp_utc")


@query("s10_step_log", f"select episode_id, step_index, action, cell_id, barcode, applied, {RS('reward', 'value_est')}, done from step_log")
def _(ws):
    return ws["step_log"].select("episode_id", "step_index", "action", "cell_id", "barcode", "applied", *rs("reward", "value_est"), "done")


@query("s10_action_traces", f"""
select episode_id, cast(row_number() over (partition by episode_id order by step_index) - 1 as int) as step_offset, action, case when action <> 'stop' then barcode end as barcode, applied, {R('reward')} as reward from step_log""")
def _(ws):
    from ..sources.step_log import read_action_traces, write_traces
    from .growth import scratch
    path = scratch(ws, "traces")
    # a step that stops names no bin
    steps = ws["step_log"].select("episode_id", "step_index", "action", F.when(F.col("action") != "stop", F.col("barcode")).alias("barcode"), "applied", "reward")
    write_traces(steps, "episode_id", "step_index", path)
    field = lambda name, kind: F.try_variant_get("step", f"$.{name}", kind).alias(name)
    read = read_action_traces(ws.spark, path).select("episode_id", "step_offset", field("action", "string"), field("barcode", "string"), field("applied", "boolean"), field("reward", "double"))
    return read.select("episode_id", "step_offset", "action", "barcode", "applied", *rs("reward"))


# rewards have four decimals, so short sums lie on decimal rounding boundaries; values are compared as 32-bit floats, whose boundaries they miss
def single(*names: str):
    return [(F.col(n).cast("float").cast("double") + F.lit(0.0)).alias(n) for n in names]


def SINGLE(expr: str) -> str:
    return f"(cast(cast({expr} as real) as double) + 0.0e0)"


_BACK = """
with recursive b as (select s.episode_id, s.step_index, {first} as g from lg s where s.step_index = s.n
 union all select s.episode_id, s.step_index, {nxt} as g from b join lg s on s.episode_id = b.episode_id and s.step_index = b.step_index - 1)
select episode_id, step_index, {out} from b {join}"""
cte("lg", "select episode_id, step_index, reward, value_est, done, count(*) over (partition by episode_id) as n, lead(value_est) over (partition by episode_id order by step_index) as nv from step_log")


@query("w7_discounted_return", _BACK.format(first="s.reward", nxt="s.reward + 0.99e0*b.g", out=SINGLE("g") + " as discounted_return", join=""))
def _(ws):
    return lg.discounted_returns(ws["step_log"], 0.99).select("episode_id", "step_index", *single("discounted_return"))


_DELTA = "s.reward + 0.99e0*coalesce(s.nv, 0.0e0)*(case when s.done then 0.0e0 else 1.0e0 end) - s.value_est"


@query("w8_advantages", _BACK.format(first=_DELTA, nxt=f"{_DELTA} + 0.99e0*0.95e0*(case when s.done then 0.0e0 else 1.0e0 end)*b.g", out=f"{SINGLE('g')} as advantage, {SINGLE('g + value_est')} as return_est", join="join lg using (episode_id, step_index)"))
def _(ws):
    return lg.advantages(ws["step_log"], 0.99, 0.95).select("episode_id", "step_index", *single("advantage", "return_est"))


cte("ep", "select episode_id, sum(reward) as total_reward, row_number() over (order by episode_id) - 1 as idx from step_log group by 1")


@query("w9_group_relative", f"select episode_id, {R('(total_reward - avg(total_reward) over w)/(stddev_pop(total_reward) over w + 1.0e-6)')} as advantage from ep window w as (partition by idx // 5)")
def _(ws):
    from ..functions.ordered import ordinal
    totals = ordinal(ws["step_log"].groupBy("episode_id").agg(F.sum("reward").alias("total_reward")), ["episode_id"], "idx")
    return lg.group_relative(totals, "idx", "total_reward", 5, 1.0e-6).select("episode_id", *rs("advantage"))


@query("w10_cumulative_reward", f"""
select episode_id, step_index, {R('sum(reward) over w')} as cumulative_reward, count(*) filter (applied) over w as n_applied, count(*) filter (not applied) over w as n_rejected from step_log window w as (partition by episode_id order by step_index)""")
def _(ws):
    return lg.cumulative(ws["step_log"]).select("episode_id", "step_index", *rs("cumulative_reward"), "n_applied", "n_rejected")


cte("ma", "select episode_id, step_index, case when count(*) over w = 5 then avg(reward) over w end as ma from step_log window w as (partition by episode_id order by step_index rows between 4 preceding and current row)")


@query("w11_moving_average", f"select episode_id, step_index, {R('ma')} as moving_average from ma")
def _(ws):
    return lg.moving_average(ws["step_log"], "reward", 5, "moving_average").select("episode_id", "step_index", *rs("moving_average"))


@query("w11_early_stopping", f"""
with recursive b as (select episode_id, step_index, ma, cast(null as double) as best, 0 as stale, false as improved from ma where step_index = 1
 union all select m.episode_id, m.step_index, m.ma, case when m.ma is not null and (b.best is null or m.ma > b.best + 0.001e0) then m.ma else b.best end,
  case when m.ma is null or b.best is null or m.ma > b.best + 0.001e0 then 0 else b.stale + 1 end, m.ma is not null and (b.best is null or m.ma > b.best + 0.001e0) from b join ma m on m.episode_id = b.episode_id and m.step_index = b.step_index + 1)
select b.episode_id, b.step_index, {R('b.best')} as best_moving_average, b.improved, cast(b.stale as bigint) as no_improve_count, s.stop_step from b
left join (select episode_id, min(step_index) as stop_step from b where stale >= 20 and ma is not null group by 1) s using (episode_id)""")
def _(ws):
    return lg.early_stopping(ws["step_log"], 5, 0.001, 20).select("episode_id", "step_index", *rs("best_moving_average"), "improved", "no_improve_count", "stop_step")


_OWNER_AT_STEP = """
select episode_id, barcode, cell_id from (select *, row_number() over (partition by episode_id, barcode order by step_index desc) as rn from (
 select episode_id, barcode, cell_id, step_index from step_log where step_index <= {k} and applied
 union all select distinct episode_id, barcode, cast(99 as bigint), cast(0 as bigint) from step_log where step_index % 3 = 0) q) q2 where rn = 1"""


def initial_owners(ws):
    return ws["step_log"].filter("step_index % 3 = 0").select("episode_id", "barcode").distinct().withColumn("cell_id", F.lit(99).cast("bigint"))


@query("w13_owner_at_step", _OWNER_AT_STEP.format(k=40))
def _(ws):
    return lg.owners_at_step(initial_owners(ws), ws["step_log"], 40)


@query("s11_trajectory_at_step", _OWNER_AT_STEP.format(k=40))
def _(ws):
    from ..sources.timeline import owners_after, read_timeline, timeline, write_timeline
    from .growth import scratch
    path = scratch(ws, "timeline")
    write_timeline(timeline(initial_owners(ws), ws["step_log"], 16), path)
    return owners_after(read_timeline(ws.spark, path), 40)


@query("w13_owner_bin_counts", """
select episode_id, cell_id, count(*) as n_bins from (select episode_id, barcode, arg_max(cell_id, step_index) as cell_id from step_log where step_index <= 40 and applied group by 1, 2) q group by 1, 2""")
def _(ws):
    none = ws["step_log"].filter("false").select("episode_id", "barcode", "cell_id")
    return lg.owners_at_step(none, ws["step_log"], 40).groupBy("episode_id", "cell_id").agg(F.count("*").alias("n_bins"))


cte("lgt", """
select l.episode_id, cast(floor((l.step_index - 1)/3) as bigint) as step, l.reward, l.applied,
 l.applied and l.action = 'replace' and g.cell_id is not null and m.gt_id is distinct from g.cell_id as wrong
from step_log l left join gt_cell_bins g using (barcode) left join cell_truth m on m.pred_id = cast(l.cell_id as varchar)""")


@query("w14_trajectory_landmarks", """
with s as (select episode_id, step, round(sum(reward), 6) as reward, count(*) as n, bool_or(not applied) as rejected, bool_or(wrong) as wrong from lgt group by 1, 2)
select episode_id, case when min(reward) < 0 then arg_min(step, (reward, step)) end as largest_drop, case when max(reward) > 0 then arg_min(step, (-reward, step)) end as largest_gain,
 min(step) filter (rejected) as first_rollback, min(step) filter (wrong) as first_wrong_replace, arg_min(step, (-n, step)) as busiest_step from s group by 1""")
def _(ws):
    log = ws["step_log"].select("episode_id", F.floor((F.col("step_index") - 1) / 3).cast("bigint").alias("step"), "reward", "applied", "action", "barcode", F.col("cell_id").cast("string").alias("cell_id"))
    truth = ws["gt_cell_bins"].select("barcode", F.col("cell_id").alias("gt_id"))
    return lg.landmarks(log, truth, cell_truth(ws).withColumnRenamed("pred_id", "cell_id"))


@query("w14_cell_landmarks", """
select patch_id, arg_min(cell_id, (-(predicted_bins - gt_bins), cast(cell_id as bigint))) filter (predicted_bins > gt_bins) as most_overgrown_cell,
 arg_min(cell_id, (predicted_bins - gt_bins, cast(cell_id as bigint))) filter (predicted_bins < gt_bins) as most_undersegmented_cell,
 arg_min(cell_id, (round(patch_iou, 9), cast(cell_id as bigint))) filter (patch_iou is not null) as lowest_iou_cell from pcells group by 1""")
def _(ws):
    return lg.cell_landmarks(ws["patch_cells"])


@query("w16_streaks", """
with q as (select episode_id, step_index, action = 'add' as m, count(*) filter (action <> 'add') over (partition by episode_id order by step_index) as island from step_log)
select episode_id, step_index, case when m then count(*) filter (m) over (partition by episode_id, island order by step_index) else 0 end as streak from q""")
def _(ws):
    return lg.streaks(ws["step_log"], F.col("action") == "add").select("episode_id", "step_index", "streak")


@query("w16_mode_counts_and_streaks", f"""
with q as (select episode_id, step_index, action, action = 'add' as m, count(*) filter (action <> 'add') over (partition by episode_id order by step_index) as island from step_log),
s as (select *, case when m then count(*) filter (m) over (partition by episode_id, island order by step_index) else 0 end as streak from q)
select action, count(*) as n, {R('avg(streak)')} as mean_streak, max(streak) as max_streak from s group by 1""")
def _(ws):
    s = lg.streaks(ws["step_log"], F.col("action") == "add", carry=["action"])
    return s.groupBy("action").agg(F.count("*").alias("n"), r(F.avg("streak")).alias("mean_streak"), F.max("streak").alias("max_streak"))


@query("w17_first_finite_score", """
select user_id, arg_min(value, event_id) as value from events where event_id % 3 <> 0 group by 1""")
def _(ws):
    rows = ws["events"].select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return lg.first_finite(rows, "user_id", "value", "event_id")


@query("g25_replay_consistency", """
with s as (select episode_id, round(sum(reward), 7) + case when episode_id % 10 = 0 then 1.0e0 else 0.0e0 end as total_reward, count(*) as n_steps, count(distinct case when applied then barcode end) + case when episode_id % 7 = 0 then 1 else 0 end as n_bins from step_log group by 1)
select s.episode_id, abs(a.r - s.total_reward) <= 1.0e-5 as reward_matches, a.n = s.n_steps as steps_match, a.b = s.n_bins as bins_match from s join (
 select episode_id, sum(reward) as r, count(*) as n, count(distinct case when applied then barcode end) as b from step_log group by 1) a using (episode_id)""")
def _(ws):
    off = lambda d, v: F.when(F.col("episode_id") % d == 0, F.lit(v)).otherwise(F.lit(v * 0))
    stored = ws["step_log"].groupBy("episode_id").agg(
        F.round(F.sum("reward"), 7).alias("total_reward"), F.count("*").alias("n_steps"), F.countDistinct(F.when(F.col("applied"), F.col("barcode"))).alias("n_bins"))
    stored = stored.select("episode_id", (F.col("total_reward") + off(10, 1.0)).alias("total_reward"), "n_steps", (F.col("n_bins") + off(7, 1)).alias("n_bins"))
    return lg.replay_consistency(ws["step_log"], stored)


cte("tri", """
select t.* from (select episode_id, step_index, barcode, case action when 'replace' then 'remove' when 'stop' then case when event_id % 40 = 3 then 'stop' else 'add' end when 'noop' then 'remove' else action end as action from step_log) t
left join (select episode_id, min(step_index) as stop from (select episode_id, step_index, case action when 'stop' then case when event_id % 40 = 3 then 'stop' else 'add' end else action end as action from step_log) q where action = 'stop' group by 1) s using (episode_id)
where (s.stop is null or t.step_index < s.stop) and t.action in ('add', 'remove')""")


def three_action_log(ws):
    kind = F.expr("case action when 'replace' then 'remove' when 'stop' then case when event_id % 40 = 3 then 'stop' else 'add' end when 'noop' then 'remove' else action end")
    return ws["step_log"].select("episode_id", "step_index", "barcode", kind.alias("action"))


@query("g26_action_fold", "select episode_id, barcode, arg_max(action, step_index) = 'add' as is_member, count(*) as n_actions from tri group by 1, 2")
def _(ws):
    return lg.fold_actions(three_action_log(ws))[0]


@query("g26_invalid_actions", """
select episode_id, barcode, step_index, action from (select *, coalesce(lag(action) over (partition by episode_id, barcode order by step_index), 'remove') as prev from tri) q where action = prev""")
def _(ws):
    return lg.fold_actions(three_action_log(ws))[1]
