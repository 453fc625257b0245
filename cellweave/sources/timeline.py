"""Owner timelines: which cell owns a bin after each step, coded as changes with a snapshot every few steps.

A timeline has one row for each group and segment of ``every`` steps: the owners before the
segment and the changes inside it. The owners after any step follow from one segment, so a
reader replays at most ``every`` steps and skips all other rows by their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.ordered import join_groups

OWNERS = "array<struct<barcode:string,cell_id:bigint>>"
CHANGES = "array<struct<step_index:bigint,barcode:string,cell_id:bigint>>"
FIELDS = ("segment", "last_segment", "every", "owners", "changes")
SEGMENT = f"segment:bigint,last_segment:bigint,every:bigint,owners:{OWNERS},changes:{CHANGES}"


def _segment(step: str | Column, every: int) -> Column:
    step = F.col(step) if isinstance(step, str) else step
    return F.floor((step - 1) / every).cast("long")


def timeline(initial: DataFrame, log: DataFrame, every: int, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """(keys, segment, last_segment, every, owners, changes) of an action log.

    ``initial`` has one owner per (keys, barcode); ``log`` has step_index from 1, applied, barcode and
    cell_id. Rejected steps count for the length only; a null owner stays in the snapshots. Groups
    that only one of the inputs has are kept. What is written grows with bins times segments.
    """
    keys = list(keys)
    part = [*keys, "segment"]
    steps = log.select(*keys, F.col("step_index").cast("long").alias("step_index"))
    ends = steps.unionByName(initial.select(*keys, F.lit(1).cast("long").alias("step_index"))).groupBy(*keys).agg(
        _segment(F.max("step_index"), every).alias("last_segment"))
    acts = log.filter("applied").select(*keys, _segment("step_index", every).alias("segment"), F.col("step_index").cast("long").alias("step_index"),
                                        "barcode", F.col("cell_id").cast("long").alias("cell_id"))
    # the last owner of a segment holds from the next segment on, up to the segment of the next change
    last = acts.groupBy(*part, "barcode").agg(F.max_by("cell_id", "step_index").alias("cell_id"))
    first = initial.select(*keys, F.lit(-1).cast("long").alias("segment"), "barcode", F.col("cell_id").cast("long").alias("cell_id"))
    until = F.lead("segment").over(Window.partitionBy(*keys, "barcode").orderBy("segment"))
    spans = join_groups(last.unionByName(first).withColumn("_until", until), ends, keys)
    spans = spans.withColumns({"_from": F.col("segment") + 1, "_to": F.least("_until", "last_segment")}).filter("_from <= _to")
    held = spans.select(*keys, "barcode", "cell_id", F.explode(F.sequence("_from", "_to")).alias("segment"))
    owners = held.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("barcode", "cell_id"))).alias("owners"))
    changes = acts.groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("step_index", "barcode", "cell_id"))).alias("changes"))
    frame = ends.select(*keys, "last_segment", F.lit(every).cast("long").alias("every"), F.explode(F.sequence(F.lit(0).cast("long"), "last_segment")).alias("segment"))
    full = join_groups(join_groups(frame, owners, part, "left"), changes, part, "left")
    filled = {"owners": F.coalesce("owners", F.array().cast(OWNERS)), "changes": F.coalesce("changes", F.array().cast(CHANGES))}
    return full.withColumns(filled).select(*keys, *FIELDS)


def owners_after(segments: DataFrame, k: int, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """(keys, barcode, cell_id) after step ``k``, rebuilt from one segment of each group; steps behind the end change nothing."""
    wanted = _segment(F.greatest(F.lit(k), F.lit(1)), F.col("every"))
    one = segments.filter((F.col("segment") == wanted) | ((F.col("segment") == F.col("last_segment")) & (F.col("segment") < wanted)))
    start = F.transform("owners", lambda o: F.struct(F.lit(0).cast("long").alias("step_index"), o["barcode"].alias("barcode"), o["cell_id"].alias("cell_id")))
    rows = one.select(*keys, F.explode(F.concat(start, F.filter("changes", lambda c: c["step_index"] <= k))).alias("c")).select(*keys, "c.*")
    return rows.groupBy(*keys, "barcode").agg(F.max_by("cell_id", "step_index").alias("cell_id"))


def write_timeline(segments: DataFrame, path: str) -> None:
    """One JSON line per segment."""
    segments.write.json(path)


def read_timeline(spark: SparkSession, path: str, key: str = "episode_id bigint") -> DataFrame:
    return spark.read.schema(f"{key}, segment bigint, last_segment bigint, every bigint, owners {OWNERS}, changes {CHANGES}").json(path)


def nested(segments: DataFrame, key: str = "patch_id") -> DataFrame:
    """(key, trajectory): all segments of a group in one row, for patches, whose steps are limited."""
    return segments.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("trajectory"))


def read_nested(spark: SparkSession, path: str, key: str = "patch_id") -> DataFrame:
    """The segments of written documents; no other field of them is parsed."""
    return spark.read.schema(f"{key} string, trajectory array<struct<{SEGMENT}>>").json(path).select(key, F.inline("trajectory"))
