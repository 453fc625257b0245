"""Backward recurrences h_t = add_t + mul_t * h_(t+1) over sequences of any length.

Every step is an affine map, and maps compose: a chunk of steps is one map again. Inside a
chunk the maps are composed by doubling (1, 2, 4, ... steps ahead, all over one sort), the
maps of whole chunks form a shorter sequence that is solved in the same way, and its values
are carried back into the chunks. Chunks are dealt by hash, so that one long sequence fills
all tasks evenly; only keys, order, the maps and what the caller names are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import write_stage
from .ordered import join_groups

CHUNK = 256


def _scaled(mul: Column, x: Column) -> Column:
    """mul * x, where a map that forgets (0) forgets infinities too and nothing counts as 0."""
    return F.coalesce(F.when(mul != 0, mul * x), F.lit(0.0))


def _compose(rows: DataFrame, part: Sequence[str], index: str, chunk: int) -> DataFrame:
    """Each row's map composed with the maps of all later rows of its chunk."""
    later = Window.partitionBy(*part).orderBy(index)
    reach = 1
    while reach < chunk:
        add, mul = F.lead("_add", reach).over(later), F.lead("_mul", reach).over(later)
        rows = rows.withColumns({"_add": F.col("_add") + _scaled(F.col("_mul"), add), "_mul": F.col("_mul") * F.coalesce(mul, F.lit(1.0))})
        reach *= 2
    return rows.select("*", F.lead("_add").over(later).alias("_next_add"), F.lead("_mul").over(later).alias("_next_mul"),
                       (F.row_number().over(later) == 1).alias("_head"))


def backward_scan(rows: DataFrame, keys: Sequence[str], index: str, add: Column, mul: Column, value: str, after: str,
                  carry: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """(keys, index, ``carry``, ``value`` = h of the row, ``after`` = h of the row behind it).

    ``index`` is a whole number of 0 or more, unique in its group; gaps are allowed. Behind the
    last row h is 0. A null ``add`` or ``mul`` counts as 0, null keys are a group.
    """
    kept = [*keys, index, *carry]
    part = [*keys, "_chunk"]
    maps = rows.select(*kept, F.expr(f"`{index}` div {chunk}").alias("_chunk"),
                       F.coalesce(add.cast("double"), F.lit(0.0)).alias("_add"), F.coalesce(mul.cast("double"), F.lit(0.0)).alias("_mul"))
    local = write_stage(_compose(maps, part, index, chunk), "scan")
    first, last = local.agg(F.min(index), F.max(index)).first()
    if first is not None and first < 0:
        raise ValueError(f"{index} must not be negative")
    if last is None or last < chunk:
        solved = local.withColumn("_behind", F.lit(0.0))
    else:
        heads = local.filter("_head").select(*keys, F.col("_chunk").alias("_pos"), "_add", "_mul")
        across = backward_scan(heads, keys, "_pos", F.col("_add"), F.col("_mul"), "_h", "_behind", chunk=chunk)
        solved = join_groups(local, across.select(*keys, F.col("_pos").alias("_chunk"), "_behind"), part)
    behind = F.col("_behind")
    following = F.when(F.col("_next_mul").isNull(), behind).otherwise(F.col("_next_add") + _scaled(F.col("_next_mul"), behind))
    return solved.select(*kept, (F.col("_add") + _scaled(F.col("_mul"), behind)).alias(value), following.alias(after))
