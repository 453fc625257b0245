"""Ordered computations over groups of any size.

A plain window sorts a whole group in one task. A run, episode or the global order can
be arbitrarily long, so these helpers cut the ordered rows into range blocks, work inside
each block, and carry block totals forward. A block, not a group, is what one task sees.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import write_stage
from .scalars import attach_scalars

BLOCK = "_blk"


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Range-partition on (keys, order) and store the block number of every row.

    Range bounds come from sampling and may differ when recomputed, so the blocked rows
    are written once and every later step reads the same blocks.
    """
    sort_cols = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    blocked = df.repartitionByRange(*sort_cols).withColumn(BLOCK, F.spark_partition_id())
    return write_stage(blocked, "blocks")


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group keys where null is a key like any other."""
    other = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_of_{k}" for k in keys])


def _carry(totals: DataFrame, keys: Sequence[str], outs: Mapping[str, str]) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    cols = []
    for out, kind in outs.items():
        fn = {"sum": F.sum, "max": F.max}[kind]
        cols.append(fn(f"_t_{out}").over(before).alias(f"_c_{out}"))
    return totals.select(*keys, BLOCK, *cols)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    rank: str | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Inclusive running sums / maxima and a 1-based row number per group.

    The result has the columns of ``df``, or only keys, order and ``keep`` where that is given.
    """
    named = df.columns if keep is None else list(dict.fromkeys([*keys, *[o for o in order if isinstance(o, str)], *keep]))
    values = {**(sums or {}), **(maxes or {})}
    kinds = {**{k: "sum" for k in (sums or {})}, **{k: "max" for k in (maxes or {})}}
    if rank:
        values[rank], kinds[rank] = F.lit(1).cast("long"), "sum"
    staged = df.select(*named, *[c.alias(f"_v_{o}") for o, c in values.items()])
    blocked = ordered_blocks(staged, keys, order)
    sort_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    inside = Window.partitionBy(BLOCK, *keys).orderBy(*sort_cols).rowsBetween(Window.unboundedPreceding, 0)
    fns = {"sum": F.sum, "max": F.max}
    local = blocked.select("*", *[fns[kinds[o]](f"_v_{o}").over(inside).alias(f"_l_{o}") for o in values])
    totals = blocked.groupBy(*keys, BLOCK).agg(*[fns[kinds[o]](f"_v_{o}").alias(f"_t_{o}") for o in values])
    carried = _carry(totals, keys, kinds)
    out = join_groups(local, carried, [*keys, BLOCK])
    final = []
    for o, kind in kinds.items():
        if kind == "sum":
            final.append((F.col(f"_l_{o}") + F.coalesce(F.col(f"_c_{o}"), F.lit(0))).alias(o))
        else:
            final.append(F.greatest(f"_l_{o}", f"_c_{o}").alias(o))
    return out.select(*named, *final)


def ordinal(df: DataFrame, order: Sequence[str | Column], out: str = "ordinal", start: int = 0,
            keys: Sequence[str] = ()) -> DataFrame:
    """Dense 0-based position in a (global or per-key) total order."""
    ranked = running(df, keys, order, rank=out)
    return ranked.withColumn(out, F.col(out) - 1 + start)


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``lag(value)`` per group without sorting a group in one task.

    Inside a block it is a plain lag; the first row of a block takes the last value of
    the closest earlier block that holds rows of the group.
    """
    blocked = ordered_blocks(df, keys, order)
    inside = Window.partitionBy(BLOCK, *keys).orderBy(*order)
    local = blocked.select("*", F.lag(value).over(inside).alias("_lag"), F.row_number().over(inside).alias("_rn"))
    ends = blocked.groupBy(*keys, BLOCK).agg(
        F.max(F.struct(*order, F.col(value).alias("_end"))).alias("_m")
    ).select(*keys, BLOCK, F.col("_m._end").alias("_end"))
    across = ends.select(*keys, BLOCK, F.lag("_end").over(Window.partitionBy(*keys).orderBy(BLOCK)).alias("_prev_end"))
    joined = join_groups(local, across, [*keys, BLOCK])
    return joined.select(*df.columns, F.when(F.col("_rn") == 1, F.col("_prev_end")).otherwise(F.col("_lag")).alias(out))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per group, without gathering a group's values.

    Equal values collapse first (map-side), then positions come from block-wise running
    counts; only the two rows around each position are kept.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run = running(counts, keys, [value], sums={"_hi": F.col("_n")})
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    joined = join_groups(run, total, keys) if keys else attach_scalars(run, total)
    v = F.col(value).cast("double")

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_hi") - F.col("_n") <= position) & (position < F.col("_hi")), v))

    aggs = [F.max("_total").alias("_total")]
    for name, p in points.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        aggs += [at(F.floor(pos)).alias(f"_a_{name}"), at(F.ceil(pos)).alias(f"_b_{name}")]
    picked = joined.groupBy(*keys).agg(*aggs)
    out = []
    for name, p in points.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.col(f"_a_{name}"), F.col(f"_b_{name}")
        out.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    return picked.select(*keys, *out)


def with_halo(df: DataFrame, index: str, block: int, before: int) -> DataFrame:
    """Cut a dense index into fixed blocks; copy the last ``before`` rows into the next block.

    Trailing-row frames then see all they need inside ``(keys, _blk)``. ``_halo`` marks copies.
    """
    own = F.floor((F.col(index) - 1) / block).cast("long")
    tail = (F.pmod(F.col(index) - 1, F.lit(block)) >= block - before)
    places = F.when(tail, F.array(F.struct(own.alias("b"), F.lit(False).alias("h")),
                                  F.struct((own + 1).alias("b"), F.lit(True).alias("h")))
                    ).otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("h"))))
    return df.withColumn("_p", F.explode(places)).select(
        *df.columns, F.col("_p.b").alias(BLOCK), F.col("_p.h").alias("_halo"))
