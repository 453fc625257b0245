"""One-row aggregates used as constants of another table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add every column of a one-row table to all rows of ``df``.

    Planned as a scalar subquery: it runs once and its value is a constant in the scan of
    ``df``; nothing is joined.
    """
    names = one_row.columns
    packed = one_row.select(F.struct(*names).alias("_scalars"))
    return df.withColumn("_scalars", packed.scalar()).select(*df.columns, *[F.col(f"_scalars.{n}").alias(n) for n in names])
