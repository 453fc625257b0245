"""Schemas of the interchange tables and load-time checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Required columns and their types.
PIXELS = T.StructType([
    T.StructField("x", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("cell_id", T.LongType()),
    T.StructField("is_boundary", T.IntegerType()),
    T.StructField("is_interior", T.IntegerType()),
    T.StructField("is_nuclear", T.IntegerType()),
    T.StructField("is_cytoplasm", T.IntegerType()),
])
TISSUE_POSITIONS = T.StructType([
    T.StructField("barcode", T.StringType()),
    T.StructField("in_tissue", T.IntegerType()),
    T.StructField("array_row", T.IntegerType()),
    T.StructField("array_col", T.IntegerType()),
    T.StructField("pxl_row_in_fullres", T.DoubleType()),
    T.StructField("pxl_col_in_fullres", T.DoubleType()),
])
COORDINATE_PAIRS = (
    ("array_col", "array_row"),
    ("bin_x_index", "bin_y_index"),
    ("x", "y"),
    ("col", "row"),
)
DEFAULT_MICRONS_PER_PIXEL = 0.2737012522439323


def require_columns(df: DataFrame, columns: Iterable[str], name: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} is missing required columns: {missing}")
    return df


def resolve_coordinate_pair(columns: Sequence[str]) -> tuple[str, str]:
    """First known (x, y) column pair that the table has."""
    for pair in COORDINATE_PAIRS:
        if all(c in columns for c in pair):
            return pair
    raise ValueError(f"no coordinate column pair among {list(columns)}")


def resolve_prefix_columns(columns: Sequence[str], prefix: str) -> list[str]:
    found = [c for c in columns if c.startswith(prefix)]
    if not found:
        raise ValueError(f"no columns start with {prefix!r}")
    return found


def unpivot_prefix(df: DataFrame, keys: Sequence[str], prefix: str, name: str, value: str) -> DataFrame:
    """Wide prefixed expression columns to long (keys, name, value) rows."""
    cols = resolve_prefix_columns(df.columns, prefix)
    long = df.unpivot(list(keys), cols, name, value)
    return long.withColumn(name, F.expr(f"substring({name}, {len(prefix) + 1})"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Raise when a side declared one-row-per-key has repeated keys."""
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"{name} is not unique on {list(keys)}: {bad[0].asDict()}")
    return df


def quality_report(df: DataFrame, keys: Sequence[str], numeric: Sequence[str], positive: Sequence[str] = ()) -> DataFrame:
    """One pass over ``df``; rows ``(check_name, n_bad)``.

    Null keys count as null, not as duplicates; text in a numeric column counts as such. The
    duplicate count comes from a two-step aggregate, so a hot key is first reduced
    to one row per key.
    """
    aggs: list[Column] = []
    for c in dict.fromkeys([*keys, *numeric]):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"null:{c}"))
    for c in numeric:
        v = F.col(c).try_cast("double")
        aggs.append(F.count_if(F.col(c).isNotNull() & v.isNull()).alias(f"non_numeric:{c}"))
        aggs.append(F.count_if(F.isnan(v) | (F.abs(v) == F.lit(float("inf")))).alias(f"non_finite:{c}"))
    for c in positive:
        aggs.append(F.count_if(~(F.col(c) > 0)).alias(f"non_positive:{c}"))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
    aggs.append((F.count_if(whole) - F.countDistinct(*keys)).alias("duplicate:" + ",".join(keys)))
    wide = df.agg(*aggs)
    return wide.unpivot([], wide.columns, "check_name", "n_bad")


def check_quality(report: DataFrame, name: str) -> None:
    bad = report.filter("n_bad > 0").collect()
    if bad:
        raise ValueError(f"{name} failed checks: " + ", ".join(f"{r.check_name}={r.n_bad}" for r in bad))
