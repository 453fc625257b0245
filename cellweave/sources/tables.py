"""Table scan and sink with the format taken from the file suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.ordered import ordinal
from ..functions.scalars import attach_scalars
from ..operators.shape import mix_key

# Suffix to format.
FORMATS = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".csv.gz": "csv", ".tsv": "tsv", ".tsv.gz": "tsv", ".txt": "tsv"}


def detect_format(path: str, fmt: str = "auto") -> str:
    if fmt != "auto":
        if fmt not in set(FORMATS.values()):
            raise ValueError(f"unsupported table format: {fmt}")
        return fmt
    for suffix, name in FORMATS.items():
        if path.lower().rstrip("/").endswith(suffix):
            return name
    raise ValueError(f"cannot tell the table format of {path!r}")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: T.StructType | None = None, fmt: str = "auto") -> DataFrame:
    """Lazy scan; selecting ``columns`` prunes them at the source. Text needs a schema to avoid an inference pass."""
    kind = detect_format(path, fmt)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        df = reader.parquet(path)
    else:
        df = reader.csv(path, header=True, sep="\t" if kind == "tsv" else ",", inferSchema=schema is None)
    return df if columns is None else df.select(*columns)


def write_table(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Write by suffix (.parquet, .csv, .csv.gz); ``order`` sorts the whole output by range partitions."""
    kind = detect_format(path)
    out = df.orderBy(*order) if order else df
    writer = out.write.mode("overwrite")
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "csv":
        writer.csv(path, header=True, compression="gzip" if path.endswith(".gz") else "none")
    else:
        raise ValueError(f"cannot write {path!r}")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, chosen by ``seed``, returned in key order."""
    return df.orderBy(mix_key(F.col(key), seed), key).limit(n).orderBy(key)


def sample_with_replacement(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` draws by ``seed``, numbered by ``draw``; each meets its row by ordinal."""
    numbered = ordinal(df, [key], out="_at")
    size = df.agg(F.count("*").alias("_size")).filter("_size > 0")
    draws = df.sparkSession.range(1, n + 1).withColumnRenamed("id", "draw")
    number = F.conv(F.substring(mix_key(F.col("draw"), seed), 1, 15), 16, 10).cast("bigint")
    placed = attach_scalars(draws, size).withColumn("_at", number % F.col("_size"))
    return placed.join(numbered, "_at").select("draw", *df.columns)
