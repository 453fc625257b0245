"""Sparse matrix directory (matrix.mtx, barcodes.tsv, features.tsv) as long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ordered import ordinal

MATRIX, BARCODES, FEATURES = "matrix.mtx", "barcodes.tsv", "features.tsv"
HEADER = "%%MatrixMarket matrix coordinate integer general"


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of one file with their 0-based position."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"),
                                       F.monotonically_increasing_id().alias("_i"))
    return ordinal(raw, ["_f", "_s", "_i"], "line").select("value", "line")


def _existing(spark: SparkSession, folder: str, name: str) -> str:
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for candidate in (f"{folder}/{name}", f"{folder}/{name}.gz"):
        p = fs_path(candidate)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return candidate
    raise FileNotFoundError(f"{folder} has no {name} or {name}.gz")


def read_barcodes(spark: SparkSession, folder: str) -> DataFrame:
    return lines_in_order(spark, _existing(spark, folder, BARCODES)).select(F.col("value").alias("barcode"), F.col("line").alias("matrix_col_index"))


def read_features(spark: SparkSession, folder: str, feature_type: str | None = None) -> DataFrame:
    """id, name, feature_type, genome (missing ones blank) with the original row position."""
    parts = F.split("value", "\t")
    field = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    all_rows = lines_in_order(spark, _existing(spark, folder, FEATURES)).select(
        field(0).alias("id"), field(1).alias("name"), field(2).alias("feature_type"), field(3).alias("genome"), F.col("line").alias("matrix_feature_index"))
    if feature_type is None:
        return all_rows
    kept = all_rows.filter(F.col("feature_type") == feature_type)
    if kept.limit(1).count() == 0:
        raise ValueError(f"no feature has type {feature_type!r}")
    return kept


def read_entries(spark: SparkSession, folder: str) -> DataFrame:
    """(row, col, value), 0-based. Comments and the size line, the first plain line, are skipped.

    Integer matrices give a long value, others a double.
    """
    path = _existing(spark, folder, MATRIX)
    head = spark.read.text(path).filter(F.col("value").startswith("%%")).limit(1).collect()
    kind = "bigint" if head and " integer " in head[0][0] else "double"
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"),
                                       F.monotonically_increasing_id().alias("i")).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    first = raw.groupBy().agg(F.min_by("value", F.struct("f", "s", "i")).alias("size_line"))
    sizes = F.split(F.trim("value"), r"\s+")
    entries = raw.select(sizes.alias("p"), "value", "f", "s", "i").withColumn(
        "_first", raw.agg(F.min(F.struct("f", "s", "i")).alias("m")).scalar())
    body = entries.filter(F.struct("f", "s", "i") != F.col("_first"))
    return body.select((F.col("p")[0].cast("bigint") - 1).alias("row"), (F.col("p")[1].cast("bigint") - 1).alias("col"), F.col("p")[2].cast(kind).alias("value"))


def read_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Long (barcode, gene, cnt) rows of the directory."""
    return (read_entries(spark, folder)
            .join(read_features(spark, folder).select(F.col("matrix_feature_index").alias("row"), F.col("name").alias("gene")), "row")
            .join(read_barcodes(spark, folder).select(F.col("matrix_col_index").alias("col"), "barcode"), "col")
            .select("barcode", "gene", F.col("value").alias("cnt")))


def write_matrix(expression: DataFrame, barcodes: DataFrame, genes: DataFrame, folder: str) -> None:
    """Write the three files; entries are sorted by column, as range-partitioned part files."""
    coded = expression.join(barcodes, "barcode").join(genes, "gene")
    n_rows, n_cols, n = genes.count(), barcodes.count(), coded.count()
    spark = expression.sparkSession
    top = spark.createDataFrame([(0, HEADER), (1, f"{n_rows} {n_cols} {n}")], "k int, value string")
    body = coded.orderBy("matrix_col_index", "matrix_feature_index").select(
        F.concat_ws(" ", F.col("matrix_feature_index") + 1, F.col("matrix_col_index") + 1, "cnt").alias("value"))
    top.coalesce(1).orderBy("k").select("value").unionByName(body).write.mode("overwrite").text(f"{folder}/{MATRIX}")
    barcodes.orderBy("matrix_col_index").select("barcode").write.mode("overwrite").text(f"{folder}/{BARCODES}")
    genes.orderBy("matrix_feature_index").select(F.concat_ws("\t", "gene", "gene", "feature_type", F.lit("")).alias("value")).write.mode("overwrite").text(f"{folder}/{FEATURES}")
