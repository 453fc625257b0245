"""Incremental ingest: the mergeable aggregates of the batch operators over file streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.claims import COUNTS
from ..session import stage_root


def _fresh(spark: SparkSession, label: str) -> str:
    return f"{stage_root(spark)}/{spark.sparkContext.applicationId}/stream-{label}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def partials(stream: DataFrame, reduce: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Run ``reduce`` on every micro-batch and keep its rows; returns all partial rows.

    A batch writes its own folder, so a retried batch replaces its earlier attempt and
    nothing is counted twice.
    """
    spark = stream.sparkSession
    out, checkpoint = _fresh(spark, label), _fresh(spark, label + "-offsets")

    def store(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(store).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def nucleus_moments(stream: DataFrame) -> DataFrame:
    """Same rows as the batch nucleus moments, merged from per-batch partial sums."""
    from ..operators.nuclei import nucleus_moments as reduce
    p = partials(stream, reduce, "moments")
    return p.groupBy("cell_id").agg(*[F.sum(c).alias(c) for c in ("nuclear_pixel_count", "sum_x", "sum_y")],
                                    *[f(c).alias(c) for f, c in ((F.min, "min_x"), (F.max, "max_x"), (F.min, "min_y"), (F.max, "max_y"))])


def pixel_counts(stream: DataFrame, buckets: DataFrame, rectangle: DataFrame) -> DataFrame:
    """Same rows as the batch pixel counts per (bin, cell, type)."""
    from ..operators.claims import pixel_counts as reduce
    from ..operators.grid import assign_pixels

    def one(batch: DataFrame) -> DataFrame:
        typed = batch if "cell_type" in batch.columns else batch.withColumn("cell_type", F.lit(None).cast("string"))
        return reduce(assign_pixels(typed, buckets, rectangle))

    p = partials(stream, one, "pixels")
    return p.groupBy("bin_ordinal", "cell_id", "cell_type").agg(*[F.sum(c).alias(c) for c in (*COUNTS, "total_compartment_pixels")])


def episode_monitor(stream: DataFrame) -> DataFrame:
    """Running count, reward sum and last step per episode, kept as streaming state.

    Each trigger emits the changed episodes; the newest row per episode is the current one.
    """
    spark = stream.sparkSession
    running = stream.groupBy("episode_id").agg(F.count("*").alias("n_steps"), F.sum("reward").alias("total_reward"), F.max("step_index").alias("last_step"))
    out, checkpoint = _fresh(spark, "monitor"), _fresh(spark, "monitor-state")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = running.writeStream.outputMode("update").foreachBatch(store).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    query.awaitTermination()
    changes = spark.read.parquet(out)
    return changes.groupBy("episode_id").agg(F.max_by(F.struct("n_steps", "total_reward", "last_step"), "version").alias("s")).select("episode_id", "s.*")
