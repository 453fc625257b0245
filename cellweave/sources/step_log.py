"""Append-only step log: one JSON object per line with time stamps, event and payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

LOCAL_ZONE = "America/Chicago"
LOG_SCHEMA = T.StructType([
    T.StructField("timestamp_utc", T.StringType()), T.StructField("timestamp_local", T.StringType()),
    T.StructField("event", T.StringType()), T.StructField("payload", T.StringType())])


def log_rows(rows: DataFrame, ts: str, event: str, payload: str) -> DataFrame:
    fmt = "yyyy-MM-dd'T'HH:mm:ss"
    return rows.select(F.date_format(ts, fmt).alias("timestamp_utc"), F.date_format(F.from_utc_timestamp(F.col(ts), LOCAL_ZONE), fmt).alias("timestamp_local"),
                       F.col(event).alias("event"), F.col(payload).alias("payload"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """Log lines with the payload parsed to the given struct type."""
    return spark.read.schema(LOG_SCHEMA).json(path).withColumn("payload", F.from_json("payload", payload))


def read_traces(spark: SparkSession, path: str, step: str) -> DataFrame:
    """Action traces: JSON documents with an array of steps, one row per step (gz is transparent)."""
    docs = spark.read.schema(f"episode_id string, steps array<{step}>").json(path)
    return docs.select("episode_id", F.posexplode("steps").alias("step_offset", "s")).select("episode_id", "step_offset", "s.*")


def write_traces(steps: DataFrame, key: str, order: str, path: str) -> None:
    """One gzip JSON document for each ``key``: its steps in order, each with the fields its action has."""
    fields = F.struct(*[c for c in steps.columns if c != key])
    listed = steps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), fields.alias("step")))).alias("rows"))
    listed.select(key, F.transform("rows", lambda x: x["step"]).alias("steps")).write.option("compression", "gzip").json(path)


def read_action_traces(spark: SparkSession, path: str, key: str = "episode_id bigint") -> DataFrame:
    """Action traces, one row per step: the key, step_offset and the step as VARIANT, since steps differ by action.

    Reads plain and compressed documents. A document without a list of steps is an error; an empty list has no rows.
    """
    name = key.split()[0]
    docs = spark.read.schema(f"{key}, steps variant").json(path)
    is_list = F.coalesce(F.schema_of_variant("steps").startswith("ARRAY<"), F.lit(False))
    steps = F.when(is_list, F.col("steps").cast("array<variant>")).otherwise(F.raise_error(F.concat(F.lit("action trace without a list of steps: "), F.coalesce(F.col(name).cast("string"), F.lit("no key")))).cast("array<variant>"))
    return docs.select(name, F.posexplode(steps).alias("step_offset", "step"))
