"""Session settings and the shared folder for written stage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def build_session(cores: int | str | None = None, app_name: str = "cellweave", **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    Master, memory and partition numbers are the cluster's own, except in a local session
    of ``cores`` threads.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app_name)
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
        # small local inputs still use all cores
        settings |= {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB", "spark.driver.memory": "12g"}
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Folder for stage tables: the session's ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster the setting
    has to name storage that outlives any single executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix="spark-cellweave-")
    return _LOCAL_ROOTS[sc.applicationId]


def write_stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage like ``checkpoint()`` does, and unlike it keeps column pruning,
    statistics and filter pushdown for the readers. Lost executors re-read the files.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
