"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Pages can be large, so Arrow batches are bounded by bytes as well as rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    # Streaming deduplication may keep more keys than fit on the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Recording the call site of every expression makes long plans slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def builder(app_name: str = "adloom") -> SparkSession.Builder:
    """A session builder with the settings the engine is tuned for."""
    result = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        result = result.config(key, value)
    return result


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder that the cluster names.

    Every executor must reach this path. Without a configured folder it lies below
    the warehouse, which a cluster shares as well.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            warnings.warn(f"{CHECKPOINT_DIR} is not set; the warehouse must be shared", stacklevel=2)
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_adloom"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(rows: DataFrame) -> DataFrame:
    """A table that is read in fewer parts than there are cores, dealt out to all of them.

    A small table may be one row group, which one task would have to work off.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
