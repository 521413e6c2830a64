"""Spark session helpers.

The library never creates machine-local scratch space on a cluster: lineage is cut
with ``DataFrame.checkpoint()`` into the folder named by ``spark.checkpoint.dir``.
Only when that setting is absent (local tests) do we pick a folder ourselves.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Median/percentile merges are CPU-heavy while their shuffles are small: do not let
    # AQE coalesce them into a single task.  Large inputs stay at the advisory size.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "deluge", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Date/time comparisons must not depend on the machine zone.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a session on one machine (master ``local...``) may do without that setting; on a
    cluster executors would each write to their own disk, so it is an error there.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {sc.master}")
    local = tempfile.mkdtemp(prefix="deluge-ckpt-", dir=os.environ.get("DELUGE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def output_root(spark: SparkSession) -> str:
    """Folder for job outputs that must be readable by every executor.

    Uses ``deluge.output.dir`` when set, else a sub-folder of the checkpoint folder.
    """
    root = spark.conf.get("deluge.output.dir", None)
    if root:
        return root.rstrip("/")
    return checkpoint_dir(spark).rstrip("/") + "/outputs"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut lineage by writing a parquet table in the shared checkpoint folder.

    Computes the plan once (a reliable RDD checkpoint would compute it twice unless
    cached), survives executor loss, and later reads get column pruning and pushdown.
    """
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def partition_sizing(input_bytes: float, executor_cores: int, executors: int,
                     target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle/scan sizing for a job reading ``input_bytes``.

    Shuffle partitions: enough for ~``target_partition_bytes`` each (AQE coalesces
    smaller ones), never fewer than twice the task slots; scans split at the same size.
    At 100 TB with 1000 executors x 8 cores this gives ~400k shuffle partitions of
    256 MiB and 256 MiB file splits.
    """
    slots = max(1, executor_cores * executors)
    parts = max(2 * slots, int(input_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }
