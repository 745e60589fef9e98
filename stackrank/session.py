"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every plan in the package relies on. AQE re-plans joins from runtime
# sizes (that is our size check before a broadcast) and splits skewed join
# partitions; ANSI mode stays on, so operators use try_* functions explicitly.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def cluster_conf(executors: int = 1000, cores_per_executor: int = 8) -> dict:
    """Settings for a large cluster (the data volume of the package's design target).

    Shuffle partitions start high and AQE coalesces them to ~256 MB; scans split
    files at 256 MB; skewed join partitions are split by AQE. ``spark.checkpoint.dir``
    must name a shared folder (set by the cluster, read by ``ensure_checkpoint_dir``).
    """
    return {
        **DEFAULT_CONF,
        "spark.sql.shuffle.partitions": str(executors * cores_per_executor * 3),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "stackrank.fit.parallelism": "8",
    }


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "stackrank", extra_conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    Only in local mode a private scratch folder is created when it is unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if configured:
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    path = tempfile.mkdtemp(prefix="stackrank-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path
