"""SparkSession construction with settings that hold from local[8] to a large cluster."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale, all of them plain Spark configuration:
# - AQE re-plans at runtime: coalesces small shuffle partitions, splits skewed
#   join partitions, and turns a sort-merge join into a broadcast join only after
#   it has *measured* the build side (a size check done by Spark itself).
# - advisoryPartitionSizeInBytes keeps post-shuffle partitions near 128 MB, so a
#   large shuffle.partitions value on a cluster does not produce tiny tasks.
# - The Spark UI is off: it is a web server and is not needed for batch jobs.
_SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    # coalescing never makes a partition smaller than this; 256 KB (default 1 MB)
    # keeps small shuffles spread over the cores and is irrelevant for large ones
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(256 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # checkpoints (positions, exact quantiles) are deleted once no longer referenced;
    # otherwise every run would leave its key columns in the shared checkpoint folder
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tillroll", extra_conf: dict | None = None) -> SparkSession:
    """Return a SparkSession configured for the library.

    ``master`` and ``shuffle_partitions`` are only applied when given, so on a
    cluster the submit-time configuration wins.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _SCALE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("TILLROLL_DRIVER_MEMORY", "16g"))
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only when unset.

    On a cluster the setting names a shared folder (HDFS / object store) that
    survives executor loss, and it is required; only local-mode sessions (tests)
    fall back to a fresh temporary folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if current is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors "
                               "(HDFS / object store); a machine-local folder cannot hold checkpoints")
        local_dir = tempfile.mkdtemp(prefix="tillroll-ckpt-")
        sc.setCheckpointDir(local_dir)
        try:
            spark.conf.set("spark.checkpoint.dir", local_dir)
        except Exception:  # noqa: BLE001 - not settable at runtime on some deployments
            pass
        return local_dir
    return current
