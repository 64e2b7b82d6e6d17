"""Spark session settings shared by jobs, tests and the bench.

Everything the library computes runs on whatever session the caller
passes in; this module only provides a sane default for local runs and
the checkpoint-directory rule used by iterative operators.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC timestamps (the reference stores
# TIMESTAMPTZ in UTC), ANSI casts (bad casts fail the load instead of
# silently turning into NULL), AQE with skew-join splitting.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # coalesce to the advisory size, not to the cluster's parallelism:
    # fewer tiny tasks on a busy cluster
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Skip per-call Python call-site capture (several JVM round trips per
    # functions.* call while building plans); batch jobs do not need it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(
    master: str | None = None,
    app_name: str = "tablework",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the library's base settings.

    On a cluster pass ``master=None`` and let spark-submit decide; the
    shuffle partition count then stays whatever the cluster config says
    unless given here.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the whole cluster; 4g fits small
        # test machines and is plenty for the test scales
        conf.setdefault("spark.driver.memory", os.environ.get("TABLEWORK_DRIVER_MEMORY", "4g"))
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory of the cluster.

    The cluster names it in ``spark.checkpoint.dir``; only a local session
    gets a fresh temp directory when nothing is configured (tests).  On a
    cluster that is an error: executors do not see each other's disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return spark.sparkContext.getCheckpointDir() or configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tablework-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def scale_conf(
    input_bytes: int,
    executor_memory_bytes: int = 16 << 30,
    executor_cores: int = 4,
    target_partition_bytes: int = 256 << 20,
) -> dict[str, str]:
    """Settings that keep tasks inside executor memory at a given input size.

    * scan splits: ``maxPartitionBytes`` = the target partition size, capped
      so one core's share of executor memory holds ~4 splits (decoded rows
      are larger than parquet bytes);
    * shuffles: start with ``input / target`` partitions (at least 200) and
      let AQE coalesce small ones towards the same advisory size, so the
      reducers of a 100 TB job are ~256 MB each, not 500 GB;
    * skew: AQE splits any partition over 5x the median and over 4x the
      target size (hot keys).
    """
    per_core = executor_memory_bytes // max(1, executor_cores)
    split = max(32 << 20, min(target_partition_bytes, per_core // 4))
    shuffle_parts = max(200, -(-input_bytes // split))
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(split),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * split),
    }


def apply_scale_conf(spark: SparkSession, input_bytes: int, **kwargs) -> dict[str, str]:
    """Set ``scale_conf`` on a running session (all are runtime SQL confs)."""
    conf = scale_conf(input_bytes, **kwargs)
    for key, value in conf.items():
        spark.conf.set(key, value)
    return conf
