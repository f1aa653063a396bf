"""Session set-up shared by jobs, tests and the bench.

Every operator in this package is a DataFrame-in / DataFrame-out function, so
the only session state the library relies on is:

* ``spark.sql.session.timeZone = UTC``: days are cut in UTC.
* AQE on, with skew-join splitting and partition coalescing, so join strategy
  and reducer counts are re-planned from real shuffle statistics.
* A *shared* checkpoint folder (``spark.checkpoint.dir``) used to cut lineage
  where a job must survive executor loss (see :func:`checkpoint_dir`).
"""
from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# SQL confs that are safe to (re)apply on an existing session at runtime.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # packed bytes; sorted rows take some ten times as much memory of a task
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # keyed stream state outside the heap, of which each batch stores its changes
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime confs the library depends on (idempotent)."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


@contextmanager
def set_for(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Runtime confs (``__`` for a dot) that hold inside the block."""
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def freed_shuffles(spark: SparkSession):
    """Jobs of plans made inside the block delete their shuffle files when they end, not when the
    driver happens to collect garbage. Only for plans that are run once."""
    return set_for(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "flowgauge", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's defaults.

    On a cluster leave ``master`` unset and size ``shuffle_partitions`` to the
    data (roughly input bytes / 128 MB); AQE coalesces downwards from there.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(RUNTIME_CONF)
    conf.update({
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    })
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when unset.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared
    filesystem such as HDFS/S3). Only a local-mode session (tests, bench) may
    fall back to a fresh scratch folder; a cluster session without the setting
    is a configuration error, because a machine-local folder would not survive
    the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="flowgauge-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()
