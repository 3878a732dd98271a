"""Spark session and checkpoint-directory helpers.

Everything else in the package takes a ``SparkSession`` and returns lazy
DataFrames; this module is the only place that configures Spark.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "hubflow",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return (or create) a session with AQE on and the UI off.

    ``master`` is set only where the caller passes one; otherwise
    ``spark-submit`` and the cluster's configuration decide, as they do over
    memory.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory of the session.

    The cluster names it in ``spark.checkpoint.dir`` and is taken at its word
    (a mounted shared file system has ``file:`` addresses too); we only
    invent one (a scratch folder) in plain local mode with nothing set, as in
    tests. Elsewhere an unset directory is an error rather than a silent
    fallback to a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; iterative operators need a "
                "shared (HDFS/object-store) checkpoint directory")
        configured = tempfile.mkdtemp(prefix="hubflow-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, release: bool = False) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder
    and continue from that table.

    Used by the iterative operators every round: plans stay small, a lost
    executor recomputes from the written table rather than from round 0,
    and -- unlike an RDD checkpoint -- the re-read table carries file-size
    statistics, so Catalyst/AQE can broadcast small state tables in the
    next round. One write job per call. With ``release`` the write's shuffle
    files are deleted when it ends, rather than when the driver's memory is
    next collected.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/hubflow-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    if release:
        spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if release:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._hubflow_path = path
    return out


def is_written(df: DataFrame) -> bool:
    """Whether ``df`` itself is a table of ``cut_lineage`` that was not dropped."""
    return getattr(df, "_hubflow_path", None) is not None


def drop_tables(*frames: DataFrame | None) -> None:
    """Delete the tables that ``cut_lineage`` wrote for ``frames``: for state
    that a later round has replaced and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_hubflow_path", None)
        if path is None:
            continue
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
        df._hubflow_path = None
