"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


# Keyed state of streams lies on disk, not in the memory of executors.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "tickertide", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Joins carry no broadcast hints: adaptive execution measures the shuffled side and
    broadcasts it only under ``autoBroadcastJoinThreshold``, and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table, in the folder named by ``spark.checkpoint.dir``.

    Where that setting is absent, tables go below the warehouse folder. On a cluster that folder must
    not be on the disk of one machine: executors would each write to their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tickertide"
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) and _on_one_machine(spark, root):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _on_one_machine(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
