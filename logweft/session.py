"""Session settings the operators rely on."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

# Settings every operator assumes: event times are UTC instants, variant
# parsing accepts duplicate keys (a JSON line such as {"a":1,"a":2} is valid
# JSON), and adaptive execution may re-plan joins and coalesce partitions.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the library needs to an existing session."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def get_session(master: str | None = None, app_name: str = "logweft",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session for tests, benches and local runs."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` as the cluster names it.
    A session in local mode (a test) that has none gets one under the system
    temp folder; on a cluster, where executors do not share that folder, it
    is an error.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = os.path.join(os.environ.get("TMPDIR", "/tmp"), "logweft-checkpoints")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return f"{base.rstrip('/')}/{name or 'logweft'}-{uuid.uuid4().hex}"
