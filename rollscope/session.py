"""SparkSession construction and checkpoint-directory handling."""
from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Session defaults. On a cluster the deployment's own spark-defaults win for
# anything not listed; these are the knobs our plans depend on.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Scoring plans are wide projections; keep them inside one codegen stage...
    "spark.sql.codegen.maxFields": "400",
    # ...unless its generated method passes HotSpot's 8000-byte JIT limit: such a
    # method would run interpreted.  Measured 2x faster scoring at sf0.1.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_spark(master: str | None = None, app: str = "rollscope",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def compile_scoring(spark: SparkSession) -> None:
    """The JIT limit of ``DEFAULT_CONF`` in a session that someone else made (it may be set at any time)."""
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(key, DEFAULT_CONF[key])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory named by ``spark.checkpoint.dir``.

    A cluster must name a shared folder there; we never invent a
    machine-local one except in local mode (tests), where it is unset.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):      # local-cluster[...] is a cluster too
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="rollscope-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def checkpoint_path(spark: SparkSession, *parts: str) -> str:
    """A sub-path of the shared checkpoint folder (stream state, cut tables)."""
    return os.path.join(ensure_checkpoint_dir(spark), *parts)
