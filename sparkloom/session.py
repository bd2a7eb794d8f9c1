"""Spark session settings the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that change results; an existing session gets them as well.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

#: Settings that change only the plan; used when this module builds the session.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, driver_memory: str = "12g", **extra: str) -> SparkSession:
    """A single-JVM session for tests and benches; a cluster passes its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkloom")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in {**SEMANTIC_CONF, **PLAN_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return apply_semantics(spark)


def apply_semantics(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on."""
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)
    return spark


def work_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder that the driver and all executors share: below spark.checkpoint.dir, or a temporary one where a single process runs all."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
