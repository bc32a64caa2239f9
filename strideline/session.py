"""Session settings the library is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # Event times are zone-free; pinning the zone keeps epoch arithmetic exact.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Static settings, for sessions built here alone; a session of someone else keeps its own.
# Call-site capture costs several driver round trips per column expression.
BUILD_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it.

    A cluster has the package installed, or gets it with ``--py-files``; this serves workers that share the driver's folders.
    """
    environment = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])
    return spark


def local_session(app: str, cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("STRIDELINE_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in {**BUILD_CONF, **RUNTIME_CONF}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
