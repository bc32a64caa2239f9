"""Intermediate results that several later passes read.

A staged frame is written once to the folder the cluster names in
``spark.checkpoint.dir`` and read back, so a lost executor costs a re-read rather
than the whole lineage, and the optimizer knows its true size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_FOLDER = "strideline"
_local: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The shared folder; only where none is configured, a local one is made."""
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="spark-strideline-")
    return _local[app]


def staging_path(spark: SparkSession) -> str:
    """A fresh folder of this application under the staging root."""
    return f"{staging_root(spark)}/{_FOLDER}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stage(frame: DataFrame) -> DataFrame:
    """Write the frame and return it as a plain scan."""
    spark = frame.sparkSession
    path = staging_path(spark)
    frame.write.parquet(path)
    stored = spark.read.schema(frame.schema).parquet(path)
    stored._staged_path = path
    return stored


def discard(frame: DataFrame) -> None:
    """Delete the files of a frame that :func:`stage` returned, after its last reader."""
    spark, path = frame.sparkSession, frame._staged_path
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
