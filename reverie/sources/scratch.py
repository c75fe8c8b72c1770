"""Intermediate tables on storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_root(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="reverie-")


def folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, removed when the JVM ends; a temporary folder on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _local_root(spark.sparkContext.applicationId)
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` out and reads it back: its lineage ends here."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
