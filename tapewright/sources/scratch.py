"""Folders for intermediate files, under the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, label: str = "table") -> str:
    """A new path below ``spark.checkpoint.dir``, which goes when the driver's JVM ends; below a local folder on a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}"
    path = f"{root.rstrip('/')}/tapewright-{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` as Parquet in such a folder, read back."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """``df``, after lowering the session's rows in an Arrow batch to ``rows``, as batches go by rows and texts can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name, "10000")) <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """One file with these bytes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()
