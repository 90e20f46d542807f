"""Incremental ingest: new files of a folder, each batch merged once, by keys that a stream holds as state.

Two streams work in turn. The first takes the files that are new since its checkpoint (``availableNow``), and lays each batch, with one row for a key, into a folder of its own below
``<table>-keys/staged``, moved there in one step. The second reads these folders, drops rows whose key it has seen (``dropDuplicates`` over RocksDB), and writes what is left to
the table's folder of its batch. So a batch costs reads and writes by its own size: state is looked up by key, never read as a whole, and is changed by deltas.

A table that is older than its state is staged first, keys alone. Folders are named by number and replaced as a whole, so running a batch again changes nothing, for rows without
a key too. One ingest at a time writes a table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.operators.merge import first_wins
from tapewright.sources.scratch import put

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _stage(rows: DataFrame, folder: str, name: str) -> None:
    """Writes a staged folder beside and moves it into place; one that is there stays."""
    spark, path = rows.sparkSession, rows.sparkSession._jvm.org.apache.hadoop.fs.Path
    if _exists(spark, f"{folder}/staged/{name}"):
        return
    rows.write.mode("overwrite").parquet(f"{folder}/next/{name}")
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{folder}/staged"))
    if not fs.rename(path(f"{folder}/next/{name}"), path(f"{folder}/staged/{name}")):
        raise OSError(f"can't move {folder}/next/{name}")


def _state_name(spark: SparkSession, folder: str) -> str:
    """A name that the state has for good, so that another state of the same table never writes over its batches."""
    if not _exists(spark, f"{folder}/name"):
        put(spark, f"{folder}/name", uuid.uuid4().hex[:12].encode())
    return spark.read.text(f"{folder}/name", wholetext=True).first()[0]


def _keyed_stream(spark: SparkSession, schema: T.StructType, table: str, folder: str, key: str, then: Callable[[DataFrame], None] | None):
    """The second stream: staged rows of keys it hasn't seen, and those without a key, go to the table."""
    name = _state_name(spark, folder)

    def add(fresh: DataFrame, number: int) -> None:
        fresh = fresh.where(~F.col("_known")).drop("_known")
        fresh.write.mode("overwrite").parquet(f"{table}/batch={name}-{number:09d}")
        if then:
            then(fresh)

    staged = spark.readStream.schema(schema).parquet(f"{folder}/staged/*")
    fresh = staged.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(staged.where(F.col(key).isNull()))
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)  # a query takes the setting that holds when it starts
    try:
        return fresh.writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").start()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def ingest_new(spark: SparkSession, source: str, schema: str, table: str, key: str, order: str, checkpoint: str, files_per_batch: int = 50, then: Callable[[DataFrame], None] | None = None) -> None:
    """Adds rows of new JSON files to the Parquet ``table`` unless their key is there, of a batch's rows of one key that of least ``order``; null keys are never there.

    ``table`` is partitioned by ``batch``; its keys' state lies in ``<table>-keys``. ``then`` is given each batch's new rows.
    """
    folder, name = f"{table}-keys", hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    staged = T.StructType([*stream.schema, T.StructField("_known", T.BooleanType())])
    if _exists(spark, table) and not _exists(spark, folder):
        there = spark.read.schema(stream.schema).parquet(table).where(F.col(key).isNotNull()).dropDuplicates([key])
        _stage(there.withColumn("_known", F.lit(True)).select(*staged.fieldNames()), folder, "0-table")
    path = spark._jvm.org.apache.hadoop.fs.Path
    path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path(f"{folder}/staged"))
    keyed = _keyed_stream(spark, staged, table, folder, key, then)

    def stage(batch: DataFrame, number: int) -> None:
        rows = first_wins(batch.where(F.col(key).isNotNull()), [key], order).unionByName(batch.where(F.col(key).isNull()))
        _stage(rows.withColumn("_known", F.lit(False)).select(*staged.fieldNames()), folder, f"{name}-{number:09d}")
        keyed.processAllAvailable()

    try:
        keyed.processAllAvailable()  # what an earlier run has staged
        stream.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        keyed.stop()


def append_events(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """An audit trail is only ever appended to."""
    stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def illegal_transitions(log: DataFrame, run: str, order: str, phase: str, allowed: DataFrame) -> DataFrame:
    """Phase changes of a log that the table (before, after) doesn't allow."""
    from pyspark.sql import Window as W

    steps = log.withColumn("before", F.lag(phase).over(W.partitionBy(run).orderBy(order))).where("before is not null").withColumn("after", F.col(phase))
    return steps.join(allowed, ["before", "after"], "left_anti")
