"""Versions of a table: written beside each other, one of them current by a pointer that is replaced in one step; snapshots, restoring and rotation.

``folder/version=...`` holds a version's Parquet files and is never changed; ``folder/CURRENT`` names the version that readers take. A crash leaves the
pointer on the old version, and files that nothing points at, which ``rotate`` removes. Times are handed in as ``YYYYMMDD_HHMMSS``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tapewright.sources.scratch import put


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _fs(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(path(folder))) if fs.exists(path(folder)) else []


def _text(spark: SparkSession, file: str) -> str | None:
    fs, path = _fs(spark, file)
    return spark.read.text(file, wholetext=True).first()[0] if fs.exists(path(file)) else None


def _point(spark: SparkSession, folder: str, version: str) -> None:
    """The pointer is written beside and moved over the old one, which the file system does in one step."""
    put(spark, f"{folder}/CURRENT.{version}", version.encode())
    _, path = _fs(spark, folder)
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(path(f"{folder}/CURRENT.{version}"), path(f"{folder}/CURRENT"), options)


def current(spark: SparkSession, folder: str) -> str | None:
    """Name of the version that readers take."""
    return _text(spark, f"{folder}/CURRENT")


def publish(df: DataFrame, folder: str) -> str:
    """Writes a new version, then points at it: readers see the old one or the new one, whole."""
    version = f"version={uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{version}")
    _point(df.sparkSession, folder, version)
    return version


def read(spark: SparkSession, folder: str) -> DataFrame:
    version = current(spark, folder)
    if version is None:
        raise ValueError(f"nothing published in {folder}")
    return spark.read.parquet(f"{folder}/{version}")


def backup(spark: SparkSession, folder: str, at: str, descriptor: str = "") -> str:
    """Keeps the current version under the name ``bak_<at>[_<descriptor>]``; versions don't change, so nothing is copied."""
    version = current(spark, folder)
    if version is None:
        raise ValueError(f"nothing published in {folder}")
    name = f"bak_{at}" + (f"_{descriptor.strip()}" if descriptor.strip() else "")
    put(spark, f"{folder}/{name}", version.encode())
    return name


def backups(spark: SparkSession, folder: str) -> list[dict]:
    """(name, created_at, descriptor, version), newest first."""
    found = []
    for name in _names(spark, folder):
        if name.startswith("bak_") and len(name) >= 19:
            found.append({"name": name, "created_at": name[4:19], "descriptor": name[20:], "version": _text(spark, f"{folder}/{name}")})
    return sorted(found, key=lambda x: (x["created_at"], x["name"]), reverse=True)


def restore(spark: SparkSession, folder: str, name: str, at: str) -> str:
    """Points at a backup's version again, after a backup of what is current (``pre_restore``)."""
    version = _text(spark, f"{folder}/{name}")
    if version is None:
        raise ValueError(f"no backup {name}")
    if current(spark, folder):
        backup(spark, folder, at, "pre_restore")
    _point(spark, folder, version)
    return version


def rotate(spark: SparkSession, folder: str, keep: int = 10) -> list[str]:
    """Removes all but the newest ``keep`` backups, then versions that neither they nor the pointer name. Gives the backups' names. For the one writer of a table."""
    fs, path = _fs(spark, folder)
    gone = [x["name"] for x in backups(spark, folder)[keep:]]
    for name in gone:
        fs.delete(path(f"{folder}/{name}"), False)
    used = {x["version"] for x in backups(spark, folder)} | {current(spark, folder)}
    for name in _names(spark, folder):
        if name.startswith("version=") and name not in used:
            fs.delete(path(f"{folder}/{name}"), True)
    return gone
