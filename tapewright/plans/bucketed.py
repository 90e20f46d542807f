"""Keyed tables in buckets by the hash of the key: a merge reads and writes only the buckets that its batch meets.

``folder/data/<version>/_bucket=<n>`` holds a bucket's Parquet files and is never changed. A manifest names the version of each bucket, and ``folder/CURRENT`` the manifest that readers
take, which is replaced in one step: readers see the table before a merge or after it, whole, and a merge that fails or runs again leaves only files that nothing names. Manifests and versions
that ``vacuum`` finds unnamed go. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.plans.snapshots import _fs, _names, _point, _text, current
from tapewright.sources.scratch import put


def _bucket(key: list[str], n: int) -> Column:
    """Keys that are null go to a bucket too."""
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def _manifest(spark: SparkSession, folder: str) -> dict:
    name = current(spark, folder)
    if name is None:
        raise ValueError(f"nothing published in {folder}")
    return json.loads(_text(spark, f"{folder}/{name}"))


def _write(df: DataFrame, folder: str, key: list[str], n: int) -> tuple[str, list[int]]:
    """A version's name and the buckets it has. Rows of a bucket are written by one task, or by several that read much."""
    version = uuid.uuid4().hex
    made = df.withColumn("_bucket", _bucket(key, n))
    made.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{folder}/data/{version}")
    return version, [int(x.split("=")[1]) for x in _names(df.sparkSession, f"{folder}/data/{version}") if x.startswith("_bucket=")]


def _publish(spark: SparkSession, folder: str, manifest: dict) -> None:
    name = f"manifest-{uuid.uuid4().hex}.json"
    put(spark, f"{folder}/{name}", json.dumps(manifest).encode())
    _point(spark, folder, name)


def create(df: DataFrame, folder: str, key: list[str], buckets: int = 256) -> None:
    """A table of these rows in place of what the folder had."""
    version, found = _write(df, folder, key, buckets)
    _publish(df.sparkSession, folder, {"key": key, "buckets": buckets, "schema": df.schema.json(), "versions": {str(b): version for b in found}})


def _part(spark: SparkSession, folder: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
    wanted = manifest["versions"] if buckets is None else {str(b): manifest["versions"][str(b)] for b in buckets if str(b) in manifest["versions"]}
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/data/{v}/_bucket={b}" for b, v in wanted.items()])


def read(spark: SparkSession, folder: str) -> DataFrame:
    return _part(spark, folder, _manifest(spark, folder))


def merge(batch: DataFrame, folder: str, rule: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """The table with the buckets of ``batch`` replaced by ``rule(their rows, batch)``, such as ``operators.merge.upsert``; gives the buckets. ``batch`` is read twice.

    The rule's result may hold keys of these buckets alone.
    """
    spark = batch.sparkSession
    manifest = _manifest(spark, folder)
    key, n = manifest["key"], manifest["buckets"]
    met = sorted(r[0] for r in batch.select(_bucket(key, n).alias("b")).distinct().collect())  # as many as there are buckets, at most
    if met:
        version, found = _write(rule(_part(spark, folder, manifest, met), batch), folder, key, n)
        if strange := set(found) - set(met):
            raise ValueError(f"the rule gave keys of other buckets: {sorted(strange)}")
        kept = {b: v for b, v in manifest["versions"].items() if int(b) not in met}
        _publish(spark, folder, manifest | {"versions": kept | {str(b): version for b in found}})
    return met


def vacuum(spark: SparkSession, folder: str) -> int:
    """Removes manifests and versions of buckets that the current manifest doesn't name; gives the number of versions. Not while others read older ones."""
    fs, path = _fs(spark, folder)
    named, gone = _manifest(spark, folder)["versions"], 0
    now = current(spark, folder)
    for name in _names(spark, folder):
        if name.startswith("manifest-") and name != now:
            fs.delete(path(f"{folder}/{name}"), False)
    for version in _names(spark, f"{folder}/data"):
        for part in _names(spark, f"{folder}/data/{version}"):
            if part.startswith("_bucket=") and named.get(part.split("=")[1]) != version:
                gone += fs.delete(path(f"{folder}/data/{version}/{part}"), True)
    return gone
