"""JSON lines with an optional first row ``_meta``: strict, tolerant and counting readers, and the writer."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.sources.scratch import put, written


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank, without byte order marks."""
    return spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails on a line that isn't JSON."""
    kept = lines(spark, path).where(F.get_json_object("value", "$._meta").isNull())
    return kept.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects alone; lines that aren't JSON and ``_meta`` rows are left out."""
    good = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{") & F.get_json_object("value", "$._meta").isNull()
    return lines(spark, path).where(good).select(F.from_json("value", schema).alias("r")).select("r.*")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: data rows, rows that begin like objects, rows that can't be parsed."""
    meta = F.get_json_object("value", "$._meta").isNotNull()
    return lines(spark, path).agg(F.count_if(~meta).alias("n_rows"), F.count_if(F.trim("value").startswith("{")).alias("n_objects"), F.count_if(F.try_parse_json("value").isNull()).alias("n_errors"))


def queue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A queue: a ``_meta`` row counts as such on a file's first line alone, and all other rows must have a ``path_id``; a line that isn't JSON fails."""
    at = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    first = at.where("_block = 0").groupBy("_file").agg(F.min("_at").alias("_first"))  # one row for each file
    text = F.regexp_replace("value", "^\ufeff", "")
    head = F.get_json_object(text, "$._meta").isNotNull() & (F.col("_at") == F.col("_first"))
    rows = at.join(first, "_file").where((F.trim(text) != "") & ~F.coalesce(head, F.lit(False))).select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rows.withColumn("path_id", F.when(F.col("path_id").isNotNull(), F.col("path_id")).otherwise(F.raise_error(F.lit("queue row without path_id"))))


def write(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """Part files of JSON lines; ``meta`` in a file of its own, ``_meta.json``, which readers of the folder pass over."""
    df.write.mode("overwrite").json(path)
    if meta is not None:
        put(df.sparkSession, f"{path}/_meta.json", json.dumps({"_meta": meta}, ensure_ascii=False, sort_keys=True).encode())


def tagged(df: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind of a union with a ``kind`` column."""
    return df.where(F.col("kind") == kind)


#: A JSON string, and text without braces outside strings.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_FLAT = rf'(?:[^{{"]++|{_STRING})*+'


def _count(text: Column, mark: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{mark}]", ""))


def _running(df: DataFrame, **values: Column) -> DataFrame:
    """Adds sums over the rows before a row of its file, in the order (_file, _block, _at); written. A window holds one block of a file, and blocks meet by their sums."""
    at, order = ["_file", "_block"], W.partitionBy("_file", "_block").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    inside = {f"_in{name}": F.coalesce(F.sum(v).over(order), F.lit(0)) for name, v in values.items()}
    df = written(df.withColumns(inside | {f"_of{name}": v for name, v in values.items()}), "pieces")
    before = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = df.groupBy(*at).agg(*[F.sum(f"_of{name}").alias(name) for name in values])
    blocks = blocks.select(*at, *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_before{name}") for name in values])
    out = df.join(blocks, at).withColumns({name: F.col(f"_in{name}") + F.col(f"_before{name}") for name in values})
    return out.drop(*[f"{x}{name}" for name in values for x in ("_in", "_of", "_before")])


def _joined(df: DataFrame, group: str, keep: list[str]) -> DataFrame:
    """Pieces of a group put together where the first of them stands, with the first one's ``keep``."""
    parts = F.array_sort(F.collect_list(F.struct("_block", "_at", "value", *keep)))
    first = F.col("p")[0]
    return df.groupBy("_file", group).agg(parts.alias("p")).select("_file", first["_block"].alias("_block"), first["_at"].alias("_at"), F.array_join("p.value", "").alias("value"), *[first[c].alias(c) for c in keep])


def hash_report(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, path, size, hash) of a duplicate finder's report: one JSON object of size to groups of files, each with path, size and hash. Groups of under two distinct paths are left out.

    A report is one document but is read by all tasks: a text source with a separator of its own splits it at closing braces, wherever they stand, and running sums over the pieces
    tell what these are: of quotes, whether a brace stands inside a string; of braces, whether it closes a file's entry; of keys and brackets, to which size and group of it an entry
    belongs. No task holds more than a block and what reaches over its end.
    """
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]
    pieces = spark.read.option("lineSep", "}").text(path).select(F.concat("value", F.lit("}")).alias("value"), *at)
    quotes = _count(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    pieces = _running(pieces, _quotes=quotes)
    ended = ((F.col("_quotes") + quotes) % 2 == 0).cast("int")
    pieces = _joined(_running(pieces, _n=ended), "_n", [])
    bare = F.regexp_replace("value", f"(?s){_STRING}", "")
    deeper = _count(bare, "{") - _count(bare, "}")
    pieces = _running(pieces, _deep=deeper)
    closed = (F.col("_deep") + deeper == 1).cast("int")  # inside the report's own object alone
    entries = _joined(_running(pieces, _n=closed), "_n", ["_deep"])
    text = F.when(F.col("_deep") == 0, F.regexp_replace("value", r"^[^{]*\{", "")).otherwise(F.col("value"))
    head = F.regexp_extract("text", rf"(?s)^({_FLAT})\{{", 1)
    entries = entries.select("_file", "_block", "_at", text.alias("text")).withColumn("head", head).where(F.col("text").rlike(rf"(?s)^{_FLAT}\{{.*\}}$"))
    last = rf'(?s)"([^"\\]*+(?:\\.[^"\\]*+)*+)"\s*:([^"]*)$'
    entries = entries.withColumns({"key": F.regexp_extract("head", last, 1), "keyed": F.col("head").rlike(last).cast("int"), "open": _count(F.when(F.col("head").rlike(last), F.regexp_extract("head", last, 2)).otherwise(F.col("head")), r"\[")})
    entries = _running(entries, _runs=F.col("keyed"), _open=F.col("open")).withColumn("_run", F.col("_runs") + F.col("keyed"))
    sizes = entries.groupBy("_file", "_run").agg(F.max("key").alias("size_key"), F.min("_open").alias("_base"))
    group = F.concat_ws("#", "size_key", (F.col("_open") + F.col("open") - F.col("_base") - 2).cast("string"))
    entry = F.from_json(F.expr("substring(text, length(head) + 1)"), "path string, size long, hash string")
    found = entries.join(sizes, ["_file", "_run"]).select(group.alias("group_id"), entry.alias("f")).where("f.path is not null")
    rows = found.select("group_id", "f.path", F.greatest("f.size", F.lit(0)).alias("size"), "f.hash").distinct()
    return rows.join(rows.groupBy("group_id").agg(F.countDistinct("path").alias("_n")).where("_n > 1").select("group_id"), "group_id")
