"""Ranks over whole tables without a window that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.sources.scratch import written


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", ties: list[str] | None = None) -> DataFrame:
    """Adds a gapless rank from 0 within ``keys`` (none: over all rows), by ``order`` and ``ties``; nulls come first and equal rows in any order.

    Rows are dealt by ranges of (keys, order) and sorted there, whatever the ids' values. Without ``ties`` the last sort column is the row's place in
    ``df``, so that even equal rows spread; ``ties`` are for columns too long for the ranges' bounds. A range's rows of a key are numbered by place; what
    lies before comes from counts of (key, range), of which a key has at most one for each range. ``df`` is read twice (the ranges' bounds are sampled); hand
    in a table that is cheap to read. The ranked rows are written once.
    """
    by = [*keys, *order] if ties else [*keys, *order, "_tie"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by, *ties or []).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt.drop("_tie").withColumn("_range", F.shiftright("_at", 33)), "ranges")
    found = dealt.groupBy(*keys, "_range").agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys or [F.lit(0)]).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    found = found.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)], F.col("_range").alias("_of"), (F.coalesce(before, F.lit(0)) - F.col("_least")).alias("_shift"))
    same = F.col("_range") == F.col("_of")
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_key{i}"))
    return dealt.join(found, same).withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)
