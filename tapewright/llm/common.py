"""What the corpus operators share: reading tables, tables in the shared folder, ranks by ranges, and joins with hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators.ranks import ranked
from tapewright.sources.scratch import text_batches, written

__all__ = ["NULL_ID", "id_key", "join_hot", "materialize", "ranked", "read", "text_batches", "without"]

#: Where null ids stand: before all others.
NULL_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there and lost executors cost no recomputation. The files go when the driver's JVM ends."""
    return written(df, label)


def id_key(name: str, spread: str | None = None) -> Column:
    """An id for joins and blocks that is never null: null ids stand before all others, by a hash of ``spread`` if it is named."""
    null = F.lit(NULL_ID) if spread is None else F.lit(NULL_ID) + F.shiftrightunsigned(F.xxhash64(spread), 2)
    return F.coalesce(F.col(name).cast("long"), null)


def without(df: DataFrame, *outputs: str) -> DataFrame:
    """``df`` without columns whose names an operator needs for itself: its outputs, and those that begin with ``_``."""
    taken = {x.lower() for x in outputs}
    return df.drop(*[c for c in df.columns if c.startswith("_") or c.lower() in taken])


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], n: str, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``table``, which has each of the ``keys`` once, with the number ``n`` of rows that hold it (dropped).

    Keys of more than one in ``share`` of the rows, of which there are fewer than ``share``, go to every task; the others meet in a shuffle. Both are read more than once.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = table.where(F.col(n) * share > total).drop(n)
    if hot.isEmpty():
        return rows.join(table.drop(n), keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(n) * share <= total).drop(n), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys))
