"""Rebroadcasts: recordings of one episode from several dates or broadcasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import keys as K
from tapewright.functions import values as V
from tapewright.operators.groups import join_groups
from tapewright.sources.scratch import written


def groups(df: DataFrame, key: str, date: str, broadcaster: str) -> DataFrame:
    """Keys with two rows or more and over one date or over one broadcaster, empty ones not counted."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    found = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(some(date)).alias("n_dates"), F.countDistinct(some(broadcaster)).alias("n_broadcasters"))
    return found.where("n >= 2 and (n_dates > 1 or n_broadcasters > 1)").withColumn("group_id", K.group_id(F.col(key)))


def classify(df: DataFrame, key: str, flag: str) -> DataFrame:
    """``broadcast_type``: with a true flag in the group rebroadcast for true ones and original for others; with known flags original; else unknown. Rows without a key are one group.

    Flags are put together by the tasks first, and a group with much of the table gets them by a broadcast.
    """
    rows = written(df.withColumns({"_keyed": F.col(key).isNotNull(), "_key": F.coalesce(F.col(key).cast("string"), F.lit(""))}), "episodes")
    found = rows.groupBy("_keyed", "_key").agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.bool_or(flag), F.lit(False)).alias("_some"), F.max(F.col(flag).isNotNull()).alias("_known"))
    kind = F.when(F.col("_some"), F.when(F.coalesce(F.col(flag), F.lit(False)), "rebroadcast").otherwise("original")).when(F.col("_known"), "original").otherwise("unknown")
    return join_groups(rows, written(found, "flags"), ["_keyed", "_key"], "_n").withColumn("broadcast_type", kind).select(*df.columns, "broadcast_type")


def flags_by_path(links: DataFrame, broadcasts: DataFrame) -> DataFrame:
    """A three-valued flag and the greatest broadcaster for each path, over all its broadcasts."""
    return links.join(broadcasts, "broadcast_id").groupBy("path_id").agg(V.three_valued("is_rebroadcast_flag").alias("is_rebroadcast_flag"), F.max("broadcaster").alias("broadcaster"))


def group_titles(df: DataFrame, key: str, title: str, date: str, tie: str) -> DataFrame:
    """Title of each group's earliest member; empty dates last, then by ``tie``."""
    return df.groupBy(key).agg(F.min_by(title, F.struct(F.coalesce(F.nullif(F.col(date), F.lit("")), F.lit("9999")), F.col(tie))).alias("program_title"))


def members(df: DataFrame, key: str, date: str, broadcaster: str, flag: str) -> DataFrame:
    """Rows of rebroadcast groups with group id and type."""
    kept = groups(df, key, date, broadcaster).select(key, "group_id")
    return classify(df.join(kept, key), key, flag)
