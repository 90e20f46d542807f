"""Keyed upserts without a table format: both sides meet in one join, a rule decides each row, the result replaces the table.

An incoming batch is applied as if row by row: of rows with one key the last in batch order counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OLD, NEW = "o", "n"


def last_wins(batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of greatest ``order`` of each key, a null key's too. Spark limits a window whose rank is asked to be 1 before the exchange, so a key's task gets one row from each other task."""
    w = W.partitionBy(*key).orderBy(F.desc(order))
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(batch: DataFrame, key: list[str | Column], order: str) -> DataFrame:
    """The row of least ``order`` of each key, likewise."""
    w = W.partitionBy(*key).orderBy(order)
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(table: DataFrame, batch: DataFrame, key: list[str], columns: dict[str, Callable[[Column, Column], Column]] | None = None, guard: Callable[[Callable, Callable], Column] | None = None) -> DataFrame:
    """``table`` after inserting or updating by ``batch`` (unique by key, the same columns).

    columns: how a column of an updated row comes from (old, new); others take the new value.
    guard: condition, given functions that look up old and new columns, under which an existing row may change.
    """
    t = table.withColumn("_there", F.lit(True)).alias(OLD)
    b = batch.select(*table.columns).withColumn("_comes", F.lit(True)).alias(NEW)
    on = [F.col(f"{OLD}.{k}").eqNullSafe(F.col(f"{NEW}.{k}")) for k in key]
    both = t.join(b, on, "full_outer")
    old, new = (lambda c: F.col(f"{OLD}.{c}")), (lambda c: F.col(f"{NEW}.{c}"))
    there, comes = F.coalesce(old("_there"), F.lit(False)), F.coalesce(new("_comes"), F.lit(False))
    update = there & comes & (F.coalesce(guard(old, new), F.lit(False)) if guard else F.lit(True))
    rule = columns or {}

    def value(c: str) -> Column:
        changed = rule[c](old(c), new(c)) if c in rule else new(c)
        return F.when(~there, new(c)).when(update, changed).otherwise(old(c)).alias(c)

    return both.select(*[value(c) for c in table.columns])


def insert_new(table: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the table lacks are added; others are left alone. A null key is never there already."""
    fresh = batch.join(table.select(*key), key, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def keep_old(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def keep_new(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def greatest(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def reviewed_guard(old: Callable, new: Callable) -> Column:
    """A human-reviewed row gives way to a human-reviewed one alone."""
    return ~F.coalesce(old("human_reviewed") == 1, F.lit(False)) | (new("source") == "human_reviewed")


def strict_guard(old: Callable, new: Callable) -> Column:
    """A human-reviewed row gives way to none."""
    return ~F.coalesce(old("human_reviewed") == 1, F.lit(False))


def protected(table: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The rows that ``strict_guard`` keeps from this batch."""
    return table.where("human_reviewed = 1").join(batch.select(*key), key, "left_semi")


def add_history(history: Column, source: Column, at: Column, changed: Column) -> Column:
    """History (array of source, at, fields) with an entry of the changed fields, sorted."""
    return F.concat(F.coalesce(history, F.array()), F.array(F.struct(source.alias("source"), at.alias("at"), F.array_sort(changed).alias("fields"))))


def changed_fields(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names whose new value is not null and differs."""
    return F.array_compact(F.array(*[F.when(n.isNotNull() & ~n.eqNullSafe(o), F.lit(k)) for k, (o, n) in pairs.items()]))


def merge_on_collision(src: DataFrame, dst: DataFrame, key: str) -> DataFrame:
    """Two metadata rows of one key: human-reviewed first, then the newer, ties to ``dst``; histories united, ``dst`` first."""
    columns = [c for c in dst.columns if c != key]
    s, d = src.alias("s"), dst.alias("d")
    both = s.join(d, F.col(f"s.{key}") == F.col(f"d.{key}"), "full_outer")
    rank = lambda t: F.struct(F.coalesce(F.col(f"{t}.human_reviewed"), F.lit(0)), F.coalesce(F.col(f"{t}.updated_at"), F.lit("")))
    from_src = F.col(f"d.{key}").isNull() | (F.col(f"s.{key}").isNotNull() & (rank("s") > rank("d")))

    def value(c: str) -> Column:
        if c == "source_history":
            a, b = (F.coalesce(F.col(f"{t}.source_history"), F.array()) for t in ("d", "s"))
            return F.concat(a, F.array_except(b, a)).alias(c)
        return F.when(from_src, F.col(f"s.{c}")).otherwise(F.col(f"d.{c}")).alias(c)

    return both.select(F.coalesce(f"d.{key}", f"s.{key}").alias(key), *[value(c) for c in columns])


def remap_keys(df: DataFrame, mapping: DataFrame, column: str, key: list[str], prefer: str) -> DataFrame:
    """``column`` rewritten by ``mapping`` (old, new); of rows that then share a key the one with a ``prefer`` value stays (the greatest)."""
    out = df.join(mapping.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
    rest = [c for c in df.columns if c not in key]
    best = F.max(F.struct(F.col(prefer).isNotNull().alias("has"), F.col(prefer), *[F.col(c) for c in rest if c != prefer]))
    return out.groupBy(*key).agg(best.alias("_b")).select(*[F.col(c) if c in key else F.col(f"_b.{c}").alias(c) for c in df.columns])
