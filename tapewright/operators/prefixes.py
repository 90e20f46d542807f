"""Prefix matches by one scan of sorted ranges.

In sorted order all strings that begin with an entry stand side by side behind it. Entries and titles are dealt to ranges between bounds that a sample gives, sorted there, and scanned with a
stack of the entries that the current string begins with. An entry whose extensions go on in later ranges is a prefix of those ranges' lower bounds, so each range starts with the
stack of the entries that its bound begins with; there are no more of these than bounds times nested entries. Nothing is exploded, and a short entry's extensions spread
over as many ranges as they fill; where one string fills several ranges its rows are dealt among them.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings sampled for each range, and ranges for each shuffle partition.
SAMPLED, RANGES = 40, 2


def _bounds(rows: DataFrame, ranges: int) -> list[str]:
    """Lower bounds of all ranges but the first: quantiles of a sample of fixed size; a frequent string can be several of them."""
    numbered = rows.select("norm", F.monotonically_increasing_id().alias("_at"))
    found = sorted(r.norm for r in numbered.orderBy(F.xxhash64("_at")).limit(SAMPLED * ranges).select("norm").collect())
    return [found[i * len(found) // ranges] for i in range(1, ranges)] if found else []


def _scan(rows: DataFrame, entries: DataFrame, walk, schema: str) -> DataFrame:
    """What ``walk`` makes of the sorted Arrow batches of ``rows`` (norm, kind, ...): it is given the stack that each range begins with. entries: (norm, title)."""
    import pandas as pd

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows, RANGES * parts)
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def range_of(norm, tie):
        out, bounds = [], shared.value
        for s, t in zip(norm, tie, strict=True):
            low = bisect.bisect_left(bounds, s)
            same = bisect.bisect_right(bounds, s, low) - low
            out.append(low + 1 + t % same if same else low)
        return pd.Series(out, dtype="int32")

    @F.pandas_udf("boolean")
    def is_open(norm):
        bounds = shared.value
        return pd.Series([at < len(bounds) and bounds[at].startswith(s) for s, at in ((s, bisect.bisect_left(bounds, s)) for s in norm)])

    stacks: dict[int, list[tuple[str, str]]] = {}
    if bounds:
        for r in sorted(entries.where(is_open("norm")).select("norm", "title").collect(), key=lambda r: len(r.norm)):
            at = bisect.bisect_left(bounds, r.norm)
            while at < len(bounds) and bounds[at].startswith(r.norm):
                stacks.setdefault(at + 1, []).append((r.norm, r.title))
                at += 1
    opened = spark.sparkContext.broadcast(stacks)
    dealt = rows.withColumn("_range", range_of("norm", F.monotonically_increasing_id())).repartition(parts, "_range").sortWithinPartitions("_range", "norm", "kind")
    return dealt.mapInArrow(lambda batches: walk(batches, opened.value), schema)


class _Stack:
    """Entries that the current string begins with, shortest first."""

    def __init__(self, opened: dict[int, list[tuple[str, str]]]):
        self.opened, self.range, self.held = opened, None, []

    def at(self, number: int, norm: str) -> list[tuple[str, str]]:
        if number != self.range:
            self.range, self.held = number, list(self.opened.get(number, ()))
        held = self.held
        while held and not norm.startswith(held[-1][0]):
            held.pop()
        return held

    def push(self, norm: str, title: str) -> None:
        if not (self.held and self.held[-1][0] == norm):
            self.held.append((norm, title))


def longest_prefix(df: DataFrame, id_col: str, norm: str, dictionary: DataFrame, extra: int = 3, least: int = 1) -> DataFrame:
    """(id, title) of the longest dictionary entry (norm, title), of ``least`` characters or more, that ``norm`` begins with and exceeds by ``extra``; equal ones by least title.

    Rows without such an entry, and null ones, are left out; rows are kept apart whatever their ids.
    """
    import pyarrow as pa

    kind = df.schema[id_col].dataType
    entries = dictionary.where(F.length("norm") >= max(least, 1)).groupBy("norm").agg(F.min("title").alias("title"))
    titles = df.where(F.col(norm).isNotNull()).select(F.col(norm).alias("norm"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("title"), F.col(id_col).alias("_id"))
    rows = entries.select("norm", F.lit(0).alias("kind"), "title", F.lit(None).cast(kind).alias("_id")).unionByName(titles)

    def walk(batches: Iterator[pa.RecordBatch], opened: dict) -> Iterator[pa.RecordBatch]:
        stack = _Stack(opened)
        for batch in batches:
            at, found = [], []
            for i, (s, k, title, r) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("norm", "kind", "title", "_range")), strict=True)):
                held = stack.at(r, s)
                if k == 0:
                    stack.push(s, title)
                else:
                    best = next((t for e, t in reversed(held) if len(e) + extra <= len(s)), None)
                    if best is not None:
                        at.append(i)
                        found.append(best)
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(at, pa.int64())), pa.array(found, pa.string())], [id_col, "title"])

    return _scan(rows, entries, walk, f"`{id_col}` {kind.simpleString()}, title string")


def prefix_family(titles: DataFrame, norm: str, least: int = 4) -> DataFrame:
    """Distinct normal titles, of ``least`` characters or more, that are a strict prefix of another one."""
    import pyarrow as pa

    known = titles.where(F.length(norm) >= max(least, 1)).select(F.col(norm).alias("norm")).distinct()

    def walk(batches: Iterator[pa.RecordBatch], opened: dict) -> Iterator[pa.RecordBatch]:
        stack = _Stack(opened)
        for batch in batches:
            found = []
            for s, r in zip(batch.column("norm").to_pylist(), batch.column("_range").to_pylist(), strict=True):
                held = stack.at(r, s)
                base = held[-2:-1] if held and held[-1][0] == s else held[-1:]  # those below were found with the one above
                found += [e for e, _ in base]
                stack.push(s, s)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], [norm])

    return _scan(known.withColumn("kind", F.lit(0)), known.withColumn("title", F.col("norm")), walk, f"`{norm}` string").distinct()
