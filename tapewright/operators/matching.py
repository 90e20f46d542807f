"""Entries of a dictionary inside texts, found by Aho-Corasick automata: one pass over a text, whatever the number of entries.

The entries' bytes are counted first. Those of a shard (at most ``shard_bytes``) go to every task as plain lists, of which each Python worker builds its automaton; texts stay where
they are. A dictionary of one shard needs no shuffle; with more of them a text is read once for each, and its finds meet by the row's number. Texts go to Python in batches of 512 rows.
"""

from __future__ import annotations

import uuid
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.sources.scratch import text_batches, written

_built: dict = {}


def _automaton(key: str, norms: list[str]):
    """The worker's automaton of a shard; it keeps one at a time."""
    import ahocorasick

    if key not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for i, norm in enumerate(norms):
            made.add_word(norm, i)
        made.make_automaton()
        _built[key] = made
    return _built[key]


def _first(held: DataFrame, text: str) -> Column:
    """(place, title) of the shard's first entry, by place and title, that a text holds; null for none."""
    import pandas as pd

    rows = held.orderBy("place", "title", "norm").toArrow().to_pydict()
    if not rows["norm"]:
        return F.lit(None).cast("struct<place:long,title:string>")
    shared, key = held.sparkSession.sparkContext.broadcast((rows["norm"], rows["place"], rows["title"])), uuid.uuid4().hex

    @F.pandas_udf("place long, title string")
    def find(texts):
        norms, places, titles = shared.value
        iterate, number = _automaton(key, norms).iter, itemgetter(1)
        at = [min(map(number, iterate(t)), default=-1) if t else -1 for t in texts]
        return pd.DataFrame({"place": pd.array([places[i] if i >= 0 else None for i in at], "Int64"), "title": [titles[i] if i >= 0 else None for i in at]})

    return find(F.col(text))


def first_contained(df: DataFrame, id_col: str, text: str, entries: DataFrame, shard_bytes: int = 8_000_000) -> DataFrame:
    """(id, title), for each row of ``df`` whose text holds an entry (norm, title, place), of the one of least place; equal places by least title.

    Empty and null entries and texts match nothing; of entries with one ``norm`` the first by place and title counts. Rows are kept apart whatever their ids.
    """
    usable = entries.where((F.col("norm") != "") & F.col("place").isNotNull()).select(F.col("norm").cast("string").alias("norm"), F.struct(F.col("place").cast("long").alias("place"), "title").alias("b"))
    held = written(usable.groupBy("norm").agg(F.min("b").alias("b")).select("norm", "b.place", "b.title"), "entries")
    size = held.agg(F.sum(F.octet_length("norm") + F.coalesce(F.octet_length("title"), F.lit(0)) + 16).alias("n")).first().n
    if size is None:
        return df.select(id_col, F.lit(None).cast("string").alias("title")).limit(0)
    shards = -(-size // shard_bytes)
    df = text_batches(df)
    if shards == 1:
        return df.select(id_col, _first(held, text).alias("_f")).where("_f.place is not null").select(id_col, F.col("_f.title").alias("title"))
    rows = written(df.select(F.monotonically_increasing_id().alias("_row"), id_col, F.col(text).alias("_text")), "texts")
    found = None
    for i in range(shards):
        part = rows.select("_row", id_col, _first(held.where(F.pmod(F.xxhash64("norm"), F.lit(shards)) == i), "_text").alias("_f")).where("_f.place is not null")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("_row").agg(F.any_value(id_col).alias(id_col), F.min("_f").alias("_f")).select(id_col, F.col("_f.title").alias("title"))


def longest_contained(df: DataFrame, id_col: str, norm: str, dictionary: DataFrame, least: int = 2, shard_bytes: int = 8_000_000) -> DataFrame:
    """(id, title) of the longest dictionary entry (norm, title), of ``least`` characters or more, inside ``norm``; equal ones by least title."""
    entries = dictionary.where(F.length("norm") >= least).select("norm", "title", (-F.length("norm")).alias("place"))
    return first_contained(df, id_col, norm, entries, shard_bytes)


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters."""
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def literal_of(pattern: str, escape: str = "~") -> Column:
    """The longest run of characters between the wildcards of a LIKE pattern, in lower case and without escapes."""
    runs = F.transform(F.regexp_extract_all(pattern, F.lit(f"((?:[^%_{escape}]|{escape}.)+)")), lambda r: F.lower(F.regexp_replace(r, f"{escape}(.)", "$1")))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"], F.lit(""))


def like_candidates(paths: DataFrame, path: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Rows of ``paths`` beside the ``patterns`` that their LIKE, without regard to case, may fit: both hold a trigram of the pattern's longest literal, the one that fewest paths hold.

    Every pattern must hold three literal characters together. Patterns go to every task, so their number must be bounded.
    """
    keyed = patterns.withColumn("_id", F.monotonically_increasing_id()).withColumn("_g", trigrams(literal_of(pattern)))
    keyed = written(keyed, "patterns")
    wanted = keyed.select(F.explode("_g").alias("_t")).distinct()
    held = F.explode(trigrams(F.lower(path))).alias("_t")
    counts = paths.select(held).join(F.broadcast(wanted), "_t").groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    choice = keyed.select("_id", F.explode("_g").alias("_t")).join(F.broadcast(counts), "_t", "left").groupBy("_id").agg(F.min_by("_t", F.struct(F.coalesce("_n", F.lit(0)), F.col("_t"))).alias("_t"))
    rules = written(keyed.drop("_g").join(choice, "_id"), "rules")
    return paths.select("*", held).join(F.broadcast(rules), "_t").drop("_t", "_id")
