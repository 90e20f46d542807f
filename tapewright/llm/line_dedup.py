"""Line deduplication by overlapping three-line windows, in DataFrame operations only.

Every run of three consecutive lines is hashed. Of a window that occurs more than once in the corpus, the first
occurrence by (doc_id, line) stays; the lines that any later occurrence covers are removed, overlapping occurrences merged. A later
occurrence in the text of its own first one leaves the lines that such first occurrences cover, so ``r r r r`` keeps ``r r r``.

Defined cases: a null text counts as empty and comes back as empty; documents under three lines have no window and stay as
they are; windows of blank lines alone are no passages; lines are compared without surrounding spaces; repeated rows are one
document, so neither is later than the other; rows without an id stand before others, and rows of one id by a hash of their texts. Long texts are one array of
lines each. An empty table gives an empty one. Other columns pass through, but for those named like an output or with a leading ``_``, which are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import id_key, join_hot, materialize, without

#: Lines in a window.
WINDOW = 3


def line_windows(docs: DataFrame) -> DataFrame:
    """(_k, _x, pos, h1, h2): a row for each window that isn't blank; 128 bits of hash. A document is its id and a hash of its text."""
    hashed = docs.select(id_key("doc_id", "text").alias("_k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_x"), F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.xxhash64(F.trim(x))).alias("_h"))
    hashed = hashed.where(F.size("_h") >= WINDOW)

    def window(i):
        a, b, c = (F.get("_h", i + j) for j in range(WINDOW))
        return F.struct(i.alias("pos"), F.xxhash64(a, b, c).alias("h1"), F.xxhash64(F.lit(1), c, a, b).alias("h2"), ((a == b) & (b == c) & (a == F.xxhash64(F.lit("")))).alias("blank"))

    each = hashed.select("_k", "_x", F.explode(F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), window)).alias("w"))
    return each.where(~F.col("w.blank")).select("_k", "_x", "w.pos", "w.h1", "w.h2")


def later_positions(docs: DataFrame) -> DataFrame:
    """(_k, _x, _covered): for each document with later occurrences, the line numbers that they cover."""
    windows = materialize(line_windows(docs), "line-windows")
    first = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_k", "_x", "pos")).alias("first")).where("n > 1")
    later = join_hot(windows, materialize(first, "repeated-windows"), ["h1", "h2"], "n").where(F.struct("_k", "_x", "pos") != F.col("first"))
    own = F.struct("_k", "_x") == F.struct("first._k", "first._x")
    of = later.groupBy("_k", "_x").agg(F.collect_set(F.when(~own, F.col("pos"))).alias("other"), F.collect_set(F.when(own, F.col("pos"))).alias("own"), F.collect_set(F.when(own, F.col("first.pos"))).alias("held"))
    covers = lambda c: F.flatten(F.transform(c, lambda p: F.sequence(p, p + (WINDOW - 1))))
    return of.select("_k", "_x", F.array_union(covers("other"), F.array_except(covers("own"), covers("held"))).alias("_covered"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``, and ``n_lines``, ``removed_lines`` (line numbers from 0, ascending)."""
    docs = without(docs, "n_lines", "removed_lines")
    out = docs.withColumns({"_k": id_key("doc_id", "text"), "text": F.coalesce("text", F.lit("")), "_x": F.xxhash64(F.coalesce("text", F.lit("")))}).join(later_positions(docs), ["_k", "_x"], "left")
    out = out.withColumn("_lines", F.split("text", "\n"))
    out = out.withColumn("n_lines", F.size("_lines")).withColumn("_keep", F.when(F.col("_covered").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_covered")))
    out = out.withColumn("text", F.when(F.col("_keep").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_keep", lambda i: F.get("_lines", i)), "\n")))
    return out.withColumn("removed_lines", F.coalesce(F.array_sort("_covered"), F.array().cast("array<int>"))).drop("_k", "_x", "_covered", "_lines", "_keep")
