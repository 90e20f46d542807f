"""Review artefacts: title statistics, reasons and their histograms, differences between an edited and a baseline list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions import dates as D
from tapewright.functions import keys as K
from tapewright.functions import text as X
from tapewright.functions import values as V


def title_stats(df: DataFrame, title: str, review: Column, id_col: str, path: str, order: str, samples: int = 3) -> DataFrame:
    """Rows and rows under review of each title, hash of its ids, and its first paths in order."""
    firsts = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(order, path))), 1, samples), lambda x: x[path])
    return df.groupBy(title).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(review).alias("n_review"), K.set_hash(F.col(id_col)).alias("cohort"), firsts.alias("samples"))


def diagnostics(df: DataFrame) -> DataFrame:
    """Rows (program_title, air_date, needs_review, needs_review_reason) with something to look at: ``reasons``, ``fields``, ``severity``."""
    title, date = F.col("program_title"), F.col("air_date")
    rules = [
        (X.strip(X.empty(title)) == "", "missing_program_title", "program_title"), (F.coalesce(title == "UNKNOWN", F.lit(False)), "unknown_program_title", "program_title"),
        (X.has_separator(title), "subtitle_separator_in_program_title", "program_title"), (X.empty(date) == "", "missing_air_date", "air_date"),
        ((X.empty(date) != "") & ~D.is_iso_date(date), "invalid_air_date", "air_date"), (F.coalesce(F.col("needs_review"), F.lit(False)), "needs_review_flagged", "needs_review"),
    ]
    out = df.withColumn("reasons", V.reasons(*[(c, r) for c, r, _ in rules])).withColumn("fields", F.array_sort(F.array_distinct(V.reasons(*[(c, f) for c, _, f in rules]))))
    return out.where(F.size("reasons") > 0).withColumn("severity", F.when(F.arrays_overlap("reasons", F.array(F.lit("missing_program_title"), F.lit("missing_air_date"), F.lit("invalid_air_date"))), "required").otherwise("review"))


def histogram(df: DataFrame, array: str, name: str) -> DataFrame:
    return df.select(F.explode(array).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(summaries: DataFrame, counts: str) -> DataFrame:
    """Sum of count maps over all summaries."""
    return summaries.select(F.explode(counts).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("n"))


def risk(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("needs_review")).alias("n_review"), F.count_if(X.strip(X.empty(F.col("program_title"))) == "").alias("n_untitled"))


def positional_diff(edited: DataFrame, baseline: DataFrame, row: str, content: Column) -> DataFrame:
    """Row numbers at which two lists differ: changed, added, or removed. A row that is there with null content is there."""
    a, b = (t.select(row, content.alias("c"), F.lit(True).alias("is")).alias(n) for t, n in ((edited, "a"), (baseline, "b")))
    both = a.join(b, row, "full_outer").select(row, F.col("a.c").alias("new"), F.col("b.c").alias("old"), F.col("a.is").alias("_a"), F.col("b.is").alias("_b"))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("new").eqNullSafe(F.col("old")), "changed")
    return both.withColumn("change", kind).where("change is not null").drop("_a", "_b")


def batch_status(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """complete, incomplete or pending for each input batch (name, n_rows) by its output's rows."""
    out = inputs.withColumn("output", X.batch_output_name(F.col("name"))).join(outputs.select(F.col("name").alias("output"), F.col("n_rows").alias("n_done")), "output", "left")
    return out.withColumn("status", F.when(F.col("n_done").isNull(), "pending").when(F.col("n_done") >= F.col("n_rows"), "complete").otherwise("incomplete"))


def apply_aliases(df: DataFrame, title: str, norm: str, aliases: DataFrame, extra: int = 8) -> DataFrame:
    """Titles by exact alias (norm, canonical), else by the longest alias they exceed by ``extra`` characters."""
    from tapewright.operators.resolve import longest_prefix

    exact = df.join(aliases.groupBy(F.col("norm").alias(norm)).agg(F.min("canonical").alias("_a")), norm, "left")
    longest = longest_prefix(df.select(norm).distinct().withColumn("_id", F.col(norm)), "_id", norm, aliases.select("norm", F.col("canonical").alias("title")), extra).select(F.col("_id").alias(norm), F.col("title").alias("_b"))
    return exact.join(longest, norm, "left").withColumn("new_title", F.coalesce("_a", "_b", title)).drop("_a", "_b")


def gate(raw: bool, changed: int, risky: int, allow: bool) -> str | None:
    """Why a reviewed list can't be applied, None if it can."""
    if raw:
        return "raw_extraction_file"
    if not changed:
        return "no_changes"
    return "rows_still_need_review" if risky and not allow else None


def refusal(raw: Column, changed: Column, risky: Column, allow: Column) -> Column:
    """``gate`` of each row."""
    return F.when(raw, "raw_extraction_file").when(changed == 0, "no_changes").when((risky > 0) & ~allow, "rows_still_need_review")


def newest(df: DataFrame, group: str, when: str, name: str, n: int) -> DataFrame:
    """The newest ``n`` of each group, ties by name, with ``action``: keep those, rotate others."""
    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc(when), name))
    return df.withColumn("place", place).withColumn("action", F.when(F.col("place") <= n, "keep").otherwise("rotate"))
