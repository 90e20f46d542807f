"""Duplicate decisions: keep-best ranking, exact groups before metadata groups, bucket policy, eligibility, reviews of drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.operators.groups import with_groups

KEEP, DROP, REVIEW = "keep", "drop", "manual_review_required"


def keep_order(not_corrupt: str, resolution: str, size: str, mtime: str, path: str) -> list[Column]:
    return [F.desc(not_corrupt), F.desc(resolution), F.desc(size), F.desc(mtime), F.asc(path)]


def keep_best(df: DataFrame, key: list[str], order: list[Column], most_groups: int | None = None) -> DataFrame:
    """keep or drop for the rows of groups of two and more; rows with a null in the key are in no group. With ``most_groups`` (a person's number) the first groups by key alone."""
    out = with_groups(df, key, order).where("group_size > 1")
    if most_groups is not None:
        out = out.join(df.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").orderBy(*key).limit(most_groups).drop("_n"), key)
    return out.withColumn("decision", F.when(F.col("_best"), KEEP).otherwise(DROP)).drop("_best")


def two_phase(df: DataFrame, hash_col: str, key_col: str, order: list[Column], columns: list[str]) -> DataFrame:
    """Exact groups first, whose members (the kept one too) take no part in the groups by key; then the rest by key.

    ``method`` is hash_exact or metadata; only hash_exact drops may be applied without review (``auto_apply``).
    Rows without a hash, which may be most, and rows without a key are in no group.
    """
    hashed = with_groups(df, [hash_col], order)
    exact = hashed.where("group_size > 1").withColumn("method", F.lit("hash_exact"))
    rest = hashed.where("group_size = 1").select(*df.columns).unionByName(df.where(F.col(hash_col).isNull()))
    rest = with_groups(rest, [key_col], order).where("group_size > 1").withColumn("method", F.lit("metadata"))
    out = exact.unionByName(rest).withColumn("decision", F.when(F.col("_best"), KEEP).otherwise(DROP))
    return out.select(*columns, "decision", "method", ((F.col("decision") == DROP) & (F.col("method") == "hash_exact")).alias("auto_apply"))


def bucket_of(explicit: Column, sources: list[Column], rules: dict[str, list[str]]) -> Column:
    """Bucket by an explicit field, then by the first keyword found in the sources, with or without spaces; else unknown."""
    merged = F.lower(F.concat_ws(" ", *[F.nullif(F.coalesce(s, F.lit("")), F.lit("")) for s in sources]))
    tight = F.regexp_replace(merged, r"(?U)\s+", "")
    given = F.lower(F.trim(F.coalesce(explicit, F.lit(""))))
    out = F.when(given.isin(*rules), given)
    for bucket, words in rules.items():
        for word in (w.lower() for w in words if w.strip()):
            out = out.when(F.contains(merged, F.lit(word)) | F.contains(tight, F.lit("".join(word.split()))), bucket)
    return out.otherwise("unknown")


def bucket_policy(df: DataFrame, key: str, bucket: str, order: list[Column]) -> DataFrame:
    """Groups by key split by bucket. A group that mixes unknown with known buckets goes to review; single rows of a bucket stay. Rows without a key are in no group."""
    unknown = (F.col(bucket) == "unknown").cast("int")
    out = with_groups(df, [key], order, [bucket], {"_unknown": unknown, "_known": 1 - unknown}).where("group_size > 1")
    mixed = (F.col("_unknown") > 0) & (F.col("_known") > 0)
    return out.withColumn("decision", F.when(mixed, REVIEW).when(F.col("_best"), KEEP).otherwise(DROP)).drop("group_size", "_best", "_unknown", "_known")


def eligible_keep(df: DataFrame, key: list[str], eligible: Column, order: list[Column]) -> DataFrame:
    """Groups of two and more: with under two eligible rows all are for review; else the best eligible row stays, other eligible ones drop, the rest are for review. Rows with a null in the key are in no group."""
    out = with_groups(df.withColumn("_e", eligible), key, [F.desc("_e"), *order], sums={"_eligible": F.col("_e").cast("int")}).where("group_size > 1")
    ok = (F.col("_eligible") >= 2) & F.col("_e")
    return out.withColumn("decision", F.when(~F.coalesce(ok, F.lit(False)), REVIEW).when(F.col("_best"), KEEP).otherwise(DROP)).drop("_e", "_eligible", "group_size", "_best")


def hash_groups(report: DataFrame, candidates: DataFrame, path: str = "path") -> DataFrame:
    """Members of hash groups (group_id, path) that are candidates, of groups with at least two such."""
    known = report.join(candidates, path)
    return known.join(known.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("group_id"), "group_id")


def skip_groups(plan: DataFrame, review: DataFrame) -> DataFrame:
    """The plan without groups of which a reviewer skipped any row. review: group_key, decision."""
    skipped = review.groupBy("group_key").agg(F.bool_or(F.col("decision") == "skip").alias("s")).where("s").select("group_key")
    return plan.join(skipped, "group_key", "left_anti")


def review_groups(plan: DataFrame) -> DataFrame:
    """A document row for each group with drops: its candidates by path."""
    cand = F.struct("path", "path_id", "size_bytes", "decision")
    return plan.groupBy("group_key").agg(F.array_sort(F.collect_list(cand)).alias("candidates"), F.bool_or(F.col("decision") == DROP).alias("_d")).where("_d").drop("_d").orderBy("group_key")


def broadcaster_answers(answers: DataFrame, known: dict[str, list[str]]) -> DataFrame:
    """Checks a reviewer's broadcasters: those no keyword covers need a bucket, and extend the rules by it (``new_keyword``)."""
    covered = bucket_of(F.lit(None).cast("string"), [F.col("broadcaster")], known)
    bad = (covered == "unknown") & ~F.coalesce(F.col("bucket").isin(*known), F.lit(False))
    return answers.withColumns({"resolved_bucket": F.when(covered != "unknown", covered).otherwise(F.col("bucket")), "new_keyword": F.when((covered == "unknown") & ~bad, F.col("broadcaster")), "error": F.when(bad, "unknown_broadcaster_needs_bucket")})


def unique_names(df: DataFrame, dst: str, order: list[str]) -> DataFrame:
    """Later rows of one destination (whatever its case) get ``__dupN`` before the extension."""
    n = F.row_number().over(W.partitionBy(F.lower(dst)).orderBy(*order)) - 1
    suffix = F.concat(F.lit("__dup"), F.col("_n"))
    stem, ext = F.regexp_extract(dst, r"^(.*?)(\.[^.\\]*)?$", 1), F.regexp_extract(dst, r"^(.*?)(\.[^.\\]*)?$", 2)
    return df.withColumn("_n", n).withColumn(dst, F.when(F.col("_n") == 0, F.col(dst)).otherwise(F.concat(stem, suffix, ext))).drop("_n")
