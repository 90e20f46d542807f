"""Titles: prefix families, longest-prefix and contained matches, aliases, and what follows from them.

Prefix matches scan sorted ranges (``prefixes``), contained ones run automata (``matching``): neither compares all titles with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions import text as X
from tapewright.operators.matching import first_contained, longest_contained  # noqa: F401
from tapewright.operators.prefixes import longest_prefix, prefix_family  # noqa: F401


def resolve(df: DataFrame, id_col: str, norm: str, sources: list[tuple[str, DataFrame]], extra: int = 3) -> DataFrame:
    """(title, match_source) by the first source that has a match. The first source matches exactly, the others by longest prefix."""
    out = df
    name, exact = sources[0]
    out = out.join(exact.groupBy(F.col("norm").alias(norm)).agg(F.min("title").alias("_t0")), norm, "left")
    found = [(name, F.col("_t0"))]
    for i, (name, dictionary) in enumerate(sources[1:], 1):
        out = out.join(longest_prefix(df, id_col, norm, dictionary, extra).withColumnRenamed("title", f"_t{i}"), id_col, "left")
        found.append((name, F.col(f"_t{i}")))
    which = F.coalesce(*[F.when(t.isNotNull(), F.lit(n)) for n, t in found])
    return out.withColumns({"suggested": F.coalesce(*[t for _, t in found]), "match_source": which}).drop(*[f"_t{i}" for i in range(len(sources))])


def with_separator(df: DataFrame, title: str) -> DataFrame:
    """What stands before a separator becomes the suggestion if nothing else did."""
    cut = X.before_separator(F.col(title))
    usable = F.col("suggested").isNull() & X.has_separator(F.col(title)) & (cut != "")
    return df.withColumns({"match_source": F.when(usable, "separator_split").otherwise(F.col("match_source")), "suggested": F.when(usable, cut).otherwise(F.col("suggested"))})


def first_alias(norm: Column, aliases: list[tuple[str, str]]) -> Column:
    """Title of the first alias (alias, title) that ``norm`` holds, in the list's order."""
    return F.coalesce(*[F.when(F.contains(norm, F.lit(a)), F.lit(t)) for a, t in aliases], F.lit(None).cast("string"))


#: An episode number at a title's end; marks that end a series' name; marks that a whole title doesn't end in.
EPISODE_SUFFIX = r"(?U)\s+(?:第\d+話|#\d+).*$"
SERIES_END = "[▽▼◇「#＃]"
UNFINISHED = "[【「『▽▼◇#＃、。]$"


def series_name(df: DataFrame, title: str, aliases: DataFrame) -> DataFrame:
    """``series``: by alias (alias in the form of programme keys, canonical) of the title, of the title without its episode, of what stands before a mark; else that, or the title.

    Titles are in NFKC; empty ones are UNKNOWN.
    """
    full, bare, head = (F.col(f"_t{i}") for i in range(3))  # columns of their own, so that each is evaluated once
    out = df.withColumn("_t0", X.strip(X.empty(F.col(title))))
    out = out.withColumns({"_t1": X.strip(F.regexp_replace(full, EPISODE_SUFFIX, "")), "_t2": X.strip(F.split(full, SERIES_END, 2)[0])})
    for i, form in enumerate((full, bare, head)):
        one = aliases.groupBy(F.col("alias").alias(f"_k{i}")).agg(F.min("canonical").alias(f"_a{i}"))
        out = out.withColumn(f"_k{i}", X.program_key(form)).join(one, f"_k{i}", "left")
    series = F.when(full == "", "UNKNOWN").otherwise(F.coalesce("_a0", F.when(bare != "", F.col("_a1")), F.when(head != "", F.coalesce("_a2", head)), full))
    return out.withColumn("series", series).drop(*[f"_{x}{i}" for x in "kat" for i in range(3)])


def long_title_fix(df: DataFrame, title: str, aliases: DataFrame, known: DataFrame, longest: int = 25, extra: int = 3) -> DataFrame:
    """``fixed`` for titles over ``longest`` characters: a shorter series name, else the longest known title they begin with and exceed by ``extra``; else null."""
    out = series_name(df.withColumn("_id", F.col(title)), title, aliases)
    best = longest_prefix(df.where(F.length(title) > longest).select(F.col(title).alias("_id"), F.col(title).alias("_norm")).distinct(), "_id", "_norm", known.select(F.col("title").alias("norm"), "title"), extra)
    shorter = (F.col("series") != F.col(title)) & (F.length("series") < F.length(title))
    return out.join(best.withColumnRenamed("title", "_known"), "_id", "left").withColumn("fixed", F.when(F.length(title) > longest, F.when(shorter, F.col("series")).otherwise(F.col("_known")))).drop("_id", "_known", "series")


def known_titles(df: DataFrame, title: str, most_length: int = 25, least: int = 2) -> DataFrame:
    """Short titles that occur ``least`` times or more and don't end in a mark."""
    return df.where((F.length(title) <= most_length) & (X.empty(F.col(title)) != "") & ~F.col(title).rlike(UNFINISHED)).groupBy(title).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def top_titles(df: DataFrame, title: str, n: int = 30) -> DataFrame:
    return df.groupBy(title).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), title).limit(n)


def title_samples(df: DataFrame, title: str, id_col: str, path: str, samples: int = 3) -> DataFrame:
    """Ids of each title, and its first distinct paths."""
    return df.groupBy(title).agg(F.sort_array(F.collect_list(id_col)).alias("ids"), F.slice(F.sort_array(F.collect_set(path)), 1, samples).alias("sample_paths"))


def regroup(df: DataFrame, old: str, new_key: str) -> DataFrame:
    """Old programmes of each new key, and whether they merge."""
    return df.groupBy(new_key).agg(F.sort_array(F.collect_set(old)).alias("old_ids"), F.countDistinct(old).alias("n_old")).withColumn("merges", F.col("n_old") > 1)


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Aliases that lead to more than one title."""
    return aliases.groupBy("alias").agg(F.countDistinct("canonical").alias("n")).where("n > 1")


def contamination(df: DataFrame, corroborated: Column, family: Column) -> DataFrame:
    """Rows whose title should become the suggestion: not those a human gave exactly, unless in a prefix family; ``confidence`` by how it was found."""
    differs = F.col("suggested").isNotNull() & (F.col("suggested") != F.col("title"))
    human = F.col("match_source") == "human_exact"
    out = df.where(differs & (~human | family))
    label = F.when(F.col("match_source").isin("human", "human_exact"), "high").when(corroborated, "high").when(F.col("match_source") == "programs", "medium").otherwise("low")
    return out.withColumn("confidence", label)


def affected_root(path: Column, old_title: Column) -> Column:
    """Folder to scan again: above ``title\\YYYY\\MM``, else above the old title's folder, else the drive; null for empty paths."""
    p = F.translate(F.coalesce(path, F.lit("")), "/", "\\")
    dated = F.regexp_extract(p, r"^(.+?)\\[^\\]+\\\d{4}\\\d{2}\\[^\\]+$", 1)
    parts = F.split(p, r"\\")
    at = F.array_position(parts, old_title).cast("int")
    titled = F.when((at > 1) & (at < F.size(parts)), F.array_join(F.slice(parts, F.lit(1), at - 1), "\\"))
    drive = F.concat(F.regexp_extract(p, r"^([A-Za-z]:)", 1), F.lit("\\"))
    return F.when(p == "", None).when(dated != "", dated).when(titled.isNotNull(), titled).when(p.rlike("^[A-Za-z]:"), drive)


def one_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
