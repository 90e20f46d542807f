"""Views over the catalog's tables, and the filters, differences and counts that callers compose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.operators import catalog


def linked(left: DataFrame, right: DataFrame, on: dict[str, str], where: Column | str | None = None, how: str = "inner") -> DataFrame:
    """``left`` joined with the rows of ``right`` that ``where`` keeps; it is applied before the join, so that an outer join keeps rows of ``left``."""
    chosen = right if where is None else right.where(where)
    return left.join(chosen, reduce(lambda a, b: a & b, [F.col(k) == F.col(v) for k, v in on.items()]), how)


def metadata_with_paths(metadata: DataFrame, paths: DataFrame, key: tuple[str, str] = ("path_id", "path_id"), without_source: str | None = catalog.GUIDE_SOURCE, source: str = "source", outer: bool = False) -> DataFrame:
    """Metadata beside its path, without rows of one source; ``outer`` keeps metadata whose path is gone."""
    rows = metadata if without_source is None else metadata.where(F.col(source) != without_source)
    how = "left" if outer else "inner"
    return rows.join(paths, key[0], how) if key[0] == key[1] else linked(rows, paths, {key[0]: key[1]}, None, how)


def programs_with_broadcasts(programs: DataFrame, broadcasts: DataFrame, key: tuple[str, str] = ("broadcast_id", "broadcast_id"), known: str = "is_rebroadcast_flag") -> DataFrame:
    """Links beside those of their broadcasts that have a value in ``known``."""
    chosen = broadcasts.where(F.col(known).isNotNull())
    return programs.join(chosen, key[0]) if key[0] == key[1] else linked(programs, chosen, {key[0]: key[1]})


def needs_review(metadata: DataFrame, paths: DataFrame, key: str = "path_id", flag: str = "needs_review") -> DataFrame:
    """The view of what people should look at: rows whose flag is 1, beside their path."""
    return metadata.where(F.col(flag) == 1).join(paths, key)


def among(df: DataFrame, ids: DataFrame, column: str, id_column: str | None = None) -> DataFrame:
    """Rows whose ``column`` is one of the ids; no row multiplies."""
    return df.join(ids.select(F.col(id_column or column).alias("_id")), F.col(column) == F.col("_id"), "left_semi")


def conflicting_links(links: DataFrame, key: list[str], value: str) -> DataFrame:
    """Pairs (value, other) that one key has, each once; what would collide if the values became one."""
    rows = links.select(*key, value).distinct()
    return rows.join(rows.withColumnRenamed(value, "other"), key).where(F.col(value) < F.col("other"))


def difference(ids: DataFrame, others: DataFrame, column: str, other_column: str | None = None) -> DataFrame:
    """Distinct ids that ``others`` lacks."""
    return ids.select(column).distinct().join(others.select(F.col(other_column or column).alias(column)), column, "left_anti")


def counted(df: DataFrame, by: list[str], condition: Column) -> DataFrame:
    """For each group how many rows meet the condition; groups without one have 0."""
    return df.groupBy(*by).agg(F.count_if(condition).alias("n"))


def matching(df: DataFrame, exact: dict[str, str] | None = None, contains: dict[str, str] | None = None, like: dict[str, str] | None = None, one_of: dict[str, list] | None = None) -> DataFrame:
    """Rows that meet all given conditions: equal, holding a text whatever its case, LIKE with ``~`` as escape, one of a list. Empty texts and lists ask for nothing."""
    for c, v in (exact or {}).items():
        df = df.where(F.col(c) == v) if v != "" else df
    for c, v in (contains or {}).items():
        df = df.where(F.contains(F.lower(c), F.lit(v.lower()))) if v else df
    for c, v in (like or {}).items():
        df = df.where(F.like(F.col(c), F.lit(v), F.lit("~"))) if v else df
    for c, v in (one_of or {}).items():
        df = df.where(F.col(c).isin(v)) if v else df
    return df


def first_rows(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first rows in order, as a scan that stops early sees them, before anything is joined; all without ``n``."""
    return df if n is None else df.orderBy(*order).limit(n)
