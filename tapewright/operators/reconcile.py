"""Listings against the catalog, applied moves against the catalog, and names that differ in case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.operators import views


def reconcile(listing: DataFrame, catalog: DataFrame, observed: DataFrame, remapped: Column | None = None, scan_limit: int | None = None) -> DataFrame:
    """``status`` of each listed file (path, name, size, corrupt).

    existing: the path is catalogued and observed; missing_observation: catalogued only; remapped: its path under another root is
    catalogued; renamed: one catalogued file has its name and size; ambiguous: several have; corrupt: flagged by the scan; else new.
    catalog: path_id, path, name; observed: path_id, size. ``scan_limit``: only the first files by path are looked at.
    """
    listing = views.first_rows(listing, ["path"], scan_limit)
    paths = catalog.select("path", F.col("path_id").alias("same_id"))
    old = catalog.select(F.col("path").alias("_remap"), F.col("path_id").alias("remap_id"))
    by_name = catalog.select("path_id", "name").join(observed, "path_id").groupBy("name", "size").agg(F.countDistinct("path_id").alias("n_named"), F.min("path_id").alias("named_id"))
    seen = observed.select(F.col("path_id").alias("same_id")).distinct().withColumn("_seen", F.lit(True))
    out = listing.join(paths, "path", "left").join(seen, "same_id", "left")
    out = out.withColumn("_remap", remapped if remapped is not None else F.lit(None).cast("string")).join(old, "_remap", "left").join(by_name, ["name", "size"], "left")
    status = (
        F.when(F.col("corrupt"), "corrupt").when(F.col("same_id").isNotNull(), F.when(F.col("_seen"), "existing").otherwise("missing_observation"))
        .when(F.col("remap_id").isNotNull(), "remapped").when(F.col("n_named") == 1, "renamed").when(F.col("n_named") > 1, "ambiguous").otherwise("new")
    )
    return out.withColumn("status", status).withColumn("known_id", F.coalesce("same_id", "remap_id", F.when(F.col("n_named") == 1, F.col("named_id")))).drop("_seen", "_remap", "same_id", "remap_id", "n_named", "named_id")


def drive_map(pairs: dict[str, str]) -> dict[str, str]:
    """Drive letters with colon, upper case, from keys such as ``d``, ``D:`` or ``D:\\``."""
    clean = lambda x: x.strip().rstrip("\\/").rstrip(":").upper() + ":"
    return {clean(k): clean(v) for k, v in pairs.items() if k.strip() and v.strip()}


def drive(text: Column) -> Column:
    """A drive letter with colon, upper case, of a key such as ``d``, ``D:`` or ``D:\\``."""
    return F.concat(F.upper(F.regexp_replace(F.regexp_replace(F.trim(text), r"[\\/]+$", ""), ":+$", "")), F.lit(":"))


def remap_drives(df: DataFrame, path: str, pairs: DataFrame) -> DataFrame:
    """``old_path``: the path under its old drive by a table (new, old) of drives, null if its drive isn't there; of several pairs of a drive the least counts."""
    known = pairs.where((F.trim("new") != "") & (F.trim("old") != "")).select(drive(F.col("new")).alias("_d"), drive(F.col("old")).alias("_o")).groupBy("_d").agg(F.min("_o").alias("_o"))
    out = df.withColumn("_d", F.upper(F.substring(path, 1, 2))).join(known, "_d", "left")
    return out.withColumn("old_path", F.concat("_o", F.substring(path, 3, 1 << 30))).drop("_d", "_o")


def remap_drive(path: Column, pairs: dict[str, str]) -> Column:
    """The path under its old drive, null if its drive isn't in the map (new to old)."""
    table = F.create_map(*[F.lit(x) for kv in drive_map(pairs).items() for x in kv]) if pairs else F.lit(None).cast("map<string,string>")
    return F.concat(F.get(F.array(table[F.upper(F.substring(path, 1, 2))]), F.lit(0)), F.substring(path, 3, 1 << 30))


def unique_matches(old: DataFrame, new: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """New rows with how many old ones share their key, and its id if there is one: the sign of a rename."""
    known = old.groupBy(*key).agg(F.countDistinct(id_col).alias("n_old"), F.min(id_col).alias("old_id"))
    return new.join(known, key).withColumn("status", F.when(F.col("n_old") == 1, "rename").otherwise("ambiguous"))


def classify_moves(moves: DataFrame, catalog: DataFrame) -> DataFrame:
    """What each applied move (path_id, src, dst) means for the catalog (path_id, path).

    already_applied: its row is at dst; at_destination: it has none, dst has; missing_src: neither; merged_into_existing: both, dst under another id; updated.
    """
    by_id = catalog.select("path_id", F.col("path").alias("now"))
    by_dst = catalog.select(F.col("path").alias("dst"), F.col("path_id").alias("dst_id"))
    out = moves.join(by_id, "path_id", "left").join(by_dst, "dst", "left")
    kind = (
        F.when(F.col("now") == F.col("dst"), "already_applied").when(F.col("now").isNull() & F.col("dst_id").isNotNull(), "at_destination").when(F.col("now").isNull(), "missing_src")
        .when(F.col("dst_id").isNotNull(), "merged_into_existing").otherwise("updated")
    )
    return out.withColumn("outcome", kind)


def collisions(moves: DataFrame, catalog: DataFrame) -> DataFrame:
    """Preview in one row: moves, those into catalogued paths, and those without a source."""
    o = classify_moves(moves, catalog)
    return o.agg(F.count(F.lit(1)).alias("n_moves"), F.count_if(F.col("outcome") == "merged_into_existing").alias("n_collisions"), F.count_if(F.col("outcome") == "missing_src").alias("n_missing"))


def repoint(df: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    """Path ids replaced by those they were merged into (old, new)."""
    for c in columns:
        df = df.join(mapping.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return df


def rewrite_prefix(path: Column, old: str, new: str) -> Column:
    """Paths at or below ``old``, whatever their case, with ``new`` in its place."""
    under = (F.lower(path) == old.lower()) | F.startswith(F.lower(path), F.lit(old.lower() + "\\"))
    return F.when(under, F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def under_roots(path: Column, roots: list[str]) -> Column:
    roots = [r.rstrip("\\").lower() for r in roots]
    return F.exists(F.array(*[F.lit(r) for r in roots]), lambda r: (F.lower(path) == r) | F.startswith(F.lower(path), F.concat(r, F.lit("\\"))))


def case_renames(df: DataFrame, path: str, wanted: str) -> DataFrame:
    """(src, dst): folder renames, parents first, for paths that differ from the wanted ones in case alone. Files' own names don't count."""
    a, b = F.split(path, r"\\"), F.split(wanted, r"\\")
    rows = df.where((F.lower(path) == F.lower(wanted)) & (F.col(path) != F.col(wanted))).select(a.alias("a"), b.alias("b"), F.posexplode(F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(1), F.size(a) - 1)).alias("i", "z"))
    join = lambda x, n: F.array_join(F.slice(x, F.lit(1), n), "\\")
    # Parents are renamed already when a folder's turn comes.
    pairs = rows.where("z.x <> z.y").select(F.concat_ws("\\", F.nullif(join(F.col("b"), F.col("i")), F.lit("")), F.col("z.x")).alias("src"), join(F.col("b"), F.col("i") + 1).alias("dst"))
    return pairs.distinct().withColumn("depth", F.size(F.split("src", r"\\"))).orderBy("depth", F.lower("src"), "src")


def bad_names(df: DataFrame, name: str) -> DataFrame:
    """Rows whose name holds a path or drive: the path is to be split anew."""
    return df.where(F.col(name).rlike(r"[\\:]"))


def first_per_path(df: DataFrame, path: str, order: str) -> DataFrame:
    w = W.partitionBy(F.lower(path)).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
