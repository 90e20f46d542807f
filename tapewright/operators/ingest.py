"""Flows from read rows to table batches: inventory, guide, hash report, rebroadcast groups; and repairs of stored keys and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions import keys as K
from tapewright.functions import text as X
from tapewright.functions import values as V
from tapewright.operators import catalog, merge, rebroadcast, resolve
from tapewright.sources.scratch import written


def inventory_batches(listing: DataFrame, run_id: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(paths, observations) of listed files (path, size, mtime); of one path the last in time counts."""
    p = X.path_parts(F.col("path"))
    rows = merge.last_wins(listing.withColumn("path", X.windows_path(F.col("path"))).withColumn("path_id", K.path_id(F.col("path"))), ["path_id"], "mtime")
    paths = rows.select("path_id", "path", p["drive"].alias("drive"), p["dir"].alias("dir"), p["name"].alias("name"), p["ext"].alias("ext"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    seen = rows.select(F.lit(run_id).alias("run_id"), "path_id", F.col("size").alias("size_bytes"), F.col("mtime").cast("string").alias("mtime_utc"), F.lit("file").alias("type"), F.lit(None).cast("string").alias("name_flags"))
    return paths, seen


def upsert_paths(table: DataFrame, batch: DataFrame) -> DataFrame:
    """All but the creation time follows the batch."""
    return merge.upsert(table, batch, ["path_id"], {"created_at": merge.keep_old})


def guide_batches(guides: DataFrame, broadcasts: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(programs, broadcasts) to upsert from parsed sidecars (a column ``guide``), without those whose match key is stored already.

    A programme's title is that of its last broadcast in the batch.
    """
    g = guides.where("guide is not null").select("guide.*")
    g = g.withColumn("match_key", K.guide_match_key(F.col("official_title"), F.col("broadcaster"), F.col("air_date"), F.col("start_time"))).withColumn("program_key", X.program_key(F.col("official_title")))
    g = g.withColumn("broadcast_id", K.broadcast_id(F.col("match_key"), F.concat_ws("::", "air_date", "start_time", "broadcaster", "official_title"))).withColumn("program_id", K.program_id(F.col("program_key")))
    fresh = merge.last_wins(g.join(broadcasts.where("match_key is not null").select("match_key"), "match_key", "left_anti"), ["broadcast_id"], "air_date")
    programs = merge.last_wins(fresh.withColumn("_at", F.concat_ws(" ", "air_date", "start_time", "broadcast_id")), ["program_id"], "_at")
    programs = programs.select("program_id", "program_key", F.col("official_title").alias("canonical_title"), F.lit(None).cast("string").alias("franchise_id"), F.lit(now).alias("created_at"))
    casts = fresh.select("broadcast_id", "program_id", "air_date", "start_time", "end_time", "broadcaster", "match_key", F.lit(None).cast("string").alias("data_json"), F.col("is_rebroadcast_flag").cast("int").alias("is_rebroadcast_flag"), F.to_json("epg_genres").alias("epg_genres"), F.substring("description", 1, 500).alias("description"), "official_title", F.to_json("annotations").alias("annotations"))
    return programs, casts


def legacy_guides(metadata: DataFrame, aliases: DataFrame, now: str, source: str = catalog.GUIDE_SOURCE) -> tuple[DataFrame, DataFrame]:
    """(programs, broadcasts) from guide data that older versions kept as metadata rows (path_id, source, data_json).

    Rows without a JSON object or a title count for nothing. A programme is its series (by ``aliases`` in the form of programme keys); its title is that of
    its last row by path_id, and of the rows of one broadcast the last counts. JSON is read once for a row, and series and keys are made once for a title.
    """
    names = ["air_date", "start_time", "end_time", "broadcaster"]
    get = lambda k: F.get_json_object("data_json", f"$.{k}")
    title = X.strip(F.coalesce(F.nullif(get("official_title"), F.lit("")), get("program_title"), F.lit("")))
    match = F.nullif(X.strip(X.empty(get("match_key"))), F.lit(""))
    read = metadata.where((F.col("source") == source) & V.json_fields(F.col("data_json")).isNotNull())
    rows = written(read.select("path_id", "data_json", title.alias("_title"), match.alias("match_key"), *[get(n).alias(n) for n in names]), "guide-rows").where("_title <> ''")
    titles = resolve.series_name(X.normalized_map(rows.select("_title").distinct(), "_title", X.nfkc, "_norm"), "_norm", aliases)
    titles = titles.select("_title", X.program_key(F.col("series")).alias("program_key")).withColumn("program_id", K.program_id(F.col("program_key")))
    rows = rows.join(titles, "_title")
    seed = F.concat_ws("::", "program_id", X.empty(F.col("air_date")), X.empty(F.col("start_time")), X.empty(F.col("broadcaster")))
    rows = written(rows.withColumn("broadcast_id", K.broadcast_id(F.col("match_key"), seed)), "guide-keys")
    programs = merge.last_wins(rows, ["program_id"], "path_id").select("program_id", "program_key", F.col("_title").alias("canonical_title"), F.lit(now).alias("created_at"))
    casts = merge.last_wins(rows, ["broadcast_id"], "path_id")
    casts = catalog.split_broadcast(casts).withColumn("data_json", catalog.json_set(F.col("data_json"), {}, ["is_rebroadcast_flag", "epg_genres", "description", "official_title", "annotations"]))
    return programs, casts.select("broadcast_id", "program_id", *names, "match_key", "data_json", F.lit(now).alias("created_at"), "is_rebroadcast_flag", "epg_genres", "description", "official_title", "annotations")


def hash_batches(report: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, file_paths) of a hash report's known paths."""
    rows = report.withColumn("path", X.windows_path(F.col("path"))).join(paths.select("path_id", "path"), "path").withColumn("file_id", K.file_id(F.col("path_id")))
    return rows.select("file_id", F.col("size").alias("size_bytes"), F.col("hash").alias("content_hash"), F.lit("BLAKE3").alias("hash_algo")).distinct(), rows.select("file_id", "path_id", F.lit(1).alias("is_current")).distinct()


def group_batches(rows: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(broadcast_groups, broadcast_group_members) of recordings (path_id, episode_key, program_title, air_date, broadcaster, flag)."""
    members = rebroadcast.members(rows, "episode_key", "air_date", "broadcaster", "flag")
    titles = rebroadcast.group_titles(members, "group_id", "program_title", "air_date", "path_id")
    keys = members.groupBy("group_id").agg(F.min("episode_key").alias("episode_key"))
    groups = titles.join(keys, "group_id").select("group_id", "program_title", "episode_key", F.lit(now).alias("created_at"))
    return groups, members.select("group_id", "path_id", "broadcast_type", "air_date", "broadcaster", F.lit(now).alias("added_at"))


def rematch(broadcasts: DataFrame) -> DataFrame:
    """(broadcast_id, old, new) of broadcasts whose match key would differ now."""
    new = K.guide_match_key(F.col("official_title"), F.col("broadcaster"), F.col("air_date"), F.col("start_time"))
    return broadcasts.select("broadcast_id", F.col("match_key").alias("old"), new.alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))


def repair_paths(paths: DataFrame) -> DataFrame:
    """Rows whose name holds a separator or drive, with folder, name and extension split anew from the path."""
    p = X.path_parts(F.col("path"))
    return paths.where(F.col("name").rlike(r"[\\:]")).withColumns({"drive": p["drive"], "dir": p["dir"], "name": p["name"], "ext": p["ext"]})


def update_needs_review(metadata: DataFrame, changes: DataFrame) -> DataFrame:
    """A view's update: (program_title, needs_review) sets the flag of all rows of a title, in the column and in the JSON."""
    from tapewright.operators.catalog import json_set

    new = metadata.join(changes.select("program_title", F.col("needs_review").alias("_n")), "program_title", "left")
    given: Column = F.col("_n").isNotNull()
    return new.withColumn("data_json", F.when(given, json_set(F.col("data_json"), {"needs_review": (F.col("_n") == 1).cast("string")})).otherwise(F.col("data_json"))).withColumn("needs_review", F.coalesce("_n", "needs_review")).select(*metadata.columns)


def register_functions(spark: SparkSession) -> None:
    """``normalize_program_key`` for SQL text; batches, NFKC included."""
    import re
    import unicodedata

    def key(s):
        def one(t: str | None) -> str:
            t = re.sub(r"[\s\u3000]+", "_", unicodedata.normalize("NFKC", t or "").strip().lower())
            return re.sub("_+", "_", re.sub(X.FORBIDDEN, "", t)).strip("_") or "unknown"

        return s.map(one)

    spark.udf.register("normalize_program_key", F.pandas_udf(key, T.StringType()))
