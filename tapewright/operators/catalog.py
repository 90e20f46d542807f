"""The catalog's tables: schemas, views over them, constraint checks, and columns promoted out of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions import values as V

SCHEMAS = {
    "runs": "run_id string, kind string, target_root string, started_at string, finished_at string, tool_version string, notes string",
    "files": "file_id string, size_bytes long, content_hash string, hash_algo string, duration_sec double, width long, height long, codec string, bitrate long, fps string",
    "paths": "path_id string, path string, drive string, dir string, name string, ext string, created_at string, updated_at string",
    "file_paths": "file_id string, path_id string, is_current int, first_seen_run_id string, last_seen_run_id string",
    "observations": "run_id string, path_id string, size_bytes long, mtime_utc string, type string, name_flags string",
    "events": "event_id long, run_id string, ts string, kind string, src_path_id string, dst_path_id string, detail_json string, ok int, error string",
    "tags": "tag_id long, namespace string, name string",
    "path_tags": "path_id string, tag_id long, source string, updated_at string",
    "path_metadata": "path_id string, source string, data_json string, updated_at string, program_title string, air_date string, needs_review int, episode_no string, subtitle string, broadcaster string, human_reviewed int",
    "franchises": "franchise_id string, franchise_name string, created_at string",
    "programs": "program_id string, program_key string, canonical_title string, franchise_id string, created_at string",
    "broadcasts": "broadcast_id string, program_id string, air_date string, start_time string, end_time string, broadcaster string, match_key string, data_json string, is_rebroadcast_flag int, epg_genres string, description string, official_title string, annotations string",
    "path_programs": "path_id string, program_id string, broadcast_id string, source string, updated_at string",
    "broadcast_groups": "group_id string, program_title string, episode_key string, created_at string",
    "broadcast_group_members": "group_id string, path_id string, broadcast_type string, air_date string, broadcaster string, added_at string, broadcast_id string",
    "schema_version": "version int, migrated_at string",
}
KEYS = {
    "runs": [["run_id"]], "files": [["file_id"]], "paths": [["path_id"], ["path"]], "file_paths": [["file_id", "path_id"]], "observations": [["run_id", "path_id"]],
    "tags": [["namespace", "name"]], "path_tags": [["path_id", "tag_id", "source"]], "path_metadata": [["path_id"]], "franchises": [["franchise_id"], ["franchise_name"]],
    "programs": [["program_id"], ["program_key"]], "broadcasts": [["broadcast_id"], ["match_key"]], "path_programs": [["path_id", "program_id"]],
    "broadcast_groups": [["group_id"]], "broadcast_group_members": [["group_id", "path_id"]],
}
REFERENCES = [
    ("file_paths", "file_id", "files"), ("file_paths", "path_id", "paths"), ("observations", "run_id", "runs"), ("observations", "path_id", "paths"),
    ("path_tags", "path_id", "paths"), ("path_tags", "tag_id", "tags"), ("path_metadata", "path_id", "paths"), ("broadcasts", "program_id", "programs"),
    ("path_programs", "path_id", "paths"), ("path_programs", "program_id", "programs"), ("broadcast_group_members", "group_id", "broadcast_groups"),
]
#: Fixed value: the source that marks guide data among metadata rows.
GUIDE_SOURCE = "edcb_epg"
#: Columns of path_metadata that aren't kept in its JSON.
PROMOTED = ["program_title", "air_date", "needs_review", "episode_no", "subtitle", "broadcaster", "human_reviewed"]


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table in its schema; columns that the files lack are null."""
    return spark.read.schema(SCHEMAS[table]).option("mergeSchema", "true").parquet(f"{folder}/{table}")


def evolve(df: DataFrame, table: str) -> DataFrame:
    """Adds the columns that a newer schema has, and casts those there are."""
    return df.sparkSession.createDataFrame([], SCHEMAS[table]).unionByName(df, allowMissingColumns=True)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys (without nulls) that more than one row has."""
    return df.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str | None = None) -> DataFrame:
    """Rows of ``child`` whose non-null reference has no parent."""
    keys = parent.select(F.col(parent_column or column).alias(column))
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def orphan_parents(parent: DataFrame, column: str, *children: tuple[DataFrame, str]) -> DataFrame:
    """Rows of ``parent`` that no child refers to."""
    for child, name in children:
        parent = parent.join(child.select(F.col(name).alias(column)), column, "left_anti")
    return parent


def title_summary(df: DataFrame, title: str, date: str, review: Column, human: Column) -> DataFrame:
    """For each title: rows, first and last date, rows under review, human rows under review."""
    return df.where(F.col(title).isNotNull()).groupBy(title).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.sum(review.cast("long")).alias("n_review"), F.sum(F.when(human, review.cast("long")).otherwise(0)).alias("n_human_review"),
    )


def latest(df: DataFrame, key: list[str], when: str, tiebreak: list[str] | None = None) -> DataFrame:
    """Newest row of each key; with ``tiebreak`` exactly one, without it all that tie."""
    w = W.partitionBy(*key).orderBy(F.desc_nulls_last(when), *(tiebreak or []))
    return df.withColumn("_n", (F.row_number() if tiebreak else F.rank()).over(w)).where("_n = 1").drop("_n")


def promote(df: DataFrame, keys: list[str], data: str = "data_json") -> DataFrame:
    """Splits JSON rows: ``keys`` become columns, the rest stays as JSON with sorted keys."""
    m, none = V.json_fields(F.col(data)), F.from_json(F.lit("{}"), "map<string,variant>")
    out = df.withColumns({k: F.get_json_object(data, f"$.{k}") for k in keys})
    return out.withColumn(data, V.stable_json(F.map_filter(F.coalesce(m, none), lambda k, v: ~k.isin(*keys))))


def reconstruct(df: DataFrame, keys: list[str], data: str = "data_json") -> DataFrame:
    """Columns that are not null win over the JSON's values."""
    return df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.get_json_object(data, f"$.{k}")) for k in keys})


def split_broadcast(df: DataFrame, data: str = "data_json") -> DataFrame:
    """Guide data to columns: flag as 0/1/null, genres and annotations as JSON arrays, description of at most 500 characters."""
    get = lambda k: F.get_json_object(data, f"$.{k}")
    return df.withColumns({
        "is_rebroadcast_flag": V.json_flag(F.col(data), "is_rebroadcast_flag").cast("int"), "epg_genres": get("epg_genres"), "annotations": get("annotations"),
        "description": F.substring(get("description"), 1, 500), "official_title": get("official_title"),
    })


def is_human(source: Column, reviewed: Column | None = None) -> Column:
    yes = F.coalesce(source == "human_reviewed", F.lit(False))
    return yes if reviewed is None else yes | F.coalesce(reviewed.cast("int") == 1, F.lit(False))


def is_model(source: Column) -> Column:
    return F.coalesce(source.isin("llm", "llm_subagent"), F.lit(False))


def rename_sources(df: DataFrame, old: str, new: str, source: str = "source", history: str | None = None) -> DataFrame:
    """A source label renamed in its column and inside the history array (struct with a field ``source``)."""
    out = df.withColumn(source, F.when(F.col(source) == old, new).otherwise(F.col(source)))
    if history is None:
        return out
    return out.withColumn(history, F.transform(history, lambda h: h.withField("source", F.when(h["source"] == old, new).otherwise(h["source"]))))


def review_clearable(reasons: Column, title_clean: Column, related: list[str]) -> Column:
    """All comma-separated reasons concern the title, and the title is clean now."""
    parts = V.some_text(F.transform(F.split(F.coalesce(reasons, F.lit("")), ","), lambda x: F.trim(x)))
    return V.all_in(parts, related) & title_clean


def json_set(data: Column, changes: dict[str, Column], remove: list[str] | None = None) -> Column:
    """Top-level keys set (to scalars or variants) or removed in JSON text; keys come out sorted, other values as they were."""
    names = [*changes, *(remove or [])]
    kept = F.map_filter(F.coalesce(V.json_fields(data), F.from_json(F.lit("{}"), "map<string,variant>")), lambda k, v: ~k.isin(*names))
    return V.stable_json(F.map_concat(kept, F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), v.cast("variant"))])) if changes else kept)
