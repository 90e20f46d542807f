"""Routing, plans and their counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import text as X
from tapewright.plans import moves
from tapewright.queries.base import Tables, query

ROUTES = moves.Routes("D:\\lib", "by_program_year_month", (
    moves.Route("steel", "E:\\steel\\", "by_series", ("ECON - *", "SMALL"), ("red",)),
    moves.Route("brass", "F:\\brass", "flat", (), ("ring", "bolt")),
    moves.Route("tin", "G:\\tin", "by_syllabary", (), ("blue",)),
))


def _parts(t: Tables) -> DataFrame:
    n = F.col("p_partkey")
    rows = t.part.select(
        n.alias("path_id"), F.concat(F.lit("C:\\in\\by_program\\"), F.split("p_name", " ")[0], F.lit("\\"), n.cast("string"), F.lit(".mp4")).alias("path"), F.concat(n.cast("string"), F.lit(".mp4")).alias("name"), (n % 11 != 0).alias("has_metadata"), (n % 13 != 0).alias("has_contract"), (n % 7 == 0).alias("needs_review"), F.when(n % 17 != 0, F.col("p_name")).alias("program_title"), F.when(n % 19 == 0, "").when(n % 23 == 0, "20-1").otherwise(F.concat(F.lit("2020-"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("-01"))).alias("air_date"), F.when(n % 5 == 0, "brass").alias("genre"), F.array("p_type").alias("epg_strings"),
    )
    return rows.withColumn("folder_norm", F.lower(X.folder_title(F.col("path")))).withColumn("title_norm", F.lower("program_title"))


_PLAN = r"""
p as (select p_partkey as path_id, split_part(p_name, ' ', 1) as folder, concat(cast(p_partkey as varchar), '.mp4') as name, p_partkey % 11 <> 0 as has_metadata, p_partkey % 13 <> 0 as has_contract, p_partkey % 7 = 0 as needs_review, case when p_partkey % 17 <> 0 then p_name end as title,
  case when p_partkey % 19 = 0 then '' when p_partkey % 23 = 0 then '20-1' else concat('2020-', lpad(cast(p_size as varchar), 2, '0'), '-01') end as air, case when p_partkey % 5 = 0 then 'brass' end as genre, p_type from part),
r as (select *, case when genre = 'brass' then 1 when starts_with(p_type, 'ECON') or p_type = 'SMALL' then 0 when contains(lower(coalesce(title, '')), 'red') then 0 when contains(lower(coalesce(title, '')), 'ring') or contains(lower(coalesce(title, '')), 'bolt') then 1 when contains(lower(coalesce(title, '')), 'blue') then 2 end as i from p),
q as (select *, case when not has_metadata then 'missing_metadata' when not has_contract then 'invalid_metadata_contract' when needs_review then 'needs_review' when air = '' or title is null then 'missing_required_fields'
  when lower(title) <> lower(folder) and starts_with(lower(title), lower(folder)) and length(title) >= length(folder) + 8 then 'suspicious_program_title'
  when i is null and air = '20-1' then 'invalid_air_date' end as skip_reason, case i when 0 then 'steel' when 1 then 'brass' when 2 then 'tin' else 'default' end as genre_route from r),
plan as (select path_id, skip_reason, genre_route, case when skip_reason is null then case i when 0 then concat('E:\steel\', title, '\', name) when 1 then concat('F:\brass\', name) when 2 then concat('G:\tin\MV\', name) else concat('D:\lib\', title, '\2020\', substr(air, 6, 2), '\', name) end end as dst from q)
"""


@query(f"with {_PLAN} select * from plan")
def route_plan(t: Tables) -> DataFrame:
    return moves.move_plan(_parts(t), ROUTES).select("path_id", "skip_reason", "genre_route", "dst")


@query(f"with {_PLAN} select genre_route, count(*) as n from plan where skip_reason is null group by 1")
def route_histogram(t: Tables) -> DataFrame:
    return moves.route_histogram(moves.move_plan(_parts(t), ROUTES))


@query(f"with {_PLAN}, s as (select path_id from plan where skip_reason is null order by 1 limit 100) select path_id, skip_reason from plan where path_id <= (select max(path_id) from s)")
def limited_plan(t: Tables) -> DataFrame:
    return moves.until_planned(moves.move_plan(_parts(t), ROUTES), "path_id", 100).select("path_id", "skip_reason")


@query(f"with {_PLAN} select count(*) as n_rows, count(*) filter (skip_reason = 'needs_review') as n_needs_review, count(*) filter (skip_reason = 'missing_metadata') as n_missing_metadata from plan")
def plan_counters(t: Tables) -> DataFrame:
    return moves.counters(moves.move_plan(_parts(t), ROUTES), ["needs_review", "missing_metadata"], "skip_reason")


@query(f"""
with {_PLAN}, s as (select plan.*, case when path_id % 3 = 0 then 'human_reviewed' when path_id % 3 = 1 then 'llm' else 'rule_based' end as source, path_id % 29 = 0 as corrupt, path_id % 31 = 0 as unregistered, path_id % 11 <> 0 as has_metadata from plan),
x as (select path_id, case when corrupt then 'corrupt_candidate' when unregistered then 'unregistered_path' when not has_metadata then 'missing_metadata' when source = 'rule_based' then 'unreviewed_metadata' else coalesce(skip_reason, 'planned') end as reason from s)
select path_id, reason, case when reason = 'planned' then 'planned' else 'skipped' end as status from x
""")
def relocate_plan(t: Tables) -> DataFrame:
    n = F.col("path_id")
    plan = moves.move_plan(_parts(t), ROUTES).withColumns({"source": F.when(n % 3 == 0, "human_reviewed").when(n % 3 == 1, "llm").otherwise("rule_based"), "corrupt": n % 29 == 0, "file": n})
    out = moves.relocate_plan(plan.withColumn("path_id", F.when(n % 31 != 0, n)))
    return out.select(F.col("file").alias("path_id"), "reason", "status")


@query("""
with e as (select event_id, event_type <> 'error' as ok, concat(event_type, ': ', cast(user_id as varchar)) as error from events)
select count(*) as n_total, count(*) filter (ok) as n_ok, count(*) filter (not ok) as n_failed, count(*) filter (not ok) > 20 as truncated from e
""")
def move_stats(t: Tables) -> DataFrame:
    return moves.apply_stats(_log(t), "event_id")[0]


@query("select split_part(concat(event_type, ': ', cast(user_id as varchar)), ':', 1) as error_class, count(*) as n from events where event_type = 'error' or value < 10 group by 1")
def error_histogram(t: Tables) -> DataFrame:
    return moves.apply_stats(_log(t).withColumn("ok", ~((F.col("event_type") == "error") | F.coalesce(F.col("value") < 10, F.lit(False)))), "event_id")[1]


@query("select event_id from events where event_type = 'error' order by event_id limit 20")
def first_failures(t: Tables) -> DataFrame:
    return moves.apply_stats(_log(t), "event_id")[2].select("event_id")


def _log(t: Tables) -> DataFrame:
    return t.events.withColumn("ok", F.col("event_type") != "error").withColumn("error", F.concat(F.col("event_type"), F.lit(": "), F.col("user_id").cast("string")))


@query(r"""
with m as (select page_id, case when page_id % 13 <> 0 then concat(case when page_id % 5 = 0 then '' else 'D:\' end, cast(page_id as varchar)) end as src, concat('E:\x', case when page_id % 7 = 0 then 'D:\y' else '' end) as dst from pages)
select page_id, case when src is null then 'missing_src_or_dst' when page_id % 7 = 0 then 'invalid_path_embedded_drive' when page_id % 5 = 0 then 'invalid_path_not_drive_rooted' when page_id % 3 = 0 then 'src_not_found' when page_id % 2 = 0 then 'dst_exists' end as error from m
""")
def move_errors(t: Tables) -> DataFrame:
    n = F.col("page_id")
    src = F.when(n % 13 != 0, F.concat(F.when(n % 5 == 0, "").otherwise("D:\\"), n.cast("string")))
    dst = F.concat(F.lit("E:\\x"), F.when(n % 7 == 0, "D:\\y").otherwise(""))
    return t.pages.select("page_id", moves.move_errors(src, dst, n % 3 != 0, n % 2 == 0).alias("error"))


@query("""
select p_partkey as path_id, case when lower(p_name) like 'a%' then 'A titles' when lower(p_name) like 's%l%' then 'S titles' else p_name end as program_title, cast(case when lower(p_name) like 'a%' or lower(p_name) like 's%l%' then 1 else 0 end as int) as human_reviewed from part
""")
def title_updates(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("path_id"), F.col("p_name").alias("path"), F.col("p_name").alias("program_title"), F.lit("llm").alias("source"), F.lit(0).alias("human_reviewed"), F.lit(1).alias("needs_review"))
    changes = t.spark.createDataFrame([("A%", "A titles"), ("s%L%", "S titles")], "path_pattern string, new_title string")
    return moves.title_updates(rows, changes).select("path_id", "program_title", F.col("human_reviewed").cast("int").alias("human_reviewed"))


@query("select p_partkey, case when contains(p_type, 'ECONOMY') then 'plain' when contains(p_type, 'SMALL') then 'small' when contains(p_name, 'a') then 'titled' end as genre from part")
def genre_resolution(t: Tables) -> DataFrame:
    words = {"ECONOMY": "plain", "SMALL": "small"}
    epg = F.array(F.struct(F.lit("").alias("category"), F.col("p_type").alias("subcategory")))
    title = F.when(F.contains("p_name", F.lit("a")), "titled")
    return t.part.select("p_partkey", F.coalesce(moves.genre(F.lit(None).cast("string"), epg, F.lit(""), words), title).alias("genre"))
