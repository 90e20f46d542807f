"""One query for each family of scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import dates as D
from tapewright.functions import keys as K
from tapewright.functions import text as X
from tapewright.functions import values as V
from tapewright.operators import ingest, reconcile, resolve, views
from tapewright.queries.base import Tables, query


def _win(t: Tables) -> DataFrame:
    """Page paths as recordings on a drive, with mount forms and mixed case between."""
    n = F.col("page_id")
    tail = F.concat(F.lit("/VideoLibrary/"), F.split("url", "/")[2], F.lit("/2020_01_02_03_04 "), n.cast("string"), F.lit(".MP4"))
    return t.pages.select("page_id", F.when(n % 2 == 0, F.concat(F.lit("/mnt/d"), tail)).otherwise(F.concat(F.lit("e:"), F.translate(tail, "/", "\\"))).alias("path"))


_WIN = r"""w as (select page_id, split_part(url, '/', 3) as host, case when page_id % 2 = 0 then 'D' else 'E' end as drive from pages)"""


@query(rf"with {_WIN} select page_id, concat(drive, ':\VideoLibrary\', host, '\2020_01_02_03_04 ', cast(page_id as varchar), '.MP4') as path from w")
def scalar_windows_path(t: Tables) -> DataFrame:
    return _win(t).select("page_id", X.windows_path(F.col("path")).alias("path"))


@query(rf"with {_WIN} select page_id, concat('/mnt/', lower(drive), '/VideoLibrary/', host, '/2020_01_02_03_04 ', cast(page_id as varchar), '.MP4') as path from w")
def scalar_mount_path(t: Tables) -> DataFrame:
    return _win(t).select("page_id", X.mount_path(X.windows_path(F.col("path"))).alias("path"))


@query(rf"with {_WIN} select page_id, drive, concat(drive, ':\VideoLibrary\', host) as dir, concat('2020_01_02_03_04 ', cast(page_id as varchar), '.MP4') as name, '.mp4' as ext from w")
def scalar_path_split(t: Tables) -> DataFrame:
    return _win(t).select("page_id", X.path_parts(X.windows_path(F.col("path"))).alias("p")).select("page_id", "p.*")


@query(rf"with {_WIN} select page_id, host as folder from w")
def scalar_folder_title(t: Tables) -> DataFrame:
    return _win(t).select("page_id", X.folder_title(X.windows_path(F.col("path"))).alias("folder"))


@query(r"""
with s as (select doc_id, rtrim(regexp_replace(regexp_replace(regexp_replace(trim(text, chr(10) || ' '), '[\x00-\x1f]', '', 'g'), '[<>:"/\\|?*]', '＿', 'g'), ' +', ' ', 'g'), '. ') as s from documents)
select doc_id, case when s = '' then 'UNKNOWN' when length(s) > 60 then concat(rtrim(left(s, 51)), '_', left(sha1(s), 8)) else s end as dir from s
""")
def scalar_safe_dir(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.safe_dir(F.col("text")).alias("dir"))


@query(r"select page_id, left(trim(regexp_replace(regexp_replace(url, '[^0-9A-Za-z._-]+', '_', 'g'), '_+', '_', 'g'), '._-'), 120) as key from pages")
def scalar_safe_group(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.safe_group(F.col("url")).alias("key"))


@query(r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(url), '\s+', '_', 'g'), '[<>:"/\\|?*]', '', 'g'), '_+', '_', 'g'), '_') as key from pages""")
def scalar_program_key(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.program_key(F.col("url")).alias("key"))


@query(r"""select p_partkey, regexp_replace(regexp_replace(lower(p_name), '\s+', '', 'g'), '[<>:"/\\|?*]', '', 'g') as compact, regexp_replace(lower(p_type), '\s+', ' ', 'g') as subtitle, regexp_replace(p_name, '\s+', '_', 'g') as display from part""")
def scalar_title_forms(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.compact_lower(F.col("p_name")).alias("compact"), X.subtitle_key(F.col("p_type")).alias("subtitle"), X.display_key(F.col("p_name")).alias("display"))


@query("select event_id, event_type as error_class from events")
def scalar_error_class(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.error_class(F.concat("event_type", F.lit(" : x:y"))).alias("error_class"))


@query("select p_partkey, case when p_partkey % 3 = 0 then cast(p_size as bigint) * 100 when p_partkey % 3 = 1 then cast(p_size as bigint) else 0 end as score from part")
def scalar_resolution(t: Tables) -> DataFrame:
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(n % 3 == 0, F.concat(size, F.lit(" x 100"))).when(n % 3 == 1, size).otherwise("hd")
    return t.part.select("p_partkey", V.resolution_score(text).alias("score"))


@query("select o_orderkey, o_orderkey % 3 = 0 as iso, case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%Y') end as year, case when o_orderkey % 3 = 1 then 'invalid_air_date' when o_orderkey % 3 = 2 then 'missing_air_date' end as error from orders")
def scalar_iso_shape(t: Tables) -> DataFrame:
    n = F.col("o_orderkey")
    day = F.when(n % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(n % 3 == 1, F.date_format("o_orderdate", "yyyy/MM")).otherwise(" ")
    ym = D.year_month(day)
    return t.orders.select("o_orderkey", D.is_iso_date(day).alias("iso"), ym["year"].alias("year"), ym["error"].alias("error"))


@query("select p_partkey, cast(case when p_partkey % 3 <> 2 then p_size end as int) as episode from part")
def scalar_episode_no(t: Tables) -> DataFrame:
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.when(n % 3 == 0, F.concat("p_name", F.lit(" 第 "), size, F.lit("話 x"))).when(n % 3 == 1, F.concat("p_name", F.lit("("), size, F.lit(") "))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.episode_number(name).alias("episode"))


@query("""
with p as (select p_partkey, lower(replace(p_name, ' ', '')) as b, lower(replace(p_type, ' ', '')) as c, string_split(lower(p_name), ' ') as w from part)
select p_partkey, cast(case when b = c then 10000 when contains(c, b) then length(b) when contains(b, c) then length(c) else coalesce(list_sum(list_transform(list_filter(w, lambda x: x <> '' and contains(c, x)), lambda x: length(x))), 0) end as int) as score from p
""")
def scalar_overlap_score(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.overlap_score(F.col("p_name"), F.col("p_type")).cast("int").alias("score"))


@query("select doc_id, case doc_id % 4 when 0 then 'ア' when 1 then 'カ' when 2 then 'ハ' else 'MV' end as folder from documents")
def scalar_syllabary(t: Tables) -> DataFrame:
    n = F.col("doc_id") % 4
    first = F.when(n == 0, "あ").when(n == 1, "ガ").when(n == 2, "ぽ").otherwise("")
    return t.documents.select("doc_id", X.syllabary(F.concat(first, "text")).alias("folder"))


@query("select doc_id, case when length(text) > 220 then concat(left(text, 220), '…') else text end as preview from documents")
def scalar_preview(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("select doc_id, case when doc_id % 2 = 0 then 'low_confidence,late' else 'late,low_confidence' end as reasons from documents")
def scalar_reasons(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.append_reason(F.when(F.col("doc_id") % 2 == 0, "low_confidence").otherwise("late, low_confidence"), F.lit("late")).alias("reasons"))


@query("""
with f as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d from orders)
select o_orderkey, case when o_orderkey % 4 <> 3 then d end as air_date, case when o_orderkey % 4 <> 3 then '21:05' end as start_time, 'Show Name' as title from f
""")
def scalar_file_dates(t: Tables) -> DataFrame:
    n = F.col("o_orderkey")
    forms = F.when(n % 4 == 0, F.date_format("o_orderdate", "yyyy_MM_dd_'21_05'")).when(n % 4 == 1, F.date_format("o_orderdate", "yyyy MM dd '21 05'")).when(n % 4 == 2, F.date_format("o_orderdate", "yyyyMMdd'2105'")).otherwise("")
    rows = t.orders.select("o_orderkey", F.concat(F.lit("Show  Name"), F.when(forms != "", F.lit(" ")).otherwise(""), forms, F.lit(".mp4")).alias("name"))
    at = D.file_date_time(F.col("name"))
    return rows.select("o_orderkey", at["air_date"].alias("air_date"), at["start_time"].alias("start_time"), D.file_title(F.col("name")).alias("title"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as air_date, '05:07' as start_time, '25:10' as end_time from orders")
def scalar_guide_range(t: Tables) -> DataFrame:
    line = F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("(x) 5:07~25:10"))
    return t.orders.select("o_orderkey", D.guide_range(line).alias("g")).select("o_orderkey", "g.*")


_ID = """concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', lower(to_hex((cast(concat('0x', substr(h, 17, 2)) as int) & 63) | 128)), substr(h, 19, 2), '-', substr(h, 21, 12))"""


@query(rf"with {_WIN}, h as (select page_id, sha1(unhex('f4f67a6f90c64ee49c1a2c0d25b3b0c4') || encode(lower(concat('winpath:', drive, ':\VideoLibrary\', host, '\2020_01_02_03_04 ', cast(page_id as varchar), '.MP4')))) as h from w) select page_id, {_ID} as path_id from h")
def uuid_keys(t: Tables) -> DataFrame:
    return _win(t).select("page_id", K.path_id(X.windows_path(F.col("path"))).alias("path_id"))


@query("""
select o_orderkey, case when o_orderkey % 3 = 0 then concat('p', cast(o_custkey as varchar), '::ep::7') when o_orderkey % 3 = 1 then concat('p', cast(o_custkey as varchar), '::sub::', lower(o_orderpriority)) end as dedup_key,
  case when o_orderkey % 3 = 0 then concat('p', cast(o_custkey as varchar), '::ep::7') when o_orderkey % 3 = 1 then concat('p', cast(o_custkey as varchar), '::sub::', lower(o_orderpriority)) else concat('p', cast(o_custkey as varchar), '::date::', strftime(o_orderdate, '%Y-%m-%d')) end as episode_key,
  case when o_orderkey % 3 = 2 then 'missing_episode_and_subtitle' end as reason from orders
""")
def grouping_keys(t: Tables) -> DataFrame:
    n = F.col("o_orderkey")
    key, ep, sub = F.concat(F.lit("p"), F.col("o_custkey").cast("string")), F.when(n % 3 == 0, " 7"), F.when(n % 3 == 1, F.col("o_orderpriority"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select("o_orderkey", K.dedup_key(key, ep, sub).alias("dedup_key"), K.episode_key(key, ep, sub, day).alias("episode_key"), K.dedup_key_reason(key, ep, sub).alias("reason"))


@query("select o_orderkey, concat('show_name::ch_1::', strftime(o_orderdate, '%Y-%m-%d'), '::21:05') as guide_key, concat('show_name::', strftime(o_orderdate, '%Y-%m-%d'), '::21:05') as file_key, concat(strftime(o_orderdate, '%Y-%m-%d'), '::21:05') as time_key from orders")
def match_keys(t: Tables) -> DataFrame:
    day, at = F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("21:05")
    guide = K.guide_match_key(F.lit("Show: Name?"), F.lit("Ch 1"), day, at)
    return t.orders.select("o_orderkey", guide.alias("guide_key"), K.without_broadcaster(guide).alias("file_key"), K.datetime_key(day, at).alias("time_key"))


@query(r"select page_id, case when page_id % 3 = 0 then concat('E:\New', cast(page_id as varchar)) when page_id % 3 = 1 then concat('E:\New\', cast(page_id as varchar)) else 'E:\Other' end as path from pages where page_id % 3 <> 0")
def prefix_rewrite(t: Tables) -> DataFrame:
    n = F.col("page_id")
    rows = t.pages.where("page_id % 3 <> 0").select("page_id", F.when(n % 3 == 1, F.concat(F.lit("e:\\OLD\\"), n.cast("string"))).otherwise("E:\\Other").alias("path"))
    return rows.select("page_id", reconcile.rewrite_prefix(F.col("path"), "E:\\old", "E:\\New").alias("path"))


@query(rf"with {_WIN} select page_id, case when page_id % 3 = 0 then concat(drive, ':\lib') when page_id % 3 = 1 then concat(drive, ':\lib') else concat(drive, ':\') end as root from w")
def affected_roots(t: Tables) -> DataFrame:
    n = F.col("page_id")
    drive = F.when(n % 2 == 0, "D:\\").otherwise("E:/")
    path = F.concat(drive, F.when(n % 3 == 0, "lib\\Title\\2020\\01\\a.mp4").when(n % 3 == 1, "lib/Old/a.mp4").otherwise("x\\a.mp4"))
    return t.pages.select("page_id", resolve.affected_root(path, F.lit("Old")).alias("root"))


@query("select p_partkey, split_part(p_name, ' ', 1) as head, p_partkey % 2 = 0 as marked from part")
def separator_split(t: Tables) -> DataFrame:
    title = F.concat(F.split("p_name", " ")[0], F.when(F.col("p_partkey") % 2 == 0, " ▽rest▼x").otherwise(""))
    return t.part.select("p_partkey", X.before_separator(title).alias("head"), X.has_separator(title).alias("marked"))


@query("select p_partkey, length(p_type) >= 8 as swallowed, length(p_type) >= 3 as shortened from part")
def title_lengths(t: Tables) -> DataFrame:
    longer = F.concat(F.lower("p_name"), F.lower("p_type"))
    return t.part.select("p_partkey", X.swallowed(F.lower("p_name"), longer).alias("swallowed"), X.shortened(longer, F.lower("p_name")).alias("shortened"))


@query("select event_id, case event_id % 4 when 0 then true when 1 then false else event_id % 4 = 2 end as flag, case when event_id % 2 = 0 then 0.5 else 0.0 end::double as confidence from events")
def scalar_lenient(t: Tables) -> DataFrame:
    n = F.col("event_id")
    word = F.when(n % 4 == 0, " Yes ").when(n % 4 == 1, "off")
    return t.events.select("event_id", F.when(n % 4 == 2, V.flag(word, True)).otherwise(V.flag(word, False)).alias("flag"), V.confidence(F.when(n % 2 == 0, "0.5").otherwise("high")).alias("confidence"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, concat('Show_', cast(o_custkey as varchar)) as stem from orders")
def scalar_mtime_and_stem(t: Tables) -> DataFrame:
    stem = F.concat(F.lit("Show_"), F.col("o_custkey").cast("string"))
    name = F.concat(stem, F.date_format("o_orderdate", "_yyyy_MM_dd_'21_05'"), F.lit(".mp4"))
    return t.orders.select("o_orderkey", D.date_of_mtime(D.utc_text(F.col("o_orderdate").cast("timestamp"))).alias("day"), X.strip_date_suffix(name).alias("stem"))


@query("""
with b as (select o_orderkey as id, concat('show::', lower(o_orderstatus), '::', strftime(o_orderdate, '%Y-%m-%d'), '::21:05') as k from orders)
select id as broadcast_id, case when id % 5 = 0 then null else 'stale' end as old, k as new from b where id % 5 = 0 or id % 7 = 0
""")
def rematch_keys(t: Tables) -> DataFrame:
    n, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = t.orders.select(n.alias("broadcast_id"), F.lit("Show?").alias("official_title"), F.col("o_orderstatus").alias("broadcaster"), day.alias("air_date"), F.lit("21:05").alias("start_time"))
    key = K.guide_match_key(F.col("official_title"), F.col("broadcaster"), F.col("air_date"), F.col("start_time"))
    m = F.col("broadcast_id")
    return ingest.rematch(rows.withColumn("match_key", F.when(m % 5 == 0, None).when(m % 7 == 0, "stale").otherwise(key)))


@query(r"""
with p as (select distinct lower(p_brand) as b, p_brand as w from part) select concat('D:\', b) as src, concat('D:\', w) as dst, 2 as depth from p where b <> w
""")
def case_renames(t: Tables) -> DataFrame:
    tail = F.concat(F.lit("\\"), F.col("p_partkey").cast("string"))
    rows = t.part.select(F.concat(F.lit("D:\\"), F.lower("p_brand"), tail).alias("now"), F.concat(F.lit("D:\\"), "p_brand", tail).alias("wanted"))
    return reconcile.case_renames(rows, "now", "wanted")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'e') and contains(lower(p_type), 'o')")
def title_filter(t: Tables) -> DataFrame:
    return views.matching(t.part, contains={"p_name": "E", "p_type": "o"}, exact={"p_brand": ""}, one_of={"p_size": []}).select("p_partkey", "p_name")
