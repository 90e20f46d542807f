"""Flows over the tables: ingest batches, repairs, extraction rows, title fixes, plans, reviews and runs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import keys as K
from tapewright.functions import text as X
from tapewright.operators import catalog, dedup, extract, ingest, merge, reconcile, resolve
from tapewright.plans import api, moves, workflow
from tapewright.queries.base import Tables, query

#: SQL of a name-based UUID of name space ``ns`` (hex) and name ``x``, by way of its sha1 ``h``.
_UUID = "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', lower(to_hex((cast(concat('0x', substr(h, 17, 2)) as int) & 63) | 128)), substr(h, 19, 2), '-', substr(h, 21, 12))"
_PATHS, _FILES, _URLS = (x.replace("-", "") for x in (K.PATHS, K.FILES, K.URLS))


def _sha(ns: str, name: str) -> str:
    return f"sha1(unhex('{ns}') || encode({name}))"


@query(rf"""
with p as (select n_nationkey, concat('D:\', lower(n_name), '\x.TS') as path, n_regionkey from nation), h as (select *, {_sha(_PATHS, "lower(concat('winpath:', path))")} as h from p)
select {_UUID} as path_id, path, 'D' as drive, 'x.TS' as name, '.ts' as ext, case when n_nationkey % 2 = 0 then 't1' else 't2' end as created_at, 't2' as updated_at, cast(n_regionkey + 100 as bigint) as size_bytes from h
""")
def inventory_upsert(t: Tables) -> DataFrame:
    """A stored inventory of every other file, then one of all, in mount form and twice each: creation times stay, the last size counts."""
    at = F.concat(F.lit("/mnt/d/"), F.lower("n_name"), F.lit("/x.TS"))
    first = t.nation.where("n_nationkey % 2 = 0").select(at.alias("path"), F.lit(1).cast("long").alias("size"), F.lit("1").alias("mtime"))
    twice = t.nation.select(at.alias("path"), F.explode(F.array(F.struct((F.col("n_regionkey") + 100).cast("long").alias("size"), F.lit("9").alias("mtime")), F.struct(F.lit(5).cast("long").alias("size"), F.lit("3").alias("mtime")))).alias("x")).select("path", "x.*")
    old, _ = ingest.inventory_batches(first, "r1", "t1")
    new, seen = ingest.inventory_batches(twice, "r2", "t2")
    table = ingest.upsert_paths(old, new)
    return table.join(seen.select("path_id", "size_bytes"), "path_id").select("path_id", "path", "drive", "name", "ext", "created_at", "updated_at", "size_bytes")


@query(rf"""
with p as (select n_nationkey, n_name, {_sha(_FILES, "concat('path:', cast(n_nationkey as varchar))")} as h from nation where n_nationkey % 2 = 0)
select cast(n_nationkey as varchar) as path_id, {_UUID} as file_id, n_name as content_hash, 'BLAKE3' as hash_algo, cast(1 as int) as is_current from p
""")
def hash_ingest(t: Tables) -> DataFrame:
    """A hash report's files and links; paths that the catalog lacks are left out."""
    path = F.concat(F.lit("D:\\"), F.col("n_name"))
    report = t.nation.select(F.concat(F.lit("/mnt/d/"), F.col("n_name")).alias("path"), F.col("n_regionkey").cast("long").alias("size"), F.col("n_name").alias("hash"))
    files, links = ingest.hash_batches(report, t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("path_id"), path.alias("path")))
    return links.join(files, "file_id").select("path_id", "file_id", "content_hash", "hash_algo", "is_current")


@query("""
with r as (select o_orderkey as path_id, concat('k', cast(o_custkey as varchar)) as k, strftime(o_orderdate, '%Y-%m-%d') as d, o_orderstatus as b, case o_orderkey % 3 when 0 then true when 1 then false end as f from orders),
g as (select k from r group by 1 having count(*) >= 2 and (count(distinct d) > 1 or count(distinct b) > 1)),
s as (select k, bool_or(f) as any_true, bool_or(f is not null) as known, arg_min(path_id, struct_pack(a := d, b := lpad(cast(path_id as varchar), 12, '0'))) as title from r group by 1)
select cast(path_id as varchar) as path_id, substr(sha256(k), 1, 16) as group_id, case when coalesce(any_true, false) then case when coalesce(f, false) then 'rebroadcast' else 'original' end when known then 'original' else 'unknown' end as broadcast_type, concat('T', cast(title as varchar)) as program_title
from r join g using (k) join s using (k)
""")
def group_ingest(t: Tables) -> DataFrame:
    n = F.col("o_orderkey")
    rows = t.orders.select(F.lpad(n.cast("string"), 12, "0").alias("path_id"), F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("episode_key"), F.concat(F.lit("T"), n.cast("string")).alias("program_title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("air_date"), F.col("o_orderstatus").alias("broadcaster"), F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("flag"))
    groups, members = ingest.group_batches(rows, "t")
    return members.join(groups.select("group_id", "program_title"), "group_id").select(F.col("path_id").cast("long").cast("string").alias("path_id"), "group_id", "broadcast_type", "program_title")


@query("""select c_custkey, cast(case when c_mktsegment = 'BUILDING' then 0 when c_mktsegment = 'MACHINERY' then 1 else c_custkey % 2 end as int) as needs_review,
  case c_mktsegment when 'BUILDING' then 'false' when 'MACHINERY' then 'true' when 'AUTOMOBILE' then null else 'old' end as in_json from customer""")
def view_update(t: Tables) -> DataFrame:
    """An update through the view of titles sets the flag in column and JSON; other titles stay."""
    md = t.customer.select("c_custkey", F.col("c_mktsegment").alias("program_title"), (F.col("c_custkey") % 2).cast("int").alias("needs_review"), F.when(F.col("c_mktsegment") != "AUTOMOBILE", F.to_json(F.struct(F.lit("old").alias("needs_review"), F.array(F.lit(1)).alias("x")))).alias("data_json"))
    out = ingest.update_needs_review(md, t.spark.createDataFrame([("BUILDING", 0), ("MACHINERY", 1), ("NONE", 1)], "program_title string, needs_review int"))
    return out.select("c_custkey", "needs_review", F.get_json_object("data_json", "$.needs_review").alias("in_json"))


@query("""select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'terrestrial' when c_custkey % 3 = 0 then 'bs_cs' when c_custkey % 3 = 1 then 'odd' end as resolved_bucket,
  case when c_mktsegment not in ('BUILDING', 'MACHINERY') and c_custkey % 3 = 0 then c_mktsegment end as new_keyword, case when c_mktsegment not in ('BUILDING', 'MACHINERY') and c_custkey % 3 <> 0 then 'unknown_broadcaster_needs_bucket' end as error from customer""")
def broadcaster_review(t: Tables) -> DataFrame:
    n = F.col("c_custkey") % 3
    answers = t.customer.select("c_custkey", F.col("c_mktsegment").alias("broadcaster"), F.when(n == 0, "bs_cs").when(n == 1, "odd").alias("bucket"))
    return dedup.broadcaster_answers(answers, {"terrestrial": ["build", "Machinery"], "bs_cs": ["nothing"]}).select("c_custkey", "resolved_bucket", "new_keyword", "error")


@query("""select c_custkey, cast(case c_custkey % 5 when 0 then 1 when 1 then 0 when 2 then 1 when 3 then 0 end as int) as is_rebroadcast_flag, concat('[{"category":"', c_mktsegment, '","subcategory":""}]') as epg_genres, '["x","y"]' as annotations,
  left(repeat(c_name, 40), 500) as description, c_name as official_title from customer""")
def split_broadcasts(t: Tables) -> DataFrame:
    n = F.col("c_custkey") % 5
    flag = F.when(n == 0, "true").when(n == 1, "0").when(n == 2, '"yes"').when(n == 3, "false").otherwise('"?"')
    data = F.concat(F.lit('{"is_rebroadcast_flag":'), flag, F.lit(',"epg_genres":[{"category":"'), F.col("c_mktsegment"), F.lit('","subcategory":""}],"annotations":["x","y"],"description":"'), F.repeat("c_name", F.lit(40)), F.lit('","official_title":"'), F.col("c_name"), F.lit('"}'))
    out = catalog.split_broadcast(t.customer.select("c_custkey", data.alias("data_json")))
    return out.select("c_custkey", "is_rebroadcast_flag", "epg_genres", "annotations", "description", "official_title")


@query(r"select n_nationkey, 'D' as drive, concat('D:\', n_name) as dir, 'y.TS' as name, '.ts' as ext from nation where n_nationkey % 3 <> 0")
def repaired_paths(t: Tables) -> DataFrame:
    """Names that hold folders or drives are split anew; whole rows aren't touched."""
    path = F.concat(F.lit("D:\\"), F.col("n_name"), F.lit("\\y.TS"))
    n = F.col("n_nationkey") % 3
    name = F.when(n == 0, "y.TS").when(n == 1, F.concat("n_name", F.lit("\\y.TS"))).otherwise(path)
    return ingest.repair_paths(t.nation.select("n_nationkey", path.alias("path"), F.lit(None).cast("string").alias("drive"), F.lit("").alias("dir"), name.alias("name"), F.lit("").alias("ext"))).select("n_nationkey", "drive", "dir", "name", "ext")


@query("""select o_orderkey, case when o_orderkey % 4 = 0 then 'kept' else 'new' end as title from orders where o_orderkey % 3 <> 0""")
def locked_rows(t: Tables) -> DataFrame:
    """Rows that a human reviewed come through an extraction as they were."""
    new = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.lit("new").alias("title"))
    stored = t.orders.select("o_orderkey", F.lit("kept").alias("title"), F.when(F.col("o_orderkey") % 4 == 0, 1).when(F.col("o_orderkey") % 4 == 1, 0).alias("human_reviewed"))
    return extract.keep_locked(new, stored, "o_orderkey").select("o_orderkey", "title")


@query("""select o_orderkey, case when o_custkey % 2 = 0 then case when o_custkey % 4 = 0 then concat(c_mktsegment, ' - ', c_name) else c_mktsegment end end as epg_genre, case when o_custkey % 2 = 0 then left(repeat(c_name, 30), 300) end as epg_description
  from orders left join customer on c_custkey = o_custkey and c_custkey % 2 = 0""")
def enriched_rows(t: Tables) -> DataFrame:
    genre = F.struct(F.col("c_mktsegment").alias("category"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise("").alias("subcategory"))
    guides = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.array(genre, F.struct(F.lit("z").alias("category"), F.lit("z").alias("subcategory"))).alias("epg_genres"), F.lit(True).alias("is_rebroadcast_flag"), F.repeat("c_name", F.lit(30)).alias("description"))
    return extract.enrich(t.orders.select("o_orderkey", "o_custkey"), guides, "o_custkey").select("o_orderkey", "epg_genre", "epg_description")


@query("""
with f as (select o_custkey, o_orderpriority as title, min(o_orderkey) as first from orders group by 1, 2), s as (select o_custkey, o_orderstatus as start, min(o_orderkey) as first from orders group by 1, 2),
t as (select o_custkey, title, row_number() over (partition by o_custkey order by first) as r from f), u as (select o_custkey, start, row_number() over (partition by o_custkey order by first) as r from s)
select o_custkey, (select string_agg(title, ',' order by r) from t where t.o_custkey = o.o_custkey and r <= 4) as titles, (select string_agg(start, ',' order by r) from u where u.o_custkey = o.o_custkey and r <= 4) as starts from (select distinct o_custkey from orders) o
""")
def hint_payloads(t: Tables) -> DataFrame:
    found = t.orders.select("o_custkey", F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("start"))
    return extract.hint_payload(found, "o_custkey", "title", "start", 4).select("o_custkey", F.array_join("titles", ",").alias("titles"), F.array_join("start_times", ",").alias("starts"))


#: Titles as customers have them: with an episode, with a mark, alone, empty; aliases of some.
_TITLED = "select c_custkey, case c_custkey % 6 when 0 then concat(replace(c_name, '#', ' '), ' 第3話 x') when 1 then concat(replace(c_name, '#', ' '), '▽rest') when 2 then concat(' ', replace(c_name, '#', ' '), ' ') when 3 then concat(replace(c_name, '#', ' '), ' #12 y') when 4 then '' else concat('▼', replace(c_name, '#', ' ')) end as title from customer"


def _titled(t: Tables) -> DataFrame:
    n, name = F.col("c_custkey") % 6, F.replace("c_name", F.lit("#"), F.lit(" "))
    return t.customer.select("c_custkey", F.when(n == 0, F.concat(name, F.lit(" 第3話 x"))).when(n == 1, F.concat(name, F.lit("▽rest"))).when(n == 2, F.concat(F.lit(" "), name, F.lit(" "))).when(n == 3, F.concat(name, F.lit(" #12 y"))).when(n == 4, "").otherwise(F.concat(F.lit("▼"), name)).alias("title"))


@query(f"""
with t as ({_TITLED})
select c_custkey, case c_custkey % 6 when 4 then 'UNKNOWN' when 5 then concat('▼', replace(c_name, '#', ' ')) when 0 then case when c_custkey % 4 = 0 then concat('Series ', replace(c_name, '#', ' ')) else concat(replace(c_name, '#', ' '), ' 第3話 x') end when 3 then case when c_custkey % 4 = 0 then concat('Series ', replace(c_name, '#', ' ')) else replace(c_name, '#', ' ') end
  else case when c_custkey % 4 = 0 then concat('Series ', replace(c_name, '#', ' ')) else replace(c_name, '#', ' ') end end as series from t join customer using (c_custkey)
""")
def series_names(t: Tables) -> DataFrame:
    """By alias of the title, of the title without its episode, or of what stands before a mark; else that."""
    aliases = t.customer.where("c_custkey % 4 = 0").select(X.program_key(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("alias"), F.concat(F.lit("Series "), F.replace("c_name", F.lit("#"), F.lit(" "))).alias("canonical"))
    return resolve.series_name(_titled(t), "title", aliases).select("c_custkey", "series")


@query("""
with t as (select p_partkey, case p_partkey % 3 when 0 then concat(p_name, '▽', p_type) when 1 then concat(replace(p_brand, '#', ' '), ' and more than that here') else replace(p_brand, '#', ' ') end as title, p_name, replace(p_brand, '#', ' ') as p_brand from part)
select p_partkey, case when length(title) <= 25 then null when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then p_brand end as fixed from t
""")
def long_titles(t: Tables) -> DataFrame:
    """Long titles get their series' name, else the longest known title that they begin with."""
    n, brand = F.col("p_partkey") % 3, F.replace("p_brand", F.lit("#"), F.lit(" "))
    titles = t.part.select("p_partkey", F.when(n == 0, F.concat("p_name", F.lit("▽"), "p_type")).when(n == 1, F.concat(brand, F.lit(" and more than that here"))).otherwise(brand).alias("title"))
    none = t.spark.createDataFrame([], "alias string, canonical string")
    known = t.part.select(brand.alias("title")).distinct().unionByName(t.spark.createDataFrame([("Brand",), ("Brand 1 x",)], "title string"))
    return resolve.long_title_fix(titles, "title", none, known).select("p_partkey", "fixed")


@query("""
with r as (select p_partkey, p_brand as title, case when p_partkey % 5 = 0 then null when p_partkey % 5 = 1 then p_brand else p_type end as suggested, case p_partkey % 4 when 0 then 'human_exact' when 1 then 'human' when 2 then 'programs' else 'prefix_family' end as src, p_size % 2 = 0 as strong, p_size % 3 = 0 as family from part)
select p_partkey, case when src in ('human', 'human_exact') or strong then 'high' when src = 'programs' then 'medium' else 'low' end as confidence from r where suggested is not null and suggested <> title and (src <> 'human_exact' or family)
""")
def contaminated_titles(t: Tables) -> DataFrame:
    n = F.col("p_partkey")
    rows = t.part.select("p_partkey", "p_size", F.col("p_brand").alias("title"), F.when(n % 5 == 0, None).when(n % 5 == 1, F.col("p_brand")).otherwise(F.col("p_type")).alias("suggested"), F.when(n % 4 == 0, "human_exact").when(n % 4 == 1, "human").when(n % 4 == 2, "programs").otherwise("prefix_family").alias("match_source"))
    return resolve.contamination(rows, F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0).select("p_partkey", "confidence")


@query("""
with r as (select o_orderkey as id, o_orderkey % 6 as n, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderpriority as pri from orders)
select id, case n when 0 then 'Known' when 1 then 'Rule' when 2 then 'Guide' when 3 then 'UNKNOWN' when 4 then 'Better' else 'Show' end as program_title, case n when 0 then 'dictionary_match' when 1 then 'rule' when 2 then 'guide' else 'file_name' end as source,
  case when n = 3 then null else day end as air_date, case n when 0 then 0.92 when 1 then 0.78 when 2 then 0.72 when 3 then 0.4 when 4 then 0.78 else 0.65 end::double as confidence, n in (3, 5) as needs_review,
  case n when 2 then 'air_date_from_mtime' when 3 then 'missing_air_date,unknown_program_title' when 4 then 'auto_corrected_from_human' when 5 then 'program_title_may_include_description' else '' end as reason from r
""")
def extracted_rows(t: Tables) -> DataFrame:
    """Titles by dictionary, rule, guide, file name and suggestion; what each finding leaves of the confidence."""
    n, day = F.col("o_orderkey") % 6, F.date_format("o_orderdate", "yyyy-MM-dd")
    at = lambda k, x: F.when(n == k, x)
    head = F.when(n == 3, "UNKNOWN").otherwise("Show")
    dated = F.when(n.isin(2, 3), "").otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy_MM_dd_'21_05'")))
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"), F.concat(head, F.lit("_x"), dated, F.lit(".mp4")).alias("name"), F.when(n == 5, "D:\\by_program\\S\\x").otherwise("D:\\in\\x").alias("path"), at(0, "Known").alias("dictionary_title"), at(1, "Rule").alias("rule_title"),
        at(2, "Guide").alias("guide_title"), at(4, "Better").alias("suggested"), F.lit("human").alias("match_source"), F.when(n != 3, F.concat(day, F.lit("T00:00:00"))).alias("mtime"),
    )
    rows = rows.withColumn("path", F.when(F.col("id") % 6 == 5, "D:\\by_program\\Sh\\x").otherwise(F.col("path")))
    out = extract.build_rows(rows.withColumn("rule_title", F.when(F.col("id") % 6 == 5, "Show long title").otherwise(F.col("rule_title"))), name="name", path="path", dictionary_title="dictionary_title", rule_title="rule_title", guide_title="guide_title", suggested="suggested", match_source="match_source", mtime="mtime")
    fixed = F.when(F.col("program_title") == "Show long title", "Show").otherwise(F.col("program_title"))
    source = F.when(F.col("program_title") == "Show long title", "file_name").otherwise(F.col("title_extraction_path"))
    return out.select("id", fixed.alias("program_title"), source.alias("source"), "air_date", "confidence", "needs_review", F.col("needs_review_reason").alias("reason"))


@query("""
select c_custkey, case when c_custkey % 3 = 0 then 'Given' when c_custkey % 3 = 1 then 'ドラマ' end as genre, case when c_mktsegment = 'BUILDING' then 'F' end as franchise, case when c_custkey % 2 = 0 then 'old' when c_custkey % 5 = 0 then 'unknown' else 'llm' end as first_source,
  case when c_custkey % 2 = 0 then 'x' else concat_ws(',', case when c_custkey % 3 = 1 then 'epg_genres' end, case when c_mktsegment = 'BUILDING' then 'franchise' end, case when c_custkey % 3 <> 2 then 'genre' end, 'program_title') end as fields from customer
""")
def backfilled_metadata(t: Tables) -> DataFrame:
    n = F.col("c_custkey")
    parts = F.array_compact(F.array(F.when(n % 3 == 0, '"genre":"Given"'), F.when(n % 3 == 1, '"epg_genres":[{"category":"x","subcategory":"国内ドラマ"}]'), F.when(n % 2 == 0, '"source_history":[{"source":"old","at":"1","fields":["x"]}]'), F.lit('"path":"p","empty":null')))
    md = t.customer.select("c_custkey", F.lit("D:\\x").alias("path"), F.when(n % 5 == 0, "").otherwise("llm").alias("source"), F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("data_json"), F.col("c_mktsegment").alias("program_title"))
    out = extract.backfill(md, [("F", ["BUILD"])], "now")
    entry = F.get(F.from_json(F.get_json_object("data_json", "$.source_history"), "array<struct<source:string,at:string,fields:array<string>>>"), F.lit(0))
    return out.select("c_custkey", F.get_json_object("data_json", "$.genre").alias("genre"), F.get_json_object("data_json", "$.franchise").alias("franchise"), entry["source"].alias("first_source"), F.array_join(entry["fields"], ",").alias("fields"))


@query(rf"""
with r as (select o_orderkey as id, case when o_custkey % 4 = 0 then 'Series' else concat('Show ', cast(o_custkey as varchar)) end as series, concat('Show ', cast(o_custkey as varchar)) as title, o_custkey from orders where o_orderkey % 3 = 0 and o_orderkey % 7 <> 0),
k as (select *, lower(replace(series, ' ', '_')) as key from r), p as (select *, {_sha(_URLS, "concat('program_key:', key)")} as h from k),
i as (select * exclude (h), {_UUID} as program_id from p), b as (select *, {_sha(_URLS, "concat('broadcast_fallback:', program_id, '::2024-01-0', cast(id % 2 + 1 as varchar), '::', '::Ch')")} as h from i)
select program_id, key as program_key, arg_max(title, lpad(cast(id as varchar), 12, '0')) as canonical_title, count(distinct {_UUID}) as n_broadcasts from b group by 1, 2
""")
def legacy_guides(t: Tables) -> DataFrame:
    """Guide data of metadata rows as programmes and broadcasts; rows without an object or a title are left out."""
    n, title = F.col("o_orderkey"), F.concat(F.lit("Show "), F.col("o_custkey").cast("string"))
    data = F.when(n % 7 == 0, F.when(n % 2 == 0, "[]").otherwise('{"official_title":" "}')).otherwise(F.to_json(F.struct(F.concat(title, F.lit("▽x")).alias("official_title"), F.concat(F.lit("2024-01-0"), (n % 2 + 1).cast("string")).alias("air_date"), F.lit("Ch").alias("broadcaster"), F.array(F.lit("a")).alias("annotations"))))
    md = t.orders.select(F.lpad(n.cast("string"), 12, "0").alias("path_id"), F.when(n % 3 == 0, catalog.GUIDE_SOURCE).otherwise("llm").alias("source"), data.alias("data_json"))
    aliases = t.customer.where("c_custkey % 4 = 0").select(X.program_key(F.concat(F.lit("Show "), F.col("c_custkey").cast("string"))).alias("alias"), F.lit("Series").alias("canonical"))
    programs, casts = ingest.legacy_guides(md, aliases, "now")
    n_casts = casts.groupBy("program_id").agg(F.count(F.lit(1)).alias("n_broadcasts"))
    return programs.join(n_casts, "program_id").select("program_id", "program_key", F.regexp_replace("canonical_title", "▽x$", "").alias("canonical_title"), "n_broadcasts")


@query("""
with l as (select o_orderkey as id, o_orderkey % 5 as n, strftime(o_orderdate, '%Y') as y, strftime(o_orderdate, '%m') as m from orders)
select id, case n when 0 then 'missing_metadata' when 1 then 'needs_review' when 2 then 'suspicious_program_title' end as skip_reason, case n when 3 then concat('E:\\f', cast(id as varchar), '.mp4') when 4 then concat('D:\\Lib\\Other\\', y, '\\', m, '\\f', cast(id as varchar), '.mp4') end as dst from l
""".replace("\\\\", "\\"))
def planned_moves(t: Tables) -> DataFrame:
    """A listing beside its metadata, validated and routed."""
    n, id_ = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    name = F.concat(F.lit("f"), id_, F.lit(".mp4"))
    listing = t.orders.select(id_.alias("path_id"), F.concat(F.when(n == 2, "C:\\by_program\\Show\\").otherwise("C:\\in\\"), name).alias("path"), name.alias("name"))
    title = F.when(n == 2, "Show and a long text").otherwise("Other")
    md = t.orders.where("o_orderkey % 5 <> 0").select(id_.alias("path_id"), F.lit("llm").alias("source"), F.when(n == 3, '{"epg_genres":[{"category":"A","subcategory":"b"}]}').otherwise("{}").alias("data_json"), title.alias("program_title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("air_date"), (n == 1).cast("int").alias("needs_review"))
    routes = moves.Routes("D:\\Lib\\", routes=(moves.Route("g", "E:", "flat", ("A - *",)),))
    return moves.move_plan(moves.plan_rows(listing, md), routes).select(F.col("path_id").cast("long").alias("id"), "skip_reason", "dst")


@query(r"""
select n_name, case n_nationkey % 7 when 6 then concat('D:\taken', n_name, '__dup2.ts') when 5 then '' when 3 then concat('D:\x\E:\', n_name) else concat(case n_nationkey % 7 when 2 then 'D:\taken' when 4 then 'D:\full' else 'D:\out\' end, n_name, '.ts') end as dst,
  case n_nationkey % 7 when 1 then 'src_not_found' when 3 then 'invalid_path_embedded_drive' when 4 then 'mkdir_failed: no room' when 5 then 'missing_src_or_dst' when 2 then case when n_nationkey < 14 then 'dst_exists' end end as error
from nation where n_nationkey % 7 <> 2 or n_nationkey < 14
""")
def applied_moves(t: Tables) -> DataFrame:
    """Moves made by a mover that is handed in: missing sources, taken destinations with and without a suffix, refused paths, and one that fails."""
    n = F.col("n_nationkey") % 7
    root = F.when(n.isin(2, 6), "D:\\taken").when(n == 4, "D:\\full").otherwise("D:\\out\\")
    dst = F.when(n == 3, F.concat(F.lit("D:\\x\\E:\\"), "n_name")).when(n == 5, "").otherwise(F.concat(root, "n_name", F.lit(".ts")))
    plan = t.nation.where("n_nationkey % 7 <> 2 or n_nationkey < 14").select(F.col("n_name").alias("path_id"), F.concat(F.when(n == 1, "D:\\none\\").otherwise("D:\\in\\"), "n_name").alias("src"), dst.alias("dst"), n.alias("n"))

    def exists(path: str) -> bool:
        return path.startswith("D:\\in") or (path.startswith("D:\\taken") and "__dup2" not in path)

    def move(src: str, dst: str) -> None:
        if dst.startswith("D:\\full"):
            raise OSError("mkdir_failed: no room")

    log = moves.apply_moves(plan.where("n <> 6"), move, exists).unionByName(moves.apply_moves(plan.where("n = 6"), move, exists, rename=True))
    return log.select(F.col("path_id").alias("n_name"), "dst", "error")


@query(r"""
with p as (select distinct lower(p_brand) as b, p_brand as w from part) select concat('D:\', b) as src, concat('D:\', w) as dst, case when w = 'Brand#11' then 'busy' end as error from p where b <> w
""")
def applied_renames(t: Tables) -> DataFrame:
    tail = F.concat(F.lit("\\"), F.col("p_partkey").cast("string"))
    rows = t.part.select(F.concat(F.lit("D:\\"), F.lower("p_brand"), tail).alias("now"), F.concat(F.lit("D:\\"), "p_brand", tail).alias("wanted"))

    def rename(src: str, dst: str) -> None:
        if dst == "D:\\Brand#11":
            raise OSError("busy")

    return t.spark.createDataFrame(moves.apply_renames(reconcile.case_renames(rows, "now", "wanted"), rename), "src string, dst string, error string")


@query("""
with l as (select n_name as path, n_name as name, length(n_name) as size from nation order by n_name limit 10)
select path, case when n_nationkey % 2 = 0 then 'existing' else 'new' end as status from l join nation on n_name = path
""")
def limited_scan(t: Tables) -> DataFrame:
    """A scan that stops after ten files looks at the first ten by path, before it meets the catalog."""
    row = t.nation.select("n_nationkey", F.col("n_name").alias("path"), F.col("n_name").alias("name"), F.length("n_name").cast("long").alias("size"))
    known = row.where("n_nationkey % 2 = 0").withColumn("path_id", F.col("n_nationkey").cast("string"))
    return reconcile.reconcile(row.drop("n_nationkey").withColumn("corrupt", F.lit(False)), known.select("path_id", "path", "name"), known.select("path_id", "size"), scan_limit=10).select("path", "status")


@query("""select p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name), '\\s+', '_', 'g'), '[<>:"/\\\\|?*]', '', 'g'), '_+', '_', 'g') as key from part""")
def sql_program_key(t: Tables) -> DataFrame:
    """The function that SQL text may call."""
    ingest.register_functions(t.spark)
    t.part.createOrReplaceTempView("tapewright_part")
    return t.spark.sql("select p_partkey, normalize_program_key(concat('　', p_name, ' ')) as key from tapewright_part")


@query("""
select p_partkey, case when p_partkey % 4 = 0 then 'First' when p_partkey % 4 = 1 then concat('Old ', p_brand) when p_partkey % 4 = 2 then 'Any' else concat('Old ', p_brand) end as title, cast(case when p_partkey % 4 in (0, 2) then 1 else 0 end as int) as human_reviewed from part
""")
def titles_by_pattern(t: Tables) -> DataFrame:
    """Instructions by path pattern: anchored ones, ones that begin with a wildcard, escaped wildcards, and case that doesn't matter."""
    n = F.col("p_partkey") % 4
    path = F.when(n == 0, F.concat(F.lit("D:\\LIB\\a_b\\"), "p_name")).when(n == 1, F.concat(F.lit("D:\\Lib\\axb\\"), "p_name")).when(n == 2, F.concat(F.lit("E:\\100%\\"), "p_name")).otherwise(F.concat(F.lit("F:\\"), "p_name"))
    rows = t.part.select("p_partkey", F.col("p_partkey").alias("path_id"), path.alias("path"), F.concat(F.lit("Old "), "p_brand").alias("program_title"), F.lit("llm").alias("source"), F.lit(0).alias("human_reviewed"), F.lit(1).alias("needs_review"))
    rules = t.spark.createDataFrame([("d:\\lib\\a~_b\\%", "First"), ("%\\100~%\\%", "Any"), ("e:\\100~%%", "Later"), ("g:\\%", "None")], "path_pattern string, new_title string")
    return moves.title_updates(rows, rules).select("p_partkey", F.col("program_title").alias("title"), "human_reviewed")


@query("""
select concat('r', cast(r_regionkey as varchar)) as run_id, case r_regionkey % 5 when 0 then 'plan_ready' when 1 then 'complete' when 2 then 'review_required' when 3 then 'failed' else 'plan_ready' end as phase,
  case r_regionkey % 5 when 0 then 'review_plan' when 2 then 'review_metadata' when 4 then 'review_plan' end as follow_up, case r_regionkey % 5 when 4 then 'blocking_gate' when 1 then 'wrong_phase' when 2 then 'wrong_phase' when 3 then 'wrong_phase' else 'ok' end as apply from region
""")
def run_lifecycle(t: Tables) -> DataFrame:
    """A run for each region: planned, applied, waiting for review, failed, and planned with an open gate; what follows, and whether its plan may be applied."""
    clock = iter(range(10_000))
    out = []
    with tempfile.TemporaryDirectory() as folder:
        plan = f"{folder}/plan.jsonl"
        with open(plan, "w") as f:
            f.write("{}\n")

        def dry_run(run: workflow.Run, options: dict) -> str:
            n = options["n"]
            run.register("plan", "source_root_move_plan", plan, "dry_run", "t")
            if n == 2:
                run.register("yaml", "metadata_review_yaml", plan, "dry_run", "t")
                run.open_gate("g", "metadata_review", ["yaml"], "t")
                run.advance("metadata_extracted", "t")
                return "review_required"
            if n == 3:
                raise RuntimeError("no")
            if n == 4:
                run.open_gate("g", "review", ["plan"], "t")
            return "plan_ready"

        services = api.Services(workflow.Store(f"{folder}/runs"), dry_run, lambda run, plan: True, lambda: str(next(clock)))
        for r in sorted(t.region.collect()):
            name = f"r{r.r_regionkey}"
            api.start(services, "source_root", name, n=r.r_regionkey % 5)
            if r.r_regionkey % 5 == 1:
                run = services.store.load(name)
                run.check_apply("plan", "source_root", "source_root_move_plan")
                run.advance("applied", "t")
                run.advance("complete", "t")
                services.store.save(run)
            run = services.store.load(name)
            try:
                run.check_apply("plan", "source_root", "source_root_move_plan")
                verdict = "ok"
            except workflow.WorkflowError as e:
                verdict = e.code
            out.append((name, run.phase, next((x["action"] for x in run.follow_ups()), None), verdict))
    return t.spark.createDataFrame(out, "run_id string, phase string, follow_up string, apply string")


@query("select e.user_id as path_id, max(event_id) as event_id, count(*) as n from events e group by 1")
def merged_last(t: Tables) -> DataFrame:
    """The last row of each key beside how many there were, as batches are reduced before a merge."""
    last = merge.last_wins(t.events.select(F.col("user_id").alias("path_id"), "event_id"), ["path_id"], "event_id")
    return last.join(t.events.groupBy(F.col("user_id").alias("path_id")).agg(F.count(F.lit(1)).alias("n")), "path_id")
