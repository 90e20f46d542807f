"""Text, date and JSON functions over texts that are put together from the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import dates as D
from tapewright.functions import text as X
from tapewright.functions import values as V
from tapewright.operators import reconcile
from tapewright.plans import moves
from tapewright.queries.base import Tables, query
from tapewright.sources import guide

ASCII, WIDE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ ", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ　"


@query("select p_partkey, concat(lower(p_name), ' ss ', lower(p_type)) as form from part")
def text_casefold(t: Tables) -> DataFrame:
    """Names in full-width capitals, with a letter that folds to two."""
    return t.part.select("p_partkey", X.casefold(F.concat(F.lit(" "), F.translate(F.upper("p_name"), ASCII, WIDE), F.lit("　ß "), F.translate(F.upper("p_type"), ASCII, WIDE))).alias("form"))


@query(r"select doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) as spaced, length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) as n from documents")
def text_single_spaces(t: Tables) -> DataFrame:
    """Whole documents with single spaces."""
    return t.documents.select("doc_id", X.single_spaces(F.col("text")).alias("x")).select("doc_id", F.sha2("x", 256).alias("spaced"), F.length("x").cast("long").alias("n"))


@query("""
with x as (select p_partkey, concat(p_name, '「', repeat(p_type, cast(p_size % 30 as int)), case when p_size % 4 = 0 then '' else '」' end) as base from part)
select p_partkey, nullif(regexp_extract(base, '「([^」]{1,120})」', 1), '') as subtitle from x
""")
def text_quoted_subtitle(t: Tables) -> DataFrame:
    base = F.concat("p_name", F.lit("「"), F.expr("repeat(p_type, p_size % 30)"), F.when(F.col("p_size") % 4 == 0, "").otherwise("」"))
    return t.part.select("p_partkey", X.quoted_subtitle(base).alias("subtitle"))


@query("""
select p_partkey, case p_size % 5 when 0 then 'NHK地域局発' when 1 then p_type when 2 then split_part(split_part(p_name, ' ', 1), '_', 1) when 3 then split_part(p_name, ' ', 1) else 'アナザーストーリーズ' end as program,
  case p_size % 5 when 0 then p_name when 1 then p_brand when 2 then null when 3 then p_brand else p_name end as subtitle from part
""")
def text_program_and_subtitle(t: Tables) -> DataFrame:
    n, lit = F.col("p_size") % 5, F.lit
    base = (
        F.when(n == 0, F.concat(lit("【NHK地域局発】_"), "p_name", lit("_"))).when(n == 1, F.concat(lit("「"), "p_type", lit("」残り「"), "p_brand", lit("」"))).when(n == 2, F.concat("p_name", lit("_"), "p_type"))
        .when(n == 3, F.concat(lit("【再】"), "p_name", lit("「"), "p_brand", lit("」"))).otherwise(F.concat(lit("アナザーストーリーズ選_"), "p_name", lit("▼"), "p_type"))
    )
    both = X.program_and_subtitle(base)
    return t.part.select("p_partkey", both["program"].alias("program"), both["subtitle"].alias("subtitle"))


@query("select p_partkey, case when p_size % 3 = 0 then concat(p_name, p_type) else p_name end as rest from part")
def text_drop_labels(t: Tables) -> DataFrame:
    x = F.concat(F.lit("_ 名作選-"), "p_name", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("選"), "p_type")).otherwise("傑作選"), F.lit(" _"))
    return t.part.select("p_partkey", X.drop_labels(x).alias("rest"))


@query(r"with x as (select p_partkey, case when p_size % 4 = 0 then p_name else concat('a ', p_name, '_', cast(p_size as varchar), '.mp4') end as base from part) select p_partkey, case when regexp_matches(base, '(\w+)_(\d+)') then concat(regexp_extract(base, '(\w+)_(\d+)', 2), ' of $', regexp_extract(base, '(\w+)_(\d+)', 1)) end as title from x")
def text_expand_rule(t: Tables) -> DataFrame:
    base = F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(F.concat(F.lit("a "), "p_name", F.lit("_"), F.col("p_size").cast("string"), F.lit(".mp4")))
    return t.part.select("p_partkey", X.expand_rule(base, r"(\w+)_(\d+)", r"\2 of $\1").alias("title"))


@query(r"""
with x as (select p_partkey, concat('[', p_type, ']', p_name, case when p_size % 3 = 0 then '[再]' else '[' end, ' ', p_brand, ' ') as line from part)
select p_partkey, trim(regexp_replace(line, '\[[^\]]*\]', '', 'g')) as title, array_to_string(regexp_extract_all(line, '\[([^\]]*)\]', 1), ',') as annotations, list_contains(regexp_extract_all(line, '\[([^\]]*)\]', 1), '再') as again from x
""")
def text_title_line(t: Tables) -> DataFrame:
    line = guide.title_line(F.concat(F.lit("["), "p_type", F.lit("]"), "p_name", F.when(F.col("p_size") % 3 == 0, "[再]").otherwise("["), F.lit(" "), "p_brand", F.lit(" ")))
    return t.part.select("p_partkey", line["official_title"].alias("title"), F.array_join(line["annotations"], ",").alias("annotations"), line["is_rebroadcast_flag"].alias("again"))


@query("select p_partkey, concat('EventID=', cast(p_size as varchar), case when p_size % 3 = 0 then '' else concat(',OriginalNetworkID=', cast(p_partkey as varchar)) end, ',ServiceID=', cast(p_partkey * 7 as varchar)) as ids from part")
def text_network_ids(t: Tables) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    lines = F.array(F.concat(F.lit(" ServiceID:"), (F.col("p_partkey") * 7).cast("string"), F.lit("(0x1)")), F.col("p_name"), F.concat(F.lit("EventID:"), text("p_size")), F.concat(F.when(F.col("p_size") % 3 == 0, "NetworkID:").otherwise("OriginalNetworkID:"), text("p_partkey")), F.lit("ServiceID:x"))
    entries = F.array_sort(F.transform(F.map_entries(guide.network_ids(lines)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return t.part.select("p_partkey", F.array_join(entries, ",").alias("ids"))


@query("""
select o_orderkey, case when o_custkey % 5 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end as air_date, case when o_custkey % 4 = 1 then concat(strftime(o_orderdate, '%Y-%m-%d'), ' 21:', lpad(cast(o_custkey % 60 as varchar), 2, '0')) end as recorded,
  case when o_custkey % 5 = 0 then concat(o_orderpriority, ' ', strftime(o_orderdate, '%Y_%m_%d')) else o_orderpriority end as stem from orders
""")
def text_dates(t: Tables) -> DataFrame:
    """File names with the order's date in many forms, and stems that end with the time of a recording."""
    date, n = lambda p: F.date_format("o_orderdate", p), F.col("o_custkey")
    stamp = F.when(n % 5 == 0, date("yyyy_MM_dd")).when(n % 5 == 1, date("yyyy_MM_dd_HH_mm")).when(n % 5 == 2, date("yyyy MM dd HH mm")).when(n % 5 == 3, F.concat(date("yyyy_MM_dd_HH_mm"), F.lit("_(1)"))).otherwise(date("yyyyMMddHHmm"))
    name = F.concat("o_orderpriority", F.lit(" "), stamp, F.lit(".mp4"))
    minutes = F.lpad((n % 60).cast("string"), 2, "0")
    stem = F.when(n % 4 == 1, F.concat_ws(" ", "o_orderpriority", date("yyyy MM dd"), F.lit("21"), minutes)).when(n % 4 == 2, F.concat_ws("-", date("yyyy-MM-dd"), F.lit("21"), minutes)).otherwise(date("yyyy MM dd"))
    return t.orders.select("o_orderkey", D.file_air_date(name).alias("air_date"), D.recording_time(stem).alias("recorded"), X.strip_date_suffix(name).alias("stem"))


@query("""
select event_id, case event_id % 4 when 0 then props when 3 then concat(' ', props) else '{}' end as object, case event_id % 4 when 1 then null when 2 then null else props end as last,
  concat('{"a":', cast(event_id as varchar), ',"b":"', event_type, '","c":{"x":', cast(user_id as varchar), ',"y":[null,true]}}') as stable, array_to_string(list_filter([event_type, '', ' ', cast(user_id as varchar)], lambda x: trim(x) <> ''), '|') as parts from events
""")
def text_json(t: Tables) -> DataFrame:
    """Objects, arrays and broken texts made of events' properties; the last object of an output; objects with sorted keys; texts that aren't blank."""
    n, props = F.col("event_id") % 4, F.col("props")
    given = F.when(n == 0, props).when(n == 1, F.concat(F.lit("["), props, F.lit("]"))).when(n == 2, F.substring(props, 1, 5)).otherwise(F.concat(F.lit(" "), props))
    output = F.concat(F.lit("start {\n"), F.when(n == 1, "[1]").when(n == 2, "{x").otherwise(F.concat(F.lit('{"k": 0}\r\n '), props)), F.lit("\n\nend"))
    loose = F.concat(F.lit('{"c": {"y": [null, true], "x": '), F.col("user_id").cast("string"), F.lit('}, "b" : "'), "event_type", F.lit('",\n"a":'), F.col("event_id").cast("string"), F.lit("}"))
    parts = F.array_join(V.some_text(F.array("event_type", F.lit(""), F.lit(None).cast("string"), F.lit(" "), F.col("user_id").cast("string"))), "|")
    return t.events.select("event_id", V.json_object(given).alias("object"), V.last_json_object(output).alias("last"), V.stable_json(V.json_fields(loose)).alias("stable"), parts.alias("parts"))


@query(r"""
select p_partkey, case when contains(p_name, 'small') or contains(p_name, 'red') then 'First' when contains(p_name, 'ring') then 'Rings' when p_size % 2 = 0 then concat('シリーズ_', p_brand) end as franchise from part
""")
def text_franchise(t: Tables) -> DataFrame:
    """Series by the first rule with a pattern in the name, else by the folder that a series has."""
    path = F.concat(F.lit("D:\\f\\"), F.when(F.col("p_size") % 2 == 0, "シリーズ_").otherwise(""), "p_brand", F.lit("\\x"))
    return t.part.select("p_partkey", moves.franchise(F.col("p_name"), path, [("First", ["small", "", "red"]), ("Rings", ["ring"])]).alias("franchise"))


@query(r"""
with p as (select distinct p_brand, p_type from part where p_size % 2 = 0)
select 'D:\Lib' as src, 'D:\lib' as dst, 2 as depth union all select distinct concat('D:\lib\', p_brand), concat('D:\lib\', upper(p_brand)), 3 from p
union all select concat('D:\lib\', upper(p_brand), '\', p_type), concat('D:\lib\', upper(p_brand), '\', lower(p_type)), 4 from p
""")
def text_case_renames(t: Tables) -> DataFrame:
    """Folders whose names differ from the wanted ones in case alone, parents first; files' own names and folders of other names don't count."""
    wanted = F.concat(F.lit("D:\\lib\\"), F.upper("p_brand"), F.lit("\\"), F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).otherwise("other"), F.lit("\\"), "p_name")
    rows = t.part.select(F.concat(F.lit("D:\\Lib\\"), "p_brand", F.lit("\\"), "p_type", F.lit("\\"), F.upper("p_name")).alias("path"), wanted.alias("wanted"))
    return reconcile.case_renames(rows, "path", "wanted")


@query(r"select page_id, starts_with(lower(concat(case page_id % 3 when 0 then 'd:|LIB|' when 1 then 'D:|Library|' else 'E:|lib|' end, url)), 'd:|lib|') as below from pages")
def text_under_roots(t: Tables) -> DataFrame:
    """Paths below some roots: a root's name that goes on is another folder."""
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "d:\\LIB\\").when(F.col("page_id") % 3 == 1, "D:\\Library\\").otherwise("E:\\lib\\"), F.replace("url", F.lit("/"), F.lit("\\")))
    return t.pages.select("page_id", reconcile.under_roots(path, ["D:\\lib\\", "q:"]).alias("below"))
