"""Joins, title resolution and the catalog's views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import keys as K
from tapewright.operators import catalog, extract, reconcile, resolve, views
from tapewright.queries.base import Tables, query


def _urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://[^/]*", "").alias("norm"))


URLS = "u as (select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', '') as norm from pages)"


@query(f"with {URLS}, d as (select distinct norm from u where length(norm) >= 4) select distinct a.norm from d a join d b on starts_with(b.norm, a.norm) and length(b.norm) > length(a.norm)")
def prefix_family(t: Tables) -> DataFrame:
    return resolve.prefix_family(_urls(t), "norm")


@query(f"""
with {URLS}, d as (select distinct norm from u), m as (select u.page_id, d.norm as title, row_number() over (partition by u.page_id order by length(d.norm) desc, d.norm) as r from u join d on starts_with(u.norm, d.norm) and length(u.norm) >= length(d.norm) + 2)
select page_id, title from m where r = 1
""")
def longest_prefix(t: Tables) -> DataFrame:
    u = _urls(t)
    return resolve.longest_prefix(u, "page_id", "norm", u.select("norm", F.col("norm").alias("title")).distinct(), extra=2)


@query(f"""
with {URLS}, e as (select norm, min(norm) as title from u where page_id % 5 = 0 group by 1), h as (select distinct norm from u where page_id % 3 = 0), p as (select distinct norm from u),
lh as (select page_id, h.norm as title, row_number() over (partition by page_id order by length(h.norm) desc, h.norm) as r from u join h on starts_with(u.norm, h.norm) and length(u.norm) >= length(h.norm) + 1),
lp as (select page_id, p.norm as title, row_number() over (partition by page_id order by length(p.norm) desc, p.norm) as r from u join p on starts_with(u.norm, p.norm) and length(u.norm) >= length(p.norm) + 1)
select u.page_id, coalesce(e.title, lh.title, lp.title) as suggested, case when e.title is not null then 'human_exact' when lh.title is not null then 'human' when lp.title is not null then 'programs' end as match_source
from u left join e using (norm) left join (select * from lh where r = 1) lh using (page_id) left join (select * from lp where r = 1) lp using (page_id)
""")
def resolve_titles(t: Tables) -> DataFrame:
    u = _urls(t)
    entries = lambda df: df.select("norm", F.col("norm").alias("title")).distinct()
    sources = [("human_exact", entries(u.where("page_id % 5 = 0"))), ("human", entries(u.where("page_id % 3 = 0"))), ("programs", entries(u))]
    return resolve.resolve(u, "page_id", "norm", sources, extra=1).select("page_id", "suggested", "match_source")


@query("""
with w as (select distinct split_part(p_name, ' ', 1) as title from part), d as (select doc_id, lower(coalesce(text, '')) as norm from documents),
m as (select doc_id, title, row_number() over (partition by doc_id order by length(title) desc, title) as r from d join w on length(title) >= 2 and contains(norm, lower(title)))
select doc_id, title from m where r = 1
""")
def contains_dictionary(t: Tables) -> DataFrame:
    words = t.part.select(F.split("p_name", " ")[0].alias("title")).distinct().select(F.lower("title").alias("norm"), "title")
    docs = t.documents.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("norm"))
    return resolve.longest_contained(docs, "doc_id", "norm", words)


@query("""
with d as (select 'k1' as kind, concat(cast(user_id as varchar), event_type) as key, min(event_id) as payload from events where event_id % 2 = 0 group by 2
  union all select 'k2', cast(user_id as varchar), min(event_id) from events where event_id % 3 = 0 group by 2 union all select 'k3', event_type, min(event_id) from events where event_id % 5 = 0 group by 2)
select event_id, coalesce(a.payload, b.payload, c.payload) as payload, case when a.payload is not null then 'k1' when b.payload is not null then 'k2' when c.payload is not null then 'k3' end as matched_by
from events e left join d a on a.kind = 'k1' and a.key = concat(cast(e.user_id as varchar), e.event_type) left join d b on b.kind = 'k2' and b.key = cast(e.user_id as varchar) left join d c on c.kind = 'k3' and c.key = e.event_type
""")
def lookup_cascade(t: Tables) -> DataFrame:
    keyed = t.events.select("event_id", F.concat(F.col("user_id").cast("string"), "event_type").alias("k1"), F.col("user_id").cast("string").alias("k2"), F.col("event_type").alias("k3"))
    parts = [keyed.where(F.col("event_id") % n == 0).select(F.lit(k).alias("kind"), F.col(k).alias("key"), F.col("event_id").alias("payload"), F.col("event_id").alias("at")) for n, k in ((2, "k1"), (3, "k2"), (5, "k3"))]
    return extract.cascade(keyed, ["k1", "k2", "k3"], parts[0].unionByName(parts[1]).unionByName(parts[2]), "payload", "at").select("event_id", "payload", "matched_by")


@query("""
with e as (select s_suppkey, s_nationkey, s_name from supplier), c as (select c.c_custkey, 0 as p, s_name as norm, s_suppkey from customer c join e on e.s_nationkey = c.c_nationkey where e.s_suppkey % 2 = 0
  union all select c.c_custkey, 1, s_name, s_suppkey from customer c join e on e.s_suppkey = c.c_custkey % 50),
o as (select *, row_number() over (partition by c_custkey, norm order by p, s_suppkey) as r from c)
select c_custkey, norm, cast(row_number() over (partition by c_custkey order by p, s_suppkey, norm) as bigint) as place from o where r = 1
""")
def candidate_union(t: Tables) -> DataFrame:
    ask = t.customer.select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"), (F.col("c_custkey") % 50).cast("string").alias("number"))
    a = t.supplier.where("s_suppkey % 2 = 0").select(F.lit("nation").alias("kind"), F.col("s_nationkey").cast("string").alias("key"), F.col("s_name").alias("norm"), "s_suppkey")
    b = t.supplier.select(F.lit("number").alias("kind"), F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("norm"), "s_suppkey")
    return extract.candidates(ask, "c_custkey", ["nation", "number"], a.unionByName(b), "norm", "s_suppkey").select("c_custkey", "norm", F.col("place").cast("long").alias("place"))


@query("""
select c_mktsegment as title, count(*) as n_rows, strftime(min(o_orderdate), '%Y-%m-%d') as first_date, strftime(max(o_orderdate), '%Y-%m-%d') as last_date,
  cast(sum(case when o_orderstatus = 'O' then 1 else 0 end) as bigint) as n_review, cast(sum(case when o_orderstatus = 'O' and o_orderpriority like '1%' then 1 else 0 end) as bigint) as n_human_review
from orders join customer on c_custkey = o_custkey group by 1
""")
def program_titles_view(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_mktsegment").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus", "o_orderpriority")
    return catalog.title_summary(rows, "title", "day", F.col("o_orderstatus") == "O", F.col("o_orderpriority").startswith("1"))


@query("select doc_id, source, quality from documents join labels using (doc_id) where toxic = 1")
def needs_review_view(t: Tables) -> DataFrame:
    return views.needs_review(t.labels, t.documents, "doc_id", "toxic").select("doc_id", "source", "quality")


@query("select event_id, e.user_id, c_name from events e join customer on c_custkey = e.user_id where event_type <> 'error'")
def metadata_with_paths(t: Tables) -> DataFrame:
    return views.metadata_with_paths(t.events, t.customer, ("user_id", "c_custkey"), "error", "event_type").select("event_id", "user_id", "c_name")


@query("select o_orderkey, l_partkey, l_quantity from orders join lineitem on l_orderkey = o_orderkey where l_quantity is not null and l_shipdate >= o_orderdate")
def programs_with_broadcasts(t: Tables) -> DataFrame:
    return views.programs_with_broadcasts(t.orders, t.lineitem, ("o_orderkey", "l_orderkey"), "l_quantity").where("l_shipdate >= o_orderdate").select("o_orderkey", "l_partkey", "l_quantity")


@query("select c_custkey, o_orderkey, n_name from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' left join nation on n_nationkey = c_nationkey")
def left_join_on_filter(t: Tables) -> DataFrame:
    closed = views.linked(t.customer, t.orders, {"c_custkey": "o_custkey"}, "o_orderstatus = 'F'", "left")
    return views.linked(closed, t.nation, {"c_nationkey": "n_nationkey"}, None, "left").select("c_custkey", "o_orderkey", "n_name")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey) and not exists (select 1 from events where user_id = c_custkey)")
def orphan_parents(t: Tables) -> DataFrame:
    return catalog.orphan_parents(t.customer.select("c_custkey"), "c_custkey", (t.orders, "o_custkey"), (t.events, "user_id"))


@query("select event_id, user_id from events where user_id not in (select c_custkey from customer)")
def orphan_rows(t: Tables) -> DataFrame:
    return catalog.orphans(t.events, "user_id", t.customer, "c_custkey").select("event_id", "user_id")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return catalog.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_ids(t: Tables) -> DataFrame:
    return views.among(t.orders, t.customer.where("c_mktsegment = 'BUILDING'"), "o_custkey", "c_custkey").select("o_orderkey", "o_totalprice")


@query("""
with p as (select distinct l_orderkey, l_partkey, l_suppkey from lineitem) select a.l_orderkey, a.l_partkey, a.l_suppkey as supp_a, b.l_suppkey as supp_b from p a join p b on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey and a.l_suppkey < b.l_suppkey
""")
def self_conflict(t: Tables) -> DataFrame:
    return views.conflicting_links(t.lineitem, ["l_orderkey", "l_partkey"], "l_suppkey").withColumnsRenamed({"l_suppkey": "supp_a", "other": "supp_b"})


@query("""
with o as (select p_brand, p_size, count(distinct p_partkey) as n_old, min(p_partkey) as old_id from part where p_partkey % 2 = 0 group by 1, 2)
select p_partkey, n_old, old_id, case when n_old = 1 then 'rename' else 'ambiguous' end as status from part join o using (p_brand, p_size) where p_partkey % 2 = 1
""")
def rename_detect(t: Tables) -> DataFrame:
    return reconcile.unique_matches(t.part.where("p_partkey % 2 = 0"), t.part.where("p_partkey % 2 = 1"), ["p_brand", "p_size"], "p_partkey").select("p_partkey", "n_old", "old_id", "status")


@query("""
with c as (select page_id as path_id, url as path, regexp_extract(url, '[^/]*$') as name, length(html) as size from pages where page_id % 2 = 0),
l as (select page_id, replace(case when page_id % 4 = 1 then replace(url, 'https://', 'http://') else url end, '.org', '.net') as path, regexp_extract(url, '[^/]*$') as name, length(html) as size from pages where page_id % 3 <> 0),
n as (select name, size, count(distinct path_id) as n, min(path_id) as id from c where path_id % 8 <> 0 group by 1, 2), p as (select path, min(path_id) as path_id from c group by 1)
select page_id, case when size < 3000 then 'corrupt' when p.path_id is not null then case when p.path_id % 8 <> 0 then 'existing' else 'missing_observation' end when r.path_id is not null then 'remapped' when n = 1 then 'renamed' when n > 1 then 'ambiguous' else 'new' end as status
from l left join p using (path) left join p r on r.path = replace(l.path, '.net', '.org') left join n using (name, size)
""")
def reconcile_listing(t: Tables) -> DataFrame:
    name, size = F.regexp_extract("url", "[^/]*$", 0), F.length("html").cast("long")
    base = t.pages.where("page_id % 2 = 0").select(F.col("page_id").alias("path_id"), F.col("url").alias("path"), name.alias("name"), size.alias("size"))
    observed = base.where("path_id % 8 <> 0").select("path_id", "size")
    secure = F.when(F.col("page_id") % 4 == 1, F.replace("url", F.lit("https://"), F.lit("http://"))).otherwise(F.col("url"))
    seen = t.pages.where("page_id % 3 <> 0").select("page_id", F.replace(secure, F.lit(".org"), F.lit(".net")).alias("path"), name.alias("name"), size.alias("size")).withColumn("corrupt", F.col("size") < 3000)
    return reconcile.reconcile(seen, resolve.one_per_key(base, "path", ["path_id"]).unionByName(base.join(resolve.one_per_key(base, "path", ["path_id"]).select("path_id"), "path_id", "left_anti").withColumn("path", F.lit(None).cast("string"))), observed, F.replace("path", F.lit(".net"), F.lit(".org"))).select("page_id", "status")


@query("select p_type, count(*) as n from part where length(p_type) <= 25 and p_type <> '' and not regexp_matches(p_type, '[#、。]$') group by 1 having count(*) >= 2")
def known_titles(t: Tables) -> DataFrame:
    return resolve.known_titles(t.part, "p_type")


@query("select p_brand, count(*) as n from part group by 1 order by n desc, p_brand limit 30")
def top_titles(t: Tables) -> DataFrame:
    return resolve.top_titles(t.part, "p_brand")


@query("select p_brand, array_to_string(list_sort(list(p_partkey)), ',') as ids, array_to_string(list_slice(list_sort(list(distinct p_type)), 1, 3), ',') as samples from part group by 1")
def title_samples(t: Tables) -> DataFrame:
    out = resolve.title_samples(t.part, "p_brand", "p_partkey", "p_type")
    return out.select("p_brand", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.array_join("sample_paths", ",").alias("samples"))


@query("select p_type, array_to_string(list_sort(list(distinct p_brand)), ',') as old_ids, count(distinct p_brand) as n_old, count(distinct p_brand) > 1 as merges from part group by 1")
def regroup_series(t: Tables) -> DataFrame:
    return resolve.regroup(t.part, "p_brand", "p_type").withColumn("old_ids", F.array_join("old_ids", ","))


@query("select p_brand as alias, count(distinct p_type) as n from part group by 1 having count(distinct p_type) > 1")
def alias_conflicts(t: Tables) -> DataFrame:
    return resolve.alias_conflicts(t.part.select(F.col("p_brand").alias("alias"), F.col("p_type").alias("canonical")))


@query("select distinct o_custkey from orders where o_orderstatus = 'F' except select user_id from events")
def set_difference(t: Tables) -> DataFrame:
    return views.difference(t.orders.where("o_orderstatus = 'F'"), t.events, "o_custkey", "user_id")


@query("select o_custkey, substr(sha256(string_agg(cast(o_orderkey as varchar), chr(10) order by cast(o_orderkey as varchar))), 1, 16) as cohort from orders group by 1")
def id_set_hash(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(K.set_hash(F.col("o_orderkey").cast("string")).alias("cohort"))
