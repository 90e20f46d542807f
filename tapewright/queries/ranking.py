"""Duplicates, rebroadcasts and latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import values as V
from tapewright.operators import catalog, dedup, extract, merge, rebroadcast, reconcile, review
from tapewright.queries.base import Tables, query

BUCKETS = {"terrestrial": ["view", "click"], "bs_cs": ["purch ase"]}


@query("""
with c as (select doc_id, n_chars, concat(lang, '::sub::', source) as group_key, sha256(text) as h, case when length(text) > 0 then 1 else 0 end as ok from documents),
h as (select *, count(*) over (partition by h) as hn, row_number() over (partition by h order by ok desc, n_chars desc, doc_id) as hr from c),
p1 as (select doc_id, group_key, case when hr = 1 then 'keep' else 'drop' end as decision, 'hash_exact' as method from h where hn > 1),
m as (select *, count(*) over (partition by group_key) as gn, row_number() over (partition by group_key order by ok desc, n_chars desc, doc_id) as gr from h where hn = 1),
p2 as (select doc_id, group_key, case when gr = 1 then 'keep' else 'drop' end as decision, 'metadata' as method from m where gn > 1)
select *, decision = 'drop' and method = 'hash_exact' as auto_apply from (select * from p1 union all select * from p2)
""")
def two_phase_dedup(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars", F.concat_ws("::", "lang", F.lit("sub"), "source").alias("group_key"), F.sha2("text", 256).alias("h"), (F.length("text") > 0).cast("int").alias("ok"))
    return dedup.two_phase(rows, "h", "group_key", [F.desc("ok"), F.desc("n_chars"), F.asc("doc_id")], ["doc_id", "group_key"])


@query("""
select event_id, user_id, event_type, case when r = 1 then 'keep' else 'drop' end as decision, cast(n as bigint) as group_size from (
  select *, count(*) over (partition by user_id, event_type) as n,
    row_number() over (partition by user_id, event_type order by case when event_type <> 'error' then 1 else 0 end desc, value desc nulls last, ts desc, event_id) as r from events) where n > 1
""")
def choose_keep(t: Tables) -> DataFrame:
    rows = t.events.withColumn("ok", (F.col("event_type") != "error").cast("int"))
    return dedup.keep_best(rows, ["user_id", "event_type"], [F.desc("ok"), F.desc("value"), F.desc("ts"), F.asc("event_id")]).select("event_id", "user_id", "event_type", "decision", "group_size")


@query("""
with g as (select *, count(*) over (partition by user_id, event_type) as n from events), k as (select distinct user_id, event_type from g where n > 1 order by 1, 2 limit 25)
select event_id, g.user_id, g.event_type, case when row_number() over (partition by g.user_id, g.event_type order by value desc nulls last, event_id) = 1 then 'keep' else 'drop' end as decision
from g join k using (user_id, event_type)
""")
def first_groups(t: Tables) -> DataFrame:
    return dedup.keep_best(t.events, ["user_id", "event_type"], [F.desc("value"), F.asc("event_id")], 25).select("event_id", "user_id", "event_type", "decision")


@query("""
with b as (select event_id, user_id, value, case when event_type like '%view%' or event_type like '%click%' then 'terrestrial' when event_type like '%purchase%' then 'bs_cs' else 'unknown' end as bucket from events),
g as (select *, count(*) over (partition by user_id) as n, max(case when bucket = 'unknown' then 1 else 0 end) over (partition by user_id) as u, max(case when bucket <> 'unknown' then 1 else 0 end) over (partition by user_id) as k,
  row_number() over (partition by user_id, bucket order by value desc nulls last, event_id) as r from b)
select event_id, user_id, bucket, case when u = 1 and k = 1 then 'manual_review_required' when r = 1 then 'keep' else 'drop' end as decision from g where n > 1
""")
def dedup_bucket_policy(t: Tables) -> DataFrame:
    rows = t.events.withColumn("bucket", dedup.bucket_of(F.lit(None).cast("string"), [F.col("event_type")], BUCKETS))
    return dedup.bucket_policy(rows, "user_id", "bucket", [F.desc("value"), F.asc("event_id")]).select("event_id", "user_id", "bucket", "decision")


@query("""
with d as (select doc_id, source, lang, n_chars, coalesce(quality, 0) = 1 as e from documents left join (select doc_id, max(quality) as quality from labels group by 1) l using (doc_id)),
g as (select *, count(*) over (partition by source, lang) as n, sum(case when e then 1 else 0 end) over (partition by source, lang) as ne, row_number() over (partition by source, lang order by e desc, n_chars desc, doc_id) as r from d)
select doc_id, source, lang, case when ne < 2 or not e then 'manual_review_required' when r = 1 then 'keep' else 'drop' end as decision from g where n > 1
""")
def eligibility_dedup(t: Tables) -> DataFrame:
    marks = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = t.documents.select("doc_id", "source", "lang", "n_chars").join(marks, "doc_id", "left")
    return dedup.eligible_keep(rows, ["source", "lang"], F.coalesce(F.col("quality"), F.lit(0)) == 1, [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "source", "lang", "decision")


@query("""
with g as (select o_custkey, count(*) as n, count(distinct cast(o_orderdate as date)) as n_dates, count(distinct nullif(o_orderpriority, '')) as n_broadcasters from orders group by 1)
select concat('cust::', cast(o_custkey as varchar)) as episode_key, n, n_dates, n_broadcasters, substr(sha256(concat('cust::', cast(o_custkey as varchar))), 1, 16) as group_id
from g where n >= 2 and (n_dates > 1 or n_broadcasters > 1)
""")
def rebroadcast_groups(t: Tables) -> DataFrame:
    rows = t.orders.select(F.concat(F.lit("cust::"), F.col("o_custkey").cast("string")).alias("episode_key"), F.col("o_orderdate").cast("date").cast("string").alias("day"), "o_orderpriority")
    return rebroadcast.groups(rows, "episode_key", "day", "o_orderpriority")


@query("""
with f as (select l_orderkey, max(case when l_returnflag = 'R' then 1 else 0 end) as t, max(case when l_returnflag = 'A' then 1 else 0 end) as f from lineitem group by 1),
m as (select o_orderkey, o_custkey, case when t = 1 then true when f = 1 then false end as flag from orders left join f on l_orderkey = o_orderkey)
select o_orderkey, o_custkey, case when max(case when flag then 1 else 0 end) over (partition by o_custkey) = 1 then case when coalesce(flag, false) then 'rebroadcast' else 'original' end
  when max(case when flag is not null then 1 else 0 end) over (partition by o_custkey) = 1 then 'original' else 'unknown' end as broadcast_type from m
""")
def rebroadcast_types(t: Tables) -> DataFrame:
    flags = t.lineitem.withColumn("f", F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0)).groupBy("l_orderkey").agg(V.three_valued("f").alias("flag"))
    rows = t.orders.join(flags, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rebroadcast.classify(rows, "o_custkey", "flag").select("o_orderkey", "o_custkey", "broadcast_type")


@query("""
select l_orderkey, case when max(case when l_returnflag = 'R' then 1 else 0 end) = 1 then 'true' when max(case when l_returnflag = 'A' then 1 else 0 end) = 1 then 'false' else 'unknown' end as flag, max(l_linestatus) as broadcaster from lineitem group by 1
""")
def flag_tristate(t: Tables) -> DataFrame:
    links = t.lineitem.select(F.col("l_orderkey").alias("path_id"), F.monotonically_increasing_id().alias("broadcast_id"), F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).alias("is_rebroadcast_flag"), F.col("l_linestatus").alias("broadcaster"))
    out = links.groupBy("path_id").agg(V.three_valued("is_rebroadcast_flag").alias("f"), F.max("broadcaster").alias("broadcaster"))
    return out.select(F.col("path_id").alias("l_orderkey"), F.when(F.col("f"), "true").when(~F.col("f"), "false").otherwise("unknown").alias("flag"), "broadcaster")


@query("""
select p.p_partkey, case when max(case when l_returnflag = 'R' then 1 else 0 end) = 1 then true when max(case when l_returnflag = 'A' then 1 else 0 end) = 1 then false end as is_rebroadcast_flag, max(s_name) as broadcaster
from lineitem join part p on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by 1
""")
def flags_by_path(t: Tables) -> DataFrame:
    links = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_partkey").alias("path_id"), F.col("l_suppkey").alias("broadcast_id"), F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).alias("is_rebroadcast_flag"))
    casts = t.supplier.select(F.col("s_suppkey").alias("broadcast_id"), F.col("s_name").alias("broadcaster"))
    return rebroadcast.flags_by_path(links, casts).withColumnRenamed("path_id", "p_partkey")


@query("""
select o_custkey, arg_min(o_orderpriority, struct_pack(d := strftime(o_orderdate, '%Y-%m-%d'), k := o_orderkey)) as program_title from orders group by 1
""")
def rebroadcast_title(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return rebroadcast.group_titles(rows, "o_custkey", "o_orderpriority", "day", "o_orderkey")


@query("select event_id, user_id from (select *, rank() over (partition by user_id order by cast(ts as date) desc) as r from events) where r = 1")
def latest_with_ties(t: Tables) -> DataFrame:
    return catalog.latest(t.events.withColumn("day", F.to_date("ts")), ["user_id"], "day").select("event_id", "user_id")


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by ts desc, event_id) as r from events) where r = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return catalog.latest(t.events, ["user_id"], "ts", ["event_id"]).select("event_id", "user_id")


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by event_id) as r from events) where r = 1")
def first_wins(t: Tables) -> DataFrame:
    return merge.first_wins(t.events, ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type")


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as r from events) where r = 1")
def last_wins(t: Tables) -> DataFrame:
    return merge.last_wins(t.events, ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type")


@query("select event_id, event_type, cast(r as bigint) as place, case when r <= 10 then 'keep' else 'rotate' end as action from (select *, row_number() over (partition by event_type order by ts desc, event_id) as r from events)")
def keep_newest_n(t: Tables) -> DataFrame:
    return review.newest(t.events, "event_type", "ts", "event_id", 10).select("event_id", "event_type", F.col("place").cast("long").alias("place"), "action")


@query("select doc_id, cast((row_number() over (order by doc_id) - 1) // 50 + 1 as bigint) as batch from documents")
def batches(t: Tables) -> DataFrame:
    return extract.batches(t.documents.select("doc_id"), "doc_id", 50)


@query("""
with s as (select distinct source from documents where n_chars < 30)
select doc_id, source from documents where source not in (select source from s)
""")
def skipped_groups(t: Tables) -> DataFrame:
    plan = t.documents.select("doc_id", F.col("source").alias("group_key"))
    marks = t.documents.select(F.col("source").alias("group_key"), F.when(F.col("n_chars") < 30, "skip").otherwise("keep").alias("decision"))
    return dedup.skip_groups(plan, marks).select("doc_id", F.col("group_key").alias("source"))


@query("""
with g as (select sha256(text) as group_id, doc_id from documents), n as (select group_id, count(*) as n from g join labels using (doc_id) group by 1 having count(*) > 1)
select g.group_id, g.doc_id as path from g join labels using (doc_id) join n using (group_id)
""")
def hash_group_members(t: Tables) -> DataFrame:
    report = t.documents.select(F.sha2("text", 256).alias("group_id"), F.col("doc_id").alias("path"))
    return dedup.hash_groups(report, t.labels.select(F.col("doc_id").alias("path"))).select("group_id", "path")


@query("""
with d as (select doc_id, concat('D:\\\\lib\\\\', source, '\\\\doc', cast(doc_id % 50 as varchar), '.mp4') as dst from documents), n as (select *, row_number() over (partition by lower(dst) order by doc_id) - 1 as n from d)
select doc_id, case when n = 0 then dst else replace(dst, '.mp4', concat('__dup', cast(n as varchar), '.mp4')) end as dst from n
""".replace("\\\\", "\\"))
def unique_destinations(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.concat(F.lit("D:\\lib\\"), "source", F.lit("\\doc"), (F.col("doc_id") % 50).cast("string"), F.lit(".mp4")).alias("dst"))
    return dedup.unique_names(rows, "dst", ["doc_id"])


@query("select c_custkey, case when c_custkey % 7 = 0 then 1 else 0 end as first_of_case from customer where c_custkey % 7 = 0 or c_custkey % 7 > 3")
def first_path_of_case(t: Tables) -> DataFrame:
    name = F.when(F.col("c_custkey") % 7 < 4, F.concat(F.lit("Case"), F.floor(F.col("c_custkey") / 7).cast("string"))).otherwise(F.concat(F.lit("own"), F.col("c_custkey").cast("string")))
    rows = t.customer.withColumn("path", F.when(F.col("c_custkey") % 2 == 0, F.upper(name)).otherwise(name))
    return reconcile.first_per_path(rows, "path", "c_custkey").select("c_custkey", (F.col("c_custkey") % 7 == 0).cast("int").alias("first_of_case"))
