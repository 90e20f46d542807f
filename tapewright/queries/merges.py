"""Upserts, provenance, applied moves and constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import values as V
from tapewright.operators import catalog, merge, reconcile, views
from tapewright.queries.base import Tables, query
from tapewright.streaming import ingest


def _meta(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Catalogued and incoming metadata out of customers: every third is human-reviewed; the batch has every second and some new ones."""
    base = t.customer.select("c_custkey", F.col("c_name").alias("program_title"), F.when(F.col("c_custkey") % 3 == 0, "human_reviewed").otherwise("llm").alias("source"), (F.col("c_custkey") % 3 == 0).cast("int").alias("human_reviewed"))
    new = t.customer.where("c_custkey % 2 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 10 == 0, 1_000_000).otherwise(0)).alias("c_custkey"), F.upper("c_mktsegment").alias("program_title"), F.when(F.col("c_custkey") % 4 == 0, "human_reviewed").otherwise("llm").alias("source"), F.lit(0).alias("human_reviewed"))
    return base, new


_META = """
o as (select c_custkey, c_name as program_title, case when c_custkey % 3 = 0 then 'human_reviewed' else 'llm' end as source, case when c_custkey % 3 = 0 then 1 else 0 end as human_reviewed from customer),
n as (select c_custkey + case when c_custkey % 10 = 0 then 1000000 else 0 end as c_custkey, upper(c_mktsegment) as program_title, case when c_custkey % 4 = 0 then 'human_reviewed' else 'llm' end as source, 0 as human_reviewed from customer where c_custkey % 2 = 0)
"""
_UPSERT = """
with {meta} select coalesce(o.c_custkey, n.c_custkey) as c_custkey, case when {take} then n.program_title else o.program_title end as program_title, case when {take} then n.source else o.source end as source,
  cast(case when {take} then n.human_reviewed else o.human_reviewed end as int) as human_reviewed from o full join n using (c_custkey)
"""


@query(_UPSERT.format(meta=_META, take="o.c_custkey is null or (n.c_custkey is not null and (o.human_reviewed = 0 or n.source = 'human_reviewed'))"))
def guarded_upsert(t: Tables) -> DataFrame:
    return merge.upsert(*_meta(t), ["c_custkey"], guard=merge.reviewed_guard)


@query(_UPSERT.format(meta=_META, take="o.c_custkey is null or (n.c_custkey is not null and o.human_reviewed = 0)"))
def strict_upsert(t: Tables) -> DataFrame:
    return merge.upsert(*_meta(t), ["c_custkey"], guard=merge.strict_guard)


@query(f"with {_META} select o.c_custkey, o.program_title from o join n using (c_custkey) where o.human_reviewed = 1")
def protected_rows(t: Tables) -> DataFrame:
    return merge.protected(*_meta(t), ["c_custkey"]).select("c_custkey", "program_title")


@query(f"with {_META} select c_custkey, program_title from o union all select c_custkey, program_title from n where c_custkey not in (select c_custkey from o)")
def upsert_insert_only(t: Tables) -> DataFrame:
    return merge.insert_new(*_meta(t), ["c_custkey"]).select("c_custkey", "program_title")


@query("""
with a as (select l_orderkey, l_partkey, cast(max(l_linenumber % 2) as int) as is_current, min(l_shipdate) as first_seen, max(l_shipdate) as last_seen from lineitem where l_suppkey % 2 = 0 group by 1, 2),
b as (select l_orderkey, l_partkey, cast(max(l_linenumber % 2) as int) as is_current, min(l_shipdate) as first_seen, max(l_shipdate) as last_seen from lineitem where l_suppkey % 3 = 0 group by 1, 2)
select l_orderkey, l_partkey, greatest(a.is_current, b.is_current) as is_current, coalesce(a.first_seen, b.first_seen) as first_seen, coalesce(b.last_seen, a.last_seen) as last_seen from a full join b using (l_orderkey, l_partkey)
""")
def merge_flags(t: Tables) -> DataFrame:
    seen = lambda c: t.lineitem.where(c).groupBy("l_orderkey", "l_partkey").agg(F.max(F.col("l_linenumber") % 2).cast("int").alias("is_current"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))
    return merge.upsert(seen("l_suppkey % 2 = 0"), seen("l_suppkey % 3 = 0"), ["l_orderkey", "l_partkey"], {"is_current": merge.greatest, "first_seen": merge.keep_old, "last_seen": merge.keep_new})


@query("""
with o as (select o_orderkey, o_orderstatus as status, o_orderpriority as priority from orders), n as (select o_orderkey, case when o_orderkey % 3 = 0 then 'X' end as status, o_orderpriority as priority from orders where o_orderkey % 2 = 0)
select o.o_orderkey, coalesce(n.status, o.status) as status, case when n.o_orderkey is null then '' when n.status is not null and n.status is distinct from o.status then 'old,llm:status' else 'old,llm:' end as history from o left join n using (o_orderkey)
""")
def provenance_merge(t: Tables) -> DataFrame:
    old = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    new = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "X").alias("ns"), F.col("o_orderpriority").alias("np"))
    both = old.join(new, "o_orderkey", "left")
    changed = merge.changed_fields({"status": (F.col("status"), F.col("ns")), "priority": (F.col("priority"), F.col("np"))})
    first = F.array(F.struct(F.lit("old").alias("source"), F.lit("t0").alias("at"), F.array().cast("array<string>").alias("fields")))
    history = merge.add_history(first, F.lit("llm"), F.lit("t1"), changed)
    text = F.array_join(F.transform(history, lambda h: F.concat(h["source"], F.when(h["at"] == "t1", F.concat(F.lit(":"), F.array_join(h["fields"], "+"))).otherwise(""))), ",")
    return both.select("o_orderkey", F.coalesce("ns", "status").alias("status"), F.when(F.col("np").isNotNull(), text).otherwise("").alias("history"))


@query("""
with d as (select o_orderkey as path_id, o_orderstatus as title, cast(case when o_orderkey % 4 = 0 then 1 else 0 end as int) as human_reviewed, strftime(o_orderdate, '%Y-%m-%d') as updated_at from orders where o_orderkey % 2 = 0),
s as (select o_orderkey as path_id, o_orderpriority as title, cast(case when o_orderkey % 6 = 0 then 1 else 0 end as int) as human_reviewed, strftime(o_orderdate + interval 1 day * (o_orderkey % 3 - 1), '%Y-%m-%d') as updated_at from orders where o_orderkey % 3 = 0),
b as (select coalesce(d.path_id, s.path_id) as path_id, d, s, d.path_id is null or (s.path_id is not null and (s.human_reviewed > d.human_reviewed or (s.human_reviewed = d.human_reviewed and s.updated_at > d.updated_at))) as f from d full join s on d.path_id = s.path_id)
select path_id, case when f then s.title else d.title end as title, case when f then s.human_reviewed else d.human_reviewed end as human_reviewed, case when f then s.updated_at else d.updated_at end as updated_at from b
""")
def metadata_collision(t: Tables) -> DataFrame:
    row = lambda title, n, day: [F.col("o_orderkey").alias("path_id"), F.col(title).alias("title"), (F.col("o_orderkey") % n == 0).cast("int").alias("human_reviewed"), F.date_format(day, "yyyy-MM-dd").alias("updated_at")]
    dst = t.orders.where("o_orderkey % 2 = 0").select(*row("o_orderstatus", 4, F.col("o_orderdate")))
    src = t.orders.where("o_orderkey % 3 = 0").select(*row("o_orderpriority", 6, F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 3 - 1).cast("int"))))
    return merge.merge_on_collision(src, dst, "path_id")


@query("""
with m as (select l_orderkey, p_brand as program, l_suppkey as broadcast from lineitem join part on p_partkey = l_partkey) select l_orderkey, program, max(broadcast) as broadcast from m group by 1, 2
""")
def program_remap(t: Tables) -> DataFrame:
    links = t.lineitem.select("l_orderkey", F.col("l_partkey").cast("string").alias("program"), F.col("l_suppkey").alias("broadcast"))
    mapping = t.part.select(F.col("p_partkey").cast("string").alias("old"), F.col("p_brand").alias("new"))
    return merge.remap_keys(links, mapping, "program", ["l_orderkey", "program"], "broadcast")


_MOVES = """
c as (select page_id as path_id, concat('D:/', cast(page_id % 40 as varchar), '/', cast(page_id as varchar)) as path from pages where page_id % 5 <> 0),
m as (select page_id as path_id, concat('D:/', cast(case when page_id % 3 = 0 then page_id % 40 else (page_id + 1) % 40 end as varchar), '/', cast(case when page_id % 7 = 0 then page_id + 1 else page_id end as varchar)) as dst from pages)
"""


def _moves(t: Tables) -> tuple[DataFrame, DataFrame]:
    path = lambda folder, name: F.concat_ws("/", F.lit("D:"), folder.cast("string"), name.cast("string"))
    p = F.col("page_id")
    cat = t.pages.where("page_id % 5 <> 0").select(p.alias("path_id"), path(p % 40, p).alias("path"))
    moves = t.pages.select(p.alias("path_id"), path(F.when(p % 3 == 0, p % 40).otherwise((p + 1) % 40), F.when(p % 7 == 0, p + 1).otherwise(p)).alias("dst"))
    return moves, cat


@query(f"""
with {_MOVES} select m.path_id, m.dst, case when a.path = m.dst then 'already_applied' when a.path is null and b.path_id is not null then 'at_destination' when a.path is null then 'missing_src' when b.path_id is not null then 'merged_into_existing' else 'updated' end as outcome
from m left join c a on a.path_id = m.path_id left join c b on b.path = m.dst
""")
def move_reconcile(t: Tables) -> DataFrame:
    return reconcile.classify_moves(*_moves(t)).select("path_id", "dst", "outcome")


@query(f"""
with {_MOVES} select count(*) as n_moves, count(*) filter (a.path <> m.dst and b.path_id is not null) as n_collisions, count(*) filter (a.path is null and b.path_id is null) as n_missing
from m left join c a on a.path_id = m.path_id left join c b on b.path = m.dst
""")
def move_collisions(t: Tables) -> DataFrame:
    return reconcile.collisions(*_moves(t))


@query("select event_id, case when user_id % 4 = 0 then user_id + 1 else user_id end as user_id from events")
def repoint_ids(t: Tables) -> DataFrame:
    mapping = t.customer.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1).alias("new"))
    zero = t.spark.createDataFrame([(0, 1)], "old long, new long").join(mapping.withColumnRenamed("new", "_x"), "old", "left_anti")
    known = mapping.unionByName(zero)
    ids = t.events.select("event_id", "user_id")
    rest = ids.where("user_id % 4 = 0").join(known.select(F.col("old").alias("user_id")), "user_id", "left_anti").select(F.col("user_id").alias("old"), (F.col("user_id") + 1).alias("new")).distinct()
    return reconcile.repoint(ids, known.unionByName(rest), "user_id").select("event_id", "user_id")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_promote(t: Tables) -> DataFrame:
    return catalog.promote(t.events.select("event_id", F.col("props").alias("data_json")), ["k"]).select("event_id", F.col("k").cast("long").alias("k"))


@query("select event_id, coalesce(case when event_id % 2 = 0 then 'col' end, json_extract_string(props, '$.k')) as k from events")
def json_reconstruct(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("event_id") % 2 == 0, "col").alias("k"), F.col("props").alias("data_json"))
    return catalog.reconstruct(rows, ["k"]).select("event_id", "k")


@query("""select event_id, concat('{"k":', json_extract_string(props, '$.k'), ',"needs_review":"false"}') as data_json from events""")
def json_set_key(t: Tables) -> DataFrame:
    return t.events.select("event_id", catalog.json_set(F.col("props"), {"needs_review": F.lit("false")}, ["reason"]).alias("data_json"))


@query("select event_id, case when event_type = 'view' then 'rule_based' else event_type end as source from events")
def rename_sources(t: Tables) -> DataFrame:
    return catalog.rename_sources(t.events.select("event_id", F.col("event_type").alias("source")), "view", "rule_based")


@query("""
with s as (select user_id, event_id, event_type as after, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
select user_id, event_id, before, after from s where before is not null and not ((before, after) in (select * from (values ('view', 'click'), ('click', 'purchase'), ('view', 'view'))))
""")
def transition_check(t: Tables) -> DataFrame:
    allowed = t.spark.createDataFrame([("view", "click"), ("click", "purchase"), ("view", "view")], "before string, after string")
    log = t.events.withColumn("at", F.struct("ts", "event_id"))
    return ingest.illegal_transitions(log, "user_id", "at", "event_type", allowed).select("user_id", "event_id", "before", "after")


@query("select l_orderkey, count(*) filter (l_tax > 0.04) as n from lineitem where l_returnflag = 'R' group by 1")
def filtered_count(t: Tables) -> DataFrame:
    return views.counted(t.lineitem.where("l_returnflag = 'R'"), ["l_orderkey"], F.col("l_tax") > 0.04)


@query("select event_id, json_extract_string(props, '$.k') as k, case when try_cast(json_extract_string(props, '$.k') as double) is not null then try_cast(json_extract_string(props, '$.k') as double) <> 0 end as flag from events")
def json_flag(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), V.json_flag(F.col("props"), "k").alias("flag"))
