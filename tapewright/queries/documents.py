"""Rule files, review documents, manifests, logs and reports that are made from the tables, and plan functions over their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.operators import dedup, merge, reconcile, review
from tapewright.plans import bucketed, moves, reviews, runs
from tapewright.queries.base import Tables, query
from tapewright.sources import files, jsonl, rules, scratch


def _text_of(rows: DataFrame, key: str, order: Column, item: Column, head: str) -> DataFrame:
    """(key, text): a rule file for each key, its items in order."""
    items = F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("i"))))
    return rows.groupBy(key).agg(items.alias("x")).select(key, F.concat(F.lit(head), F.array_join("x.i", "")).alias("text"))


@query("""
select lower(p_type) as alias, arg_max(p_brand, cast(substr(p_brand, 7) as int)) as title from part group by 1
union all select lower(p_brand), p_brand from part group by 1, 2
""")
def hint_table(t: Tables) -> DataFrame:
    """A file of hints for each brand, with the types it has as aliases, in spaces and capitals: the last file that has an alias wins."""
    pairs = t.part.select("p_brand", "p_type").distinct()
    hint = F.concat(F.lit('  - "\u00a0 '), "p_type", F.lit('  "\n'))
    texts = _text_of(pairs, "p_brand", F.col("p_type"), hint, "\n  aliases:\n").select(F.substring("p_brand", 7, 9).cast("int").alias("file"), F.concat(F.lit("\ufeffhints:\n- canonical_title: '"), "p_brand", F.lit("'"), "text").alias("text"))
    return rules.alias_table(rules.rows(texts))


@query("select p_type as title, concat('^', p_name) as regex, case when p_size % 2 = 0 then 'base' else 'path' end as field from part where p_size % 5 <> 0 group by all")
def rule_rows(t: Tables) -> DataFrame:
    """A file of rules for each type; some are off, some don't say what they look at."""
    item = F.concat(F.lit("- match: {regex: '^"), "p_name", F.lit("'"), F.when(F.col("p_size") % 2 == 1, ", field: path").otherwise(""), F.lit("}\n  set: {program_title: '"), "p_type", F.lit("'}\n"), F.when(F.col("p_size") % 5 == 0, "  enabled: false\n").otherwise(""))
    texts = _text_of(t.part, "p_type", F.col("p_partkey"), item, "rules:\n").select(F.lit(0).alias("file"), "text")
    return rules.rule_table(rules.rows(texts)).select("title", "regex", "field").distinct()


@query("select p_brand as franchise, count(distinct p_name) as n_patterns, min(p_name) as least from part group by 1")
def franchise_table(t: Tables) -> DataFrame:
    """Series rules of each brand, its names as patterns, among others that say nothing."""
    item = F.concat(F.lit("  - '"), "p_name", F.lit("'\n  - 5\n"))
    texts = _text_of(t.part, "p_brand", F.col("p_name"), item, "").select(F.lit(0).alias("file"), F.concat(F.lit("rules:\n- franchise: '"), "p_brand", F.lit("'\n  title_patterns:\n"), "text", F.lit("- franchise: 3\n  title_patterns: [x]\n- franchise: y\n")).alias("text"))
    return rules.franchise_table(rules.rows(texts)).groupBy("franchise").agg(F.countDistinct("pattern").alias("n_patterns"), F.min("pattern").alias("least"))


@query("select p_brand, concat(p_type, '_keywords') as key, p_name as item, cast(row_number() over (partition by p_brand, p_type order by p_partkey) as int) as place from part where p_size % 7 <> 0")
def keyword_lists(t: Tables) -> DataFrame:
    """Lists without a YAML reader: a file for each brand with a list for each type, comments, blank lines and quotes."""
    item = F.concat(F.when(F.col("p_size") % 7 == 0, "# - ").otherwise(" -  "), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).otherwise(F.concat("p_name", F.lit("  "))), F.lit("\n\n"))
    lists = _text_of(t.part.withColumn("of", F.struct("p_brand", "p_type")), "of", F.col("p_partkey"), item, ":\n").select("of.p_brand", F.col("of.p_type").alias("p_type"), F.concat("of.p_type", F.lit("_keywords"), "text").alias("list"))
    texts = _text_of(lists, "p_brand", F.col("p_type"), F.col("list"), "# made\n").select(F.substring("p_brand", 7, 9).cast("int").alias("file"), "text")
    found = rules.rows(texts, lists=True).select(F.concat(F.lit("Brand#"), F.col("file").cast("string")).alias("p_brand"), F.col("name").alias("key"), F.col("value").alias("item"), "place")
    first = found.groupBy("p_brand", "key").agg(F.min("place").alias("_first"))  # places count through a file
    return found.join(first, ["p_brand", "key"]).withColumn("place", F.col("place") - F.col("_first") + 1).drop("_first")


@query("""
with b as (select p_brand, count(*) as n, max(p_type) as t from part group by 1)
select p_brand, 'limit' as name, cast(n as varchar) as value, 'number' as field from b union all select p_brand, 'layout', lower(t), 'text' from b union all select p_brand, 'types', p_type, null from part group by all
""")
def setting_files(t: Tables) -> DataFrame:
    """Lists with settings among them: a file for each brand with a number, a word, and its types."""
    made = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("p_type").alias("t"), F.array_join(F.transform(F.array_sort(F.collect_set("p_type")), lambda x: F.concat(F.lit("- '"), x, F.lit("'\n"))), "").alias("types"))
    text = F.concat(F.lit("limit: "), F.col("n").cast("string"), F.lit("\ntypes:\n"), "types", F.lit("layout:  "), F.lower("t"), F.lit(" \n"))
    found = rules.rows(made.select(F.substring("p_brand", 7, 9).cast("int").alias("file"), text.alias("text")), lists=True, scalars=True)
    return found.select(F.concat(F.lit("Brand#"), F.col("file").cast("string")).alias("p_brand"), "name", "value", "field")


@query("""
with s as (select p_type, count(*) as n_rows, cast(count(*) filter (p_size > 40) as bigint) as n_review, substr(sha256(string_agg(cast(p_partkey as varchar), chr(10) order by cast(p_partkey as varchar))), 1, 16) as cohort from part group by 1)
select p_type as title, n_rows, n_review, cohort from s
""")
def title_review(t: Tables) -> DataFrame:
    """Titles written for people in parts, and read back."""
    rows = t.part.withColumns({"program_title": F.col("p_type"), "path_id": F.col("p_partkey").cast("string")})
    stats = review.title_stats(rows, "program_title", F.col("p_size") > 40, "path_id", "p_name", "p_partkey")
    folder = scratch.folder(t.spark, "titles")
    reviews.title_parts(stats, folder)
    return reviews.title_rows(t.spark, folder).join(stats.select(F.col("program_title").alias("alias"), "n_rows", "n_review"), "alias").select("title", "n_rows", "n_review", "cohort")


@query("""
with g as (select p_brand, p_type, p_partkey, p_size, row_number() over (partition by p_brand, p_type order by p_size desc, p_partkey) as r, count(*) over (partition by p_brand, p_type) as n from part)
select concat(p_brand, '::', p_type) as group_key, cast(p_partkey as varchar) as path_id, case when r = 1 then 'keep' else 'drop' end as decision from g where n > 1
""")
def group_review(t: Tables) -> DataFrame:
    """Duplicate decisions of all groups written for people in parts, and read back."""
    plan = dedup.keep_best(t.part.withColumn("group_key", F.concat_ws("::", "p_brand", "p_type")), ["group_key"], [F.desc("p_size"), F.asc("p_partkey")])
    plan = plan.select("group_key", F.col("p_partkey").cast("string").alias("path_id"), F.col("p_name").alias("path"), F.col("p_size").cast("long").alias("size_bytes"), "decision")
    folder = scratch.folder(t.spark, "groups")
    reviews.group_parts(dedup.review_groups(plan), folder)
    return reviews.group_rows(t.spark, folder)


def _manifests(t: Tables) -> DataFrame:
    """A manifest for each order: its lines are gates, open where the line is, that wait for the line's part and for the order's plan."""
    gate = F.struct(F.col("l_linenumber").cast("string").alias("k"), F.struct(F.col("l_linenumber").cast("string").alias("id"), F.col("l_returnflag").alias("type"), F.when(F.col("l_linestatus") == "O", "open").otherwise("resolved").alias("status"), F.array(F.concat(F.lit("part"), F.col("l_partkey").cast("string")), F.lit("plan")).alias("artifact_ids")).alias("v"))
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(gate).alias("g")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list("g")).alias("gates"))
    held = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    run = F.struct(F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_orderpriority").alias("flow"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("plan_ready").alias("phase"), F.coalesce("gates", F.create_map().cast(f"map<string,{runs.GATE}>")).alias("gates"), F.create_map(F.lit("plan"), F.struct(F.lit("plan").alias("id"))).alias("artifacts"), F.lit(1).alias("version"))
    return runs.parsed(held.select(F.concat(F.lit("run"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("name"), F.col("o_orderdate").alias("changed_at"), F.to_json(run).alias("value")))


@query("""
with l as (select l_orderkey, l_linenumber, l_returnflag as f, case when l_linestatus = 'O' then 'open' else 'resolved' end as s, concat('part', cast(l_partkey as varchar)) as p, row_number() over (partition by l_orderkey, l_linenumber order by l_returnflag, case when l_linestatus = 'O' then 'open' else 'resolved' end, concat('part', cast(l_partkey as varchar))) as r from lineitem)
select concat('run', cast(o_orderkey as varchar)) as run_id, case when o_orderstatus = 'F' then 'complete' else 'plan_ready' end as phase, cast(l_linenumber as varchar) as gate, f as type, a as artifact_id
from l join orders on o_orderkey = l_orderkey, unnest([p, 'plan']) as u(a) where r = 1 and s = 'open'
""")
def open_gates(t: Tables) -> DataFrame:
    """Gates that wait, of all runs' manifests."""
    return runs.gates(_manifests(t))


@query("""
select concat('run', cast(o_orderkey as varchar)) as run_id, o_orderpriority as flow, cast(row_number() over (order by o_orderdate desc, concat('run', cast(o_orderkey as varchar), '.json')) as int) as place from orders
order by o_orderdate desc, concat('run', cast(o_orderkey as varchar), '.json') limit 20
""")
def newest_runs(t: Tables) -> DataFrame:
    """The manifests changed last."""
    return runs.recent(_manifests(t), 20).select("run_id", "flow", "place")


@query("""
with l as (select l_orderkey, l_linenumber, min(case when l_linestatus = 'O' then 'open' when l_quantity > 45 then 'rejected' else 'approved' end || '|' || case l_returnflag when 'R' then 'metadata_review' when 'A' then 'relocate_metadata_review' else 'review' end) as g from lineitem group by all),
g as (select l_orderkey, bool_or(g like 'open|%' or g like 'rejected|%') as blocked, bool_or(g = 'open|metadata_review') as a, bool_or(g = 'open|relocate_metadata_review') as b from l group by 1),
r as (select o_orderkey, case when o_custkey % 2 = 0 then 'source_root' else 'relocate' end as flow, case o_orderstatus when 'F' then 'complete' when 'O' then 'plan_ready' else 'review_required' end as phase,
  case when o_custkey % 3 = 0 then 'relocate_plan' else 'source_root_move_plan' end as kind, o_orderpriority = '5-LOW' as stale, o_orderpriority = '1-URGENT' as queue, o_orderkey % 7 as f, coalesce(blocked, false) as blocked, coalesce(a, false) as a, coalesce(b, false) as b from orders left join g on l_orderkey = o_orderkey)
select concat('run', cast(o_orderkey as varchar)) as run_id,
  case phase when 'plan_ready' then case when not stale and kind = case flow when 'source_root' then 'source_root_move_plan' else 'relocate_plan' end then 'review_plan' end
    when 'review_required' then case when flow = 'source_root' then case when a then 'review_metadata' end when b then 'review_relocate_metadata' when queue then 'prepare_relocate_metadata' end end as follow_up,
  case when flow <> 'source_root' then 'wrong_flow' when phase <> 'plan_ready' then 'wrong_phase' when blocked then 'blocking_gate' when kind <> 'source_root_move_plan' then 'wrong_artifact_type' when stale then 'stale_artifact' when f = 0 then 'artifact_missing' when f = 1 then 'checksum_mismatch' else 'ok' end as apply
from r
""")
def run_steps(t: Tables) -> DataFrame:
    """What follows for each order's run, and whether its plan may be applied: some plans' files have gone or changed."""
    status = F.when(F.col("l_linestatus") == "O", "open").when(F.col("l_quantity") > 45, "rejected").otherwise("approved")
    kind = F.when(F.col("l_returnflag") == "R", "metadata_review").when(F.col("l_returnflag") == "A", "relocate_metadata_review").otherwise("review")
    gate = F.struct(F.col("l_linenumber").cast("string").alias("k"), F.struct(status.alias("status"), kind.alias("type")).alias("v"))
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(gate).alias("g")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list("g")).alias("gates"))
    n, path = F.col("o_orderkey"), F.concat(F.lit("plans/"), F.col("o_orderkey").cast("string"))
    plan = F.struct(F.when(F.col("o_custkey") % 3 == 0, "relocate_plan").otherwise("source_root_move_plan").alias("type"), F.when(F.col("o_orderpriority") == "5-LOW", "superseded").otherwise("current").alias("status"), path.alias("path"), F.sha2(path, 256).alias("sha256"))
    queue = F.struct(F.lit("relocate_metadata_queue").alias("type"), F.when(F.col("o_orderpriority") == "1-URGENT", "current").otherwise("superseded").alias("status"), F.lit("q").alias("path"), F.lit("").alias("sha256"))
    run = F.struct(
        F.concat(F.lit("run"), n.cast("string")).alias("run_id"), F.when(F.col("o_custkey") % 2 == 0, "source_root").otherwise("relocate").alias("flow"), F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "plan_ready").otherwise("review_required").alias("phase"),
        "gates", F.create_map(F.lit("plan"), plan, F.lit("queue"), queue).alias("artifacts"),
    )
    held = t.orders.join(lines, F.col("l_orderkey") == n, "left").select(F.lit("x").alias("name"), F.col("o_orderdate").alias("changed_at"), F.to_json(run).alias("value"))
    files = t.orders.where(n % 7 != 0).select(path.alias("path"), F.sha2(F.when(n % 7 == 1, "changed").otherwise(path), 256).alias("sha256"))
    return runs.apply_checks(runs.next_steps(runs.parsed(held)), "plan", "source_root", "source_root_move_plan", files).select("run_id", "follow_up", "apply")


@query("""
with e as (select user_id, event_id, case event_type when 'view' then 'created' when 'click' then 'plan_ready' when 'purchase' then 'applied' when 'error' then 'failed' else 'complete' end as phase from events),
s as (select user_id, event_id, lag(phase) over (partition by user_id order by event_id) as before, phase as after from e),
a(before, after) as (values ('created', 'plan_ready'), ('created', 'failed'), ('plan_ready', 'applied'), ('plan_ready', 'complete'), ('plan_ready', 'failed'), ('applied', 'complete'), ('applied', 'failed'))
select user_id, event_id, before, after from s anti join a using (before, after) where before is not null
""")
def illegal_steps(t: Tables) -> DataFrame:
    """Users' events as phases of runs: the changes that a run may not make."""
    kind = F.col("event_type")
    phase = F.when(kind == "view", "created").when(kind == "click", "plan_ready").when(kind == "purchase", "applied").when(kind == "error", "failed").otherwise("complete")
    steps = t.events.select("user_id", "event_id", F.lag(phase).over(W.partitionBy("user_id").orderBy("event_id")).alias("before"), phase.alias("after")).where("before is not null")
    return runs.illegal_steps(steps).select("user_id", "event_id", "before", "after")


@query("""
with f as (select o_orderkey, concat('log', cast(o_custkey % 40 as varchar), '_', cast(o_orderkey as varchar)) as name, o_orderdate as mtime, o_orderstatus = 'F' as packed from orders),
p(prefix, keep) as (values ('log1', 5), ('log12', 2), ('log2', 0), ('log3_', 1)),
b as (select *, (select arg_max(prefix, length(prefix)) from p where starts_with(name, prefix)) as prefix from f),
r as (select b.*, coalesce(keep, 0) as keep, row_number() over (partition by packed, b.prefix order by mtime desc, name) as place from b left join p using (prefix))
select name, case when packed then case when mtime < timestamp '2000-01-01' - interval 365 day then 'delete' else 'leave' end when place <= keep then 'keep' else 'pack' end as action from r
""")
def log_actions(t: Tables) -> DataFrame:
    """What becomes of each log, by prefixes of which one begins another, and acted on."""
    name = F.concat(F.lit("log"), (F.col("o_custkey") % 40).cast("string"), F.lit("_"), F.col("o_orderkey").cast("string"))
    logs = t.orders.select(name.alias("name"), F.col("o_orderdate").cast("timestamp").alias("mtime"), (F.col("o_orderstatus") == "F").alias("packed"))
    prefixes = t.spark.createDataFrame([("log1", 5), ("log12", 2), ("log2", 0), ("log3_", 1)], "prefix string, keep int")
    done = runs.act(runs.archive_actions(logs, prefixes, F.lit("2000-01-01 00:00:00").cast("timestamp"), 365), {"pack": lambda _: None})
    return done.where("ok").select("name", "action")


def _json_text(rows: DataFrame) -> str:
    """A report of all parts, by size and brand, as one JSON object in one file, a line for each size."""
    entry = F.to_json(F.struct(F.concat(F.lit('D:\\x{"'), "p_name", F.lit('}\\"'), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") - 3).alias("size"), F.col("p_type").alias("hash"), F.struct(F.lit("}{").alias("y")).alias("other")))
    groups = rows.groupBy("p_size", "p_brand").agg(F.concat(F.lit("[\n"), F.array_join(F.array_sort(F.collect_list(entry)), ", "), F.lit("]")).alias("g"))
    sizes = groups.groupBy("p_size").agg(F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('": [[],'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_brand", "g"))), lambda x: x["g"]), ","), F.lit("],")).alias("value"))
    lines = sizes.unionByName(rows.sparkSession.createDataFrame([(-1, "\ufeff{"), (1000, '"5000": [], "5001": [[]]}')], "p_size int, value string"))
    folder = scratch.folder(rows.sparkSession, "report")
    lines.orderBy("p_size").select("value").coalesce(1).write.text(folder)
    return folder


@query(r"""
with c as (select p_size, p_brand, count(*) as n from part group by all), g as (select *, row_number() over (partition by p_size order by p_brand) as g from c)
select concat(cast(p_size as varchar), '#', cast(g as varchar)) as group_id, concat('D:\x{"', p_name, '}\"', cast(p_partkey as varchar)) as path, cast(greatest(0, p_size - 3) as bigint) as size, p_type as hash
from part join g using (p_size, p_brand) where n > 1
""")
def split_report(t: Tables) -> DataFrame:
    """A duplicate finder's report whose paths hold quotes, braces and backslashes, read by many tasks."""
    file, name, before = _json_text(t.part), "spark.sql.files.maxPartitionBytes", t.spark.conf.get("spark.sql.files.maxPartitionBytes")
    t.spark.conf.set(name, "65536")
    try:
        return jsonl.hash_report(t.spark, file).select("group_id", "path", "size", "hash")
    finally:
        t.spark.conf.set(name, before)


@query("""
select o_orderkey as k, case when o_custkey % 50 = 0 and o_orderstatus <> 'F' then 'new' else o_orderpriority end as note, o_orderstatus as status from orders
union all select o_orderkey + 1000000000, 'added', 'O' from orders where o_custkey % 100 = 0
""")
def bucketed_upsert(t: Tables) -> DataFrame:
    """A table in buckets; batches that update rows not yet final, and add rows, each write the buckets they meet."""
    folder = scratch.folder(t.spark, "bucketed")
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("note"), F.col("o_orderstatus").alias("status"))
    bucketed.create(rows, folder, ["k"], 16)
    changes = t.orders.where("o_custkey % 50 = 0").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("note"), F.col("o_orderstatus").alias("status"))
    bucketed.merge(changes, folder, lambda table, batch: merge.upsert(table, batch, ["k"], guard=lambda old, new: old("status") != "F"))
    added = t.orders.where("o_custkey % 100 = 0").select((F.col("o_orderkey") + 1_000_000_000).alias("k"), F.lit("added").alias("note"), F.lit("O").alias("status"))
    for _ in range(2):  # the second time changes nothing
        bucketed.merge(added, folder, lambda table, batch: merge.insert_new(table, batch, ["k"]))
    bucketed.vacuum(t.spark, folder)
    return bucketed.read(t.spark, folder)


@query("""
with c as (select o_custkey, count(*) filter (o_orderstatus = 'O' and o_totalprice > 200000) as planned, count(*) filter (o_orderpriority = '1-URGENT' and o_totalprice > 450000) as suspicious, count(*) filter (o_orderpriority = '2-HIGH' and o_totalprice > 480000) as unreviewed, count(*) filter (o_orderstatus = 'P') as missing from orders group by 1)
select o_custkey, case when suspicious > 0 or unreviewed > 0 then 'review_required' when planned > 0 then 'plan_ready' when missing > 0 then 'metadata_missing' else 'nothing_to_do' end as outcome from c
""")
def relocate_outcomes(t: Tables) -> DataFrame:
    """What dry runs lead to: a run for each customer."""
    n = lambda c: F.count_if(F.expr(c))
    c = t.orders.groupBy("o_custkey").agg(n("o_orderstatus = 'O' and o_totalprice > 200000").alias("p"), n("o_orderpriority = '1-URGENT' and o_totalprice > 450000").alias("s"), n("o_orderpriority = '2-HIGH' and o_totalprice > 480000").alias("u"), n("o_orderstatus = 'P'").alias("m"))
    return c.select("o_custkey", moves.outcomes(F.col("p"), F.col("s"), F.col("u"), F.col("m")).alias("outcome"))


@query("select c_custkey, case when c_mktsegment = 'MACHINERY' then 'raw_extraction_file' when c_nationkey % 4 = 0 then 'no_changes' when c_acctbal < 0 and c_custkey % 2 = 0 then 'rows_still_need_review' end as refusal from customer")
def review_refusals(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", review.refusal(F.col("c_mktsegment") == "MACHINERY", F.col("c_nationkey") % 4, (F.col("c_acctbal") < 0).cast("int"), F.col("c_custkey") % 2 != 0).alias("refusal"))


@query("""
with p as (select chr(65 + cast(n_nationkey as int)) as new, min(chr(80 + n_regionkey)) as old from nation where n_nationkey % 3 <> 0 group by 1)
select page_id, old || ':' || substr(path, 3) as old_path from (select page_id, concat(chr(cast(97 + page_id % 26 as int)), ':\\', replace(url, '/', '\\')) as path from pages) left join p on new = upper(substr(path, 1, 1))
""")
def remapped_drives(t: Tables) -> DataFrame:
    """Paths under the drives that they had, by a table of letters written in many ways."""
    n = F.col("n_nationkey")
    new, old = F.chr(65 + n), F.chr(80 + F.col("n_regionkey"))
    pairs = t.nation.where(n % 3 != 0).select(F.when(n % 2 == 0, F.lower(new)).when(n % 5 == 0, F.concat(new, F.lit(":\\"))).otherwise(F.concat(F.lit(" "), new, F.lit(":"))).alias("new"), F.concat(F.lower(old), F.lit("/")).alias("old"))
    pairs = pairs.unionByName(t.nation.select(F.lit(" ").alias("new"), F.lit("x").alias("old")))
    path = F.concat(F.chr(97 + F.col("page_id") % 26), F.lit(":\\"), F.replace("url", F.lit("/"), F.lit("\\")))
    return reconcile.remap_drives(t.pages.select("page_id", path.alias("path")), "path", pairs).select("page_id", "old_path")


@query("select p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(lower(p_name), ' '), lambda x: concat('.', x)))), ',') as exts from part")
def extension_sets(t: Tables) -> DataFrame:
    """Words of names as extensions, with and without dots, in capitals, some empty, some twice."""
    words = F.concat(F.split("p_name", " "), F.transform(F.split(F.upper("p_name"), " "), lambda w: F.concat(F.lit(" ."), w, F.lit(" "))), F.array(F.lit(" "), F.lit("")))
    return t.part.select("p_partkey", F.array_join(files.extension_set(words), ",").alias("exts"))


@query("""
select p_partkey, case when p_partkey % 3 = 0 then concat('/', p_type, '/program_aliases_review_', cast(p_partkey as varchar), '.yaml') when p_partkey % 3 = 1 then concat(p_name, '.', p_type, '_review.yaml') else concat('/a.b/llm_filename_extract_output_', p_name, '_review.yaml') end as output from part
""")
def review_outputs(t: Tables) -> DataFrame:
    """Where the review of each file of rows goes."""
    n = F.col("p_partkey")
    source = F.when(n % 3 == 0, F.concat(F.lit("/"), "p_type", F.lit("/llm_filename_extract_output_"), n.cast("string"), F.lit(".jsonl"))).when(n % 3 == 1, F.concat("p_name", F.lit("."), "p_type", F.lit(".jsonl"))).otherwise(F.concat(F.lit("/a.b/llm_filename_extract_output_"), "p_name", F.lit(".txt")))
    return t.part.select("p_partkey", reviews.output_names(source).alias("output"))
