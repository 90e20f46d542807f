"""Sources on files that are written from the tables: JSON lines, folders, sidecars, hash reports, rules, snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.operators import catalog
from tapewright.plans import reviews, runs, snapshots
from tapewright.queries.base import Tables, query
from tapewright.sources import files, guide, jsonl, rules, scratch
from tapewright.streaming import ingest


def _lines(df: DataFrame, column: str, label: str) -> str:
    """Folder of text files with these lines."""
    folder = scratch.folder(df.sparkSession, label)
    df.select(F.col(column).alias("value")).write.text(folder)
    return folder


def _order_json():
    return F.to_json(F.struct("o_orderkey", "o_orderstatus", F.struct("o_custkey").alias("by")))


@query("select o_orderkey, o_orderstatus, o_custkey from orders")
def strict_lines(t: Tables) -> DataFrame:
    """Byte order marks and blank lines between the rows."""
    text = F.explode(F.array(F.concat(F.when(F.col("o_orderkey") % 3 == 0, "﻿").otherwise(""), _order_json()), F.lit(""), F.lit("  ")))
    found = jsonl.strict(t.spark, _lines(t.orders.select(text.alias("x")), "x", "strict"), "o_orderkey long, o_orderstatus string, by struct<o_custkey:long>")
    return found.select("o_orderkey", "o_orderstatus", "by.o_custkey")


def _mixed(t: Tables) -> str:
    n = F.col("o_orderkey") % 5
    text = F.when(n == 1, '{"bad').when(n == 2, "[1]").when(n == 3, '{"_meta": {"n": 1}}').otherwise(_order_json())
    return _lines(t.orders.select(F.explode(F.array(text, F.lit(" "))).alias("x")), "x", "mixed")


@query("select o_orderkey, o_orderstatus from orders where o_orderkey % 5 in (0, 4)")
def tolerant_lines(t: Tables) -> DataFrame:
    return jsonl.tolerant(t.spark, _mixed(t), "o_orderkey long, o_orderstatus string")


@query("select count(*) filter (o_orderkey % 5 <> 3) as n_rows, count(*) filter (o_orderkey % 5 <> 2) as n_objects, count(*) filter (o_orderkey % 5 = 1) as n_errors from orders")
def line_counts(t: Tables) -> DataFrame:
    return jsonl.counts(t.spark, _mixed(t))


@query("select cast(c_custkey as varchar) as path_id, c_name as name from customer")
def queue_lines(t: Tables) -> DataFrame:
    """A queue in one file, its first line ``_meta``."""
    head = t.spark.createDataFrame([('{"_meta": {"kind": "queue"}}',)], "x string")
    rows = t.customer.select(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("path_id"), F.col("c_name").alias("name"))).alias("x"))
    return jsonl.queue(t.spark, _lines(head.unionByName(rows).coalesce(1), "x", "queue"), "path_id string, name string")


@query("select c_custkey, c_name, 'customers' as kind from customer")
def written_lines(t: Tables) -> DataFrame:
    """What the writer writes, rows and header, is read back."""
    folder = scratch.folder(t.spark, "written")
    jsonl.write(t.customer.select("c_custkey", "c_name"), folder, {"kind": "customers"})
    at = t.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_meta.json")
    stream = at.getFileSystem(t.spark._jsc.hadoopConfiguration()).open(at)
    kind = json.loads(bytes(stream.readAllBytes()))["_meta"]["kind"]
    stream.close()
    return jsonl.strict(t.spark, folder, "c_custkey long, c_name string").withColumn("kind", F.lit(kind))


def _library(t: Tables) -> str:
    """A folder for each region with a file for each nation: recordings, some empty, and texts."""
    folder = scratch.folder(t.spark, "library")
    for r in t.nation.collect():
        scratch.put(t.spark, f"{folder}/{r.n_regionkey}/{r.n_name}.{'TS' if r.n_nationkey % 3 else 'txt'}", b"" if r.n_nationkey % 7 == 1 else r.n_name.encode() * 3)
    return folder


_FILES = "(select n_name, n_regionkey, case when n_nationkey % 7 = 1 then 0 else 3 * length(n_name) end as size from nation where n_nationkey % 3 <> 0)"


@query(f"select concat(n_name, '.TS') as name, cast(n_regionkey as varchar) as folder, '.ts' as ext, cast(size as bigint) as size, size = 0 as corrupt, case when size = 0 then 'size_zero' end as corrupt_reason, cast(40 as int) as n_hash from {_FILES}")
def file_listing(t: Tables) -> DataFrame:
    found = files.listing(t.spark, [_library(t)], ["ts"], quick_hash=True, read_bytes=16)
    return found.select("name", F.regexp_extract("dir", "([^/]*)$", 1).alias("folder"), "ext", "size", "corrupt", "corrupt_reason", F.length("quick_hash").alias("n_hash"))


@query("select count(*) as n_files, count(*) filter (n_nationkey % 7 = 1) as n_corrupt, count(distinct n_regionkey) as n_folders, cast(0 as bigint) as n_warnings, cast(2 as bigint) as n_errors from nation")
def scan_report(t: Tables) -> DataFrame:
    """A root that is missing and one that is a file are errors."""
    folder = _library(t)
    scratch.put(t.spark, f"{folder}.note", b"x")
    return files.scan_summary(files.scan(t.spark, [folder, f"{folder}/none", f"{folder}.note"], ["ts", ".TXT"]))


@query("select arg_max(n_name, struct_pack(a := n_regionkey, b := n_name)) as name from nation where starts_with(n_name, 'I')")
def newest_file(t: Tables) -> DataFrame:
    listing = t.nation.select(F.col("n_name").alias("path"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("mtime"))
    return files.newest(listing, "I").select(F.col("path").alias("name"))


@query(r"""
select concat(n_name, '.program.txt') as file, case when n_nationkey % 4 < 2 then concat('2024-01-', lpad(cast(n_nationkey + 1 as varchar), 2, '0')) end as air_date, case when n_nationkey % 4 < 2 then concat(lpad(cast(n_regionkey + 20 as varchar), 2, '0'), ':05') end as start_time,
  case when n_nationkey % 4 < 2 then concat('ch ', cast(n_regionkey as varchar)) end as broadcaster, case when n_nationkey % 4 < 2 then concat(n_name, ' story') end as official_title, case when n_nationkey % 4 < 2 then n_nationkey % 2 = 1 end as again,
  case when n_nationkey % 4 < 2 then concat('about ', n_name) end as description, case when n_nationkey % 4 < 2 then concat('Drama/TV|', lower(n_name), ';Other|') end as genres, case when n_nationkey % 4 < 2 then concat('cast=', n_name, ' and co') end as details,
  case when n_nationkey % 4 < 2 then concat('ServiceID=', cast(1000 + n_nationkey as varchar)) end as ids
from nation
""")
def guide_sidecars(t: Tables) -> DataFrame:
    """Sidecars with all sections, too short ones, ones without a date, and other texts beside them."""
    folder = scratch.folder(t.spark, "guide")
    for r in t.nation.collect():
        n, name = r.n_nationkey, r.n_name
        mark = "[再][字]" if n % 2 else "[新]"
        lines = [f"2024/01/{n + 1:02d}(火) {r.n_regionkey + 20}:05～{r.n_regionkey + 21}:00" if n % 4 != 3 else "no date", f"ｃｈ　{r.n_regionkey}", f"{name}{mark} story", "", f"about {name}", "", "詳細情報", "- cast", f"{name} and co", "", "ジャンル : ", f"Drama／TV - {name.lower()}", "Other", "", "映像 : 1080i", "音声 : x", "", f"ServiceID:{1000 + n}(0x1)"]
        scratch.put(t.spark, f"{folder}/{r.n_regionkey}/{name}.program.txt", ("﻿" + "\n".join(lines[:2] if n % 4 == 2 else lines)).encode())
        scratch.put(t.spark, f"{folder}/{r.n_regionkey}/{name}.txt", b"2024/01/01(x) 1:00~2:00\na\nb\n")
    g = guide.parse(guide.find(t.spark, folder))
    entries = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    genres = F.array_join(F.transform("guide.epg_genres", lambda x: F.concat_ws("|", x["category"], x["subcategory"])), ";")
    return g.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "guide.air_date", "guide.start_time", "guide.broadcaster", "guide.official_title", F.col("guide.is_rebroadcast_flag").alias("again"), "guide.description", genres.alias("genres"), entries(F.col("guide.detail_sections")).alias("details"), entries(F.col("guide.network_ids")).alias("ids"))


@query("select concat(cast(10 * n_regionkey as varchar), '#0') as group_id, n_name as path, cast(greatest(0, n_nationkey - 3) as bigint) as size, cast(n_regionkey as varchar) as hash from nation")
def hash_report(t: Tables) -> DataFrame:
    """A size's groups of files: nations by region; groups of one path, though named twice, are left out; sizes below 0 count as 0."""
    report: dict = {}
    for r in t.nation.collect():
        groups = report.setdefault(str(10 * r.n_regionkey), [[], [{"path": "alone", "size": 1, "hash": "x"}] * 2])
        groups[0].append({"path": r.n_name, "size": r.n_nationkey - 3, "hash": str(r.n_regionkey), "other": [1]})
    file = scratch.folder(t.spark, "report") + "/report.json"
    scratch.put(t.spark, file, json.dumps(report).encode())
    return jsonl.hash_report(t.spark, file)


@query("select lower(n_name) as alias, r_name as title from nation join region on r_regionkey = n_regionkey union select lower(r_name), r_name from region where r_name <> 'ASIA' union all select 'asia', 'Last'")
def hint_aliases(t: Tables) -> DataFrame:
    """Aliases of titles from two sets of files, of which the later wins; a missing file has nothing."""
    named = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    lines = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  - ' "), "n_name", F.lit(" '\n")))), "")
    first = named.groupBy("r_name").agg(lines.alias("x")).select(F.lit(0).alias("file"), F.concat(F.lit("hints:\n- canonical_title: "), "r_name", F.lit("\n  aliases:\n"), "x", F.lit("rules:\n- match: {regex: x}\n  set: {program_title: T}\n")).alias("text"))
    last = t.region.where("r_name = 'ASIA'").select(F.lit(1).alias("file"), F.concat(F.lit("hints:\n- canonical_title: Last\n  aliases: ["), "r_name", F.lit("]\n")).alias("text"))
    texts = first.unionByName(last).unionByName(t.region.select(F.lit(2).alias("file"), F.lit(None).cast("string").alias("text")))
    return rules.alias_table(rules.rows(texts)).where("alias <> 'last'")


@query("select r_name as franchise, cast(count(*) as int) as n from region join nation on r_regionkey = n_regionkey group by 1")
def franchise_rules(t: Tables) -> DataFrame:
    """Series rules of each region, with its nations as patterns, among others that say nothing."""
    named = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    text = F.concat(F.lit("rules:\n- franchise: "), "r_name", F.lit("\n  title_patterns: ["), F.array_join(F.collect_list("n_name"), ", "), F.lit(", 5]\n- franchise: 3\n  title_patterns: []\n- franchise: x\n"))
    found = rules.franchise_table(rules.rows(named.groupBy("r_name").agg(text.alias("text")).select(F.lit(0).alias("file"), "text")))
    return found.groupBy("franchise").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("select c_mktsegment as title, count(*) as n_rows, cast(count(*) filter (c_acctbal < 0) as bigint) as n_review, substr(sha256(string_agg(c_name, chr(10) order by c_name)), 1, 16) as cohort from customer group by 1")
def review_titles(t: Tables) -> DataFrame:
    """Titles written for people and read back: alias, counts and cohort."""
    from tapewright.operators import review

    stats = review.title_stats(t.customer.withColumn("program_title", F.col("c_mktsegment")), "program_title", F.col("c_acctbal") < 0, "c_name", "c_address" if "c_address" in t.customer.columns else "c_name", "c_custkey")
    folder = scratch.folder(t.spark, "titles")
    reviews.title_parts(stats, folder)
    return reviews.title_rows(t.spark, folder).join(stats.select(F.col("program_title").alias("alias"), "n_rows", "n_review"), "alias").select("title", "n_rows", "n_review", "cohort")


@query("select concat('g', cast(o_custkey as varchar)) as group_key, cast(o_orderkey as varchar) as path_id, case when o_orderkey % 3 = 0 then 'drop' else 'keep' end as decision from orders where o_custkey in (select o_custkey from orders where o_orderkey % 3 = 0)")
def review_groups(t: Tables) -> DataFrame:
    """Groups with drops written for people and read back."""
    from tapewright.operators import dedup

    key = F.concat(F.lit("g"), F.col("o_custkey").cast("string"))
    plan = t.orders.select(key.alias("group_key"), F.col("o_orderkey").cast("string").alias("path_id"), F.col("o_orderpriority").alias("path"), F.col("o_orderkey").alias("size_bytes"), F.when(F.col("o_orderkey") % 3 == 0, "drop").otherwise("keep").alias("decision"))
    folder = scratch.folder(t.spark, "groups")
    reviews.group_parts(dedup.review_groups(plan), folder)
    return reviews.group_rows(t.spark, folder)


@query("select cast(n_nationkey as varchar) as file_id, cast(n_regionkey as bigint) as size_bytes, cast(null as varchar) as content_hash, cast(null as bigint) as width from nation")
def loaded_table(t: Tables) -> DataFrame:
    """A table whose files lack columns that the schema has."""
    folder = scratch.folder(t.spark, "catalog")
    t.nation.select(F.col("n_nationkey").cast("string").alias("file_id"), F.col("n_regionkey").cast("long").alias("size_bytes")).write.parquet(f"{folder}/files")
    return catalog.load(t.spark, folder, "files").select("file_id", "size_bytes", "content_hash", "width")


@query("select cast(n_nationkey as varchar) as file_id, cast(n_regionkey as bigint) as size_bytes, cast(null as varchar) as content_hash, cast(n_nationkey as bigint) as width from nation")
def evolved_table(t: Tables) -> DataFrame:
    """Rows of an older schema, with a column in another order and type."""
    old = t.nation.select(F.col("n_nationkey").cast("int").alias("width"), F.col("n_nationkey").cast("string").alias("file_id"), F.col("n_regionkey").cast("int").alias("size_bytes"))
    return catalog.evolve(old, "files").select("file_id", "size_bytes", "content_hash", "width")


@query("select n_nationkey, n_name, 'second' as version, '20240102_000000 20240101_000000' as backups from nation where n_nationkey < 5")
def restored_version(t: Tables) -> DataFrame:
    """Published twice, backed up, published again, restored, rotated: readers have the second version."""
    folder = scratch.folder(t.spark, "published")
    rows = t.nation.select("n_nationkey", "n_name")
    snapshots.publish(rows.withColumn("version", F.lit("first")), folder)
    snapshots.publish(rows.where("n_nationkey < 5").withColumn("version", F.lit("second")), folder)
    name = snapshots.backup(t.spark, folder, "20240101_000000", "pre_apply")
    snapshots.publish(rows.withColumn("version", F.lit("third")), folder)
    snapshots.restore(t.spark, folder, name, "20240102_000000")
    listed = " ".join(b["created_at"] for b in snapshots.backups(t.spark, folder))
    snapshots.rotate(t.spark, folder, 1)
    return snapshots.read(t.spark, folder).withColumn("backups", F.lit(listed))


@query("select concat('run', cast(r_regionkey as varchar)) as run_id, cast(row_number() over (order by r_regionkey desc) as int) as place, case when r_regionkey % 2 = 0 then 'gate' end as gate from region order by r_regionkey desc limit 3")
def recent_runs(t: Tables) -> DataFrame:
    """The newest three manifests of runs, with their open gates."""
    key = F.col("r_regionkey")
    gate = F.when(key % 2 == 0, F.create_map(F.lit("gate"), F.struct(F.lit("gate").alias("id"), F.lit("open").alias("status"))))
    text = F.to_json(F.struct(F.concat(F.lit("run"), key.cast("string")).alias("run_id"), gate.alias("gates")))
    held = runs.recent(runs.parsed(t.region.select(F.concat(F.lit("run"), key.cast("string")).alias("name"), F.timestamp_seconds(1000 + key).alias("changed_at"), text.alias("value"))), 3)
    return held.join(runs.gates(held).select("run_id", "gate"), "run_id", "left").select("run_id", "place", "gate")


@query("select o_custkey as k, min(o_orderkey) as n from orders where o_custkey % 3 <> 0 group by 1 union all select null, o_orderkey from orders where o_custkey % 3 = 0")
def incremental_ingest(t: Tables) -> DataFrame:
    """Files in three batches, the last of which is run again: a key's first row stays, rows without a key all do."""
    source, table, state = (scratch.folder(t.spark, x) for x in ("incoming", "ingested", "state"))
    rows = t.orders.select(F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("k"), F.col("o_orderkey").alias("n")).orderBy("n")
    run = lambda: ingest.ingest_new(t.spark, source, "k long, n long", table, "k", "n", state, 1)
    third = t.orders.approxQuantile("o_orderkey", [0.33, 0.66], 0.01)
    for low, high in zip([-1, *third], [*third, 1e18], strict=True):
        rows.where((F.col("n") > low) & (F.col("n") <= high)).coalesce(1).write.mode("append").json(source)
        run()
    run()
    return t.spark.read.parquet(table).select("k", "n")


@query("select event_id, user_id, event_type from events")
def audit_trail(t: Tables) -> DataFrame:
    """A stream of events appended to a folder, nothing twice though it is started again."""
    source, folder, state = (scratch.folder(t.spark, x) for x in ("events", "trail", "state"))
    t.events.select("event_id", "user_id", "event_type").repartition(3).write.parquet(source)
    stream = lambda: t.spark.readStream.schema("event_id long, user_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):
        ingest.append_events(stream(), folder, state)
    return t.spark.read.parquet(folder)


@query("select n_name as name, case when row_number() over (partition by n_regionkey order by n_nationkey desc) <= 2 then 'kept' else 'packed' end as action from nation")
def rotated_logs(t: Tables) -> DataFrame:
    """Logs by prefix: the newest two of each stay, older ones are packed."""
    name = F.concat(F.lit("log"), F.col("n_regionkey").cast("string"), F.lit("_"), "n_name")
    logs = t.nation.select(name.alias("name"), F.timestamp_seconds(86_400 * (100 + F.col("n_nationkey"))).alias("mtime"), F.lit(False).alias("packed"))
    prefixes = t.region.select(F.concat(F.lit("log"), F.col("r_regionkey").cast("string"), F.lit("_")).alias("prefix"), F.lit(2).alias("keep"))
    done = runs.act(runs.archive_actions(logs, prefixes, F.timestamp_seconds(F.lit(86_400 * 126)), 30), {})
    return done.select(F.regexp_replace("name", "^log[0-9]+_", "").alias("name"), F.when(F.col("action") == "keep", "kept").otherwise("packed").alias("action"))
