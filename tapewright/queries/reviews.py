"""Review statistics and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions import keys as K
from tapewright.operators import catalog, extract, review
from tapewright.queries.base import Tables, query


@query("""
with d as (select source, doc_id, coalesce(toxic, 0) = 1 as r from documents left join (select doc_id, max(toxic) as toxic from labels group by 1) l using (doc_id))
select source, count(*) as n_rows, count(*) filter (r) as n_review, substr(sha256(string_agg(cast(doc_id as varchar), chr(10) order by cast(doc_id as varchar))), 1, 16) as cohort,
  array_to_string(list_slice(list_sort(list(doc_id)), 1, 3), ',') as samples from d group by 1
""")
def review_stats(t: Tables) -> DataFrame:
    marks = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = t.documents.select("source", "doc_id").join(marks, "doc_id", "left").withColumn("id", F.col("doc_id").cast("string"))
    out = review.title_stats(rows, "source", F.coalesce(F.col("toxic"), F.lit(0)) == 1, "id", "id", "doc_id")
    return out.withColumn("samples", F.array_join("samples", ","))


def _extracted(t: Tables) -> DataFrame:
    n = F.col("c_custkey")
    return t.customer.select(n.alias("row"), F.when(n % 9 == 0, "").when(n % 7 == 0, "UNKNOWN").otherwise(F.col("c_name")).alias("program_title"), F.when(n % 5 == 0, None).when(n % 4 == 0, "2020/01/01").otherwise("2020-01-01").alias("air_date"), (n % 3 == 0).alias("needs_review"))


_REASONS = """
c as (select c_custkey as row, list_filter([case when c_custkey % 9 = 0 then 'missing_program_title' end, case when c_custkey % 9 <> 0 and c_custkey % 7 = 0 then 'unknown_program_title' end, case when c_custkey % 5 = 0 then 'missing_air_date' end,
  case when c_custkey % 5 <> 0 and c_custkey % 4 = 0 then 'invalid_air_date' end, case when c_custkey % 3 = 0 then 'needs_review_flagged' end], lambda x: x is not null) as reasons from customer)
"""


@query(f"with {_REASONS} select row, array_to_string(reasons, ',') as reasons, case when list_has_any(reasons, ['missing_program_title', 'missing_air_date', 'invalid_air_date']) then 'required' else 'review' end as severity from c where len(reasons) > 0")
def review_reasons(t: Tables) -> DataFrame:
    return review.diagnostics(_extracted(t)).select("row", F.array_join("reasons", ",").alias("reasons"), "severity")


@query(f"with {_REASONS} select reason, count(*) as n from (select unnest(reasons) as reason from c) group by 1")
def review_histogram(t: Tables) -> DataFrame:
    return review.histogram(review.diagnostics(_extracted(t)), "reasons", "reason")


@query("select event_type as key, cast(sum(event_id % 5) as bigint) as n from events group by 1")
def merged_counts(t: Tables) -> DataFrame:
    return review.merge_counts(t.events.select(F.create_map("event_type", F.col("event_id") % 5).alias("counts")), "counts")


@query("select count(*) as n_rows, count(*) filter (c_custkey % 3 = 0) as n_review, count(*) filter (c_custkey % 9 = 0) as n_untitled from customer")
def review_risk(t: Tables) -> DataFrame:
    return review.risk(_extracted(t))


@query("""
with a as (select conv_id * 1000 + turn as row, concat(role, text) as c from conversations where turn % 5 <> 4), b as (select conv_id * 1000 + turn as row, case when conv_id % 3 = 0 then concat(role, upper(text)) else concat(role, text) end as c from conversations where turn % 5 <> 3)
select row, case when b.c is null then 'added' when a.c is null then 'removed' else 'changed' end as change from a full join b using (row) where a.c is distinct from b.c
""")
def positional_diff(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("row", F.col("conv_id") * 1000 + F.col("turn"))
    a = rows.where("turn % 5 <> 4").select("row", F.concat("role", "text").alias("c"))
    b = rows.where("turn % 5 <> 3").select("row", F.concat("role", F.when(F.col("conv_id") % 3 == 0, F.upper("text")).otherwise(F.col("text"))).alias("c"))
    return review.positional_diff(a, b, "row", F.col("c")).select("row", "change")


@query("""
select concat('b', cast(s_suppkey as varchar), '_input.jsonl') as name, case when s_suppkey % 3 = 0 then 'pending' when s_suppkey % 3 = 1 then 'complete' else 'incomplete' end as status from supplier
""")
def batch_status(t: Tables) -> DataFrame:
    n = F.col("s_suppkey")
    name = lambda kind: F.concat(F.lit("b"), n.cast("string"), F.lit(f"_{kind}.jsonl"))
    inputs = t.supplier.select(name("input").alias("name"), F.lit(10).alias("n_rows"))
    outputs = t.supplier.where("s_suppkey % 3 <> 0").select(name("output").alias("name"), F.when(n % 3 == 1, 10).otherwise(4).alias("n_rows"))
    return review.batch_status(inputs, outputs).select("name", "status")


@query("""
with a as (select distinct lower(split_part(p_name, ' ', 1)) as norm, upper(split_part(p_name, ' ', 1)) as canonical from part), x as (select p_partkey, p_name, a.canonical, row_number() over (partition by p_partkey order by length(a.norm) desc, a.canonical) as r from part left join a on starts_with(lower(p_name), a.norm) and length(p_name) >= length(a.norm) + 8)
select x.p_partkey, coalesce(e.canonical, x.canonical, x.p_name) as new_title from x left join a e on e.norm = lower(x.p_name) where r = 1
""")
def alias_application(t: Tables) -> DataFrame:
    word = F.split("p_name", " ")[0]
    aliases = t.part.select(F.lower(word).alias("norm"), F.upper(word).alias("canonical")).distinct()
    return review.apply_aliases(t.part.withColumn("norm", F.lower("p_name")), "p_name", "norm", aliases).select("p_partkey", "new_title")


@query("""
with d as (select doc_id, case doc_id % 4 when 0 then 'needs_review_flagged,suspicious_program_title' when 1 then 'low_confidence,needs_review_flagged' when 2 then '' end as reasons from documents)
select doc_id, doc_id % 4 in (0, 2, 3) and doc_id % 3 <> 0 as clearable from d
""")
def review_clearing(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    reasons = F.when(n % 4 == 0, "needs_review_flagged,suspicious_program_title").when(n % 4 == 1, "low_confidence,needs_review_flagged").when(n % 4 == 2, "")
    return t.documents.select("doc_id", catalog.review_clearable(reasons, n % 3 != 0, ["needs_review_flagged", "suspicious_program_title"]).alias("clearable"))


@query("""
select c_custkey, array_to_string(list_filter([case when c_custkey % 9 = 0 then 'missing_program_title' end, case when c_custkey % 4 = 0 then 'invalid_air_date' end, case when c_custkey % 6 = 0 then 'invalid_episode_no' end, case when c_custkey % 5 = 0 then 'invalid_confidence' end], lambda x: x is not null), ',') as errors,
  case when c_custkey % 5 = 0 then 1.0 else 0.5 end::double as confidence from customer
""")
def coerced_rows(t: Tables) -> DataFrame:
    n = F.col("c_custkey")
    rows = t.customer.select("c_custkey", F.when(n % 9 == 0, " ").otherwise(F.col("c_name")).alias("program_title"), F.when(n % 4 == 0, "2020/1/1").otherwise("2020-01-01").alias("air_date"), F.when(n % 6 == 0, "x").otherwise("7").alias("episode_no"), F.when(n % 5 == 0, "1.5").otherwise("0.5").alias("confidence"))
    return extract.coerce(rows).select("c_custkey", F.array_join("errors", ",").alias("errors"), "confidence")


@query("select cast(event_id as varchar) as id, array_to_string(list_filter([case when event_id % 3 = 0 then 'missing path_id/path' end, 'missing keys: program_title', case when event_id % 2 = 0 then 'confidence must be 0..1' end], lambda x: x is not null), '|') as errors from events")
def row_validation(t: Tables) -> DataFrame:
    n = F.col("event_id")
    row = F.to_json(F.struct(F.when(n % 3 != 0, n.cast("string")).alias("path_id"), F.when(n % 2 == 0, 1.5).otherwise(0.5).alias("confidence"), F.lit(True).alias("needs_review")))
    return t.events.withColumn("row", row).select(n.cast("string").alias("id"), F.array_join(extract.row_errors("row", ["confidence", "needs_review", "program_title"]), "|").alias("errors"))


@query("select event_id, user_id % 5 = 0 as queued from events")
def queue_predicate(t: Tables) -> DataFrame:
    n = F.col("user_id")
    rows = t.events.select("event_id", F.when(n % 5 != 0, "llm").alias("source"), F.lit("x").alias("program_title"), F.lit("2020-01-01").alias("air_date"))
    return rows.select("event_id", extract.needs_queue(rows, True).alias("queued"))


@query("select p_partkey, substr(sha256(p_name), 1, 12) as h from part")
def short_hashes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", K.short_hash(F.col("p_name"), 12).alias("h"))
