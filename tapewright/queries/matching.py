"""Dictionaries made from the tables, looked for in texts and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.operators import resolve
from tapewright.plans import moves
from tapewright.queries.base import Tables, query

TERMS = "t as (select item_id, unnest(string_split(lower(text), ' ')) as word, generate_subscripts(string_split(lower(text), ' '), 1) as i from benchmark)"


def _terms(t: Tables) -> DataFrame:
    """(item_id, i, word) of the words of the benchmark."""
    return t.benchmark.select("item_id", F.posexplode(F.split(F.lower("text"), " ")).alias("i", "word"))


@query(f"""
with {TERMS}, w as (select distinct word from t where length(word) >= 4), d as (select doc_id, lower(coalesce(text, '')) as norm from documents)
select doc_id, arg_min(word, struct_pack(n := -length(word), w := word)) as title from d join w on contains(norm, word) group by doc_id
""")
def contained_terms(t: Tables) -> DataFrame:
    """The longest word of the benchmark inside each document."""
    words = _terms(t).select(F.col("word").alias("norm"), F.col("word").alias("title")).distinct()
    return resolve.longest_contained(t.documents.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("norm")), "doc_id", "norm", words, least=4)


@query(f"""
with {TERMS}, a as (select word, min(item_id * 1000 + i) as place from t where length(word) >= 6 group by word), d as (select doc_id, lower(coalesce(text, '')) as norm from documents)
select doc_id, concat('item ', cast(min(place) // 1000 as varchar)) as title from d join a on contains(norm, word) group by doc_id
""")
def first_alias_contained(t: Tables) -> DataFrame:
    """Aliases in the order of the items: the title of the first one inside each document."""
    place = F.col("item_id") * 1000 + F.col("i") + 1
    aliases = _terms(t).where(F.length("word") >= 6).select(F.col("word").alias("norm"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("title"), place.alias("place"))
    return resolve.first_contained(t.documents.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("norm")), "doc_id", "norm", aliases)


@query("""
with e as (select distinct substr(p_name, 1, 1) as norm from part union select distinct split_part(p_name, ' ', 1) from part where p_partkey % 3 = 0),
m as (select p_partkey, norm as title, row_number() over (partition by p_partkey order by length(norm) desc, norm) as r from part join e on starts_with(p_name, norm) and length(p_name) >= length(norm) + 1)
select p_partkey, title from m where r = 1
""")
def short_prefixes(t: Tables) -> DataFrame:
    """Names by the longest of the entries that they begin with: single letters, which many names share, and words."""
    words = t.part.select(F.substring("p_name", 1, 1).alias("norm")).union(t.part.where("p_partkey % 3 = 0").select(F.split("p_name", " ")[0]))
    return resolve.longest_prefix(t.part, "p_partkey", "p_name", words.select("norm", F.col("norm").alias("title")), extra=1)


@query("""
with w as (select distinct split_part(p_name, ' ', 2) as word from part where p_partkey % 2 = 0), r as (select concat('%', word, '_%') as pattern, concat(word, ' titles') as new_title from w where length(word) >= 3 union all select '%~%%', 'percents')
select p_partkey as path_id, coalesce(arg_min(new_title, pattern), p_name) as program_title, cast(max(case when pattern is null then 0 else 1 end) as int) as human_reviewed
from part left join r on concat(p_type, '/', upper(p_name)) ilike pattern escape '~' group by p_partkey, p_name
""")
def wildcard_titles(t: Tables) -> DataFrame:
    """Instructions whose patterns begin with a wildcard, made of the second words of names."""
    words = t.part.where("p_partkey % 2 = 0").select(F.split("p_name", " ")[1].alias("word")).distinct().where("length(word) >= 3")
    changes = words.select(F.concat(F.lit("%"), "word", F.lit("_%")).alias("path_pattern"), F.concat("word", F.lit(" titles")).alias("new_title")).unionByName(t.spark.createDataFrame([("%~%%", "percents")], "path_pattern string, new_title string"))
    rows = t.part.select(F.col("p_partkey").alias("path_id"), F.concat("p_type", F.lit("/"), F.upper("p_name")).alias("path"), F.col("p_name").alias("program_title"), F.lit("llm").alias("source"), F.lit(0).alias("human_reviewed"), F.lit(1).alias("needs_review"))
    return moves.title_updates(rows, changes).select("path_id", "program_title", F.col("human_reviewed").cast("int").alias("human_reviewed"))
