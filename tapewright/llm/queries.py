"""The queries opN_<name> over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import ann, byte_bpe, class_lm
from tapewright.llm.chat_quotes import link_conversations
from tapewright.llm.common import read
from tapewright.llm.fingerprints import compare_versions
from tapewright.llm.lexical import rank_documents
from tapewright.llm.line_dedup import dedup_lines
from tapewright.llm.mixing import mix_sources
from tapewright.llm.near_dedup import near_duplicate_classes
from tapewright.llm.packing import pack_documents
from tapewright.llm.toxicity import fit, fold, score_toxicity
from tapewright.llm.url_filter import judge_urls, parse_rule
from tapewright.llm.vector_codes import compress_and_sum

#: The fixed rules of op7.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("example.net/de/8", "allow"), ("org/es/", "block")]


def word_tokenizer() -> str:
    """Where the vocabulary file lies on this machine and, installed alike, on the executors."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_conversations(read(spark, sf_dir, "conversations"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), word_tokenizer())


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "source", "block", "release", "deadline", "slot", "position")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [parse_rule(text, verdict) for text, verdict in URL_RULES]
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return class_lm.fit_score(docs)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_and_sum(read(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's operator with given shares: 30 %, 15 %, 5 %, and half for all other sources."""
    return mix_sources(read(spark, sf_dir, "documents"), {"src0": 0.3, "src1": 0.15, "src2": 0.05, "*": 0.5}).select("doc_id", "source", "block", "release", "deadline", "slot", "position")


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3's operator that SQL can state: lengths, and digests of the edited texts."""
    return op3_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column of op13's operator that SQL can state: decoding gives the texts back."""
    return op13_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_quotes, op2_line_dedup, op3_fingerprints, op4_packing, op5_near_dedup, op6_mixing, op7_url_filter, op8_class_lm, op9_toxicity, op10_ann,
        op11_lexical, op12_vector_codes, op13_byte_bpe, mixing_to_targets, fingerprint_edits, bpe_decoded,
    )
}

OP1_SQL = r"""
with recursive messages as (select *, row_number() over (order by conv_id, turn, role, text) as id from conversations),
split as (select id, conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) as l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from messages),
marked as (select *, regexp_extract(l, '^(?:[ \t]{0,3}>)+') as mark from split),
leveled as (select id, conv_id, turn, i, length(regexp_replace(mark, '[^>]', '', 'g')) as level, case when mark = '' then l else trim(substr(l, length(mark) + 1)) end as body from marked),
stepped as (select *, case when lag(level) over (partition by id order by i) = level then 0 else 1 end as step from leveled),
numbered as (select *, sum(step) over (partition by id order by i) - 1 as run from stepped),
runs as (select id, conv_id, turn, run, level, list(body order by i) as bodies from numbered group by all),
quoting as (select id, string_agg(body, chr(10) order by i) filter (level = 0) as own from leveled group by id having max(level) > 0),
cleaned as (select m.*, case when q.id is null then coalesce(text, '') else regexp_replace(coalesce(own, ''), '^\n+|\n+$', '', 'g') end as clean from messages m left join quoting q using (id)),
held as (select conv_id, turn, unnest(list_concat([clean], string_split_regex(clean, '\n\s*\n'), string_split(clean, chr(10)))) as x from cleaned
  union all select conv_id, turn, array_to_string(bodies, ' ') from runs where level = 0 and id in (select id from quoting)),
firsts as (select conv_id, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) as x, min(turn) as source from held group by 1, 2 having x <> ''),
passages as (select distinct conv_id, turn, run, level, bodies from runs where level > 0),
probes as (select conv_id, turn, run, level, array_to_string(bodies, ' ') as x, len(bodies) + 1 as w from passages union all select conv_id, turn, run, level, unnest(bodies), 1 from passages),
met as (select p.conv_id, p.turn, run, level, source, sum(w) as w from probes p join firsts f on f.conv_id = p.conv_id and f.x = lower(trim(regexp_replace(p.x, '\s+', ' ', 'g'))) and source < p.turn group by all),
best as (select conv_id, turn, run, level, arg_max(source, struct_pack(w := w, s := source)) as source from met group by all),
parents as (select conv_id, turn, arg_min(source, struct_pack(d := level > 1, a := run)) as parent, count(*) as n_linked from best group by all),
chains as (select conv_id, turn, parent as root, 1 as depth from parents union all select c.conv_id, c.turn, p.parent, depth + 1 from chains c join parents p on p.conv_id = c.conv_id and p.turn = c.root),
ends as (select conv_id, turn, arg_max(root, depth) as root, max(depth) as depth from chains group by all),
quotes as (select conv_id, turn, count(*) as n_quotes from (select distinct conv_id, turn, run from passages) group by all)
select c.conv_id, c.turn, role, text, clean as clean_text, coalesce(n_quotes, 0) as n_quotes, coalesce(n_linked, 0) as n_linked, parent as parent_turn, coalesce(root, c.turn) as root_turn, cast(coalesce(depth, 0) as bigint) as reply_depth,
  row_number() over (partition by c.conv_id order by coalesce(root, c.turn), c.turn, role, text) - 1 as position
from cleaned c left join parents p on p.conv_id = c.conv_id and p.turn = c.turn left join ends e on e.conv_id = c.conv_id and e.turn = c.turn left join quotes q on q.conv_id = c.conv_id and q.turn = c.turn
"""

#: Common table expressions from documents (doc_id, text) to deduplicated (doc_id, text, n_lines, n_removed).
LINES_SQL = """
lines as (select doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as l from {docs}),
windows as (select doc_id, i, trim(l[i]) as a, trim(l[i+1]) as b, trim(l[i+2]) as c from lines, unnest(range(1, len(l) - 1)) as u(i)),
ordered as (select doc_id, i, row_number() over w as r, first_value(doc_id) over w as fd, first_value(i) over w as fi from windows where not (a = '' and b = '' and c = '') window w as (partition by a, b, c order by doc_id, i)),
held as (select distinct doc_id, fi + d as j from ordered, unnest([0, 1, 2]) as v(d) where r > 1 and fd = doc_id),
own as (select distinct doc_id, i + d as j from ordered, unnest([0, 1, 2]) as v(d) where r > 1 and fd = doc_id),
gone as (select doc_id, i + d as j from ordered, unnest([0, 1, 2]) as v(d) where r > 1 and fd <> doc_id union select * from own anti join held using (doc_id, j)),
marks as (select doc_id, list(j) as js from gone group by doc_id),
deduplicated as (select lines.doc_id, len(l) as n_lines, coalesce(len(js), 0) as n_removed,
  array_to_string([l[k] for k in range(1, len(l) + 1) if not list_contains(coalesce(js, []::bigint[]), k)], chr(10)) as text
  from lines left join marks using (doc_id))
"""

#: All pairs that share a shingle, by exact multiset overlap, and what they connect.
OP5_SQL = r"""
with recursive t as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end as s from t),
n as (select doc_id, len(s) as n from s),
c as (select doc_id, x, count(*) as c from (select doc_id, unnest(s) as x from s) group by all),
p as (select a.doc_id as a, b.doc_id as b, sum(least(a.c, b.c)) as m from c a join c b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where cast(m as double) / (x.n + y.n - m) >= 0.8 union all select x.doc_id, y.doc_id from n x join n y on x.n = 0 and y.n = 0 and x.doc_id < y.doc_id),
edges as (select a, b from links union select b, a from links),
reach(a, b) as (select doc_id, doc_id from n union select r.a, e.b from reach r join edges e on e.a = r.b)
select doc_id, min(b) as class_id, any_value(n) as n_shingles, doc_id = min(b) as is_first from reach join n on doc_id = a group by doc_id
"""

#: {tasks}: common table expressions up to tasks (source, task, w); {ranked}: documents with task, w and block.
MIX_SQL = """
with recursive {tasks},
cycle as (select cast(sum(w) as bigint) as q, list(w order by task) as ws, count(*) as m from tasks),
slots(slot, task, block, done) as (
  select cast(-1 as bigint), cast(-1 as bigint), cast(-1 as bigint), list_transform(ws, lambda x: cast(0 as bigint)) from cycle
  union all
  select slot + 1, pick, done[pick + 1],
    list_transform(range(1, m + 1), lambda i: done[i] + case when i = pick + 1 then 1 else 0 end)
  from (select slot, done, q, ws, m, list_min(list_transform(list_filter(range(1, m + 1), lambda i: done[i] < ws[i] and (done[i] * q) // ws[i] <= slot + 1),
      lambda i: (((done[i] + 1) * q + ws[i] - 1) // ws[i]) * 100000 + i - 1)) % 100000 as pick
    from slots, cycle where slot + 1 < q)
),
ranked as ({ranked}),
placed as (select r.doc_id, r.source, r.block, (r.block // w) * q + s.slot as slot, (r.block // w) * q + (s.block * q) // w as release,
    (r.block // w) * q + ((s.block + 1) * q + w - 1) // w as deadline
  from ranked r join slots s on s.task = r.task and s.block = r.block % r.w, cycle)
select doc_id, source, cast(block as bigint) as block, cast(release as bigint) as release, cast(deadline as bigint) as deadline, cast(slot as bigint) as slot,
  row_number() over (order by slot, doc_id) - 1 as position from placed
"""

OP6_SQL = MIX_SQL.format(
    tasks="""counts as (select source, count(*) as n from documents group by source),
total as (select sum(sqrt(n)) as s from counts),
tasks as (select source, (row_number() over (order by source nulls first) - 1) as task, greatest(1, cast(floor(sqrt(n) / s * 10000 + 0.5) as bigint)) as w from counts, total)""",
    ranked="""select doc_id, d.source, task, w, (row_number() over (partition by d.source order by doc_id) - 1) // 16 as block
  from documents d join tasks t on d.source is not distinct from t.source""",
)

#: Sources that aren't named share the last task.
TARGETS_SQL = MIX_SQL.format(
    tasks="tasks(source, task, w) as (values ('src0', 0, 6::bigint), ('src1', 1, 3::bigint), ('src2', 2, 1::bigint), ('*', 3, 10::bigint))",
    ranked="""select doc_id, source, task, w, (row_number() over (partition by task order by doc_id) - 1) // 16 as block
  from (select doc_id, d.source, coalesce(t.task, 3) as task, coalesce(t.w, 10) as w from documents d left join tasks t on d.source = t.source)""",
)

OP7_SQL = r"""
with p as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from p),
q as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
rules(rhost, rpath, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'allow'), ('org', '/es/', 'block')),
best as (select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(v, length(rhost || rpath)) as v
  from q join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select q.page_id, host, path, rule, coalesce(v, 'allow') as verdict from q left join best using (page_id)
"""

OP10_SQL = """
with v as (select vec_id, embedding::double[] as e, row_number() over () as n from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.n as query_row, q.vec_id as query_id, v.vec_id, list_sum(list_transform(range(1, len(v.e) + 1), lambda i: v.e[i] * q.e[i])) as score from v join v q on q.vec_id % 20 = 0 and v.n <> q.n and len(v.e) = len(q.e)),
r as (select query_id, cast(row_number() over (partition by query_row order by score desc, vec_id) as int) as rank, vec_id, score from s)
select * from r where rank <= 20
"""

OP11_SQL = r"""
with t as (select row_number() over () as d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
docs as (select d, any_value(doc_id) as doc_id, count(*) as n from t group by d),
corpus as (select count(*) as docs, cast(sum(n) as bigint) as terms from docs),
ms as (select d, doc_id, 50 + (50 * n * docs) // terms as m from docs, corpus),
tfs as (select d, term, count(*) as tf from t group by all),
ws as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from tfs, corpus group by term, docs),
q as (select distinct i, item_id, term from (select row_number() over () as i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)),
s as (select i, any_value(item_id) as item_id, d, any_value(doc_id) as doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
  from q join ws using (term) join tfs using (term) join ms using (d) group by i, d),
r as (select item_id, cast(row_number() over (partition by i order by score desc, doc_id nulls first) as int) as rank, doc_id, score from s where score > 0)
select * from r where rank <= 50
"""


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Each round as a pair of tables: the nearest entry of each part, then the entries' means. Floors of negative quotients go down, as DuckDB's // does not."""
    out = [
        """ints as materialized (select row_number() over (order by vec_id, embedding) as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(x::double * 1024) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"cut as materialized (select r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as x from ints, range({parts}) as u(p))",
        f"book0 as materialized (select p, r - 1 as e, x as c from cut where r <= {entries})",
    ]
    for i in range(rounds + 1):
        out.append(
            f"""near{i} as materialized (select r, p, any_value(x) as x, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, e := e)) as b
  from cut join book{i} using (p) group by r, p)"""
        )
        if i < rounds:
            out.append(
                f"""book{i + 1} as materialized (select p, e, case when s is null then c else list_transform(s, lambda z: cast(floor(z / n) as bigint)) end as c from book{i} left join
  (select p, e, list(cast(t as bigint) order by j) as s, any_value(n) as n from
    (select p, b.e as e, j, sum(x[j]) as t, count(*) as n from near{i}, unnest(range(1, len(x) + 1)) as w(j) group by all) group by p, e) using (p, e))"""
            )
    return f"""with {", ".join(out)},
coded as (select r, string_agg(printf('%02x', b.e), '' order by p) as code, cast(sum(b.d) as bigint) as error from near{rounds} group by r),
sha as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded join ints using (r), sha"""


ORACLE_SQL: dict[str, str] = {
    "op1_chat_quotes": OP1_SQL,
    "op2_line_dedup": f"with {LINES_SQL.format(docs='documents')} select doc_id, text, n_lines, cast(n_removed as bigint) as n_removed from deduplicated",
    "op5_near_dedup": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "mixing_to_targets": TARGETS_SQL,
    "op7_url_filter": OP7_SQL,
    "op10_ann": OP10_SQL,
    "op11_lexical": OP11_SQL,
    "op12_vector_codes": _codes_sql(),
    "fingerprint_edits": """
with d as (select doc_id, coalesce(text, '') as t, coalesce(lead(coalesce(text, '')) over (order by doc_id), first(coalesce(text, '')) over (order by doc_id)) as f from documents)
select doc_id, length(t) as n_chars, sha256(concat(substr(t, 1, length(t) - length(t) // 4), substr(f, 1, length(t) // 4))) as edited_sha256 from d
""",
    "bpe_decoded": "select doc_id, sha256(coalesce(text, '')) as decoded_sha256 from documents",
}
