"""Chat formatting by quotation linking, in DataFrame operations only.

A line's quote level is the number of ``>`` marks that it begins with (spaces between). Consecutive lines of one level form a passage.
Passages of level 1 and more are normalised (lower case, single spaces) and hashed; so are each message's own words: whole, by
run between quotes, by paragraph and by line. A passage comes from the first message of its conversation that holds it and stands
before the quoting one; a passage that no message holds as a whole comes from the one that holds most of its lines (then the latest).
A message answers the source of its first linked passage of level 1, or else of its first linked one. Threads are messages with
what answers them; conversations are ordered by the thread's first turn, then by turn, so an answer stands after what it
answers, and quoted lines are gone from the texts.

Defined cases: null ids make one conversation, null turns stand first; a null text is empty; a message all of quotes has an empty
text; rows of one conversation and turn are alike in links (they share them) and are placed each, by role and text; empty tables give none. Of a
hash only the first message that holds it is joined, so a line that everyone writes costs no pairs. Lines that attribute a quote ("On ...
wrote:") are a message's own words and stay. A line may have any number of marks and a text any length; one text is held at a time.
Columns named like an output or ``clean``, or with a leading ``_``, are dropped; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import NULL_ID, id_key, materialize, ranked, without

#: Possessive, so that the engine loops over the marks and doesn't recurse.
_MARKS = r"^(?:[ \t]{0,3}>)++"


def normalise(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _hash(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def parse(messages: DataFrame) -> DataFrame:
    """Adds ``_lines`` (level, body), ``_runs`` (at, level, text, bodies: one for each run of lines of one level) and ``clean``, the text without quotes."""
    marks = lambda x: F.regexp_extract(x, _MARKS, 0)
    line = lambda x: F.struct(F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.when(F.length(marks(x)) > 0, F.trim(F.substr(x, F.length(marks(x)) + 1))).otherwise(x).alias("body"))
    out = messages.withColumn("_text", F.coalesce("text", F.lit("")))
    quoting = F.col("_text").rlike(r"(?m)" + _MARKS)
    none = F.array().cast("array<struct<level:int,body:string>>")
    out = out.withColumn("_lines", F.when(quoting, F.transform(F.split("_text", "\n"), line)).otherwise(none))
    level = lambda i: F.get("_lines", i)["level"]
    out = out.withColumn("_starts", F.when(F.size("_lines") > 0, F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))).otherwise(F.array().cast("array<int>")))
    bodies = lambda i, j: F.transform(F.slice("_lines", i + 1, F.coalesce(F.get("_starts", j + 1), F.size("_lines")) - i), lambda x: x["body"])
    out = out.withColumn("_runs", F.transform("_starts", lambda i, j: F.struct(j.alias("at"), level(i).alias("level"), bodies(i, j).alias("bodies"))))
    own = F.array_join(F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return out.withColumn("clean", F.when(F.size("_lines") > 0, F.btrim(own, F.lit("\n"))).otherwise(F.col("_text"))).drop("_starts", "_text")


def link_passages(parsed: DataFrame) -> DataFrame:
    """(_c, _t, at, level, source): for each quoted passage of a conversation's message its source's turn, null if there is none."""
    held = F.concat(
        F.array("clean"), F.split("clean", r"\n\s*\n"), F.split("clean", "\n"),
        F.transform(F.filter("_runs", lambda r: r["level"] == 0), lambda r: F.array_join(r["bodies"], " ")),
    )
    held = F.array_distinct(F.transform(held, normalise))
    firsts = parsed.select("_c", "_t", F.explode(held).alias("x")).where("x <> ''").select("_c", "_t", _hash(F.col("x")).alias("h")).groupBy("_c", "h.h1", "h.h2").agg(F.min("_t").alias("source"))
    passages = parsed.select("_c", "_t", F.explode(F.filter("_runs", lambda r: r["level"] > 0)).alias("r")).select("_c", "_t", "r.at", "r.level", "r.bodies").distinct()
    whole = F.struct(normalise(F.array_join("bodies", " ")).alias("x"), (F.size("bodies") + 1).alias("w"))
    lines = F.transform("bodies", lambda b: F.struct(normalise(b).alias("x"), F.lit(1).alias("w")))
    probes = passages.select("_c", "_t", "at", "level", F.explode(F.concat(F.array(whole), lines)).alias("p")).select("_c", "_t", "at", "level", _hash(F.col("p.x")).alias("h"), "p.w").select("_c", "_t", "at", "level", "h.h1", "h.h2", "w")
    met = probes.join(firsts, ["_c", "h1", "h2"]).where("source < _t").groupBy("_c", "_t", "at", "source").agg(F.sum("w").alias("w"))
    best = met.groupBy("_c", "_t", "at").agg(F.max(F.struct("w", "source"))["source"].alias("source"))
    return passages.select("_c", "_t", "at", "level").distinct().join(best, ["_c", "_t", "at"], "left")


def roots(parents: DataFrame) -> DataFrame:
    """(_c, _t, root, reply_depth) of messages with a parent; doubling the distance looked back in each round."""
    jump = materialize(parents.select("_c", "_t", F.col("parent").alias("root"), F.lit(1).cast("long").alias("reply_depth")), "threads")
    while True:
        far = jump.select("_c", F.col("_t").alias("root"), F.col("root").alias("_r"), F.col("reply_depth").alias("_d"))
        joined = jump.join(far, ["_c", "root"], "left")
        if joined.where(F.col("_r").isNotNull()).isEmpty():
            return jump
        jump = materialize(joined.select("_c", "_t", F.coalesce("_r", "root").alias("root"), (F.col("reply_depth") + F.coalesce("_d", F.lit(0))).alias("reply_depth")), "threads")


def link_conversations(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) with ``clean_text``, ``n_quotes``, ``n_linked``, ``parent_turn``, ``root_turn``, ``reply_depth``, ``position`` (from 0)."""
    names = ("clean_text", "n_quotes", "n_linked", "parent_turn", "root_turn", "reply_depth", "position")
    base = without(messages, *names, "clean").withColumns({"_c": id_key("conv_id"), "_t": id_key("turn")})
    parsed = materialize(parse(base), "parsed")
    links = materialize(link_passages(parsed), "links")
    linked = links.where(F.col("source").isNotNull())
    first = linked.groupBy("_c", "_t").agg(F.min(F.struct((F.col("level") > 1).alias("deep"), "at", "source"))["source"].alias("parent"))
    per = links.groupBy("_c", "_t").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("source").alias("n_linked"))
    tree = roots(materialize(first, "parents"))
    info = per.join(first, ["_c", "_t"], "left").join(tree, ["_c", "_t"], "left")
    rows = parsed.drop("_lines", "_runs").join(info, ["_c", "_t"], "left").withColumn("root", F.coalesce("root", "_t"))
    rows = materialize(rows, "messages")
    out = ranked(rows, ["_c"], ["root", "_t", "role"], "_r", ["text"])
    turn = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(*[c for c in base.columns if not c.startswith("_")], F.col("clean").alias("clean_text"), zero("n_quotes").alias("n_quotes"), zero("n_linked").alias("n_linked"), turn("parent").alias("parent_turn"), turn("root").alias("root_turn"), zero("reply_depth").alias("reply_depth"), F.col("_r").alias("position"))
