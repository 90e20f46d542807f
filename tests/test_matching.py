"""Automata, sorted ranges and trigrams against comparing all with all."""

import random
import time

from pyspark.sql import functions as F

from tapewright.operators import matching, prefixes
from tapewright.plans import moves


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_first_contained_equals_brute_force(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abé\U0001f600") for _ in range(n))
    entries = [(word(r.randint(1, 5)), r.choice(["t1", "t2", None, "é"]), r.randint(0, 9)) for _ in range(60)] + [("", "x", 0), (None, "x", 0), ("a", "late", 9)]
    texts = [(i % 40, word(r.randint(0, 12))) for i in range(80)] + [(1, None), (None, "aab"), (2, "")]
    best = {}
    for norm, title, place in entries:
        if norm:
            best[norm] = min(best.get(norm, (99, True, "")), (place, title is not None, title or ""))
    want = []
    for i, text in texts:
        if found := [b for norm, b in best.items() if text and norm in text]:
            want.append((i, min(found)[2] if min(found)[1] else None))
    df, table = spark.createDataFrame(texts, "id int, norm string"), spark.createDataFrame(entries, "norm string, title string, place int")
    for shard in (10**6, 400):
        assert rows(matching.first_contained(df, "id", "norm", table, shard)) == sorted(want, key=str)
    assert rows(matching.first_contained(df, "id", "norm", table.limit(0))) == [] == rows(matching.first_contained(df.limit(0), "id", "norm", table))


def test_many_entries_in_long_texts(spark):
    """200,000 entries against texts of 20,000 characters: one row out of each, and no exchange of texts."""
    entries = spark.range(200_000).select(F.concat(F.lit("entry "), F.sha2(F.col("id").cast("string"), 256).substr(1, 12)).alias("norm"), F.col("id").cast("string").alias("title"))
    filler = F.repeat(F.lit("entry 00 of lorem ipsum "), 900)
    texts = spark.range(200).select("id", F.when(F.col("id") % 2 == 0, F.concat(filler, F.lit("entry "), F.sha2((F.col("id") * 7).cast("string"), 256).substr(1, 12), filler)).otherwise(filler).alias("norm"))
    began = time.perf_counter()
    out = matching.longest_contained(texts, "id", "norm", entries)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.title for r in out.collect()} == {i: str(i * 7) for i in range(0, 200, 2)}
    assert time.perf_counter() - began < 60


def test_prefixes_equal_brute_force(spark):
    r = random.Random(3)
    titles = ["".join(r.choice("ab") for _ in range(r.randint(0, 14))) for _ in range(400)] + ["a"] * 300 + ["abab"] * 200 + [None, "", "é", "é\U0001f600", "\uffff", "\uffffx"]
    data = [(i if i % 50 else None, t) for i, t in enumerate(titles)]
    entries = sorted({t for t in titles if t is not None and r.random() < 0.5} | {"a", "b", "abab"})
    df = spark.createDataFrame(data, "id int, norm string")
    table = spark.createDataFrame([(e, f"<{e}>") for e in entries] + [("a", "zz"), (None, "n")], "norm string, title string")
    for extra in (0, 1, 3):
        want = []
        for i, t in data:
            if found := [e for e in entries if e and t is not None and t.startswith(e) and len(t) >= len(e) + extra]:
                want.append((i, f"<{max(found, key=len)}>"))
        assert rows(prefixes.longest_prefix(df, "id", "norm", table, extra)) == sorted(want, key=str)
    known = {t for t in titles if t}
    for least in (1, 4):
        assert {x.norm for x in prefixes.prefix_family(df, "norm", least).collect()} == {a for a in known if len(a) >= least and any(b != a and b.startswith(a) for b in known)}
    assert rows(prefixes.longest_prefix(df.limit(0), "id", "norm", table)) == [] == rows(prefixes.longest_prefix(df, "id", "norm", table.limit(0)))


def test_a_short_entry_spreads(spark):
    """Half of the titles begin with one letter, a quarter are one title: no range of the scan holds much more than its share."""
    n = 40_000
    norm = F.when(F.col("id") % 4 == 0, "same").when(F.col("id") % 4 < 3, F.concat(F.lit("x"), F.sha2(F.col("id").cast("string"), 256))).otherwise(F.sha2(F.col("id").cast("string"), 256))
    df = spark.range(n).select("id", norm.alias("norm"))
    entries = spark.createDataFrame([("x", "X"), ("sa", "Sa"), ("same", "Same")], "norm string, title string")
    found = prefixes.longest_prefix(df, "id", "norm", entries, extra=0)
    sizes = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == n // 4 * 3 and max(sizes) < 3 * n / 4
    assert {(r.title, r.n) for r in found.groupBy("title").agg(F.count(F.lit(1)).alias("n")).collect()} == {("X", n // 2), ("Same", n // 4)}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_wildcard_patterns_meet_by_trigrams(spark):
    paths = ["D:\\tv\\Show One\\a.ts", "D:\\tv\\show 100%\\b.ts", "E:\\x_y\\ONE.ts", "nothing", "", None, "ab"]
    rules = [("%one%", "1"), ("%100~%%", "2"), ("%x~_y%", "3"), ("%b", "4"), ("%SHOW%.ts", "0"), ("_:%", "9"), ("%~~%", "8"), ("%éé~%é%", "7")]
    df = spark.createDataFrame([(str(i), p, "t", "llm", 0, 1) for i, p in enumerate(paths)], "path_id string, path string, program_title string, source string, human_reviewed int, needs_review int")
    table = spark.createDataFrame(rules, "path_pattern string, new_title string")
    want = {r.path_id: r.t for r in df.join(table, F.expr("path ilike path_pattern escape '~'")).groupBy("path_id").agg(F.min_by("new_title", "path_pattern").alias("t")).collect()}
    assert len(want) == 4
    out = {r.path_id: r.program_title for r in moves.title_updates(df, table).collect()}
    assert out == {str(i): want.get(str(i), "t") for i in range(len(paths))}
    long = moves.title_updates(df, table.where("length(path_pattern) >= 5 and path_pattern not like '%~~%'"))
    assert "NestedLoop" not in long._jdf.queryExecution().executedPlan().toString()


def test_texts_go_in_short_batches(spark):
    """Texts may be long, so a batch has few of them, whatever the session's setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        entries = spark.createDataFrame([("abc", "T", 1)], "norm string, title string, place long")
        assert matching.first_contained(spark.range(3).selectExpr("id", "'xabcx' as text"), "id", "text", entries).count() == 3
        assert int(spark.conf.get(name)) <= 512
    finally:
        spark.conf.set(name, before)
