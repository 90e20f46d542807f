"""State by key, buckets, groups, reports by pieces, moves under retries, rules and reviews as tables."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tapewright.operators import dedup, groups, merge, reconcile, review
from tapewright.plans import bucketed, moves, reviews, runs
from tapewright.sources import files, jsonl, rules
from tapewright.streaming import ingest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ingest_never_reads_the_table(spark, tmp_path):
    """Ten batches; keys are known by state alone, even after the table's files have gone."""
    src, table, state = (str(tmp_path / x) for x in ("src", "table", "state"))
    os.mkdir(src)
    given = []
    for i in range(10):
        with open(f"{src}/{i}.json", "w") as f:
            f.writelines(json.dumps({"k": f"k{j % 30}" if j % 9 else None, "n": 100 * i + j}) + "\n" for j in range(5 * i, 5 * i + 20))
        os.utime(f"{src}/{i}.json", (1000 + i, 1000 + i))
    ingest.ingest_new(spark, src, "k string, n int", table, "k", "n", state, 1, then=lambda new: given.append(new.count()))
    want, nulls = {}, []
    for i in range(10):
        for j in range(5 * i, 5 * i + 20):
            if j % 9:
                want.setdefault(f"k{j % 30}", 100 * i + j)
            else:
                nulls.append(100 * i + j)
    expected = sorted([*want.items(), *((None, n) for n in nulls)], key=str)
    assert rows(spark.read.parquet(table).select("k", "n")) == expected and sum(given) == len(expected)
    for part in os.listdir(table):
        shutil.rmtree(f"{table}/{part}")
    with open(f"{src}/11.json", "w") as f:
        f.write('{"k": "k1", "n": 5000}\n{"k": "fresh", "n": 5001}\n')
    ingest.ingest_new(spark, src, "k string, n int", table, "k", "n", state, 1)
    assert rows(spark.read.parquet(table).select("k", "n")) == [("fresh", 5001)]


def test_ingest_into_an_older_table(spark, tmp_path):
    src, table, state = (str(tmp_path / x) for x in ("src", "table", "state"))
    os.mkdir(src)
    spark.createDataFrame([("a", 1), (None, 2)], "k string, n int").write.parquet(f"{table}/batch=old")
    with open(f"{src}/1.json", "w") as f:
        f.write('{"k": "a", "n": 3}\n{"k": "b", "n": 4}\n{"n": 5}\n')
    for _ in range(2):
        ingest.ingest_new(spark, src, "k string, n int", table, "k", "n", state)
    assert rows(spark.read.parquet(table).select("k", "n")) == [("a", 1), ("b", 4), (None, 2), (None, 5)]


def test_a_batch_of_one_key_writes_one_bucket(spark, tmp_path):
    folder = str(tmp_path / "t")
    table = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    bucketed.create(table, folder, ["k"], 32)
    before = set(os.listdir(f"{folder}/data"))
    rule = lambda part, batch: merge.upsert(part, batch, ["k"])
    met = bucketed.merge(spark.createDataFrame([(7, "new")], "k long, v string"), folder, rule)
    (version,) = set(os.listdir(f"{folder}/data")) - before
    assert len(met) == 1 and [x for x in os.listdir(f"{folder}/data/{version}") if x.startswith("_bucket")] == [f"_bucket={met[0]}"]
    assert rows(bucketed.read(spark, folder).where("v = 'new'")) == [(7, "new")] and bucketed.read(spark, folder).count() == 1000
    plan = bucketed.read(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    for at in (met[0], (met[0] + 1) % 32):  # a rule that gives keys of other buckets is refused and leaves all as it was
        strange = spark.createDataFrame([(i, "x") for i in range(40)], "k long, v string")
        with pytest.raises(ValueError):
            bucketed.merge(spark.createDataFrame([(7, "z")], "k long, v string"), folder, lambda part, batch, s=strange: s)
        assert bucketed.read(spark, folder).count() == 1000, at
    bucketed.merge(spark.createDataFrame([(7, "z")], "k long, v string"), folder, lambda part, batch: part.limit(0))
    assert bucketed.read(spark, folder).where("k = 7").count() == 0
    assert bucketed.merge(table.limit(0), folder, rule) == [] and bucketed.vacuum(spark, folder) > 0 and bucketed.read(spark, folder).where("k = 8").count() <= 1
    null = spark.createDataFrame([(None, "n")], "k long, v string")
    bucketed.merge(null, folder, rule)
    bucketed.merge(null, folder, rule)
    assert rows(bucketed.read(spark, folder).where("k is null")) == [(None, "n")]


def test_groups_equal_windows(spark):
    r = random.Random(5)
    data = [(i, r.choice([None, "a", "a", "a", f"k{r.randrange(40)}"]), r.choice(["unknown", "x", "y"]), r.choice([1, 2, None])) for i in range(400)] + [(9, "a", "x", 2)] * 3
    df = spark.createDataFrame(data, "id int, k string, b string, n int")
    out = groups.with_groups(df, ["k"], [F.desc("n"), F.asc("id")], sums={"s": F.col("n")})
    found = [tuple(x) for x in out.collect()]
    by = {}
    for i, k, b, n in data:
        if k is not None:
            by.setdefault(k, []).append((n is None, -(n or 0), i, b, n))
    assert len(found) == sum(map(len, by.values())) and out.columns == [*df.columns, "group_size", "_best", "s"]
    for i, k, _b, n, size, best, s in found:
        assert size == len(by[k]) and s == (sum(x[4] for x in by[k] if x[4] is not None) if any(x[4] is not None for x in by[k]) else None)
        assert not best or (n is None, -(n or 0), i) == min(x[:3] for x in by[k])
    assert sum(x[5] for x in found) == len(by)
    parts = groups.with_groups(df, ["k"], [F.asc("id")], ["b"])
    assert parts.where("_best").count() == len({(k, b) for _, k, b, _ in data if k is not None})
    assert groups.with_groups(df.limit(0), ["k"], [F.asc("id")]).count() == 0


def test_a_key_with_half_of_the_rows_spreads(spark):
    n = 40_000
    df = spark.range(0, n, 1, 8).select("id", F.when(F.col("id") % 2 == 0, "default").otherwise((F.col("id") % 9000).cast("string")).alias("k"))
    out = dedup.keep_best(df, ["k"], [F.asc("id")])
    sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < n / 3 and out.where("k = 'default'").count() == n // 2 and rows(out.where("k = 'default' and decision = 'keep'").select("id")) == [(0,)]


def test_report_by_pieces(spark, tmp_path):
    """Quotes, braces, backslashes and nested objects in a report, in one line and in many, split at every few bytes."""
    r = random.Random(6)
    odd = ['a"b', "c}d{", "e\\", "\\\\", "\\\"}", "日本{", "", "][", '"},{"path":"no"}', "\n"]
    report = {str(s): [[{"path": r.choice(odd) + str(r.randrange(30)), "size": s - 3, "hash": r.choice(odd), "z": {"deep": [{"x": "}"}]}} for _ in range(r.randrange(5))] for _ in range(r.randrange(4))] for s in (1, 20, 300, 4000)}
    report["7"] = []
    want = set()
    for s, found in report.items():
        for g, members in enumerate(found):
            if len({m["path"] for m in members}) > 1:
                want |= {(f"{s}#{g}", m["path"], max(0, m["size"]), m["hash"]) for m in members}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for i, (indent, size) in enumerate(((None, "64"), (2, "100"), (None, before))):
            path = tmp_path / f"r{i}.json"
            path.write_text(("\ufeff" if i == 1 else "") + json.dumps(report, indent=indent, ensure_ascii=i == 0) + "\n" * i)
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert set(rows(jsonl.hash_report(spark, str(path)).select("group_id", "path", "size", "hash"))) == want, i
        (tmp_path / "none.json").write_text("{}")
        assert jsonl.hash_report(spark, str(tmp_path / "none.json")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_moves_survive_a_lost_task(spark, tmp_path):
    """A first attempt that moved half of the files and was lost: the log is the one of an undisturbed run, and no file is moved twice."""

    def disk(name):
        folder = tmp_path / name
        folder.mkdir()
        for i in range(8):
            (folder / f"s{i}").write_text(str(i))
        (folder / "taken.ts").write_text("old")
        (folder / "taken__dup2.ts").write_text("old")
        return str(folder)

    plan = [(str(i), f"D:\\s{i}", f"D:\\d{i}.ts") for i in range(5)] + [("5", "D:\\s5", "D:\\taken.ts"), ("6", "D:\\s6", "D:\\TAKEN.ts"), ("7", "D:\\none", "D:\\x"), ("8", "D:\\s7", "D:\\d__dup")]
    df = spark.createDataFrame(plan, "path_id string, src string, dst string")
    logs = []
    for name in ("whole", "lost"):
        folder = disk(name)
        place = lambda p, folder=folder: f"{folder}/" + p[3:].replace("TAKEN", "taken")
        exists = lambda p, place=place: os.path.exists(place(p))

        def move(a, b, place=place):
            assert not os.path.exists(place(b))
            os.rename(place(a), place(b))

        intents = moves.intend_moves(df, exists, rename=True)
        if name == "lost":
            for r in intents.where("error is null and path_id % 2 = 1").collect():
                move(r.src, r.dst)
        logs.append(rows(moves.carry_out(intents, move, exists)))
        assert {(folder_file, open(f"{folder}/{folder_file}").read()) for folder_file in os.listdir(folder) if folder_file.startswith("taken")} == {("taken.ts", "old"), ("taken__dup2.ts", "old"), ("taken__dup1.ts", "5"), ("taken__dup3.ts", "6")}
    assert logs[0] == logs[1] and [x[0] for x in logs[0] if not x[3]] == ["7"]


def test_rule_files_as_tables(spark, tmp_path):
    one, two = tmp_path / "1.yaml", tmp_path / "2.yaml"
    one.write_text("\ufeffhints:\n- canonical_title: T\n  aliases: [' A  b ', c]\nrules:\n- match: {regex: x}\n  set: {program_title: R}\n- match: {regex: y, field: path}\n  set: {program_title: S}\n  enabled: false\n")
    two.write_text("hints:\n- canonical_title: U\n  aliases: [C]\n- canonical_title: V\nrules:\n- franchise: F\n  title_patterns: [p, 3, q]\n- franchise: G\n")
    texts = rules.files(spark, [str(one), str(two), str(tmp_path / "none.yaml")])
    found = rules.rows(texts)
    assert rows(rules.alias_table(found)) == [("a b", "T"), ("c", "U"), ("t", "T"), ("u", "U"), ("v", "V")] and texts.where("text is null").count() == 1
    aliases, ordered, _ = rules.hints([str(one)])
    assert rows(rules.alias_table(found.where("file = 0"))) == sorted(aliases.items())
    assert rows(rules.rule_table(found).select("regex", "field", "title")) == [(r["regex"], r["field"], r["title"]) for r in ordered]
    assert rows(rules.franchise_table(found).select("franchise", "pattern")) == [("F", "p"), ("F", "q")]
    lists = spark.createDataFrame([(0, "a:\n- x\n# no\n- 'y z'\nb: 5\n"), (1, None), (2, "")], "file int, text string")
    assert rows(rules.rows(lists, lists=True).select("file", "place", "name", "value")) == [(0, 0, "a", "x"), (0, 1, "a", "y z")]
    with pytest.raises(Exception, match="line 1"):
        rules.rows(spark.createDataFrame([(0, "- orphan")], "file int, text string"), lists=True).collect()


def test_reviews_in_parts(spark, tmp_path):
    folder = str(tmp_path / "titles")
    stats = spark.createDataFrame([(f"番組: {i}", 9 - i, 1, f"c{i}", ["#x", "- y"]) for i in range(9)] + [("UNKNOWN", 9, 1, "c", [])], "program_title string, n_rows long, n_review long, cohort string, samples array<string>")
    reviews.title_parts(stats, folder)
    assert rows(reviews.title_rows(spark, folder)) == [(f"番組: {i}", f"番組: {i}", f"c{i}") for i in range(9)]
    parts = sorted(p for p in os.listdir(folder) if p.startswith("part"))
    text = open(f"{folder}/{parts[0]}", encoding="utf-8").read()
    assert text.startswith("- canonical_title: ")
    edited = text.replace("aliases:\n  - '番組: 0'", "aliases:\n  - zero\n  - null")
    assert edited != text
    with open(f"{folder}/{parts[0]}", "w", encoding="utf-8") as f:
        f.write(edited)
    for crc in os.listdir(folder):
        if crc.endswith(".crc"):
            os.unlink(f"{folder}/{crc}")
    assert ("zero", "番組: 0", "c0") in rows(reviews.title_rows(spark, folder))
    groups_folder = str(tmp_path / "groups")
    plan = spark.createDataFrame([(f"g{i % 3}", str(i), "p", i, "drop" if i % 3 else "keep") for i in range(12)], "group_key string, path_id string, path string, size_bytes long, decision string")
    reviews.group_parts(dedup.review_groups(plan), groups_folder)
    assert rows(reviews.group_rows(spark, groups_folder)) == sorted((f"g{i % 3}", str(i), "drop") for i in range(12) if i % 3)


def test_runs_as_tables(spark, tmp_path):
    for i in range(4):
        gates = {"g": {"id": "g", "type": "review", "status": "open" if i % 2 else "resolved", "artifact_ids": ["a", "gone"]}}
        (tmp_path / f"r{i}.json").write_text(json.dumps({"run_id": f"r{i}", "flow": "f", "phase": "p", "gates": gates, "artifacts": {"a": {"id": "a"}}, "other": 1}))
        os.utime(tmp_path / f"r{i}.json", (1000 + i // 2, 1000 + i // 2))
    held = runs.manifests(spark, str(tmp_path))
    assert [(r.run_id, r.place) for r in runs.recent(held, 3).orderBy("place").collect()] == [("r2", 1), ("r3", 2), ("r0", 3)]
    assert rows(runs.gates(held).select("run_id", "gate", "artifact_id")) == [(f"r{i}", "g", a) for i in (1, 3) for a in ("a", "gone")]
    assert rows(runs.dangling(held)) == [(f"r{i}", "g", "gone") for i in range(4)]
    logs = spark.createDataFrame([(f"a{i}", 100 + i, False) for i in range(5)] + [("ab1", 1, False), ("z", 1, False), ("p1", 1, True), ("p2", 10**7, True)], "name string, t long, packed boolean").select("name", F.timestamp_seconds("t").alias("mtime"), "packed")
    actions = runs.archive_actions(logs, spark.createDataFrame([("a", 2), ("ab", 0)], "prefix string, keep int"), F.timestamp_seconds(F.lit(10**7)), 30)
    assert {r.name: r.action for r in actions.collect()} == {"a4": "keep", "a3": "keep", "a2": "pack", "a1": "pack", "a0": "pack", "ab1": "pack", "z": "pack", "p1": "delete", "p2": "leave"}

    def fail(name):
        if name == "p1":
            raise OSError("no")

    assert rows(runs.act(actions, {"delete": fail}).where("not ok")) == [("p1", "delete", False, "no")]


def test_plan_functions_by_column(spark):
    n = [(a, b, c, d) for a in (0, 2) for b in (0, 1) for c in (0, 1) for d in (0, 3)]
    df = spark.createDataFrame(n, "a int, b int, c int, d int")
    assert [r.o for r in df.select(moves.outcomes(*map(F.col, "abcd")).alias("o")).collect()] == [moves.outcome(*x) for x in n]
    g = [(a, b, c, d) for a in (True, False) for b in (0, 1) for c in (0, 1) for d in (True, False)]
    df = spark.createDataFrame(g, "a boolean, b int, c int, d boolean")
    assert [r.o for r in df.select(review.refusal(*map(F.col, "abcd")).alias("o")).collect()] == [review.gate(*x) for x in g]
    given = [["MP4", ".ts", " mp4 ", "", None], [".M2TS", "avi"], []]
    df = spark.createDataFrame([(x,) for x in given], "x array<string>")
    assert [r.o for r in df.select(files.extension_set(F.col("x")).alias("o")).collect()] == [files.extensions(x) for x in given]
    names = ["/x/llm_filename_extract_output_0001.jsonl", "/x/rows.jsonl", "a.b.jsonl", "/x.y/none", "/x/llm_filename_extract_output_7.txt", ".hidden"]
    df = spark.createDataFrame([(x,) for x in names], "x string")
    assert [r.o for r in df.select(reviews.output_names(F.col("x")).alias("o")).collect()] == [reviews.output_name(x) for x in names]
    pairs = {"d": "e", "F:": "g:\\", " ": "x", "x": "y/"}
    df = spark.createDataFrame([("D:\\a",), ("f:\\b",), ("Q:\\c",), (None,)], "p string")
    out = reconcile.remap_drives(df, "p", spark.createDataFrame(list(pairs.items()), "new string, old string"))
    assert rows(out) == rows(df.withColumn("old_path", reconcile.remap_drive(F.col("p"), pairs)))


def test_driver_helpers():
    """The small functions for one value, which the columns above follow."""
    assert files.extensions(["MP4", ".ts", " mp4 ", ""]) == [".mp4", ".ts"] and files.extensions([".M2TS", "avi"]) == [".avi", ".m2ts"]
    assert reconcile.drive_map({"d": "e", "F:": "g:\\"}) == {"D:": "E:", "F:": "G:"} and reconcile.drive_map({" ": "x"}) == {} and reconcile.drive_map({"x": "y/"}) == {"X:": "Y:"}
    assert [reviews.output_name(x) for x in ("/x/llm_filename_extract_output_0001.jsonl", "/x/rows.jsonl", "a.b.jsonl")] == ["/x/program_aliases_review_0001.yaml", "/x/rows_review.yaml", "a.b_review.yaml"]
    assert [moves.outcome(*x) for x in ((1, 0, 0, 0), (0, 1, 0, 0), (5, 0, 2, 0), (0, 0, 0, 2), (0, 0, 0, 0), (3, 0, 0, 4))] == ["plan_ready", "review_required", "review_required", "metadata_missing", "nothing_to_do", "plan_ready"]
    assert [review.gate(*x) for x in ((True, 1, 0, False), (False, 0, 0, False), (False, 2, 1, False), (False, 2, 1, True), (False, 2, 0, False))] == ["raw_extraction_file", "no_changes", "rows_still_need_review", None, None]
    assert rules.simple_lists("a:\n- x\n- 'y z'\nb: 5\n") == {"a": ["x", "y z"], "b": []} and rules.simple_lists("a:\n- x\n- 'y z'\nb: 5\n", True) == {"a": ["x", "y z"], "b": 5}
    assert rules.simple_lists('# c\nk:\n  - "q"\n\nk2: text\n') == {"k": ["q"], "k2": []} and rules.simple_lists('# c\nk:\n  - "q"\n\nk2: text\n', True) == {"k": ["q"], "k2": "text"}
    for text, scalars in (("- orphan", False), ("- orphan", True), ("a: 1\n- x", False), ("a: 1\n- x", True)):
        with pytest.raises(ValueError):
            rules.simple_lists(text, scalars)


def test_candidates_meet_once_for_each_list(spark, monkeypatch):
    """Repeated titles go before the join and ids with the same keys share a list: no step has more rows than the result; ids of several rows and null keys keep their candidates."""
    from tapewright.operators import extract

    made = {}
    plain = extract.written
    monkeypatch.setattr(extract, "written", lambda df, label: made.setdefault(label, plain(df, label)))
    entries = [("a", "x", f"n{i % 3}", i) for i in range(300)] + [("a", "y", "n9", 5), ("a", None, "n8", 1), ("b", "7", "n1", 0), ("b", "7", "m", 2)]
    asks = [(i, "x", "7" if i % 2 else None) for i in range(400)] + [(1000, "y", None), (1000, "x", "7"), (None, None, "7"), (1001, None, None)]
    dictionary = spark.createDataFrame(entries, "kind string, key string, norm string, at int")
    out = extract.candidates(spark.createDataFrame(asks, "id int, a string, b string"), "id", ["a", "b"], dictionary, "norm", "at", at_once=50)
    want = set()
    for i in {x[0] for x in asks}:
        found = {}
        for p, k, norm, at in sorted((p, *e[1:]) for asked in asks if asked[0] == i for p, kind in enumerate("ab") for e in entries if e[0] == kind and e[1] is not None and e[1] == asked[p + 1] for e in [(kind, e[3], e[2], e[3])]):
            found.setdefault(norm, (p, at, norm))
        want |= {(i, norm, at, n) for n, (p, at, norm) in enumerate(sorted(found.values()), 1)}
    rows = [tuple(r) for r in out.select("id", "norm", "at", "place").collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert made["entries"].count() == 6 and made["found"].count() < 20
    assert max(r["_slices"] for r in made["sizes"].collect()) > 5


def test_candidates_keep_no_row_for_each_list_and_entry(spark, monkeypatch):
    """Lists that share a key share its entries: what is kept grows with ids and entries, not with their product, and blocks go to a bounded number of slices. Titles found again, by whichever of three keys, keep places gapless."""
    import random

    from tapewright.operators import extract

    made = {}
    plain = extract.written
    monkeypatch.setattr(extract, "written", lambda df, label: made.setdefault(label, plain(df, label)))
    rng = random.Random(5)
    entries = [("a", "x", f"n{i}", i) for i in range(600)] + [("b", str(i), f"n{i}" if i % 2 else f"m{i}", i) for i in range(120)]
    entries += [(k, rng.choice("uvw"), rng.choice([None, *(f"t{j}" for j in range(40))]), 1000 + i) for i in range(400) for k in [rng.choice("abc")]]
    asks = [(i, "x", str(i % 120), None) for i in range(360)] + [(1000 + i, *(rng.choice(["u", "v", "w", "none", None]) for _ in range(3))) for i in range(60)] + [(1000, "u", "v", "w"), (None, "u", None, "v"), (1, "x", "1", None)]
    dictionary = spark.createDataFrame(entries, "kind string, key string, norm string, at int")
    out = extract.candidates(spark.createDataFrame(asks, "id int, a string, b string, c string"), "id", ["a", "b", "c"], dictionary, "norm", "at", at_once=1, share=8)
    want = []
    for i in {x[0] for x in asks}:
        found = {}
        for p, at, norm in sorted({(p, at, norm) for asked in asks if asked[0] == i for p, kind in enumerate("abc") for k, key, norm, at in entries if (k, key) == (kind, asked[p + 1])}, key=lambda x: x[:2]):
            found.setdefault(norm, (at, norm))
        want += [(i, norm, at, n) for n, (at, norm) in enumerate(found.values(), 1)]
    rows = [tuple(r) for r in out.select("id", "norm", "at", "place").collect()]
    assert sorted(rows, key=str) == sorted(want, key=str) and len(rows) > 200_000
    kept = {label: df.count() for label, df in made.items()}
    assert sum(kept.values()) < 3 * (len(asks) + len(entries)), kept
    sizes = [r["_slices"] for r in made["sizes"].collect()]
    assert 2 < max(sizes) and sum(sizes) <= 8 + 1 + len(sizes)


def test_rule_files_are_read_item_by_item(spark):
    """Rules come out of a file without an end, whatever piece they begin in; values are PyYAML's."""
    import yaml

    from tapewright.sources import yamls

    def endless(text):
        yield "﻿rules:\n- match: {regex: é"
        while True:
            yield text

    found = rules._parsed(endless("}\n  set: {program_title: 'a'}\n- match: {regex: é"))
    assert [next(found) for _ in range(50)] == [("rule", "é", "a", "base")] * 50
    text = "- &a {k: 1, t: [yes, ~, 0x1F, 2.5, 'no', 2020-01-01]}\n- {<<: *a, k: 3}\n- *a\n- |\n  x\n   y\n- !!set {p, q}\n- \"m\n- n\"\n- - []\n  - {}\n"
    for n in (1, 7, 1000):
        assert list(yamls.items(text[i : i + n] for i in range(0, len(text), n))) == yaml.safe_load(text)
    for bad in ("a: 1", "- *x", "- a\n---\n- b", "- [a", "- &a x\n- &a y", "- !foo x"):
        with pytest.raises((ValueError, yaml.YAMLError)):
            list(yamls.items(iter([bad])))
    long = "rules:\n" + "- match: {regex: '^😀x'}\n  set: {program_title: T}\n" * 8000
    assert rules.rows(spark.createDataFrame([(0, long), (1, None), (2, "")], "file int, text string")).groupBy("file", "name", "value").count().collect() == [(0, "^😀x", "T", 8000)]


def test_review_parts_are_bounded(spark, tmp_path):
    """Parts end at a number of characters too; items longer than that stand alone, and all is read back."""
    import yaml

    folder = str(tmp_path / "parts")
    given = [{"group_key": f"g{i:03}", "candidates": [{"path_id": f"p{j}\n'x", "decision": "keep"} for j in range(200 if i == 50 else 3)]} for i in range(300)]
    reviews.write_parts(spark.createDataFrame(given, "group_key string, candidates array<struct<path_id:string,decision:string>>").coalesce(1), folder, rows=100, chars=3000)
    texts = [(tmp_path / "parts" / n).read_text() for n in sorted(os.listdir(folder)) if n.startswith("part")]
    assert len(texts) > 10 and sorted(map(len, texts))[-2] <= 3001
    assert [x for t in texts for x in yaml.safe_load(t)] == given
    assert rows(reviews.group_rows(spark, folder)) == sorted(((g["group_key"], c["path_id"], c["decision"]) for g in given for c in g["candidates"]), key=str)
