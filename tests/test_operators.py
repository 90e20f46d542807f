"""Merges, decisions, plans, sources and the control plane: properties and edge cases beyond the queries."""

import gzip
import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tapewright.functions import keys
from tapewright.operators import catalog, dedup, extract, ingest as batches, merge, reconcile, resolve, review
from tapewright.plans import moves, snapshots, workflow
from tapewright.sources import files, guide, jsonl, rules
from tapewright.streaming import ingest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 0), (None, "n", 0)], "k int, v string, human_reviewed int").withColumn("source", F.lit("llm"))
    b = spark.createDataFrame([(1, "x", 0), (2, "y", 0), (3, "z", 0), (None, "m", 0)], "k int, v string, human_reviewed int").withColumn("source", F.lit("llm"))
    once = merge.upsert(t, b, ["k"], guard=merge.reviewed_guard)
    assert rows(once) == rows(merge.upsert(once, b, ["k"], guard=merge.reviewed_guard))
    assert {r.k: r.v for r in once.collect()} == {1: "a", 2: "y", 3: "z", None: "m"}
    human = b.withColumn("source", F.lit("human_reviewed"))
    assert {r.k: r.v for r in merge.upsert(t, human, ["k"], guard=merge.reviewed_guard).collect()}[1] == "x"
    assert {r.k: r.v for r in merge.upsert(t, human, ["k"], guard=merge.strict_guard).collect()}[1] == "a"


def test_collision_merges_histories(spark):
    schema = "path_id int, human_reviewed int, updated_at string, title string, source_history array<string>"
    dst = spark.createDataFrame([(1, 0, "2", "d", ["a", "b"]), (2, 1, "1", "d", None), (3, 0, "2", "d", ["a"])], schema)
    src = spark.createDataFrame([(1, 0, "3", "s", ["b", "c"]), (2, 0, "9", "s", ["c"]), (3, 0, "2", "s", ["a"]), (4, 0, "1", "s", ["z"])], schema)
    got = {r.path_id: (r.title, r.source_history) for r in merge.merge_on_collision(src, dst, "path_id").collect()}
    assert got == {1: ("s", ["a", "b", "c"]), 2: ("d", ["c"]), 3: ("d", ["a"]), 4: ("s", ["z"])}


def test_publish_replaces(spark, tmp_path):
    folder = str(tmp_path / "t")
    for n in (3, 5):
        snapshots.publish(spark.range(n), folder)
        assert snapshots.read(spark, folder).count() == n
    # A version that was written and not pointed at, as after a crash, is not read; backups name versions and outlive new ones.
    spark.range(99).write.parquet(f"{folder}/version=lost")
    assert snapshots.read(spark, folder).count() == 5
    snapshots.backup(spark, folder, "20240102_030405", "pre_apply")
    snapshots.publish(spark.range(7), folder)
    snapshots.restore(spark, folder, "bak_20240102_030405_pre_apply", "20240102_030406")
    assert snapshots.read(spark, folder).count() == 5
    assert [(b["created_at"], b["descriptor"]) for b in snapshots.backups(spark, folder)] == [("20240102_030406", "pre_restore"), ("20240102_030405", "pre_apply")]
    assert snapshots.rotate(spark, folder, 1) == ["bak_20240102_030405_pre_apply"] and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version=")]) == 2
    with pytest.raises(ValueError):
        snapshots.restore(spark, folder, "bak_none", "20240102_030407")


def test_reconstruct_undoes_split(spark):
    df = spark.createDataFrame([('{"a":"1","b":"x","c":"2"}',), ("{}",), ("bad",)], "data_json string")
    back = catalog.reconstruct(catalog.promote(df, ["a", "b"]), ["a", "b"]).collect()
    assert [(r.a, r.b, r.data_json) for r in back] == [("1", "x", '{"c":"2"}'), (None, None, "{}"), (None, None, "{}")]


def test_latest_row_wins_over_json(spark):
    df = spark.createDataFrame([('{"needs_review":"1"}', "0")], "data_json string, needs_review string")
    assert catalog.reconstruct(df, ["needs_review"]).first().needs_review == "0"


def test_two_phase_keeps_claims(spark):
    data = [(1, "h", "k", 5), (2, "h", "k", 9), (3, None, "k", 7), (4, "z", "k", 1), (5, "y", None, 1)]
    want = [(1, "drop", "hash_exact"), (2, "keep", "hash_exact"), (3, "keep", "metadata"), (4, "drop", "metadata")]
    for some in itertools.islice(itertools.permutations(data), 0, 120, 37):
        df = spark.createDataFrame(list(some), "id int, h string, k string, n int")
        assert rows(dedup.two_phase(df, "h", "k", [F.desc("n"), F.asc("id")], ["id"]).drop("auto_apply")) == want


def test_prefix_explosion_equals_theta_join(spark):
    r = random.Random(1)
    titles = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(150)})
    df = spark.createDataFrame([(t,) for t in titles], "norm string")
    assert {x.norm for x in resolve.prefix_family(df, "norm").collect()} == {a for a in titles if len(a) >= 4 and any(b != a and b.startswith(a) for b in titles)}
    got = {x.norm: x.title for x in resolve.longest_prefix(df, "norm", "norm", df.select("norm", F.col("norm").alias("title")), extra=3).collect()}
    for t in titles:
        assert got.get(t) == max((d for d in titles if t.startswith(d) and len(t) >= len(d) + 3), key=len, default=None)


def test_contained_small_and_large_dictionaries(spark):
    df = spark.createDataFrame([(1, "the red fox"), (2, "nothing"), (3, "foxred")], "id int, norm string")
    words = spark.createDataFrame([("red", "Red"), ("the red", "The Red"), ("fox", "Fox"), ("x", "X")], "norm string, title string")
    want = [(1, "The Red"), (3, "Fox")]
    assert rows(resolve.longest_contained(df, "id", "norm", words)) == rows(resolve.longest_contained(df, "id", "norm", words, shard_bytes=30)) == want


def test_series_name(spark):
    aliases = spark.createDataFrame([("my_show", "The Show"), ("other", "Other")], "alias string, canonical string")
    titles = {"My Show": "The Show", "my show 第3話 x": "The Show", "Other▽sub": "Other", "none": "none", "a▼b": "a", "▽x": "▽x", " ": "UNKNOWN"}
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r.t: r.series for r in resolve.series_name(df, "t", aliases).collect()} == titles


def test_separator_suggestion(spark):
    df = spark.createDataFrame([("A▽b", None, None), ("A", None, None), ("A▽b", "X", "human")], "title string, suggested string, match_source string")
    assert rows(resolve.with_separator(df, "title").select("suggested", "match_source")) == sorted([("A", "separator_split"), (None, None), ("X", "human")], key=str)


def test_case_renames(spark):
    df = spark.createDataFrame([("B:\\lib\\SHOW\\x\\a.mp4", "B:\\Lib\\Show\\x\\a.mp4"), ("B:\\q\\a", "B:\\r\\a")], "now string, want string")
    assert [(r.src, r.dst) for r in reconcile.case_renames(df, "now", "want").collect()] == [("B:\\lib", "B:\\Lib"), ("B:\\Lib\\SHOW", "B:\\Lib\\Show")]
    assert reconcile.remap_drive(F.lit("x"), {}) is not None and reconcile.drive_map({"d:\\": "e"}) == {"D:": "E:"}


def test_hints_and_locked_rows(spark):
    old = spark.createDataFrame([(1, "h", 1), (2, "o", 0)], "id int, title string, human_reviewed int")
    new = spark.createDataFrame([(1, "n"), (2, "m"), (3, "p")], "id int, title string")
    assert {r.id: r.title for r in extract.keep_locked(new, old, "id").collect()} == {1: "h", 2: "m", 3: "p"}


def test_extraction_rows(spark):
    rows = [
        ("Show 2024_01_02_21_00.mp4", "p", "D", None, None, None, None, None), ("番組▽副.mp4", "p", None, None, None, None, None, "2024-05-06T00:00:00+00:00"), (".mp4", "p", None, None, None, None, None, None),
        ("abc 2024_01_02_21_00.mp4", "B:\\by_program\\abc\\x", None, "abc 12345678", None, "abc 12345679", "human", None), ("塚原卜伝.mp4", "p", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "name string, path string, d string, r string, g string, s string, ms string, m string")
    a, b, c, d, e = extract.build_rows(df, name="name", path="path", dictionary_title="d", rule_title="r", guide_title="g", suggested="s", match_source="ms", mtime="m").collect()
    assert (a.program_title, a.air_date, a.confidence, a.needs_review) == ("D", "2024-01-02", 0.92, False)
    assert (b.air_date, b.needs_review_reason, b.confidence, b.needs_review) == ("2024-05-06", "air_date_from_mtime,subtitle_separator_in_program_title", 0.65, True)
    assert c.needs_review and "missing_air_date" in c.needs_review_reason
    assert (d.program_title, d.needs_review_reason, d.confidence) == ("abc 12345679", "auto_corrected_from_human,program_title_may_include_description", 0.65)
    assert (e.program_title, e.needs_review, e.confidence) == ("塚原卜伝", False, 0.78)


def test_review_gate_and_first_failures(spark):
    assert [review.gate(True, 1, 0, False), review.gate(False, 0, 0, False), review.gate(False, 1, 1, False), review.gate(False, 1, 1, True)] == ["raw_extraction_file", "no_changes", "rows_still_need_review", None]
    log = spark.createDataFrame([(i, i % 2 == 0, f"io: {i}") for i in range(100)], "i int, ok boolean, error string")
    totals, kinds, first = moves.apply_stats(log, "i")
    assert tuple(totals.first()) == (100, 50, 50, True) and rows(kinds) == [("io", 50)] and [r.i for r in first.collect()] == list(range(1, 40, 2))


def test_limits_count_only_what_the_loop_saw(spark):
    plan = spark.createDataFrame([(i, None if i % 3 == 0 else "x") for i in range(30)], "i int, skip_reason string")
    assert [r.i for r in moves.until_planned(plan, "i", 4).orderBy("i").collect()] == list(range(10))
    assert moves.until_planned(plan, "i", 99).count() == 30


def test_routes(tmp_path, spark):
    (tmp_path / "r.yaml").write_text("default_dest: D:\\\nroutes:\n- genre: g\n  dest_root: E:\\x\\\n  layout: by_series\n  epg_genre_match: ['A - *']\n- {dest_root: q}\n")
    found = rules.routes(str(tmp_path / "r.yaml"))
    assert len(found.routes) == 1 and found.routes[0].epg_genre_match == ("A - *",)
    df = spark.createDataFrame([("T", "2024-01-02", "a.mp4", ["A - b"]), ("T", "bad", "a.mp4", ["B"]), ("T", "2024-01-02", "a.mp4", [])], "t string, d string, n string, g array<string>")
    to = moves.destination(found, moves.route_index(found, F.lit(None).cast("string"), F.col("g"), F.col("t")), F.col("t"), F.col("d"), F.col("n"))
    assert [tuple(r[0]) for r in df.select(to).collect()] == [("E:\\x\\T\\a.mp4", "g", None), (None, "default", "invalid_air_date"), ("D:\\T\\2024\\01\\a.mp4", "default", None)]


def test_genres_and_franchises(spark):
    df = spark.createDataFrame([(None, [("スポーツ", "アニメ特集")], "x"), ("own", None, "x"), (None, None, "映画の日"), (None, None, "x")], "g string, e array<struct<category:string,subcategory:string>>, t string")
    assert [r[0] for r in df.select(moves.genre(F.col("g"), F.col("e"), F.col("t"))).collect()] == ["アニメ", "own", "映画", None]
    df = spark.createDataFrame([("A gundam", "q"), ("x", "B:\\シリーズ_Y\\a"), ("x", "y")], "t string, p string")
    assert [r[0] for r in df.select(moves.franchise(F.col("t"), F.col("p"), [("G", ["gundam"])])).collect()] == ["G", "シリーズ_Y", None]


def test_rule_files(tmp_path):
    text = "# c\nterrestrial_keywords:\n- 'NHK'\n- b c\nbs_cs_keywords:\n- BS\nother: 5\n"
    (tmp_path / "b.yaml").write_text(text)
    assert rules.buckets(str(tmp_path / "b.yaml")) == {"terrestrial": ["NHK", "b c"], "bs_cs": ["BS"]}
    assert rules.simple_lists(text, scalars=True)["other"] == 5 and rules.simple_lists(text)["other"] == []
    with pytest.raises(ValueError):
        rules.simple_lists("- x")
    (tmp_path / "h.yaml").write_text("hints:\n- canonical_title: T\n  aliases: [ A  b ]\nrules:\n- match: {regex: x}\n  set: {program_title: T}\n- match: {regex: y}\n  set: {program_title: T}\n  enabled: false\n")
    aliases, ordered, seen = rules.hints([str(tmp_path / "h.yaml"), str(tmp_path / "none")])
    assert aliases == {"t": "T", "a b": "T"} and len(ordered) == 1 and seen == {"loaded": 1, "missing": 1}


SIDECAR = "﻿2024/01/02(火) 25:10～26:00\nＮＨＫ総合\n番組名[字][再] 第1話\n\n説明文\n\n詳細情報\n- 出演\nだれか\n\nジャンル : \nアニメ／特撮 - 国内アニメ\nその他\n\n映像 : 1080i\n\nOriginalNetworkID:32736(0x7FE0)\nServiceID:1024\n"


def test_guide_sidecars(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.program.txt").write_text(SIDECAR)
    (tmp_path / "d" / "b.program.txt").write_text("x\ny\n")
    (tmp_path / "d" / "c.txt").write_text(SIDECAR)
    out = {r.path.rsplit("/", 1)[1]: r.guide for r in guide.parse(guide.find(spark, str(tmp_path))).collect()}
    g = out["a.program.txt"]
    assert set(out) == {"a.program.txt", "b.program.txt"} and out["b.program.txt"] is None
    assert (g.air_date, g.start_time, g.end_time, g.broadcaster, g.official_title, g.annotations, g.is_rebroadcast_flag) == ("2024-01-02", "25:10", "26:00", "NHK総合", "番組名 第1話", ["字", "再"], True)
    assert g.description == "説明文" and g.detail_sections == {"出演": "だれか"} and g.network_ids == {"OriginalNetworkID": 32736, "ServiceID": 1024}
    assert [tuple(x) for x in g.epg_genres] == [("アニメ/特撮", "国内アニメ"), ("その他", "")]
    df = spark.createDataFrame([("番組名[字][再] 第1話", ["A - b", "", "c", "ジャンル :"], ["ServiceID:7", "x"])], "t string, g array<string>, n array<string>")
    r = df.select(guide.title_line(F.col("t")).alias("t"), guide.genres(F.col("g")).alias("g"), guide.network_ids(F.col("n")).alias("n")).first()
    assert r.t.official_title == "番組名 第1話" and r.t.is_rebroadcast_flag and [tuple(x) for x in r.g] == [("A", "b"), ("c", "")] and r.n == {"ServiceID": 7}


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "q.jsonl")
    (tmp_path / "q.jsonl").write_text('﻿{"_meta": {"x": 1}}\n\n{"path_id": "a", "n": 1}\nnot json\n[1]\n{"n": 2}\n')
    schema = "path_id string, n int"
    assert rows(jsonl.tolerant(spark, path, schema)) == [("a", 1), (None, 2)] and tuple(jsonl.counts(spark, path).first()) == (4, 3, 1)
    with pytest.raises(Exception, match="path_id|MALFORMED|PARSE|Malformed"):
        jsonl.queue(spark, path, schema).collect()
    (tmp_path / "ok.jsonl").write_text('\ufeff{"_meta": {"x": 1}}\n\n{"path_id": "a", "n": 1}\n{"path_id": "b"}\n')
    assert rows(jsonl.queue(spark, str(tmp_path / "ok.jsonl"), schema)) == [("a", 1), ("b", None)]
    for n, text in enumerate(['{"path_id": "a"}\n{"_meta": {"x": 1}}\n', '\n{"_meta": {}}\n{"path_id": "a"}\n', '{"n": 1}\n']):
        (tmp_path / f"bad{n}.jsonl").write_text(text)
        with pytest.raises(Exception, match="queue row without path_id"):
            jsonl.queue(spark, str(tmp_path / f"bad{n}.jsonl"), schema).collect()
    out = str(tmp_path / "out")
    jsonl.write(spark.createDataFrame([("a", 1)], schema), out, {"kind": "queue"})
    assert rows(jsonl.strict(spark, out, schema)) == [("a", 1)] and json.loads((tmp_path / "out" / "_meta.json").read_text()) == {"_meta": {"kind": "queue"}}
    (tmp_path / "h.json").write_text(json.dumps({"10": [[{"path": "a", "size": -1, "hash": "h"}, {"path": "b", "size": 10, "hash": "h"}], [{"path": "c", "size": 1, "hash": "i"}]]}))
    assert rows(jsonl.hash_report(spark, str(tmp_path / "h.json")).select("path", "size")) == [("a", 0), ("b", 10)]


def test_listing(spark, tmp_path):
    for name, size in (("x/A.MP4", 3), ("x/a.mp4", 3), ("b.txt", 1), ("c.mp4", 0)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    got = files.listing(spark, [str(tmp_path)], ["mp4", ".MP4"], quick_hash=True).collect()
    assert sorted((r.name.lower(), r.size, r.corrupt_reason) for r in got) == [("a.mp4", 3, None), ("c.mp4", 0, "size_zero")] and all(len(r.quick_hash) == 40 for r in got)
    assert files.newest(files.listing(spark, [str(tmp_path)]), "b").first().path.endswith("b.txt")


def test_ingest_is_incremental(spark, tmp_path):
    src, table, state = (str(tmp_path / x) for x in ("src", "table", "state"))
    (tmp_path / "src").mkdir()
    run = lambda: ingest.ingest_new(spark, src, "k string, n int", table, "k", "n", state, 1)
    (tmp_path / "src" / "1.json").write_text('{"k": "a", "n": 2}\n{"k": "a", "n": 1}\n{"n": 9}\n')
    run()
    (tmp_path / "src" / "2.json").write_text('{"k": "a", "n": 3}\n{"k": "b", "n": 4}\n')
    run()
    run()
    assert rows(spark.read.parquet(table).select("k", "n")) == [("a", 1), ("b", 4), (None, 9)]
    (tmp_path / "state" / "commits" / "1").unlink()  # as if the second batch had written but not ended
    (tmp_path / "state" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert rows(spark.read.parquet(table).select("k", "n")) == [("a", 1), ("b", 4), (None, 9)]


def test_workflow(tmp_path):
    plan = tmp_path / "plan.jsonl"
    plan.write_text("x")
    run = workflow.Run("r1", "relocate")
    run.register("a1", "relocate_plan", str(plan), "dry_run", "t0")
    with pytest.raises(workflow.WorkflowError, match="duplicate_artifact"):
        run.register("a1", "relocate_plan", str(plan), "dry_run", "t0")
    with pytest.raises(workflow.WorkflowError, match="invalid_transition"):
        run.advance("applied", "t1")
    run.advance("plan_ready", "t1")
    run.open_gate("g1", "review", ["a1"], "t1")
    refused = lambda code, **k: pytest.raises(workflow.WorkflowError, match=code)
    with refused("blocking_gate"):
        run.check_apply("a1", "relocate", "relocate_plan")
    assert run.next_actions()[0]["action"] == "resolve_gate"
    run.resolve_gate("g1", "superseded", "t2", by="me")
    assert run.check_apply("a1", "relocate", "relocate_plan").id == "a1" and run.next_actions()[0]["action"] == "apply_plan"
    for args, code in ((("a1", "source_root", "relocate_plan"), "wrong_flow"), (("zz", "relocate", "relocate_plan"), "unknown_artifact"), (("a1", "relocate", "move_plan"), "wrong_artifact_type")):
        with refused(code):
            run.check_apply(*args)
    store = workflow.Store(str(tmp_path / "runs"))
    store.save(run)
    assert store.load("r1") == run and [r.run_id for r in store.recent()] == ["r1"] and store.inspect("r1", "a1", 10)["preview"] == "x"
    plan.write_text("y")
    with refused("checksum_mismatch"):
        run.check_apply("a1", "relocate", "relocate_plan")
    run.advance("applied", "t3")
    run.advance("complete", "t4")
    assert run.next_actions() == [] and set(workflow.TERMINAL) == {"complete", "failed", "blocked"}
    assert not workflow.allowed("created", "applied") and workflow.allowed("review_required", "metadata_accepted")


def test_scan_reports(spark, tmp_path):
    """Folders that can't be listed, files that can't be read, missing roots; levels of folders."""
    deep = tmp_path / "a" / "b" / "c"
    deep.mkdir(parents=True)
    (deep / "x.ts").write_bytes(b"123")
    (tmp_path / "a" / "empty.TS").write_bytes(b"")
    out = files.scan(spark, [str(tmp_path / "a"), str(tmp_path / "none"), str(deep / "x.ts")], [".ts"])
    kinds = {(r.kind, r.path.replace(str(tmp_path), "")): (r.size, r.corrupt_reason, r.code) for r in out.collect()}
    assert kinds[("file", "/a/b/c/x.ts")] == (3, None, None) and kinds[("file", "/a/empty.TS")] == (0, "size_zero", None)
    assert kinds[("error", "/none")][2] == "root_missing" and kinds[("error", "/a/b/c/x.ts")][2] == "root_not_directory" and ("folder", "/a/b/c") in kinds
    assert tuple(files.scan_summary(out).first()) == (2, 1, 2, 0, 2)


def test_two_phase_without_hashes(spark):
    """Rows without a hash or a key are in no group, and in no window."""
    df = spark.createDataFrame([(1, None, "k", 1), (2, None, "k", 2), (3, "h", "k", 3), (4, "h", None, 4), (5, None, None, 5), (6, None, None, 6), (7, "i", "k", 7)], "id int, h string, k string, size int")
    out = dedup.two_phase(df, "h", "k", [F.desc("size")], ["id"])
    assert {r.id: (r.decision, r.method, r.auto_apply) for r in out.collect()} == {3: ("drop", "hash_exact", True), 4: ("keep", "hash_exact", False), 7: ("keep", "metadata", False), 1: ("drop", "metadata", False), 2: ("drop", "metadata", False)}
    assert dedup.keep_best(df, ["h"], [F.desc("size")]).count() == 2


def test_positional_diff_of_null_content(spark):
    a = spark.createDataFrame([(0, None), (1, "x"), (2, None), (3, "y")], "i int, c string")
    b = spark.createDataFrame([(0, None), (1, None), (2, "z")], "i int, c string")
    assert {r.i: r.change for r in review.positional_diff(a, b, "i", F.col("c")).collect()} == {1: "changed", 2: "changed", 3: "added"}


def test_json_keeps_nested_values(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, null]}, "t": "x", "n": 1.5}',), ("bad",), (None,)], "data_json string")
    out = df.select(catalog.json_set(F.col("data_json"), {"k": F.lit(True)}, ["t"]).alias("s")).collect()
    assert [json.loads(r.s) for r in out] == [{"a": {"b": [1, None]}, "n": 1.5, "k": True}, {"k": True}, {"k": True}]
    assert json.loads(catalog.promote(df, ["t"]).first().data_json) == {"a": {"b": [1, None]}, "n": 1.5}


def test_title_patterns_like_the_nested_loop(spark):
    """Anchored and free patterns give what LIKE over all pairs gives."""
    r = random.Random(9)
    paths = [(i, "D:\\" + "".join(r.choice("aB_%x") for _ in range(r.randint(0, 6)))) for i in range(300)]
    rules = sorted({("".join(r.choice(["d:\\", "a", "b", "%", "_", "~_", "~%", "x"]) for _ in range(r.randint(1, 4))), f"T{i}") for i in range(40)})
    df = spark.createDataFrame([(i, p, "old", "llm", 0, 1) for i, p in paths], "path_id int, path string, program_title string, source string, human_reviewed int, needs_review int")
    changes = spark.createDataFrame(rules, "path_pattern string, new_title string")
    brute = df.join(changes, F.expr("path ilike path_pattern escape '~'")).groupBy("path_id").agg(F.min_by("new_title", F.struct("path_pattern", "new_title")).alias("t"))
    want = {x.path_id: x.t for x in brute.collect()}
    changes = changes.groupBy("path_pattern").agg(F.min("new_title").alias("new_title"))
    got = {x.path_id: x.program_title for x in moves.title_updates(df, changes).collect()}
    assert got == {i: want.get(i, "old") for i, _ in paths} and len(want) > 50


def test_backup_names_and_follow_ups(tmp_path):
    plan = tmp_path / "p"
    plan.write_text("x")
    run = workflow.Run("r", "relocate")
    run.register("q", "relocate_metadata_queue", str(plan), "dry_run", "t")
    run.phase = "review_required"
    assert run.follow_ups()[0]["params"] == {"runId": "r", "artifactIds": ["q"]} and run.follow_ups()[0]["action"] == "prepare_relocate_metadata"
    run.open_gate("g", "relocate_metadata_review", ["q"], "t")
    assert run.follow_ups()[0]["action"] == "review_relocate_metadata" and run.follow_ups()[0]["requires_human"]
    run.phase = "complete"
    assert run.follow_ups() == []


def test_rotation(tmp_path):
    for i in range(5):
        (tmp_path / f"db-{i}").mkdir()
    assert workflow.rotate(str(tmp_path), "db-", 2) == ["db-2", "db-1", "db-0"]
    logs = tmp_path / "logs"
    logs.mkdir()
    for i, (name, day) in enumerate([("move_a_1", 1), ("move_a_2", 5), ("move_a_3", 5), ("move_b", 9), ("other", 50)]):
        (logs / f"{name}.jsonl").write_text(f"{i}")
        os.utime(logs / f"{name}.jsonl", (86_400 * day, 86_400 * day))
    (logs / "x.txt").write_text("x")
    out = workflow.archive_logs(str(logs), {"move_": 1, "move_a_": 2}, now=86_400 * 40, ttl_days=35)
    assert out == {"kept": ["move_a_2.jsonl", "move_a_3.jsonl", "move_b.jsonl"], "packed": ["move_a_1.jsonl", "other.jsonl"], "deleted": ["move_a_1.jsonl.gz"]}
    assert gzip.open(logs / "archive" / "other.jsonl.gz", "rt").read() == "4" and (logs / "x.txt").exists()


def test_ids_are_hashed_once(spark):
    ids = spark.range(1).select(keys.broadcast_id(F.col("id").cast("string"), F.concat(F.lit("s"), "id")).alias("b"))
    assert ids._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1


def test_legacy_guides_read_json_once(spark):
    data = ['{"official_title":"Show▽1","air_date":"2024-01-01"}', '{"program_title":"show","match_key":" k "}', '{"official_title":"show▽2","match_key":"k","air_date":"2024-01-03"}', "[]", None, '{"official_title":" "}']
    metadata = spark.createDataFrame([(f"p{i}", catalog.GUIDE_SOURCE, d) for i, d in enumerate(data)], "path_id string, source string, data_json string")
    aliases = spark.createDataFrame([], "alias string, canonical string")
    programs, casts = batches.legacy_guides(metadata, aliases, "now")
    assert rows(programs.select("program_key", "canonical_title")) == [("show", "show▽2")]
    assert rows(casts.select("match_key", "air_date", "official_title")) == [("k", "2024-01-03", "show▽2"), (None, "2024-01-01", "Show▽1")]
    assert "get_json_object" not in programs._jdf.queryExecution().optimizedPlan().toString()
