"""Flows made of the operators: ingest batches, repairs, review documents, the public calls."""

import pytest
from pyspark.sql import functions as F

from tapewright.operators import catalog, dedup, ingest, merge, review
from tapewright.plans import api, reviews, workflow
from tapewright.sources import guide


def empty(spark, table):
    return spark.createDataFrame([], catalog.SCHEMAS[table])


def test_inventory_to_paths(spark):
    listing = spark.createDataFrame([("/mnt/d/a/x.MP4", 5, "2"), ("D:\\a\\x.MP4", 4, "1"), ("d:/b/y.ts", 1, "1")], "path string, size long, mtime string")
    paths, seen = ingest.inventory_batches(listing, "r1", "t1")
    table = ingest.upsert_paths(empty(spark, "paths"), paths)
    again = ingest.upsert_paths(table, ingest.inventory_batches(listing, "r2", "t2")[0])
    assert {(r.path, r.ext, r.created_at, r.updated_at) for r in again.collect()} == {("D:\\a\\x.MP4", ".mp4", "t1", "t2"), ("D:\\b\\y.ts", ".ts", "t1", "t2")}
    assert sorted(r.size_bytes for r in seen.collect()) == [1, 5] and catalog.duplicate_keys(again, ["path_id"]).isEmpty()


def test_guides_are_ingested_once(spark):
    texts = [f"2024/01/0{d}(x) 21:00~22:00\nCh\nShow[{m}] one\n" for d, m in ((1, "字"), (2, "再"), (2, "再"))]
    guides = guide.parse(spark.createDataFrame([(t,) for t in texts], "value string"))
    programs, casts = ingest.guide_batches(guides, empty(spark, "broadcasts"), "t")
    assert programs.count() == 1 and sorted(r.is_rebroadcast_flag for r in casts.collect()) == [0, 1]
    stored = merge.upsert(empty(spark, "broadcasts"), casts, ["broadcast_id"])
    assert ingest.guide_batches(guides, stored, "t")[1].isEmpty() and ingest.rematch(stored).isEmpty()
    assert ingest.rematch(stored.withColumn("broadcaster", F.lit("Other"))).count() == 2


def test_hash_report_and_groups(spark):
    paths = spark.createDataFrame([("p1", "D:\\a"), ("p2", "D:\\b")], "path_id string, path string")
    report = spark.createDataFrame([("/mnt/d/a", 3, "h"), ("D:\\zz", 3, "h")], "path string, size long, hash string")
    f, links = ingest.hash_batches(report, paths)
    assert f.first().content_hash == "h" and f.count() == 1 and links.first().path_id == "p1"
    rows = spark.createDataFrame([("a", "k", "T1", "2024-01-02", "x", True), ("b", "k", "T0", "", "x", None), ("c", "k", "T2", "2024-01-03", "x", False), ("d", "l", "T", "1", "x", None)], "path_id string, episode_key string, program_title string, air_date string, broadcaster string, flag boolean")
    groups, members = ingest.group_batches(rows, "t")
    assert [r.program_title for r in groups.collect()] == ["T1"] and {r.path_id: r.broadcast_type for r in members.collect()} == {"a": "rebroadcast", "b": "original", "c": "original"}


def test_repairs(spark):
    bad = spark.createDataFrame([("D:\\a\\x.ts", "D", "", "a\\x.ts", ""), ("D:\\a\\y.ts", "D", "D:\\a", "y.ts", ".ts")], "path string, drive string, dir string, name string, ext string")
    assert [(r.dir, r.name) for r in ingest.repair_paths(bad).collect()] == [("D:\\a", "x.ts")]
    md = spark.createDataFrame([("T", '{"needs_review":"true"}', 1), ("U", None, 1)], "program_title string, data_json string, needs_review int")
    out = {r.program_title: r for r in ingest.update_needs_review(md, spark.createDataFrame([("T", 0)], "program_title string, needs_review int")).collect()}
    assert out["T"].needs_review == 0 and "false" in out["T"].data_json and out["U"].needs_review == 1
    ingest.register_functions(spark)
    assert spark.sql("select normalize_program_key('Ａ　b/c')").first()[0] == "a_bc"


def test_review_documents(spark, tmp_path):
    rows = spark.createDataFrame([("T", "1", "p1", 1, True), ("T", "2", "p2", 2, False), ("UNKNOWN", "3", "p3", 3, True)], "program_title string, id string, path string, n int, r boolean")
    stats = review.title_stats(rows, "program_title", F.col("r"), "id", "path", "n")
    path = str(tmp_path / "t.yaml")
    assert reviews.write_titles(stats, path, "s") == 1 and reviews.read_titles(path)[0] == {"T": "T"} and len(reviews.read_titles(path)[1]["T"]) == 16
    plan = spark.createDataFrame([("g", "a", "p", 1, "keep"), ("g", "b", "q", 2, "drop"), ("h", "c", "r", 1, "keep")], "group_key string, path_id string, path string, size_bytes long, decision string")
    assert reviews.write_groups(dedup.review_groups(plan), path) == 1 and reviews.read_groups(path) == [("g", "a", "keep"), ("g", "b", "drop")]
    edited = spark.createDataFrame([("g", "a", "skip"), ("g", "b", "drop")], "group_key string, path_id string, decision string")
    assert [r.group_key for r in dedup.skip_groups(plan, edited).collect()] == ["h"] and reviews.output_name("/x/y.jsonl") == "/x/y_review.yaml" and reviews.output_name("/x/llm_filename_extract_output_7.jsonl") == "/x/program_aliases_review_7.yaml"
    answers = dedup.broadcaster_answers(spark.createDataFrame([("NHK one", None), ("New", "bs_cs"), ("Odd", None)], "broadcaster string, bucket string"), {"terrestrial": ["nhk"], "bs_cs": ["BS"]})
    assert [(r.resolved_bucket, r.new_keyword, r.error) for r in answers.collect()] == [("terrestrial", None, None), ("bs_cs", "New", None), (None, None, "unknown_broadcaster_needs_bucket")]


def test_public_calls(tmp_path):
    plan = tmp_path / "plan"
    plan.write_text("x")
    clock = iter(range(100))

    def dry_run(run, options):
        run.register("p", f"{run.flow}_plan", str(plan), "dry_run", "t")
        run.open_gate("g", "review", ["p"], "t")
        return "plan_ready"

    services = api.Services(workflow.Store(str(tmp_path / "runs")), dry_run, lambda run, plan: True, lambda: str(next(clock)))
    assert api.start(services, "relocate", "r")["nextActions"][0]["action"] == "resolve_gate"
    with pytest.raises(workflow.WorkflowError, match="blocking_gate"):
        api.resume(services, "r", artifact_id="p")
    api.resume(services, "r", "resolve_gate", gate_id="g")
    assert api.resume(services, "r", artifact_id="p")["phase"] == "complete" and api.status(services)[0]["runId"] == "r" and api.inspect(services, "r", "p")["exists"]
    broken = api.Services(services.store, lambda run, options: 1 / 0, services.apply, services.now)
    assert api.start(broken, "source_root", "s")["ok"] is False
    for flow, options in (("x", {}), ("relocate", {"maxFilesPerRun": 9999})):
        with pytest.raises(workflow.WorkflowError):
            api.start(services, flow, "q", **options)


def test_plan_from_tables(spark):
    from tapewright.plans import moves

    listing = spark.createDataFrame([("1", "C:\\in\\a.mp4", "a.mp4"), ("2", "C:\\in\\b.mp4", "b.mp4"), ("3", "C:\\by_program\\Show\\c.mp4", "c.mp4"), ("4", "C:\\in\\d.mp4", "d.mp4")], "path_id string, path string, name string")
    data = [("1", "llm", '{"epg_genres":[{"category":"A","subcategory":"b"}]}', "T", "2024-01-02", 0), ("3", "llm", "{}", "Show and a long text", "2024-01-02", 0), ("4", "llm", "{}", "T", None, None)]
    md = spark.createDataFrame([(*r, None, None, None, 0, "t") for r in data], "path_id string, source string, data_json string, program_title string, air_date string, needs_review int, episode_no string, subtitle string, broadcaster string, human_reviewed int, updated_at string")
    routes = moves.Routes("D:", routes=(moves.Route("g", "E:", "flat", ("A - b",)),))
    plan = {r.path_id: (r.skip_reason, r.dst) for r in moves.move_plan(moves.plan_rows(listing, md), routes).collect()}
    assert plan == {"1": (None, "E:\\a.mp4"), "2": ("missing_metadata", None), "3": ("suspicious_program_title", None), "4": ("invalid_metadata_contract", None)}
    assert moves.outcome(1, 0, 0, 0) == "plan_ready" and moves.outcome(0, 1, 0, 0) == "review_required" and moves.outcome(0, 0, 0, 2) == "metadata_missing"


def test_contamination_and_guide_details(spark):
    from tapewright.operators import extract, reconcile, resolve

    df = spark.createDataFrame([(1, "Show x", "Show", "human_exact", False, False), (2, "Show x", "Show", "human_exact", False, True), (3, "Show y", "Show", "programs", False, False), (4, "Show", "Show", "human", True, False), (5, "S z", "S", "prefix_family", True, False)], "id int, title string, suggested string, match_source string, strong boolean, family boolean")
    assert {r.id: r.confidence for r in resolve.contamination(df, F.col("strong"), F.col("family")).collect()} == {2: "high", 3: "medium", 5: "high"}
    found = spark.createDataFrame([(1, i, f"T{i % 3}", f"0{i}:00") for i in range(1, 9)], "id int, place int, title string, start string")
    hint = extract.hint_payload(found, "id", "title", "start").first()
    assert hint.titles == ["T1", "T2", "T0"] and hint.start_times == [f"0{i}:00" for i in range(1, 6)]
    guides = spark.createDataFrame([("k", [("A", "b")], True, "x" * 400)], "k string, epg_genres array<struct<category:string,subcategory:string>>, is_rebroadcast_flag boolean, description string")
    row = extract.enrich(spark.createDataFrame([("k",), ("l",)], "k string"), guides, "k").orderBy("k").collect()
    assert row[0].epg_genre == "A - b" and len(row[0].epg_description) == 300 and row[1].epg_genre is None
    paths = spark.createDataFrame([("B:\\Lib\\x",), ("B:\\Library",), ("b:\\lib",)], "p string")
    assert [r[0] for r in paths.select(reconcile.under_roots(F.col("p"), ["B:\\lib\\"])).collect()] == [True, False, True]
    long = spark.createDataFrame([("A very long title that goes on▽more",), ("Known show and so much more text here",), ("Short",)], "t string")
    known = spark.createDataFrame([("Known show",), ("Known",)], "title string")
    none = spark.createDataFrame([], "alias string, canonical string")
    assert {r.t: r.fixed for r in resolve.long_title_fix(long, "t", none, known).collect()} == {"A very long title that goes on▽more": "A very long title that goes on", "Known show and so much more text here": "Known show", "Short": None}


def test_review_documents_list_everything(spark, tmp_path):
    path, n = str(tmp_path / "t.yaml"), 5001
    stats = spark.range(n).selectExpr("concat('T', id) as program_title", "id + 1 as n_rows", "0 as n_review", "'c' as cohort", "array('s') as samples")
    assert reviews.write_titles(stats, path, "s") == n and set(reviews.read_titles(path)[0]) == {f"T{i}" for i in range(n)}
    plan = spark.range(402).selectExpr("concat('g', id div 2) as group_key", "string(id) as path_id", "concat('p', id) as path", "1L as size_bytes", "if(id % 2 = 0, 'keep', 'drop') as decision")
    assert reviews.write_groups(dedup.review_groups(plan), path) == 201 and len(reviews.read_groups(path)) == 402
