"""Manifests of runs as a table, and archives of logs as a table of actions that the tasks carry out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.operators.prefixes import longest_prefix
from tapewright.sources.scratch import written

GATE = "struct<id:string,type:string,status:string,artifact_ids:array<string>>"
ARTIFACT = "struct<id:string,type:string,path:string,sha256:string,status:string>"
MANIFEST = f"run_id string, flow string, phase string, gates map<string,{GATE}>, artifacts map<string,{ARTIFACT}>"


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """(name, changed_at, run_id, flow, phase, gates, artifacts) of a folder's manifests, a JSON file for each run; those that can't be read have nulls."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("changed_at"), "value")
    return parsed(files)


def parsed(texts: DataFrame) -> DataFrame:
    """(name, changed_at, value) with the manifest in ``value`` as columns."""
    return texts.select("name", "changed_at", F.from_json("value", MANIFEST).alias("m")).select("name", "changed_at", "m.*")


def recent(runs: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` runs changed last, ties by name, with their ``place`` from 1."""
    newest = runs.orderBy(F.desc("changed_at"), "name").limit(n)
    return newest.withColumn("place", F.row_number().over(W.orderBy(F.desc("changed_at"), "name")))  # n rows


def gates(runs: DataFrame, status: str = "open") -> DataFrame:
    """(run_id, phase, gate, type, artifact_id) of the gates with a status, a row for each artifact that they wait for; null for none."""
    held = runs.select("run_id", "phase", F.explode(F.map_values("gates")).alias("g")).where(F.col("g.status") == status)
    return held.select("run_id", "phase", F.col("g.id").alias("gate"), F.col("g.type").alias("type"), F.explode_outer("g.artifact_ids").alias("artifact_id"))


def dangling(runs: DataFrame) -> DataFrame:
    """Artifacts that gates wait for and the run doesn't have: (run_id, gate, artifact_id)."""
    waits = runs.select("run_id", F.explode(F.map_values("gates")).alias("g")).select("run_id", F.col("g.id").alias("gate"), F.explode("g.artifact_ids").alias("artifact_id"))
    return waits.join(runs.select("run_id", F.explode(F.map_keys("artifacts")).alias("artifact_id")), ["run_id", "artifact_id"], "left_anti").select("run_id", "gate", "artifact_id")


def _gate(status: list[str], type: str | None = None) -> Column:
    """Whether the run has a gate of such a status."""
    return F.coalesce(F.exists(F.map_values("gates"), lambda g: g["status"].isin(*status) & (F.lit(True) if type is None else g["type"] == type)), F.lit(False))


def _current(type: Column | str) -> Column:
    return F.coalesce(F.exists(F.map_values("artifacts"), lambda a: (a["status"] == "current") & (a["type"] == type)), F.lit(False))


def next_steps(held: DataFrame) -> DataFrame:
    """``follow_up`` of each run, what a person or caller does next (as ``workflow.Run.follow_ups`` of one), null for nothing: by flow, phase, open gates and current artefacts."""
    source = F.col("flow") == "source_root"
    reviewed = F.when(source, F.when(_gate(["open"], "metadata_review"), "review_metadata")).when(_gate(["open"], "relocate_metadata_review"), "review_relocate_metadata")
    reviewed = reviewed.when(_current("relocate_metadata_queue") | _current("relocate_diagnostics"), "prepare_relocate_metadata")
    planned = F.when(_current(F.when(source, "source_root_move_plan").otherwise("relocate_plan")), "review_plan")
    return held.withColumn("follow_up", F.when(F.col("phase") == "plan_ready", planned).when(F.col("phase") == "review_required", reviewed))


def apply_checks(held: DataFrame, artifact: str, flow: str, plan_type: str, files: DataFrame) -> DataFrame:
    """``apply`` of each run: ok if its plan may be applied now, else the first check that fails (as ``workflow.Run.check_apply`` of one). files: (path, sha256) of what is there."""
    plan = F.get(F.array(F.col("artifacts")[artifact]), F.lit(0))
    out = held.withColumn("_plan", plan).withColumn("_path", F.col("_plan.path")).join(files.groupBy(F.col("path").alias("_path")).agg(F.max("sha256").alias("_sha")), "_path", "left")
    refused = (
        F.when(~F.col("flow").eqNullSafe(F.lit(flow)), "wrong_flow").when(~F.col("phase").eqNullSafe(F.lit("plan_ready")), "wrong_phase").when(_gate(["open", "rejected"]), "blocking_gate")
        .when(F.col("_plan").isNull(), "unknown_artifact").when(~F.col("_plan.type").eqNullSafe(F.lit(plan_type)), "wrong_artifact_type").when(~F.col("_plan.status").eqNullSafe(F.lit("current")), "stale_artifact")
        .when(F.col("_sha").isNull(), "artifact_missing").when(~F.col("_sha").eqNullSafe(F.col("_plan.sha256")), "checksum_mismatch").otherwise("ok")
    )
    return out.withColumn("apply", refused).drop("_plan", "_path", "_sha")


def illegal_steps(events: DataFrame) -> DataFrame:
    """Rows (run_id, at, before, after) of phase changes that aren't allowed, by the table of transitions."""
    from tapewright.plans.workflow import TRANSITIONS

    pairs = events.sparkSession.createDataFrame([(a, b) for a, after in TRANSITIONS.items() for b in after], "before string, after string")
    return events.join(F.broadcast(pairs), ["before", "after"], "left_anti")


def archive_actions(files: DataFrame, prefixes: DataFrame, now: Column, ttl_days: int = 30) -> DataFrame:
    """``action`` for each log (name, mtime, packed): the newest ``keep`` of each prefix stay, ties by name, others are packed; packed ones older than ``ttl_days`` go.

    prefixes: (prefix, keep); the longest one that a name begins with counts; names under none are packed. The newest of a prefix are found with a bounded number of rows from
    each task, so a prefix may hold most files.
    """
    rows = written(files.withColumn("_id", F.monotonically_increasing_id()), "logs")
    under = longest_prefix(rows.where("not packed"), "_id", "name", prefixes.select(F.col("prefix").alias("norm"), F.col("prefix").alias("title")), extra=0)
    live = rows.where("not packed").join(under.withColumnRenamed("title", "prefix"), "_id").join(prefixes.groupBy("prefix").agg(F.max("keep").alias("keep")), "prefix")
    most = prefixes.agg(F.max("keep")).first()[0] or 0
    place = F.row_number().over(W.partitionBy("prefix").orderBy(F.desc("mtime"), "name"))
    kept = live.withColumn("_r", place).where(F.col("_r") <= most).where("_r <= keep").select("_id", F.lit(True).alias("_kept"))
    old = F.col("mtime") < now - F.make_interval(days=F.lit(max(ttl_days, 0)))
    action = F.when(F.col("packed"), F.when(old, "delete").otherwise("leave")).when(F.col("_kept"), "keep").otherwise("pack")
    return rows.join(kept, "_id", "left").withColumn("action", action).drop("_id", "_kept")


def act(actions: DataFrame, handlers: dict[str, Callable[[str], None]]) -> DataFrame:
    """Log (name, action, ok, error) of actions carried out by the tasks, written once. Handlers are handed in by action, and must not mind being called again; others do nothing."""
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, action in part.itertuples(index=False):
                error = None
                try:
                    handlers.get(action, lambda _: None)(name)
                except Exception as e:  # the log says so; others go on
                    error = str(e)
                out.append((name, action, error is None, error))
            yield pd.DataFrame(out, columns=["name", "action", "ok", "error"])

    return written(actions.select("name", "action").mapInPandas(run, "name string, action string, ok boolean, error string"), "acted")
