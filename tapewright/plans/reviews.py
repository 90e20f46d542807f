"""Review documents for people: written from tables, read back into rules and decisions.

A document is one file on the driver (``write_titles``, ``write_groups``), or a folder of parts that the tasks write and read (``write_parts``): each part is a list of YAML items in the order of the
table, of at most a set number of rows, and the committed folder has a ``_SUCCESS`` mark. People edit parts in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.sources import yamls
from tapewright.sources.scratch import text_batches


def _rows(df: DataFrame) -> Iterator[dict]:
    """All rows, fetched a partition at a time."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def write_titles(stats: DataFrame, path: str, source: str) -> int:
    """Titles by count with samples and cohort hash, for renaming; UNKNOWN is counted by its rows but not listed. Gives the number of titles."""
    import yaml

    rows = sorted(_rows(stats.where("program_title <> 'UNKNOWN'")), key=lambda r: (-r["n_rows"], r["program_title"]))
    hints = [{"canonical_title": r["program_title"], "aliases": [r["program_title"]], "count": r["n_rows"], "needs_review": r["n_review"], "cohort": r["cohort"], "samples": r["samples"]} for r in rows]
    Path(path).write_text(yaml.safe_dump({"source": source, "hints": hints}, allow_unicode=True, sort_keys=False), encoding="utf-8")
    return len(hints)


def read_titles(path: str) -> tuple[dict[str, str], dict[str, str]]:
    """(alias to title, title to cohort hash) of an edited document; later aliases win."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8-sig")) or {}
    aliases, cohorts = {}, {}
    for h in raw.get("hints", []):
        for a in h.get("aliases") or []:
            aliases[a] = h["canonical_title"]
        if h.get("cohort"):
            cohorts[h["canonical_title"]] = h["cohort"]
    return aliases, cohorts


def write_groups(groups: DataFrame, path: str) -> int:
    """Groups with their candidates and decisions, of which a reader may set any to skip."""
    import yaml

    rows = list(_rows(groups))
    Path(path).write_text(yaml.safe_dump({"groups": rows}, allow_unicode=True, sort_keys=False), encoding="utf-8")
    return len(rows)


def read_groups(path: str) -> list[tuple[str, str, str]]:
    """(group_key, path_id, decision) rows."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8-sig")) or {}
    return [(g["group_key"], c["path_id"], c["decision"]) for g in raw.get("groups", []) for c in g.get("candidates", [])]


def write_parts(df: DataFrame, folder: str, rows: int = 5000, chars: int = 2_000_000) -> None:
    """Each row of ``df`` as a YAML item, in parts of at most ``rows`` items and, but for single items, ``chars`` characters."""

    def parts(batches: Iterator) -> Iterator:
        import json

        import pyarrow as pa

        dump, held, size = yamls.dumper(), [], 0
        for batch in batches:
            for text in batch.column(0):
                item = dump(json.loads(text.as_py()))
                if held and (len(held) >= rows or size + len(item) > chars):
                    yield pa.RecordBatch.from_arrays([pa.array(["\n".join(held)])], ["value"])
                    held, size = [], 0
                held.append(item)
                size += len(item) + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["\n".join(held)])], ["value"])

    texts = text_batches(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    texts.mapInArrow(parts, "value string").write.option("maxRecordsPerFile", 1).text(folder)


def read_parts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Items of such a folder, edited or not, as rows of ``schema``. An edited part that is no list is an error."""

    def items(batches: Iterator) -> Iterator:
        import json

        import pyarrow as pa

        held, size = [], 0
        for _, parts in yamls.by_text(batches):
            for x in yamls.items(parts):
                held.append(json.dumps(x, ensure_ascii=False, default=str))
                size += len(held[-1])
                if size > 1_000_000 or len(held) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["t"])
                    held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["t"])

    texts = yamls.pieces(spark.read.text(folder, wholetext=True), F.col("value"))
    return texts.mapInArrow(items, "t string").select(F.from_json("t", schema).alias("r")).select("r.*")


def title_parts(stats: DataFrame, folder: str) -> None:
    """``write_titles`` in parts."""
    known = stats.where("program_title <> 'UNKNOWN'").orderBy(F.desc("n_rows"), "program_title")
    write_parts(known.select(F.col("program_title").alias("canonical_title"), F.array("program_title").alias("aliases"), F.col("n_rows").alias("count"), F.col("n_review").alias("needs_review"), "cohort", "samples"), folder)


def title_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(alias, title, cohort) of an edited document in parts; of an alias that several titles have the greatest title counts."""
    read = read_parts(spark, folder, "canonical_title string, aliases array<string>, cohort string")
    return read.select(F.explode("aliases").alias("alias"), F.struct(F.col("canonical_title").alias("title"), "cohort").alias("t")).groupBy("alias").agg(F.max("t").alias("t")).select("alias", "t.title", "t.cohort")


def group_parts(groups: DataFrame, folder: str) -> None:
    """``write_groups`` in parts."""
    write_parts(groups, folder)


def group_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(group_key, path_id, decision) rows of an edited document in parts."""
    read = read_parts(spark, folder, "group_key string, candidates array<struct<path_id:string,decision:string>>")
    return read.select("group_key", F.explode("candidates").alias("c")).select("group_key", "c.path_id", "c.decision")


#: How the files of extracted rows and of their reviews are named.
EXTRACTED, REVIEW, OTHER = "llm_filename_extract_output_", "program_aliases_review_{}.yaml", "{}_review.yaml"


def output_name(source: str) -> str:
    """Path of the review document of a file of rows, beside it."""
    path = Path(source)
    extracted = path.name.startswith(EXTRACTED) and path.suffix == ".jsonl"
    return str(path.with_name(REVIEW.format(path.stem[len(EXTRACTED) :]) if extracted else OTHER.format(path.stem)))


def output_names(source: Column) -> Column:
    """``output_name`` of each row."""
    folder, name = F.regexp_extract(source, r"^(.*/)?([^/]*)$", 1), F.regexp_extract(source, r"^(.*/)?([^/]*)$", 2)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    extracted = name.startswith(EXTRACTED) & name.endswith(".jsonl")
    before, after = REVIEW.split("{}")
    return F.concat(folder, F.when(extracted, F.concat(F.lit(before), F.substring(stem, len(EXTRACTED) + 1, 1 << 30), F.lit(after))).otherwise(F.concat(stem, F.lit(OTHER.replace("{}", "")))))
