"""Rule files: small ordered lists that become expressions on the driver, or tables, parsed by the tasks, whatever their number and size.

``rows`` makes a table of the texts of many files: a row for each alias, rule, pattern and list item, with the file's number and the place in it; the tables below follow from it by
``max_by`` where later ones win.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.plans.moves import Route, Routes
from tapewright.sources import yamls


def simple_lists(text: str, scalars: bool = False) -> dict:
    """``key:`` with ``- item`` lines. With ``scalars`` digits after a key are numbers and mixing them with items is an error; else values after a key are left out."""
    out: dict = {}
    key = None
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := re.fullmatch(r"\s*-\s*(.+?)\s*", line):
            if key is None or not isinstance(out[key], list):
                raise ValueError(f"line {n}: item without a list")
            out[key].append(re.sub(r"""^(["'])(.*)\1$""", r"\2", m[1]))
        elif m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*:\s*(.*?)\s*", line):
            key = m[1]
            if not m[2]:
                out.setdefault(key, [])
            elif scalars:
                out[key] = int(m[2]) if m[2].isdigit() else m[2]
            else:
                out.setdefault(key, [])
                key = None
        else:
            raise ValueError(f"line {n}: {line}")
    return out


def _yaml(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8-sig")) or {}


def buckets(path: str) -> dict[str, list[str]]:
    found = simple_lists(Path(path).read_text(encoding="utf-8"))
    return {b: [w.strip() for w in found.get(f"{b}_keywords", []) if w.strip()] for b in ("terrestrial", "bs_cs")}


def routes(path: str) -> Routes:
    raw = _yaml(path)
    made = tuple(Route(str(r["genre"]), str(r.get("dest_root") or ""), str(r.get("layout") or "by_program_year_month"), tuple(r.get("epg_genre_match") or ()), tuple(r.get("title_patterns") or ())) for r in raw.get("routes", []) if r.get("genre"))
    return Routes(str(raw.get("default_dest") or ""), str(raw.get("default_layout") or "by_program_year_month"), made)


def franchises(path: str) -> list[tuple[str, list[str]]]:
    return [(r["franchise"], [p for p in r["title_patterns"] if isinstance(p, str)]) for r in _yaml(path).get("rules", []) if isinstance(r.get("franchise"), str) and isinstance(r.get("title_patterns"), list)]


def hints(paths: list[str]) -> tuple[dict[str, str], list[dict], dict[str, int]]:
    """(alias to title, ordered regex rules, counters). Later files win; a missing file is counted, one that can't be read is an error."""
    aliases: dict[str, str] = {}
    rules: list[dict] = []
    seen = {"loaded": 0, "missing": 0}
    norm = lambda s: re.sub(r"\s+", " ", s).strip().lower()
    for p in paths:
        if not Path(p).exists():
            seen["missing"] += 1
            continue
        raw = _yaml(p)
        seen["loaded"] += 1
        for h in raw.get("hints", []):
            for a in [h["canonical_title"], *(h.get("aliases") or [])]:
                aliases[norm(a)] = h["canonical_title"]
        for r in raw.get("rules", []):
            if r.get("enabled", True):
                rules.append({"regex": r["match"]["regex"], "field": r["match"].get("field", "base"), "title": r["set"]["program_title"]})
    return aliases, rules, seen


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, path, text) of rule files that Spark reads, by their number in the list; a missing one has null text."""
    found = spark.createDataFrame([], "file int, path string, text string")
    for i, p in enumerate(paths):  # people's lists of files, a few
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        one = spark.read.text(p, wholetext=True).agg(F.first("value").alias("text")) if there else spark.range(1).select(F.lit(None).cast("string").alias("text"))
        found = found.unionByName(one.select(F.lit(i).alias("file"), F.lit(p).alias("path"), "text"))
    return found


def _parsed(parts: Iterator[str]) -> Iterator[tuple]:
    """(kind, name, value, field) of what a rule file, read in pieces, says, in its order."""
    for section, found in yamls.sections(parts):
        if section == "hints":
            for h in found or []:
                for alias in [h["canonical_title"], *(h.get("aliases") or [])]:
                    yield "alias", re.sub(r"\s+", " ", alias).strip().lower(), h["canonical_title"], None
        elif section == "rules":
            for r in found or []:
                if "match" in r:
                    if r.get("enabled", True):
                        yield "rule", r["match"]["regex"], r["set"]["program_title"], r["match"].get("field", "base")
                elif isinstance(r.get("franchise"), str) and isinstance(r.get("title_patterns"), list):
                    for pattern in r["title_patterns"]:
                        if isinstance(pattern, str):
                            yield "franchise", r["franchise"], pattern, None
        elif section == "routes":
            for r in found or []:
                if r.get("genre"):
                    yield "route", str(r["genre"]), str(r.get("dest_root") or ""), str(r.get("layout") or "by_program_year_month")
                    for pattern in r.get("title_patterns") or ():
                        yield "route_title", str(r["genre"]), str(pattern), None


def _listed(parts: Iterator[str], scalars: bool) -> Iterator[tuple]:
    for key, items in simple_lists("".join(parts), scalars).items():
        if isinstance(items, list):
            for item in items:
                yield "item", key, item, None
        else:
            yield "scalar", key, str(items), "number" if isinstance(items, int) else "text"


def rows(texts: DataFrame, lists: bool = False, scalars: bool = False) -> DataFrame:
    """(file, place, kind, name, value, field) of rule files (file, text); null texts have none. With ``lists`` the files are ``simple_lists``, with or without ``scalars``. A file that can't be read is an error."""
    parse = (lambda parts: _listed(parts, scalars)) if lists else _parsed

    def parsed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for (file,), parts in yamls.by_text(batches):
            numbered = enumerate(parse(parts))
            while said := list(islice(numbered, 5000)):
                columns = zip(*[x for _, x in said], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(said), pa.int64()), pa.array([n for n, _ in said], pa.int32()), *[pa.array(c, pa.string()) for c in columns]], ["file", "place", "kind", "name", "value", "field"])

    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts.sparkSession.sparkContext.defaultParallelism)
    spread = texts.select(F.col("file").cast("long").alias("file"), "text").repartition(tasks, F.xxhash64("file", "text"))
    found = yamls.pieces(spread, F.col("text"), "file").mapInArrow(parsed, "file long, place int, kind string, name string, value string, field string")
    return found.withColumn("file", F.col("file").cast(texts.schema["file"].dataType))


def alias_table(found: DataFrame) -> DataFrame:
    """(alias, title): of an alias that several hints have the last, by file and place."""
    return found.where("kind = 'alias'").groupBy(F.col("name").alias("alias")).agg(F.max_by("value", F.struct("file", "place")).alias("title"))


def rule_table(found: DataFrame) -> DataFrame:
    """(file, place, regex, field, title) of the rules that are on."""
    return found.where("kind = 'rule'").select("file", "place", F.col("name").alias("regex"), "field", F.col("value").alias("title"))


def franchise_table(found: DataFrame) -> DataFrame:
    """(franchise, pattern, file, place) of series rules."""
    return found.where("kind = 'franchise'").select(F.col("name").alias("franchise"), F.col("value").alias("pattern"), "file", "place")
