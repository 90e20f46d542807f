"""Programme-guide sidecars (``*.program.txt``): date range, broadcaster and title, then sections."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import dates as D

SCHEMA = (
    "air_date string, start_time string, end_time string, broadcaster string, official_title string, title_raw string, annotations array<string>, is_rebroadcast_flag boolean, "
    "description string, epg_genres array<struct<category:string,subcategory:string>>, detail_sections map<string,string>, network_ids map<string,long>"
)
#: Network identifiers, and below in ``_fold`` the section heads, of a sidecar.
_IDS = re.compile(r"(OriginalNetworkID|TransportStreamID|ServiceID|EventID):(\d+)")
#: A mark in a title, the mark of a rebroadcast, and the parts of a genre's line.
MARK, AGAIN = r"\[([^\]]*)\]", "再"
GENRE_LINE = r"(.+?)\s*-\s*(.+)"


def find(spark: SparkSession, root: str) -> DataFrame:
    """(path, value): each sidecar's whole text."""
    return spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True, pathGlobFilter="*.program.txt").select(F.col("_metadata.file_path").alias("path"), "value")


def annotations(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(MARK), 1)


def title_line(line: Column) -> Column:
    """struct(official_title, annotations, is_rebroadcast_flag) of a line in NFKC."""
    marks = annotations(line)
    return F.struct(F.regexp_replace(F.regexp_replace(line, MARK, ""), r"(?U)^\s+|\s+$", "").alias("official_title"), marks.alias("annotations"), F.array_contains(marks, AGAIN).alias("is_rebroadcast_flag"))


def genres(lines: Column) -> Column:
    """Lines ``category - subcategory`` as structs; the section's own head and blank lines don't count."""
    part = lambda i: lambda x: F.trim(F.regexp_extract(x, f"(?U)^{GENRE_LINE}$", i))
    two = lambda x: x.rlike(f"(?U)^{GENRE_LINE}$")
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^ジャンル ?:$"))
    return F.transform(kept, lambda x: F.struct(F.when(two(x), part(1)(x)).otherwise(x).alias("category"), F.when(two(x), part(2)(x)).otherwise("").alias("subcategory")))


def network_ids(lines: Column) -> Column:
    hits = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*((?:OriginalNetworkID|TransportStreamID|ServiceID|EventID):\d+)", 1)), lambda x: x != "")
    return F.transform_values(F.str_to_map(F.array_join(hits, "|"), F.lit(r"\|"), F.lit(":")), lambda k, v: v.cast("long"))


def _fold(text: str) -> dict | None:
    lines = text.removeprefix("﻿").splitlines()
    if len(lines) < 3:
        return None
    norm = [unicodedata.normalize("NFKC", x) for x in lines]
    when = re.search(D.GUIDE_RANGE, norm[0])
    if not when:
        return None
    y, m, d, h, mi, eh, em = when.groups()
    sections: dict[str, list[str]] = {"text": [], "detail": [], "genre": [], "ids": [], "technical": []}
    at = "text"
    for raw, x in zip(lines[3:], (n.strip() for n in norm[3:]), strict=True):
        head = "detail" if x == "詳細情報" else "genre" if x.startswith("ジャンル") and ":" in x else "technical" if re.match("映像 ?:", x) else None
        if head:
            at = head
            continue
        at = "ids" if _IDS.match(x) else at
        sections[at].append(raw.strip() if at == "text" else x)
    details: dict[str, list[str]] = {}
    name = None
    for x in sections["detail"]:
        if x.startswith("- "):
            details[name := x[2:].strip()] = []
        elif name is not None:
            details[name].append(x)
    marks = re.findall(MARK, norm[2])
    pairs = [re.match(GENRE_LINE, x) for x in sections["genre"] if x]
    return {
        "air_date": f"{y}-{m}-{d}", "start_time": f"{int(h):02d}:{mi}", "end_time": f"{int(eh):02d}:{em}", "broadcaster": norm[1].strip(),
        "official_title": re.sub(MARK, "", norm[2]).strip(), "title_raw": lines[2].strip(), "annotations": marks, "is_rebroadcast_flag": AGAIN in marks,
        "description": "\n".join(sections["text"]).strip(), "detail_sections": {k: "\n".join(v).strip() for k, v in details.items() if v},
        "epg_genres": [{"category": p[1].strip(), "subcategory": p[2].strip()} if p else {"category": x, "subcategory": ""} for p, x in zip(pairs, [x for x in sections["genre"] if x], strict=True)],
        "network_ids": {k: int(v) for k, v in (_IDS.match(x).groups() for x in sections["ids"] if _IDS.match(x))},
    }


def parse(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``guide``, the parsed struct, null where the text has under three lines or no date range. Sections need a fold and NFKC, hence batches in Python."""
    import pandas as pd

    def fold(s):
        names = [x.split(" ")[0] for x in ("air_date", "start_time", "end_time", "broadcaster", "official_title", "title_raw", "annotations", "is_rebroadcast_flag", "description", "epg_genres", "detail_sections", "network_ids")]
        rows = [_fold(x or "") or dict.fromkeys(names) for x in s]
        return pd.DataFrame(rows, columns=names)

    out = df.withColumn("guide", F.pandas_udf(fold, SCHEMA)(F.col(value)))
    return out.withColumn("guide", F.when(F.col("guide.air_date").isNotNull(), F.col("guide")))
