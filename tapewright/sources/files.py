"""File listings as tables: names, sizes and times without contents."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import text as X
from tapewright.sources.scratch import written


def extensions(given: list[str]) -> list[str]:
    """Lower case, with a dot, sorted, none twice."""
    return sorted({"." + e.strip().lower().removeprefix(".") for e in given if e and e.strip()})


def extension_set(given: Column) -> Column:
    """``extensions`` of an array of each row."""
    clean = F.transform(given, lambda e: F.regexp_replace(F.lower(F.trim(e)), r"^\.", ""))
    kept = F.filter(F.arrays_zip(given.alias("g"), clean.alias("c")), lambda x: F.trim(x["g"]) != "")
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.concat(F.lit("."), x["c"]))))


SCAN = "kind string, root string, path string, size long, mtime timestamp, corrupt boolean, corrupt_reason string, code string, message string"


def scan(spark: SparkSession, roots: list[str], exts: list[str] | None = None, read_bytes: int = 4096, retries: int = 1) -> DataFrame:
    """Rows of kind file, folder, warning or error for all that lies below the roots, listed by the tasks, a level of folders after the other.

    A file of no bytes is corrupt (size_zero), as is one whose first ``read_bytes`` can't be read (read_failed:...; 0 reads none). A folder that can't be
    listed is tried ``retries`` times more and is then a warning (walk_failed), as is a file that can't be looked at (stat_failed); a root that
    is missing (root_missing) or no folder (root_not_directory) is an error. Each level is written, so that it is listed once.
    """
    import pandas as pd

    wanted, names = set(extensions(exts or [])), [c.split()[0] for c in SCAN.split(", ")]

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        def row(kind: str, root: str, path: str, **more) -> dict:
            return dict.fromkeys(names) | {"kind": kind, "root": root, "path": path} | more

        def entries(system, path: str) -> list:
            for left in range(retries, -1, -1):
                try:
                    return system.get_file_info(fs.FileSelector(path))
                except OSError:
                    if not left:
                        raise
            return []

        def look(root: str, path: str) -> Iterator[dict]:
            system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            if path == root and (kind := system.get_file_info(inner).type) != fs.FileType.Directory:
                missing = kind == fs.FileType.NotFound
                yield row("error", root, path, code="root_missing" if missing else "root_not_directory")
                return
            try:
                found = entries(system, inner)
            except OSError as e:
                yield row("warning", root, path, code="walk_failed", message=str(e))
                return
            for x in found:
                here = path.rstrip("/") + "/" + x.base_name
                if x.type == fs.FileType.Directory:
                    yield row("folder", root, here)
                elif x.type != fs.FileType.File:
                    yield row("warning", root, here, code="stat_failed")
                elif not wanted or _extension(x.base_name) in wanted:
                    why = None if x.size else "size_zero"
                    if x.size and read_bytes:
                        try:
                            with system.open_input_stream(x.path) as f:
                                f.read(read_bytes)
                        except OSError as e:
                            why = f"read_failed:{type(e).__name__}"
                    yield row("file", root, here, size=x.size, mtime=pd.Timestamp(x.mtime_ns // 1000, unit="us", tz="UTC"), corrupt=why is not None, corrupt_reason=why)

        for part in parts:
            rows = [r for root, path in zip(part["root"], part["path"], strict=True) for r in look(root, path)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"size": "Int64", "mtime": "datetime64[us, UTC]", "corrupt": "boolean"})

    level = spark.createDataFrame([(r, r) for r in roots], "root string, path string")
    out = None
    while True:
        tasks = min(spark.sparkContext.defaultParallelism * 4, 10_000)
        found = written(level.repartition(tasks, "path").mapInPandas(walk, SCAN), "scan")
        out = found if out is None else out.unionByName(found)
        level = found.where("kind = 'folder'").select("root", "path")
        if level.isEmpty():
            return out


def _extension(name: str) -> str:
    """The extension of a file's name, lower case, with its dot."""
    stem, dot, ext = name.rpartition(".")
    return f".{ext.lower()}" if dot and stem.strip(".") else ""


def scan_summary(rows: DataFrame) -> DataFrame:
    """What ends a scan's report: one row with the number of files, corrupt ones, folders, warnings and errors."""
    of = lambda k: F.count_if(F.col("kind") == k)
    return rows.agg(of("file").alias("n_files"), F.count_if(F.col("corrupt")).alias("n_corrupt"), of("folder").alias("n_folders"), of("warning").alias("n_warnings"), of("error").alias("n_errors"))


def listing(spark: SparkSession, roots: list[str], exts: list[str] | None = None, quick_hash: bool = False, read_bytes: int = 0) -> DataFrame:
    """(path, dir, name, ext, size, mtime, corrupt, corrupt_reason[, quick_hash]) of all files below the roots; of paths that differ in case the first."""
    df = scan(spark, roots, exts, read_bytes).where("kind = 'file'")
    p = F.regexp_replace("path", "^file:(//)?", "")
    df = df.select(p.alias("path"), F.regexp_extract(p, "^(.*)/[^/]*$", 1).alias("dir"), F.element_at(F.split(p, "/"), -1).alias("name"), "size", "mtime", F.lower(F.regexp_extract(p, r"[^./](\.[^./]*)$", 1)).alias("ext"), "corrupt", "corrupt_reason")
    if quick_hash:
        df = df.withColumn("quick_hash", F.sha1(F.concat_ws("|", "path", F.col("size").cast("string"), F.unix_timestamp("mtime").cast("string"))))
    return df.groupBy(F.lower("path").alias("_k")).agg(F.min(F.struct(*df.columns)).alias("f")).select("f.*")


def newest(df: DataFrame, prefix: str = "") -> DataFrame:
    """The newest file whose name begins with ``prefix``, ties by path."""
    return df.where(F.startswith("name", F.lit(prefix))).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def inventory(df: DataFrame) -> DataFrame:
    """Listing rows in the catalog's path columns."""
    return df.withColumn("p", X.path_parts(X.windows_path(F.col("path")))).select("path", "p.drive", "p.dir", "p.name", "p.ext", "size", "mtime")
