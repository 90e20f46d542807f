"""Move and relocate plans: routing by ordered rules, destinations by layout, validation by the first failing rule, counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions import dates as D
from tapewright.functions import text as X
from tapewright.functions import values as V
from tapewright.operators import matching as M

#: Words in genre texts and titles, and the genre that each means; the first found counts.
GENRES = {
    "アニメ": "アニメ", "特撮": "特撮", "映画": "映画", "ドラマ": "ドラマ", "ドキュメンタリー": "ドキュメンタリー・情報", "情報": "ドキュメンタリー・情報",
    "バラエティ": "バラエティ", "ニュース": "ニュース・報道", "報道": "ニュース・報道", "放送大学": "放送大学",
}
LAYOUTS = ("by_program_year_month", "by_syllabary", "by_title", "flat")


@dataclass(frozen=True)
class Route:
    genre: str
    dest_root: str
    layout: str = "by_program_year_month"
    epg_genre_match: tuple[str, ...] = ()
    title_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Routes:
    default_dest: str
    default_layout: str = "by_program_year_month"
    routes: tuple[Route, ...] = field(default=())


def genre_in(text: Column, genres: dict[str, str] | None = None) -> Column:
    out = F
    for word, genre in (genres or GENRES).items():
        out = out.when(F.contains(X.empty(text), F.lit(word)), genre)
    return out.otherwise(None)


def genre(explicit: Column, epg: Column, title: Column, genres: dict[str, str] | None = None) -> Column:
    """Explicit genre, else the first guide genre (array of category, subcategory) that means one, else by the title."""
    by_guide = F.get(F.filter(F.transform(epg, lambda g: F.coalesce(genre_in(g["subcategory"], genres), genre_in(g["category"], genres))), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(F.nullif(explicit, F.lit("")), by_guide, genre_in(title, genres))


def franchise(title: Column, path: Column, rules: list[tuple[str, list[str]]], marker: str = "シリーズ_") -> Column:
    """First rule (franchise, patterns) with a pattern in the title, else the first path segment with the marker."""
    by_title = [F.when(F.contains(X.empty(title), F.lit(p)), F.lit(name)) for name, patterns in rules for p in patterns if p]
    segment = F.get(F.filter(F.split(X.empty(path), r"\\"), lambda s: F.contains(s, F.lit(marker))), F.lit(0))
    return F.coalesce(*by_title, segment)


def route_index(routes: Routes, pre: Column, epg_strings: Column, title: Column) -> Column:
    """Number of the route: by resolved genre, then guide genre, then title pattern, each over all routes in order; null for the default."""
    lower = F.lower(X.empty(title))
    by_genre = [F.when(pre == r.genre, F.lit(i)) for i, r in enumerate(routes.routes)]
    by_guide = [F.when(_some_genre(epg_strings, p), F.lit(i)) for i, r in enumerate(routes.routes) for p in r.epg_genre_match]
    by_title = [F.when(F.contains(lower, F.lit(p.lower())), F.lit(i)) for i, r in enumerate(routes.routes) for p in r.title_patterns]
    return F.coalesce(*by_genre, *by_guide, *by_title, F.lit(None).cast("int"))


def _some_genre(genres: Column, pattern: str) -> Column:
    return F.exists(genres, lambda g: X.genre_matches(g, F.lit(pattern)))


def destination(routes: Routes, index: Column, title: Column, air_date: Column, name: Column) -> Column:
    """struct(dst, genre_route, error); layouts that aren't known are by programme and month."""
    pick = lambda attr, default: F.coalesce(F.get(F.array(*[F.lit(getattr(r, attr)) for r in routes.routes]).cast("array<string>"), index), F.lit(default))
    root, layout = F.regexp_replace(pick("dest_root", routes.default_dest), r"\\+$", ""), X.layout_name(pick("layout", routes.default_layout))
    ym = D.year_month(air_date)
    dated = ~layout.isin(*LAYOUTS[1:])
    error = V.first_reason((X.empty(title) == "", "missing_program_title"), (X.empty(name) == "", "missing_filename"), (root == "", "no_dest_root")).otherwise(F.when(dated, ym["error"]))
    middle = F.when(layout == "by_syllabary", F.array(X.syllabary(title))).when(layout == "by_title", F.array(X.safe_dir(title, 80))).when(layout == "flat", F.array().cast("array<string>")).otherwise(F.array(X.safe_dir(title), ym["year"], ym["month"]))
    dst = F.array_join(F.concat(F.array(root), middle, F.array(name)), "\\")
    return F.struct(F.when(error.isNull(), dst).alias("dst"), pick("genre", "default").alias("genre_route"), error.alias("error"))


def validate(df: DataFrame, *, allow_review: bool = False, check_titles: bool = True) -> Column:
    """Why a row (has_metadata, has_contract, needs_review, program_title, air_date, folder, title_norm, folder_norm) can't move: the first reason, or null."""
    title, date = F.col("program_title"), F.col("air_date")
    rules = [
        (~F.col("has_metadata"), "missing_metadata"), (~F.col("has_contract"), "invalid_metadata_contract"), (F.col("needs_review") & F.lit(not allow_review), "needs_review"),
        ((X.empty(date) == "") | (X.empty(title) == ""), "missing_required_fields"), (X.has_separator(title), "subtitle_separator_in_program_title"),
    ]
    if check_titles:
        rules += [(X.swallowed(F.col("folder_norm"), F.col("title_norm")), "suspicious_program_title"), (X.shortened(F.col("folder_norm"), F.col("title_norm")), "suspicious_program_title_shortened")]
    return V.first_reason(*rules)


def plan_rows(listing: DataFrame, metadata: DataFrame, norm=None) -> DataFrame:
    """Listed files (path_id, path, name) with their metadata (one row for each path_id) in the columns that plans read.

    The contract asks for a title, a date and a review flag to be there, as columns or in the JSON. norm: the normal form in which
    folder and title are compared; lower case and strip without it.
    """
    get = lambda k: F.coalesce(F.col(f"m.{k}").cast("string"), F.get_json_object("m.data_json", f"$.{k}"))
    norm = norm or (lambda c: X.strip(F.lower(c)))
    keys = F.coalesce(F.json_object_keys("m.data_json"), F.array().cast("array<string>"))
    there = lambda k: F.col(f"m.{k}").isNotNull() | F.array_contains(keys, k)
    genres = F.from_json(get("epg_genres") if "epg_genres" in metadata.columns else F.get_json_object("m.data_json", "$.epg_genres"), "array<struct<category:string,subcategory:string>>")
    strings = F.transform(F.coalesce(genres, F.array().cast("array<struct<category:string,subcategory:string>>")), lambda g: F.when(X.empty(g["subcategory"]) != "", F.concat_ws(" - ", g["category"], g["subcategory"])).otherwise(g["category"]))
    rows = listing.alias("l").join(metadata.alias("m"), "path_id", "left").select(
        "path_id", "l.path", "l.name", F.col("m.source").alias("source"), F.col("m.source").isNotNull().alias("has_metadata"), (there("program_title") & there("air_date") & there("needs_review")).alias("has_contract"),
        F.coalesce(get("needs_review").isin("1", "true"), F.lit(False)).alias("needs_review"), get("program_title").alias("program_title"), get("air_date").alias("air_date"), F.get_json_object("m.data_json", "$.genre").alias("genre"), strings.alias("epg_strings"),
    )
    return rows.withColumn("folder_norm", norm(X.folder_title(F.col("path")))).withColumn("title_norm", norm(F.col("program_title")))


def move_plan(df: DataFrame, routes: Routes, *, allow_review: bool = False) -> DataFrame:
    """Rows (path, name, genre, epg_strings and those of ``validate``) with ``skip_reason``, ``dst``, ``genre_route``."""
    to = destination(routes, route_index(routes, F.col("genre"), F.col("epg_strings"), F.col("program_title")), F.col("program_title"), F.col("air_date"), F.col("name"))
    out = df.withColumn("_why", validate(df, allow_review=allow_review)).withColumn("_to", to)
    return out.withColumn("skip_reason", F.coalesce("_why", F.col("_to.error"))).withColumns({"dst": F.when(F.col("skip_reason").isNull(), F.col("_to.dst")), "genre_route": F.col("_to.genre_route")}).drop("_why", "_to")


def relocate_plan(plan: DataFrame, *, allow_unreviewed: bool = False) -> DataFrame:
    """``status`` and ``reason``: corrupt, unregistered, missing metadata and unreviewed sources come before the plan's own reasons; files in place are already_correct."""
    reason = V.first_reason(
        (F.col("corrupt"), "corrupt_candidate"), (F.col("path_id").isNull(), "unregistered_path"), (~F.col("has_metadata"), "missing_metadata"),
        (~F.col("source").isin("human_reviewed", "llm") & F.lit(not allow_unreviewed), "unreviewed_metadata"),
    ).otherwise(F.coalesce("skip_reason", F.when(F.lower("path") == F.lower("dst"), "already_correct")))
    return plan.withColumn("reason", F.coalesce(reason, F.lit("planned"))).withColumn("status", F.when(F.col("reason") == "planned", "planned").otherwise("skipped"))


def counters(plan: DataFrame, reasons: list[str], column: str = "reason") -> DataFrame:
    """One row with how often each reason occurs."""
    return plan.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(column) == r).alias(f"n_{r}") for r in reasons])


def outcome(planned: int, suspicious: int, unreviewed: int, missing: int) -> str:
    """What a relocate dry run leads to, by its counters."""
    if suspicious or unreviewed:
        return "review_required"
    return "plan_ready" if planned else "metadata_missing" if missing else "nothing_to_do"


def outcomes(planned: Column, suspicious: Column, unreviewed: Column, missing: Column) -> Column:
    """``outcome`` of each row of counters."""
    return F.when((suspicious > 0) | (unreviewed > 0), "review_required").when(planned > 0, "plan_ready").when(missing > 0, "metadata_missing").otherwise("nothing_to_do")


def route_histogram(plan: DataFrame) -> DataFrame:
    return plan.where("skip_reason is null").groupBy("genre_route").agg(F.count(F.lit(1)).alias("n"))


def until_planned(plan: DataFrame, order: str, limit: int) -> DataFrame:
    """The rows that a loop sees which stops after its ``limit``-th planned row.

    The cut is the order value of that row, found by a top-``limit`` selection, not by a running sum over all rows.
    """
    first = plan.where("skip_reason is null").select(order).orderBy(order).limit(limit)
    cut = first.agg(F.max(order).alias("_cut"), F.count(F.lit(1)).alias("_n"))
    return plan.join(F.broadcast(cut), (F.col("_n") < limit) | (F.col(order) <= F.col("_cut"))).drop("_cut", "_n")


def move_errors(src: Column, dst: Column, src_exists: Column, dst_exists: Column, rename: bool = False) -> Column:
    """Result of a move before it is made: the first thing wrong, rename_suffix, or null."""
    embedded = lambda c: F.substring(c, 3, 1 << 30).rlike(r"[A-Za-z]:\\")
    rooted = lambda c: c.rlike(r"^[A-Za-z]:\\")
    return V.first_reason(
        ((X.empty(src) == "") | (X.empty(dst) == ""), "missing_src_or_dst"), (embedded(src) | embedded(dst), "invalid_path_embedded_drive"), (~rooted(src) | ~rooted(dst), "invalid_path_not_drive_rooted"),
        (~src_exists, "src_not_found"), (dst_exists, "rename_suffix" if rename else "dst_exists"),
    )


def intend_moves(plan: DataFrame, exists: Callable[[str], bool], rename: bool = False) -> DataFrame:
    """What is going to be done for each row of a plan (path_id, src, dst), written before anything moves: (path_id, src, dst, error).

    A move with an error (``move_errors``) isn't made. With ``rename`` a file whose destination is taken gets a free ``__dupN`` beside it: rows of one destination, whatever its case, take the free
    numbers by their rank, and no name that is another row's destination.
    """
    import pandas as pd

    from tapewright.sources.scratch import written

    schema = "path_id string, src string, dst string"

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            there = {c: [bool(p) and exists(p) for p in part[c]] for c in ("src", "dst")}
            yield part.assign(src_exists=there["src"], dst_exists=there["dst"])

    @F.pandas_udf("string")
    def free_name(dst, place):
        out = []
        for d, left in zip(dst, place, strict=True):
            stem, dot, ext = d.rpartition(".")
            stem, ext = (stem, dot + ext) if stem and "\\" not in ext else (d, "")
            n = 1
            while (taken := exists(f"{stem}__dup{n}{ext}")) or left > 1:
                n, left = n + 1, left - (not taken)
            out.append(f"{stem}__dup{n}{ext}")
        return pd.Series(out)

    rows = plan.select(*[F.col(c).cast("string").alias(c) for c in ("path_id", "src", "dst")])
    seen = rows.mapInPandas(look, f"{schema}, src_exists boolean, dst_exists boolean")
    checked = written(seen.select("path_id", "src", "dst", move_errors(F.col("src"), F.col("dst"), F.col("src_exists"), F.col("dst_exists"), rename).alias("error")), "checked")
    if not rename:
        return checked
    taken = F.col("error") == "rename_suffix"
    place = F.row_number().over(W.partitionBy(F.lower("dst")).orderBy("path_id", "src"))
    named = checked.where(taken).withColumn("dst", free_name("dst", place)).withColumn("_name", F.lower("dst"))
    named = named.join(checked.select(F.lower("dst").alias("_name"), F.lit("dst_exists").alias("_why")).distinct(), "_name", "left")
    named = named.select("path_id", "src", "dst", F.col("_why").alias("error"))
    return written(checked.where(taken.isNull() | ~taken).unionByName(named), "intents")


def carry_out(intents: DataFrame, move: Callable[[str, str], None], exists: Callable[[str], bool]) -> DataFrame:
    """Log (path_id, src, dst, ok, error) of intended moves, made by the tasks and written once. What ``move`` raises becomes the error.

    A task that runs again finds what its first attempt has moved: the source has gone and the destination, which was free when the intent was written, is there. Such a move is done and not made
    twice, so the log is the same however often tasks are lost.
    """
    import pandas as pd

    from tapewright.sources.scratch import written

    def act(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, src, dst, error in part.itertuples(index=False):
                if error is None and not (exists(dst) and not exists(src)):
                    try:
                        move(src, dst)
                    except Exception as e:  # the log says so; other moves go on
                        error = str(e)
                out.append((key, src, dst, error is None, error))
            yield pd.DataFrame(out, columns=["path_id", "src", "dst", "ok", "error"])

    return written(intents.mapInPandas(act, "path_id string, src string, dst string, ok boolean, error string"), "moves")


def apply_moves(plan: DataFrame, move: Callable[[str, str], None], exists: Callable[[str], bool], rename: bool = False) -> DataFrame:
    """Log of a plan's moves (path_id, src, dst, each destination once): first all intents, then the moves.

    move, exists: what moves a file and tells whether one is there; handed in, as they know the machine.
    """
    return carry_out(intend_moves(plan, exists, rename), move, exists)


def apply_renames(renames: DataFrame, rename: Callable[[str, str], None]) -> list[tuple[str, str, str | None]]:
    """(src, dst, error) of folder renames (src, dst, depth) made one after the other, parents first, each by way of a name of its own, as many
    file systems take names that differ in case for one. Folders are few; they come a partition at a time."""
    done = []
    for r in renames.orderBy("depth", F.lower("src"), "src").toLocalIterator():
        try:
            rename(r.src, f"{r.src}__case")
            rename(f"{r.src}__case", r.dst)
            done.append((r.src, r.dst, None))
        except Exception as e:
            done.append((r.src, r.dst, str(e)))
    return done


def apply_stats(log: DataFrame, order: str, most: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, errors by class, first failures in order) of applied moves (ok, error)."""
    failed = log.where(~F.col("ok"))
    totals = log.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("ok")).alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), (F.count_if(~F.col("ok")) > most).alias("truncated"))
    return totals, failed.groupBy(X.error_class(F.col("error")).alias("error_class")).agg(F.count(F.lit(1)).alias("n")), failed.orderBy(order).limit(most)


def title_updates(df: DataFrame, changes: DataFrame, most: int = 10_000) -> DataFrame:
    """New titles by instructions (path_pattern with % and _, new_title; the first pattern counts): reviewed by a human from then on. Case is ignored.

    Patterns with three literal characters together meet the paths that hold one of their trigrams (``matching.like_candidates``), whatever they begin with, and LIKE decides on
    what is left; only those with fewer, which have nothing to join on, are tried on each path. Instructions are people's, and over ``most`` are refused.
    """
    if changes.limit(most + 1).count() > most:
        raise ValueError(f"over {most} instructions")
    rules, like, paths = changes.select("path_pattern", "new_title"), F.expr("path ilike path_pattern escape '~'"), df.select("path_id", "path")
    keyed = F.length(M.literal_of("path_pattern")) >= 3
    parts = [M.like_candidates(paths, "path", rules.where(keyed), "path_pattern")]
    if not (few := rules.where(~keyed)).isEmpty():
        parts.append(paths.join(F.broadcast(few), like))
    hit = parts[0].where(like).select("path_id", "path_pattern", "new_title")
    for part in parts[1:]:
        hit = hit.unionByName(part.select("path_id", "path_pattern", "new_title"))
    best = hit.groupBy("path_id").agg(F.min_by("new_title", "path_pattern").alias("new_title"))
    out = df.join(best, "path_id", "left").withColumn("_c", F.col("new_title").isNotNull())
    return out.withColumns({"program_title": F.coalesce("new_title", "program_title"), "source": F.when(F.col("_c"), "human_reviewed").otherwise(F.col("source")), "human_reviewed": F.when(F.col("_c"), 1).otherwise(F.col("human_reviewed")), "needs_review": F.when(F.col("_c"), 0).otherwise(F.col("needs_review"))}).drop("_c", "new_title")


def in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(order)))
