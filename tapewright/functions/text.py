"""Text functions. White space is Unicode's, as (?U) asks for; trimming is of white space, not of spaces alone.

Compatibility normalisation (NFKC) and case folding have no built-in: ``nfkc`` and ``casefold`` are Arrow batch functions, and ``normalized_map``
applies them to distinct values only. All else stays in Column expressions.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that names can't hold, and what counts as space.
FORBIDDEN = r'[<>:"/\\|?*]'
SPACES = r"(?U)[\s\u3000]+"
#: Marks that separate a programme's title from its subtitle.
SEPARATORS = "[▽▼◇「]"
#: An episode's number, a number at the end, a quoted subtitle, and words and a mark that label a programme.
EPISODE, FINAL_NUMBER = r"(?U)第\s*(\d+)\s*話", r"(?U)\((\d+)\)\s*$"
QUOTED, LABELS, LABEL_MARK = "「([^」]{1,120})」", "名作選|傑作選", "選"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\u3000]+|[\s\u3000]+$", "")


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def nfkc(c: Column) -> Column:
    """NFKC; for ASCII it is the identity, so prefer ``normalized_map`` on tables."""
    def apply(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(apply, T.StringType())(c)


def casefold(c: Column) -> Column:
    """NFKC, case folding and strip: the form in which titles are compared."""
    def apply(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold().strip())

    return F.pandas_udf(apply, T.StringType())(c)


def normalized_map(df: DataFrame, column: str, form, name: str) -> DataFrame:
    """``df`` with ``name`` = form(column), where the batch function sees only distinct values beyond ASCII; for others ``form`` must equal its ASCII part.

    form: ``nfkc`` (identity on ASCII) or ``casefold`` (lower case and strip on ASCII).
    """
    plain = strip(F.lower(column)) if form is casefold else F.col(column)
    other = F.col(column).rlike(r"[^\x00-\x7F]")
    values = df.where(other).select(column).distinct().select(column, form(F.col(column)).alias("_form"))
    return df.join(values, column, "left").withColumn(name, F.when(other, F.col("_form")).otherwise(plain)).drop("_form")


def program_key(c: Column) -> Column:
    """Key of a title that is already in NFKC (any ASCII one is): lower, spaces to ``_``, forbidden characters gone, ``unknown`` if empty."""
    t = F.regexp_replace(F.lower(strip(empty(c))), SPACES, "_")
    t = F.regexp_replace(F.regexp_replace(t, FORBIDDEN, ""), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(t, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def compact_lower(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(empty(c)), SPACES, ""), FORBIDDEN, "")


def display_key(c: Column) -> Column:
    """Spaces to ``_``, forbidden characters gone, case kept, ``UNKNOWN`` if empty."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(empty(c)), SPACES, "_"), FORBIDDEN, ""), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(t, "^_+|_+$", ""), F.lit("")), F.lit("UNKNOWN"))


def single_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(empty(c), SPACES, " "))


def subtitle_key(c: Column) -> Column:
    return F.regexp_replace(strip(F.lower(empty(c))), r"(?U)\s+", " ")


def windows_path(c: Column) -> Column:
    """``/mnt/x/a/b`` to ``X:\\a\\b``; slashes to backslashes; drive letter upper."""
    mount = F.regexp_extract(c, r"^/mnt/([A-Za-z])(?:/|$)", 1)
    flat = F.translate(F.when(mount != "", F.concat(mount, F.lit(":\\"), F.substring(c, 8, 1 << 30))).otherwise(c), "/", "\\")
    return F.when(flat.rlike("^[A-Za-z]:"), F.concat(F.upper(F.substring(flat, 1, 1)), F.substring(flat, 2, 1 << 30))).otherwise(flat)


def mount_path(c: Column) -> Column:
    """``X:\\a\\b`` to ``/mnt/x/a/b``; other paths with slashes."""
    rest = F.translate(F.substring(c, 3, 1 << 30), "\\", "/")
    return F.when(c.rlike("^[A-Za-z]:"), F.concat(F.lit("/mnt/"), F.lower(F.substring(c, 1, 1)), rest)).otherwise(F.translate(c, "\\", "/"))


def id_path(c: Column) -> Column:
    return F.lower(F.translate(c, "/", "\\"))


def path_parts(c: Column) -> Column:
    """struct(drive, dir, name, ext); drive without the colon, ext lower with its dot; null without."""
    p = F.translate(c, "/", "\\")
    drive = F.regexp_extract(p, "^([A-Za-z]):", 1)
    name = F.element_at(F.split(p, r"\\"), -1)
    ext = F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))
    nul = lambda x: F.nullif(x, F.lit(""))
    return F.struct(nul(drive).alias("drive"), F.regexp_extract(p, r"^(.*)\\[^\\]*$", 1).alias("dir"), name.alias("name"), nul(ext).alias("ext"))


def safe_dir(c: Column, most: int = 60) -> Column:
    s = F.regexp_replace(strip(empty(c)), r"[\x00-\x1f]", "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, FORBIDDEN, "＿"), SPACES, " "), r"[. ]+$", "")
    s = F.coalesce(F.nullif(s, F.lit("")), F.lit("UNKNOWN"))
    short = F.concat(F.regexp_replace(F.substring(s, 1, most - 9), r"(?U)\s+$", ""), F.lit("_"), F.substring(F.sha1(s), 1, 8))
    return F.when(F.length(s) > most, short).otherwise(s)


def safe_group(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(empty(c), "[^0-9A-Za-z._-]+", "_"), "_+", "_")
    s = F.substring(F.regexp_replace(s, "^[._-]+|[._-]+$", ""), 1, 120)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("group"))


def has_separator(c: Column) -> Column:
    return empty(c).rlike(SEPARATORS)


def before_separator(c: Column) -> Column:
    return strip(F.split(empty(c), SEPARATORS, 2)[0])


def folder_title(path: Column) -> Column:
    """The path segment after ``by_program``, else after ``videolibrary``; null if neither has one."""
    parts = F.split(empty(path), r"\\")
    lower = F.transform(parts, lambda x: F.lower(x))
    inner = F.slice(lower, 1, F.size(lower) - 1)
    after = lambda name: F.when(F.array_position(inner, name) > 0, F.get(parts, F.array_position(inner, name).cast("int")))
    return F.coalesce(after("by_program"), after("videolibrary"))


def swallowed(folder: Column, title: Column, extra: int = 8) -> Column:
    """Both compared in their normal form: the title begins with the folder's and is ``extra`` characters or more longer."""
    return F.coalesce((folder != "") & (title != folder) & F.startswith(title, folder) & (F.length(title) >= F.length(folder) + extra), F.lit(False))


def shortened(folder: Column, title: Column, extra: int = 3) -> Column:
    return F.coalesce((title != "") & (title != folder) & F.startswith(folder, title) & (F.length(folder) >= F.length(title) + extra), F.lit(False))


#: Rows of the kana table, folder and last character of each.
KANA_ROWS = [("ア", "オ"), ("カ", "ゴ"), ("サ", "ゾ"), ("タ", "ド"), ("ナ", "ノ"), ("ハ", "ポ"), ("マ", "モ"), ("ヤ", "ヨ"), ("ラ", "ロ"), ("ワ", "ン")]


def syllabary(title: Column) -> Column:
    """Kana row of the first character (of a title in NFKC), ``MV`` for all others."""
    first = F.substring(empty(title), 1, 1)
    hiragana = "".join(map(chr, range(0x3041, 0x3097)))
    kata = F.translate(first, hiragana, "".join(chr(ord(x) + 0x60) for x in hiragana))
    out = F
    for folder, last in KANA_ROWS:
        out = out.when((kata >= folder) & (kata <= last), folder)
    return out.otherwise("MV")


def layout_name(c: Column) -> Column:
    return F.when(c == "by_series", "by_title").otherwise(c)


def genre_matches(genre: Column, pattern: Column) -> Column:
    """Equality, or for ``X - *`` the beginning ``X``."""
    return F.when(F.endswith(pattern, F.lit(" - *")), F.startswith(genre, F.substring(pattern, 1, F.length(pattern) - 4))).otherwise(genre == pattern)


def episode_number(c: Column) -> Column:
    """``第N話``, else a final ``(N)``."""
    a, b = F.regexp_extract(c, EPISODE, 1), F.regexp_extract(c, FINAL_NUMBER, 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))).try_cast("int")


def quoted_subtitle(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, QUOTED, 1), F.lit(""))


def drop_labels(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.regexp_replace(c, LABELS, ""), F.lit(LABEL_MARK), F.lit("")), "^[ _-]+|[ _-]+$", "")


#: Forms of a file's base name, by precedence, and the titles that two of them stand for; label words; lengths.
LOCAL_FORM, LOCAL_TITLE = "^【NHK地域局発】(.+)$", "NHK地域局発"
HEART_FORM, HEART_TITLE = r"(?U)^【ハートネット(?:TV|tv|ｔｖ)】\s*虹クロ[_\s]*(.+)$", "虹クロ"
ANOTHER_FORM, ANOTHER_TITLE = "アナザーストーリーズ(?:選)?(.+)$", "アナザーストーリーズ"
QUOTED_FORM = "^[『「]([^』」]+)[』」](.*)$"
TAGGED_FORM, SPECIAL_TAG = r"(?U)^【([^】]+)】\s*(.+)?$", "特選"
SUBTITLE_LENGTH, TITLE_LENGTH = 120, 80


def program_and_subtitle(base: Column) -> Column:
    """struct(program, subtitle) of a file's base name, by the first rule that fits."""
    nul = lambda x: F.nullif(x, F.lit(""))
    edge = lambda x: F.regexp_replace(x, "^[_ ]+|[_ ]+$", "")
    pair = lambda p, s: F.struct(p.alias("program"), s.cast("string").alias("subtitle"))
    head = lambda x: F.split(F.split(x, " ", 2)[0], "_", 2)[0]
    cut = lambda x: F.split(x, "[▼▽]", 2)[0]
    null = F.lit(None).cast("string")
    local = F.regexp_extract(base, LOCAL_FORM, 1)
    heart = edge(F.regexp_extract(base, HEART_FORM, 1))
    another = F.regexp_replace(F.regexp_extract(base, ANOTHER_FORM, 1), "^選+", "")
    q_title, q_rest = drop_labels(strip(F.regexp_extract(base, QUOTED_FORM, 1))), drop_labels(edge(F.regexp_extract(base, QUOTED_FORM, 2)))
    q_sub = F.coalesce(quoted_subtitle(q_rest), quoted_subtitle(base))
    tag, rest = drop_labels(strip(F.regexp_extract(base, TAGGED_FORM, 1))), drop_labels(edge(F.regexp_extract(base, TAGGED_FORM, 2)))
    tok = head(rest)
    special = F.startswith(tag, F.lit(SPECIAL_TAG)) & (rest != "") | (rest != "") & (F.length(tok) >= 2) & ~F.startswith(tok, F.lit("▼"))
    return (
        F.when(local != "", pair(F.lit(LOCAL_TITLE), nul(drop_labels(edge(local)))))
        .when(heart != "", pair(F.lit(HEART_TITLE), nul(F.substring(F.coalesce(quoted_subtitle(heart), edge(cut(heart))), 1, SUBTITLE_LENGTH))))
        .when(F.contains(base, F.lit(ANOTHER_TITLE)), pair(F.lit(ANOTHER_TITLE), nul(F.substring(F.trim(cut(F.translate(another, "_", " "))), 1, SUBTITLE_LENGTH))))
        .when(base.rlike("^[『「][^』」]+[』」]"), pair(q_title, F.when(q_sub != q_title, q_sub)))
        .when(base.rlike("^【[^】]+】"), F.when(special, pair(tok, quoted_subtitle(rest))).otherwise(pair(tag, null)))
        .otherwise(pair(F.substring(strip(head(base)), 1, TITLE_LENGTH), quoted_subtitle(base)))
    )


def expand_rule(base: Column, pattern: str, replacement: str) -> Column:
    """The replacement with ``\\1``-style references filled in, null where the pattern isn't found."""
    java = replacement.replace("$", r"\$")
    for i in range(9, 0, -1):
        java = java.replace(f"\\{i}", f"${i}")
    return F.when(base.rlike(pattern), F.regexp_replace(F.regexp_substr(base, F.lit(pattern)), pattern, java))


def overlap_score(base: Column, candidate: Column) -> Column:
    """10,000 for equal compact forms, the shorter's length if one holds the other, else the lengths of the base's tokens that the candidate holds."""
    b, c = compact_lower(base), compact_lower(candidate)
    tokens = F.transform(F.split(single_spaces(base), r"(?U)[\s_]+"), compact_lower)
    parts = F.aggregate(F.filter(tokens, lambda t: (t != "") & F.contains(c, t)), F.lit(0), lambda a, t: a + F.length(t))
    return F.when((b == "") | (c == ""), 0).when(b == c, 10_000).when(F.contains(c, b), F.length(b)).when(F.contains(b, c), F.length(c)).otherwise(parts)


def preview(c: Column, most: int = 220) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def append_reason(reasons: Column, reason: Column) -> Column:
    """Comma-separated reasons with one more, none twice."""
    parts = F.filter(F.split(empty(reasons), ","), lambda x: F.trim(x) != "")
    return F.array_join(F.array_distinct(F.concat(F.transform(parts, lambda x: F.trim(x)), F.array(reason))), ",")


def error_class(c: Column) -> Column:
    return F.trim(F.substring_index(c, ":", 1))


def strip_date_suffix(name: Column) -> Column:
    """A file name up to its date and time, without trailing marks; without a date, without its extension."""
    from tapewright.functions.dates import FILE_DATES

    out = F
    for p in FILE_DATES:
        at = F.regexp_instr(name, F.lit(p))
        out = out.when(at > 0, F.regexp_replace(F.substr(name, F.lit(1), at - 1), "[ _-]+$", ""))
    return out.otherwise(F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", ""))


def batch_output_name(c: Column) -> Column:
    return F.replace(c, F.lit("_input.jsonl"), F.lit("_output.jsonl"))
