"""Deterministic keys, bit for bit: name-based UUIDs (version 5), short digests, grouping and match keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.functions import text as X

#: Name spaces of identifiers.
PATHS = "f4f67a6f-90c6-4ee4-9c1a-2c0d25b3b0c4"
FILES = "88e78892-867e-4e54-b432-2f251e75ac9f"
URLS = str(uuid.NAMESPACE_URL)


def uuid5(namespace: str, name: Column) -> Column:
    """The digest, and ``name`` with it, is evaluated once for a row, inside a CASE too."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))

    def parts(h: Column) -> Column:
        variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))

    return F.get(F.transform(F.array(digest), parts), F.lit(0))


def path_id(path: Column, namespace: str = PATHS) -> Column:
    return uuid5(namespace, F.concat(F.lit("winpath:"), X.id_path(path)))


def file_id(path_id: Column, namespace: str = FILES) -> Column:
    return uuid5(namespace, F.concat(F.lit("path:"), path_id))


def program_id(key: Column) -> Column:
    return uuid5(URLS, F.concat(F.lit("program_key:"), key))


def broadcast_id(match_key: Column, seed: Column) -> Column:
    name = F.when(match_key != "", F.concat(F.lit("broadcast_match_key:"), match_key)).otherwise(F.concat(F.lit("broadcast_fallback:"), X.empty(seed)))
    return uuid5(URLS, name)


def franchise_id(name: Column) -> Column:
    return uuid5(URLS, F.concat(F.lit("franchise:"), name))


def group_id(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 16)


def dedup_key(title_key: Column, episode: Column, subtitle: Column) -> Column:
    """Episode, else subtitle with single spaces; null for unknown titles and without either."""
    ep, sub = X.strip(X.empty(episode.cast("string"))), X.strip(X.empty(subtitle))
    return F.when(title_key == "unknown", None).when(ep != "", F.concat_ws("::", title_key, F.lit("ep"), ep)).when(sub != "", F.concat_ws("::", title_key, F.lit("sub"), X.subtitle_key(sub)))


def dedup_key_reason(title_key: Column, episode: Column, subtitle: Column) -> Column:
    return F.when(title_key == "unknown", "missing_program_title").when(dedup_key(title_key, episode, subtitle).isNull(), "missing_episode_and_subtitle")


def episode_key(title_key: Column, episode: Column, subtitle: Column, air_date: Column) -> Column:
    """As ``dedup_key``, but the subtitle keeps its spaces and the air date stands in last."""
    ep, sub, day = (X.strip(X.empty(c.cast("string"))) for c in (episode, subtitle, air_date))
    return F.when(title_key == "unknown", None).when(ep != "", F.concat_ws("::", title_key, F.lit("ep"), ep)).when(sub != "", F.concat_ws("::", title_key, F.lit("sub"), F.lower(sub))).when(day != "", F.concat_ws("::", title_key, F.lit("date"), day))


def _part(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(X.empty(c)), X.FORBIDDEN, ""), X.SPACES, "_"), "^_+|_+$", "")


def guide_match_key(title: Column, broadcaster: Column, air_date: Column, start: Column) -> Column:
    """title::broadcaster::date::time; null if title, date or time is missing."""
    there = (X.empty(title) != "") & (X.empty(air_date) != "") & (X.empty(start) != "")
    return F.when(there, F.concat_ws("::", _part(title), _part(broadcaster), air_date, start))


def file_match_key(base: Column, air_date: Column, start: Column) -> Column:
    there = (X.empty(base) != "") & air_date.isNotNull() & start.isNotNull()
    return F.when(there, F.concat_ws("::", _part(base), air_date, start))


def datetime_key(air_date: Column, start: Column) -> Column:
    return F.when((X.empty(air_date) != "") & (X.empty(start) != ""), F.concat_ws("::", air_date, start))


def without_broadcaster(match_key: Column) -> Column:
    """A four-part guide key as the three-part key of file names."""
    p = F.split(match_key, "::")
    return F.when(F.size(p) == 4, F.concat_ws("::", p[0], p[2], p[3]))


def set_hash(ids: Column) -> Column:
    """16 digits over the sorted ids; ``ids`` is a column inside an aggregation."""
    return F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(ids)), "\n"), 256), 1, 16)


def short_hash(c: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)
