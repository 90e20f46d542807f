"""Lenient numbers and flags, JSON guards, and small array helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolution_score(c: Column) -> Column:
    """``1920x1080`` to its product, a number to its integer part, all else 0."""
    p = r"(\d+)\s*[xX]\s*(\d+)"
    product = F.regexp_extract(c, p, 1).try_cast("long") * F.regexp_extract(c, p, 2).try_cast("long")
    return F.coalesce(F.when(c.rlike(p), product), F.when(c.rlike(r"^-?\d+(\.\d+)?$"), c.try_cast("double").cast("long")), F.lit(0).cast("long"))


def confidence(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def flag(c: Column, default: bool) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("1", "true", "yes", "on"), True).when(s.isin("0", "false", "no", "off"), False).otherwise(default)


def json_flag(data: Column, key: str) -> Column:
    """True, false or null (unknown) of a JSON value that is a boolean, number or word."""
    s = F.lower(F.trim(F.get_json_object(data, f"$.{key}")))
    n = s.try_cast("double")
    return F.when(s.isin("true", "yes"), True).when(s.isin("false", "no"), False).when(n.isNotNull(), n != 0)


def json_object(data: Column) -> Column:
    """The text if it is a JSON object, else ``{}``."""
    return F.when(F.try_parse_json(data).isNotNull() & F.coalesce(data, F.lit("")).rlike(r"(?s)^\s*\{"), data).otherwise("{}")


def json_map(data: Column) -> Column:
    """Top level of a JSON object as map<string,string>; null for anything else."""
    return F.from_json(data, "map<string,string>")


def json_fields(data: Column) -> Column:
    """Top level of a JSON object as map<string,variant>, whose values keep their types and whatever they hold; null for anything else."""
    return F.try_variant_get(F.try_parse_json(data), "$", "map<string,variant>")


def stable_json(m: Column) -> Column:
    """A map as JSON with sorted keys. The map is evaluated once."""
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m), by_key)))


def last_json_object(output: Column) -> Column:
    """The last line of a process's output that is a JSON object, as text; null without one."""
    lines = F.transform(F.split(F.coalesce(output, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.trim(x))
    return F.get(F.reverse(F.filter(lines, lambda x: F.startswith(x, F.lit("{")) & F.try_parse_json(x).isNotNull())), F.lit(0))


def three_valued(column: str) -> Column:
    """Inside an aggregation over flags 0, 1, null: TRUE if any is 1, FALSE if any is 0, else NULL, in whatever order."""
    return F.when(F.coalesce(F.bool_or(F.col(column) == 1), F.lit(False)), True).when(F.coalesce(F.bool_or(F.col(column) == 0), F.lit(False)), False)


def all_in(items: Column, allowed: list[str]) -> Column:
    """Empty lists are TRUE."""
    return F.forall(items, lambda x: x.isin(*allowed))


def some_text(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != ""))


def reasons(*rules: tuple[Column, str]) -> Column:
    """Array of the reasons whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in rules]))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds, null if none does; one CASE expression."""
    return reduce(lambda out, rule: out.when(rule[0], rule[1]), rules[1:], F.when(rules[0][0], rules[0][1]))
