"""Registry of queries, and tables by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """``t.orders`` reads the table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None):
    """Registers a function of ``Tables`` under its name, with the SQL it is compared with."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def literal(v) -> str:
    """A value as SQL."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values(rows: list[tuple], names: str) -> str:
    """Rows as a SQL table with a number ``i`` from 0 and these columns."""
    body = ", ".join(f"({i}, {', '.join(map(literal, r))})" for i, r in enumerate(rows))
    return f"(values {body}) as c(i, {names})"


def by_case(table: str, key: str, given: list[tuple], want: list[tuple], names: str, types: str | None = None):
    """Registers a function of ``Columns`` (one for each given value) to Columns, applied to each row of a table with the row's case: number ``key`` modulo the cases.

    What each case gives is written out in ``want``, and stands in the SQL as it is.
    """
    kinds = (types or ", ".join(["string"] * len(given[0]))).split(", ")
    sql = f"select {key}, {names} from {table} join {values(want, names)} on {key} % {len(given)} = i"

    def register(f):
        def run(t: Tables) -> DataFrame:
            case = (F.col(key) % len(given)).cast("int")
            inputs = [F.get(F.array(*[F.lit(g[j]) for g in given]).cast(f"array<{kind}>"), case) for j, kind in enumerate(kinds)]
            rows = getattr(t, table).select(key, *[c.alias(f"_{j}") for j, c in enumerate(inputs)])
            out = f(*[F.col(f"_{j}") for j in range(len(inputs))])
            return rows.select(key, *[c.alias(n) for n, c in zip(names.split(", "), out if isinstance(out, (list, tuple)) else [out], strict=True)])

        run.__name__ = f.__name__
        query(sql)(run)
        return f

    return register
