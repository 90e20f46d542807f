"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source is a periodic task whose integer weight is its share of a cycle. The k-th block of a source with share w (from 0)
is released at floor(k / w) and due at ceil((k + 1) / w); every slot goes to the released block with the earliest deadline.
On one processor this meets all deadlines, so after any number of slots a source is less than one block from its share.
The schedule depends on the weights alone and repeats after one cycle, whose slots the driver lays out (about ``max_cycle`` and one
for each source at most, whatever the number of documents); documents find theirs by joining on the block's number within the cycle.

Defined cases: a null source is a source of its own; a source without documents has no block and its slots stay idle, as do
those of a source that has run out: the others keep their proportions. Every row is placed once: none is dropped or repeated.
Ties of doc_id are broken by a hash of the text; equal rows, however many, are dealt their places by their number among themselves. An
empty table gives an empty schedule. Texts are of any length: they are hashed where they lie and meet their places in one join.
Columns named like an output or with a leading ``_`` are dropped; others pass through.
Every source has a task of its own. Only if ``max_sources`` is given do the smallest sources beyond it share one, interleaved by doc_id.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import id_key, materialize, ranked, without


def pfair_cycle(weights: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(task, block, slot, release, deadline) for one cycle of sum(weights) slots; ties of deadlines go to the lower task."""
    total = sum(weights)
    waiting = [(0, i, 0) for i, w in enumerate(weights) if w > 0]  # release, task, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            release, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[i]), i, k, release))
        deadline, i, k, release = heapq.heappop(ready)
        out.append((i, k, slot, release, deadline))
        if k + 1 < weights[i]:
            heapq.heappush(waiting, ((k + 1) * total // weights[i], i, k + 1))
    return out


def integer_weights(weights: dict, max_cycle: int, exact_cycle: int = 1_000_000) -> dict:
    """Shares as integers of at least 1 in their exact proportion, if a cycle of up to ``exact_cycle`` slots has it; else of a cycle of
    ``max_cycle`` slots (one for each source at least), by largest remainders, so that a share is less than one slot of the cycle off."""
    exact = {k: Fraction(str(v)) for k, v in weights.items() if v > 0}
    if not exact:
        return {}
    common = math.lcm(*(v.denominator for v in exact.values()))
    whole = {k: int(v * common) for k, v in exact.items()}
    least = math.gcd(*whole.values())
    whole = {k: v // least for k, v in whole.items()}
    total = sum(whole.values())
    if total <= exact_cycle:
        return whole
    out = {k: max(1, v * max_cycle // total) for k, v in whole.items()}
    for k in sorted(whole, key=lambda k: (-(whole[k] * max_cycle % total), str(k)))[: max(0, max_cycle - sum(out.values()))]:
        out[k] += 1
    return out


def temperature_weights(docs: DataFrame, temperature: float, max_sources: int | None, max_cycle: int) -> tuple[list[tuple], list[int]]:
    """(source, task, weight) rows and the weight of the shared task, if any: share of each source in proportion to its documents to the power 1 / temperature.

    With ``max_sources``, the largest ``max_sources`` - 1 sources have tasks of their own; the others share the last one.
    """
    counts = docs.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.toArrow()
    sizes = sorted(zip(found["_source"].to_pylist(), found["_n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))
    own = sizes if max_sources is None else sizes[: max_sources - 1]
    rest = sum(n for _, n in sizes[len(own) :])
    power = {s: float(n) ** (1 / temperature) for s, n in own}
    shared = {"": float(rest) ** (1 / temperature)} if rest else {}
    total = sum(power.values()) + sum(shared.values())
    as_int = lambda x: max(1, int(x / total * max_cycle + 0.5))
    order = sorted(power, key=lambda s: (s is not None, s or ""))
    return [(s, i, as_int(power[s])) for i, s in enumerate(order)], ([as_int(shared[""])] if shared else [])


def mix_sources(docs: DataFrame, weights: dict | None = None, *, temperature: float = 2.0, block_docs: int = 16, max_sources: int | None = None, max_cycle: int = 10_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with ``block`` (of its source, from 0), ``release``, ``deadline``, ``slot`` (all in slots), ``position`` (from 0).

    weights: source to share; sources that it doesn't name share the key "*" (weight 1 if absent). Without weights, shares follow
    the sources' sizes to the power 1 / temperature. A block is ``block_docs`` consecutive documents of a source.
    Sources and slots go to every task up to ``broadcast_rows`` of them; more meet the documents in a shuffle.
    """
    import pyarrow as pa

    spark, docs = docs.sparkSession, without(docs, "block", "release", "deadline", "slot", "position")
    if weights is None:
        tasks, shared = temperature_weights(docs, temperature, max_sources, max_cycle)
    else:
        named = integer_weights(weights | ({} if "*" in weights else {"*": 1}), max_cycle)
        shared = [named.pop("*", 1)]
        if max_sources is not None and len(named) >= max_sources:
            raise ValueError(f"{len(named)} weights; max_sources is {max_sources}")
        tasks = [(s, i, named[s]) for i, s in enumerate(sorted(named, key=lambda s: (s is not None, s or "")))]
    shares = [w for *_, w in tasks] + shared
    cycle = sum(shares)
    small = lambda df, n: F.broadcast(df) if n <= broadcast_rows else df
    table = lambda rows, schema: spark.createDataFrame(pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.values(), strict=True)], list(schema)))
    slots = table(pfair_cycle(shares), {"_task": pa.int32(), "_kc": pa.int64(), "_t": pa.int64(), "_r": pa.int64(), "_d": pa.int64()})
    names = table(tasks, {"_source": pa.string(), "_t0": pa.int32(), "_w0": pa.int64()})
    row = docs.join(small(names, len(tasks)), F.col("source").eqNullSafe(F.col("_source")), "left")
    row = row.withColumn("_task", F.coalesce("_t0", F.lit(len(tasks)))).withColumn("_w", F.coalesce("_w0", F.lit((shared or [1])[0]).cast("long"))).drop("_source", "_t0", "_w0")
    row = row.withColumns({"_k": id_key("doc_id", "text"), "_x": F.xxhash64("text")})
    keys = materialize(row.select("_k", "_x", "_task", "_w"), "mix-keys")
    at = ranked(keys, ["_task"], ["_k", "_x"], "_rank")
    at = at.withColumn("_b", F.floor(F.col("_rank") / block_docs))
    at = at.withColumn("_cycle", F.floor(F.col("_b") / F.col("_w"))).withColumn("_kc", F.col("_b") % F.col("_w"))
    at = at.join(small(slots, cycle), ["_task", "_kc"])
    start = F.col("_cycle") * cycle
    at = at.select("_k", "_x", "_task", "_rank", F.col("_b").alias("block"), (start + F.col("_r")).alias("release"), (start + F.col("_d")).alias("deadline"), (start + F.col("_t")).alias("slot"))
    at = materialize(ranked(materialize(at, "mix-slots"), [], ["slot", "_rank"], "position"), "mix-positions")
    # Equal rows of a source have ranks in a row and are dealt places by number; all others meet theirs by id and text alone.
    same = ["_k", "_x", "_task"]
    repeated = materialize(at.groupBy(*same).agg(F.count(F.lit(1)).alias("_n"), F.min("_rank").alias("_least")).where("_n > 1"), "mix-repeated")
    row = row.drop("_w")
    if repeated.isEmpty():
        return row.join(at.drop("_rank"), same).drop(*same)
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    several = small(repeated.select(*same))
    once = row.join(several, same, "left_anti").join(at.drop("_rank"), same)
    places = at.join(small(repeated.drop("_n")), same).withColumn("_copy", F.col("_rank") - F.col("_least")).drop("_rank", "_least")
    copies = ranked(materialize(row.join(several, same, "left_semi"), "mix-copies"), same, [], "_copy")
    return once.unionByName(copies.join(places, [*same, "_copy"]).select(*once.columns)).drop(*same)
