"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector o is normalised, padded with zeros to ``EXPAND`` times its length and rotated at random; its code holds the sign of each coordinate, that is,
the nearest vertex v of a cube inscribed in the sphere. With c = <o/|o|, v> and a rotated query q, <o/|o|, q> is estimated by <v, q> / c, and
the error stays within |q| sqrt((1 - c^2) / c^2) epsilon / sqrt(bits - 1) except with a chance that falls fast in epsilon. More bits than coordinates
make the bound tight enough to leave out most vectors: it shrinks with the root of ``EXPAND``. Vectors whose upper bound reaches the k-th
product found so far are ranked by the inner product of the original vectors. So are, to begin with, those of the best estimates, which gives that product.

Every row is encoded once, none is sampled: code (packed bits), length and c are written beside the vector. Queries go to all tasks in turns of at most
``query_bytes``; a task reads its part of the index in blocks of ``block`` rows, unpacks their codes, and carries each query's best k, and so the product to
reach, from block to block. Only these k leave the task and are merged by query, so no vector is shuffled or copied.

Defined cases: vectors that are null, empty, all zero, or that hold null or non-finite components take no part, as queries or candidates, nor do
rows of null id; a query meets the vectors of its own length; every row is a candidate but the query's own, so other rows of one id
are; equal scores go to the smaller id. Fewer than k candidates give all of them. An empty table gives no rows. Columns other than the two are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.llm.common import materialize

EXPAND = 8  # bits for each coordinate of a vector
EPSILON = 4.5  # deviations that the error bound allows for
_turns: dict[int, np.ndarray] = {}


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    """dim x bits: what a random orthogonal matrix does to vectors padded with zeros."""
    if dim not in _turns:
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((-(-EXPAND * dim // 8) * 8, dim)))
        _turns[dim] = (q * np.sign(np.diag(r))).T
    return _turns[dim]


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes (bytes), lengths, and <o/|o|, v> of each row."""
    turn = rotation(x.shape[1])
    scale = np.abs(x).max(1)  # squares of the largest numbers don't fit
    length = np.linalg.norm(x / scale[:, None], axis=1) * scale
    y = (x / scale[:, None] / (length / scale)[:, None]) @ turn
    return np.packbits(y >= 0, axis=1), length, np.abs(y).sum(1) / np.sqrt(turn.shape[1])


def inner_products(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, coordinate after coordinate, so that equal vectors have equal scores wherever they lie."""
    out = np.zeros(len(x))
    for j, y in enumerate(query):
        out += x[:, j] * y
    return out


class Best:
    """The k nearest rows of each query among the blocks seen so far. own: the queries' rows in the index (-1: none); rows, ids, x: their numbers, ids and vectors."""

    def __init__(self, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        self.own, self.rows, self.ids, self.x, self.k = own, rows, ids, x, k
        turned = x @ rotation(x.shape[1])
        self.turned, self.length = turned.astype(np.float32), np.linalg.norm(x, axis=1)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(x)  # rows, ids, scores; best first
        self.seen = self.ranked = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, length: np.ndarray, c: np.ndarray, at_once: int = 128) -> None:
        bits = codes.shape[1] * 8
        signs = np.unpackbits(codes, axis=1).astype(np.float32)
        signs += signs - 1
        scale = (length / c / np.sqrt(bits)).astype(np.float32)
        spread = (length * np.sqrt(np.maximum(1 - c * c, 0)) / c * EPSILON / np.sqrt(max(bits - 1, 1)) + 1e-5 * length).astype(np.float32)
        for start in range(0, len(self.x), at_once):
            near = (self.turned[start : start + at_once] @ signs.T) * scale
            for i, estimate in enumerate(near, start):
                self._one(i, estimate, estimate + np.float32(self.length[i]) * spread, rows, ids, x)

    def _one(self, i: int, estimate: np.ndarray, high: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        own, q, k = self.own[i], self.x[i], self.k
        self.seen += len(rows)
        held = self.found[i]
        at = np.arange(len(rows))
        if len(held[0]) < k and len(rows) > 2 * k:  # the best estimates first, for a product to reach
            first = np.argpartition(-estimate, 2 * k)[: 2 * k]
            held = self._merge(held, rows[first], ids[first], inner_products(x[first], q), own)
            self.ranked += len(first)
            rest = np.ones(len(rows), bool)
            rest[first] = False
            at = np.flatnonzero(rest)
        if len(held[0]) == k:
            at = at[high[at] >= held[2][-1]]
        if len(at):
            self.ranked += len(at)
            held = self._merge(held, rows[at], ids[at], inner_products(x[at], q), own)
        self.found[i] = held

    def _merge(self, held: tuple, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, own: int) -> tuple:
        if own >= 0:
            other = rows != own
            rows, ids, scores = rows[other], ids[other], scores[other]
        rows, ids, scores = (np.concatenate(z) for z in zip(held, (rows, ids, scores), strict=True))
        order = np.lexsort((rows, ids, -scores))[: self.k]
        return rows[order], ids[order], scores[order]


def _usable(df: DataFrame, keep: Column) -> DataFrame:
    """(vec_id, e, asked) of the rows that take part; asked: whether ``keep`` holds."""
    e = F.col("embedding").cast("array<double>")
    sound = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"), F.coalesce(keep, F.lit(False)).alias("asked")).where(F.col("vec_id").isNotNull() & sound)


def _matrices(batch) -> Iterator[np.ndarray]:
    """Places of the rows of each length in a batch whose column ``e`` holds lists."""
    sizes = np.diff(batch.column("e").offsets.to_numpy())
    for dim in np.unique(sizes):
        yield np.flatnonzero(sizes == dim)


def _stack(column, at: np.ndarray) -> np.ndarray:
    import pyarrow as pa

    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def index(vectors: DataFrame, keep: Column) -> DataFrame:
    """(row, vec_id, e, asked, code, length, c) of every row that takes part, written."""
    import pyarrow as pa

    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("e", pa.list_(pa.float64())), ("asked", pa.bool_()), ("code", pa.binary()), ("length", pa.float64()), ("c", pa.float64())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _matrices(batch):
                codes, length, c = encode(_stack(batch.column("e"), at))
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([b.tobytes() for b in codes], pa.binary()), pa.array(length), pa.array(c)], schema=schema)

    rows = _usable(vectors, keep).select(F.monotonically_increasing_id().alias("row"), "vec_id", "e", "asked")
    return materialize(rows.mapInArrow(code, "row long, vec_id long, e array<double>, asked boolean, code binary, length double, c double"), "vectors")


def search(vectors: DataFrame, queries: Column | DataFrame, k: int = 20, query_bytes: int = 32_000_000, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of ``vectors`` (vec_id, embedding) to each query.

    queries: a condition on the rows of ``vectors``, which aren't candidates to themselves, or a table of its own (vec_id, embedding).
    """
    import pyarrow as pa

    own = isinstance(queries, Column)
    held = index(vectors, queries if own else F.lit(False))
    if own:
        asked = held.where("asked").select("row", "vec_id", "e")
    else:
        asked = materialize(_usable(queries, F.lit(True)).select(F.monotonically_increasing_id().alias("row"), "vec_id", "e"), "queries")
    size = asked.agg(F.sum(8 * (F.size("e") + 2)).alias("b")).first().b or 0
    turns = max(1, -(-size // query_bytes))
    kinds = "query_row long, query_id long, vec_id long, score double"

    def part(turn: int) -> DataFrame:
        found = asked.where(F.pmod(F.xxhash64("row"), F.lit(turns)) == turn).orderBy("vec_id", "row").toArrow().combine_chunks()
        batches = found.to_batches()
        waiting = [(b.column("row").to_numpy()[at], b.column("vec_id").to_numpy()[at], _stack(b.column("e"), at)) for b in batches for at in _matrices(b)]
        shared = vectors.sparkSession.sparkContext.broadcast(waiting)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {x.shape[1]: [] for *_, x in shared.value}
            for rows, ids, x in shared.value:
                best[x.shape[1]].append(Best(rows if own else np.full(len(rows), -1), rows, ids, x, k))
            parts: list[pa.RecordBatch] = []

            def work() -> None:
                table = pa.Table.from_batches(parts).combine_chunks().to_batches()
                parts.clear()
                for b in table:
                    for at in _matrices(b):
                        x = _stack(b.column("e"), at)
                        if x.shape[1] not in best:
                            continue
                        codes = np.frombuffer(b"".join(b.column("code").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                        numbers = (b.column(c).to_numpy()[at] for c in ("row", "vec_id", "length", "c"))
                        rows, ids, length, c = numbers
                        for q in best[x.shape[1]]:
                            q.add(rows, ids, x, codes, length, c)

            waiting = 0
            for batch in batches:
                if len(batch):
                    parts.append(batch)
                    waiting += len(batch)
                if waiting >= block:
                    work()
                    waiting = 0
            if parts:
                work()
            for q in (q for x in best.values() for q in x):
                for start in range(0, len(q.x), 4096):
                    out = [(np.full(len(f[0]), r), np.full(len(f[0]), i), f[1], f[2]) for r, i, f in zip(q.rows[start : start + 4096], q.ids[start : start + 4096], q.found[start : start + 4096], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_row", "query_id", "vec_id", "score"])

        return held.select("row", "vec_id", "e", "code", "length", "c").mapInArrow(walk, kinds)

    found = part(0)
    if turns > 1:
        parts = [materialize(part(i), "nearest") for i in range(turns)]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
    w = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
