"""Compression of vectors to one byte a part, with exact codebooks in whole numbers.

A component x becomes the integer floor(1024 x) and vectors are cut into ``parts`` equal consecutive parts; each part position has a codebook of ``entries`` entries.
A codebook starts as that part of the vectors of least ids. A round assigns every part to its nearest entry, ties to the lower index, and replaces entries by
the mean of their parts, rounded down; entries without parts stay. After the last round parts are assigned once more.

Nearest entries are found by one float32 matrix product for a block: |c|^2 - 2 x.c is the squared distance but for what all entries share. Any order of summing k products in
float32 errs by at most (k + 4) u / (1 - (k + 4) u) of the sum of their sizes (u = 2^-24; roundings of the factors and of the difference are in the 4), and that sum is at
most |x| |c|. So each value lies in an interval; entries whose interval reaches down to the best one's upper end are worked out again in int64, and ties go by index. Distances
are int64 always. A task gives the sums of its rows' parts, at most parts x entries rows, and the codebooks, whose size is set by the parameters, go to all tasks.

Defined cases: rows whose vector is null, or that hold null or non-finite components, go; all others stay, repeated ones too. Equal ids start codebooks in the order of their
vectors, null ids after all others. Fewer vectors than entries make shorter codebooks. The dimension is that of the vector of least id; vectors of another one
have null code, error and label_error of their own and count for nothing. Dimensions that ``parts`` doesn't divide are filled with zeros. Integers are held to +-2^26, so that
squares and their sums fit 64 bits. An empty table gives no rows. Of other columns only the label is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import join_hot, materialize

SCALE, LIMIT = 1024, 2**26
UNIT = 2.0**-24


def intervals(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Screened |c|^2 - 2 x.c of each row and entry, and by how much each may be off."""
    length = np.einsum("ij,ij->i", book.astype(np.float64), book)  # sums of up to 2^60, off by no more than a few parts in 2^52
    value = length.astype(np.float32) - 2 * (x.astype(np.float32) @ book.astype(np.float32).T)
    size = np.sqrt(np.einsum("ij,ij->i", x.astype(np.float64), x))
    k = (x.shape[1] + 4) * UNIT
    off = 2 * k / (1 - k) * size[:, None] * np.sqrt(length) + 2 * UNIT * (length + 2 * size[:, None] * np.sqrt(length))
    return value, off * (1 + 2.0**-20)


def nearest(x: np.ndarray, book: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance of each row of int64 parts."""
    found, squares = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for start in range(0, len(x), block):
        part = x[start : start + block]
        value, off = intervals(part, book)
        open_ = value - off <= (value + off).min(1, keepdims=True)
        row, entry = np.nonzero(open_)  # entries ascend within a row
        d = part[row] - book[entry]
        square = np.einsum("ij,ij->i", d, d)
        order = np.lexsort((entry, square, row))
        first = order[np.unique(row, return_index=True)[1]]
        found[start : start + block], squares[start : start + block] = entry[first], square[first]
    return found, squares


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry, and position within the part."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _whole(vectors: DataFrame, embedding: str) -> tuple[DataFrame, Column]:
    e = F.col(embedding).cast("array<double>")
    sound = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))  # null for a null vector
    return vectors.where(sound), F.transform(e, lambda v: F.least(F.greatest(F.floor(v * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))


def _parts(column, dim: int, parts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of that dimension in a column of lists, and their parts: rows x parts x width."""
    import pyarrow as pa

    at = np.flatnonzero(np.diff(column.offsets.to_numpy()) == dim)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), dim)
    return at, np.pad(flat, ((0, 0), (0, parts * width - dim))).reshape(len(at), parts, width)


def train(held: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[int, np.ndarray]:
    """Dimension and codebooks (parts x entries x width) of ``held`` (vec_id, v array<int>), which each round reads once."""
    import pyarrow as pa

    least = held.orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).collect()
    dim = len(least[0].v) if least else 0
    width = -(-dim // parts)
    same = held.where(F.size("v") == dim)
    first = same.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()  # as many as a codebook has
    start = np.array([r.v for r in first], np.int64).reshape(len(first), dim)
    books = np.pad(start, ((0, 0), (0, parts * width - dim))).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    kinds = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
    for _ in range(rounds if dim else 0):
        shared = held.sparkSession.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books = shared.value
            n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                _, x = _parts(batch.column(0), dim, parts, width)
                for p in range(parts):
                    found, _ = nearest(x[:, p], books[p])
                    n[p] += np.bincount(found, minlength=len(books[p]))
                    np.add.at(total[p], found, x[:, p])
            part, entry = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(total[part, entry].tolist(), kinds.field("sums").type)], schema=kinds)

        made = same.select("v").mapInArrow(sums, "part int, entry int, n long, sums array<long>").groupBy("part", "entry")
        for r in made.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect():  # parts x entries at most
            books[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
        shared.destroy()
    return dim, books


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every vector that stays, and the codebooks. ``entries`` is 256 at most: an index is two hex digits."""
    import pyarrow as pa

    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    rows, v = _whole(vectors, embedding)
    held = materialize(rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v")), "integers")
    dim, books = train(held.select("vec_id", "v"), parts, entries, rounds)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            codes, errors = np.full(len(batch), None, object), np.full(len(batch), None, object)
            at, x = _parts(batch.column(2), dim, parts, books.shape[2])
            if len(at):
                found, squares = zip(*(nearest(x[:, p], books[p]) for p in range(parts)), strict=True)
                codes[at] = [row.tobytes().hex() for row in np.stack(found, 1).astype(np.uint8)]
                errors[at] = np.sum(squares, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = held.schema["label"].dataType.simpleString()
    return held.mapInArrow(assign, f"vec_id long, label {kind}, code string, error long"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the sum of ``error`` over the rows of equal labels, null labels together. ``coded`` is read more than once; labels that many rows share meet their sum without a shuffle."""
    keyed = coded.withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    return join_hot(keyed, sums, ["_none", "_label"], "_n").drop("_none", "_label")


def compress_and_sum(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256)."""
    coded, books = compress(vectors)
    return with_label_error(materialize(coded, "codes")).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
