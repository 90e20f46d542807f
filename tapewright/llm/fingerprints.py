"""Document fingerprints as invertible Bloom lookup sketches.

Paragraphs (lines) are hashed whole, and again in pieces of a few words, cut at content-defined places: many texts have one paragraph or few, and an edit
changes the pieces around it alone. Each digest, with its number among equal ones, is an item. A sketch of m cells adds an item to
three cells: a count, the xor of keys and the xor of checksums. Subtracting two sketches cancels common items; peeling cells
that hold one item recovers the digests on either side only. Sketches that are compared hold sums modulo 2^64 in place of xors and are sized by the
difference that a fourth of the keys lets expect; if peeling fails, both texts are sketched anew with ``GROWTH`` times the cells.
Likeness is the Jaccard similarity of the two item sets, from their sizes and the recovered difference. The rule is one for texts of any size;
a text of one to four words is often a single piece, which any edit changes, so that its likeness to an edited copy is 0.

Defined cases: a null text is an empty one, with no items; two texts without items are alike (1), one without and one with are not (0).
Equal texts have equal sketches. The sketch of ``BASE`` cells, with the item count, is the fingerprint string (base64); ``decode`` reads it back.
The next document is by doc_id, rows of one id by a hash of their texts, and null ids stand first, by such a hash; the last row's next is the first. Repeated
rows are documents each and follow one another; rows repeated more than 512 times are compared once and dealt out. A single row is its own next; an empty table gives no rows. Texts are whole, of any length: two
are held beside a small batch. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import id_key, materialize, text_batches

#: Cells of the first sketch, each part of which takes one third; retries multiply by GROWTH.
BASE, GROWTH, PARTS = 24, 16, 3
#: A piece ends after a word whose hash is 0 modulo PIECE_WORDS, and after MOST_WORDS words.
PIECE_WORDS, MOST_WORDS = 2, 6
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Which bytes are white space, and a random number for each byte at each place (modulo 64) of a word.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
with np.errstate(over="ignore"):
    _BYTES = _mix(np.arange(1, 64 * 256 + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def items_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owners): for each text, by its number, the distinct 64-bit keys of its paragraphs and their pieces, ascending within a text.

    Words end at ASCII white space. White space at a line's ends and between words doesn't count, nor do blank lines.
    """
    coded = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
    space = _SPACE[data] if len(data) else np.zeros(0, bool)
    start = np.flatnonzero(~space & np.append(True, space[:-1]))  # of words; each ends before a space, as each text does
    n = len(start)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    end = np.flatnonzero(space & np.append(False, ~space[:-1]))
    with np.errstate(over="ignore"):
        at = np.flatnonzero(~space)
        place = at - np.repeat(start, end - start)
        h = _BYTES[(place & 63) << 8 | data[at]]
        if (end - start).max() > 64:
            h = h * ((place >> 6).astype(_U) * _U(2) + _U(1))
        first = np.cumsum(end - start) - (end - start)
        h = _mix(np.add.reduceat(h, first) + (end - start).astype(_U))
        cut = _mix(h) % _U(PIECE_WORDS) == 0
        lines = np.flatnonzero(data == 10)
        last = np.searchsorted(start, lines) - 1  # the word before each line's end
        last = np.unique(last[last >= 0])
        cut[last] = True
        line = np.append(0, last[:-1] + 1)  # first word of each paragraph
        place = np.arange(n) - np.repeat(line, np.diff(np.append(line, n)))
        whole = _mix(np.add.reduceat(_mix(h + _mix(place.astype(_U))), line) + _U(2))
        start_of = np.append(0, np.flatnonzero(cut)[:-1] + 1)
        place = (np.arange(n) - np.repeat(start_of, np.diff(np.append(start_of, n)))) % MOST_WORDS
        begin = np.flatnonzero(place == 0)
        key = _mix(np.add.reduceat(_mix(h + _mix(place.astype(_U) + _U(0x9E3779B97F4A7C15))), begin) + _U(1))
        key, begin = np.concatenate([key, whole]), np.concatenate([begin, line])
        owner = np.searchsorted(np.cumsum([len(c) + 1 for c in coded]), start[begin], "right")
        order = np.lexsort((key, owner))
        key, owner = key[order], owner[order]
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
        copy = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
        if copy.any():  # pieces that come again are items of their own
            key = np.where(copy > 0, _mix(key + copy.astype(_U) * _U(0xD1342543DE82EF95)), key)
            order = np.lexsort((key, owner))
            key, owner = key[order], owner[order]
    return key, owner


def items(text: str | None) -> np.ndarray:
    return items_of([text or ""])[0]


def _check(keys: np.ndarray) -> np.ndarray:
    return _mix(keys ^ _U(0x8EBC6AF09C88C6E3))


def _places(keys: np.ndarray, third: np.ndarray | int, base: np.ndarray | int) -> list[np.ndarray]:
    """For each part the cells of keys in sketches of 3 x third cells that begin at base."""
    third, base = np.asarray(third), np.asarray(base)
    return [base + p * third + ((_mix(keys + _U((0xA0761D6478BD642F * (p + 1)) & (2**64 - 1))) >> _U(20)) % third.astype(_U)).astype(np.int64) for p in range(PARTS)]


@dataclass
class Sketch:
    n: int
    count: np.ndarray
    key: np.ndarray
    check: np.ndarray

    def __sub__(self, other: Sketch) -> Sketch:
        return Sketch(self.n - other.n, self.count - other.count, self.key ^ other.key, self.check ^ other.check)


def _fill(keys: np.ndarray, cells: int, third, base, put=np.bitwise_xor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, keys and checksums of cells, the latter two by xor, or as sums modulo 2^64 where ``put`` is np.add, which numpy does several times as fast."""
    with np.errstate(over="ignore"):
        check = _check(keys)
        count, key, sums = np.zeros(cells, np.int64), np.zeros(cells, _U), np.zeros(cells, _U)
        for at in _places(keys, third, base):
            count += np.bincount(at, minlength=cells)
            put.at(key, at, keys)
            put.at(sums, at, check)
    return count, key, sums


def sketch(keys: np.ndarray, cells: int = BASE) -> Sketch:
    return Sketch(len(keys), *_fill(keys, cells, cells // PARTS, 0))


def _peel(count: np.ndarray, key: np.ndarray, check: np.ndarray, third: np.ndarray, owner: np.ndarray, take=np.bitwise_xor) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Peels the differences of many pairs at once, each in cells of its own. third: of each pair; owner: of each cell; take: np.subtract where cells hold sums.

    (keys, sides, owners) recovered and whether each pair's cells came out empty.
    """
    base = np.cumsum(PARTS * third) - PARTS * third
    part = np.repeat(np.tile(np.arange(PARTS), len(third)), np.repeat(third, PARTS))
    waiting = [[np.flatnonzero(part == p)] for p in range(PARTS)]  # cells to look at: all, then those that an item was taken from
    out: list[tuple] = [(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    with np.errstate(over="ignore"):
        idle = turn = 0
        while idle < PARTS and turn < 1000 * PARTS:  # a part after the other: an item has one cell in each, so none is found twice
            here = turn % PARTS
            first = turn < PARTS
            at = waiting[here][0] if first else np.concatenate([np.zeros(0, np.int64), *waiting[here]])
            at, waiting[here] = at[np.abs(count[at]) == 1], []
            side = _U(1) if take is np.bitwise_xor else count[at].astype(_U)
            at = at[_check(key[at] * side) == check[at] * side]
            turn, idle = turn + 1, 0 if len(at) else idle + 1
            if not len(at):
                continue
            if not first:
                at = np.sort(at)
                at = at[np.append(True, at[1:] != at[:-1])]
            sign, of = count[at], owner[at]
            side = _U(1) if take is np.bitwise_xor else sign.astype(_U)
            found = key[at] * side
            gone, sums = found * side, _check(found) * side
            for p, x in enumerate(_places(found, third[of], base[of])):
                np.subtract.at(count, x, sign)
                take.at(key, x, gone)
                take.at(check, x, sums)
                if p != here:
                    waiting[p].append(x)
            out.append((found, sign, of))
        left = np.unique(owner[(count != 0) | (key != 0) | (check != 0)])
    clean = np.ones(len(third), bool)
    clean[left] = False
    return *(np.concatenate([o[i] for o in out]) for i in range(3)), clean


def peel(diff: Sketch) -> tuple[np.ndarray, np.ndarray] | None:
    """Keys on the first side only and on the second only; None if the difference is too large for the sketch."""
    cells = len(diff.count)
    found, sign, _, clean = _peel(diff.count.copy(), diff.key.copy(), diff.check.copy(), np.array([cells // PARTS]), np.zeros(cells, np.int64))
    return (found[sign > 0], found[sign < 0]) if clean[0] else None


def _rows_of(texts: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where the items of these texts stand, text by text."""
    many = size[texts]
    return np.repeat(start[texts], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _expected(keys: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray, right: np.ndarray, share: int = 4) -> np.ndarray:
    """For each pair about how many items are on one side only, by one key in ``share``. It only sizes sketches; what they give is exact."""
    some = keys % _U(share) == 0
    keys, size = keys[some], np.bincount(owner[some], minlength=n)
    start = np.cumsum(size) - size
    pair = np.concatenate([np.repeat(np.arange(len(left)), size[side]) for side in (left, right)])
    key = keys[np.concatenate([_rows_of(side, start, size) for side in (left, right)])]
    order = np.lexsort((key, pair))
    key, pair = key[order], pair[order]
    again = np.flatnonzero((key[1:] == key[:-1]) & (pair[1:] == pair[:-1]))  # keys of a text are distinct: on both sides
    return share * (np.bincount(pair, minlength=len(left)) - 2 * np.bincount(pair[again], minlength=len(left)))


def differences(keys: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of texts (left, right: their numbers; keys and owner as of ``items_of``) the recovered keys, their sides (1, -1) and pairs.

    The first sketches have BASE cells and twice as many as a fourth of the keys, chosen by their bits, lets expect to differ; pairs whose peeling fails are
    sketched anew with GROWTH times as many. Sizes that the difference of the item counts alone must overfill are passed over.
    """
    size = np.bincount(owner, minlength=n)
    start = np.cumsum(size) - size
    cells = BASE + PARTS * (-(-2 * _expected(keys, owner, n, left, right) // PARTS))
    todo, out = np.arange(len(left)), []
    while len(todo):
        while (small := cells[todo] < np.abs(size[left[todo]] - size[right[todo]])).any():
            cells[todo[small]] *= GROWTH
        third = cells[todo] // PARTS
        base = np.cumsum(PARTS * third) - PARTS * third
        sides = []
        for side in (left[todo], right[todo]):
            many, pick = size[side], _rows_of(side, start, size)
            sides.append(_fill(keys[pick], int(PARTS * third.sum()), np.repeat(third, many), np.repeat(base, many), np.add))
        (c, k, s), (d, l, t) = sides  # noqa: E741
        found, sign, of, clean = _peel(c - d, k - l, s - t, third, np.repeat(np.arange(len(todo)), PARTS * third), np.subtract)
        good = clean[of]
        out.append((found[good], sign[good], todo[of[good]]))
        todo = todo[~clean]
        cells[todo] *= GROWTH
    empty = (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate([o[i] for o in [empty, *out]]) for i in range(3))


def difference(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ``a`` only and in ``b`` only."""
    found, sign, _ = differences(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, np.array([0]), np.array([1]))
    return found[sign > 0], found[sign < 0]


def likenesses(keys: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each pair's items."""
    _, sign, of = differences(keys, owner, n, left, right)
    size = np.bincount(owner, minlength=n)
    mine, other = (np.bincount(of[sign == x], minlength=len(left)) for x in (1, -1))
    both = size[left] - mine
    return np.where(both + mine + other > 0, both / np.maximum(both + mine + other, 1), 1.0)


def encode(s: Sketch) -> str:
    head = np.append(np.array([s.n], "<i4"), s.count.astype("<i4")).tobytes()
    return base64.b64encode(head + s.key.astype("<u8").tobytes() + (s.check >> _U(32)).astype("<u4").tobytes()).decode()


def decode(text: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(items, counts, keys, upper halves of the checksums) of a fingerprint string."""
    raw = base64.b64decode(text)
    cells = (len(raw) - 4) // 16
    return int(np.frombuffer(raw, "<i4", 1)[0]), np.frombuffer(raw, "<i4", cells, 4), np.frombuffer(raw, "<u8", cells, 4 + 4 * cells), np.frombuffer(raw, "<u4", cells, 4 + 12 * cells)


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) of the code points replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, block_rows: int = 512, most_blocks: int = 65_536, seen: int = 8) -> DataFrame:
    """(doc_id, text, _block, _k, _x, _own): rows dealt in blocks of neighbours by (id, hash of text), each block with the first row of the following one
    (_own false), so that a row's successor is in its block. The last block gets the very first row.

    The blocks, of about ``block_rows`` rows but ``most_blocks`` at most, end at quantiles of a sample of some ``seen`` ids a block, so that it doesn't
    matter how ids are spread. The sample decides on nothing else; the driver holds it and the blocks' first ids.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), id_key("doc_id", "text").alias("_k")).withColumn("_x", F.xxhash64("text"))
    n = docs.count()
    blocks = max(1, min(most_blocks, n // block_rows))
    share = min(1.0, seen * blocks / max(n, 1))
    some = rows.where(F.pmod(F.xxhash64("_k", "_x"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("_k", "_x").distinct().orderBy(F.xxhash64("_x", "_k")).limit(2 * seen * blocks).toArrow() if blocks > 1 else None
    ids = sorted(zip(some["_k"].to_pylist(), some["_x"].to_pylist(), strict=True)) if some else []
    ends = np.array(sorted({ids[len(ids) * i // blocks] for i in range(1, blocks)}), [("k", "i8"), ("x", "i8")]) if ids else np.zeros(0, [("k", "i8"), ("x", "i8")])
    shared = spark.sparkContext.broadcast(ends)

    @F.pandas_udf("int")
    def block(k, x):
        import pandas as pd

        asked = np.zeros(len(k), shared.value.dtype)
        asked["k"], asked["x"] = k.to_numpy(), x.to_numpy()
        return pd.Series(np.searchsorted(shared.value, asked, "right").astype(np.int32))

    rows = rows.withColumn("_block", block("_k", "_x"))
    found = sorted((r["_block"], *r["f"]) for r in rows.groupBy("_block").agg(F.min(F.struct("_k", "_x")).alias("f")).collect())
    to = [found[i - 1][0] for i in range(len(found))]
    firsts = spark.createDataFrame(pa.table({"_k": pa.array([f[1] for f in found], pa.int64()), "_x": pa.array([f[2] for f in found], pa.int64()), "_to": pa.array(to, pa.int32())}))
    moved = rows.drop("_block").join(F.broadcast(firsts), ["_k", "_x"]).dropDuplicates(["_k", "_x", "_to"]).select("doc_id", "text", "_k", "_x", F.col("_to").alias("_block"), F.lit(False).alias("_own"))
    return rows.withColumn("_own", F.lit(True)).unionByName(moved)


def repeated(docs: DataFrame, more_than: int = 512, share: int = 100_000) -> tuple[DataFrame, DataFrame | None]:
    """(rows, copies): ``docs`` (doc_id, text) with one row of those repeated more often than ``more_than`` times, and than one in ``share`` of all rows; and these, with how many more there are (``n``).

    There are fewer than ``share`` repeated rows, whose keys go to every task. Copies are None where no row is so frequent.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumns({"_k": id_key("doc_id", "text"), "_x": F.xxhash64("text")})
    counts = materialize(keyed.groupBy("_k", "_x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than), "repeated-rows")
    if counts.isEmpty():
        return rows, None
    often = F.broadcast(counts.where(F.col("n") * share > docs.count()))
    first = materialize(keyed.join(often, ["_k", "_x"]).dropDuplicates(["_k", "_x"]).select("doc_id", "text", (F.col("n") - 1).alias("n")), "first-copies")
    return keyed.join(often, ["_k", "_x"], "left_anti").select("doc_id", "text").unionByName(first.drop("n")), first


def compare_versions(docs: DataFrame, at_once: int = 1000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of ``docs`` (doc_id, text).

    The next of a repeated row is its copy, but for the last one: copies of frequent rows are compared once, and their results dealt out as often as there are copies.
    """
    rows, copies = repeated(docs)
    out = _compared(with_next(rows))
    if copies is None:
        return out
    numbered = materialize(copies.withColumn("_r", F.monotonically_increasing_id()), "numbered")
    twice = numbered.select(F.col("_r").alias("doc_id"), "text", F.col("_r").alias("_block"), F.explode(F.array(F.lit(True), F.lit(False))).alias("_own"), F.lit(0).alias("_k"), F.lit(0).alias("_x"))  # each row before itself
    found = _compared(twice).withColumnRenamed("doc_id", "_r").join(numbered.select("_r", "doc_id", "n"), "_r")
    dealt = found.withColumn("_part", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / at_once)))).repartition("_r", "_part")
    return out.unionByName(dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(at_once), F.col("n") - (F.col("_part") - 1) * at_once)))).select(*out.columns))


def _compared(dealt: DataFrame) -> DataFrame:
    """``compare_versions`` of blocks of rows that stand before their successors."""
    import pyarrow as pa

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text, following text or None if the row is there as one alone)."""
        asked = [i for i, r in enumerate(rows) if r[2] is not None]
        changed = [edited(rows[i][1], rows[i][2]) for i in asked]
        n = len(rows)
        keys, owner = items_of([r[1] for r in rows] + changed)
        size = np.bincount(owner, minlength=n + len(asked))
        third = np.full(len(size), BASE // PARTS)
        base = np.arange(len(size)) * BASE
        count, key, check = (x.reshape(-1, BASE) for x in _fill(keys, BASE * len(size), third[owner], base[owner]))
        text = lambda i: encode(Sketch(int(size[i]), count[i], key[i], check[i]))
        here, new = np.array(asked, int), n + np.arange(len(asked))
        alike = likenesses(keys, owner, len(size), np.concatenate([here, here]), np.concatenate([new, here + 1])) if asked else np.zeros(0)
        columns = [[rows[i][0] for i in asked], [len(rows[i][1]) for i in asked], [hashlib.sha256(c.encode()).hexdigest() for c in changed], [text(i) for i in asked], [text(i) for i in new], alike[: len(asked)], alike[len(asked) :]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []  # doc_id, text, following text; a row stays until its successor has come
        block, chars = None, 0
        for batch in batches:
            for doc_id, text, at, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = text.as_py()
                if held and at == block and held[-1][3]:
                    held[-1][2] = text
                if len(held) >= 128 or chars > 400_000:
                    held.append([doc_id, text, None, own])
                    yield compare(held)
                    held, chars = [], 0
                held.append([doc_id, text, None, own])
                block, chars = at, chars + len(text)
        if held:
            yield compare(held)

    dealt = dealt.repartition("_block").sortWithinPartitions("_block", F.desc("_own"), "_k", "_x")
    return text_batches(dealt).select("doc_id", "text", "_block", "_own").mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
