"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

Documents are tokenised and cut into pieces of at most ``size`` tokens. Only the number of pieces of each length goes to the
driver (at most ``size`` rows); best-fit decreasing runs over those counts, whole groups of equal bins at a time, and gives a
plan of at most a few entries for each length. Pieces are ranked within their length and take the planned slot of that rank.
With an ``order`` column (such as the schedule's position) that ranks pieces within their length, and sequences are numbered by
the least order among their pieces, so that reading sequences in turn follows it.

Defined cases: a null text is an empty one, which has the end token alone; a document longer than ``size`` is cut into full
pieces and a shorter last one; repeated rows are packed each; null ids rank first; ties of doc_id go by piece and checksum.
An empty table gives no sequences. Tokenising keeps one document's ids in memory at a time. Of other columns only the one named as
``order`` is read, so names can't clash; equal orders go by doc_id, piece and checksum.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import materialize, ranked, text_batches

#: Ids of so many white-space separated strings are kept by a Python worker.
CACHE = 500_000
_loaded: dict = {}


class _Ids(dict):
    """Token ids of a string without white space, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        self.encode, self.word = made.encode, made.model.tokenize
        self.four = [i.to_bytes(4, "little") for i in range(made.get_vocab_size())]
        # Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.alphabet = {b: chr(b if b in shown else next(other)) for b in range(256)}
        plain = all(self.by_word(w) == self.whole(w) for w in ("a", "zebra", "naïve", "straße", "niño"))
        self.marks = {m: self.whole(m) for m in ".,"} if plain and all(self.whole(f"zebra{m}") == self.whole("zebra") + self.whole(m) for m in ".,") else None

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def by_word(self, word: str) -> bytes:
        """A lower-case word of letters is one piece to the tokenizer, which goes to its merges straight."""
        if not word.isascii():
            word = "".join(map(self.alphabet.__getitem__, word.encode()))
        four = self.four
        return b"".join([four[t.id] for t in self.word(word)])

    def __missing__(self, chunk: str) -> bytes:
        if chunk.islower() and chunk.isalpha():
            ids = self.by_word(chunk) if self.marks and (chunk.isascii() or max(chunk) < "\u0250") else self.whole(chunk)
        else:
            word = chunk.lower()
            mark = self.marks.get(word[-1]) if self.marks else None
            if mark:
                word = word[:-1]
            # Letters below U+0250 are in NFC and alike in case mapping everywhere.
            ids = self[word] + (mark or b"") if self.marks and word != chunk and word.isalpha() and word.islower() and (word.isascii() or max(word) < "\u0250") else self.whole(chunk)
        if len(chunk) < 64:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = ids
        return ids


def token_bytes(text: str, path: str) -> bytes:
    """The ids of a text, four bytes each. The tokenizer drops white space and nothing it does reaches across it, so strings between spaces are looked up."""
    ids = _loaded.get(path) or _loaded.setdefault(path, _Ids(path))
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, not to the tokenizer
        return np.array(ids.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return b"".join(map(ids.__getitem__, text.split()))


def tokenized_pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, with_ids: bool = False, order: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids][, _order]) for each piece of each document."""
    import pyarrow as pa

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, *["_order"] * bool(order)]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for doc_id, text, at_order in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = token_bytes(text.as_py() or "", tokenizer) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), *[at_order] * bool(order)))
                    if with_ids:
                        parts.append(part)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.int64()] * bool(order)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            if with_ids:
                ends = np.cumsum([0] + [len(x) // 4 for x in parts], dtype=np.int32)
                columns.insert(5, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<u4").view(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", _order long" * bool(order)
    return text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (F.col(order) if order else F.lit(None)).cast("long")).mapInArrow(cut, schema)


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Entries (length, first_rank, bins, per_bin, first_sequence, offset): rank r of that length, i = r - first_rank, goes to sequence
    first_sequence + i // per_bin at offset + (i % per_bin) * length.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    left: dict[int, list[tuple[int, int]]] = {}  # room -> groups of equal bins (first sequence, how many)
    rooms: list[int] = []  # sorted keys of left
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in left:
                left[room] = []
                bisect.insort(rooms, room)
            left[room].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = left[room].pop()
                if not left[room]:
                    del left[room], rooms[at]
            else:
                room, first = size, sequences
                n = -(-todo // (size // length))
                sequences += n
            each = room // length
            full = min(n, todo // each)
            if full:
                plan.append((length, rank, full, each, first, size - room))
                put(room - full_length if (full_length := each * length) < room else 0, first, full)
            rank, todo, used = rank + full * each, todo - full * each, full
            if used < n and todo:  # fewer pieces than a bin takes
                plan.append((length, rank, 1, todo, first + used, size - room))
                put(room - todo * length, first + used, 1)
                rank, todo, used = rank + todo, 0, used + 1
            put(room if room < size else 0, first + used, n - used)
    return plan


def pack(pieces: DataFrame, size: int = 4096, order: list[str] | None = None) -> DataFrame:
    """``pieces`` (length in 1..size) with ``sequence_id`` and ``offset``; sequences have no gaps. ``pieces`` is read more than once.

    Pieces of a length take their slots by ``order``.
    """
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    plan = np.array(sorted(best_fit_plan(counts, size)) or [(0,) * 6], np.int64)
    shared = spark.sparkContext.broadcast((plan, plan[:, 0] << 48 | plan[:, 1]))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length, rank):
        import pandas as pd

        plan, starts = shared.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        of = plan[np.searchsorted(starts, n << 48 | r, "right") - 1]
        i = r - of[:, 1]
        return pd.DataFrame({"sequence_id": of[:, 4] + i // of[:, 3], "offset": of[:, 5] + i % of[:, 3] * n})

    at = ranked(pieces, ["length"], order or ["doc_id", "piece", "ids_crc32"], "_rank")
    return at.withColumn("_s", slot("length", "_rank")).select(*pieces.columns, "_s.sequence_id", "_s.offset")


def in_order(packed: DataFrame, order: str) -> DataFrame:
    """``packed`` with sequences numbered anew, by the least ``order`` among their pieces. ``packed`` is read twice."""
    least = packed.groupBy("sequence_id").agg(F.min(order).alias("_first"))
    numbers = ranked(materialize(least, "sequences"), [], ["_first", "sequence_id"], "_number").select("sequence_id", "_number")
    return packed.join(numbers, "sequence_id").withColumn("sequence_id", F.col("_number")).select(*packed.columns)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, with_ids: bool = False, order: str | None = None) -> DataFrame:
    """Pieces of all documents with their places; ``with_ids`` adds the token ids, ``order`` names the column that sequences follow.

    Ids stay out of the placing: they are written once with a piece number and meet their place in one join.
    """
    made = tokenized_pieces(docs, tokenizer, size, end_id, with_ids, order)
    pieces = materialize(made.withColumn("_p", F.monotonically_increasing_id()) if with_ids else made, "pieces")
    light = pieces.drop("ids")
    placed = pack(light, size, ["_order", "doc_id", "piece", "ids_crc32"] if order else None)
    if order:
        placed = in_order(materialize(placed, "packed"), "_order").drop("_order")
    if with_ids:
        placed = pieces.drop("_order").join(placed.select("_p", "sequence_id", "offset"), "_p").drop("_p")
    return placed
