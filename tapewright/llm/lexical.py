"""Ranked lexical search, score at a time over postings that are grouped by exact impact.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A document's score for a query sums, over the query's distinct terms,
impacts w * ((1000000000 tf) div (1000 tf + 20 m)): w is floor(1000 ln((2 N + 2) / (2 df + 1))), m is 50 + (50 n N) div L, of whole numbers throughout (``search``).

The index is a table of segments. A task deals its documents, whole, to segments of at most ``documents`` documents and some ``tokens`` terms, and writes a row for each term of
a segment: the places of its documents and how often each holds it; a row without a term holds the documents' ids and lengths. Nothing is shuffled for that, and every term of every text is indexed.

A search reads the rows of the queries' terms alone, as does the count of documents that hold a term. Rows of a segment meet in one task; there each term's postings are ordered by
impact, equal impacts forming a group, and a query takes the groups of all its terms from the highest impact down, adding to its documents' sums. Between steps the bound of a document is its sum and
the highest impact left in each term it hasn't met yet. The query stops only when the bounds prove that the k best are among few documents, those whose bound reaches the k-th sum (or
what is known to be reached elsewhere); their scores are then completed from the postings not yet processed, and the k best leave the segment. The first segments (one of ``lead``) are searched before the
others, and their k-th scores are what the others must reach. So no segment, and no task, holds more than its segment's postings, whatever a term's frequency.

Defined cases: null and empty texts, and texts without a term, have no postings and count in neither N nor L; null query texts have no results; every document row and every query row stands for itself, also
with equal or null ids; equal scores go by document id, null ids first; documents with score 0 are no result; no query, or no document, gives no rows. Of other columns none is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.llm.common import materialize, text_batches

#: ASCII bytes that are no letters or digits part terms; bytes from 128 belong to them.
_FOLD = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_POSTINGS = "segment long, term binary, places array<int>, counts array<int>, ids array<long>"


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_FOLD).split()


class _Builder:
    """One segment on its way: a document's terms and counts are kept as numbers of the segment's own vocabulary."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.lengths, self.held, self.counts, self.tokens = [], [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        number = self.vocabulary.setdefault
        numbers = np.array([number(t, len(self.vocabulary)) for t in terms(text)], np.int64)
        if len(numbers):
            held, counts = np.unique(numbers, return_counts=True)
            self.ids.append(doc_id)
            self.lengths.append(len(numbers))
            self.held.append(held.astype(np.int32))
            self.counts.append(counts.astype(np.int32))
            self.tokens += len(numbers)

    def rows(self, segment: int, at_once: int = 100_000):
        """Record batches: a row for each term, and one for the documents."""
        import pyarrow as pa

        names = ["segment", "term", "places", "counts", "ids"]
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([None], pa.binary()), pa.array([None], ints), pa.array([self.lengths], ints), pa.array([self.ids], longs)], names)
        held = np.concatenate(self.held)
        order = np.argsort(held, kind="stable")  # places ascend within a term
        places = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(h) for h in self.held])[order]
        counts = np.concatenate(self.counts)[order]
        starts = np.append(np.searchsorted(held[order], np.arange(len(self.vocabulary))), len(held))
        words = list(self.vocabulary)
        for a in range(0, len(words), at_once):
            b = min(a + at_once, len(words))
            ends = pa.array((starts[a : b + 1] - starts[a]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[starts[a] : starts[b]])) for x in (places, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, segment)), pa.array(words[a:b], pa.binary()), *lists, pa.nulls(b - a, longs)], names)


def index(docs: DataFrame, documents: int = 8192, tokens: int = 4_000_000) -> DataFrame:
    """(segment, term, places, counts, ids) of all documents (doc_id, text), written. A row with null term holds a segment's document ids, and their lengths as ``counts``."""

    def build(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        segment, made = TaskContext.get().partitionId() << 32, _Builder()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made.add(doc_id, text.as_py() or b"")
                if len(made.ids) >= documents or made.tokens >= tokens:
                    yield from made.rows(segment)
                    segment, made = segment + 1, _Builder()
        if made.ids:
            yield from made.rows(segment)

    rows = text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return materialize(rows.mapInArrow(build, _POSTINGS), "postings")


def _query_terms(queries: DataFrame) -> DataFrame:
    """(query, item_id, term) of the distinct terms of each row of ``queries`` (item_id, text), written."""
    import pyarrow as pa

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(dict.fromkeys(terms(text.as_py() or b""))) for text in batch.column(2)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([t for x in found for t in x], pa.binary())], ["query", "item_id", "term"])

    rows = text_batches(queries).select(F.monotonically_increasing_id().alias("query"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return materialize(rows.mapInArrow(split, "query long, item_id long, term binary"), "query-terms")


class Postings:
    """Postings of one term in one segment: places, and impacts without the term's weight, by descending impact; and both by place."""

    def __init__(self, places: np.ndarray, impacts: np.ndarray):
        self.places, self.impacts = places, impacts
        order = np.argsort(-impacts, kind="stable")
        self.down, self.by_impact = impacts[order], places[order]

    def of(self, places: np.ndarray) -> np.ndarray:
        """Impacts at these places, 0 where the term isn't held."""
        at = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
        return np.where(self.places[at] == places, self.impacts[at], 0)


def top(lists: list[tuple[int, Postings]], size: int, k: int, reach: int = 1, steps: int = 8) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(places, scores, processed, postings): all of the segment's ``size`` documents that can be among its k best with ``reach`` at least; lists: (weight, postings) of a query's terms.

    Of equal scores at the k-th place all are given. Groups of equal impact are processed whole, from the highest down, and the bounds are worked out after each ``1 / steps`` of the postings.
    Processing stops when they prove that the k best are among so few documents that their scores take less to complete than the postings that are left.
    """
    weights = np.array([w for w, _ in lists], np.int64)
    sizes = np.array([len(p.down) for _, p in lists])
    starts = np.cumsum(sizes) - sizes
    impacts = np.concatenate([w * p.down for w, p in lists])
    order = np.argsort(-impacts, kind="stable")  # merges runs that are in order
    total, falling = len(order), impacts[order]
    places = np.concatenate([p.by_impact for _, p in lists])[order]
    of = np.repeat(np.arange(len(lists)), sizes)[order]
    sums, met, taken, done = np.zeros(size, np.int64), np.zeros((len(lists), size), bool), np.zeros(len(lists), np.int64), 0
    while done < total:
        least_here = falling[min(done + -(-total // steps), total) - 1]
        end = total - int(np.searchsorted(falling[::-1], least_here, "left"))  # the group is whole
        np.add.at(sums, places[done:end], falling[done:end])
        met[of[done:end], places[done:end]] = True
        taken += np.bincount(of[done:end], minlength=len(lists))
        done = end
        least = max(reach, int(np.partition(sums, size - k)[size - k]) if size > k else 0)
        heads = np.where(taken < sizes, impacts[np.minimum(starts + taken, total - 1)], 0)
        bounds = sums + heads.sum() - heads @ met
        live = np.flatnonzero(bounds >= least)
        if len(live) <= k or len(live) * len(lists) < total - done or done == total:
            break
    scores = sum(w * p.of(live) for w, p in zip(weights.tolist(), (p for _, p in lists), strict=True)) if done < total and len(live) else sums[live]
    keep = scores >= reach
    return live[keep], scores[keep], done, total


def search(postings: DataFrame, queries: DataFrame, k: int = 50, query_bytes: int = 16_000_000, lead: int = 16) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k documents of an index that score highest for each row of ``queries`` (item_id, text).

    Queries go to the tasks in turns of some ``query_bytes``.
    """
    spark = postings.sparkSession
    asked = _query_terms(queries)
    stats = postings.where(F.col("term").isNull()).select(F.explode("counts").alias("n")).agg(F.count("n").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = stats.docs, stats.terms or 1
    wanted = asked.select("term").distinct()
    df = postings.select("term", F.size("places").cast("long").alias("df")).join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000) * F.log((F.lit(2) * n_docs + 2).cast("double") / (F.lit(2) * F.col("df") + 1).cast("double")))
    weighed = materialize(asked.join(df, "term").select("query", "item_id", "term", weight.cast("long").alias("w")).where("w > 0"), "weights")
    size = weighed.agg(F.sum(F.length("term") + 64).alias("b")).first().b or 0
    turns = max(1, -(-size // query_bytes))
    parts = []
    for turn in range(turns):
        mine = weighed.where(F.pmod(F.xxhash64("query"), F.lit(turns)) == turn)
        asks: dict[int, list] = {}
        for batch in mine.select("query", "term", "w").toArrow().to_batches():
            for query, term, w in zip(*batch.to_pydict().values(), strict=True):
                asks.setdefault(query, []).append((term, w))
        few = F.broadcast(mine.select("term").distinct())  # of a turn's size
        held = postings.join(few, "term", "left_semi").unionByName(postings.where(F.col("term").isNull()))
        first = F.pmod(F.xxhash64("segment"), F.lit(lead)) == 0
        shared = spark.sparkContext.broadcast((asks, {}))
        found = materialize(_best(_searched(held.where(first), shared, n_docs, n_terms, k), k), "first")
        reach = {r.query: r.score for r in found.where(F.col("rank") == k).select("query", "score").collect()}  # one for each of the turn's queries
        wiser = spark.sparkContext.broadcast((asks, reach))
        parts.append(materialize(found.drop("rank").unionByName(_searched(held.where(~first), wiser, n_docs, n_terms, k)), "found"))
        shared.destroy()
        wiser.destroy()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    names = weighed.select("query", "item_id").distinct()
    return _best(out, k).join(names, "query").select("item_id", "rank", "doc_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _searched(held: DataFrame, shared, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score) of what each segment's search gives; shared: a broadcast of each query's (term, weight) and the scores to reach."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def walk(table: pa.Table) -> pa.Table:
        asked, reach = shared.value
        table = table.combine_chunks()
        documents = table.filter(pc.is_null(table.column("term")))
        named = documents.column("ids")[0].values
        none, ids = named.is_null().to_numpy(zero_copy_only=False), named.fill_null(0).to_numpy()
        m = 50 + 50 * documents.column("counts")[0].values.to_numpy().astype(np.int64) * n_docs // n_terms
        lists = {}
        for term, places, counts in zip(table.column("term").to_pylist(), table.column("places"), table.column("counts"), strict=True):
            if term is not None:
                at, tf = places.values.to_numpy(), counts.values.to_numpy().astype(np.int64)
                lists[term] = Postings(at, 1_000_000_000 * tf // (1000 * tf + 20 * m[at]))
        out = []
        for query, held in asked.items():
            mine = [(w, lists[t]) for t, w in held if t in lists]
            if mine:
                places, scores, *_ = top(mine, len(ids), k, max(1, reach.get(query, 1)))
                order = np.lexsort((ids[places], ~none[places], -scores))[:k]
                out.append((np.full(len(order), query), places[order], scores[order]))
        query, places, scores = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"query": query, "doc_id": pa.array(ids[places], mask=none[places]), "score": scores})

    return held.groupBy("segment").applyInArrow(walk, "query long, doc_id long, score long")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    return search(index(docs), queries, k)
