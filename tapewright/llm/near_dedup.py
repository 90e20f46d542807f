"""Near-duplicate classes by BagMinHash over the multiset of a text's five-word shingles.

A shingle that occurs w times has weight w. Weights are discretised at the integers, and these lie in blocks [0,1), [1,2),
[2,4), [4,8), ...: each block of a shingle has a Poisson process of its own, of a rate in proportion to its width, and each
point of it a random slot and a random height in the block. A block wholly below w takes part with all points; the one that w
cuts keeps the points below w, which is what halving it again and again comes to. The earliest point of a slot is that slot's
signature: two texts share it with a probability equal to their weighted Jaccard similarity. Points later than a slot can need
are never made: a horizon is set from the number of shingles, and a text with an empty slot goes on with a longer one.

Texts with equal multisets are one class representative. Bands of the signature deal representatives into buckets. All pairs of a
small bucket are candidates; in a large one each member is compared with the least, which links the copies of one text in linear
time. Members that this leaves outside a bucket's main component are compared with all of the bucket, in blocks of bounded size
that give links between components alone, never pairs; texts go there only where signatures agree. Candidates are verified by exact multiset overlap of their texts, so each
pair that shares a bucket is compared, or is in one class already. Classes are connected components of the verified pairs.

Defined cases: words are lower-cased and split at white space; a text under five words is one shingle of all its words; null and
empty texts are equal, hence one class; rows without an id stand before others, each text for itself, and a class that begins with
one has no id; repeated rows are copies, of which one stays. Rows are told apart by id and text, so several texts of one id are documents each,
ordered by a hash of the text. A class id is its least doc_id. Texts are read whole, of any length, one batch in memory at a time. An empty table
gives no rows. Columns with a leading ``_`` are dropped; others pass through ``drop_near_duplicates``. Distinct multisets are numbered in the order of
their least (id, text), and all linking is between these numbers; what holds many rows goes by counts of them (``join_hot``).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.common import join_hot, materialize, text_batches, without

WORDS = 5
SLOTS, BANDS, ROWS = 128, 25, 5
KEYS = ["_g", "_k", "_x"]
#: A pivot's pairs that go to one task with one copy of its text.
OFTEN = 20_000
#: Signatures that agree in so much less than the threshold are not verified: over four standard deviations of the estimate.
SLACK = 0.17
_U = np.uint64


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hash = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of all shingles of a text, repeats included."""
    tokens = (text or "").lower().split()
    x = np.fromiter(map(_hash.__getitem__, tokens), _U, len(tokens))
    n = max(min(1, len(x)), len(x) - words + 1)
    if not n:
        return x
    with np.errstate(over="ignore"):
        out = np.full(n, len(x) if len(x) < words else words, _U)
        for i in range(min(words, len(x))):
            out = out * _U(0x9E3779B97F4A7C15) + x[i : i + n]
        out = _mix(out)
    out.sort()
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    u, m = np.unique(a, return_counts=True)
    v, n = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    common = np.minimum(m[i], n[j]).sum()
    return float(common / (len(a) + len(b) - common))


def bag_minhash(bags: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` 32-bit values for each sorted multiset; zeros for an empty one."""
    sizes = np.array([len(b) for b in bags])
    out = np.zeros((len(bags), slots), np.uint32)
    if not sizes.sum():
        return out
    doc, h = np.repeat(np.arange(len(bags)), sizes), np.concatenate(bags)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    weight = np.diff(np.append(start, len(h)))
    doc, h = doc[start], h[start]
    with np.errstate(over="ignore"):
        # Blocks: [0,1), then [2**k, 2**(k+1)) for each k with 2**k < weight; ``cover``: what of the block lies below the weight.
        docs, seeds, widths, covers = [doc], [_mix(h)], [np.ones(len(h))], [np.ones(len(h))]
        at, k = np.flatnonzero(weight > 1), 0
        while len(at):
            docs.append(doc[at])
            seeds.append(_mix(h[at] + _U((k + 1) * 0xD1342543DE82EF95 & (2**64 - 1))))
            widths.append(np.full(len(at), float(2**k)))
            covers.append(np.minimum(weight[at] - 2**k, 2**k).astype(float))
            k += 1
            at = at[weight[at] > 2**k]
        doc, seed, width, cover = (np.concatenate(x) for x in (docs, seeds, widths, covers))
        horizon = np.where(sizes > 0, (np.log(slots) + 3) / np.maximum(sizes, 1), 0.0)
        todo = sizes > 0
        while True:
            best, value = np.full(len(bags) * slots, np.inf), out.reshape(-1)
            d, s, w, c, t, i = doc, seed, width, cover, np.zeros(len(doc)), 0
            while len(d):
                i += 1
                r = _mix(s + _U(i * 0x9E3779B97F4A7C15 & (2**64 - 1)))
                t = t - np.log(((r >> _U(11)).astype(float) + 1) * 2.0**-53) / (slots * w)
                on = t <= horizon[d]
                d, s, w, c, t, r = d[on], s[on], w[on], c[on], t[on], r[on]
                r = _mix(r ^ _U(0xA0761D6478BD642F))
                keep = (r >> _U(40)).astype(float) * 2.0**-24 * w < c
                place = d[keep] * slots + ((r[keep] & _U(0xFFFF)) * _U(slots) >> _U(16)).astype(np.int64)
                tk, v = t[keep], (_mix(r[keep]) >> _U(32)).astype(np.uint32)
                np.minimum.at(best, place, tk)
                won = best[place] == tk
                value[place[won]] = v[won]
            short = np.unique(np.flatnonzero(np.isinf(best)) // slots)
            short = short[todo[short]]
            todo = np.isin(np.arange(len(bags)), short)
            if not len(short):
                return out
            again = todo[doc]
            doc, seed, width, cover = doc[again], seed[again], width[again], cover[again]
            horizon[short] *= 2


def _keys() -> list[Column]:
    """What tells rows apart, in their order: whether there is an id, the id, or a hash of the text where there is none, and a hash of the text."""
    return [F.col("doc_id").isNotNull().cast("int").alias("_g"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("_k"), F.xxhash64("text").alias("_x")]


def signatures(docs: DataFrame) -> DataFrame:
    """(_g, _k, _x, h1, h2, n_shingles, sig, bands) for each row: whether it has an id, id, hash of the text, hashes of the whole multiset, signature, and a hash for each band."""
    import pyarrow as pa

    names = ["_g", "_k", "_x", "h1", "h2", "n_shingles", "sig", "bands"]

    def part(ids: list[tuple], bags: list[np.ndarray]) -> pa.RecordBatch:
        sig = bag_minhash(bags)
        with np.errstate(over="ignore"):
            band = np.zeros((len(bags), BANDS), _U)
            for r in range(ROWS):
                band = _mix(band * _U(0x9E3779B97F4A7C15) + sig[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)[:, :, r].astype(_U) + _U(1))
            band = _mix(band + np.arange(1, BANDS + 1, dtype=_U) * _U(0xD1342543DE82EF95)).view(np.int64)
            whole = [((_mix(b).sum(dtype=_U) ^ _U(len(b))), _mix(b ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)) for b in bags]
        h1, h2 = (np.array([x[j] for x in whole], _U).view(np.int64) for j in (0, 1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bags) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(band.reshape(-1)))
        keys = [pa.array(column, kind) for column, kind in zip(zip(*ids, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays([*keys, pa.array(h1), pa.array(h2), pa.array([len(b) for b in bags], pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary()), lists], names)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bags, held = [], [], 0
            for *key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                ids.append(key)
                bags.append(shingles(text.as_py()))
                held += len(bags[-1])
                if held > 300_000 or len(ids) >= 2000:
                    yield part(ids, bags)
                    ids, bags, held = [], [], 0
            if ids:
                yield part(ids, bags)

    return text_batches(docs).select(*_keys(), F.col("text").cast("string")).mapInArrow(sign, "_g int, _k long, _x long, h1 long, h2 long, n_shingles long, sig binary, bands array<long>")


@F.pandas_udf(T.DoubleType())
def _agreement(a, b):
    """Share of equal slots."""
    import pandas as pd

    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs (p, q, a, b) whose texts (node, text) have a weighted Jaccard similarity of ``threshold`` or more."""
    import pyarrow as pa

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict = OrderedDict()  # pivots come again and again
        for batch in batches:
            p, keep = batch.column(0).to_pylist(), []
            for i, (x, y) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                if p[i] not in known:
                    known[p[i]] = shingles(x.as_py())
                    if len(known) > 64:
                        known.popitem(last=False)
                if overlap(known[p[i]], shingles(y.as_py())) >= threshold:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(j).take(pa.array(keep, pa.int64())) for j in (1, 2)], ["a", "b"])

    # A pivot of many pairs goes to several tasks, with so many copies of its text.
    often = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OFTEN).select("p", F.ceil(F.col("n") / OFTEN).cast("int").alias("parts"))
    often = F.broadcast(often.limit(0) if pairs.count() <= OFTEN else often)  # at most one of them for each ``OFTEN`` pairs
    first = texts.select(F.col("node").alias("p"), F.col("text").alias("tp")).join(often, "p", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    dealt = pairs.join(often, "p", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    both = dealt.join(texts.select(F.col("node").alias("q"), F.col("text").alias("tq")), "q").join(first, ["p", "part"])
    return text_batches(both).select("p", "a", "b", "tp", "tq").mapInArrow(judge, "a long, b long")


def components(links: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(node, comp) for all nodes of ``links`` (a, b) but the least of each component, which is comp. Large-star and small-star steps in turn until only stars are left.

    Least neighbours of up to ``broadcast_rows`` edges go to every task; of more, those of nodes with many edges do.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        edges = materialize(edges, "edges")
        if edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        few = edges.count() <= broadcast_rows
        meet = lambda rows, table: rows.join(F.broadcast(table.drop("n")), "u") if few else join_hot(rows, materialize(table, "least"), ["u"], "n")  # noqa: B023, E731
        least = lambda rows: rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = meet(both.where("v > u"), least(both).withColumn("m", F.least("u", "m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = meet(large, least(large))
        edges = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def rest_of_buckets(members: DataFrame, store: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b): links between components of buckets (bucket, node, comp) that hold several.

    Members outside a bucket's main component are compared with all its members, blocks of ``block`` rows against each other: first by the low bytes of their signatures alone, which is all
    that is sent to every block. Rows that agree with one of another component there are sent again, with their texts, to the blocks where they do, and verified. A task
    gives no pairs but those that join components within its blocks. Pairs that share an earlier band are that band's.
    """
    import pandas as pd

    least = (threshold - SLACK) * SLOTS
    sizes = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.sum("n").alias("n"), F.max("n").alias("top"))
    sizes = sizes.where("top < n").select("bucket", "main", "n", F.ceil(F.col("n") / block).cast("int").alias("nm"), F.ceil((F.col("n") - F.col("top")) / block).cast("int").alias("no"))
    rows = join_hot(members, materialize(sizes.withColumn("size", F.col("n")), "sizes"), ["bucket"], "size")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key, kept = ["bucket", "ob", "mb"], ["bucket", "ob", "mb", "node", "comp"]
    rows = materialize(rows.join(store.select("node", _low("sig").alias("low")), "node"), "low-bytes")
    outer = rows.where("comp <> main").select("bucket", "node", "comp", "low", place("no").alias("ob"), every("nm").alias("mb")).select(*kept, "low")
    inner = rows.select("bucket", "node", "comp", "low", place("nm").alias("mb"), every("no").alias("ob")).select(*kept, "low")

    def screen(o: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        here, there = [], np.zeros(len(m), bool)
        if len(o) and len(m):
            low, comp = [np.frombuffer(b"".join(x["low"]), np.uint8).reshape(len(x), -1) for x in (o, m)], [x["comp"].to_numpy() for x in (o, m)]
            for i in range(len(o)):
                at = ((low[1] == low[0][i]).sum(axis=1, dtype=np.uint8) >= least) & (comp[1] != comp[0][i])  # equal slots have equal low bytes
                if at.any():
                    there |= at
                    here.append(i)
        return pd.concat([o[kept].iloc[here].assign(outer=True), m[kept].iloc[np.flatnonzero(there)].assign(outer=False)])

    def join(o: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(o) and len(m):
            sig, bands = ([np.frombuffer(b"".join(x["sig"]), np.uint32).reshape(len(x), -1) for x in (o, m)], [np.stack(x["bands"].to_numpy()) for x in (o, m)])
            band, comp = int(np.flatnonzero(bands[0][0] == o["bucket"].iloc[0])[0]), [x["comp"].to_numpy() for x in (o, m)]
            found = []
            for i in range(len(o)):
                agree = (sig[1] == sig[0][i]).mean(axis=1)
                fits = (agree >= threshold - SLACK) & (comp[1] != comp[0][i]) & ~(bands[1][:, :band] == bands[0][i, :band]).any(axis=1)
                found += [(-agree[j], i, j) for j in np.flatnonzero(fits)]
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            known: dict[tuple[int, int], np.ndarray] = {}
            for _, i, j in sorted(found):
                a, b = find(int(comp[0][i])), find(int(comp[1][j]))
                if a == b:
                    continue
                for side, x, n in ((0, o, i), (1, m, j)):
                    if (side, n) not in known:
                        known[side, n] = shingles(x["text"].iloc[n])
                if overlap(known[0, i], known[1, j]) >= threshold:
                    root[max(a, b)] = min(a, b)
                    out.append((min(a, b), max(a, b)))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    outer, inner = (x.toDF(*kept, "low") for x in (outer, inner))
    near = outer.groupBy(*key).cogroup(inner.groupBy(*key)).applyInPandas(screen, "bucket long, ob int, mb int, node long, comp long, outer boolean")
    near = materialize(near, "screened")
    full = near.join(store, "node")
    o, m = (full.where(x).toDF(*full.columns) for x in ("outer", "not outer"))
    return o.groupBy(*key).cogroup(m.groupBy(*key)).applyInPandas(join, "a long, b long")


@F.pandas_udf(T.BinaryType())
def _low(sig):
    """The low byte of each slot."""
    import pandas as pd

    return pd.Series([np.frombuffer(x, np.uint32).astype(np.uint8).tobytes() for x in sig])


def _classes(docs: DataFrame, threshold: float, small: int, block: int) -> DataFrame:
    """(_g, _k, _x, class_g, class_k, class_x, n_shingles) for each row of ``docs``: ``_keys`` of the row and of the first of its class.

    Members of a bucket of up to ``small`` are compared with each other, those of a larger one with its least member, which links the copies
    of one text. What is left outside a larger bucket's main component is then compared with the whole bucket, by blocks of ``block`` rows.
    """
    sigs = materialize(signatures(docs), "signatures")
    firsts = sigs.groupBy("h1", "h2").agg(F.min(F.struct(*KEYS)).alias("f"), F.count(F.lit(1)).alias("n")).select("h1", "h2", "n", "f.*")
    # Numbers in the order of (id, text): places in sorted ranges.
    firsts = materialize(firsts.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).withColumn("node", F.monotonically_increasing_id()), "firsts")
    reps = sigs.join(firsts, ["h1", "h2", *KEYS]).where("n_shingles > 0").dropDuplicates(["node"])
    reps = materialize(reps.select("node", *KEYS, "sig", "bands"), "representatives")
    banded = reps.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1")
    shared = materialize(shared.withColumn("size", F.col("n")), "shared")
    members = materialize(join_hot(banded, shared, ["bucket"], "size").select("bucket", "node", "n", "first"), "buckets")
    # Signature and text of each representative that shares a bucket: the only texts that are read from here on.
    wanted = materialize(reps.join(members.select("node").distinct(), "node"), "wanted")
    texts = docs.select(*_keys(), "text").join(wanted, KEYS).dropDuplicates(["node"])
    store = materialize(texts.select("node", "text", "sig", "bands"), "bucket-texts")
    sig, texts = (lambda k, s: wanted.select(F.col("node").alias(k), F.col("sig").alias(s))), store.select("node", "text")
    few = members.where(F.col("n") <= small).select("bucket", "node")
    pairs = few.withColumnRenamed("node", "p").join(few.withColumnRenamed("node", "q"), "bucket").where("p < q").select("p", "q")
    pairs = pairs.unionByName(members.where((F.col("n") > small) & (F.col("node") > F.col("first"))).select(F.col("first").alias("p"), F.col("node").alias("q"))).distinct()
    pairs = pairs.join(sig("p", "sp"), "p").join(sig("q", "sq"), "q").where(_agreement("sp", "sq") >= threshold - SLACK).select("p", "q", F.col("p").alias("a"), F.col("q").alias("b"))
    near = components(materialize(verified(materialize(pairs, "candidates"), texts, threshold), "links"))
    large = members.where(F.col("n") > small).select("bucket", "node")
    if not large.isEmpty():
        large = materialize(large.join(near, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp")), "large-buckets")
        rest = materialize(rest_of_buckets(large, store, threshold, block), "links")
        if not rest.isEmpty():
            near = components(near.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(rest))
    # From nodes to the first rows of their classes, then to rows.
    of = materialize(firsts.join(near, "node", "left").withColumn("class", F.coalesce("comp", "node")).select("h1", "h2", "n", "node", *KEYS, "class"), "nodes")
    heads = of.groupBy("class").agg(F.count(F.lit(1)).alias("m")).join(of.where("node = class").select("class", *[F.col(c).alias(f"class{c}") for c in KEYS]), "class")
    of = join_hot(of.select("h1", "h2", "n", "class"), materialize(heads, "heads"), ["class"], "m")
    return join_hot(sigs.select(*KEYS, "h1", "h2", "n_shingles"), materialize(of.drop("class"), "classes"), ["h1", "h2"], "n")


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, small: int = 32, block: int = 256) -> DataFrame:
    """A row for each row of ``docs``: doc_id, class_id (least doc_id of its class), n_shingles, is_first (it stays if one of each class does)."""
    given = lambda c: F.when(F.col(f"{c}_g") == 1, F.col(f"{c}_k"))
    return _classes(docs, threshold, small, block).select(given("").alias("doc_id"), given("class").alias("class_id"), "n_shingles", _is_first().alias("is_first"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, small: int = 32, block: int = 256) -> DataFrame:
    """``docs`` without the rows that have a class mate of a lower doc_id; of repeated rows (equal id and text) one stays."""
    docs = without(docs)
    keep = _classes(docs, threshold, small, block).where(_is_first()).select(*KEYS)
    return docs.select("*", *_keys()).join(keep, KEYS, "left_semi").dropDuplicates(KEYS).drop(*KEYS)


def _is_first() -> Column:
    return (F.col("_g") == F.col("class_g")) & (F.col("_k") == F.col("class_k")) & (F.col("_x") == F.col("class_x"))
