"""A class-based bigram language model (Brown classes by the exchange algorithm).

Words, lower-cased A-Z and split at ASCII white space, are counted over all training documents. The exchange algorithm clusters
a core on the driver: the ``own`` most frequent words, and ``buckets`` groups of all others by the last three bytes. Then every
other training word, however rare, leaves its group for the class that its own neighbours' classes make likeliest, by counts over
all training documents in the tasks; the groups' classes are left to unseen words. Bigrams of the final classes are counted over
all training documents, and the model is

    P(w | v) = P(class w | class v) P(w | class w)

with transitions smoothed towards class shares and emissions (c + 0.5) / (class tokens + 0.5 (class words + 1)), where all unseen
words of a class share one place. The end of a text is a word with a class of its own, which also precedes the first word. Next tokens' probabilities sum to 1, so no score is above 0.

Counts and classes of the most frequent words, ``frequent`` at most (a bound that doesn't depend on the corpus), go to every task; all other
words of a text meet theirs in a join, so every word is scored by its exact count and its own class.

Defined cases: a null or empty text is the end alone; repeated rows count and score each; a null id belongs to training (its
crc32 is null, hence not 1); without training documents all counts are 0 and each token has probability 1 in the base and by its
classes alone in the model. An empty table gives no rows. Words of equal counts are frequent all or none, and rank by their bytes; words whose classes tie take the lowest.
Texts are read whole, of any length, one at a time. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import materialize, text_batches

END = 0  # its unit and its class


def tokens(text: bytes | None) -> list[bytes]:
    """Words; bytes lower-case and split by ASCII alone."""
    return (text or b"").lower().split()


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


class _Units(dict):
    """A word's unit: 1 .. own for the frequent ones, then a bucket."""

    def __init__(self, words: list[bytes], buckets: int):
        super().__init__({w: i + 1 for i, w in enumerate(words)})
        self.own, self.buckets, self.most = len(words), buckets, len(words) + 300_000

    def of(self, word: bytes) -> int:
        return self.own + 1 + zlib.crc32(word[-3:]) % self.buckets

    def __missing__(self, word: bytes) -> int:
        found = self.of(word)
        if len(self) < self.most:
            self[word] = found
        return found

    def __reduce__(self):
        return _Units, ([w for w, i in self.items() if i <= self.own], self.buckets)


@dataclass
class ClassModel:
    train_tokens: int
    train_words: int  # distinct, the end included
    frequent: dict[bytes, int]  # word to its place in the arrays
    counts: np.ndarray
    units: _Units
    unit_class: np.ndarray
    transition: np.ndarray  # log10 P(class | class before)
    room: np.ndarray  # log10 of the emission's denominator, by class


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) over all texts."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0):
                found.update(tokens(text.as_py()))
                if len(found) > 300_000:
                    yield give()
                    found.clear()
        yield give()

    return text_batches(train).select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _level():
    """A word's number of occurrences on a scale of 64 levels a doubling."""
    return F.floor(F.log2("n") * 64).cast("int")


def frequent_level(counts: DataFrame, most: int) -> int:
    """The lowest level from which on there are at most ``most`` words: found by counts of levels, without an order of all words in one task."""
    found, held = sorted(((r.level, r.k) for r in counts.groupBy(_level().alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True), 0
    least = 1 << 30
    for level, k in found:
        held += k
        if held > most:
            break
        least = level
    return least


def encode(docs: DataFrame, units: _Units) -> DataFrame:
    """doc_id, held_out, row, ids (units as 32-bit numbers), rare (words that have no unit of their own, in order) for each row of ``docs``."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(units)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            ids, rare = [], []
            for text in batch.column(3):
                words = tokens(text.as_py())
                u = np.fromiter(map(of.__getitem__, words), "<u4", len(words))
                ids.append(u.tobytes())
                rare.append([words[i] for i in np.flatnonzero(u > of.own)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], ["doc_id", "held_out", "row", "ids", "rare"])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"))
    return materialize(text_batches(asked).mapInArrow(code, "doc_id long, held_out boolean, row long, ids binary, rare array<binary>"), "encoded")


def count_pairs(rows: DataFrame, column: str, kind: str, size: int, of: np.ndarray | None = None) -> np.ndarray:
    """Matrix of how often a number below ``size`` follows a number; rows: the first. ``column`` holds them as bytes of ``kind``, to be looked up in ``of`` if given."""
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast(of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = shared.value, np.zeros(size * size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                u = np.frombuffer(ids.as_py(), kind).astype(np.int64)
                u = np.concatenate(([END], u if of is None else of[u], [END]))
                np.add.at(total, u[:-1] * size + u[1:], 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 500_000):
            part = at[i : i + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["code", "n"])

    found = rows.select(column).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[found["code"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def assign_words(train: DataFrame, words: list[bytes], distinct: int, own: int, unit_class: np.ndarray, g: np.ndarray, bucket_words: int = 5_000, most: int | None = None) -> DataFrame:
    """(word, n, class) for each word of ``train`` (ids, rare) beyond the first ``own``: the class likeliest by the classes before and after all its n places.

    unit_class: present class of each unit; g: bigrams of classes; distinct: number of words, which gives the number of buckets (of about ``bucket_words`` each).
    A task hands on, now and then, a row for each bucket: its words and the classes beside each of their places, two bytes a place, or how often each
    class stands there for words of more than ``most`` places (where that is shorter). Buckets are merged row by row, so no word's places are held together.
    """
    import pyarrow as pa

    classes, buckets = len(g), max(16, distinct // bucket_words)
    most = 4 * classes if most is None else most
    shared = train.sparkSession.sparkContext.broadcast((words, unit_class))
    names = ["bucket", "counted", "words", "sizes", "near"]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of = shared.value
        in_bucket = lambda some: np.fromiter(map(zlib.crc32, some), np.uint32, len(some)).astype(np.int64) % buckets
        bucket_of = np.append(0, in_bucket(words))  # by unit
        at: list[tuple] = []  # (word's unit, class before, class after) of frequent words
        rare: dict[bytes, bytearray] = {}

        def rows(some: list, bucket: np.ndarray, sizes: np.ndarray | None, near: bytes, width: np.ndarray) -> Iterator[tuple]:
            """For each bucket one; all in the order of buckets, ``width`` bytes of ``near`` for each word."""
            edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            byte = np.append(0, np.cumsum(width))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                yield int(bucket[a]), sizes is None, b"\n".join(some[a:b]), b"" if sizes is None else sizes[a:b].astype("<u4").tobytes(), near[byte[a] : byte[b]]

        def give() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            if at:
                u, pairs = (np.concatenate([x[k] for x in at]) for k in (0, 1))
                order = np.argsort(bucket_of[u] << 32 | u, kind="stable")
                u, pairs = u[order], pairs[order]
                first = np.flatnonzero(np.diff(u, prepend=-1))
                n = np.diff(np.append(first, len(u)))
                dense = n > most
                few, many = np.repeat(~dense, n), np.flatnonzero(dense)
                w = u[first]
                out += rows([words[x - 1] for x in w[~dense]], bucket_of[w[~dense]], n[~dense], pairs[few].tobytes(), 2 * n[~dense])
                table = np.stack([np.bincount(np.concatenate([pairs[f : f + k, 0], pairs[f : f + k, 1].astype(np.int64) + classes]), minlength=2 * classes) for f, k in zip(first[many], n[many], strict=True)]) if len(many) else np.zeros((0, 2 * classes))
                out += rows([words[x - 1] for x in w[many]], bucket_of[w[many]], None, table.astype("<u4").tobytes(), np.full(len(many), 8 * classes))
            if rare:
                some = list(rare)
                bucket = in_bucket(some)
                order = np.argsort(bucket, kind="stable").tolist()
                some = [some[x] for x in order]
                n = np.fromiter((len(rare[x]) // 2 for x in some), np.int64, len(some))
                out += rows(some, bucket[order], n, b"".join([rare[x] for x in some]), 2 * n)
            at.clear()
            rare.clear()
            kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
            for i in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 256], strict=True), kinds, strict=True)], names)

        held = 0
        for batch in batches:
            for ids, few in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                u = np.frombuffer(ids.as_py(), "<u4").astype(np.int64)
                c = np.concatenate(([END], of[u], [END])).astype(np.uint8)
                pairs = np.stack([c[:-2], c[2:]], 1)
                mid = (u > own) & (u <= len(words))
                at.append((u[mid], pairs[mid]))
                for w, p in zip(few, pairs[u > len(words)], strict=True):
                    rare.setdefault(w, bytearray()).extend(p.tobytes())
                held += len(u)
            if held > 3_000_000:
                yield from give()
                held = 0
        yield from give()

    share = (g.sum(0) + 0.5) / (g.sum() + 0.5 * classes)
    ahead = np.log((g + 10 * share) / (g.sum(1, keepdims=True) + 10))
    mass = g.sum(0)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, index, counted = -1, {}, np.zeros((1024, 2 * classes))

        def chosen() -> Iterator[pa.RecordBatch]:
            some = list(index)
            for i in range(0, len(some), 20_000):
                before, after = (counted[i : min(i + 20_000, len(some)), k * classes : (k + 1) * classes] for k in (0, 1))
                n = before.sum(1)
                gain = before @ ahead + after @ ahead.T - n[:, None] * np.log(mass + n[:, None])
                gain[:, (mass == 0) | (np.arange(classes) == END)] = -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 20_000], pa.binary()), pa.array(n.astype(np.int64)), pa.array(gain.argmax(1).astype(np.int32))], ["word", "n", "class"])

        for batch in batches:
            for here, dense, some, sizes, near in (tuple(x.as_py() for x in row) for row in zip(*batch.columns, strict=True)):
                if here != bucket:
                    yield from chosen()
                    bucket, index = here, {}
                    counted[:] = 0
                some = some.split(b"\n")
                at = np.fromiter((index.setdefault(w, len(index)) for w in some), np.int64, len(some))
                if len(index) > len(counted):
                    counted = np.concatenate([counted, np.zeros((max(len(index) - len(counted), len(counted)), 2 * classes))])
                if dense:
                    counted[at] += np.frombuffer(near, "<u4").reshape(len(some), -1)
                else:
                    pairs, at = np.frombuffer(near, np.uint8).reshape(-1, 2), np.repeat(at, np.frombuffer(sizes, "<u4")) * (2 * classes)
                    for k in (0, 1):
                        np.add.at(counted.reshape(-1), at + pairs[:, k] + k * classes, 1)
        yield from chosen()

    found = train.select("ids", "rare").mapInArrow(contexts, "bucket int, counted boolean, words binary, sizes binary, near binary")
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(choose, "word binary, n long, class int")


def resolve(coded: DataFrame, words: int, counts: np.ndarray, unit_class: np.ndarray, vocabulary: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, log (of counts + 0.5, summed), classes (a byte for each word) for each row of ``coded``; all words have their own class."""
    import pyarrow as pa

    shared = coded.sparkSession.sparkContext.broadcast((counts, unit_class))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "log", "classes"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, of = shared.value
        log_c = np.log10(counts + 0.5)
        for batch in batches:
            logs, known, classes, rare = [], [], [], []
            for ids in batch.column(3):
                u = np.frombuffer(ids.as_py(), "<u4").astype(np.int64)
                often = u[u <= words]
                logs.append(float(log_c[often - 1].sum() + log_c[-1]))
                known.append(len(often) + int(counts[-1] > 0))
                classes.append(of[u].astype(np.uint8).tobytes())
                rare.append(np.flatnonzero(u > words).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(logs, pa.float64()), pa.array(known, pa.int64()), pa.array(classes, pa.binary()), pa.array(rare, pa.binary())], ["doc_id", "held_out", "row", "log", "known", "classes", "at"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs, known, classes, sizes = [], [], [], []
            for log, k, c, at, ks, ns, cs in zip(*(batch.column(i).to_pylist() for i in range(2, 9)), strict=True):
                at, c = np.frombuffer(at, "<u4"), np.frombuffer(c, np.uint8).copy()
                ns = np.array(ns or [], float)  # of the rare words that training has
                if len(ns):
                    c[at[np.array(ks)]] = cs
                logs.append(log + np.log10(ns + 0.5).sum() + (len(at) - len(ns)) * np.log10(0.5))
                known.append(k + len(ns))
                classes.append(c.tobytes())
                sizes.append(len(c) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(classes, pa.binary())], names)

    rare = coded.select("row", F.posexplode("rare").alias("k", "word")).join(vocabulary, "word")
    found = rare.groupBy("row").agg(F.collect_list(F.struct("k", "n", "class")).alias("_f")).select("row", F.col("_f.k").alias("ks"), F.col("_f.n").alias("ns"), F.col("_f.class").alias("cs"))
    base = coded.select("doc_id", "held_out", "row", "ids").mapInArrow(look_up, "doc_id long, held_out boolean, row long, log double, known long, classes binary, at binary")
    both = base.join(found, "row", "left").select("doc_id", "held_out", "log", "known", "classes", "at", "ks", "ns", "cs")
    return materialize(both.mapInArrow(fill, "doc_id long, held_out boolean, n_tokens long, n_known long, log double, classes binary"), "resolved")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 12) -> np.ndarray:
    """A class for each unit, 0 for unit 0 alone. Units move to the class that gains most likelihood, most frequent first, until none moves."""
    size = len(bigrams)
    mass = bigrams.sum(0) + bigrams.sum(1)
    order = [u for u in np.argsort(-mass, kind="stable") if u != END and mass[u] > 0]
    of = np.ones(size, int)
    of[END] = 0
    for i, u in enumerate(order):
        of[u] = 1 + i % (classes - 1)
    member = np.eye(classes)[of]
    g = member.T @ bigrams @ member
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a = of[u]
            right, left, own = np.bincount(of, bigrams[u], classes), np.bincount(of, bigrams[:, u], classes), bigrams[u, u]
            right[a] -= own  # to and from all others
            left[a] -= own
            g[a] -= right
            g[:, a] -= left
            g[a, a] -= own
            out, into, f = g.sum(1), g.sum(0), _xlogx(g)
            rows = _xlogx(g + right[None]) - f
            cols = _xlogx(g + left[:, None]) - f
            i = np.arange(classes)
            gain = rows.sum(1) - rows[i, i] + cols.sum(0) - cols[i, i] + _xlogx(g[i, i] + right + left + own) - f[i, i]
            gain -= _xlogx(out + right.sum() + own) - _xlogx(out) + _xlogx(into + left.sum() + own) - _xlogx(into)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            g[b] += right
            g[:, b] += left
            g[b, b] += own
            of[u], moved = b, moved + (b != a)
        if moved <= size // 500:
            break
    return of


def _fit(docs: DataFrame, frequent: int, own: int, buckets: int, classes: int, most: int | None = None) -> tuple[ClassModel, DataFrame, DataFrame]:
    """The model, (word, n, class) of all training words, and ``docs`` as ``resolve`` gives them."""
    if classes > 256:
        raise ValueError("a class is a byte")
    spark, train = docs.sparkSession, docs.where(~_held_out())
    counts = materialize(count_words(train), "word-counts")
    n_docs = train.count()
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    least = frequent_level(counts, frequent)
    top = counts.where(_level() >= least).toArrow()
    order = sorted(zip((-top["n"].to_numpy()).tolist(), top["word"].to_pylist(), strict=True))
    words, often = [w for _, w in order], np.array([-n for n, _ in order] + [n_docs], np.int64)
    units, core = _Units(words, buckets), _Units(words[:own], buckets)
    to_core = np.array([END, *(core[w] for w in words), *range(core.own + 1, core.own + 1 + buckets)])
    coded = encode(docs, units)
    seen = coded.where("not held_out")
    bigrams = count_pairs(seen, "ids", "<u4", core.own + buckets + 1, to_core)
    of = exchange(bigrams, classes)
    member = np.eye(classes)[of]
    unit_class = of[to_core]
    vocabulary = assign_words(seen, words, int(total.v), core.own, unit_class, member.T @ bigrams @ member, most=most)
    first = [(bytearray(w), int(n), int(of[i + 1])) for i, (w, n) in enumerate(zip(words[:own], often, strict=False))]
    vocabulary = materialize(vocabulary.unionByName(spark.createDataFrame(first, "word binary, n long, class int")), "vocabulary")
    unit_class = unit_class.copy()
    known = vocabulary.where(_level() >= least).select("word", "class").toArrow()
    for w, c in zip(known["word"].to_pylist(), known["class"].to_pylist(), strict=True):
        unit_class[units[w]] = c
    resolved = resolve(coded, len(words), often, unit_class, vocabulary)
    kinds = np.zeros(classes)
    for r in vocabulary.groupBy("class").agg(F.count(F.lit(1)).alias("v")).collect():
        kinds[r["class"]] = r.v
    g = count_pairs(resolved.where("not held_out"), "classes", "u1", classes)
    mass = g.sum(0)
    share = (mass + 0.5) / (mass.sum() + 0.5 * classes)
    transition = np.log10((g + 10 * share) / (g.sum(1, keepdims=True) + 10))
    room = np.log10(mass + 0.5 * (kinds + 1))  # END's is that of its own count, so the end's probability given its class is 1
    model = ClassModel(int(total.n or 0) + n_docs, total.v + (n_docs > 0), {w: i for i, w in enumerate(words)}, often, units, unit_class, transition, room)
    return model, vocabulary, resolved


def _judge(resolved: DataFrame, model: ClassModel) -> DataFrame:
    import pyarrow as pa

    base_room = float(np.log10(model.train_tokens + 0.5 * (model.train_words + 1)))
    shared = resolved.sparkSession.sparkContext.broadcast((model.transition, model.room))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "log", "model"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, room = shared.value
        for batch in batches:
            out = []
            for x in batch.column(5):
                c = np.concatenate(([END], np.frombuffer(x.as_py(), np.uint8), [END])).astype(int)
                out.append(float(transition[c[:-1], c[1:]].sum() - room[c[1:]].sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(out, pa.float64())], names)

    part = resolved.select("doc_id", "held_out", "n_tokens", "n_known", "log", "classes").mapInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, log double, model double")
    return part.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("log") - F.col("n_tokens") * base_room).alias("base_score"), (F.col("model") + F.col("log")).alias("score"),
    )


def fit(docs: DataFrame, *, frequent: int = 131_072, own: int = 1024, buckets: int = 256, classes: int = 64, most: int | None = None) -> tuple[ClassModel, DataFrame]:
    """The model of the documents that aren't held out, and (word, n, class) of all their words."""
    return _fit(docs, frequent, own, buckets, classes, most)[:2]


def score(docs: DataFrame, model: ClassModel, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``."""
    return _judge(resolve(encode(docs, model.units), model.units.own, model.counts, model.unit_class, counts), model)


def fit_score(docs: DataFrame, *, frequent: int = 131_072, own: int = 1024, buckets: int = 256, classes: int = 64) -> DataFrame:
    """``score`` of the documents by their own ``fit``, whose texts are split once for both."""
    model, _, resolved = _fit(docs, frequent, own, buckets, classes)
    return _judge(resolved, model)
