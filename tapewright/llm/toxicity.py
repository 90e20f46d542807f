"""Toxicity by weak supervision.

1. Lexicon: of the training rows' words and word beginnings (4 to 8 letters), those that occur in toxic rows far more often than
   in clean ones, by counts over all training rows.
2. Voters: the lexicon's strongest entries vote each for itself (toxic if present, else they abstain); the others vote in pools;
   patterns (repeated hits, hits per word, no hit at all) vote too, some of them for clean.
3. Generative label model: expectation maximisation over the number of training documents with each combination of votes, labelled
   or not, estimates every voter's rates given either class. Voters that agree given the class more than the model allows
   (residual correlation of a pair) share one voice: their log odds are divided by one plus their summed correlations.
4. Linear classifier: logistic regression on lexicon entries and patterns, trained on the model's posterior labels of a bounded
   sample (``sample`` rows), then scaled to probabilities on labelled training rows of the same bound.

Defined cases: a null or empty text has no hits and gets the score of such texts; repeated rows score alike; a label row
without a document counts for nothing; several labels of a document count as its greatest, null as none; without both classes in the labels every
score is the toxic share (0 without labels). An empty table gives no rows. The text alone enters a score, whole, of any length, one at a time.
Entries that tie are taken in the order of their names, rows of the sample by a hash of id and text. Columns named score or predicted, or with a
leading ``_``, are dropped; others pass through.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import materialize, text_batches, without

_word = re.compile(r"\w+").findall
STEMS = (4, 5, 6, 7, 8)
PATTERNS = ("hits >= 2", "hits >= 3", "distinct >= 2", "hits a word >= 1/200", "no hit", "no hit in over 50 words")


def features(text: str | None) -> tuple[Counter, int]:
    """How often each word occurs, and the number of words."""
    words = Counter(_word((text or "").lower()))
    return words, words.total()


def entries(words) -> set[str]:
    """Lexicon candidates of a text: its words, and beginnings of longer words, marked by a final ``*``."""
    return set(words) | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(1))


def _count(rows: DataFrame) -> DataFrame:
    """(entry, n): documents of ``rows`` (text) that hold an entry, for each entry."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["entry", "n"])
        for batch in batches:
            for text in batch.column(0):
                found.update(entries(features(text.as_py())[0]))
                if len(found) > 200_000:
                    yield give()
                    found.clear()
        yield give()

    return text_batches(rows).select("text").mapInArrow(count, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def mine_lexicon(train: DataFrame, precision: float = 0.9) -> list[str]:
    """train: (text, toxic). The entries that hold toxic rows at a smoothed rate of ``precision`` or more and explain some that others don't, most frequent first.

    Every entry of three toxic texts is looked at. Copies of a toxic text count once. An entry needs so many toxic texts that chance would give a twentieth of one such entry.
    """
    n = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return []
    bad = materialize(train.where("toxic = 1").groupBy(F.xxhash64("text").alias("_x")).agg(F.first("text").alias("text")).select("text"), "toxic-texts")
    n[1] = bad.count()
    toxic = materialize(_count(bad).where("n >= 3"), "toxic-entries")
    surely = float(np.log(20 * max(toxic.count(), 1)) / -np.log(min(0.5, n[1] / (n[0] + n[1]))))
    odds = n[0] / n[1]  # rates as if the classes were equally large
    toxic = toxic.where(F.col("n") >= surely)
    clean = _count(train.where("toxic = 0")).withColumnRenamed("n", "c")
    x, c = F.col("n"), F.coalesce("c", F.lit(0))
    good = toxic.join(clean, "entry", "left").where((x * odds / (x * odds + c + 0.5) >= max(precision, 0.9)) & (x > 3 * c)).select("entry", "n").toArrow()
    kept: dict[str, int] = {}
    for e, x in sorted(zip(good["entry"].to_pylist(), good["n"].to_pylist(), strict=True), key=lambda y: (-y[1], y[0])):
        if not any(len(e) >= k and f"{e[:k]}*" in kept for k in STEMS):
            kept[e] = x
    return explaining(bad, kept, n[1])


def explaining(toxic: DataFrame, lexicon: dict[str, int], texts: int, common: float = 0.03) -> list[str]:
    """The entries that a share ``common`` of the toxic texts holds, and of the others those that explain two or more that no kept one does.

    Words that copies of one toxic text share go: others explain it. ``lexicon`` has the number of toxic texts of each entry, ``texts`` is
    that of all; of the texts without a common entry, those that hold the same entries are counted together.
    """
    import pyarrow as pa

    names = list(lexicon)
    kept = {i for i, e in enumerate(names) if lexicon[e] >= max(3, common * texts)}
    shared = toxic.sparkSession.sparkContext.broadcast(({e: i for i, e in enumerate(names)}, kept))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, common = shared.value
        for batch in batches:
            rows = (sorted(_hits(t.as_py(), index)[0]) for t in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r for r in rows if r and common.isdisjoint(r)], pa.list_(pa.int32()))], ["at"])

    found = text_batches(toxic.select("text")).mapInArrow(held, "at array<int>").groupBy("at").agg(F.count(F.lit(1)).alias("n")).toArrow()
    weight = found["n"].to_pylist()
    holders: dict[int, set[int]] = {}
    for i, at in enumerate(found["at"].to_pylist()):
        for e in at:
            holders.setdefault(e, set()).add(i)
    seen: set[int] = set()
    heap = sorted((-sum(weight[i] for i in x), names[e], e) for e, x in holders.items())
    while heap:  # gains only shrink: look anew at the best alone
        _, name, e = heapq.heappop(heap)
        gain = sum(weight[i] for i in holders[e] - seen)
        if heap and gain < -heap[0][0]:
            heapq.heappush(heap, (-gain, name, e))
        elif gain < 2:
            break
        else:
            kept.add(e)
            seen |= holders[e]
    return [x for i, x in enumerate(names) if i in kept]


@dataclass
class Model:
    lexicon: list[str]
    voices: int  # lexicon entries that vote for themselves; the others vote in ``pools``
    pools: int
    base: float
    rates: np.ndarray | None = None  # voter x class x (toxic, clean, abstain)
    share: np.ndarray | None = None  # voter's voice after correlations
    weights: np.ndarray | None = None
    bias: float = 0.0


def _hits(text: str | None, index: dict[str, int]) -> tuple[dict[int, int], int]:
    """Lexicon entries found and how often, and the number of words."""
    words, n = features(text)
    found: dict[int, int] = {}
    for w, c in words.items():
        at = index.get(w)
        if at is not None:
            found[at] = found.get(at, 0) + c
        if len(w) > 4:
            for k in STEMS:
                if len(w) > k and (at := index.get(f"{w[:k]}*")) is not None:
                    found[at] = found.get(at, 0) + c
    return found, n


def _patterns(found: dict[int, int], n: int) -> list[bool]:
    hits = sum(found.values())
    return [hits >= 2, hits >= 3, len(found) >= 2, hits * 200 >= max(n, 1) and hits > 0, not hits, not hits and n > 50]


def _votes(found: dict[int, int], n: int, m: Model) -> str:
    """A letter for each voter: t(oxic), c(lean), - (abstains)."""
    lex = ["-"] * (m.voices + m.pools)
    for at in found:
        lex[at if at < m.voices else m.voices + at % m.pools] = "t"
    p = _patterns(found, n)
    return "".join(lex) + "".join("-t"[x] for x in p[:4]) + "".join("-c"[x] for x in p[4:])


def _row(found: dict[int, int], n: int, lexicon: int) -> tuple[list[int], list[float]]:
    """Sparse features: log count of each entry, patterns, log hits."""
    hits = sum(found.values())
    at, x = list(found), [float(np.log1p(c)) for c in found.values()]
    for i, p in enumerate(_patterns(found, n)):
        if p:
            at.append(lexicon + i)
            x.append(1.0)
    at.append(lexicon + len(PATTERNS))
    x.append(float(np.log1p(hits)))
    return at, x


def _one_hot(votes: list[str]) -> np.ndarray:
    """combination x voter x vote"""
    return np.eye(3)[np.array([["tc-".index(x) for x in k] for k in votes])]


def posterior(hot: np.ndarray, prior: float, rates: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Chance of toxic, given the votes; a voter's log odds count by its share."""
    odds = np.log(prior / (1 - prior)) + (np.einsum("pjv,jv->pj", hot, np.log(rates[:, 1] / rates[:, 0])) * share).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _sums(hot: np.ndarray, n: np.ndarray, prior: float, rates: np.ndarray, share: np.ndarray, pairs: bool) -> np.ndarray:
    """Of documents with these votes, for either class (clean, toxic): their number, voter x vote sums, and with ``pairs`` voter x voter sums of signed votes; in one row."""
    post = posterior(hot, prior, rates, share)
    signed, out = hot[:, :, 0] - hot[:, :, 1], []
    for p in (1 - post, post):
        w = n * p
        out += [np.array([w.sum()]), np.einsum("p,pjv->jv", w, hot).ravel(), ((signed * w[:, None]).T @ signed).ravel() if pairs else np.zeros(0)]
    return np.concatenate(out)


def _sums_of(votes: DataFrame, *now) -> np.ndarray:
    """``_sums`` over the whole table (votes, n), a row from each task."""
    import pyarrow as pa

    shared = votes.sparkSession.sparkContext.broadcast(now)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = _sums(_one_hot(batch.column(0).to_pylist()), batch.column(1).to_numpy().astype(float), *shared.value)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    return np.sum([r.sums for r in text_batches(votes.select("votes", "n")).mapInArrow(add, "sums array<double>").collect()], axis=0)


def label_model(votes: DataFrame, base: float, rounds: int = 60, most: int = 20_000) -> tuple[np.ndarray, np.ndarray, float]:
    """(rates, shares, prior) from ``votes`` (votes, n): the number of documents with each combination of votes.

    Each round needs sums over all combinations: up to ``most`` are summed here, more by the tasks. ``votes`` is read in each round.
    """
    first = votes.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.first("votes").alias("v")).first()
    voters, n = len(first.v), float(first.n)
    if first.k <= most:
        rows = votes.orderBy(F.desc("n"), "votes").collect()
        hot, times = _one_hot([r.votes for r in rows]), np.array([r.n for r in rows], float)
        sums = lambda *now: _sums(hot, times, *now)
    else:
        sums = lambda *now: _sums_of(votes, *now)

    def split(row: np.ndarray) -> list[tuple]:
        """For either class, clean first: number, voter x vote, voter x voter."""
        return [(c[0], c[1 : 1 + 3 * voters].reshape(voters, 3), c[1 + 3 * voters :]) for c in np.split(row, 2)]

    prior, share = min(max(base, 1e-3), 0.5), np.ones(voters)
    rates = np.full((voters, 2, 3), 1 / 3)
    some = sum(c[1] for c in split(sums(prior, rates, share, False))) / max(n, 1)
    for j in range(voters):
        rates[j, 1], rates[j, 0] = [min(0.5, 10 * some[j, 0] + 0.05), some[j, 1] * 0.1, 0.5], [some[j, 0] * 0.1, some[j, 1], 1]
    rates = (rates + 1e-4) / (rates + 1e-4).sum(2, keepdims=True)
    for step in range(rounds):
        classes = split(sums(prior, rates, share, step in (9, 29)))
        for y, (_, of, _) in enumerate(classes):
            rates[:, y] = of + 0.1
        rates /= rates.sum(2, keepdims=True)
        prior = float(np.clip(classes[1][0] / n, 1e-4, 0.9))
        if step in (9, 29):  # residual correlation of votes given the class
            corr = np.zeros((voters, voters))
            for w, of, both in classes:
                mean = (of[:, 0] - of[:, 1]) / max(w, 1e-9)
                c = both.reshape(voters, voters) / max(w, 1e-9) - np.outer(mean, mean)
                d = np.sqrt(np.maximum(np.diag(c), 1e-9))
                corr += w / n * np.clip(c / d / d[:, None], 0, 1)
            np.fill_diagonal(corr, 0)
            share = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(1))
    return rates, share, prior


def logistic(rows: list[tuple[list[int], list[float]]], y: np.ndarray, width: int, steps: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias for soft labels, by gradient descent with momentum scaling (Adam)."""
    r = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    c, x = np.concatenate([a for a, _ in rows]).astype(int), np.concatenate([b for _, b in rows])
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(r, x * w[c], len(rows)) + w[-1]
        e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.append(np.bincount(c, x * e[r], width) / len(rows) + l2 * w[:-1], e.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, voices: int = 16, pools: int = 4, broadcast_rows: int = 1_000_000) -> Model:
    """Learns from the documents whose fold isn't 0 and their labels. ``sample`` bounds the rows that the classifier is fitted on.

    Labels of up to ``broadcast_rows`` documents (an id and a mark each, some 50 MB as a hash table) go to every task; more meet the texts in a shuffle.
    """
    marks = labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    train = docs.select("doc_id", "text").where(fold() != 0)
    marks = materialize(marks, "marks")
    marks = F.broadcast(marks) if marks.count() <= broadcast_rows else marks
    labelled = materialize(train.join(marks, "doc_id").select("doc_id", "text", "toxic"), "labelled")
    n = labelled.agg(F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("share")).first()
    mined = mine_lexicon(labelled)
    m = Model(mined, min(voices, len(mined)), pools, float(n.share or 0))
    if not mined:
        return m
    index, spark = {e: i for i, e in enumerate(mined)}, docs.sparkSession
    shared = spark.sparkContext.broadcast((index, m))

    import pyarrow as pa

    give = lambda found: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["votes", "n"])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, m = shared.value
        found: Counter = Counter()
        for batch in batches:
            found.update(_votes(*_hits(t.as_py(), index), m) for t in batch.column(0))
            if len(found) > 200_000:
                yield give(found)
                found.clear()
        yield give(found)

    votes = materialize(train.select("text").mapInArrow(vote, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")), "votes")
    m.rates, m.share, prior = label_model(votes, m.base)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, m = shared.value
        for batch in batches:
            hits = [_hits(t.as_py(), index) for t in batch.column(0)]
            rows = [_row(f, k, len(index)) for f, k in hits]
            yield pa.RecordBatch.from_arrays([pa.array([_votes(f, k, m) for f, k in hits], pa.string()), pa.array([a for a, _ in rows], pa.list_(pa.int32())), pa.array([x for _, x in rows], pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["votes", "at", "x", "toxic", "h"])

    # The rows of the least hashes; a share of them by hash first, so that only about as many meet the sort.
    labelled, share = labelled.withColumn("h", F.xxhash64("doc_id", "text")), min(1.0, 1.1 * sample / max(n.n, 1))
    some = labelled.where(F.pmod("h", F.lit(1_000_000)) <= int(share * 1_000_000)).select("text", "toxic", "h").mapInArrow(sparse, "votes string, at array<int>, x array<double>, toxic int, h long")
    rows = some.orderBy("h", "votes").limit(sample).collect()
    soft = posterior(_one_hot([r.votes for r in rows]), prior, m.rates, m.share)
    data, truth = [(list(r["at"]), list(r["x"])) for r in rows], np.array([r.toxic for r in rows], float)
    m.weights, m.bias = logistic(data, soft, len(mined) + len(PATTERNS) + 1)
    # Probabilities: one slope and one shift on labelled rows.
    z = np.array([m.weights[a] @ np.array(x) + m.bias for a, x in data])
    (slope,), shift = logistic([([0], [float(x)]) for x in z], truth, 1, l2=1e-4)
    if slope > 0:
        m.weights, m.bias = m.weights * slope, m.bias * slope + shift
    return m


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more)."""
    docs = text_batches(without(docs, "score", "predicted"))
    if model.weights is None:
        return docs.withColumns({"score": F.lit(model.base), "predicted": F.lit(int(model.base >= 0.5))})
    shared = docs.sparkSession.sparkContext.broadcast(({e: i for i, e in enumerate(model.lexicon)}, model))

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        index, m = shared.value
        out = np.empty(len(text))
        for i, t in enumerate(text):
            at, x = _row(*_hits(t, index), len(index))
            out[i] = m.weights[at] @ np.array(x) + m.bias
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return docs.withColumn("score", score(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those that the model calls toxic."""
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted") and not c.startswith("_")]
    return score_toxicity(docs, model).where("predicted = 0").select(*names)
