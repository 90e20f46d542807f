"""Corpus operators against brute force, on small fixtures with nulls, empty and long texts, ties, copies, no rows, and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import ann, chat_quotes, class_lm, fingerprints, line_dedup, mixing, near_dedup, packing, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def prose(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    r = random.Random(7)
    texts = [prose(r.randint(1, 120), r) for _ in range(40)]
    for i in range(12):  # near and exact copies
        words = texts[3].split() if i % 2 else prose(300, random.Random(99)).split()
        words[r.randrange(len(words))] = "edit"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0], "", None, " ", "a b", "a b", prose(20_000, r), "x\ny\nz\nq", "k\nx\ny\nz", "\n\n\n\n"]
    return [(i, t, "en", None if i % 9 == 0 else f"s{min(i % 5, 2)}", 0) for i, t in enumerate(texts)] + [(None, "no id here at all", "en", "s0", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_line_dedup(spark, docs):
    rows = [(1, "a\nb\nc\nd"), (2, "z\na\nb\nc\nd\ny"), (3, None), (4, "a\nb"), (5, "\n\n\n\n"), (6, "\n\n\n"), (7, "r\nr\nr\nr"), (8, " a \nb\nc"), (8, "q"), (9, "A\nB\nA\nB\nA\nB")]
    out = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _k", "2 as n_lines")).collect()}
    assert {k[0]: k[1] for k in out if k[0] != 8} == {1: "a\nb\nc\nd", 2: "z\ny", 3: "", 4: "a\nb", 5: "\n\n\n\n", 6: "\n\n\n", 7: "r\nr\nr", 9: "A\nB\nA\nB"}
    assert out[(2, "z\ny")].removed_lines == [1, 2, 3, 4] and (8, "") in out
    lost = [(None, "a\nb\nc"), (None, "k\nl\nm"), (3, "a\nb\nc\nd"), (3, "a\nb\nc\nd"), (4, "k\nl\nm")]
    kept = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(lost, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([(None, "a\nb\nc"), (None, "k\nl\nm"), (3, "d"), (3, "d"), (4, "")], key=str)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    ordered = sorted(corpus(), key=lambda r: -1 if r[0] is None else r[0])
    assert got == brute_lines([(i, t) for i, t, *_ in ordered])


def brute_lines(rows):
    """Texts by id without the lines of later windows; rows in the order of their ids."""
    first, out = {}, {}
    for i, t in rows:
        lines, gone, own, held = (t or "").split("\n"), set(), set(), set()
        for j in range(len(lines) - 2):
            w = tuple(x.strip(" ") for x in lines[j : j + 3])
            if any(w) and (at := first.setdefault(w, (i, j))) != (i, j):
                if at[0] == i:
                    own |= {j, j + 1, j + 2}
                    held |= {at[1], at[1] + 1, at[1] + 2}
                else:
                    gone |= {j, j + 1, j + 2}
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone | (own - held))
    return out


def test_line_dedup_within_a_text(spark):
    """Against brute force and the SQL, with many overlapping repeats inside and across texts, and one long text of them."""
    import duckdb

    from tapewright.llm.queries import ORACLE_SQL

    r = random.Random(12)
    rows = [(i, "\n".join(r.choice("abc") * (r.random() > 0.1) for _ in range(r.randint(0, 14)))) for i in range(60)]
    rows.append((60, "\n".join(r.choice("pqrs") for _ in range(4_000))))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(documents).collect()}
    assert got == brute_lines(rows)
    documents = documents.toPandas()  # noqa: F841
    assert dict(duckdb.sql(f"select doc_id, text from ({ORACLE_SQL['op2_line_dedup']})").fetchall()) == got


def test_best_fit_plan_is_gapless_and_full():
    for seed in range(40):
        r = random.Random(seed)
        size = r.choice([10, 64, 4096])
        counts = Counter(r.randint(1, r.choice([size, max(1, size // 6)])) for _ in range(r.randint(0, 800)))
        bins, n = defaultdict(list), Counter()
        for length, first, many, each, seq, at in packing.best_fit_plan(counts, size):
            for i in range(many * each):
                bins[seq + i // each].append((at + i % each * length, length))
                n[length] += 1
        assert n == counts
        for b in bins.values():
            end = 0
            for at, length in sorted(b):
                assert at == end
                end += length
            assert end <= size
        # Best-fit decreasing by single pieces, as a bound.
        rooms = []
        for length in sorted(counts.elements(), reverse=True):
            fit = [x for x in rooms if x >= length]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else size) - length)
        assert len(bins) == len(rooms)


def test_packing_tokens(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(1000, "I'm don't a.b,c Ünïcode ΣΊΣ İx e\u0301 <|endoftext|>x 12.5, ﬁ ½ \x1c a\x1cb \u00a0y\u0085z", "", "", 0)], DOCS)
    clash = docs.union(extra).selectExpr("*", "1 as sequence_id", "2 as _p", "3 as length", "'x' as ids")
    out = packing.pack_documents(clash, path, with_ids=True).collect()
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in [*corpus(), (1000, extra.first().text)]}
    got = defaultdict(dict)
    for r in out:
        got[r.doc_id][r.piece] = r
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) and r.start == 4096 * r.piece
    assert {i: [x for p in sorted(v) for x in v[p].ids] for i, v in got.items()} == want
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= 4096
    assert packing.pack_documents(empty(spark), path).count() == 0


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(min(1, len(w)), len(w) - 4)))


def similarity(a, b):
    a, b = bag(a), bag(b)
    return 1.0 if not a and not b else sum((a & b).values()) / sum((a | b).values())


def brute_classes(rows, threshold=0.8):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(rows[i][1], rows[j][1]) >= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_near_duplicates(spark, docs):
    rows = [r for r in corpus() if r[0] is not None]
    for small, block in ((32, 256), (1, 3)):
        out = near_dedup.near_duplicate_classes(docs.where("doc_id is not null"), small=small, block=block).collect()
        assert {r.doc_id: r.class_id for r in out} == brute_classes(rows) and len(out) == len(rows)
    assert {r.doc_id for r in out if r.is_first} == set(brute_classes(rows).values())
    kept = near_dedup.drop_near_duplicates(docs.unionAll(docs)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(brute_classes(rows).values())) and sum(r.doc_id is None for r in kept) == 1
    assert near_dedup.drop_near_duplicates(empty(spark)).columns == docs.columns and near_dedup.near_duplicate_classes(empty(spark)).count() == 0
    # One id with several texts: each is a document; one of them is a near copy of another id's text, and one comes twice. Rows without an id are told apart by their texts.
    base, some, other = (prose(n, random.Random(n)) for n in (100, 101, 90))
    several = [(1, base, "x"), (1, some, "x"), (1, other, "x"), (2, base + " more", "x"), (2, "quite another text", "x"), (1, base, "x"), (None, "one text here", "x"), (None, "another text there", "x"), (None, "one text here", "x"), (7, "another text there", "x")]
    clash = spark.createDataFrame(several, "doc_id long, text string, class_id string").selectExpr("*", "1 as _k", "2 as node", "3 as n")
    left = near_dedup.drop_near_duplicates(clash)
    assert left.columns == ["doc_id", "text", "class_id", "node", "n"] and sorted(r.text for r in left.collect()) == sorted({t for i, t, _ in several if t != base + " more"})
    assert sorted((r.doc_id or 0, r.class_id or 0, r.is_first) for r in near_dedup.near_duplicate_classes(clash).collect()) == [(0, 0, True)] * 3 + [(1, 1, True)] * 4 + [(2, 1, False), (2, 2, True), (7, 0, False)]


def test_components(spark):
    """A hub with many neighbours, chains, cycles and pairs, with least neighbours broadcast and joined."""
    r = random.Random(17)
    links = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000 + i, 5000 + (i + 1) % 9) for i in range(9)] + [(7, 1020)] + [(r.randrange(9000, 9200), r.randrange(9000, 9200)) for _ in range(120)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for p in links for x in p if find(x) != x}
    df = spark.createDataFrame(links, "a long, b long")
    for rows in (10**6, 0):
        assert {x.node: x.comp for x in near_dedup.components(df, rows).collect()} == want


def test_bag_minhash_is_unbiased():
    r, errors = random.Random(1), []
    for _ in range(20):
        a = {r.getrandbits(64): r.choice([1, 1, 2, 5, 17]) for _ in range(100)}
        b = {k: max(1, v + r.choice([-3, 0, 0, 6])) for k, v in a.items() if r.random() > 0.1}
        x, y = (np.sort(np.array([k for k, v in d.items() for _ in range(v)], np.uint64)) for d in (a, b))
        s = near_dedup.bag_minhash([x, y], 1024)
        errors.append((s[0] == s[1]).mean() - near_dedup.overlap(x, y))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03
    assert not near_dedup.bag_minhash([np.zeros(0, np.uint64)]).any()


def test_pfair_lags():
    for shares in ([1], [3, 1], [5, 3, 2], [1, 1, 1, 97], [7, 11, 13, 2]):
        total, done = sum(shares), [0] * len(shares)
        for task, block, slot, release, deadline in mixing.pfair_cycle(shares):
            assert block == done[task] and release <= slot < deadline
            done[task] += 1
            assert all(abs(d - w * (slot + 1) / total) < 1 for d, w in zip(done, shares, strict=True))
        assert done == shares


def test_mixing(spark, docs):
    out = mixing.mix_sources(docs.selectExpr("*", "1 as slot", "2 as _task"), {"s0": 3, "s1": 1}, block_docs=2).collect()
    assert sorted(r.position for r in out) == list(range(len(corpus()))) and {r.text for r in out} == {r[1] for r in corpus()}
    assert [r.slot for r in sorted(out, key=lambda r: r.position)] == sorted(r.slot for r in out)
    for r in out:
        assert r.release <= r.slot < r.deadline
    assert mixing.mix_sources(empty(spark)).count() == 0 and mixing.mix_sources(docs, max_sources=2).count() == docs.count()
    twice = mixing.mix_sources(docs.unionAll(docs)).collect()
    assert sorted(r.position for r in twice) == list(range(2 * len(corpus())))


def test_mixing_to_given_weights(spark):
    """After any number of slots each source is less than a block from its share, over 20 cycles; weights that integers hold are exact."""
    assert mixing.integer_weights({"a": 1, "b": 5, "*": 1}, 10_000) == {"a": 1, "b": 5, "*": 1}
    assert mixing.integer_weights({"a": 0.5, "b": 0.3, "*": 0.2, "c": 0}, 10_000) == {"a": 5, "b": 3, "*": 2}
    odd = mixing.integer_weights({"a": 2**0.5, "b": 3**0.5, "c": 1e-9}, 10_000)
    assert sum(odd.values()) == 10_000 and odd["c"] == 1
    shares = {"a": 3, "b": 1, "*": 2}
    many = spark.range(6 * 20 * 2 * 3).selectExpr("id as doc_id", "concat('t', id) as text", "element_at(array('a', 'a', 'a', 'b', 'c', 'd'), cast(id % 6 as int) + 1) as source")
    out = mixing.mix_sources(many, shares, block_docs=3).collect()
    slots = defaultdict(set)
    for r in out:
        slots["*" if r.source in "cd" else r.source].add(r.slot)
        assert r.release <= r.slot < r.deadline
    for upto in range(6 * 20):
        for s, w in shares.items():
            assert abs(sum(x <= upto for x in slots[s]) - w * (upto + 1) / 6) < 1


def test_mixing_equal_rows(spark):
    """Many rows that are equal, without an id or with one, in two sources: each has a place of its own, and time grows in proportion."""
    n = 30_000
    rows = spark.range(n).selectExpr("cast(null as long) as doc_id", "'' as text", "case when id % 3 = 0 then 'a' else 'b' end as source", "1 as position")
    rows = rows.unionByName(spark.range(n).selectExpr("5L as doc_id", "cast(null as string) as text", "'b' as source", "2 as position")).unionByName(spark.range(100).selectExpr("id as doc_id", "'x' as text", "'a' as source", "3 as position"))
    out = mixing.mix_sources(rows)
    assert out.columns == ["doc_id", "text", "source", "block", "release", "deadline", "slot", "position"]
    found = out.groupBy("source", "doc_id", "text").count().collect()
    want = Counter({("a", None, ""): n // 3, ("b", None, ""): n - n // 3, ("b", 5, None): n}) + Counter({("a", i, "x"): 1 for i in range(100)})
    assert {tuple(r)[:3]: r["count"] for r in found} == want
    assert out.select("position").distinct().count() == 2 * n + 100 and out.agg(F.max("position")).first()[0] == 2 * n + 99


def test_mixing_many_sources(spark):
    """Every source is a task of its own: blocks count within it and slots keep its releases and deadlines."""
    n = 1500
    many = spark.range(2 * n).selectExpr("id as doc_id", "concat('t', id) as text", f"concat('s', id % {n}) as source")
    out = mixing.mix_sources(many, block_docs=1).collect()
    blocks = defaultdict(list)
    for r in out:
        blocks[r.source].append(r.block)
        assert r.release <= r.slot < r.deadline
    assert len(blocks) == n and all(sorted(b) == [0, 1] for b in blocks.values()) and sorted(r.position for r in out) == list(range(2 * n))
    shuffled = mixing.mix_sources(many, block_docs=1, broadcast_rows=10).collect()
    assert {(r.doc_id, r.slot, r.position) for r in shuffled} == {(r.doc_id, r.slot, r.position) for r in out}


RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("example.net/de/8", "allow"), ("org/es/", "block"), ("x.org", "block")]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = (None, "allow")
    for rule, verdict in sorted(RULES, key=lambda r: len(r[0])):
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = (rule, verdict)
    return host, path, *best


def test_url_cascade(spark):
    r = random.Random(3)
    urls = [None, "", "nope", "http://", "x://COM/en/", "a://com.?/en/", "http://a.b.example.com/en/7x#y", "http://example.comx/en/7", "s://Ünï.ORG/es/", "a://.com/en/", "http://com/en", "h://u@com:8/en/", "h://x.org", "h://y.x.org?q"]
    urls += [f"http://{r.choice(['a.', ''])}{r.choice(['example', 'x'])}.{r.choice(['com', 'net', 'org', 'COM'])}/{r.choice(['en', 'de', 'es'])}/{r.randint(1, 99)}{r.choice(['', '?a', '#b'])}" for _ in range(400)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge_urls(df, [url_filter.parse_rule(*x) for x in RULES]).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(df.limit(0), [url_filter.parse_rule(*RULES[0])]).count() == 0
    assert {x.verdict for x in url_filter.judge_urls(df, []).collect()} == {"allow"}


def test_url_of_many_labels(spark):
    """Hosts of 100,000 labels and paths of a million characters; a rule that names a host alone, and clashing columns."""
    import time

    rules = [url_filter.parse_rule(*x) for x in [*RULES, ("a.b.example.com", "allow")]]
    urls = ["http://" + "a." * 100_000 + "x.org/" + "p" * 1_000_000, "http://" + "." * 100_000, "http://" + "ab." * 100_000 + "example.com/en/" + "7" * 100_000, "http://a.b.example.com", "http://z.a.b.example.com/en/7"]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, verdict string, _keys int")
    url_filter.judge_urls(df, rules).collect()
    began = time.perf_counter()
    got = url_filter.judge_urls(df, rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert [(r.rule, r.verdict) for r in got.orderBy("page_id").collect()] == [("x.org", "block"), (None, "allow"), ("example.com/en/7", "allow"), ("a.b.example.com", "allow"), ("example.com/en/7", "allow")]
    assert time.perf_counter() - began < 10


def test_cascade_is_exact():
    r = np.random.default_rng(1)
    keys = r.integers(0, 2**63, (2, 30_000)).astype(np.uint64)
    listed = (keys[0, :500], keys[1, :500])
    first = url_filter.Bloom(*listed, 0.05, 0)
    hit = first.holds(*keys) & (np.arange(30_000) >= 500)
    cascade = url_filter.Cascade(first, listed, (keys[0, hit], keys[1, hit]))
    assert hit.sum() > 100 and len(cascade.levels) > 2
    assert (cascade.listed(*keys) == (np.arange(30_000) < 500)).all()


def test_near_duplicates_of_any_id(spark):
    """The least ids there are come back whole; rows without an id stand before all, whatever their texts hash to."""
    low = [-(2**63), -(2**62) - 5, -1, 0, 2**63 - 1]
    texts = [prose(50, random.Random(i)) for i in range(len(low))]
    rows = [(i, t) for i, t in zip(low, texts)] + [(7, texts[0]), (8, texts[1]), (None, texts[4]), (None, "alone"), (None, "alone too")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.is_first) for r in near_dedup.near_duplicate_classes(df).collect()), key=str)
    want = [(i, i, True) for i in low[:4]] + [(7, low[0], False), (8, low[1], False), (low[4], None, False)] + [(None, None, True)] * 3
    assert got == sorted(want, key=str)
    assert sorted((str(r.doc_id), r.text) for r in near_dedup.drop_near_duplicates(df).collect()) == sorted([*((str(i), t) for i, t in zip(low[:4], texts)), ("None", texts[4]), ("None", "alone"), ("None", "alone too")])


def test_a_large_bucket_of_unlike_texts_sends_no_texts(spark):
    """Members of one bucket with signatures that don't agree: none passes the screen, and of two that do only these are sent again."""
    r = np.random.default_rng(3)
    sigs = r.integers(0, 2**32, (300, near_dedup.SLOTS), np.uint32)
    words = [prose(60, random.Random(i)) for i in range(300)]
    sigs[7], words[7] = sigs[250], words[250] + " more"
    sigs[7, :5] = 0
    store = spark.createDataFrame([(i, words[i], sigs[i].tobytes(), [5, i + 1000]) for i in range(300)], "node long, text string, sig binary, bands array<long>")
    members = spark.createDataFrame([(5, i, i) for i in range(300)], "bucket long, node long, comp long")
    assert [(x.a, x.b) for x in near_dedup.rest_of_buckets(members, store, 0.8, 64).distinct().collect()] == [(7, 250)]
    low = store.select(near_dedup._low("sig").alias("low")).first().low
    assert bytes(low) == bytes(sigs[0].astype(np.uint8))


def test_pairs_of_a_frequent_pivot_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "OFTEN", 10)
    texts = spark.createDataFrame([(i, f"{prose(40, random.Random(1))} x{i % 3}") for i in range(60)], "node long, text string")
    pairs = spark.createDataFrame([(0, i, 0, i) for i in range(1, 60)] + [(1, 2, 1, 2)], "p long, q long, a long, b long")
    assert sorted((x.a, x.b) for x in near_dedup.verified(pairs, texts, 0.8).collect()) == sorted([(0, i) for i in range(1, 60)] + [(1, 2)])


def test_class_lm(spark, docs):
    clash = docs.selectExpr("*", "1 as ids", "2 as held_out", "3 as row", "'x' as word", "4 as score")
    out = {r.doc_id: r for r in class_lm.score(clash, *class_lm.fit(clash, frequent=50, own=20, buckets=8, classes=6)).collect()}
    count, words = Counter(), {}
    for i, t, *_ in corpus():
        words[i] = [*(t or "").encode().lower().split(), None]
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(words[i])
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        assert out[i].n_tokens == len(w) and out[i].n_known == sum(count[x] > 0 for x in w) and out[i].train_tokens == n
        assert math.isclose(out[i].base_score, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert out[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 1)
    assert class_lm.score(empty(spark), *class_lm.fit(empty(spark))).count() == 0


def test_class_lm_probabilities(spark, docs):
    """Behind every class, all known words, one unseen word of each class, and the end share the whole mass; no text is likelier than certain."""
    model, counts = class_lm.fit(docs, frequent=1000, own=20, buckets=8, classes=6)
    mass = np.zeros(6)
    for r in counts.collect():
        mass[model.unit_class[model.units[bytes(r.word)]]] += r.n + 0.5
    mass[1:] += 0.5
    mass[0] = model.counts[-1] + 0.5  # there is no unseen end
    assert np.allclose(10**model.transition @ (mass / 10**model.room), 1)
    texts = [(i, t) for i, t in enumerate(["", None, "a", "b a", "never seen", " ".join(WORDS), "w1", *(t for _, t, *_ in corpus())])]
    scored = class_lm.score(spark.createDataFrame(texts, "doc_id long, text string"), model, counts).collect()
    assert len(scored) == len(texts) and all(r.score < 0 for r in scored)
    many = spark.createDataFrame([(i, "") for i in range(1000)] + [(1000 + i, "a b") for i in range(10)], "doc_id long, text string")
    out = class_lm.fit_score(many).collect()
    assert max(r.score for r in out) <= 0 and min(r.score for r in out if r.doc_id < 1000) > -0.1


def test_class_lm_words_beyond_the_core(spark):
    """Words of one ending, but with unlike neighbours, have classes of their own; those that the driver doesn't hold too."""
    r = random.Random(6)
    rows = []
    for i in range(400):
        sides = [r.choice(["ax", "by"]) for _ in range(30)]
        rows.append((i, " ".join(f"{s[0]}{r.randrange(3)} " + (f"{s[1]}core" if r.random() < 0.5 else f"{s[1]}{r.randrange(40)}same") for s in sides)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kw = dict(frequent=20, own=8, buckets=8, classes=10)
    model, words = class_lm.fit(docs, **kw)
    of = {bytes(x.word).decode(): x["class"] for x in words.collect()}
    assert len(of) == 88 and not {c for w, c in of.items() if w[0] == "x"} & {c for w, c in of.items() if w[0] == "y"}
    # Places counted where they are read, or sent as they are: the same classes. (Frequent words are those of 20 places and more here.)
    counted = {bytes(x.word).decode(): (x.n, x["class"]) for x in class_lm.fit(docs, most=2, **kw | {"frequent": 60})[1].collect()}
    sent = {bytes(x.word).decode(): (x.n, x["class"]) for x in class_lm.fit(docs, most=10**9, **kw | {"frequent": 60})[1].collect()}
    assert counted == sent and {w: c for w, (_, c) in sent.items()} == of
    out = {x.doc_id: x.score for x in class_lm.fit_score(docs, **kw).collect()}
    again = {x.doc_id: x.score for x in class_lm.score(docs, model, words).collect()}
    count = {bytes(x.word).decode(): x.n for x in words.collect()}
    for i, t in rows:
        c = [0, *(of[w] for w in t.split()), 0]
        n = [*(count[w] for w in t.split()), model.counts[-1]]
        want = model.transition[c[:-1], c[1:]].sum() - model.room[c[1:]].sum() + np.log10(np.array(n) + 0.5).sum()
        assert math.isclose(out[i], want, rel_tol=1e-9) and math.isclose(again[i], want, rel_tol=1e-9)


def test_exchange_finds_classes():
    r, order = random.Random(2), np.zeros((21, 21))
    for _ in range(20_000):  # units 1-10 are followed by 11-20 and the other way round
        a = r.randint(1, 10)
        order[a, b := r.randint(11, 20)] += 1
        order[b, r.randint(1, 10)] += 1
    of = class_lm.exchange(order, 3)
    assert len(set(of[1:11])) == 1 and len(set(of[11:])) == 1 and of[1] != of[11]


def test_lexicon_has_no_rank_cap(spark):
    """Rare toxic words stay, however many entries and lexicon words are more frequent."""
    r = random.Random(8)
    rare = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}zz" for i in range(600)]
    toxic = [" ".join(r.choice(WORDS) for _ in range(10)) + f" {rare[i % 600]}" for i in range(4800)]
    clean = [" ".join(r.choice(WORDS) for _ in range(10)) for _ in range(48_000)]
    mined = toxicity.mine_lexicon(spark.createDataFrame([(x, 1) for x in toxic] + [(x, 0) for x in clean], "text string, toxic int"))
    assert set(mined) == set(rare)


def test_label_model_sees_all_combinations(spark):
    """Tasks' sums over every combination give what one place gives, and the rarest combinations weigh in."""
    r = random.Random(3)
    seen = Counter()
    for _ in range(4000):
        toxic = r.random() < 0.3
        seen["".join("t" if r.random() < (0.5 if toxic else 0.02) else "-" for _ in range(6)) + ("c" if not toxic and r.random() < 0.8 else "-")] += 1
    votes = spark.createDataFrame(list(seen.items()), "votes string, n long").repartition(3)
    here, tasks = toxicity.label_model(votes, 0.3), toxicity.label_model(votes, 0.3, most=5)
    top = toxicity.label_model(spark.createDataFrame(seen.most_common(5), "votes string, n long"), 0.3)
    assert all(np.allclose(a, b) for a, b in zip(here, tasks, strict=True)) and abs(here[2] - 0.3) < 0.03 and abs(top[2] - here[2]) > 0.03


def test_label_model_is_em(spark):
    """The label model against expectation maximisation written out row by row, without and with correlated voters."""
    r = random.Random(13)
    rows = []
    for _ in range(3000):
        toxic = r.random() < 0.25
        first = r.random() < (0.6 if toxic else 0.03)
        votes = [first, first if r.random() < 0.9 else not first, r.random() < (0.5 if toxic else 0.05)]
        rows.append("".join("-t"[v] for v in votes) + ("c" if not toxic and r.random() < 0.7 else "-"))
    seen = Counter(rows)
    rates, share, prior = toxicity.label_model(spark.createDataFrame(list(seen.items()), "votes string, n long"), 0.25)
    n, voters, kinds = len(rows), 4, "tc-"
    p, weight = 0.25, [1.0] * voters
    table = []
    for j in range(voters):
        t, c = (sum(x[j] == k for x in rows) / n for k in "tc")
        two = [[0.1 * t, c, 1.0], [min(0.5, 10 * t + 0.05), 0.1 * c, 0.5]]
        table.append([[(x + 1e-4) / sum(y + 1e-4 for y in row) for x in row] for row in two])
    for step in range(60):
        post = {}
        for x in seen:
            odds = math.log(p / (1 - p)) + sum(weight[j] * math.log(table[j][1][kinds.index(v)] / table[j][0][kinds.index(v)]) for j, v in enumerate(x))
            post[x] = 1 / (1 + math.exp(-odds))
        for j in range(voters):
            for y in (0, 1):
                of = [0.1 + sum(m * (post[x] if y else 1 - post[x]) for x, m in seen.items() if x[j] == k) for k in kinds]
                table[j][y] = [v / sum(of) for v in of]
        p = sum(m * post[x] for x, m in seen.items()) / n
        if step in (9, 29):
            together = np.zeros((voters, voters))
            for y in (0, 1):
                w = {x: m * (post[x] if y else 1 - post[x]) for x, m in seen.items()}
                total, z = sum(w.values()), {x: np.array([{"t": 1.0, "c": -1.0, "-": 0.0}[v] for v in x]) for x in seen}
                mean = sum(m * z[x] for x, m in w.items()) / total
                cov = sum(m * np.outer(z[x] - mean, z[x] - mean) for x, m in w.items()) / total
                d = np.sqrt(np.diag(cov))
                together += total / n * np.clip(cov / np.outer(np.maximum(d, 3e-5), np.maximum(d, 3e-5)), 0, 1)
            weight = [1 / (1 + sum(together[j, i] for i in range(voters) if i != j and together[j, i] > 0.1)) for j in range(voters)]
    assert abs(prior - p) < 1e-6 and np.allclose(share, weight, atol=1e-6) and min(share) < 0.9
    for j in range(voters):
        assert np.allclose(rates[j], table[j], atol=1e-6)


def test_logistic_reaches_the_minimum():
    """Gradients at the fitted weights vanish, and no step to either side lowers the loss."""
    r = np.random.default_rng(4)
    x = r.random((200, 5)) * (r.random((200, 5)) < 0.6)
    y = 1 / (1 + np.exp(-(x @ np.array([3.0, -2, 0, 1, 0.5]) - 1)))
    rows = [(np.flatnonzero(a).tolist(), a[a != 0].tolist()) for a in x]
    w, b = toxicity.logistic(rows, y, 5, steps=3000)
    loss = lambda w, b: float(np.mean(np.logaddexp(0, x @ w + b) - y * (x @ w + b)) + 0.5e-3 * (w @ w))
    at = loss(w, b)
    for d in np.eye(6) * 0.02:
        assert min(loss(w + d[:5], b + d[5]), loss(w - d[:5], b - d[5])) > at - 1e-7


def test_toxicity(spark):
    r = random.Random(4)
    rows, marks = [], []
    for i in range(900):
        toxic = r.random() < 0.3
        words = [r.choice(WORDS) for _ in range(60)]
        for _ in range(r.randint(2, 5) * toxic):
            words[r.randrange(60)] = r.choice(["scumbag", "idiotic", "vile", "hateful"]) + r.choice(["", "", "x"])
        rows.append((i, " ".join(words)))
        marks += [(i, int(toxic))] if r.random() < 0.7 else []
    rows += [(1000, None), (1001, ""), (None, "scumbag idiotic vile")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0.1D as score", "1 as _x")
    labels = spark.createDataFrame([*marks, (1000, 0), (5000, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = {x.doc_id: x for x in toxicity.score_toxicity(docs, model).collect()}
    truth = dict(marks)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i].predicted == truth[i] for i in held]) > 0.97
    assert out[None].predicted == 1 and out[1000].score == out[1001].score < 0.5 and all(0 <= x.score <= 1 for x in out.values())
    assert toxicity.drop_toxic(docs, model).count() == sum(not x.predicted for x in out.values())
    blank = toxicity.fit(docs, labels.limit(0))
    assert {x.score for x in toxicity.score_toxicity(docs, blank).collect()} == {0.0} and toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_ann(spark):
    import duckdb

    from tapewright.llm.queries import ORACLE_SQL

    g = np.random.default_rng(3)
    x = g.standard_normal((700, 24)).astype(np.float32)
    x[50:80] = x[50]
    as_list = lambda e: [float(v) for v in e]
    rows = [(i, as_list(e)) for i, e in enumerate(x)] + [(800, None), (820, [0.0] * 24), (840, [float("nan")] * 24), (860, [None] + [1.0] * 23), (None, [1.0] * 24), (900, []), (920, [float("inf")] * 24)]
    rows += [(3, as_list(x[3])), (40, as_list(x[41])), (40, as_list(x[40])), (1, [9.0] * 24)]  # ids that come again, with the same vector and with others
    rows += [(1000 + i, as_list(e)) for i, e in enumerate(g.standard_normal((30, 5)))]  # vectors of another length meet each other
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as row", "2 as e", "3 as score")
    embeddings = df.select("vec_id", "embedding").toPandas()  # noqa: F841
    want = sorted((q, r, v, round(s, 9)) for q, r, v, s in duckdb.sql(f"select query_id, rank, vec_id, score from ({ORACLE_SQL['op10_ann']})").fetchall())
    for kw in ({}, {"block": 100, "query_bytes": 3000}):
        assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(df, F.col("vec_id") % 20 == 0, **kw).collect()) == want
    # Queries from a table of their own have no row among the candidates.
    some = [(v, np.array(e)) for v, e in rows if v is not None and v < 700]
    score = sorted(((-sum(a * b for a, b in zip(e, x[9].astype(float), strict=True)), v) for v, e in some))[:5]
    got = [(r.vec_id, round(r.score, 9)) for r in ann.search(df.where("vec_id < 700"), df.where("vec_id = 9"), k=5).orderBy("rank").collect()]
    assert got == [(v, round(-s, 9)) for s, v in score] and 9 in dict(got)
    assert ann.search(df.limit(0), df.limit(0)).count() == 0 and ann.search(df.limit(0), F.col("vec_id") > 0).count() == 0
    assert ann.search(df.where("vec_id = 20"), F.lit(True)).count() == 0


def test_ann_codes_prune():
    """The bounds leave out most vectors, and none of the nearest."""
    g = np.random.default_rng(5)
    x = g.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n, ids = 100, np.arange(6000)
    best = ann.Best(ids[:n], ids[:n], ids[:n], x[:n], 20)
    for at in np.array_split(ids, 3):
        best.add(at, at, x[at], *ann.encode(x[at]))
    assert best.seen == 6000 * n and best.ranked / best.seen < 0.15
    for i in range(n):
        score = ann.inner_products(x, x[i])
        score[i] = -9
        assert best.found[i][1].tolist() == np.lexsort((ids, -score))[:20].tolist()


def test_fingerprints(spark, docs):
    rows = sorted(corpus(), key=lambda r: -1 if r[0] is None else r[0])
    out = {r.doc_id: r for r in fingerprints.compare_versions(docs).collect()}
    assert len(out) == len(rows)
    texts = [r[1] or "" for r in rows]
    for (i, *_), text, after in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        assert out[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and out[i].n_chars == len(text)
        a, b, c = (set(fingerprints.items(x).tolist()) for x in (text, changed, after))
        assert math.isclose(out[i].near_edited, len(a & b) / len(a | b) if a | b else 1.0) and math.isclose(out[i].near_next, len(a & c) / len(a | c) if a | c else 1.0)
    assert out[0].fingerprint == out[52].fingerprint == out[53].fingerprint
    assert fingerprints.decode(out[0].fingerprint)[0] == len(fingerprints.items(texts[1]))
    assert fingerprints.compare_versions(empty(spark)).count() == 0 and fingerprints.compare_versions(docs.where("doc_id = 5")).count() == 1


def test_fingerprints_of_scattered_and_repeated_ids(spark):
    """Ids over all 64 bits, one id with many texts, null ids and repeated rows; many blocks, clashing columns, and a long text."""
    from tapewright.llm.common import id_key as common_key

    r = random.Random(31)
    ids = [r.getrandbits(63) - 2**62 for _ in range(300)] + [5] * 200 + [None] * 60
    rows = [(i, prose(r.randint(0, 12), r) + f" t{n // 2}") for n, i in enumerate(ids)] + [(6, None), (6, None), (7, prose(20_000, r))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _block", "2 as _k", "'x' as fingerprint")
    texts = [(i, t or "") for i, t in rows]
    hashed = {t: x for t, x in spark.createDataFrame([(t,) for _, t in texts], "t string").select("t", F.xxhash64("t")).distinct().collect()}
    nulls = {x.text: x.k for x in df.where("doc_id is null").select("text", common_key("doc_id", "text").alias("k")).collect()}
    order = sorted(texts, key=lambda row: (nulls[row[1]] if row[0] is None else row[0], hashed[row[1]]))
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        want[i, hashlib.sha256(fingerprints.edited(t, after).encode()).hexdigest()] += 1
    out = fingerprints.with_next(df, block_rows=16)
    assert out.select("_block").distinct().count() > 20
    got = fingerprints.compare_versions(df).collect()
    assert Counter((x.doc_id, x.edited_sha256) for x in got) == want


def test_fingerprints_of_many_equal_rows(spark):
    """A third of the rows without id and text, another frequent row: as if each were walked, but no block or task holds a run of them."""
    rows = [(None, None)] * 4000 + [(5, "twice one two three")] * 1500 + [(i, prose(20, random.Random(i))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held, copies = fingerprints.repeated(df)
    assert held.count() == 3002 and sorted((r.doc_id is None, r.n) for r in copies.collect()) == [(False, 1499), (True, 3999)]
    blocks = [r.n for r in fingerprints.with_next(held).where("_own").groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(blocks) < 2 * sum(blocks) / len(blocks)
    out = fingerprints.compare_versions(df, at_once=100).collect()
    assert len(out) == len(rows)
    whole = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hash_of(spark, r[1]) if r[0] == 5 else 0))
    counts = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in out)
    want = Counter()
    for (i, text), (_, after) in zip(whole, whole[1:] + whole[:1]):
        text, after = text or "", after or ""
        n = len(text) // 4
        want[i, len(text), hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()] += 1
    assert Counter({k[:3]: 0 for k in counts}).keys() == want.keys() and all(sum(c for k, c in counts.items() if k[:3] == w) == n for w, n in want.items())
    fives = [r for r in out if r.doc_id == 5 and r.n_chars == 19]
    assert len(fives) == 1500 and sum(r.near_next == 1.0 for r in fives) >= 1499 and len({r.fingerprint for r in fives}) == 1


def hash_of(spark, text, known={}):
    if text not in known:
        known[text] = spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0]
    return known[text]


def test_sketches_have_the_size_of_the_difference(monkeypatch):
    cells, fill = [], fingerprints._fill
    monkeypatch.setattr(fingerprints, "_fill", lambda keys, n, *more: cells.append(n) or fill(keys, n, *more))
    keys = np.unique(np.random.default_rng(3).integers(0, 2**64, 2600, dtype=np.uint64, endpoint=False))
    mine, others, common = keys[::13], keys[1::13], np.delete(keys, np.concatenate([np.arange(0, len(keys), 13), np.arange(1, len(keys), 13)]))
    for pick in (keys >= 0, keys % np.uint64(4) != 0):  # of the second keys none is among those that sizes are told by
        only = [x[np.isin(x, keys[pick])] for x in (mine, others)]
        left, right = fingerprints.difference(*(np.sort(np.concatenate([common, x])) for x in only))
        assert set(left) == set(only[0]) and set(right) == set(only[1])
        if pick.all():
            assert sum(cells) <= 2 * 4 * (len(mine) + len(others)), cells


def test_peeling_recovers_both_sides():
    g = np.random.default_rng(1)
    for n in (0, 1, 30, 3000):
        common, a, b = (np.unique(g.integers(0, 2**63, k).astype(np.uint64)) for k in (2000, n, n // 2))
        left, right = fingerprints.difference(np.concatenate([common, a]), np.concatenate([common, b]))
        assert sorted(left) == sorted(a) and sorted(right) == sorted(b)


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there\nhow are you\n\nSecond para"), (1, 1, "a", "unrelated"), (1, 2, "u", "> Hello  there\n> how are YOU\nfine"),
        (1, 3, "a", "> > hello there\n> > how are you\n> fine\nok good\n> not known"), (1, 4, "u", "> unrelated\nyes"), (1, 5, "a", None), (2, 0, "u", "> self"),
        (None, None, None, "lost"), (None, 1, "u", ">lost\nfound"), (3, 1, "u", "same"), (3, 1, "u", "same"), (3, 2, "u", "> same\n"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as position", "2 as _c")
    out = chat_quotes.link_conversations(df).orderBy("conv_id", "position").collect()
    got = [(r.conv_id, r.turn, r.clean_text, r.n_quotes, r.n_linked, r.parent_turn, r.root_turn, r.reply_depth, r.position) for r in out]
    assert got == [
        (None, None, "lost", 0, 0, None, None, 0, 0), (None, 1, "found", 1, 1, None, None, 1, 1),
        (1, 0, "Hello there\nhow are you\n\nSecond para", 0, 0, None, 0, 0, 0), (1, 2, "fine", 1, 1, 0, 0, 1, 1), (1, 3, "ok good", 3, 2, 2, 0, 2, 2),
        (1, 1, "unrelated", 0, 0, None, 1, 0, 3), (1, 4, "yes", 1, 1, 1, 1, 1, 4), (1, 5, "", 0, 0, None, 5, 0, 5), (2, 0, "", 1, 0, None, 0, 0, 0),
        (3, 1, "same", 0, 0, None, 1, 0, 0), (3, 1, "same", 0, 0, None, 1, 0, 1), (3, 2, "", 1, 1, 1, 1, 1, 2),
    ]
    # The SQL that the query is compared with, on rows that quote.
    import duckdb

    from tapewright.llm.queries import ORACLE_SQL

    conversations = spark.createDataFrame([r for r in rows if None not in r[:2]], "conv_id long, turn long, role string, text string").toPandas()  # noqa: F841
    names = ["conv_id", "turn", "clean_text", "n_quotes", "n_linked", "parent_turn", "root_turn", "reply_depth", "position"]
    asked = duckdb.sql(f"select {', '.join(names)} from ({ORACLE_SQL['op1_chat_quotes']}) order by conv_id, position").fetchall()
    assert asked == got[2:]
    chain = spark.createDataFrame([(1, i, "u", f"m{i}" if not i else f"> m{i - 1}\nm{i}") for i in range(40)], "conv_id long, turn long, role string, text string")
    assert [r.reply_depth for r in chat_quotes.link_conversations(chain).orderBy("position").collect()] == list(range(40))
    assert chat_quotes.link_conversations(df.limit(0)).count() == 0


def test_quotes_of_many_marks(spark):
    """A line may begin with 100,000 marks."""
    n = 100_000
    rows = [(1, 0, "u", "word"), (1, 1, "a", ">" * n + " word"), (1, 2, "u", "> " * n), (1, 3, "a", "> > >\nown"), (1, 4, "u", " >" * n + "    > word"), (1, 5, "u", "x " * n)]
    out = chat_quotes.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [(r.clean_text, r.n_quotes, r.n_linked) for r in out][:5] == [("word", 0, 0), ("", 1, 1), ("", 1, 0), ("own", 1, 0), ("", 1, 0)] and out[5].clean_text == "x " * n


def test_quoted_replies_against_sql(spark):
    """Some thousand replies: nested, reflowed, partial, forwarded and altered quotes, repeated turns and turns without a number."""
    import duckdb

    from tapewright.llm.queries import ORACLE_SQL

    r, rows = random.Random(21), []
    for conv in range(220):
        texts = []
        for turn in range(r.randint(1, 18)):
            own = "\n".join(prose(r.randint(1, 9), r) for _ in range(r.randint(1, 4)))
            body = own
            if texts and r.random() < 0.8:
                quoted = r.choice(texts[-4:]).split("\n")
                how = r.random()
                if how < 0.25:  # a part
                    at = r.randrange(len(quoted))
                    quoted = quoted[at : at + r.randint(1, 3)]
                elif how < 0.4:  # other line breaks and case
                    words = " ".join(quoted).upper().split(" ")
                    quoted = [" ".join(words[i : i + 4]) for i in range(0, len(words), 4)]
                elif how < 0.5:  # altered
                    quoted[r.randrange(len(quoted))] = "altered " + prose(2, r)
                mark = r.choice(["> ", ">", " > ", "  >\t"])
                body = "\n".join(mark + x for x in quoted) + r.choice(["\n", "\n\n"]) + own
                if r.random() < 0.2:
                    body = own + "\n" + body + "\n> " + r.choice(texts).split("\n")[0]
            texts.append(body)
            rows.append((conv, turn, r.choice("ua"), body))
            if r.random() < 0.03:
                rows.append((conv, turn, "z", body))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_quotes.link_conversations(df).orderBy("conv_id", "position")
    conversations = df.toPandas()  # noqa: F841
    names = got.columns
    asked = duckdb.sql(f"select {', '.join(names)} from ({ORACLE_SQL['op1_chat_quotes']}) order by conv_id, position").fetchall()
    found = [tuple(x) for x in got.collect()]
    assert len(rows) > 1500 and sum(x[names.index("n_linked")] for x in found) > 1500 and max(x[names.index("reply_depth")] for x in found) > 5
    assert found == asked


def test_ranks_of_scattered_ids_and_equal_rows(spark):
    """Ids over all 64 bits, nulls and many equal rows: gapless ranks, and no range holds most rows."""
    from tapewright.llm import common

    r = random.Random(2)
    rows = [(r.choice("ab"), r.choice([None, 7, r.getrandbits(63) - r.getrandbits(63)])) for _ in range(4000)]
    df = common.materialize(spark.createDataFrame(rows, "g string, id long").repartition(4))
    for keys in ([], ["g"]):
        out = common.ranked(df, keys, ["id"]).collect()
        groups = defaultdict(list)
        for x in out:
            groups[x.g if keys else 0].append((x["rank"], x.id is not None, x.id or 0))
        for g in groups.values():
            assert [x[0] for x in sorted(g)] == list(range(len(g))) and [x[1:] for x in sorted(g)] == sorted(x[1:] for x in g)
    table = df.groupBy("id").agg(F.count("*").alias("n"), F.min("g").alias("least")).where("id is not null")
    one = common.join_hot(df, table, ["id"], "n", 5).groupBy("least").count().collect()
    assert {tuple(x) for x in one} == {tuple(x) for x in df.join(table, "id").groupBy("least").count().collect()}


def test_pipeline(spark, docs, tmp_path):
    """Null ids, copies, empty and long texts, an extra column that clashes: the documents that brute force keeps, whole, in token ids."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline as pipeline

    docs.selectExpr("*", "1 as position", "2 as _k", "3 as score").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    packed = pipeline.run(spark, str(tmp_path)).collect()
    texts = brute_lines(sorted(((i, t) for i, t, *_ in corpus()), key=lambda r: -1 if r[0] is None else r[0]))
    lost = texts.pop(None)
    keep = {i: texts[i] for i in set(brute_classes(list(texts.items())).values())} | {None: lost}
    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in packed:
        pieces[r.doc_id][r.piece] = r.ids
        sequences[r.sequence_id].append((r.offset, len(r.ids)))
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert {i: [x for p in sorted(v) for x in v[p]] for i, v in pieces.items()} == {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in keep.items()}
    for at in sequences.values():
        assert [o for o, _ in sorted(at)] == [sum(n for _, n in sorted(at)[:i]) for i in range(len(at))] and sum(n for _, n in at) <= 4096


def test_pipeline_without_rows(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipeline

    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_sequences_follow_the_mix(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows = [(i, f"alone{i} " + prose(30, random.Random(i)), "en", "a" if i < 90 else "b", 0) for i in range(100)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    mixed = pipeline.mix_stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    position = {r.doc_id: r.position for r in mixed.collect()}
    assert [d for d, _ in sorted(position.items(), key=lambda x: x[1])] != sorted(position)
    packed = pipeline.pack_stage(spark, mixed, str(tmp_path)).collect()
    by_length, least = defaultdict(list), {}
    for r in packed:
        by_length[r.length].append((position[r.doc_id], r.sequence_id, r.doc_id))
        least[r.sequence_id] = min(least.get(r.sequence_id, 10**9), position[r.doc_id])
    assert sorted(least) == list(range(len(least))) and [least[s] for s in sorted(least)] == sorted(least.values())
    turned = pipeline.pack_stage(spark, mixed.selectExpr("doc_id", "text", "99 - position as position"), str(tmp_path)).collect()
    assert {(r.doc_id, r.sequence_id, r.offset) for r in turned} != {(r.doc_id, r.sequence_id, r.offset) for r in packed}
    for v in by_length.values():  # one sequence holds them all here: places of a length go up with position
        at = {r.doc_id: (r.sequence_id, r.offset) for r in packed}
        assert [at[d] for _, _, d in sorted(v)] == sorted(at[d] for *_, d in v)
