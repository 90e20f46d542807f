"""Lexical search, vector codes and byte-level BPE against brute force and the tokenizer library."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import byte_bpe, lexical, vector_codes

DOCS = "doc_id long, text string"


# ---- lexical search


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m, score = 50 + 50 * n * n_docs // n_terms, 0
            for t in set(split(text)) & set(c):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k=50, schema=DOCS, **index):
    postings = lexical.index(spark.createDataFrame(docs, schema), **index)
    found = lexical.search(postings, spark.createDataFrame(items, "item_id long, text string"), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_search_equals_brute_force(spark):
    r = random.Random(3)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 80)))) for i in range(700)]
    docs += [(i, docs[5][1]) for i in range(700, 800)]  # copies: ties beyond k
    docs += [(None, docs[7][1]), (None, None), (7, docs[7][1]), (7, "other w1"), (900, ""), (901, "... !!"), (902, " ".join(r.choices(words, k=30_000)))]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 40)))) for i in range(25)] + [(3, docs[5][1]), (3, docs[5][1]), (None, "w1 w2"), (40, None), (41, ""), (42, "nowhere"), (43, "w1 W1 w1.W1")]
    for k in (1, 10, 50):
        assert searched(spark, docs, items, k, documents=64) == brute_search(docs, items, k)
    assert searched(spark, docs, items, 2000, documents=100_000) == brute_search(docs, items, 2000)


def test_search_terms(spark):
    text = "ÀB_aZ09-x y　Q\x85\x1cr Kİ naïve\U0001f600"  # only ASCII parts terms, only A-Z is folded
    assert [t.decode() for t in lexical.terms(text.encode())] == split(text)
    every = "".join(map(chr, [*range(0x300), 0x2028, 0x212A, 0xFFFD, 0x10FFFF]))
    assert [t.decode() for t in lexical.terms(every.encode())] == split(every)


def test_search_edges(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a b")], []) == []
    assert searched(spark, [(1, None), (2, " ")], [(1, "a")]) == []
    docs = spark.createDataFrame([(1, "a b", "x", 5, 6)], "doc_id long, text string, term string, segment int, places int")
    items = spark.createDataFrame([(1, "A", 2, "z")], "item_id long, text string, rank int, score string")
    assert [tuple(r)[:3] for r in lexical.rank_documents(docs, items).collect()] == [(1, 1, 1)]
    one = spark.createDataFrame([(i, f"t{i} common") for i in range(300)], DOCS)
    many = lexical.search(lexical.index(one, documents=20), spark.createDataFrame([(i, f"t{i}") for i in range(300)], "item_id long, text string"), query_bytes=2000)
    assert {(r.item_id, r.doc_id) for r in many.collect()} == {(i, i) for i in range(300)}  # in many turns


def test_search_stops_early_with_whole_scores():
    r = np.random.default_rng(1)
    size = 5000
    lists = []
    for n in (20, 400, 3000, 4500):
        places = np.sort(r.choice(size, n, replace=False))
        lists.append((int(10_000 / n) + 1, lexical.Postings(places, r.integers(1, 1_000_000, n))))
    exact = sum(w * p.of(np.arange(size)) for w, p in lists)
    for k in (1, 10, 100):
        places, scores, done, total = lexical.top(lists, size, k, steps=64)
        least = np.sort(exact)[-k]
        assert set(np.flatnonzero(exact >= least)) <= set(places) and (scores == exact[places]).all()
        assert done < total
    places, scores, done, total = lexical.top(lists, size, 10, reach=int(exact.max()))
    assert scores.tolist() == [exact.max()] and done <= total / 2


# ---- vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, label, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    w = len(kept[0][2]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for *_, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            at = [near(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at) if a == e]
                if mine:
                    books[p][e] = [sum(z) // len(mine) for z in zip(*mine)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, label, _), e in zip(kept, errors):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, by_label[label], sha) for (i, label, _), f, err in zip(kept, found, errors)), key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


def coded(spark, rows, schema=VECTORS):
    out = vector_codes.compress_and_sum(spark.createDataFrame(rows, schema))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_vector_codes_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(i * 3, [r.gauss(0, 0.1) for _ in range(8)], r.choice([None, 1, 1, 1, 2])) for i in range(330)]
    rows += [(r.randrange(900), [r.choice([-0.001, 0.0, 0.001]) for _ in range(8)], 7) for _ in range(60)]  # ties
    rows += [(5, rows[3][1], 1), (5, rows[3][1], 1), (None, rows[4][1], None), (1, None, 1), (2, [1.0] * 7 + [None], 1), (4, [float("nan")] + [0.0] * 7, 1), (8, [float("-inf")] * 8, 2)]
    r.shuffle(rows)
    assert coded(spark, rows) == brute_codes(rows)
    few = rows[:40]
    assert coded(spark, few) == brute_codes(few)


def test_vector_codes_screen_is_sound():
    r = np.random.default_rng(2)
    for scale in (3, 1000, 2**26):
        book = r.integers(-scale, scale + 1, (256, 16))
        x = np.concatenate([r.integers(-scale, scale + 1, (500, 16)), (book[:100] + book[100:200]) // 2])
        value, off = vector_codes.intervals(x, book)
        exact = [[sum(int(c) * int(c) - 2 * int(a) * int(c) for a, c in zip(row, entry)) for entry in book[:40]] for row in x[::25]]
        assert all(abs(float(value[i * 25, j]) - e) <= off[i * 25, j] for i, row in enumerate(exact) for j, e in enumerate(row))
        found, squares = vector_codes.nearest(x, book, 128)
        d = ((x[:, None, :] - book[None]) ** 2).sum(2)
        assert (found == d.argmin(1)).all() and (squares == d.min(1)).all()


def test_vector_codes_edges(spark):
    assert coded(spark, []) == [] and coded(spark, [(1, None, 2)]) == []
    mixed = coded(spark, [(1, [0.5] * 4, 1), (2, [0.5] * 8, 2), (3, [], None), (4, [3e38] * 4, 1)])
    assert [(x[0], x[1] is None, x[2] is None, x[3]) for x in mixed][1:3] == [(2, True, True, None), (3, True, True, None)]
    assert mixed[0][:3] == (1, "00000000", 0) and mixed[3][1:3] == ("01010101", 0)
    odd = coded(spark, [(i, [i / 10, 0.0, 1.0, -i / 7, 0.3], 1) for i in range(20)])  # four parts don't divide five components
    assert len(odd) == 20 and {x[2] for x in odd} == {0}
    extra = spark.createDataFrame([(1, [0.5] * 4, 1, "a", 2)], VECTORS + ", code string, _n int")
    assert vector_codes.compress_and_sum(extra).count() == 1
    with pytest.raises(ValueError):
        vector_codes.compress(extra, entries=257)


# ---- byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return path, P.PATTERN, library, byte_bpe.Encoder(ranks, byte_bpe.compiled(P.PATTERN))


def strings(tokens, n, seed):
    r = random.Random(seed)
    pools = [
        "ab ", "aA \n", "   \n\t\r", "éñü a", "0123456789 ", "'s're't x", "中文あ ", "\U0001f600‍️ ", ".,-=_*# ", " \x85　 a", "=", "a", " ", "\x1c\x1d a", "Kİſ ",
        [chr(c) for c in range(0x20, 0x2000)], [chr(r.randrange(0x10000, 0x110000)) for _ in range(2000)], tokens, [t for t in tokens if len(t) > 10],
    ]
    pools = [p for p in pools if p]
    for _ in range(n):
        yield "".join("".join(r.choice(pool) for _ in range(r.choice([1, 2, 5, 8, 30, 200]))) for pool in r.choices(pools, k=r.choice([1, 1, 2])))


def test_bpe_equals_the_library(bpe):
    *_, library, encoder = bpe
    tokens = [t.decode("utf-8", "ignore") for t in encoder.transducer.ranks]
    for text in strings(tokens, 4000, 1):
        assert np.frombuffer(encoder.ids(text), "<i4").tolist() == library.encode_ordinary(text), repr(text)


def test_bpe_classes_are_the_librarys(bpe):
    """Every code point, between letters, digits and spaces, whatever Unicode version other libraries have."""
    *_, library, encoder = bpe
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0 or 0x323B0 <= c < 0x33500 or 0x10D40 <= c < 0x11000)]
    text = "".join(f"a{chr(c)}1 " for c in every)
    assert np.frombuffer(encoder.ids(text), "<i4").tolist() == library.encode_ordinary(text)


def test_transducer_by_the_definition():
    """Any ranks over a small alphabet whose tokens are made by merges: against merging pair by pair."""
    for seed in range(60):
        r = random.Random(seed)
        tokens = [b"a", b"b", b"c"]
        while len(tokens) < 40:
            made = r.choice(tokens) + r.choice(tokens)
            if made not in tokens and len(made) < 12:
                tokens.append(made)
        machine = byte_bpe.Transducer({t: i for i, t in enumerate(tokens)})
        for _ in range(150):
            data = bytes(r.choice(b"abc") for _ in range(r.randint(1, 40)))
            parts = [data[i : i + 1] for i in range(len(data))]
            while True:
                found = [(machine.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in machine.ranks]
                if not found:
                    break
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert list(machine.stream(data)) == [machine.ranks[p] for p in parts], (seed, data)


def test_transducer_emits_before_the_end(bpe, monkeypatch):
    machine = bpe[3].transducer
    data = " internationalisation".encode() * 400
    given = 0
    state = machine.start
    for n, byte in enumerate(data, 1):
        state, out = state.get(byte) or machine.step(state, byte)
        given += sum(len(machine.tokens[i]) for i in out)
        assert n - given <= 128 + 64  # the longest token and what waits before it
    monkeypatch.setattr(byte_bpe, "STATES", 50)
    small = byte_bpe.Transducer(machine.ranks)
    for n in range(30):  # more misses than are borne
        assert list(small.stream(data[n:])) == list(machine.stream(data[n:])) and len(small.states) <= 50


def test_transducer_states_are_small_and_go(bpe):
    import gc
    import tracemalloc

    machine, r = byte_bpe.Transducer(bpe[3].transducer.ranks), random.Random(7)
    words = [(" " + "".join(r.choices(["th", "an", "ion", "er", "st", "ea", "ou", "nt"], k=r.randint(2, 9)))).encode() for _ in range(5000)]
    for word in words:  # tokens and pairs are met
        machine.encode(word)
    machine.clear()
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for word in words:
            machine.encode(word)
        states, held = len(machine.states), tracemalloc.get_traced_memory()[0]
        machine.clear()
        left = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
        gc.enable()
    assert states > 4000 and held < 750 * states and left < held / 2, (states, held / states, left / held)


def test_decoder_is_incremental(bpe):
    *_, library, encoder = bpe
    tokens = encoder.transducer.tokens
    r = random.Random(8)
    for _ in range(3000):
        ids = [r.choice([r.randrange(50256), r.randrange(94, 256), r.randrange(94, 256)]) for _ in range(r.randrange(14))]
        raw = b"".join(tokens[i] for i in ids)
        decoder, out, n = byte_bpe.Decoder(tokens), [], r.randint(1, 5)
        for a in range(0, len(ids), n):
            out.append(decoder.feed(ids[a : a + n]))
            assert len(decoder.waiting) < 4
        out.append(decoder.end())
        assert b"".join(out) == raw and "".join(p.decode("utf-8", "replace") for p in out) == raw.decode("utf-8", "replace") == library.decode(ids)
        try:
            raw.decode()
            assert decoder.bad == 0
        except UnicodeDecodeError:
            assert decoder.bad > 0


def test_bpe_documents(spark, bpe):
    path, pattern, library, encoder = bpe
    texts = [None, "", " ", "a", "x  y   z\n\n q ", "<|endoftext|> é", "word " * 20_000, "ñ" * 5000, " \n \t", "same", "same", *strings(["tok", "EN", "é"], 60, 9)]
    rows = [(i if i != 3 else None, t, 1, "x") for i, t in enumerate(texts)] + [(8, "again", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens string").repartition(3)
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    out = byte_bpe.round_trip(docs, path, pattern)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)
    encoded = byte_bpe.encode_documents(docs, path, pattern)
    back = byte_bpe.decode_documents(encoded, path)
    assert sorted((r.doc_id, r.text) for r in back.where("doc_id is not null").collect()) == sorted((i, t or "") for i, t, *_ in rows if i is not None)
    broken = spark.createDataFrame([(1, None), (2, []), (3, [library.encode_ordinary("é")[0], encoder.transducer.ranks[b"\xc3"]])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in byte_bpe.decode_documents(broken, path).collect()} == {1: "", 2: "", 3: "é�"}
    assert byte_bpe.round_trip(docs.limit(0), path, pattern).count() == 0
    other = spark.createDataFrame([(1, "Zebra naïve")], DOCS)
    assert byte_bpe.encode_documents(other.where(F.lit(True)), path.replace("byte_bpe_50k", "byte_bpe_multi_50k"), pattern).first().ids
    assert base64.b64decode(open(path, "rb").readline().split()[0]) in encoder.transducer.ranks
