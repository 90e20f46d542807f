"""Byte-level BPE: encoding by a lazily determinised transducer that is compiled from the merges, decoding by an incremental UTF-8 machine.

Merging always joins the pair of least rank, so a sequence of tokens is what merging makes of its bytes exactly if each two neighbours are what merging makes of
theirs. That gives a nondeterministic transducer: a branch holds the last token and the bytes read since, which must begin some token; where they are one that may
follow the last, a new branch starts behind it. For every prefix of the input one branch ends there. ``Transducer`` runs all branches at once: a state is the
tuple of (last token, bytes since, tokens not yet emitted) of the living ones, and a step emits what all agree on. How long a token waits is bounded by the
vocabulary, since no branch reads further than the longest token. States and steps are made when first met. A set number of them are kept: beyond it new ones serve once, and all are dropped
when too many are needed anew.

Text is split by the pattern first; each match is encoded separately, and a match that is a token is that token. The pattern's classes are those that
the tokenizer library knows, asked of it once on the driver (Unicode versions differ between libraries), and go to the tasks as ranges.

Decoding is incremental in its turn: ``Decoder`` takes ids in portions of any size and lets bytes go as soon as the characters they belong to are complete; bytes that can't
begin or continue a character go through as they are, and as U+FFFD in ``text``.

Defined cases: a null text is an empty one, which has no tokens; repeated rows and ids stand for themselves; null ids of documents stay null; an empty table
gives no rows; special tokens' strings are ordinary text; columns other than doc_id and text are not read. Texts are whole; a task holds one Arrow batch of them.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import text_batches

#: Ids of so many strings without spaces (in each of two generations), and so many states, are kept by a Python worker: some 140 and 700 bytes each.
CACHE, STATES = 300_000, 150_000
_loaded: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a vocabulary file: a base64 token and its rank on each line. The file lies on every machine; the driver's copy is read."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def ranges_of(kind: str) -> str:
    """What a class such as ``\\p{L}`` holds to the tokenizer library, as ranges for ``re``."""
    import tiktoken

    library = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    held = np.array([ord(c) for c in bytes(library.encode_ordinary(every)).decode()])
    starts = np.flatnonzero(np.diff(held, prepend=-2) != 1)
    ends = np.append(starts[1:], len(held)) - 1
    return "".join(f"\\U{held[a]:08x}-\\U{held[b]:08x}" for a, b in zip(starts, ends, strict=True))


def compiled(pattern: str) -> str:
    """``pattern`` for ``re``, its classes as the tokenizer library has them. Classes may stand inside brackets or alone."""
    made = {kind: ranges_of(kind) for kind in (r"\p{L}", r"\p{N}", r"\s") if kind in pattern or kind.upper() in pattern}
    out, inside = [], False
    for part in re.split(r"(\\p\{\w\}|\\.|\[\^?|\])", pattern):
        if part.startswith("["):
            inside = True
        elif part == "]":
            inside = False
        elif part in made:
            part = made[part] if inside else f"[{made[part]}]"
        elif part == r"\S" and not inside:
            part = f"[^{made[chr(92) + 's']}]"
        out.append(part)
    return "".join(out)


class State(dict):
    """byte -> (state, tokens emitted). branches: last token, node of the bytes since, tokens not yet emitted of each, one behind the other, the latest last."""

    __slots__ = ("branches",)

    def __init__(self, branches: tuple):
        self.branches = branches

    @property
    def rest(self) -> tuple:
        """What is left to emit where the input ends."""
        return self.branches[-1]


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.edges: dict[int, tuple] = {}
        self.pairs: dict[int, bool] = {}
        self.children: dict[int, int] = {}  # node and byte -> node; node 0 is that of no bytes
        self.token_at, self.inner, self.states = [-1], [True], {}
        for token, i in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                at = node << 8 | byte
                node = self.children.get(at)
                if node is None:
                    node = self.children[at] = len(self.inner)
                    self.token_at.append(-1)
                    self.inner.append(False)
            self.token_at[node] = i
        self.clear()

    def clear(self) -> None:
        for state in self.states.values():  # they may lead to one another in a circle
            state.clear()
        self.start = State((-1, 0, ()))
        self.states, self.missed = {self.start.branches: self.start}, 0
        self.waits: dict[tuple, tuple] = {}  # states share the tokens that wait in them

    def edge(self, token: int) -> tuple:
        """(sound, first, last) of a token: whether merging its bytes makes it, and the parts that begin and end it on the way, each with the rank of the merge that takes it in."""
        known = self.edges.get(token)
        if known is None:
            parts = [bytes((b,)) for b in self.tokens[token]]
            first, last, none = [], [], len(self.ranks)
            while len(parts) > 1:
                found = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
                least = min(found)
                if least == none:
                    break
                at = found.index(least)
                if at == 0:
                    first.append((parts[0], least))
                if at == len(parts) - 2:
                    last.append((parts[-1], least))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self.edges[token] = len(parts) == 1, (*first, (parts[0], none)), (*last, (parts[-1], none))
        return known

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand behind ``last`` (-1: at the start)."""
        pair = (last + 1) << 24 | token
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= 2 * STATES:
                self.pairs.clear()
            known = self.pairs[pair] = self._stands(last, token)
        return known

    def _stands(self, last: int, token: int) -> bool:
        """No merge across the border of the two comes before the merges that make them. The parts at the border grow as the ranks rise; of equal ranks the left merge comes first."""
        sound, first, _ = self.edge(token)
        if last < 0 or not sound:
            return sound
        end, ranks, i, j = self.edge(last)[2], self.ranks, 0, 0
        none = len(ranks)
        while True:
            (left, left_ends), (right, right_ends) = end[i], first[j]
            across = ranks.get(left + right, none)
            if across < left_ends and across <= right_ends and across < none:
                return False
            if left_ends == right_ends == none:
                return True
            if left_ends <= right_ends:
                i += 1
            else:
                j += 1

    def step(self, state: State, byte: int) -> tuple[State, tuple]:
        """Made when first met."""
        live, latest, child, token_at, inner = [], None, self.children.get, self.token_at, self.inner
        parts = iter(state.branches)
        for last, node, waiting in zip(parts, parts, parts):
            node = child(node << 8 | byte)
            if node is None:
                continue
            if latest is None and (token := token_at[node]) >= 0 and self.follows(last, token):
                latest = (token, 0, (*waiting, token))
            if inner[node]:
                live += last, node, waiting
        if latest is None:
            raise ValueError(f"byte {byte} is no token")
        live += latest
        out, agreed = live[-1], 0
        if live[2]:  # the oldest branch has something to emit
            agreed = min(map(len, live[2::3]))
            for waiting in live[2::3]:
                while waiting[:agreed] != out[:agreed]:
                    agreed -= 1
        if agreed:
            live[2::3] = [waiting[agreed:] for waiting in live[2::3]]
        branches = tuple(live)
        made = self.states.get(branches), out[:agreed]
        if made[0] is None:
            made = State(branches), made[1]
            if len(self.states) >= STATES:  # the first ones met are the frequent ones, and stay as long as they serve
                self.missed += 1
                if self.missed < 20 * STATES:
                    return made
                self.clear()
            live[2::3] = map(self.waits.setdefault, live[2::3], live[2::3])
            made[0].branches = branches = tuple(live)
            self.states[branches] = made[0]
        state[byte] = made
        return made

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Ids of the bytes of one match, each as soon as no later byte can change it."""
        state = self.start
        for byte in data:
            state, out = state.get(byte) or self.step(state, byte)
            yield from out
        yield from state.rest

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern, all at once."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        state, ids = self.start, []
        for byte in data:
            try:
                state, out = state[byte]
            except KeyError:
                state, out = self.step(state, byte)
            if out:
                ids += out
        ids += state.rest
        return ids


class Encoder(dict):
    """Texts to ids; as a dictionary, ids (four bytes each) of strings without spaces, with one before them. Of two generations the older goes when the younger is full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer, self.older = Transducer(ranks), {}
        self.matches = re.compile(pattern).findall
        self.apart = re.compile(r"\s \s").search

    def whole(self, text: str) -> bytes:
        found, encode = self.matches(text), self.transducer.encode
        ids = encode(found[0].encode()) if len(found) == 1 else [i for m in found for i in encode(m.encode())]
        return array("i", ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.whole(" " + word)
        if len(word) < 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of a text, four bytes each. No match reaches across a space but as its first character, or where the space has white space on both sides."""
        if self.apart(text):
            return self.whole(text)
        first, *others = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, others))


def _machine() -> list[list[int]]:
    """Next state by state and byte, -1 where a byte can't follow. 0: between characters; 1, 2, 3: so many bytes to come; 4 to 7: the next byte of a character is restricted."""
    steps = [[-1] * 256 for _ in range(8)]

    def put(state: int, first: int, last: int, after: int) -> None:
        steps[state][first : last + 1] = [after] * (last + 1 - first)

    put(0, 0x00, 0x7F, 0)
    put(0, 0xC2, 0xDF, 1)
    put(0, 0xE0, 0xEF, 2)
    put(0, 0xF0, 0xF4, 3)
    for state in (1, 2, 3):
        put(state, 0x80, 0xBF, state - 1)
    for state, lead, first, last in ((4, 0xE0, 0xA0, 0xBF), (5, 0xED, 0x80, 0x9F), (6, 0xF0, 0x90, 0xBF), (7, 0xF4, 0x80, 0x8F)):
        put(0, lead, lead, state)  # neither too long a form, nor a surrogate, nor beyond the last character
        put(state, first, last, 1 if state < 6 else 2)
    return steps


class Decoder:
    """Ids in, bytes of whole characters out; what is incomplete waits for the next portion."""

    steps = _machine()
    beyond = re.compile(rb"[\x80-\xff]+")

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.waiting, self.bad = tokens, b"", 0

    def feed(self, ids: Iterable[int]) -> bytes:
        data = self.waiting + b"".join(map(self.tokens.__getitem__, ids))
        first = 0  # of the character that has begun
        for run in self.beyond.finditer(data):  # other bytes are characters of their own
            state = 0
            for at in range(run.start(), run.end()):
                if not state:
                    first = at
                after = self.steps[state][data[at]]
                if after < 0 and state:  # the character is broken off, and the byte may begin another one
                    self.bad, first, after = self.bad + 1, at, self.steps[0][data[at]]
                if after < 0:
                    self.bad, after = self.bad + 1, 0
                state = after
            if state and run.end() == len(data):
                self.waiting = data[first:]
                return data[:first]
            self.bad += bool(state)
        self.waiting = b""
        return data

    def end(self) -> bytes:
        """What never got complete."""
        left, self.waiting, self.bad = self.waiting, b"", self.bad + bool(self.waiting)
        return left

    def parts(self, ids: np.ndarray, at_once: int = 65_536) -> Iterator[bytes]:
        for start in range(0, len(ids), at_once):
            yield self.feed(ids[start : start + at_once].tolist())
        yield self.end()

    def text(self, ids: Iterable[int]) -> str:
        return "".join(part.decode("utf-8", "replace") for part in self.parts(np.fromiter(ids, np.int64)))


def _of_worker(key: tuple, make):
    """One of its kind in each Python worker."""
    if key not in _loaded:
        _loaded.pop(next((k for k in _loaded if k[0] == key[0]), None), None)
        _loaded[key] = make()
    return _loaded[key]


def _encoder(shared, path: str, pattern: str) -> Encoder:
    gc.set_threshold(1_000_000)  # states stay, and looking through them again and again costs a fifth of the time
    return _of_worker(("encoder", path, pattern), lambda: Encoder(*shared.value))


def _texts(docs: DataFrame) -> DataFrame:
    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(path), compiled(pattern)))  # as large as the vocabulary
    kinds = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, path, pattern)
        for batch in batches:
            made = [encoder.ids(text.as_py() or "") for text in batch.column(1)]
            ends = np.cumsum([0] + [len(x) // 4 for x in made], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], schema=kinds)

    return _texts(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids are none, bytes that are no characters U+FFFD."""
    import pyarrow as pa

    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _of_worker(("decoder", path), lambda: {i: t for t, i in shared.value.items()})
        for batch in batches:
            texts = [Decoder(tokens).text(x.values.to_numpy()) if x.is_valid else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return text_batches(encoded).select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): documents encoded, and decoded from their ids alone, where the ids are made."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(path), compiled(pattern)))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, path, pattern)
        tokens = encoder.transducer.tokens
        decimals = _of_worker(("decimals", path), lambda: {i: b"%d" % i for i in tokens})
        for batch in batches:
            sizes, of_ids, of_bytes = [], [], []
            for text in batch.column(1):
                ids, held = np.frombuffer(encoder.ids(text.as_py() or ""), "<i4"), hashlib.sha256()
                for part in Decoder(tokens).parts(ids):
                    held.update(part)
                sizes.append(len(ids))
                of_ids.append(hashlib.sha256(b" ".join(map(decimals.__getitem__, ids.tolist()))).hexdigest())
                of_bytes.append(held.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names)

    return _texts(docs).mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
