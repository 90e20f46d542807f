"""YAML documents read and written by the tasks item by item, however long a document is.

Texts go to Python in pieces of at most ``PIECE`` characters, from which libyaml's parser reads as it needs them, and its events become plain values at once: no task holds a whole document or its
nodes, but the one item it is at. Values are those of PyYAML's safe loader.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.sources.scratch import text_batches

PIECE = 65_536
_STR, _VALUE = "tag:yaml.org,2002:str", "tag:yaml.org,2002:value"


def pieces(df: DataFrame, text: Column, *columns: str | Column) -> DataFrame:
    """``columns``, the number from 0 of a text's piece, and the piece: those of a text one after the other in one task. Empty and null texts have none."""
    return text_batches(df).select(*columns, F.posexplode(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("_at", "_piece"))


def by_text(batches: Iterator) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(columns, pieces) of each text of ``pieces``, whose batches are read as its pieces are."""
    n = 0

    def numbered() -> Iterator[tuple]:
        nonlocal n
        for batch in batches:
            *columns, at, piece = batch.columns
            for row in zip(*[c.to_pylist() for c in columns], at.to_pylist(), piece, strict=True):
                n += row[-2] == 0
                yield n, row[:-2], row[-1].as_py()

    for (_, columns), found in groupby(numbered(), lambda x: x[:2]):
        yield columns, (x[2] for x in found)


class _Source:
    """What a YAML parser reads from."""

    def __init__(self, parts: Iterator[str]):
        self.parts, self.first = parts, True

    def read(self, size: int = -1) -> str:
        for part in self.parts:
            part, self.first = part.removeprefix("﻿") if self.first else part, False
            if part:
                return part
        return ""


class _Values:
    """Values of the events of one document."""

    def __init__(self, parts: Iterator[str]):
        import yaml

        self.y, self.loader, self.anchors = yaml, getattr(yaml, "CSafeLoader", yaml.SafeLoader)(_Source(parts)), {}
        self.next = self.loader.get_event
        self.next()

    def root(self):
        """The first event of the document's value; None without a document."""
        if type(self.next()) is self.y.StreamEndEvent:
            return None
        return self.next()

    def end(self) -> None:
        self.next()
        if type(e := self.next()) is not self.y.StreamEndEvent:
            raise self.y.composer.ComposerError("expected a single document in the stream", None, "but found another document", e.start_mark)

    def plain(self, e) -> bool:
        """Whether a sequence is one without a name and a tag."""
        return type(e) is self.y.SequenceStartEvent and e.anchor is None and e.tag in (None, "!")

    def scalar(self, e, key: bool = False):
        node = self.y.ScalarNode
        tag = e.tag
        if tag is None or tag == "!":
            tag = self.loader.resolve(node, e.value, e.implicit) if e.implicit[0] else _STR
        if tag == _STR or key and tag == _VALUE:
            return e.value
        return self.loader.construct_document(node(tag, e.value, e.start_mark, e.end_mark))

    def name(self, e, value):
        if e.anchor is not None:
            if e.anchor in self.anchors:
                raise self.y.composer.ComposerError("found duplicate anchor", None, "second occurrence", e.start_mark)
            self.anchors[e.anchor] = value
        return value

    def value(self, e, key: bool = False):
        kind = type(e)
        if kind is self.y.ScalarEvent:
            return self.name(e, self.scalar(e, key))
        if kind is self.y.AliasEvent:
            if e.anchor not in self.anchors:
                raise self.y.composer.ComposerError(None, None, f"found undefined alias {e.anchor!r}", e.start_mark)
            return self.anchors[e.anchor]
        tag = None if e.tag in (None, "!", "tag:yaml.org,2002:seq", "tag:yaml.org,2002:map") else e.tag.removeprefix("tag:yaml.org,2002:")
        if kind is self.y.SequenceStartEvent:
            out = self.name(e, [])
            for x in self.items():
                out.append(x)
            if tag in ("omap", "pairs"):
                out[:] = [next(iter(x.items())) for x in out]
            elif tag:
                raise self.y.constructor.ConstructorError(None, None, f"could not determine a constructor for the tag {e.tag!r}", e.start_mark)
            return out
        if tag and tag != "set":
            raise self.y.constructor.ConstructorError(None, None, f"could not determine a constructor for the tag {e.tag!r}", e.start_mark)
        out = self.name(e, {} if tag is None else set())
        merged: dict = {}
        for k, first in self.keys(merged):
            if tag is None:
                out[k] = self.value(first)
            else:
                self.value(first)
                out.add(k)
        if merged:
            own = dict(out)
            out.clear()
            out.update(merged)
            out.update(own)
        return out

    def items(self) -> Iterator:
        while type(e := self.next()) is not self.y.SequenceEndEvent:
            yield self.value(e)

    def keys(self, merged: dict) -> Iterator[tuple]:
        """(key, first event of its value) of a mapping; what it merges goes to ``merged``, the first that has a key."""
        while type(k := self.next()) is not self.y.MappingEndEvent:
            if type(k) is self.y.ScalarEvent and k.value == "<<" and k.tag is None and k.implicit[0]:
                found = self.value(self.next())
                for m in found if isinstance(found, list) else [found]:
                    if not isinstance(m, dict):
                        raise self.y.constructor.ConstructorError("while constructing a mapping", k.start_mark, "expected a mapping or list of mappings for merging", k.end_mark)
                    for name, v in m.items():
                        merged.setdefault(name, v)
            else:
                yield self.value(k, True), self.next()


def items(parts: Iterator[str]) -> Iterator:
    """Items of a document that is a list, one by one; an empty document has none, another is an error."""
    doc = _Values(parts)
    if (e := doc.root()) is None:
        return
    if doc.plain(e):
        yield from doc.items()
    elif found := doc.value(e):
        if not isinstance(found, list):
            raise ValueError("the document must be a list")
        yield from found
    doc.end()


def sections(parts: Iterator[str]) -> Iterator[tuple]:
    """(key, value) of a document that is a mapping, in its order; lists are iterators over their items. An empty document has none, another and a key that is there twice are errors."""
    doc = _Values(parts)
    if (e := doc.root()) is None:
        return
    if type(e) is doc.y.MappingStartEvent and e.tag in (None, "!"):
        merged: dict = {}
        seen = set()
        for k, first in doc.keys(merged):
            if k in seen:
                raise ValueError(f"key {k!r} is there twice")
            seen.add(k)
            if doc.plain(first):
                found = doc.items()
                yield k, found
                for _ in found:
                    pass
            else:
                yield k, doc.value(first)
        yield from ((k, v) for k, v in merged.items() if k not in seen)
    elif doc.value(e):
        raise ValueError("the document must be a mapping")
    doc.end()


def dumper() -> Callable[[object], str]:
    """A function from a JSON value to a YAML list of it alone, as ``yaml.dump`` writes it in block style; events are written as they are made, without nodes."""
    import yaml

    base = getattr(yaml, "CSafeDumper", yaml.SafeDumper)
    scalars = yaml.SafeDumper(io.StringIO())
    seq, mapping = "tag:yaml.org,2002:seq", "tag:yaml.org,2002:map"

    @lru_cache(4096)
    def text(x: str) -> yaml.ScalarEvent:
        return yaml.ScalarEvent(None, _STR, (scalars.resolve(yaml.ScalarNode, x, (True, False)) == _STR, True), x)

    def events(x) -> Iterator:
        if isinstance(x, str):
            yield text(x) if len(x) < 100 else text.__wrapped__(x)
        elif isinstance(x, dict):
            yield yaml.MappingStartEvent(None, mapping, True, flow_style=False)
            for k, v in x.items():
                yield text(k)
                yield from events(v)
            yield yaml.MappingEndEvent()
        elif isinstance(x, list):
            yield yaml.SequenceStartEvent(None, seq, True, flow_style=False)
            for v in x:
                yield from events(v)
            yield yaml.SequenceEndEvent()
        else:
            node = scalars.represent_data(x)
            yield yaml.ScalarEvent(None, node.tag, (scalars.resolve(yaml.ScalarNode, node.value, (True, False)) == node.tag, False), node.value)

    def dump(x) -> str:
        out = io.StringIO()
        to = base(out, allow_unicode=True)
        for e in chain([yaml.StreamStartEvent(), yaml.DocumentStartEvent(explicit=False)], events([x]), [yaml.DocumentEndEvent(explicit=False), yaml.StreamEndEvent()]):
            to.emit(e)
        to.dispose()
        return out.getvalue().rstrip("\n")

    return dump
