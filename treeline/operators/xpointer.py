"""Pointers into documents, and fragments parsed in the place that a pointer names.

A pointer is a bare id, a child sequence (``/1/2``), or parts ``scheme(data)`` of which
the first that finds elements counts: ``element()`` with an id and child sequence,
``xpointer()`` and ``xpath1()`` with paths of names, positions and attribute tests, and
``xmlns()``, which binds a prefix for the parts behind it. Other schemes are skipped.

Defined cases: a null text or pointer, or a text that is not well-formed, finds
nothing, and says so; a fragment that is not well-formed in its place is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.sources.markup import XmlReader

XML = "http://www.w3.org/XML/1998/namespace"
#: Parts of a pointer; round brackets pair, or are escaped by a circumflex.
PART = re.compile(r"([\w:.-]+)\(((?:[^()^]|\^.|\((?:[^()]|\([^()]*\))*\))*)\)").findall


class Place:
    """An element: where its text begins and ends, the namespaces in scope, its attributes, its children."""

    __slots__ = ("attributes", "begin", "children", "element", "end", "inner", "scope", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], begin: int, scope: dict[str, str], element: ElementTree.Element):
        self.tag, self.attributes, self.begin, self.scope, self.element = tag, attributes, begin, scope, element
        self.end, self.inner, self.children = begin, (begin, begin), []


class Outline:
    """A document's elements with their places in its bytes."""

    def __init__(self, text: str):
        self.data = text.encode()
        self.root: Place | None = None
        self.open: list[Place] = []
        self.scope: list[dict[str, str]] = [{}]
        self.fresh: dict[str, str] = {}
        self.places: list[Place] = []
        self.of: dict[ElementTree.Element, Place] = {}
        p = self.parser = expat.ParserCreate(namespace_separator="}")
        p.StartElementHandler, p.EndElementHandler = self.start, self.stop
        p.StartNamespaceDeclHandler = lambda prefix, uri: self.fresh.__setitem__(prefix or "", uri or "")
        p.Parse(self.data, True)

    def start(self, name: str, attributes: dict[str, str]) -> None:
        tag = "{" + name if "}" in name else name
        element = ElementTree.Element(tag, {("{" + k if "}" in k else k): v for k, v in attributes.items()})
        at = Place(tag, attributes, self.parser.CurrentByteIndex, self.scope[-1] | self.fresh, element)
        self.of[element] = at
        self.scope.append(at.scope)
        self.fresh = {}
        if self.open:
            self.open[-1].children.append(at)
            self.open[-1].element.append(element)
        else:
            self.root = at
        at.inner = (self.tag_end(at.begin), 0)
        self.places.append(at)
        self.open.append(at)

    def stop(self, _: str) -> None:
        at, here = self.open.pop(), self.parser.CurrentByteIndex
        self.scope.pop()
        closed = self.data[at.inner[0] - 2 : at.inner[0]] != b"/>"
        at.inner = (at.inner[0], here if closed else at.inner[0])
        at.end = self.data.index(b">", here) + 1 if closed else at.inner[0]

    def tag_end(self, at: int) -> int:
        """Behind the start tag at ``at``; a ``>`` inside quotes ends none."""
        return re.compile(rb"""<(?:[^"'>]|"[^"]*"|'[^']*')*>""").match(self.data, at).end()

    @staticmethod
    def wrapped(scope: dict[str, str], inner: str) -> str:
        """A text below an element with the namespaces of a scope."""
        return "<w" + "".join(f" xmlns{':' * bool(k)}{k}={quoteattr(v)}" for k, v in sorted(scope.items()) if k != "xml" and (k or v)) + f">{inner}</w>"

    def found(self, pointer: str) -> tuple[int | None, list[Place]]:
        """Which part of a pointer is the first that finds elements, and these; bindings of prefixes hold for the parts behind them."""
        if re.fullmatch(r"(/[0-9]+)+", pointer):
            pointer = f"element({pointer})"
        if re.fullmatch(r"[^\s()]+", pointer):
            got = self.identified(pointer)
            return (0 if got else None), got
        spaces: dict[str, str] = {}
        for k, (scheme, data) in enumerate(PART(pointer)):
            data = re.sub(r"\^(.)", r"\1", data)
            if scheme == "xmlns":
                prefix, _, uri = data.partition("=")
                spaces[prefix.strip()] = uri.strip()
                continue
            got = self.sequence(data) if scheme == "element" else self.path(data, spaces) if scheme in ("xpointer", "xpath1") else []
            if got:
                return k, got
        return None, []

    def identified(self, name: str) -> list[Place]:
        return [p for p in self.of.values() if name in (p.attributes.get("id"), p.attributes.get(f"{XML}}}id"))][:1]

    def sequence(self, data: str) -> list[Place]:
        first, *steps = data.split("/")
        if not all(s.isdigit() for s in steps):
            return []
        if first:
            now = self.identified(first)
        else:
            now, steps = ([self.root] if steps[:1] == ["1"] else []), steps[1:]
        for s in steps:
            now = [p.children[int(s) - 1] for p in now if 0 < int(s) <= len(p.children)]
        return now

    def path(self, data: str, spaces: dict[str, str]) -> list[Place]:
        above = ElementTree.Element("")
        above.append(self.root.element)
        try:
            return [self.of[e] for e in above.findall("." + data, spaces)] if data.startswith("/") else []
        except (SyntaxError, KeyError):
            return []


def resolve(df: DataFrame) -> DataFrame:
    """``doc_id, part, n_found, value, error`` of ``df(doc_id, text, pointer)``: which part of the pointer found elements, how many, and the first one's text."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("n_found", pa.int32()), ("value", pa.string()), ("error", pa.string())])

    def one(doc_id: int, text: str | None, pointer: str | None) -> tuple:
        try:
            part, found = Outline(text or "").found(pointer or "")
        except expat.ExpatError:
            return doc_id, None, 0, None, "not well-formed"
        if not found:
            return doc_id, None, 0, None, "nothing found"
        inner = found[0]
        return doc_id, part, len(found), "".join(ElementTree.fromstring(Outline.wrapped(inner.scope, text.encode()[inner.begin : inner.end].decode())).itertext()), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return df.select(F.col("doc_id").cast("long"), "text", "pointer").mapInArrow(run, "doc_id long, part int, n_found int, value string, error string")


def fragments(df: DataFrame) -> DataFrame:
    """``doc_id, pre, level, parent, kind, ns, name, value, error`` of ``df(doc_id, text, pointer, fragment)``.

    The nodes of each fragment as they would hang below the element that the
    pointer names, with the namespaces in its scope; ``pre`` counts within the
    fragment and ``parent`` is null at its top. A fragment that can't be parsed
    there has one row with the error.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("pre", pa.int64()), ("level", pa.int32()), ("parent", pa.int64()), ("kind", pa.string()), ("ns", pa.string()), ("name", pa.string()), ("value", pa.string()), ("error", pa.string())])

    def one(doc_id: int, text: str | None, pointer: str | None, fragment: str | None) -> list[tuple]:
        try:
            _, found = Outline(text or "").found(pointer or "")
        except expat.ExpatError:
            return [(doc_id, *[None] * 7, "not well-formed")]
        if not found:
            return [(doc_id, *[None] * 7, "nothing found")]
        reader = XmlReader(doc_id)
        reader.feed(Outline.wrapped(found[0].scope, fragment or ""))
        rows = reader.close()
        if reader.tree.errors:
            return [(doc_id, *[None] * 7, f"fragment: {reader.tree.errors[0][2]}")]
        # The document, the wrapper and its namespaces are taken off.
        top = next((k for k, r in enumerate(rows) if r[3] == 2 and r[5] != "ns"), len(rows))
        return [(doc_id, r[1] - top, r[3] - 2, r[4] - top if r[4] >= top else None, r[5], r[6], r[8], r[9], None) for r in rows[top:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row for r in zip(*(c.to_pylist() for c in b.columns), strict=True) for row in one(*r)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    ddl = "doc_id long, pre long, level int, parent long, kind string, ns string, name string, value string, error string"
    return df.select(F.col("doc_id").cast("long"), "text", "pointer", "fragment").mapInArrow(run, ddl)
