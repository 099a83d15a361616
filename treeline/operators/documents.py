"""Operators on whole documents, run in Arrow batches: inclusion, grammar validation."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.schema import BUILT_IN

XI = "{http://www.w3.org/2001/XInclude}"


class IncludeError(ValueError):
    """An inclusion that fails and has no fallback."""


class LoopError(IncludeError):
    """A document that includes itself: no fallback helps."""


def include(name: str, library: dict[str, str], depth: int = 40, path: tuple[str, ...] = ()) -> ElementTree.Element:
    """A document with its xi:include elements replaced: by the target's root, by text, or by the fallback's content."""
    if name in path:
        raise LoopError(f"{name} includes itself")
    if len(path) > depth:
        raise IncludeError("too deep")
    if name not in library:
        raise IncludeError(f"{name} is missing")
    root = ElementTree.fromstring(library[name])

    def expand(parent: ElementTree.Element) -> None:
        k = 0
        while k < len(parent):
            child = parent[k]
            if child.tag != XI + "include":
                expand(child)
                k += 1
                continue
            href, tail = child.get("href", ""), child.tail or ""
            new: list[ElementTree.Element] = []
            text = ""
            try:
                if child.get("parse") == "text":
                    if href not in library:
                        raise IncludeError(f"{href} is missing")
                    text = library[href]
                else:
                    new = [include(href, library, depth, (*path, name))]
            except (IncludeError, ElementTree.ParseError) as e:
                fallback = child.find(XI + "fallback")
                if fallback is None or isinstance(e, LoopError):
                    raise
                expand(fallback)
                text, new = fallback.text or "", list(fallback)
            parent.remove(child)
            for n, e in enumerate(new):
                parent.insert(k + n, e)
            if text or not new:
                text += tail
                if k:
                    parent[k - 1].tail = (parent[k - 1].tail or "") + text
                else:
                    parent.text = (parent.text or "") + text
            else:
                new[-1].tail = (new[-1].tail or "") + tail
            k += len(new)

    expand(root)
    return root


def typed(name: str, text: str) -> bool:
    """Whether a text is a value of a built-in type."""
    try:
        BUILT_IN[name](" ".join(text.split()))
    except (ValueError, ArithmeticError):
        return False
    return True


def names(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


class Grammar:
    """A grammar of patterns: validation by derivatives-like matching of children and attributes.

    Patterns: ``("empty",) ("text",) ("value", s) ("data", regex) ("type", name) ("ref", n)
    ("element", name, p) ("attribute", name, p) ("group", p, q) ("choice", p, q)
    ("interleave", p, q) ("many", p) ("optional", p)``.
    """

    def __init__(self, start: tuple, defines: dict[str, tuple] | None = None):
        self.start, self.defines = start, defines or {}
        self.check(start, ())
        for p in self.defines.values():
            self.check(p, ())

    def check(self, p: tuple, refs: tuple) -> None:
        """References must not come back to themselves without an element between."""
        if p[0] == "ref":
            if p[1] not in self.defines:
                raise ValueError(f"undefined {p[1]}")
            if p[1] in refs:
                raise ValueError(f"{p[1]} refers to itself")
            self.check(self.defines[p[1]], (*refs, p[1]))
        elif p[0] == "type":
            if p[1] not in BUILT_IN:
                raise ValueError(f"no type {p[1]}")
        elif p[0] not in ("element", "attribute", "value", "data"):
            for q in p[1:]:
                self.check(q, refs)

    def valid(self, text: str | None) -> bool:
        try:
            root = ElementTree.fromstring(text or "")
        except ElementTree.ParseError:
            return False
        return any(not rest[0] and not rest[1] for rest in self.match(self.start, ((("e", root),), frozenset())))

    def content(self, e: ElementTree.Element) -> tuple:
        items: list = [("t", e.text)] if e.text and e.text.strip() else []
        for c in e:
            items.append(("e", c))
            if c.tail and c.tail.strip():
                items.append(("t", c.tail))
        return tuple(items)

    def match(self, p: tuple, state: tuple) -> set:
        """States ``(items left, attributes left)`` after a pattern has taken its part."""
        import re

        items, attrs = state
        kind = p[0]
        if kind == "empty":
            return {state}
        if kind == "text":
            return {state, (items[1:], attrs)} if items and items[0][0] == "t" else {state}
        if kind in ("value", "data", "type"):
            said = items[0][1].strip() if items and items[0][0] == "t" else ""
            ok = said == p[1] if kind == "value" else typed(p[1], said) if kind == "type" else re.fullmatch(p[1], said) is not None
            return {(items[1:] if items and items[0][0] == "t" else items, attrs)} if ok else set()
        if kind == "ref":
            return self.match(self.defines[p[1]], state)
        if kind == "element":
            if not items or items[0][0] != "e" or p[1] not in ("*", names(items[0][1])):
                return set()
            e = items[0][1]
            inner = self.match(p[2], (self.content(e), frozenset(e.attrib.items())))
            return {(items[1:], attrs)} if any(not i and not a for i, a in inner) else set()
        if kind == "attribute":
            found = [(k, v) for k, v in attrs if k == p[1]]
            return {(items, attrs - {found[0]})} if found and any(not i for i, _ in self.match(p[2], ((("t", found[0][1]),), frozenset()))) else set()
        if kind == "group":
            return {s for mid in self.match(p[1], state) for s in self.match(p[2], mid)}
        if kind == "choice":
            return self.match(p[1], state) | self.match(p[2], state)
        if kind == "optional":
            return {state} | self.match(p[1], state)
        if kind == "interleave":
            # The second pattern's elements may lie anywhere among the first's.
            out = set()
            for pick in self.subsets(items, p[1]):
                rest = tuple(x for k, x in enumerate(items) if k not in pick)
                for left, a in self.match(p[1], (tuple(items[k] for k in sorted(pick)), attrs)):
                    if not left:
                        out |= self.match(p[2], (rest, a))
            return out
        done, fresh = {state}, {state}
        while fresh:
            fresh = {s for f in fresh for s in self.match(p[1], f)} - done
            done |= fresh
        return done

    def heads(self, p: tuple) -> set:
        if p[0] == "element":
            return {p[1]}
        if p[0] == "ref":
            return self.heads(self.defines[p[1]])
        return set().union(*(self.heads(q) for q in p[1:] if isinstance(q, tuple))) if p[0] != "attribute" else set()

    def subsets(self, items: tuple, p: tuple) -> Iterator[set]:
        """Interleaved patterns have different element names, so each item belongs to one side."""
        own = self.heads(p)
        yield {k for k, (kind, e) in enumerate(items) if kind == "e" and names(e) in own}

    def potential(self, p: tuple | None = None) -> set:
        """Names of elements that a pattern's content may begin with or hold."""
        return self.heads(p or self.start)


def validate(df: DataFrame, grammar: Grammar) -> DataFrame:
    """``doc_id, valid`` of ``df(doc_id, text)``."""
    schema = pa.schema([("doc_id", pa.int64()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([grammar.valid(t) for t in b.column(1).to_pylist()])], schema=schema)

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, valid boolean")


def deterministic(transitions: list[tuple[int, str | None, int]], start: int) -> bool:
    """Whether an automaton has at most one way to go for each token, empty transitions followed."""
    follow: dict[int, set[int]] = {}

    def reach(s: int) -> set[int]:
        if s not in follow:
            follow[s] = {s}
            todo = [s]
            while todo:
                x = todo.pop()
                for a, token, b in transitions:
                    if a == x and token is None and b not in follow[s]:
                        follow[s].add(b)
                        todo.append(b)
        return follow[s]

    states = {start} | {a for a, _, _ in transitions} | {b for _, _, b in transitions}
    for s in states:
        ways: dict[str, set[tuple[int, int]]] = {}
        for x in reach(s):
            for a, token, b in transitions:
                if a == x and token is not None:
                    ways.setdefault(token, set()).add((a, b))
        if any(len({b for _, b in w}) > 1 for w in ways.values()):
            return False
    return True
