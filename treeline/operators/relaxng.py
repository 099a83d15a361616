"""RelaxNG: a schema's XML form read and simplified, documents validated by derivatives while they are read.

A schema becomes a pattern with a table of element contents: grammars, combined
definitions, inclusions with overrides, external references and inherited
namespaces and type libraries are resolved on the driver, and the restrictions on
schemas are checked there. A document is a sequence of events; after each one the
pattern that the rest must match is the derivative of the one before, so only that
pattern and the names of open elements are held. Events come from a text fed in
pieces (:func:`validate`) or from the rows of a node table in document order
(:func:`validate_nodes`). The first event that nothing can follow is the error.

Defined cases: a null, empty or broken text is not well-formed; a document
without nodes has no row. White space alone between elements is no text.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.schema import BUILT_IN, FACETS, SchemaError, Simple
from treeline.sources.markup import split_name

RNG = "{http://relaxng.org/ns/structure/1.0}"
#: The library of XML Schema's types.
TYPES = "http://www.w3.org/2001/XMLSchema-datatypes"
#: Derivatives and patterns that a worker remembers from document to document.
MEMO = 200_000

BAD = pa.schema([("doc_id", pa.int64()), ("valid", pa.bool_()), ("error", pa.string())])
DDL = "doc_id long, valid boolean, error string"


class GrammarError(ValueError):
    """A schema that can't be read, or that breaks a restriction."""


# ---- classes of names: ("name", ns, local), ("any", except), ("ns", ns, except), ("or", a, b)


def contains(names: tuple | None, ns: str, local: str) -> bool:
    if names is None:
        return False
    kind = names[0]
    if kind == "name":
        return names[1:] == (ns, local)
    if kind == "or":
        return contains(names[1], ns, local) or contains(names[2], ns, local)
    return (kind == "any" or names[1] == ns) and not contains(names[-1], ns, local)


def witnesses(names: tuple | None) -> set[tuple[str, str]]:
    """Names that stand for all that a class tells apart."""
    if names is None:
        return set()
    if names[0] == "name":
        return {names[1:]}
    if names[0] == "or":
        return witnesses(names[1]) | witnesses(names[2])
    return {(names[1] if names[0] == "ns" else "\0", "\0")} | witnesses(names[-1])


def overlap(a: tuple, b: tuple) -> bool:
    return any(contains(a, *w) and contains(b, *w) for w in witnesses(a) | witnesses(b))


def endless(names: tuple) -> bool:
    return names[0] in ("any", "ns") or (names[0] == "or" and (endless(names[1]) or endless(names[2])))


# ---- patterns


class Pattern:
    """One of equal patterns; ``number`` tells them apart."""

    __slots__ = ("a", "b", "kind", "nullable", "number")

    def __init__(self, kind: str, a: object, b: object, nullable: bool, number: int):
        self.kind, self.a, self.b, self.nullable, self.number = kind, a, b, nullable, number


class Patterns:
    """Makes patterns, equal ones once."""

    def __init__(self) -> None:
        self.held: dict[tuple, Pattern] = {}
        self.none, self.empty, self.text = self.make("notAllowed"), self.make("empty"), self.make("text")

    def make(self, kind: str, a: object = None, b: object = None) -> Pattern:
        key = kind, a.number if isinstance(a, Pattern) else a, b.number if isinstance(b, Pattern) else b
        if key not in self.held:
            nullable = kind in ("empty", "text") or (kind == "choice" and (a.nullable or b.nullable)) or (kind in ("group", "interleave") and a.nullable and b.nullable) or (kind == "oneOrMore" and a.nullable)
            self.held[key] = Pattern(kind, a, b, nullable, len(self.held))
        return self.held[key]

    def choice(self, a: Pattern, b: Pattern) -> Pattern:
        """Alternatives as a list to the right without repeats, so that derivatives stay small."""
        if a is self.none or a is b:
            return b
        if b is self.none:
            return a
        if a.kind == "choice":
            return self.choice(a.a, self.choice(a.b, b))
        rest = b
        while rest.kind == "choice":
            if rest.a is a:
                return b
            rest = rest.b
        return b if rest is a else self.make("choice", a, b)

    def pair(self, kind: str, a: Pattern, b: Pattern) -> Pattern:
        """``group`` or ``interleave``."""
        if self.none in (a, b):
            return self.none
        return b if a is self.empty else a if b is self.empty else self.make(kind, a, b)

    def many(self, a: Pattern) -> Pattern:
        return a if a in (self.none, self.empty) else self.make("oneOrMore", a)

    def after(self, a: Pattern, b: Pattern) -> Pattern:
        return self.none if self.none in (a, b) else self.make("after", a, b)


# ---- schemas


class Scope:
    """The definitions of one grammar; the start has the name None."""

    def __init__(self, parent: Scope | None):
        self.parent, self.defines = parent, {}


class Context(NamedTuple):
    """What a place in a schema inherits: namespace, type library, grammar, definitions being expanded, documents being read."""

    ns: str = ""
    types: str = ""
    scope: Scope | None = None
    refs: frozenset = frozenset()
    path: tuple = ()


def parts(e: ElementTree.Element) -> list[ElementTree.Element]:
    return [c for c in e if isinstance(c.tag, str) and c.tag.startswith(RNG)]


class Schema:
    """A compiled schema: ``start`` and the contents of its elements by number. ``library`` has further documents by href."""

    def __init__(self, text: str, library: Mapping[str, str] | None = None):
        self.library, self.made = library or {}, Patterns()
        self.prefixes: dict[ElementTree.Element, dict[str, str]] = {}
        self.contents: list[Pattern] = []
        self.numbers: dict[tuple, int] = {}
        self.pending: list[tuple] = []
        self.simple: dict[tuple, Simple] = {}
        self.start = self.pattern(self.read(text), Context())
        while self.pending:
            number, inner, c = self.pending.pop()
            self.contents[number] = self.sequence(inner, c)
        self.check()

    def read(self, text: str) -> ElementTree.Element:
        root, spaces, fresh = None, [{"xml": "http://www.w3.org/XML/1998/namespace"}], {}
        try:
            for event, x in ElementTree.iterparse(io.BytesIO(text.encode()), ("start-ns", "start", "end")):
                if event == "start-ns":
                    fresh[x[0]] = x[1]
                elif event == "start":
                    root = x if root is None else root
                    spaces.append(spaces[-1] | fresh if fresh else spaces[-1])
                    self.prefixes[x], fresh = spaces[-1], {}
                else:
                    spaces.pop()
        except ElementTree.ParseError as e:
            raise GrammarError(str(e)) from None
        if not root.tag.startswith(RNG):
            raise GrammarError(f"{root.tag} is no schema")
        return root

    def load(self, e: ElementTree.Element, c: Context) -> tuple[ElementTree.Element, Context]:
        href = e.get("href", "")
        if href in c.path:
            raise GrammarError(f"{href} includes itself")
        if href not in self.library:
            raise GrammarError(f"{href} is missing")
        return self.read(self.library[href]), c._replace(path=(*c.path, href))

    def inherit(self, e: ElementTree.Element, c: Context) -> Context:
        return c._replace(ns=e.get("ns", c.ns), types=e.get("datatypeLibrary", c.types))

    def names(self, e: ElementTree.Element, c: Context) -> tuple:
        """A class of names."""
        c, kind = self.inherit(e, c), e.tag.removeprefix(RNG)
        if kind == "name":
            return self.qualified(e, (e.text or "").strip(), c.ns)
        inner = parts(e)
        if kind == "choice" and inner:
            out = self.names(inner[0], c)
            for x in inner[1:]:
                out = ("or", out, self.names(x, c))
            return out
        if kind not in ("anyName", "nsName"):
            raise GrammarError(f"{kind} is no class of names")
        left = None
        for x in (y for z in inner for y in parts(z)):
            one = self.names(x, c)
            if (kind == "anyName" and any_name(one)) or (kind == "nsName" and endless(one)):
                raise GrammarError(f"{kind} excludes what it may not")
            left = one if left is None else ("or", left, one)
        return ("any", left) if kind == "anyName" else ("ns", c.ns, left)

    def qualified(self, e: ElementTree.Element, name: str, ns: str) -> tuple:
        prefix, colon, local = name.rpartition(":")
        if colon and prefix not in self.prefixes[e]:
            raise GrammarError(f"prefix {prefix} is not bound")
        return ("name", self.prefixes[e][prefix] if colon else ns, local)

    def sequence(self, inner: list[ElementTree.Element], c: Context) -> Pattern:
        out = self.made.empty
        for x in inner:
            out = self.made.pair("group", out, self.pattern(x, c))
        return out

    def fold(self, kind: str, inner: list[ElementTree.Element], c: Context) -> Pattern:
        if not inner:
            raise GrammarError(f"{kind} of nothing")
        out = self.pattern(inner[0], c)
        for x in inner[1:]:
            right = self.pattern(x, c)
            out = self.made.choice(out, right) if kind == "choice" else self.made.pair(kind, out, right)
        return out

    def pattern(self, e: ElementTree.Element, c: Context) -> Pattern:
        made, kind = self.made, e.tag.removeprefix(RNG)
        outer, c = c, self.inherit(e, c)
        inner = parts(e)
        if kind in ("element", "attribute"):
            if (name := e.get("name")) is not None:
                names = self.qualified(e, name.strip(), c.ns if kind == "element" else e.get("ns", ""))
            elif inner:
                names, inner = self.names(inner[0], c), inner[1:]
            else:
                raise GrammarError(f"{kind} without a name")
            if kind == "attribute":
                return made.make("attribute", names, self.sequence(inner, c) if inner else made.text)
            if not inner:
                raise GrammarError("element without a pattern")
            key = (e, c.scope, c.ns, c.types)
            if key not in self.numbers:
                self.numbers[key] = len(self.contents)
                self.contents.append(made.none)
                self.pending.append((self.numbers[key], inner, c._replace(refs=frozenset())))
            return made.make("element", names, self.numbers[key])
        if kind in ("group", "interleave", "choice"):
            return self.fold(kind, inner, c)
        if kind in ("optional", "zeroOrMore", "oneOrMore", "mixed", "list"):
            p = self.fold("group", inner, c)
            if kind == "optional":
                return made.choice(p, made.empty)
            if kind == "mixed":
                return made.pair("interleave", made.text, p)
            if kind == "list":
                return made.make("list", p)
            return made.many(p) if kind == "oneOrMore" else made.choice(made.many(p), made.empty)
        if kind in ("empty", "text", "notAllowed"):
            return {"empty": made.empty, "text": made.text, "notAllowed": made.none}[kind]
        if kind == "value":
            library = c.types if e.get("type") else ""
            value = library, e.get("type", "token"), e.text or ""
            self.type(*value[:2], ())
            return made.make("value", value)
        if kind == "data":
            facets = tuple((x.get("name", ""), x.text or "") for x in inner if x.tag == RNG + "param")
            left = [y for x in inner if x.tag == RNG + "except" for y in parts(x)]
            self.type(c.types, e.get("type", ""), facets)
            return made.make("data", (c.types, e.get("type", ""), facets), self.fold("choice", left, c) if left else None)
        if kind in ("ref", "parentRef"):
            scope = c.scope if kind == "ref" else c.scope and c.scope.parent
            return self.defined(scope, (e.get("name") or "").strip(), c)
        if kind == "externalRef":
            root, c = self.load(e, c)
            return self.pattern(root, c._replace(scope=None, types="", refs=frozenset(), ns=c.ns if "ns" in e.attrib else ""))
        if kind == "grammar":
            scope = Scope(outer.scope)
            self.fill(scope, e, c._replace(scope=scope))
            return self.defined(scope, None, c._replace(scope=scope))
        raise GrammarError(f"{kind} is no pattern")

    def fill(self, scope: Scope, e: ElementTree.Element, c: Context, without: set | frozenset = frozenset()) -> set:
        """Add a grammar's definitions but those ``without``; returns the names that it has."""
        seen = set()
        for x in parts(e):
            kind, here = x.tag.removeprefix(RNG), self.inherit(x, c)
            if kind in ("start", "define"):
                name = x.get("name", "").strip() if kind == "define" else None
                seen.add(name)
                if name not in without:
                    scope.defines.setdefault(name, []).append((x.get("combine"), parts(x), here))
            elif kind == "div":
                seen |= self.fill(scope, x, here, without)
            elif kind == "include":
                root, there = self.load(x, here)
                if root.tag != RNG + "grammar":
                    raise GrammarError(f"{x.get('href')} is no grammar")
                own = self.fill(scope, x, here, without)
                held = self.fill(scope, root, self.inherit(root, there), own | without)
                if own - held:
                    raise GrammarError(f"{x.get('href')} does not define {sorted(map(str, own - held))[0]}")
                seen |= held
            else:
                raise GrammarError(f"{kind} in a grammar")
        return seen

    def defined(self, scope: Scope | None, name: str | None, c: Context) -> Pattern:
        said = name or "start"
        if scope is None or name not in scope.defines:
            raise GrammarError(f"{said} is not defined")
        if (scope, name) in c.refs:
            raise GrammarError(f"{said} refers to itself")
        entries = scope.defines[name]
        ways = {how for how, _, _ in entries if how}
        if len(ways) > 1 or sum(not how for how, _, _ in entries) > 1:
            raise GrammarError(f"{said} is defined twice")
        out = None
        for _, inner, at in entries:
            p = self.sequence(inner, at._replace(scope=scope, refs=c.refs | {(scope, name)}))
            out = p if out is None else self.made.choice(out, p) if ways == {"choice"} else self.made.pair("interleave", out, p)
        return out

    # ---- types

    def type(self, library: str, name: str, facets: tuple) -> Simple:
        key = library, name, facets
        if key not in self.simple:
            if library == "" and name in ("string", "token") and not facets:
                self.simple[key] = Simple(name, str, "preserve" if name == "string" else "collapse")
            elif library == TYPES and name in BUILT_IN and all(f in FACETS - {"enumeration", "whiteSpace"} for f, _ in facets):
                steps = [{f: [v]} for f, v in facets]
                self.simple[key] = Simple(name, BUILT_IN[name], "preserve" if name in ("string", "anySimpleType") else "replace" if name == "normalizedString" else "collapse", steps)
            else:
                raise GrammarError(f"no type {name} in library {library or 'built in'}" if not facets else f"no type {name} with such parameters")
        return self.simple[key]

    def fits(self, p: Pattern, text: str) -> bool:
        """Whether a text is of a ``data`` or ``value`` pattern."""
        library, name = p.a[:2]
        try:
            if p.kind == "value":
                kind = self.type(library, name, ())
                return kind.value(text) == kind.value(p.a[2])
            self.type(library, name, p.a[2]).value(text)
        except (ValueError, ArithmeticError, SchemaError):
            return False
        return True

    # ---- restrictions

    def check(self) -> None:
        todo = [self.start]
        while todo:
            p = todo.pop()
            if p.kind == "choice":
                todo += [p.a, p.b]
            elif p.kind not in ("element", "notAllowed"):
                raise GrammarError(f"{p.kind} at the start")
        for p in self.contents:
            self.forbidden(p, frozenset())
            if self.grouped(p) is None:
                raise GrammarError("data beside data, text or elements")
            self.held(p, False)

    def forbidden(self, p: Pattern, inside: frozenset) -> None:
        if "attribute" in inside and p.kind in ("attribute", "element"):
            raise GrammarError(f"{p.kind} in an attribute")
        if "list" in inside and p.kind in ("attribute", "element", "list", "text", "interleave"):
            raise GrammarError(f"{p.kind} in a list")
        if "data" in inside and p.kind not in ("data", "value", "choice"):
            raise GrammarError(f"{p.kind} in an exception")
        if p.kind == "attribute" and "repeated pair" in inside:
            raise GrammarError("a repeated group with an attribute")
        more = inside | {p.kind} if p.kind in ("attribute", "list", "data", "oneOrMore") else inside
        if p.kind in ("group", "interleave") and "oneOrMore" in inside:
            more = more | {"repeated pair"}
        for q in (p.a, p.b):
            if isinstance(q, Pattern):
                self.forbidden(q, more)

    def grouped(self, p: Pattern) -> int | None:
        """0 empty, 1 elements and text, 2 data; None where data would stand beside others."""
        if p.kind in ("value", "data", "list"):
            return 2
        if p.kind in ("text", "element"):
            return 1
        if p.kind == "attribute":
            return None if self.grouped(p.b) is None else 0
        if p.kind in ("choice", "group", "interleave", "oneOrMore"):
            a = self.grouped(p.a)
            b = a if p.kind == "oneOrMore" else self.grouped(p.b)
            if a is None or b is None or (p.kind != "choice" and 2 in (a, b) and 0 not in (a, b)):
                return None
            return max(a, b)
        return 0

    def held(self, p: Pattern, many: bool) -> tuple[list[tuple], list[tuple], bool]:
        """Names of attributes and elements of a content, and whether it has text."""
        if p.kind == "attribute":
            if endless(p.a) and not many:
                raise GrammarError("a class of attributes that is not repeated")
            return [p.a], [], False
        if p.kind == "element":
            return [], [p.a], False
        if p.kind == "oneOrMore":
            return self.held(p.a, True)
        if p.kind in ("choice", "group", "interleave"):
            (a, x, s), (b, y, t) = self.held(p.a, many), self.held(p.b, many)
            if p.kind != "choice" and any(overlap(m, n) for m in a for n in b):
                raise GrammarError("an attribute twice")
            if p.kind == "interleave" and (any(overlap(m, n) for m in x for n in y) or (s and t)):
                raise GrammarError("interleaved patterns that are not told apart")
            return [*a, *b], [*x, *y], s or t
        return [], [], p.kind == "text"

    # ---- the simplified form

    def simplified(self) -> list[tuple[int, str, str]]:
        """The start (number -1, no name) and each element's number, name class and content, as text."""
        rows = [(-1, "", said(self.start))]
        seen: dict[int, str] = {}

        def collect(p: Pattern) -> None:
            if p.kind == "element":
                seen[p.b] = said_names(p.a)
            for q in (p.a, p.b):
                if isinstance(q, Pattern):
                    collect(q)

        for p in [self.start, *self.contents]:
            collect(p)
        return rows + [(k, seen.get(k, ""), said(p)) for k, p in enumerate(self.contents)]


def any_name(names: tuple) -> bool:
    return names[0] == "any" or (names[0] == "or" and (any_name(names[1]) or any_name(names[2])))


def said_names(names: tuple) -> str:
    kind = names[0]
    if kind == "name":
        return f"{{{names[1]}}}{names[2]}" if names[1] else names[2]
    if kind == "or":
        return f"{said_names(names[1])}|{said_names(names[2])}"
    return ("*" if kind == "any" else f"{{{names[1]}}}*") + (f"-({said_names(names[-1])})" if names[-1] else "")


def said(p: Pattern) -> str:
    if p.kind in ("choice", "group", "interleave"):
        return f"({said(p.a)}{ {'choice': ' | ', 'group': ', ', 'interleave': ' & '}[p.kind]}{said(p.b)})"
    if p.kind == "oneOrMore":
        return f"{said(p.a)}+"
    if p.kind == "element":
        return f"{said_names(p.a)}#{p.b}"
    if p.kind == "attribute":
        return f"@{said_names(p.a)}={said(p.b)}"
    if p.kind == "value":
        return repr(p.a[2])
    if p.kind == "data":
        return p.a[1] + "".join(f" {k}={v}" for k, v in p.a[2]) + (f" - {said(p.b)}" if p.b else "")
    return f"list({said(p.a)})" if p.kind == "list" else p.kind


# ---- validation


class Validator:
    """Derivatives of a schema's pattern by event; ``error`` is the first event that nothing can follow."""

    def __init__(self, schema: Schema):
        self.schema, self.made = schema, schema.made
        self.memo: dict[tuple, Pattern] = {}
        self.base = dict(self.made.held)
        self.begin()

    def begin(self) -> Validator:
        if max(len(self.memo), len(self.made.held)) > MEMO:
            self.memo.clear()
            self.made.held = dict(self.base)
        self.now, self.open, self.parents, self.said, self.error = self.schema.start, [], [], [], None
        return self

    def remembered(self, what: Callable, p: Pattern, *args: str) -> Pattern:
        key = (what.__name__, p.number, *args)
        got = self.memo.get(key)
        if got is None:
            got = self.memo[key] = what(p, *args)
        return got

    def text_after(self, p: Pattern, text: str) -> Pattern:
        made, kind = self.made, p.kind
        if kind == "choice":
            return made.choice(self.text_after(p.a, text), self.text_after(p.b, text))
        if kind == "interleave":
            return made.choice(made.pair(kind, self.text_after(p.a, text), p.b), made.pair(kind, p.a, self.text_after(p.b, text)))
        if kind == "group":
            x = made.pair(kind, self.text_after(p.a, text), p.b)
            return made.choice(x, self.text_after(p.b, text)) if p.a.nullable else x
        if kind == "after":
            return made.after(self.text_after(p.a, text), p.b)
        if kind == "oneOrMore":
            return made.pair("group", self.text_after(p.a, text), made.choice(p, made.empty))
        if kind == "text":
            return p
        if kind in ("value", "data"):
            ok = self.schema.fits(p, text) and not (isinstance(p.b, Pattern) and self.text_after(p.b, text).nullable)
            return made.empty if ok else made.none
        if kind == "list":
            q = p.a
            for word in text.split():
                q = self.text_after(q, word)
            return made.empty if q.nullable else made.none
        return made.none

    def beyond(self, p: Pattern, then: Callable[[Pattern], Pattern]) -> Pattern:
        """What comes after the open element, changed."""
        if p.kind == "choice":
            return self.made.choice(self.beyond(p.a, then), self.beyond(p.b, then))
        return self.made.after(p.a, then(p.b)) if p.kind == "after" else self.made.none

    def opened(self, p: Pattern, ns: str, local: str) -> Pattern:
        made, kind = self.made, p.kind
        go = lambda q: self.remembered(self.opened, q, ns, local)
        if kind == "choice":
            return made.choice(go(p.a), go(p.b))
        if kind == "element":
            return made.after(self.schema.contents[p.b], made.empty) if contains(p.a, ns, local) else made.none
        if kind == "interleave":
            return made.choice(self.beyond(go(p.a), lambda x: made.pair(kind, x, p.b)), self.beyond(go(p.b), lambda x: made.pair(kind, p.a, x)))
        if kind == "group":
            x = self.beyond(go(p.a), lambda x: made.pair(kind, x, p.b))
            return made.choice(x, go(p.b)) if p.a.nullable else x
        if kind == "oneOrMore":
            return self.beyond(go(p.a), lambda x: made.pair("group", x, made.choice(p, made.empty)))
        return self.beyond(go(p.a), lambda x: made.after(x, p.b)) if kind == "after" else made.none

    def attribute(self, p: Pattern, ns: str, local: str, value: str) -> Pattern:
        made, kind = self.made, p.kind
        go = lambda q: self.attribute(q, ns, local, value)
        if kind == "choice":
            return made.choice(go(p.a), go(p.b))
        if kind in ("group", "interleave"):
            return made.choice(made.pair(kind, go(p.a), p.b), made.pair(kind, p.a, go(p.b)))
        if kind == "after":
            return made.after(go(p.a), p.b)
        if kind == "oneOrMore":
            return made.pair("group", go(p.a), made.choice(p, made.empty))
        if kind == "attribute" and contains(p.a, ns, local):
            return made.empty if (p.b.nullable and not value.strip()) or self.text_after(p.b, value).nullable else made.none
        return made.none

    def attributes_done(self, p: Pattern) -> Pattern:
        made, kind = self.made, p.kind
        go = lambda q: self.remembered(self.attributes_done, q)
        if kind == "choice":
            return made.choice(go(p.a), go(p.b))
        if kind in ("group", "interleave"):
            return made.pair(kind, go(p.a), go(p.b))
        if kind == "after":
            return made.after(go(p.a), p.b)
        if kind == "oneOrMore":
            return made.many(go(p.a))
        return made.none if kind == "attribute" else p

    def closed(self, p: Pattern) -> Pattern:
        if p.kind == "choice":
            return self.made.choice(self.closed(p.a), self.closed(p.b))
        return p.b if p.kind == "after" and p.a.nullable else self.made.none

    # ---- events

    def step(self, to: Pattern, error: str) -> bool:
        if to is self.made.none:
            self.error = error
            return False
        self.now = to
        return True

    def start(self, ns: str, local: str, attributes: list[tuple[str, str, str]]) -> None:
        if self.error:
            return
        if self.open:
            self.parents[-1] = True
            if not self.between():
                return
        if not self.step(self.remembered(self.opened, self.now, ns, local), f"element {local} is not allowed" + (f" in {self.open[-1]}" if self.open else "")):
            return
        for a_ns, a_local, value in attributes:
            if not self.step(self.attribute(self.now, a_ns, a_local, value), f"attribute {a_local} of {local} is not allowed"):
                return
        self.step(self.remembered(self.attributes_done, self.now), f"{local} lacks an attribute")
        self.open.append(local)
        self.parents.append(False)

    def between(self) -> bool:
        """Text between elements, where white space alone is none."""
        text = "".join(self.said)
        self.said.clear()
        return not text.strip() or self.step(self.text_after(self.now, text), f"text is not allowed in {self.open[-1]}")

    def text(self, data: str) -> None:
        if not self.error and self.open:
            self.said.append(data)

    def end(self) -> None:
        if self.error:
            return
        if self.parents.pop():
            ok = self.between()
        else:
            text = "".join(self.said)
            self.said.clear()
            got = self.text_after(self.now, text)
            ok = self.step(self.made.choice(self.now, got) if not text.strip() else got, f"text of {self.open[-1]} is not allowed")
        if ok:
            self.step(self.closed(self.now), f"content of {self.open.pop()} is incomplete")

    def finish(self) -> str | None:
        return self.error or (None if self.now.nullable and not self.open else "no document element")


def validate_text(validator: Validator, text: str | None, chunk: int | None = None) -> str | None:
    """The error of a text that is fed in pieces of ``chunk`` characters, or None."""
    v = validator.begin()
    parser = expat.ParserCreate(namespace_separator="\n")
    parser.ordered_attributes = parser.buffer_text = True
    name = lambda n: (split_name(n)[0] or "", split_name(n)[2])
    parser.StartElementHandler = lambda n, a: v.start(*name(n), [(*name(a[k]), a[k + 1]) for k in range(0, len(a), 2)])
    parser.EndElementHandler, parser.CharacterDataHandler = lambda _: v.end(), v.text
    data = text or ""
    size = chunk or max(1, len(data))
    try:
        for k in range(0, len(data), size):
            parser.Parse(data[k : k + size], False)
        parser.Parse("", True)
    except expat.ExpatError:
        return "not well-formed"
    return v.finish()


def validate(df: DataFrame, schema: str, library: Mapping[str, str] | None = None, chunk: int | None = None) -> DataFrame:
    """``doc_id, valid, error`` of ``df(doc_id, text)`` against a schema document."""
    Schema(schema, library)  # a faulty schema is an error here and not in the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Validator(Schema(schema, library))
        for b in batches:
            errors = [validate_text(v, t, chunk) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e is None for e in errors]), pa.array(errors, pa.string())], schema=BAD)

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DDL)


def validate_nodes(nodes: DataFrame, schema: str, library: Mapping[str, str] | None = None) -> DataFrame:
    """``doc_id, valid, error`` of the documents of a node table, row by row in document order.

    The rows of a document pass through one task, which holds its open elements alone.
    """
    Schema(schema, library)
    columns = ["doc_id", "pre", "end", "parent", "kind", "ns", "name", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Validator(Schema(schema, library))
        doc, started = None, False
        ends: list[int] = []
        waiting: list | None = None

        def begin_waiting() -> None:
            nonlocal waiting
            if waiting:
                v.start(waiting[0], waiting[1], waiting[2])
                waiting = None

        def close(before: int) -> None:
            while ends and ends[-1] < before:
                ends.pop()
                v.end()

        def finish() -> tuple:
            begin_waiting()
            close(1 << 63)
            error = v.finish()
            return doc, error is None, error

        for b in batches:
            out = []
            for d, pre, end, _, kind, ns, name, value in zip(*(b.column(k).to_pylist() for k in columns), strict=True):
                if not started or d != doc:
                    if started:
                        out.append(finish())
                    doc, started, waiting = d, True, None
                    ends.clear()
                    v.begin()
                if kind == "attr":
                    if waiting:
                        waiting[2].append((ns or "", name, value or ""))
                    continue
                if kind not in ("element", "text", "cdata"):
                    continue
                begin_waiting()
                close(pre)
                if kind == "element":
                    waiting = [ns or "", name, []]
                    ends.append(end)
                else:
                    v.text(value or "")
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(BAD.names, o, strict=True)) for o in out], schema=BAD)
        if started:
            yield pa.RecordBatch.from_pylist([dict(zip(BAD.names, finish(), strict=True))], schema=BAD)

    return nodes.select(*columns).repartition("doc_id").sortWithinPartitions("doc_id", "pre").mapInArrow(run, DDL)


def simplified(df: DataFrame, library: Mapping[str, str] | None = None) -> DataFrame:
    """``doc_id, number, name, pattern, error`` of schemas ``df(doc_id, text)``: the simplified form, or why there is none."""
    schema = pa.schema([("doc_id", pa.int64()), ("number", pa.int32()), ("name", pa.string()), ("pattern", pa.string()), ("error", pa.string())])

    def one(doc_id: int, text: str | None) -> list[tuple]:
        try:
            return [(doc_id, *row, None) for row in Schema(text or "", library).simplified()]
        except GrammarError as e:
            return [(doc_id, None, None, None, re.sub(r": line.*", "", str(e)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in one(d, t)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, number int, name string, pattern string, error string")
