"""XML Schema: declarations compiled into automata and checks, documents validated in Arrow batches.

What is read: global and local elements, named and anonymous types, ``sequence``,
``choice`` and ``all`` with occurrences, groups of attributes by use, simple types
by restriction with all facets, by list and by union, extension and simple
content, ``any``, ``nillable``. Identity constraints, substitution groups and
imports are not; a schema that uses them is refused, so that nothing passes
unchecked.

Defined cases: a null, empty or broken text has the one error that it isn't
well-formed; a root without a declaration is an error.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

XS = "{http://www.w3.org/2001/XMLSchema}"
XSI = "{http://www.w3.org/2001/XMLSchema-instance}"


class SchemaError(ValueError):
    """A schema that can't be read, or that says what isn't supported."""


def spaced(text: str, how: str) -> str:
    """White space kept, made blanks, or collapsed."""
    if how == "preserve":
        return text
    text = re.sub("[\t\r\n]", " ", text)
    return re.sub(" +", " ", text).strip(" ") if how == "collapse" else text


def whole(low: int | None, high: int | None) -> Callable[[str], object]:
    def read(s: str) -> int:
        if not re.fullmatch("[+-]?[0-9]+", s):
            raise ValueError
        n = int(s)
        if (low is not None and n < low) or (high is not None and n > high):
            raise ValueError
        return n

    return read


def matches(pattern: str, value: Callable[[str], object] = str) -> Callable[[str], object]:
    held = re.compile(pattern)

    def read(s: str) -> object:
        if not held.fullmatch(s):
            raise ValueError
        return value(s)

    return read


def number(s: str) -> Decimal:
    if not re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)", s):
        raise ValueError
    return Decimal(s)


def real(s: str) -> float:
    if not re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|-?INF|NaN", s):
        raise ValueError
    return float(s.replace("INF", "inf"))


ZONE = r"(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"


def moment(s: str) -> object:
    date, _, time = s.partition("T")
    if not re.fullmatch(rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?{ZONE}", s):
        raise ValueError
    return datetime.date.fromisoformat(date), time


# Built-in types by base, bounds or form.
BUILT_IN: dict[str, Callable[[str], object]] = {
    "anySimpleType": str, "string": str, "normalizedString": str, "token": str, "anyURI": str, "boolean": matches("true|false|0|1", lambda s: s in ("true", "1")), "decimal": number, "float": real, "double": real,
    "integer": whole(None, None), "nonNegativeInteger": whole(0, None), "positiveInteger": whole(1, None), "nonPositiveInteger": whole(None, 0), "negativeInteger": whole(None, -1),
    "long": whole(-(1 << 63), (1 << 63) - 1), "int": whole(-(1 << 31), (1 << 31) - 1), "short": whole(-(1 << 15), (1 << 15) - 1), "byte": whole(-128, 127),
    "unsignedLong": whole(0, (1 << 64) - 1), "unsignedInt": whole(0, (1 << 32) - 1), "unsignedShort": whole(0, (1 << 16) - 1), "unsignedByte": whole(0, 255),
    "date": matches(rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{ZONE}", lambda s: datetime.date.fromisoformat(s[:10])), "dateTime": moment, "time": matches(rf"([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?{ZONE}"), "gYear": matches(rf"-?[0-9]{{4,}}{ZONE}"),
    "Name": matches(r"[^\W\d][\w.\-:·]*|[_:][\w.\-:·]*"), "NCName": matches(r"[^\W\d][\w.\-·]*|_[\w.\-·]*"), "NMTOKEN": matches(r"[\w.\-:·]+"), "ID": matches(r"[^\W\d][\w.\-·]*|_[\w.\-·]*"), "IDREF": matches(r"[^\W\d][\w.\-·]*|_[\w.\-·]*"),
    "language": matches("[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*"), "hexBinary": matches("([0-9a-fA-F]{2})*"), "QName": matches(r"([^\W\d][\w.\-·]*:)?[^\W\d][\w.\-·]*"),
}
FACETS = {"enumeration", "pattern", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "length", "minLength", "maxLength", "totalDigits", "fractionDigits", "whiteSpace"}


@dataclass
class Simple:
    """A simple type: how white space is treated, how a text is read, and the facets of each step of its derivation."""

    name: str
    read: Callable[[str], object]
    space: str = "collapse"
    facets: list[dict[str, list[str]]] = field(default_factory=list)
    kind: str = "atomic"
    parts: list[Simple] = field(default_factory=list)

    def value(self, text: str) -> object:
        """The value of a text; ``ValueError`` names the facet or the type that it breaks."""
        s = spaced(text, self.space)
        if self.kind == "union":
            for p in self.parts:
                try:
                    got: object = p.value(text)
                    break
                except ValueError:
                    continue
            else:
                raise ValueError(self.name)
        elif self.kind == "list":
            got = [self.parts[0].value(x) for x in s.split()]
        else:
            try:
                got = self.read(s)
            except (ValueError, InvalidOperation):
                raise ValueError(self.name) from None
        for step in self.facets:
            for facet, wanted in step.items():
                if not self.holds(facet, wanted, s, got):
                    raise ValueError(facet)
        return got

    def holds(self, facet: str, wanted: list[str], s: str, got: object) -> bool:
        size = len(got) if isinstance(got, list) else len(s) // 2 if self.name == "hexBinary" else len(s)
        if facet == "enumeration":
            return any(got == self.same(w) for w in wanted)
        if facet == "pattern":
            return any(re.fullmatch(python_pattern(w), s) for w in wanted)
        if facet in ("length", "minLength", "maxLength"):
            n = int(wanted[0])
            return {"length": size == n, "minLength": size >= n, "maxLength": size <= n}[facet]
        if facet == "totalDigits":
            return len(re.sub(r"\D", "", s).lstrip("0").rstrip("0") if "." in s else re.sub(r"\D", "", s).lstrip("0")) <= int(wanted[0])
        if facet == "fractionDigits":
            return len(s.partition(".")[2].rstrip("0")) <= int(wanted[0])
        if facet == "whiteSpace":
            return True
        edge = self.same(wanted[0])
        return {"minInclusive": got >= edge, "maxInclusive": got <= edge, "minExclusive": got > edge, "maxExclusive": got < edge}[facet]

    def same(self, text: str) -> object:
        return Simple(self.name, self.read, self.space, [], self.kind, self.parts).value(text)


def python_pattern(pattern: str) -> str:
    """A schema's pattern for Python: name classes and class subtraction; properties are refused."""
    if re.search(r"\\[pP]", pattern):
        raise SchemaError(f"properties of characters are not supported: {pattern}")
    out = pattern.replace(r"\i", r"(?:[^\W\d]|:)").replace(r"\c", r"[\w.\-:·]")
    return re.sub(r"\[((?:[^\[\]\\]|\\.)+)-\[((?:[^\[\]\\]|\\.)+)\]\]", r"(?:(?![\2])[\1])", out)


@dataclass
class Complex:
    """An element's type: attributes, and a content of particles, text or both."""

    attributes: dict[str, tuple[Simple, str, str | None]] = field(default_factory=dict)
    particle: tuple | None = None
    mixed: bool = False
    text: Simple | None = None
    any_attribute: bool = False


class Schema:
    """A compiled schema."""

    def __init__(self, text: str):
        try:
            self.root = ElementTree.fromstring(text)
        except ElementTree.ParseError as e:
            raise SchemaError(str(e)) from None
        if self.root.tag != XS + "schema":
            raise SchemaError("no schema")
        self.space = self.root.get("targetNamespace")
        self.qualified = self.root.get("elementFormDefault") == "qualified"
        self.named = {(c.tag.removeprefix(XS), c.get("name")): c for c in self.root if c.get("name")}
        for e in self.root.iter():
            if e.tag in (XS + t for t in ("import", "include", "redefine", "key", "keyref", "unique")) or e.get("substitutionGroup"):
                raise SchemaError(f"{e.tag.removeprefix(XS)} is not supported")
        self.types: dict[str, object] = {}
        self.elements: dict[str, tuple] = {}
        for kind, name in list(self.named):
            if kind == "element":
                self.elements[self.tag(name, True)] = self.element(self.named[kind, name], True)

    def tag(self, name: str, qualified: bool) -> str:
        return f"{{{self.space}}}{name}" if self.space and qualified else name

    def element(self, e: ElementTree.Element, top: bool = False) -> tuple:
        """``(tag, type, nillable, fixed)``; the type is looked up when it is needed, so that types may hold themselves."""
        if ref := e.get("ref"):
            return ("ref", self.tag(ref.rpartition(":")[2], True))
        inner = next((c for c in e if c.tag in (XS + "complexType", XS + "simpleType")), None)
        held = inner if inner is not None else e.get("type") or "anyType"
        return ("element", self.tag(e.get("name"), top or self.qualified or e.get("form") == "qualified"), held, e.get("nillable") == "true", e.get("fixed"))

    def type(self, held: ElementTree.Element | str) -> object:
        if not isinstance(held, str):
            key = f"#{id(held)}"
            if key not in self.types:
                self.types[key] = self.complex(held) if held.tag == XS + "complexType" else self.simple(held)
            return self.types[key]
        name = held.rpartition(":")[2]
        if ("complexType", name) in self.named or ("simpleType", name) in self.named:
            return self.type(self.named.get(("complexType", name), self.named.get(("simpleType", name))))
        if name == "anyType":
            return None
        if name not in BUILT_IN:
            raise SchemaError(f"no type {held}")
        return Simple(name, BUILT_IN[name], "preserve" if name in ("string", "anySimpleType") else "replace" if name == "normalizedString" else "collapse")

    def simple(self, e: ElementTree.Element) -> Simple:
        for c in e:
            what = c.tag.removeprefix(XS)
            inner = [x for x in c if x.tag == XS + "simpleType"]
            if what == "restriction":
                base = self.type(c.get("base") or inner[0])
                facets: dict[str, list[str]] = {}
                for f in c:
                    if (name := f.tag.removeprefix(XS)) in FACETS:
                        if name == "pattern":
                            python_pattern(f.get("value", ""))
                        facets.setdefault(name, []).append(f.get("value", ""))
                return Simple(base.name, base.read, facets.get("whiteSpace", [base.space])[0], [*base.facets, facets], base.kind, base.parts)
            if what == "list":
                return Simple("list", str, "collapse", [], "list", [self.type(c.get("itemType") or inner[0])])
            if what == "union":
                return Simple("union", str, "preserve", [], "union", [self.type(m) for m in [*(c.get("memberTypes") or "").split(), *inner]])
        raise SchemaError("a simple type without a derivation")

    def complex(self, e: ElementTree.Element) -> Complex:
        out = Complex(mixed=e.get("mixed") == "true")
        body = e
        for c in e:
            if c.tag in (XS + "simpleContent", XS + "complexContent"):
                body = next(x for x in c if x.tag in (XS + "extension", XS + "restriction"))
                base = self.type(body.get("base"))
                if c.tag == XS + "simpleContent":
                    out.text = base.text if isinstance(base, Complex) else base
                if isinstance(base, Complex):
                    out.attributes |= base.attributes
                    if body.tag == XS + "extension":
                        out.particle, out.mixed = base.particle, out.mixed or base.mixed
        for c in body:
            what = c.tag.removeprefix(XS)
            if what in ("sequence", "choice", "all", "group"):
                own = self.particle(c)
                out.particle = own if out.particle is None else ("sequence", [out.particle, own], 1, 1)
            elif what == "attribute":
                self.attribute(c, out)
            elif what == "attributeGroup":
                for a in self.named["attributeGroup", c.get("ref").rpartition(":")[2]]:
                    self.attribute(a, out)
            elif what == "anyAttribute":
                out.any_attribute = True
        return out

    def attribute(self, a: ElementTree.Element, out: Complex) -> None:
        if a.get("ref"):
            a = self.named["attribute", a.get("ref").rpartition(":")[2]]
        inner = next((c for c in a if c.tag == XS + "simpleType"), None)
        out.attributes[a.get("name")] = (self.type(inner if inner is not None else a.get("type") or "xs:anySimpleType"), a.get("use", "optional"), a.get("fixed"))

    def particle(self, e: ElementTree.Element) -> tuple:
        most = e.get("maxOccurs", "1")
        low, high = int(e.get("minOccurs", "1")), None if most == "unbounded" else int(most)
        what = e.tag.removeprefix(XS)
        if what == "element":
            return ("one", self.element(e), low, high)
        if what == "any":
            return ("any", None, low, high)
        if what == "group":
            inner = next(c for c in self.named["group", e.get("ref").rpartition(":")[2]] if c.tag != XS + "annotation")
            return ("sequence", [self.particle(inner)], low, high)
        return (what, [self.particle(c) for c in e if c.tag != XS + "annotation"], low, high)

    # ---- documents

    def errors(self, text: str | None) -> list[str]:
        try:
            root = ElementTree.fromstring(text or "")
        except ElementTree.ParseError:
            return ["not well-formed"]
        if root.tag not in self.elements:
            return [f"no declaration for element {local(root)}"]
        found: list[str] = []
        self.visit(root, self.elements[root.tag], found)
        return found

    def visit(self, e: ElementTree.Element, declared: tuple, found: list[str]) -> None:
        if declared[0] == "ref":
            declared = self.elements[declared[1]]
        _, _, held, nillable, fixed = declared
        kind, name = self.type(held), local(e)
        if e.get(XSI + "nil") in ("true", "1"):
            if not nillable:
                found.append(f"{name} may not be nil")
            elif len(e) or (e.text or "").strip():
                found.append(f"{name} is nil and not empty")
            return
        if kind is None:
            return
        simple = kind if isinstance(kind, Simple) else kind.text
        if isinstance(kind, Complex):
            self.attributes(e, kind, found)
        elif any(not a.startswith(XSI) for a in e.attrib):
            found.append(f"{name} has attributes")
        if simple is not None:
            if len(e):
                found.append(f"{name} has children")
                return
            try:
                value = simple.value(e.text or "")
                if fixed is not None and value != simple.value(fixed):
                    found.append(f"{name} is not {fixed}")
            except ValueError as broken:
                found.append(f"value of {name} breaks {broken}")
            return
        texts = [e.text or "", *(c.tail or "" for c in e)]
        if not kind.mixed and any(t.strip() for t in texts):
            found.append(f"{name} has text")
        children = list(e)
        ends = self.match(kind.particle, children, {0: ()}) if kind.particle else {0: ()}
        if len(children) not in ends:
            found.append(f"content of {name} does not fit")
            return
        for child, d in zip(children, flat(ends[len(children)]), strict=True):
            if d is not None:
                self.visit(child, d, found)

    def attributes(self, e: ElementTree.Element, kind: Complex, found: list[str]) -> None:
        name = local(e)
        for a, value in e.attrib.items():
            if a.startswith(XSI):
                continue
            if a not in kind.attributes or kind.attributes[a][1] == "prohibited":
                if not kind.any_attribute:
                    found.append(f"{name} has attribute {a.rpartition('}')[2]}")
                continue
            simple, _, fixed = kind.attributes[a]
            try:
                if fixed is not None and simple.value(value) != simple.value(fixed):
                    found.append(f"attribute {a} of {name} is not {fixed}")
                simple.value(value)
            except ValueError as broken:
                found.append(f"value of attribute {a} of {name} breaks {broken}")
        found += [f"{name} lacks attribute {a}" for a, (_, use, _) in kind.attributes.items() if use == "required" and a not in e.attrib]

    def match(self, p: tuple, children: list, starts: dict[int, tuple]) -> dict[int, tuple]:
        """Places up to which a particle may reach from places where it may begin, each with the declarations met on the way."""
        what, inner, low, high = p
        reached, now, n = dict(starts) if low == 0 else {}, starts, 0
        while now and (high is None or n < high):
            n += 1
            then: dict[int, tuple] = {}
            for at, way in now.items():
                for k, more in self.once(what, inner, children, at, way).items():
                    then.setdefault(k, more)
            now = {k: w for k, w in then.items() if n <= low or k not in reached}
            if n >= low:
                for k, w in now.items():
                    reached.setdefault(k, w)
            if all(k in starts for k in now) and n >= low:
                break
        return reached

    def once(self, what: str, inner, children: list, at: int, way: tuple) -> dict[int, tuple]:
        if what in ("one", "any"):
            if at < len(children) and (what == "any" or children[at].tag == inner[1]):
                declared = self.elements.get(children[at].tag) if what == "any" else inner
                return {at + 1: (way, declared)}
            return {}
        if what == "sequence":
            now = {at: way}
            for q in inner:
                now = self.match(q, children, now)
            return now
        if what == "choice":
            out: dict[int, tuple] = {}
            for q in inner:
                for k, w in self.match(q, children, {at: way}).items():
                    out.setdefault(k, w)
            return out
        # all: each child once, in any order
        left, k = list(inner), at
        while k < len(children):
            q = next((q for q in left if q[0] == "one" and q[1][1] == children[k].tag), None)
            if q is None:
                break
            left.remove(q)
            way, k = (way, q[1]), k + 1
        return {k: way} if all(q[2] == 0 for q in left) else {}


def flat(way: tuple) -> list:
    out = []
    while way:
        way, d = way
        out.append(d)
    return out[::-1]


def local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def validate(df: DataFrame, schema: str) -> DataFrame:
    """``doc_id, valid, errors array<string>`` of ``df(doc_id, text)`` against a schema document."""
    Schema(schema)  # a faulty schema is an error here and not in the tasks
    out = pa.schema([("doc_id", pa.int64()), ("valid", pa.bool_()), ("errors", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Schema(schema)
        for b in batches:
            got = [compiled.errors(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([not g for g in got]), pa.array(got, pa.list_(pa.string()))], schema=out)

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, valid boolean, errors array<string>")
