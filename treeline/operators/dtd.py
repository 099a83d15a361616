"""DTDs: declarations, content models as automata, validation as a document goes by.

A content model is compiled into positions, one for each name in it: which may
come first, which may follow each, where it may end. Validation keeps, for each
open element, the set of positions that its children so far may have reached, so
memory grows with the depth of a document and not with its size; whole documents
and documents fed in pieces go through the same class.

Defined cases: a null or empty text is no document; one that isn't well-formed
has that as its error, and no others after it; an element without a declaration
is an error of its own, and anything may lie in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = r"[^\s()|,?*+\"'<>&;%#]+"
TOKENS = re.compile(rf"\s*(#PCDATA|{NAME}|[()|,?*+])")
DECLARATION = re.compile(r"<!--.*?-->|<\?.*?\?>|<!(ELEMENT|ATTLIST|ENTITY|NOTATION)\s+((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.DOTALL)
ENTITY = re.compile(rf"(%\s+)?({NAME})\s+(?:(?:SYSTEM\s+|PUBLIC\s+(?:\"[^\"]*\"|'[^']*')\s+)(\"[^\"]*\"|'[^']*')|(\"[^\"]*\"|'[^']*'))", re.DOTALL)
ATTRIBUTE = re.compile(rf"\s*({NAME})\s+(NOTATION\s*\([^)]*\)|\([^)]*\)|[A-Z]+)\s+(#REQUIRED|#IMPLIED|(?:#FIXED\s+)?(?:\"[^\"]*\"|'[^']*'))", re.DOTALL)


class DtdError(ValueError):
    """A declaration that can't be read."""


@dataclass
class Model:
    """A content model: ``kind`` is empty, any, mixed or children; positions carry names."""

    kind: str
    names: list[str] = field(default_factory=list)
    first: set[int] = field(default_factory=set)
    follow: list[set[int]] = field(default_factory=list)
    last: set[int] = field(default_factory=set)
    nullable: bool = True

    def step(self, state: frozenset[int] | None, name: str) -> frozenset[int]:
        """Positions after one more child; ``None`` is the state before the first."""
        ways = self.first if state is None else set().union(*(self.follow[p] for p in state))
        return frozenset(p for p in ways if self.names[p] == name)

    def complete(self, state: frozenset[int] | None) -> bool:
        return self.nullable if state is None else bool(state & self.last)

    def potential(self, state: frozenset[int] | None = None) -> list[str]:
        """Names that may come next."""
        if self.kind == "mixed":
            return sorted(self.names)
        ways = self.first if state is None else set().union(*(self.follow[p] for p in state))
        return sorted({self.names[p] for p in ways})

    def deterministic(self) -> bool:
        """Whether no state has two ways for one name."""
        return all(len({self.names[p] for p in ways}) == len(ways) for ways in (self.first, *self.follow))


def content_model(text: str) -> Model:
    """Read a content model."""
    text = text.strip()
    if text in ("EMPTY", "ANY"):
        return Model(text.lower())
    tokens, at = [], 0
    while at < len(text):
        m = TOKENS.match(text, at)
        if m is None:
            if text[at:].strip():
                raise DtdError(f"unexpected {text[at:][:10]!r} in {text!r}")
            break
        tokens.append(m.group(1))
        at = m.end()
    if "#PCDATA" in tokens:
        names = [t for t in tokens if t not in "()|*" and t != "#PCDATA"]
        if tokens[:2] != ["(", "#PCDATA"] or any(t in ",?+" for t in tokens) or (names and tokens[-1] != "*"):
            raise DtdError(f"mixed content must be (#PCDATA | ...)*: {text!r}")
        return Model("mixed", names)
    out, place = Model("children"), 0

    def take() -> str:
        nonlocal place
        if place == len(tokens):
            raise DtdError(f"{text!r} ends too soon")
        place += 1
        return tokens[place - 1]

    def peek() -> str:
        return tokens[place] if place < len(tokens) else ""

    def repeated(part: tuple[set[int], set[int], bool]) -> tuple[set[int], set[int], bool]:
        first, last, empty = part
        sign = peek() if peek() in ("?", "*", "+") and peek() else ""
        if sign:
            take()
        if sign in ("*", "+"):
            for p in last:
                out.follow[p] |= first
        return first, last, empty or sign in ("?", "*")

    def item() -> tuple[set[int], set[int], bool]:
        t = take()
        if t == "(":
            return repeated(group())
        if t in "|,?*+)":
            raise DtdError(f"unexpected {t!r} in {text!r}")
        out.names.append(t)
        out.follow.append(set())
        p = {len(out.names) - 1}
        return repeated((p, set(p), False))

    def group() -> tuple[set[int], set[int], bool]:
        first, last, empty = item()
        sign = peek()
        while (t := take()) != ")":
            if t != sign or t not in "|,":
                raise DtdError(f"unexpected {t!r} in {text!r}")
            f, l, e = item()  # noqa: E741
            if sign == "|":
                first, last, empty = first | f, last | l, empty or e
            else:
                for p in last:
                    out.follow[p] |= f
                first, last, empty = first | f if empty else first, last | l if e else l, empty and e
        return first, last, empty

    if not tokens or take() != "(":
        raise DtdError(f"no content model: {text!r}")
    out.first, out.last, out.nullable = repeated(group())
    if place != len(tokens):
        raise DtdError(f"unexpected {peek()!r} in {text!r}")
    return out


@dataclass
class Attribute:
    name: str
    type: str
    values: list[str]
    #: required, implied, fixed or default
    use: str
    value: str | None


@dataclass
class Dtd:
    elements: dict[str, Model] = field(default_factory=dict)
    models: dict[str, str] = field(default_factory=dict)
    attributes: dict[str, dict[str, Attribute]] = field(default_factory=dict)
    entities: dict[str, str] = field(default_factory=dict)
    notations: set[str] = field(default_factory=set)


def parse(text: str, library: dict[str, str] | None = None) -> Dtd:
    """Read the declarations of a DTD; of repeated ones the first holds. External parameter entities come from ``library``; nothing else is opened."""
    out, held, library = Dtd(), {}, library or {}

    def inside(t: str, depth: int = 0) -> str:
        if depth > 40:
            raise DtdError("parameter entities refer to themselves")

        def value(m: re.Match) -> str:
            if m.group(1) not in held:
                raise DtdError(f"undefined %{m.group(1)};")
            return f" {inside(held[m.group(1)], depth + 1)} "

        return re.sub(rf"%({NAME});", value, t)

    def read(t: str, depth: int) -> None:
        at = 0
        while at < len(t):
            m = DECLARATION.match(t, at)
            if m is None:
                ref = re.compile(rf"\s*%({NAME});").match(t, at)
                blank = re.compile(r"\s+").match(t, at)
                if ref:
                    if ref.group(1) not in held or depth > 40:
                        raise DtdError(f"undefined %{ref.group(1)};" if depth <= 40 else "parameter entities refer to themselves")
                    read(held[ref.group(1)], depth + 1)
                elif not blank:
                    raise DtdError(f"unexpected {t[at : at + 20]!r}")
                at = (ref or blank).end()
                continue
            at = m.end()
            if m.group(1):
                declare(m.group(1), m.group(2))

    def declare(kind: str, body: str) -> None:
        if kind == "ENTITY":
            m = ENTITY.match(body)
            if m is None:
                raise DtdError(f"no entity: {body!r}")
            value = library.get(m.group(3)[1:-1], "") if m.group(3) else m.group(4)[1:-1]
            (held if m.group(1) else out.entities).setdefault(m.group(2), value)
            return
        body = inside(body)
        name, rest = re.match(rf"\s*({NAME})(.*)", body, re.DOTALL).groups()
        if kind == "NOTATION":
            out.notations.add(name)
        elif kind == "ELEMENT":
            if name not in out.elements:
                out.elements[name], out.models[name] = content_model(rest), re.sub(r"\s+", "", rest)
        else:
            mine, at = out.attributes.setdefault(name, {}), 0
            while rest[at:].strip():
                m = ATTRIBUTE.match(rest, at)
                if m is None:
                    raise DtdError(f"no attribute: {rest[at:][:30]!r}")
                said = m.group(3)
                use = {"#REQUIRED": "required", "#IMPLIED": "implied"}.get(said) or ("fixed" if said.startswith("#FIXED") else "default")
                value = re.search("[\"'](.*)[\"']", said, re.DOTALL).group(1) if use in ("fixed", "default") else None
                listed = [v.strip() for v in m.group(2).partition("(")[2].rstrip(")").split("|")] if "(" in m.group(2) else []
                kind_ = m.group(2) if not listed else "NOTATION" if m.group(2).startswith("NOTATION") else "ENUMERATION"
                mine.setdefault(m.group(1), Attribute(m.group(1), kind_, listed, use, value))
                at = m.end()

    read(text, 0)
    return out


TOKEN, NAMED = re.compile(r"[\w.\-:·]+"), re.compile(r"[^\W\d][\w.\-:·]*|[_:][\w.\-:·]*")


class Validator:
    """Takes a document's events as they come and collects its errors."""

    def __init__(self, dtd: Dtd, root: str | None = None):
        self.dtd, self.root = dtd, root
        self.stack: list[list] = []  # name, model, state, whether it can still match
        self.errors: list[str] = []
        self.ids: set[str] = set()
        self.refs: dict[str, None] = {}
        #: Attributes that the DTD adds: element number, name, value.
        self.added: list[tuple[int, str, str]] = []
        self.count = 0

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if not self.stack and self.root not in (None, name):
            self.errors.append(f"root {name} is not {self.root}")
        if self.stack:
            self.child(name)
        model = self.dtd.elements.get(name)
        if model is None:
            self.errors.append(f"no declaration for element {name}")
        self.stack.append([name, model, None, True])
        self.check(name, attributes)
        self.count += 1

    def child(self, name: str) -> None:
        top = self.stack[-1]
        model = top[1]
        if model is None or model.kind == "any" or not top[3]:
            return
        if model.kind == "mixed":
            top[3] = name in model.names
        elif model.kind == "empty":
            top[3] = False
        else:
            top[2] = model.step(top[2], name)
            top[3] = bool(top[2])

    def text(self, data: str) -> None:
        if self.stack and data:
            top = self.stack[-1]
            if top[1] is not None and (top[1].kind == "empty" or top[1].kind == "children" and data.strip(" \t\r\n")):
                top[3] = False

    def end(self) -> None:
        name, model, state, fits = self.stack.pop()
        if model is not None and (not fits or model.kind == "children" and not model.complete(state)):
            self.errors.append(f"content of {name} does not follow {self.dtd.models[name]}")

    def check(self, name: str, attributes: dict[str, str]) -> None:
        declared = self.dtd.attributes.get(name, {})
        for a, value in attributes.items():
            d = declared.get(a)
            if d is None:
                if not a.startswith("xmlns"):
                    self.errors.append(f"no declaration for attribute {a} of {name}")
                continue
            if d.use == "fixed" and value != d.value:
                self.errors.append(f"attribute {a} of {name} is not {d.value}")
            self.typed(name, d, value if d.type == "CDATA" else " ".join(value.split()))
        for a, d in declared.items():
            if a not in attributes:
                if d.use == "required":
                    self.errors.append(f"{name} lacks attribute {a}")
                elif d.value is not None:
                    self.added.append((self.count, a, d.value))

    def typed(self, name: str, d: Attribute, value: str) -> None:
        many, words = d.type in ("IDREFS", "NMTOKENS", "ENTITIES"), value.split(" ")
        ok = True
        if d.type in ("ENUMERATION", "NOTATION"):
            ok = value in d.values
        elif d.type.startswith("NMTOKEN"):
            ok = all(TOKEN.fullmatch(w) for w in words) and (many or len(words) == 1)
        elif d.type != "CDATA":
            ok = all(NAMED.fullmatch(w) for w in words) and (many or len(words) == 1)
        if ok and d.type == "ID":
            if value in self.ids:
                self.errors.append(f"ID {value} is there twice")
            self.ids.add(value)
        elif ok and d.type.startswith("IDREF"):
            self.refs.update(dict.fromkeys(words))
        if not ok:
            self.errors.append(f"value of attribute {d.name} of {name} is no {d.type}")

    def finish(self) -> list[str]:
        self.errors += [f"IDREF {r} has no ID" for r in self.refs if r not in self.ids]
        return self.errors


def validate_text(dtd: Dtd, text: str | None, root: str | None = None, chunk: int | None = None) -> Validator:
    """Validate one document, in pieces of ``chunk`` characters if given."""
    v, p = Validator(dtd, root), expat.ParserCreate()
    p.buffer_text = False
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = v.start, lambda _: v.end(), v.text
    data = text or ""
    size = chunk or max(1, len(data))
    try:
        for k in range(0, len(data), size):
            p.Parse(data[k : k + size], False)
        p.Parse("", True)
    except expat.ExpatError as e:
        v.errors = [f"not well-formed: {expat.ErrorString(e.code)}"]
        return v
    v.finish()
    return v


def validate(df: DataFrame, dtd: str, *, root: str | None = None, chunk: int | None = None, library: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, valid, errors array<string>, n_added`` of ``df(doc_id, text)`` against a DTD; ``n_added`` are attributes that it supplies."""
    held = parse(dtd, library)
    schema = pa.schema([("doc_id", pa.int64()), ("valid", pa.bool_()), ("errors", pa.list_(pa.string())), ("n_added", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [validate_text(held, t, root, chunk) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([not v.errors for v in got]), pa.array([v.errors for v in got], pa.list_(pa.string())), pa.array([len(v.added) for v in got], pa.int64())], schema=schema)

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, valid boolean, errors array<string>, n_added long")
