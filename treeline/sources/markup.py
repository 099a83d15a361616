"""XML and HTML documents as node tables, read in Arrow batches.

A parser runs once a partition and reads each document on its own, so memory is
bounded by the largest document. A document that is not well-formed yields the
nodes up to the error and a row in the error table, never a failed job. Nothing
external is loaded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5
from html.parser import HTMLParser
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from treeline.nodetable import SCHEMA
from treeline.session import dealt, values

XML_NS = "http://www.w3.org/XML/1998/namespace"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("pre", pa.int64()), ("end", pa.int64()), ("level", pa.int32()), ("parent", pa.int64()), ("kind", pa.string()), ("ns", pa.string()),
    ("prefix", pa.string()), ("name", pa.string()), ("value", pa.string()), ("ord", pa.int32()), ("line", pa.int32()),
])
#: Characters of documents whose rows are held before they are handed on: elements hold the texts below them, each level anew.
PARSED = 1 << 18
#: Documents of a batch that are made Python objects at a time.
SLICE = 64
EVENTS = pa.schema([("doc_id", pa.int64()), ("seq", pa.int64()), ("event", pa.string()), ("name", pa.string()), ("ns", pa.string()), ("text", pa.string())])


@dataclass(frozen=True)
class Limits:
    """What one document may take; beyond it the document has an error and its nodes up to there.

    ``amplification`` bounds characters of text against characters read, once entities
    have made more than ``activation`` of them.
    """

    depth: int = 256
    nodes: int = 10_000_000
    name: int = 50_000
    text: int = 10_000_000
    amplification: float = 5.0
    activation: int = 1_000_000


class LimitError(Exception):
    """A document goes beyond a limit."""


# Fixed value: the code of the error that a limit was exceeded.
BEYOND = 114


class Tree:
    """Collects a document's nodes; ``value`` of an element is the text below it."""

    def __init__(self, doc_id: int):
        self.doc, self.rows, self.stack = doc_id, [], []
        self.errors: list[tuple] = []
        self.counts: list[int] = []
        self.open("document", None, None, None, 1)

    def open(self, kind: str, ns: str | None, prefix: str | None, name: str | None, line: int) -> None:
        stack, rows, counts = self.stack, self.rows, self.counts
        if counts:
            counts[-1] += 1
        row = [self.doc, len(rows), 0, len(stack), stack[-1][1] if stack else None, kind, ns, prefix, name, "", counts[-1] if counts else 0, line]
        rows.append(row)
        stack.append(row)
        counts.append(0)

    def next_place(self) -> int:
        if not self.counts:
            return 0
        self.counts[-1] += 1
        return self.counts[-1]

    def leaf(self, kind: str, ns: str | None, prefix: str | None, name: str | None, value: str, line: int) -> None:
        place = 0 if kind in ("attr", "ns") else self.next_place()
        at = len(self.rows)
        self.rows.append([self.doc, at, at, len(self.stack), self.stack[-1][1], kind, ns, prefix, name, value, place, line])

    def close(self) -> None:
        row = self.stack.pop()
        self.counts.pop()
        row[2] = len(self.rows) - 1

    def text(self, data: str, line: int, kind: str = "text") -> None:
        """Adjacent text is one node."""
        last = self.rows[-1]
        if kind == "text" and last[5] == "text" and last[4] == self.stack[-1][1]:
            last[9] += data
        else:
            self.leaf(kind, None, None, None, data, line)

    def finish(self) -> list[list]:
        while self.stack:
            self.close()
        below: dict[int, list[str]] = {}
        for row in reversed(self.rows):
            kind, parent = row[5], row[4]
            if kind == "element" or kind == "document":
                held = below.pop(row[1], None)
                if held is not None:
                    row[9] = held[0] if len(held) == 1 else "".join(reversed(held))
            elif kind != "text" and kind != "cdata":
                continue
            if parent is not None:
                if parent in below:
                    below[parent].append(row[9])
                else:
                    below[parent] = [row[9]]
        return self.rows


def split_name(name: str) -> tuple[str | None, str | None, str]:
    """Namespace, prefix and local part of expat's triplets."""
    if "\n" not in name:
        return None, None, name
    parts = name.split("\n")
    return parts[0], parts[2] if len(parts) > 2 else None, parts[1]


class XmlReader:
    """Push parser: feed chunks in any cut, then ``close``; ``events`` are kept if they are asked for."""

    def __init__(self, doc_id: int, limits: Limits | None = None, record: bool = False):
        self.tree, self.events, self.cdata, self.record = Tree(doc_id), [], False, record
        self.limits, self.fed, self.said = limits, 0, 0
        self.declared: list[tuple[str | None, str | None]] = []
        p = self.parser = expat.ParserCreate(namespace_separator="\n")
        p.namespace_prefixes, p.ordered_attributes, p.buffer_text = True, True, True
        p.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
        p.StartElementHandler, p.CharacterDataHandler = self.start, self.chars
        p.EndElementHandler = self.end if record else lambda _, close=self.tree.close: close()
        p.CommentHandler, p.ProcessingInstructionHandler = self.comment, self.pi
        p.StartNamespaceDeclHandler = lambda prefix, uri: self.declared.append((prefix, uri))
        p.StartCdataSectionHandler, p.EndCdataSectionHandler = lambda: setattr(self, "cdata", True), lambda: setattr(self, "cdata", False)

    def start(self, name: str, attrs: list[str]) -> None:
        ns, prefix, local = split_name(name)
        line = self.parser.CurrentLineNumber
        if self.limits:
            self.within(len(self.tree.stack), self.limits.depth, "depth")
            self.within(len(self.tree.rows) + len(attrs) // 2, self.limits.nodes, "number of nodes")
            self.within(max(map(len, [local, *attrs[::2]])), self.limits.name, "length of a name")
            self.within(max(map(len, attrs[1::2]), default=0), self.limits.text, "length of a value")
        self.tree.open("element", ns, prefix, local, line)
        if self.record:
            self.events.append(("start", local, ns, None))
        if self.declared:
            for p, uri in self.declared:
                self.tree.leaf("ns", None, None, p or "", uri or "", line)
            self.declared.clear()
        for k in range(0, len(attrs), 2):
            a_ns, a_prefix, a_local = split_name(attrs[k])
            self.tree.leaf("attr", a_ns, a_prefix, a_local, attrs[k + 1], line)

    def end(self, name: str) -> None:
        ns, _, local = split_name(name)
        self.tree.close()
        self.events.append(("end", local, ns, None))

    def within(self, number: float, most: float, what: str) -> None:
        if number > most:
            raise LimitError(f"{what} above {most}")

    def chars(self, data: str) -> None:
        if self.limits:
            self.said += len(data)
            if self.said > self.limits.activation:
                self.within(self.said / max(1, self.fed), self.limits.amplification, "amplification")
            last = self.tree.rows[-1]
            self.within(len(data) + (len(last[9]) if last[5] == "text" else 0), self.limits.text, "length of a text")
        self.tree.text(data, self.parser.CurrentLineNumber, "cdata" if self.cdata else "text")
        if self.record:
            self.events.append(("text", None, None, data))

    def comment(self, data: str) -> None:
        self.tree.leaf("comment", None, None, None, data, self.parser.CurrentLineNumber)
        if self.record:
            self.events.append(("comment", None, None, data))

    def pi(self, target: str, data: str) -> None:
        self.tree.leaf("pi", None, None, target, data, self.parser.CurrentLineNumber)
        if self.record:
            self.events.append(("pi", target, None, data))

    def feed(self, chunk: str | bytes) -> None:
        if self.tree.errors:
            return
        self.fed += len(chunk)
        try:
            self.parser.Parse(chunk, False)
        except expat.ExpatError as e:
            self.tree.errors.append(("parser", e.code, expat.ErrorString(e.code), e.lineno, e.offset))
        except LimitError as e:
            self.tree.errors.append(("limits", BEYOND, str(e), self.parser.CurrentLineNumber, self.parser.CurrentColumnNumber))

    def close(self) -> list[list]:
        if not self.tree.errors:
            try:
                self.parser.Parse("", True)
            except expat.ExpatError as e:
                self.tree.errors.append(("parser", e.code, expat.ErrorString(e.code), e.lineno, e.offset))
            except LimitError as e:
                self.tree.errors.append(("limits", BEYOND, str(e), self.parser.CurrentLineNumber, self.parser.CurrentColumnNumber))
        return self.tree.finish()


# Elements without content, and which start tags end an open element.
VOID = {"area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "isindex", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "center", "dir", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
AUTO_CLOSE = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "option": {"option"}, "body": {"head"}, "head": {"p"}, "a": {"a"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
    **{b: {"p"} for b in BLOCKS}, **{h: {"p", *(f"h{k}" for k in range(1, 7))} for h in (f"h{k}" for k in range(1, 7))},
}
HEAD_ONLY = {"base", "link", "meta", "script", "style", "title"}


class HtmlReader(HTMLParser):
    """Tag soup: implied html, head and body, start tags that close what is open, end tags that close what is inside."""

    def __init__(self, doc_id: int, implied: bool = True):
        super().__init__(convert_charrefs=True)
        self.tree, self.implied, self.open, self.events = Tree(doc_id), implied, [], []

    def push(self, tag: str, attrs: list) -> None:
        self.tree.open("element", None, None, tag, self.getpos()[0])
        self.events.append(("start", tag, None, None))
        for name, value in attrs:
            self.tree.leaf("attr", None, None, name, value if value is not None else "", self.getpos()[0])
        self.open.append(tag)

    def pop(self) -> None:
        self.tree.close()
        self.events.append(("end", self.open.pop(), None, None))

    def imply(self, tag: str) -> None:
        if not self.implied or tag == "html":
            return
        if not self.open:
            self.push("html", [])
        if tag in ("head", "body"):
            return
        if self.open == ["html"]:
            self.push("head" if tag in HEAD_ONLY else "body", [])
        elif self.open == ["html", "head"] and tag not in HEAD_ONLY:
            self.pop()
            self.push("body", [])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "head", "body") and tag in self.open:
            return
        self.imply(tag)
        closes = AUTO_CLOSE.get(tag, ())
        while self.open and self.open[-1] in closes:
            self.pop()
        self.push(tag, attrs)
        if tag in VOID:
            self.pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1] == tag:
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open and tag not in VOID:
            while self.open[-1] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data: str) -> None:
        if not data.strip() and self.open[-1:] in ([], ["html"], ["head"]):
            return
        if not self.open or self.open[-1] in ("html", "head"):
            self.imply("p")
        self.tree.text(data, self.getpos()[0])
        self.events.append(("text", None, None, data))

    def handle_comment(self, data: str) -> None:
        self.tree.leaf("comment", None, None, None, data, self.getpos()[0])
        self.events.append(("comment", None, None, data))

    def handle_pi(self, data: str) -> None:
        target, _, rest = data.partition(" ")
        self.tree.leaf("pi", None, None, target, rest, self.getpos()[0])

    def finish(self) -> list[list]:
        self.close()
        while self.open:
            self.pop()
        return self.tree.finish()


def read_xml(doc_id: int, text: str | bytes | None, chunk: int | None = None, limits: Limits | None = None, record: bool = False) -> XmlReader:
    reader = XmlReader(doc_id, limits, record)
    data = text or ""
    for k in range(0, len(data), chunk or max(1, len(data))):
        reader.feed(data[k : k + chunk] if chunk else data)
    reader.rows = reader.close()
    # The parser holds the reader: without this, both wait for the collector of cycles.
    reader.parser = None
    return reader


def read_html(doc_id: int, text: str | None, chunk: int | None = None, implied: bool = True) -> HtmlReader:
    reader = HtmlReader(doc_id, implied)
    data = text or ""
    for k in range(0, len(data), chunk or max(1, len(data))):
        reader.feed(data[k : k + chunk] if chunk else data)
    reader.rows = reader.finish()
    return reader


def table_of(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def parse_with(df: DataFrame, id_column: str, text_column: str, read, pick, schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows that ``pick`` takes from each document as ``read`` reads it.

    Parsing is dear a byte and a small file is one split, so the documents are
    dealt out first. A document makes many more bytes than it has, which Spark's
    estimate doesn't know, so the rows are never broadcast by it. A document's rows
    lie in one part, one behind the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for k in range(0, batch.num_rows, SLICE):
                for doc, text in zip(*map(values, batch.slice(k, SLICE).columns), strict=True):
                    rows += pick(read(doc, text))
                    held += len(text or "")
                    if len(rows) > 20_000 or held > PARSED:
                        yield table_of(rows, schema)
                        rows, held = [], 0
            yield table_of(rows, schema)

    return dealt(df.select(F.col(id_column).cast("long"), F.col(text_column))).mapInArrow(run, ddl).hint("merge")


def xml_nodes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk: int | None = None, limits: Limits | None = None) -> DataFrame:
    """Node table of XML documents; with ``chunk``, fed in pieces of that size (the result is the same); with ``limits``, of a document beyond them what lies before."""
    return parse_with(df, id_column, text_column, lambda d, t: read_xml(d, t, chunk, limits), lambda r: r.rows, ARROW, SCHEMA.replace(" end ", " `end` "))


def html_nodes(df: DataFrame, id_column: str = "page_id", text_column: str = "html", chunk: int | None = None, implied: bool = True) -> DataFrame:
    """Node table of HTML pages."""
    return parse_with(df, id_column, text_column, lambda d, t: read_html(d, t, chunk, implied), lambda r: r.rows, ARROW, SCHEMA)


def events(df: DataFrame, id_column: str, text_column: str, kind: str = "xml") -> DataFrame:
    """``doc_id, seq, event, name, ns, text`` in document order."""
    read = (lambda d, t: read_xml(d, t, record=True)) if kind == "xml" else read_html
    number = lambda r: [(r.tree.doc, k, *e) for k, e in enumerate(r.events)]
    return parse_with(df, id_column, text_column, read, number, EVENTS, "doc_id long, seq long, event string, name string, ns string, text string")


def errors(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", limits: Limits | None = None) -> DataFrame:
    """``doc_id, domain, code, level, message, line, col``, a row per document that is not well-formed or goes beyond limits."""
    schema = pa.schema([("doc_id", pa.int64()), ("domain", pa.string()), ("code", pa.int32()), ("level", pa.string()), ("message", pa.string()), ("line", pa.int32()), ("col", pa.int32())])
    pick = lambda r: [(r.tree.doc, d, c, "fatal", m, line, col) for d, c, m, line, col in r.tree.errors]
    return parse_with(df, id_column, text_column, lambda d, t: read_xml(d, t, None, limits), pick, schema, "doc_id long, domain string, code int, level string, message string, line int, col int")


#: Entity names without a semicolon's need; kept for lookups by name and by value.
ENTITY_VALUES = {name.rstrip(";"): value for name, value in html5.items()}


#: The name that a character is written with: the shortest, then the first.
ENTITY_NAMES = {v: min((n for n, x in ENTITY_VALUES.items() if x == v), key=lambda n: (len(n), n)) for v in set(ENTITY_VALUES.values()) if len(v) == 1}
REFERENCE = re.compile("&(?:#([0-9]{1,7})|#[xX]([0-9A-Fa-f]{1,6})|([A-Za-z][A-Za-z0-9]*));")


def encode_entities(text: str) -> str:
    """Characters outside ASCII and the marks of markup as references, by name where there is one; NUL has none and stays."""
    return "".join([c if " " <= c < "\x7f" and c not in "&<>\"" or c in "\t\n\r\0" else f"&{ENTITY_NAMES[c]};" if c in ENTITY_NAMES else f"&#{ord(c)};" for c in text])


def decode_entities(text: str) -> str:
    """References as characters; unknown names and numbers of no character stay as they are."""

    def one(m: re.Match) -> str:
        if m[3]:
            return ENTITY_VALUES.get(m[3], m[0])
        n = int(m[1]) if m[1] else int(m[2], 16)
        return chr(n) if 0 < n < 0xD800 or 0xE000 <= n <= 0x10FFFF else m[0]

    return REFERENCE.sub(one, text)


def entities(text: Column, decode: bool = False) -> Column:
    """:func:`encode_entities` or :func:`decode_entities` of a column; null stays null."""
    change = decode_entities if decode else encode_entities

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(change, na_action="ignore")

    return run(text)


# Node types of the pull reader.
NODE_TYPES = {"element": 1, "text": 3, "cdata": 4, "pi": 7, "comment": 8}
END_ELEMENT = 15


def cursor_rows(rows: list[list]) -> list[tuple]:
    """What a pull reader stops at, one stop after the other: nodes and the ends of elements that aren't empty."""
    out, open_, attributes, filled = [], [], {}, set()
    for r in rows:
        if r[5] == "attr":
            attributes[r[4]] = attributes.get(r[4], 0) + 1
        elif r[5] not in ("ns", "document"):
            filled.add(r[4])

    def close(before: int) -> None:
        while open_ and open_[-1][2] < before:
            e = open_.pop()
            if e[1] in filled:
                out.append((e[0], len(out), END_ELEMENT, e[3] - 1, e[8], False, None, attributes.get(e[1], 0)))

    for r in rows:
        if r[5] in ("attr", "ns", "document"):
            continue
        close(r[1])
        name = r[8] or f"#{'cdata-section' if r[5] == 'cdata' else r[5]}"
        out.append((r[0], len(out), NODE_TYPES[r[5]], r[3] - 1, name, r[5] == "element" and r[1] not in filled, None if r[5] == "element" else r[9], attributes.get(r[1], 0)))
        if r[5] == "element":
            open_.append(r)
    close(1 << 62)
    return out


def cursor(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, seq, type, depth, name, empty, value, attributes``: the stops of a pull reader over each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("seq", pa.int64()), ("type", pa.int32()), ("depth", pa.int32()), ("name", pa.string()), ("empty", pa.bool_()), ("value", pa.string()), ("attributes", pa.int32())])
    return parse_with(df, id_column, text_column, read_xml, lambda r: cursor_rows(r.rows), schema, "doc_id long, seq long, type int, depth int, name string, empty boolean, value string, attributes int")


class PatternReader:
    """Matches an XSLT-style pattern while a document is read: only the names of the open elements are kept."""

    def __init__(self, doc_id: int, pattern: str):
        self.doc, self.names, self.count, self.found, self.errors = doc_id, [], 0, [], []
        self.patterns = []
        for one in pattern.split("|"):
            parts = re.findall(r"(//|/)?\s*([^/\s]+)", one.strip())
            self.patterns.append([("^" if sep == "/" and k == 0 else "//" if k == 0 else sep, test) for k, (sep, test) in enumerate(parts)])
        p = self.parser = expat.ParserCreate(namespace_separator="\n")
        p.StartElementHandler, p.EndElementHandler = self.start, lambda _: self.names.pop()

    def start(self, name: str, attributes: dict) -> None:
        self.names.append(split_name(name)[2])
        for steps in self.patterns:
            if steps[-1][1].startswith("@"):
                wanted = steps[-1][1][1:]
                for a in attributes:
                    if wanted in ("*", split_name(a)[2]) and self.fits(steps[:-1], steps[-1][0], len(self.names)):
                        self.found.append((self.doc, self.count, f"@{split_name(a)[2]}"))
            elif self.fits(steps[:-1], steps[-1][0], len(self.names) - 1) and steps[-1][1] in ("*", self.names[-1]):
                self.found.append((self.doc, self.count, self.names[-1]))
        self.count += 1

    def fits(self, steps: list, how: str, upto: int) -> bool:
        """Whether the steps lead along the open elements to the one before ``upto``, if the next is reached by ``how``."""
        if not steps:
            return how == "//" or upto == 0
        for k in (range(upto - 1, -1, -1) if how == "//" else [upto - 1]):
            if k >= 0 and steps[-1][1] in ("*", self.names[k]) and self.fits(steps[:-1], steps[-1][0], k):
                return True
        return False

    def feed(self, chunk: str, last: bool = False) -> None:
        if not self.errors:
            try:
                self.parser.Parse(chunk, last)
            except expat.ExpatError as e:
                self.errors.append(expat.ErrorString(e.code))


def stream_matches(df: DataFrame, pattern: str, chunk: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, element, name``: what matches a pattern, found while each document is fed in pieces; ``element`` counts start tags."""
    schema = pa.schema([("doc_id", pa.int64()), ("element", pa.int64()), ("name", pa.string())])

    def read(doc_id: int, text: str | None) -> PatternReader:
        reader, data = PatternReader(doc_id, pattern), text or ""
        for k in range(0, len(data), chunk):
            reader.feed(data[k : k + chunk])
        reader.feed("", True)
        return reader

    return parse_with(df, id_column, text_column, read, lambda r: sorted(set(r.found)), schema, "doc_id long, element long, name string")
