"""A streaming writer: events in order become a document's text, checked step by step.

The writer holds the open elements and what it has said; an event that can't
come where it stands ends the document with an error that names it. Elements left
open at the end are closed. Documents' events meet in one task each, in order.

Events: ``start`` and ``end`` (``name``, ``ns`` a prefix's namespace or null), ``attr``
(``name``, ``text``), ``text``, ``cdata``, ``comment``, ``pi`` (``name``, ``text``).

Defined cases: null text is empty; a null name of ``end`` closes whatever is open;
unknown events are errors; a document without events has no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.session import values

NAME = re.compile(r"(?:[^\W\d]|_)[\w.\-·]*(?::(?:[^\W\d]|_)[\w.\-·]*)?").fullmatch
WRITTEN = pa.schema([("doc_id", pa.int64()), ("xml", pa.string()), ("error", pa.string()), ("error_seq", pa.int64())])


class WriterError(ValueError):
    """An event that can't come where it stands."""


class Writer:
    """States: before the document element, in a start tag, in content, behind the document element."""

    def __init__(self, indent: str | None = None):
        self.out: list[str] = []
        self.open: list[str] = []
        self.attributes: set[str] | None = None
        self.done = False
        self.indent = indent
        #: For each open element whether it holds text, so that nothing is indented there.
        self.mixed: list[bool] = []
        self.filled: list[bool] = []

    def event(self, kind: str, name: str | None, text: str | None) -> None:
        step = getattr(self, f"on_{kind}", None)
        if step is None:
            raise WriterError(f"unknown event {kind}")
        step(name, text or "")

    def named(self, name: str | None) -> str:
        if not name or not NAME(name):
            raise WriterError(f"no name: {name}")
        return name

    def content(self) -> None:
        """The start tag, if one is being written, ends."""
        if self.attributes is not None:
            self.out.append(">")
            self.attributes = None

    def line(self) -> None:
        if self.indent is not None and self.out and not (self.mixed and self.mixed[-1]):
            self.out.append("\n" + self.indent * len(self.open))

    def child(self) -> None:
        self.content()
        self.line()
        if self.filled:
            self.filled[-1] = True

    def on_start(self, name: str | None, _: str) -> None:
        name = self.named(name)
        if self.done:
            raise WriterError(f"second document element {name}")
        self.child()
        self.out.append(f"<{name}")
        self.open.append(name)
        self.mixed.append(False)
        self.filled.append(False)
        self.attributes = set()

    def on_attr(self, name: str | None, text: str) -> None:
        name = self.named(name)
        if self.attributes is None:
            raise WriterError(f"attribute {name} outside a start tag")
        if name in self.attributes:
            raise WriterError(f"attribute {name} twice")
        self.attributes.add(name)
        self.out.append(f' {name}="{escape(text, ESCAPES)}"')

    def on_end(self, name: str | None, _: str) -> None:
        if not self.open:
            raise WriterError("end of nothing")
        if name is not None and name != self.open[-1]:
            raise WriterError(f"end of {name} in {self.open[-1]}")
        last, mixed, filled = self.open.pop(), self.mixed.pop(), self.filled.pop()
        if self.attributes is not None:
            self.out.append("/>")
            self.attributes = None
        else:
            if filled and not mixed and self.indent is not None:
                self.line()
            self.out.append(f"</{last}>")
        self.done = not self.open

    def inside(self, what: str) -> None:
        if not self.open:
            raise WriterError(f"{what} outside the document element")
        self.content()
        self.mixed[-1] = True

    def on_text(self, _: str | None, text: str) -> None:
        if text.strip() or self.open:
            self.inside("text")
            self.out.append(escape(text, {"\r": "&#13;"}))

    def on_cdata(self, _: str | None, text: str) -> None:
        self.inside("cdata")
        self.out.append("<![CDATA[" + text.replace("]]>", "]]]]><![CDATA[>") + "]]>")

    def on_comment(self, _: str | None, text: str) -> None:
        if "--" in text or text.endswith("-"):
            raise WriterError("comment with --")
        self.child()
        self.out.append(f"<!--{text}-->")

    def on_pi(self, name: str | None, text: str) -> None:
        name = self.named(name)
        if name.lower() == "xml" or "?>" in text:
            raise WriterError(f"no instruction: {name}")
        self.child()
        self.out.append(f"<?{name}{' ' * bool(text)}{text}?>")

    def finish(self) -> str:
        while self.open:
            self.on_end(None, "")
        if not self.done:
            raise WriterError("no document element")
        return "".join(self.out)


# What attributes escape besides the usual.
ESCAPES = {'"': "&quot;", "\t": "&#9;", "\n": "&#10;", "\r": "&#13;"}


def write(events: DataFrame, indent: str | None = None, whole: bool = False) -> DataFrame:
    """``doc_id, xml, error, error_seq`` of ``events(doc_id, seq, event, name, text)``; ``seq`` may be of any type that sorts, ``error_seq`` counts a document's events.

    ``whole`` documents lie in one part each, as those of a reader do, and are not shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, writer, failed, started, seq = None, Writer(indent), None, False, -1

        def finish() -> tuple:
            if failed:
                return doc, None, *failed
            try:
                return doc, writer.finish(), None, None
            except WriterError as e:
                return doc, None, str(e), None

        for b in batches:
            out = []
            for d, kind, name, text in zip(*map(values, b.columns), strict=True):
                if not started or d != doc:
                    if started:
                        out.append(finish())
                    doc, writer, failed, started, seq = d, Writer(indent), None, True, -1
                seq += 1
                if not failed:
                    try:
                        writer.event(kind, name, text)
                    except WriterError as e:
                        failed = str(e), seq
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), WRITTEN, strict=True)], schema=WRITTEN)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(finish(), WRITTEN, strict=True)], schema=WRITTEN)

    rows = events.select(F.col("doc_id").cast("long"), "seq", "event", "name", "text")
    rows = rows if whole else rows.repartition("doc_id")
    return rows.sortWithinPartitions("doc_id", "seq").drop("seq").mapInArrow(run, "doc_id long, xml string, error string, error_seq long")


def events_of(nodes: DataFrame) -> DataFrame:
    """``doc_id, seq, event, name, text`` of a node table: a row a node, and one where an element ends."""
    name = F.when(F.col("prefix").isNotNull(), F.concat("prefix", F.lit(":"), "name")).otherwise(F.col("name"))
    event = F.when(F.col("kind") == "element", "start").when(F.col("kind") == "ns", "attr").otherwise(F.col("kind"))
    said = F.when(F.col("kind") == "ns", F.concat_ws(":", F.lit("xmlns"), F.when(F.col("name") != "", F.col("name")))).otherwise(name)
    none = F.lit(None).cast("string")
    row = lambda at, order, event, name, text: F.struct(F.struct(F.col(at).alias("at"), order.cast("long").alias("order")).alias("seq"), event.alias("event"), name.alias("name"), text.alias("text"))
    begin = row("pre", F.lit(0), event, said, F.when(F.col("kind") != "element", F.col("value")))
    # Ends at one place come from the inside out.
    end = row("end", F.lit(1 << 62) - F.col("pre"), F.lit("end"), name, none)
    both = F.when(F.col("kind") == "element", F.array(begin, end)).otherwise(F.array(begin))
    return nodes.where("kind <> 'document'").select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.*")
