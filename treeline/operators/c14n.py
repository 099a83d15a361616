"""Canonical XML 1.0 and exclusive canonical XML, of whole documents and of node-sets.

A document's rows are written in one pass with a stack of what is in scope and
what the output already says. A node-set is a column: rows that aren't visible
are left out, but namespaces and ``xml:`` attributes above a visible element come
from its invisible ancestors too, as the standard has it.

Defined cases: a text that isn't well-formed, null or empty is null; a document
with no visible node is the empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.nodetable import COLUMNS
from treeline.session import dealt
from treeline.sources.markup import XML_NS, read_xml

TEXT = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", "\r": "&#xD;"})
VALUE = str.maketrans({"&": "&amp;", "<": "&lt;", '"': "&quot;", "\t": "&#x9;", "\n": "&#xA;", "\r": "&#xD;"})
DOC, PRE, END, LEVEL, PARENT, KIND, NS, PREFIX, NAME, WORTH = range(10)


def named(prefix: str | None, name: str) -> str:
    return f"{prefix}:{name}" if prefix else name


def canonical(rows: list, *, exclusive: bool = False, comments: bool = False, prefixes: tuple[str, ...] = (), visible: set[int] | None = None) -> str:
    """One document's rows in order as canonical text. ``prefixes`` are treated as in the inclusive form; ``visible`` are places of the node-set."""
    seen = lambda row: visible is None or row[PRE] in visible
    owned: dict[int, list] = {}
    for row in rows:
        if row[KIND] in ("attr", "ns"):
            owned.setdefault(row[PARENT], []).append(row)
    out: list[str] = []
    #: Open elements: where they end, their end tag if they are written, namespaces in scope, namespaces said, xml: attributes in scope.
    stack: list[tuple[int, str, dict, dict, dict]] = [(1 << 62, "", {"": "", "xml": XML_NS}, {"": ""}, {})]
    root = next((r[PRE] for r in rows if r[KIND] == "element"), -1)

    def close(before: int) -> None:
        while stack[-1][0] < before:
            out.append(stack.pop()[1])

    def apart(row: list, text: str) -> str:
        """Outside the root, lines part comments and instructions from it."""
        return text if row[LEVEL] != 1 else f"{text}\n" if row[PRE] < root else f"\n{text}"

    for row in rows:
        kind = row[KIND]
        if kind in ("attr", "ns", "document"):
            continue
        close(row[PRE])
        if kind == "element":
            _, _, scope, said, xml = stack[-1]
            own = owned.get(row[PRE], [])
            scope = scope | {r[NAME]: r[WORTH] for r in own if r[KIND] == "ns"}
            attrs = [r for r in own if r[KIND] == "attr"]
            held = xml | {r[NAME]: r for r in attrs if r[NS] == XML_NS}
            if not seen(row):
                stack.append((row[END], "", scope, said, held))
                continue
            shown = [r for r in attrs if seen(r)]
            if not exclusive and visible is not None and row[PARENT] not in visible:
                mine = {r[NAME] for r in attrs if r[NS] == XML_NS}
                shown += [r for name, r in held.items() if name not in mine]
            names = {p: u for p, u in scope.items() if p != "xml"}
            if exclusive:
                used = {row[PREFIX] or "", *(r[PREFIX] for r in shown if r[PREFIX])}
                names = {p: u for p, u in names.items() if p in used or p in prefixes or (p == "" and "#default" in prefixes)}
            new = {p: u for p, u in names.items() if said.get(p, "") != u}
            tag = named(row[PREFIX], row[NAME])
            out.append(f"<{tag}")
            out += [f' xmlns{":" if p else ""}{p}="{u.translate(VALUE)}"' for p, u in sorted(new.items())]
            out += [f' {named(r[PREFIX], r[NAME])}="{r[WORTH].translate(VALUE)}"' for r in sorted(shown, key=lambda r: (r[NS] or "", r[NAME]))]
            out.append(">")
            stack.append((row[END], f"</{tag}>", scope, said | new, held))
        elif not seen(row):
            continue
        elif kind in ("text", "cdata"):
            out.append(row[WORTH].translate(TEXT))
        elif kind == "comment" and comments:
            out.append(apart(row, f"<!--{row[WORTH]}-->"))
        elif kind == "pi":
            out.append(apart(row, f"<?{row[NAME]}{' ' if row[WORTH] else ''}{row[WORTH]}?>"))
    close(1 << 61)
    return "".join(out)


Where = tuple[str, Callable[[tuple], bool]]


def any_node(row: tuple) -> bool:
    return True


def walks(path: str, namespaces: dict[str, str] | None = None) -> list[list[Where]]:
    """A union of paths from the root as axes and tests of rows: children, attributes, and nodes at or below, without predicates; others are an error."""
    from treeline.plans.xpath import Binary, Path, parse

    def test(axis: str, t: tuple) -> Callable[[tuple], bool]:
        if t == ("node",):
            return any_node
        if t[0] in ("text", "comment") and len(t) == 1:
            return lambda r: r[KIND] == t[0] or (t[0] == "text" and r[KIND] == "cdata")
        if t[0] != "name" or t[1] is not None and t[1] not in (namespaces or {}):
            raise ValueError(f"{path}: {t} is not followed row by row")
        kind, uri = "attr" if axis == "attribute" else "element", "" if t[1] is None else namespaces[t[1]]
        return lambda r: r[KIND] == kind and r[NAME] == t[2] and (r[NS] or "") == uri

    def one(e: object) -> list[list[Where]]:
        if isinstance(e, Binary) and e.op == "|":
            return one(e.left) + one(e.right)
        if not isinstance(e, Path) or e.start != "root" or e.predicates or any(x.predicates or x.axis not in ("child", "attribute", "descendant-or-self") or x.test[-1] == "*" for x in e.steps):
            raise ValueError(f"{path} is not followed row by row")
        return [[(x.axis, test(x.axis, x.test)) for x in e.steps]]

    return one(parse(path))


def visible_by(rows: list, unions: list[list[Where]]) -> set[int]:
    """Places of a document's rows, in their order, that paths lead to: a row's own and its parent's matches tell."""
    inner, attributes = [r for r in rows if r[KIND] not in ("attr", "ns")], [r for r in rows if r[KIND] == "attr"]
    root, out = {r[PRE] for r in rows[:1]}, set()
    for steps in unions:
        here = root
        for axis, test in steps:
            if axis == "descendant-or-self":
                reached = set(here)
                if here is root:
                    reached.update([r[PRE] for r in inner])
                else:
                    for r in inner:
                        if r[PARENT] in reached:
                            reached.add(r[PRE])
                here = {r[PRE] for r in rows if r[PRE] in reached and test(r)} if test is not any_node else reached
            else:
                here = {r[PRE] for r in (attributes if axis == "attribute" else inner) if r[PARENT] in here and test(r)}
        out |= here
    return out


def canonicalize(df: DataFrame, *, exclusive: bool = False, comments: bool = False, prefixes: tuple[str, ...] = (), path: str | None = None, namespaces: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, canonical`` of ``df(doc_id, text)``; with a ``path`` (:func:`walks`) of the node-set that it leads to, told where a document is parsed."""
    schema = pa.schema([("doc_id", pa.int64()), ("canonical", pa.string())])
    if path is not None:
        walks(path, namespaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unions = None if path is None else walks(path, namespaces)

        def one(i: int, text: str | None) -> str | None:
            reader = read_xml(i, text)
            if reader.tree.errors:
                return None
            return canonical(reader.rows, exclusive=exclusive, comments=comments, prefixes=prefixes, visible=None if unions is None else visible_by(reader.rows, unions))

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(i, t) for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True)], pa.string())], schema=schema)

    return dealt(df.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, canonical string")


def canonicalize_nodes(nodes: DataFrame, visible: DataFrame, *, exclusive: bool = False, comments: bool = False, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, canonical`` of the node-set ``visible`` of each document; a task holds one document at a time."""
    shown = visible.select("doc_id", "pre").distinct().withColumn("shown", F.lit(True))

    schema = pa.schema([("doc_id", pa.int64()), ("canonical", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents follow one another in order of place, whatever the batches cut."""
        held: list[tuple] = []
        for batch in batches:
            done: list[list[tuple]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][DOC] != row[DOC]:
                    done.append(held)
                    held = []
                held.append(row)
            yield written(done)
        yield written([held] if held else [])

    def written(documents: list[list[tuple]]) -> pa.RecordBatch:
        text = [canonical(rows, exclusive=exclusive, comments=comments, prefixes=prefixes, visible={r[PRE] for r in rows if r[-1]}) for rows in documents]
        return pa.RecordBatch.from_arrays([pa.array([rows[0][DOC] for rows in documents], pa.int64()), pa.array(text, pa.string())], schema=schema)

    rows = nodes.join(shown, ["doc_id", "pre"], "left").select(*COLUMNS[:10], "shown")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "pre").mapInArrow(run, "doc_id long, canonical string")
