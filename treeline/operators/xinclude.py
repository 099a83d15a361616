"""XInclude over a table of documents: inclusions are rows, resolved by joins to a fixed point.

What an include element asks for is a unit: a document (or what a pointer finds in
it, or its text), and likewise the content of a fallback. Each unit is cut once
into literal pieces and references to other units, where the unit meets its
document in an equi-join; units that these name and that are new are cut in the
next round. Then units are put together from the leaves up: one is ready once all
that it names are, so there are as many rounds as inclusions are deep, and what is
never ready is part of a loop or includes one. No task holds more than the
documents of its rows, and no document is broadcast; a unit that very many
documents name is a skewed key of the join, which adaptive execution splits.
Libraries, pieces and units put together are written down once; which units are
ready is asked of their references alone, so the texts of a unit move once.

Included elements get ``xml:base`` and the namespaces in whose scope they were.
Pointers: a bare id, ``element()``, ``xpointer()`` with paths of names, positions and
attribute tests, and ``xmlns()`` for their prefixes.

Defined cases: what is missing, not well-formed or not found by its pointer is
replaced by the fallback; without one the document that includes it has the error,
as has every document that includes that one. A null text is missing. Of documents
with equal names the least text counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators.xpointer import XML, Outline
from treeline.session import values, written

XI = "http://www.w3.org/2001/XInclude"
INCLUDE, FALLBACK = f"{{{XI}}}include", f"{{{XI}}}fallback"
UNIT = ["href", "how", "at"]
PIECES = pa.schema([(c, pa.string()) for c in UNIT] + [("seq", pa.int32()), ("text", pa.string())] + [(f"c_{c}", pa.string()) for c in UNIT] + [("f_at", pa.string()), ("failed", pa.string()), ("waits", pa.bool_())])
DDL = "href string, how string, at string, seq int, text string, c_href string, c_how string, c_at string, f_at string, failed string, waits boolean"


def cut(href: str, how: str, at: str, text: str | None) -> list[tuple]:
    """A unit's pieces: literals, and references with the place of their fallback; or one row that says why there is none."""

    def failed(why: str) -> list[tuple]:
        return [(href, how, at, 0, None, None, None, None, None, why)]

    if text is None:
        return failed(f"{href} is missing")
    if how == "text":
        return [(href, how, at, 0, escape(text), None, None, None, None, None)]
    try:
        doc = Outline(text)
    except expat.ExpatError:
        return failed(f"{href} is not well-formed")
    out: list[tuple] = []
    includes = [p for p in doc.places if p.tag == INCLUDE]

    def literal(begin: int, end: int) -> None:
        if end > begin:
            out.append((href, how, at, len(out), doc.data[begin:end].decode(), None, None, None, None, None))

    def stretch(begin: int, end: int) -> None:
        """What lies between two places, its outermost includes as references."""
        for k, p in enumerate(includes):
            if p.begin < begin or p.begin >= end:
                continue
            literal(begin, p.begin)
            said = p.attributes
            target = urljoin(href, said["href"]) if said.get("href") else href
            kind = "text" if said.get("parse") == "text" else "xml"
            fallback = any(c.tag == FALLBACK for c in p.children)
            out.append((href, how, at, len(out), None, target, kind, said.get("xpointer", "") if kind == "xml" else "", str(k) if fallback else None, None))
            begin = p.end
        literal(begin, end)

    if how == "document":
        stretch(0, len(doc.data))
    elif how == "fallback":
        held = next(c for c in includes[int(at)].children if c.tag == FALLBACK)
        stretch(*held.inner)
    else:
        found = doc.found(at)[1] if at else [doc.root]
        if not found:
            return failed(f"{at} is not in {href}")
        for p in found:
            if p.tag == INCLUDE:
                stretch(p.begin, p.end)
                continue
            name = re.compile(rb"<[^\s/>]+").match(doc.data, p.begin).end()
            head = doc.data[p.begin : p.inner[0]]
            base = p.attributes.get(f"{XML}}}base")
            own = set(re.findall(rb"""\sxmlns(?::([^\s=]+))?\s*=""", re.sub(rb"""(=\s*)("[^"]*"|'[^']*')""", rb"\1", head)))
            added = "".join(f" xmlns{':' * bool(k)}{k}={quoteattr(v)}" for k, v in sorted(p.scope.items()) if k.encode() not in own and (k or v) and k != "xml")
            rest = doc.data[name : p.inner[0]].decode()
            if base is not None:
                rest = re.sub(r"""\sxml:base\s*=\s*("[^"]*"|'[^']*')""", "", rest)
            opening = f"{doc.data[p.begin:name].decode()}{added} xml:base={quoteattr(urljoin(href, base or ''))}{rest}"
            out.append((href, how, at, len(out), opening, None, None, None, None, None))
            stretch(p.inner[0], p.end)
    return out or [(href, how, at, 0, "", None, None, None, None, None)]


def pieces(units: DataFrame, library: DataFrame) -> DataFrame:
    """The pieces of units, each cut where it meets its document; a unit ``waits`` if it names others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for unit in zip(*map(values, b.columns), strict=True):
                got = cut(*unit)
                waits = any(r[5] is not None for r in got)
                rows += [(*r, waits) for r in got]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)] if rows else [pa.array([], f.type) for f in PIECES], schema=PIECES)

    return units.join(library, F.col("href") == F.col("name"), "left").select(*UNIT, "text").mapInArrow(run, DDL)


def all_pieces(library: DataFrame, roots: DataFrame) -> DataFrame:
    """Pieces of all units that the roots name, directly or by others."""
    new = roots.select(F.col("name").alias("href"), F.lit("document").alias("how"), F.lit("").alias("at"))
    known, out = new, None
    while not new.isEmpty():
        got = written(pieces(new, library))
        out = got if out is None else out.unionByName(got)
        named = got.where("c_href IS NOT NULL")
        children = named.select(*[F.col(f"c_{c}").alias(c) for c in UNIT])
        fallbacks = named.where("f_at IS NOT NULL").select("href", F.lit("fallback").alias("how"), F.col("f_at").alias("at"))
        new = written(children.unionByName(fallbacks).distinct().join(known, UNIT, "left_anti"))
        known = known.unionByName(new)
    return out if out is not None else pieces(new, library)


def put_together(rows: DataFrame) -> DataFrame:
    """Units ``(href, how, at, state, said)`` of pieces ``(href, how, at, seq, state, said)``: their text, or the first error."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "said"))), lambda x: x["said"]), "")
    first_error = F.min_by("said", F.when(F.col("state") != "ok", F.col("seq")))
    worst = F.max(F.when(F.col("state") == "broken", 2).when(F.col("state") == "failed", 1).otherwise(0))
    units = rows.groupBy(*UNIT).agg(worst.alias("worst"), whole.alias("whole"), first_error.alias("error"))
    return units.select(*UNIT, F.element_at(F.array(F.lit("ok"), F.lit("failed"), F.lit("broken")), F.col("worst") + 1).alias("state"), F.when(F.col("worst") == 0, F.col("whole")).otherwise(F.col("error")).alias("said"))


def expand(library: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``name, text, error``: the documents ``library(name, text)``, or those that ``roots(name)`` names, with their includes replaced."""
    library = written(library.groupBy("name").agg(F.min("text").alias("text")))
    roots = library.select("name") if roots is None else written(roots.select("name").distinct())
    left = all_pieces(library, roots)
    own = [F.when(F.col("failed").isNotNull(), "failed").otherwise("ok").alias("state"), F.coalesce("text", "failed").alias("said")]
    # Units that name no others.
    done = written(put_together(left.where("NOT waits").select(*UNIT, "seq", *own)))
    left = left.where("waits")
    named = left.where("c_href IS NOT NULL").select(*UNIT, *[f"c_{c}" for c in UNIT], "f_at")
    while True:
        child = done.select(*[F.col(c).alias(f"c_{c}") for c in UNIT], F.col("state").alias("c_state"), F.col("said").alias("c_text"))
        other = done.where("how = 'fallback'").select("href", F.col("at").alias("f_at"), F.col("state").alias("f_state"), F.col("said").alias("f_text"))
        second = (F.col("c_state") == "failed") & F.col("f_at").isNotNull()
        decided = F.when(second, F.col("f_state").isNotNull()).otherwise(F.col("c_state").isNotNull())
        asked = named.join(child.drop("c_text"), [f"c_{c}" for c in UNIT], "left").join(other.drop("f_text"), ["href", "f_at"], "left")
        ready = written(asked.groupBy(*UNIT).agg(F.bool_and(decided).alias("all")).where("all").select(*UNIT))
        if ready.isEmpty():
            break
        now = left.join(ready, UNIT, "left_semi").join(child, [f"c_{c}" for c in UNIT], "left").join(other, ["href", "f_at"], "left")
        held = F.when(second, F.col("f_state")).otherwise(F.col("c_state"))
        needs = F.col("c_href").isNotNull()
        state = F.when(needs, F.when(held == "ok", "ok").otherwise("broken")).otherwise("ok")
        said = F.when(needs, F.when(second, F.col("f_text")).otherwise(F.col("c_text"))).otherwise(F.col("text"))
        done = done.unionByName(written(put_together(now.select(*UNIT, "seq", state.alias("state"), said.alias("said")))))
        named = named.join(ready, UNIT, "left_anti")
    tops = done.where("how = 'document'").select(F.col("href").alias("name"), "state", "said")
    loop = F.concat("name", F.lit(" includes a loop"))
    return roots.join(tops, "name", "left").select(
        "name", F.when(F.col("state") == "ok", F.col("said")).alias("text"),
        F.when(F.col("state").isNull(), loop).when(F.col("state") != "ok", F.col("said")).alias("error"),
    )
