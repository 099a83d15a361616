"""Consistency of node tables: each fault is a row, found by windows over a document's places and each parent's children: one shuffle, no join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of nodes that hold others, and that lie before all children.
INNER, BEFORE = ("document", "element"), ("attr", "ns")


def faults(nodes: DataFrame) -> DataFrame:
    """``doc_id, pre, fault`` of a node table.

    * ``no interval``: a null number, or an end before the beginning; ``leaf with an interval`` for nodes that hold none
    * ``number twice``: two nodes of a document with one ``pre``
    * ``no parent``: a parent that isn't there, or none although the node is no document
    * ``parent holds nothing``: a parent that is neither document nor element, or an attribute of a document
    * ``outside its parent``: an interval that isn't within the parent's
    * ``wrong level``: not one more than the parent's; 0 for documents
    * ``overlaps its sibling``: begins before the sibling in front has ended
    * ``attribute after a child``; ``attribute twice``: a name that the element has already
    * ``text beside text``: adjacent text nodes
    * ``without a name``: an element or attribute

    A node may have several rows. A table without rows has no fault.
    """
    own = nodes.select("doc_id", "pre", "end", "level", "parent", "kind", "ns", "name")
    # A row stands at its own place, where it tells what it is, and at its parent's, where it is told.
    side = lambda place, child: F.struct(F.col(place).alias("place"), F.lit(child).alias("child"))
    place = Window.partitionBy("doc_id", "place")
    holds = lambda c: F.when(F.col("place").isNotNull(), F.min(F.when(~F.col("child"), F.col(c))).over(place))
    sides = own.withColumn("side", F.explode(F.array(side("pre", False), side("parent", True)))).select("*", "side.*").drop("side")
    sides = sides.withColumns({"same": F.count_if(~F.col("child")).over(place), "p_end": holds("end"), "p_level": holds("level"), "p_kind": holds("kind")})
    # At its own place a row has told what it is; it goes on only if its number is there twice.
    sides = sides.where(F.col("child") | (F.col("same") > 1))
    siblings = Window.partitionBy("doc_id", "parent", "child").orderBy("pre", "end")
    before = F.col("kind").isin(*BEFORE)
    # Windows over a parent's children take no notice of the rows at their own places.
    n = sides.withColumns({
        "last_end": F.max("end").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), "last_kind": F.lag("kind").over(siblings), "child_seen": F.max(~before).over(siblings.rowsBetween(Window.unboundedPreceding, -1)),
        "named": F.count(F.lit(1)).over(Window.partitionBy("doc_id", "parent", "child", "kind", "ns", "name").orderBy("pre")),
    })
    top = F.col("kind") == "document"
    checks = {
        "no interval": F.col("pre").isNull() | F.col("end").isNull() | (F.col("end") < F.col("pre")),
        "leaf with an interval": ~F.col("kind").isin(*INNER) & (F.col("end") > F.col("pre")),
        "number twice": F.col("same") > 1,
        "no parent": ~top & F.col("p_level").isNull(),
        "parent holds nothing": ~F.col("p_kind").isin(*INNER) | (before & (F.col("p_kind") == "document")),
        "outside its parent": F.col("p_level").isNotNull() & ((F.col("pre") <= F.col("parent")) | (F.col("end") > F.col("p_end"))),
        "wrong level": F.when(top, F.col("level") != 0).otherwise(F.col("level") != F.col("p_level") + 1),
        "overlaps its sibling": F.col("parent").isNotNull() & (F.col("last_end") >= F.col("pre")),
        "attribute after a child": before & F.col("child_seen"),
        "attribute twice": (F.col("kind") == "attr") & F.col("parent").isNotNull() & (F.col("named") > 1),
        "text beside text": (F.col("kind") == "text") & (F.col("last_kind") == "text") & F.col("parent").isNotNull(),
        "without a name": F.col("kind").isin("element", "attr") & (F.coalesce("name", F.lit("")) == ""),
    }
    found = F.array_compact(F.array(*[F.when(c & (F.col("child") != (name == "number twice")), F.lit(name)) for name, c in checks.items()]))
    return n.select("doc_id", "pre", F.explode(found).alias("fault"))
