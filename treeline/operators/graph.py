"""Graphs as edge tables: layers, closure, strongly connected components, failure propagation.

Layers and closure number the nodes in the order of their keys and write the edges
down by number, once; what is told of nodes is held by number (a depth, a row of
bits), and the edges go by in their order. The others are loops of equi-joins with a
reliable checkpoint a round. Nothing is collected but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from treeline.session import settle, stored, written

#: Dependencies of unsettled nodes that the task of :func:`layers` holds.
BLOCK = 1_000_000
#: Bytes of the bits that a task of :func:`closure` holds, and pairs that it hands on at a time.
BITS, PAIRS = 32 << 20, 1 << 18
#: Bytes of a group of edges in a file; a group is read whole.
GROUP = 16 << 20


def numbered(nodes: DataFrame) -> tuple[DataFrame, str, int]:
    """``node, number`` of distinct nodes, numbered from 0 in the order of their keys, a null first; the folder of ``node, place`` in that order; how many."""
    folder = stored(settle(nodes).orderBy("node").select("node", F.monotonically_increasing_id().alias("place")))
    placed = nodes.sparkSession.read.schema(StructType([nodes.schema["node"], *nodes.sparkSession.range(0).toDF("place").schema])).parquet(folder)
    part, at = F.expr("shiftright(place, 33)"), F.expr("place & 8589934591")
    before, total = [0], 0
    for p, n in sorted(map(tuple, placed.groupBy(part).count().collect())):
        before += [total] * (p + 1 - len(before))
        before[p] = total
        total += n
    return placed.select("node", (F.element_at(F.lit(before).cast("array<long>"), (part + 1).cast("int")) + at).cast("int").alias("number")), folder, total


def by_number(steps: DataFrame, size: int) -> str:
    """The folder of ``s, d``, numbers of nodes below ``size``, in the order of ``s``."""
    spark = steps.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = steps.repartitionById(parts, F.expr(f"cast(cast(s as long) * {parts} div {max(1, size)} as int)"))
    return stored(dealt.sortWithinPartitions("s"), **{"parquet.block.size": GROUP})


def files(folder: str) -> list[tuple[pafs.FileSystem, str]]:
    """The files of a folder in their order."""
    store, root = pafs.FileSystem.from_uri(folder)
    names = sorted(f.path for f in store.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))
    return [(store, name) for name in names]


def keys_of(folder: str) -> pa.Array:
    """All nodes in the order of their numbers."""
    found = pa.concat_tables([pq.read_table(name, filesystem=store) for store, name in files(folder)]).sort_by("place")
    return found["node"].combine_chunks()


def steps_of(folder: str, down: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Each node that has steps, by number, and where they lead; from the greatest number down if asked."""
    turn = slice(None, None, -1 if down else 1)
    last, held = None, []
    for store, name in files(folder)[turn]:
        with store.open_input_file(name) as source:
            f = pq.ParquetFile(source)
            for k in range(f.num_row_groups)[turn]:
                t = f.read_row_group(k, columns=["s", "d"])
                s, d = (t[c].to_numpy() for c in ("s", "d"))
                if not len(s):
                    continue
                ends = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
                for a, b in [*zip(ends, ends[1:])][turn]:
                    if (node := int(s[a])) != last:
                        if held:
                            yield last, held[0] if len(held) == 1 else np.concatenate(held)
                        last, held = node, []
                    held.append(d[a:b])
    if held:
        yield last, held[0] if len(held) == 1 else np.concatenate(held)


def reached(folder: str, size: int, low: int, high: int) -> np.ndarray:
    """A row of bits a node: which of the nodes from ``low`` to below ``high`` it reaches.

    Edges go by in turns up and down the numbers, and a node takes what its next nodes
    have so far; where all lead the same way one turn does, else they go on until one changes nothing.
    """
    bits, some, down = np.zeros((size, -(-(high - low) // 64)), np.uint64), np.zeros(size + 1, bool), False
    while True:
        changed = back = False
        for s, to in steps_of(folder, down):
            back = back or bool((to < s).any() if down else (to > s).any())
            here = to[(to >= low) & (to < high)] - low
            through = to[some[to]]
            if not len(here) and not len(through):
                continue
            row = np.bitwise_or.reduce(bits[through], axis=0) if len(through) else np.zeros(bits.shape[1], np.uint64)
            if len(here):
                own = np.zeros(64 * len(row), np.uint8)
                own[here] = 1
                row |= np.packbits(own, bitorder="little").view(np.uint64)
            if (row & ~bits[s]).any():
                bits[s] |= row
                some[s] = changed = True
        if not (changed and back):
            return bits
        down = not down


def closure(edges: DataFrame) -> DataFrame:
    """All pairs ``(src, dst)`` with a path.

    Nodes get numbers in the order of their keys, and each task finds for all nodes which
    of its own range of numbers they reach, as bits: at most ``BITS`` bytes of them or 64
    bits a node. The edges are read from files a group at a time, so no pair meets a join
    or is written before the result.
    """
    spark = edges.sparkSession
    edges = written(edges.select("src", "dst"))
    nodes, keys, size = numbered(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    number = lambda side: nodes.select(F.col("node").alias(f"{side}_node"), F.col("number").alias(side))
    # A null is at the end of paths, as no join finds it, but never inside one: there it is a node of its own, without steps.
    steps = edges.join(number("s"), F.col("src").eqNullSafe(F.col("s_node"))).join(number("d"), F.col("dst").eqNullSafe(F.col("d_node")))
    folder = by_number(steps.select("s", F.when(F.col("dst").isNull(), size).otherwise(F.col("d")).alias("d")), size)
    wide = max(64, min(BITS * 8 // max(1, size), -(-(size + 1) // spark.sparkContext.defaultParallelism)) // 64 * 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for low in (x * wide for b in batches for x in b.column(0).to_pylist()):
            high = min(low + wide, size + 1)
            bits = reached(folder, size, low, high)
            nodes = keys_of(keys)
            nodes = pa.concat_arrays([nodes, pa.nulls(1, nodes.type)])
            rows = max(1, PAIRS // wide)
            for a in range(0, size, rows):
                s, d = np.nonzero(np.unpackbits(bits[a : a + rows].view(np.uint8), axis=1, bitorder="little"))
                if len(s):
                    yield pa.RecordBatch.from_arrays([nodes.take(pa.array(s + a)), nodes.take(pa.array(d + low))], names=["src", "dst"])

    tiles = -(-(size + 1) // wide)
    return spark.range(0, tiles, 1, tiles).mapInArrow(run, StructType([StructField("src", edges.schema["src"].dataType), StructField("dst", edges.schema["dst"].dataType)]))


def ready(held: list[tuple[int, np.ndarray]], depths: np.ndarray) -> int:
    """Settle, in ``depths``, those of the nodes held whose steps lead to settled nodes or to others of them that get settled; returns how many."""
    waits, users, done = {}, {}, []
    for node, to in held:
        open_ = set(to[depths[to] < 0].tolist())
        waits[node] = len(open_)
        for d in open_:
            users.setdefault(d, []).append(node)
        if not open_:
            done.append(node)
    steps = dict(held)
    for node in done:
        depths[node] = depths[steps[node]].max() + 1
        for user in users.get(node, ()):
            waits[user] -= 1
            if waits[user] == 0:
                done.append(user)
    return len(done)


def settled(folder: str, depths: np.ndarray) -> None:
    """Depths of all nodes that no cycle holds back, in place: -1 where not known yet, 0 for nodes without steps.

    Edges go by in turns up and down the numbers. What isn't settled as it goes by is
    held, up to ``BLOCK`` steps, and settled among itself; the next turn reads it again if that wasn't all.
    """
    down = False
    while True:
        held, steps, whole, found = [], 0, True, 0
        for s, to in steps_of(folder, down):
            if depths[s] >= 0:
                continue
            below = depths[to]
            if below.min() >= 0:
                depths[s] = below.max() + 1
                found += 1
                continue
            if held and steps + len(to) > BLOCK:
                found += ready(held, depths)
                held, steps, whole = [], 0, False
            held.append((s, to))
            steps += len(to)
        found += ready(held, depths)
        if whole or not found:
            return
        down = not down


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, depth``: a node lies one above its deepest dependency (``src`` depends on ``dst``); what a cycle holds back shares the layer after the last.

    A layer needs the ones below it, so one task reads the dependencies, sorted before by
    many, and holds four bytes a node and a group of dependencies; where these lead to
    lower keys it reads them once, else in turns up and down, whatever the depth.
    """
    spark = nodes.sparkSession
    nodes, _, size = numbered(nodes.select("node").distinct())
    number = lambda side, to: nodes.select(F.col("node").alias(side), F.col("number").alias(to))
    folder = by_number(edges.where("src <> dst").join(number("src", "s"), "src").join(number("dst", "d"), "dst").select("s", "d"), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            depths = np.zeros(size, np.int32)
            for store, name in files(folder):
                with store.open_input_file(name) as source:
                    for b in pq.ParquetFile(source).iter_batches(columns=["s"]):
                        depths[b.column(0).to_numpy()] = -1
            settled(folder, depths)
            depths[depths < 0] = depths.max(initial=-1) + 1
            for a in range(0, size, PAIRS):
                part = depths[a : a + PAIRS]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part), dtype=np.int32)), pa.array(part)], names=["number", "depth"])

    depths = spark.range(0, 1, 1, 1).mapInArrow(run, StructType([StructField("number", IntegerType()), StructField("depth", IntegerType())]))
    return depths.join(nodes, "number").select("node", "depth")


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component, size``: nodes that reach each other, named by the least of them.

    Colouring: nodes that nothing leads to, or that lead nowhere, are components
    of their own and go, as often as there are some. Then each node takes the
    least node that reaches it as its colour; what reaches a colour's own node
    within the colour is that node's component. These go too, and the rest is
    coloured again. No pairs of nodes are made; every round is an aggregate with
    partial sums and an equi-join.
    """
    edges = edges.select("src", "dst")
    nodes = settle(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    left = settle(edges.where("src <> dst").distinct())
    done: list[DataFrame] = []
    while not left.isEmpty():
        while True:  # what has no way in or no way out
            inner = left.select(F.col("src").alias("node")).intersect(left.select("dst"))
            kept = settle(left.join(inner.select(F.col("node").alias("src")), "src", "left_semi").join(inner.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        if left.isEmpty():
            break
        colour = settle(left.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("colour")))
        while True:
            offered = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("new")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("new").alias("new"))
            step = settle(colour.join(offered, "node", "left").select("node", F.least("colour", "new").alias("colour"), (F.col("new") < F.col("colour")).alias("moved")))
            colour = step.select("node", "colour")
            if step.where("moved").isEmpty():
                break
        within = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst").where("c = d").select("src", "dst")
        found = settle(reachable(within, colour.where("node = colour").select("node")).join(colour, "node").select("node", F.col("colour").alias("component")))
        done.append(found)
        gone = found.select("node")
        left = settle(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    named = nodes.select("node", F.col("node").alias("component"))
    for found in done:
        named = named.join(found.withColumnRenamed("component", "found"), "node", "left").select("node", F.coalesce("found", "component").alias("component"))
    size = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return named.join(size, "component").select("node", "component", "size")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes from which a root is reached along ``src`` depends on ``dst``, roots included: what fails if the roots do."""
    edges = settle(edges.select("src", "dst").distinct())
    known = fresh = settle(roots.select("node").distinct())
    while not fresh.isEmpty():
        found = edges.join(fresh, edges.dst == fresh.node).select(F.col("src").alias("node")).distinct()
        fresh = settle(found.join(known, "node", "left_anti"))
        known = settle(known.unionByName(fresh))
    return known
