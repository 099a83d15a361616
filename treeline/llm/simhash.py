"""Operator 2: SimHash near-duplicates by a binary-trie self-join.

A text is lower-cased (A-Z), cut into words at ASCII white space and into
shingles of ``size`` words, repeats included. A bit of the 64-bit fingerprint is
1 if it is set in over half of the shingles' XXH64 values (seed 42). Documents
link if their fingerprints differ in at most ``errors`` bits.

Equal fingerprints are one class from the start, so copies never meet as pairs.
The classes' fingerprints are dealt out by ``errors + 1`` blocks of bits: two
fingerprints within the budget agree in at least one whole block, so all of
their link's work lies in the bucket of that block's value. Inside a bucket the
sorted fingerprints are a binary trie; pairs of its nodes are traversed
together, level by level, differing bits are added up and a pair of nodes is
dropped as soon as they exceed the budget. Links within a bucket are contracted
there and leave it as a forest, at most one edge a fingerprint. Buckets over
``BUCKET`` fingerprints are cut into parts, and each pair of parts is a unit of
work of its own, so no task holds an unbounded bucket.

Defined cases: a null or empty text has fingerprint zero and links like any
other; a text of fewer words than a shingle is one shingle; repeated rows are
copies; rows with a null id take part in links, and are no one's component id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

#: Fingerprints of a bucket that one task takes at once.
BUCKET = 40_000
#: Node pairs that the traversal holds at once.
FRONTIER = 1 << 17
#: A pair of nodes with at most so many pairs of fingerprints below it is compared directly.
DIRECT = 16
SEED = 42


def fingerprint(text: str, size: int = 4) -> int:
    """The SimHash of one text as an unsigned 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    pieces = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[k - 1 :].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, n)
    # Bytes of the same place in all hashes are counted by value; the bits follow from the 256 counts.
    value, ones = hashes.view(np.uint8).reshape(n, 8), np.zeros(64, np.int64)
    if n >= 512:
        for b in range(8):
            ones[8 * b : 8 * b + 8] = np.bincount(value[:, b], minlength=256) @ BITS_OF_BYTE
    else:
        ones[:] = np.unpackbits(value, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((2 * ones > n).astype(np.uint64) @ POWERS)


BITS_OF_BYTE = (np.arange(256)[:, None] >> np.arange(8)) & 1
POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """``(doc_id, fp)``, one row per row of ``docs``; ``fp`` is the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, size) for t in common.strings(batch.column(1))), np.uint64, batch.num_rows)
        return common.record(schema, batch.column(0).cast(pa.int64()), fps.view(np.int64))

    return common.arrow_map(common.pick(docs, "doc_id", "text"), run, "doc_id long, fp long")


def pairs_within(fps: np.ndarray, groups: np.ndarray, sides: np.ndarray, errors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one group whose fingerprints differ in at most ``errors`` bits.

    Rows are sorted by ``(groups, sides, fps)``. A group of one side joins with
    itself; of one with two sides, only rows of different sides are compared.
    """
    n = len(fps)
    if n < 2:
        return
    cut = np.flatnonzero((groups[1:] != groups[:-1]) | (sides[1:] != sides[:-1])) + 1
    lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [n]))
    same = np.flatnonzero(groups[lo[1:]] == groups[lo[:-1]])
    alone = np.setdiff1d(np.arange(len(lo)), np.concatenate((same, same + 1)))
    a, b = np.concatenate((alone, same)), np.concatenate((alone, same + 1))
    stack = [(63, lo[a], hi[a], lo[b], hi[b], np.zeros(len(a), np.int8))]
    ones: dict[int, np.ndarray] = {}

    def below(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        return ones[bit]

    while stack:
        bit, a0, a1, b0, b1, cost = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(bit, *(x[half:] for x in (a0, a1, b0, b1, cost))), (bit, *(x[:half] for x in (a0, a1, b0, b1, cost)))]
            continue
        size = (a1 - a0) * (b1 - b0)
        small = (size <= DIRECT) | (bit < 0)
        if small.any():
            yield from compare(fps, a0[small], a1[small], b0[small], b1[small], errors)
            a0, a1, b0, b1, cost = (x[~small] for x in (a0, a1, b0, b1, cost))
        if not len(a0):
            continue
        c = below(bit)
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        itself = a0 == b0
        zeros, units = (a0, am, b0, bm), (am, a1, bm, b1)
        # In a pair of a node with itself, 0-1 and 1-0 are the same pairs.
        mixed, mirror = (a0, am, bm, b1), (am, a1, b0, bm)
        kids = []
        for quad, more, keep in ((zeros, 0, True), (units, 0, True), (mixed, 1, True), (mirror, 1, ~itself)):
            ok = keep & (quad[0] < quad[1]) & (quad[2] < quad[3]) & (cost + more <= errors)
            kids.append((*(x[ok] for x in quad), cost[ok] + np.int8(more)))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*kids, strict=True))))


def compare(fps: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, errors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All fingerprints below the given node pairs, one by one, in blocks."""
    wide, size = b1 - b0, (a1 - a0) * (b1 - b0)
    bounds = np.searchsorted(np.cumsum(size), np.arange(FRONTIER, int(size.sum()) + FRONTIER, FRONTIER))
    at = 0
    for end in np.unique(np.concatenate((bounds + 1, [len(size)]))):
        end = min(int(end), len(size))
        if end <= at:
            continue
        s = size[at:end]
        k = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
        w = np.repeat(wide[at:end], s)
        i, j = np.repeat(a0[at:end], s) + k // w, np.repeat(b0[at:end], s) + k % w
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= errors
        ok &= (i < j) | (np.repeat(a0[at:end] != b0[at:end], s))
        if ok.any():
            yield i[ok], j[ok]
        at = end


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index linked to each index, over all links: blocks are contracted as they come."""
    label = np.arange(n)
    for i, j in links:
        while True:
            a, b = label[i], label[j]
            ok = a != b
            if not ok.any():
                break
            i, j, a, b = i[ok], j[ok], a[ok], b[ok]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
    return label


def link_buckets(fps: DataFrame, errors: int) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints that connect all within the budget; ``fps(fp)`` are distinct."""
    blocks = errors + 1
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    keys = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1)).alias("value")) for k in range(blocks)]
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.block", "key.value")
    large = dealt.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("block", "value", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts"))
    # A bucket has a part of its own unless it is large; then each row goes to every unit that its part is in.
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    units = dealt.join(large, ["block", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part).withColumn("other", other)
    units = units.select("fp", "block", "value", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), F.when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side"))
    unit = ["block", "value", "p", "q"]
    units = units.repartition(*unit).sortWithinPartitions(*unit, "side")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole units are gathered until there are ``BUCKET`` rows, then joined at once."""
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            group = np.concatenate(([0], np.cumsum((np.diff(rows[1:5]) != 0).any(0))))
            fp = rows[0].view(np.uint64)
            order = np.lexsort((fp, rows[5], group))
            fp, group, side = fp[order], group[order], rows[5][order]
            label = forest(len(fp), pairs_within(fp, group, side, errors))
            child = np.flatnonzero(label != np.arange(len(fp)))
            return common.record(schema, fp[child].view(np.int64), fp[label[child]].view(np.int64))

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(h.shape[1] for h in held) < BUCKET:
                continue
            rows = np.concatenate(held, axis=1)
            whole = np.flatnonzero((np.diff(rows[1:5]) != 0).any(0))
            if not len(whole):
                held = [rows]
                continue
            held = [rows[:, whole[-1] + 1 :]]
            yield flush(rows[:, : whole[-1] + 1])
        if held and (rows := np.concatenate(held, axis=1)).shape[1]:
            yield flush(rows)

    return units.mapInArrow(join, "a long, b long")


def grouped(docs: DataFrame, size: int, errors: int) -> DataFrame:
    """``doc_id, fp, root, component_id`` for every row of ``docs``; ``root`` is a fingerprint of the row's component, ``component_id`` its least doc_id."""
    rows = common.settle(fingerprints(docs, size))
    classes = common.settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    common.session(docs.sparkSession)
    edges = common.settle(link_buckets(classes.select("fp"), errors).distinct())
    roots = common.components(edges)
    linked = classes.join(roots, classes.fp == roots.node).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = linked.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    named = common.settle(classes.join(joined, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id")))
    return common.join_groups(rows, named, "fp", "n", rows.count()).select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, size: int = 4, errors: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the smallest
    doc_id reachable over links, the row's own included.
    """
    return grouped(docs, size, errors).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, *, size: int = 4, errors: int = 4) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the least id; all columns as they were.

    Where several rows of a group have that id or no row of it has one, the
    row of least text hash among them stays; ids that several groups share are
    told apart by fingerprint.
    """
    names = docs.columns
    near = common.settle(grouped(docs, size, errors))
    heads = common.settle(near.where("doc_id <=> component_id").groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp")))
    again = common.settle(near.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    alone = heads.where("doc_id is not null").join(again, "doc_id", "left_anti").select("doc_id")
    once = plain.join(alone, key == F.col("doc_id"), "left_semi")
    shared = common.settle(heads.where("doc_id is null").unionByName(heads.join(again, "doc_id", "left_semi")))
    if not shared.isEmpty():
        rows = plain.join(shared.select("doc_id").distinct(), key.eqNullSafe(F.col("doc_id")), "left_semi")
        found = marked(rows, names.index("text"), size).join(shared.withColumnRenamed("fp", "head"), key.eqNullSafe(F.col("doc_id")) & (F.col("fp") == F.col("head")))
        least = found.groupBy("root").agg(F.min_by(F.struct(*plain.columns), F.struct(F.xxhash64(text), text)).alias("row"))
        once = once.unionByName(least.select("row.*"))
    return once.toDF(*names)


def marked(rows: DataFrame, at: int, size: int) -> DataFrame:
    """All columns of ``rows`` and ``fp``, the fingerprint of the text at position ``at``."""
    names = [*rows.columns, "fp"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, size) for t in common.strings(batch.column(at))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=names)

    return common.arrow_map(rows, run, StructType([*rows.schema.fields, StructField("fp", LongType())]))
