"""Operator 13: prefix trie of conversations from mergeable partial tries.

A node stands for a distinct sequence of first turns (role and text). Its name is
its depth and the sum of its turns' hashes times powers of a base, modulo a prime
(two sums of 60 and 61 bits, from SHA-256 of each turn). Sums of prefixes can be
taken part by part, so a conversation need not lie in one task:

1. Turns are sorted by conversation and turn into ranges; a conversation that spans
   ranges is carried on by one summary a range (count and sums), all that the
   driver fetches.
2. Each task combines its turns to a partial trie in bounded memory: a row a node
   with members counted, least member and parent. Partial tries are merged by
   node, first within groups of tasks, then over all.
3. Ends of conversations are sorted into ranges by node and id; runs of ids become
   one row, and the rows of a node meet in order. The digest of a node's ids is one
   sequence of bytes, so one task reads a node's rows, in bounded memory.
4. Sums over subtrees go bottom-up in steps of 1, 2, 4, ... levels: a node hands what
   it holds to its ancestor at that distance, so the number of rounds is the
   logarithm of the depth. Nodes of one member have one leaf and save nothing; they
   are handed up as counts and take no part in rounds.

Where many nodes share a parent or ancestor, that one's row is broadcast, at most
``common.HOT_KEYS`` and a few rows; sums of such groups are combined before they
are shuffled. The text itself is never shuffled.

Defined cases: a null role or text is empty; a null turn comes first; turns with
equal numbers are ordered by role, then by hash; repeated rows are turns of their
own; rows without conv_id belong to no conversation; no row at all gives no node,
not even the root; a conversation without turns ends at the root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.session import settle

from . import common

#: The modulus of both sums, and their bases.
MODULUS = (1 << 61) - 1
BASES = (1_000_003_019_477_361, 918_273_645_546_372_819)
INVERSES = tuple(pow(b, -1, MODULUS) for b in BASES)
#: Turns that are lent at most (a hash modulo 9), and conversations that share a lender.
LENT, SHARING = 9, 5
#: Nodes a task combines at a time, ids a row of ends holds, groups of tasks of the first merge.
NODES, IDS, GROUPS = 100_000, 20_000, 16
#: Nodes below one parent from which its row is broadcast.
HOT_ROWS = 1_000

NODE = ["depth", "k1", "k2"]


def placed(conversations: DataFrame) -> DataFrame:
    """Turns by conversation and turn, in ranges that stay: ``part`` (the range), ``conv_id, size, r1, r2``; the two hashes are of role and text."""
    rows = common.pick(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    rows = rows.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sha = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.select("conv_id", "turn", "role", F.octet_length("text").cast("long").alias("size"), sha.alias("sha"))
    number = lambda at: F.conv(F.substring("sha", at, 15), 16, 10).cast("long")
    rows = rows.select("conv_id", "turn", "role", "size", number(1).alias("r1"), number(16).alias("r2"))
    # Rows that are equal in all go to several ranges by their number in the input.
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("r1"), F.col("r2"), F.col("u")]
    return settle(rows.withColumn("u", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv_id", "size", "r1", "r2"))


def summaries(rows: DataFrame) -> dict[int, tuple[int, int, int, int, int, int]]:
    """For each range its first and last conversation, its rows, and of the last conversation's rows in it the number and the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, total, n, s1, s2, w1, w2 = None, None, None, 0, 0, 0, 0, 1, 1
        for batch in batches:
            total += batch.num_rows
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for c, r1, r2 in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "r1", "r2")), strict=True):
                if c != last:
                    first = c if first is None else first
                    last, n, s1, s2, w1, w2 = c, 0, 0, 0, 1, 1
                n, s1, s2 = n + 1, (s1 + r1 * w1) % MODULUS, (s2 + r2 * w2) % MODULUS
                w1, w2 = w1 * BASES[0] % MODULUS, w2 * BASES[1] % MODULUS
        if last is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "first": [first], "last": [last], "total": [total], "n": [n], "s1": [s1], "s2": [s2]})

    got = rows.mapInArrow(run, "part long, first long, last long, total long, n long, s1 long, s2 long").collect()
    return {r.part: (r.first, r.last, r.total, r.n, r.s1, r.s2) for r in got}


def ranked(rows: DataFrame, held: dict[int, tuple[int, int, int, int, int, int]]) -> DataFrame:
    """Every turn with its number in its conversation and the sums before it and with it: ``conv_id, rank, size, q1, q2, s1, s2``."""
    starts: dict[int, tuple[int, int, int]] = {}
    conv, n, s1, s2 = None, 0, 0, 0
    for part in sorted(held):
        first, last, _, m, t1, t2 = held[part]
        if conv == first:
            starts[part] = n, s1, s2
        if conv == first == last:
            n, s1, s2 = n + m, (s1 + pow(BASES[0], n, MODULUS) * t1) % MODULUS, (s2 + pow(BASES[1], n, MODULUS) * t2) % MODULUS
        else:
            conv, n, s1, s2 = last, m, t1, t2
    schema = pa.schema([(k, pa.int64()) for k in ("conv_id", "rank", "size", "q1", "q2", "s1", "s2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun = None, False
        n = s1 = s2 = 0
        w1 = w2 = 1
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                n, s1, s2 = starts.get(batch.column("part")[0].as_py(), (0, 0, 0))
            ranks, q, s = [], ([], []), ([], [])
            conv_ids = batch.column("conv_id").to_pylist()
            for c, r1, r2 in zip(conv_ids, batch.column("r1").to_pylist(), batch.column("r2").to_pylist(), strict=True):
                if c != last:
                    if begun:
                        n = s1 = s2 = 0
                    last, begun, w1, w2 = c, True, pow(BASES[0], n, MODULUS), pow(BASES[1], n, MODULUS)
                ranks.append(n)
                q[0].append(s1)
                q[1].append(s2)
                n, s1, s2 = n + 1, (s1 + r1 * w1) % MODULUS, (s2 + r2 * w2) % MODULUS
                w1, w2 = w1 * BASES[0] % MODULUS, w2 * BASES[1] % MODULUS
                s[0].append(s1)
                s[1].append(s2)
            yield common.record(schema, conv_ids, ranks, batch.column("size").cast(pa.int64()), *q, *s)

    return rows.mapInArrow(run, "conv_id long, rank long, size long, q1 long, q2 long, s1 long, s2 long")


def lent(conv_id: int) -> int:
    """How many first turns a conversation borrows: the hash of its id modulo ``LENT``."""
    return zlib.crc32(str(conv_id).encode()) % LENT


def nobody(conv_id: int) -> int:
    """Nothing is borrowed: conversations as they are."""
    return 0


def rebuilt(turns: DataFrame, borrow=lent) -> DataFrame:
    """A row a conversation: what it borrows, and what its own turns' sums become behind that.

    Conversation c takes the first ``borrow(c)`` turns of conversation
    ``c - c % SHARING`` for as many of its own. ``heads`` are the nodes of the
    borrowed turns (root first), ``skip`` the number of own turns left out; of the
    others' sums ``s`` the new ones are ``m * s + a``, and ``move`` is what is added
    to their numbers. ``depth, k1, k2`` name the node where it ends.
    """
    first = F.when(F.col("rank") < LENT - 1, F.struct("rank", "size", "s1", "s2"))
    per = settle(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(first)).alias("own"), F.max_by(F.struct("s1", "s2"), "rank").alias("whole")))
    lender = per.select(F.col("conv_id").alias("lender"), F.col("own").alias("theirs"))
    both = per.withColumn("lender", F.col("conv_id") - F.col("conv_id") % SHARING).join(lender, "lender", "left").select("conv_id", "n", "own", "whole", "theirs")
    head = pa.struct([(k, pa.int64()) for k in ("depth", "k1", "k2", "p1", "p2", "size")])
    schema = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("heads", pa.list_(head)), *((k, pa.int64()) for k in ("skip", "move", "m1", "a1", "m2", "a2", "depth", "k1", "k2"))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x in batch.to_pylist():
            h, own, n = borrow(x["conv_id"]), x["own"], x["n"]
            theirs = (x["theirs"] or [])[:h]
            got = len(theirs)
            heads = [{"depth": 0, "k1": 0, "k2": 0, "p1": None, "p2": None, "size": 0}]
            for t in theirs:
                heads.append({"depth": t["rank"] + 1, "k1": t["s1"], "k2": t["s2"], "p1": heads[-1]["k1"], "p2": heads[-1]["k2"], "size": t["size"]})
            shift = []
            for k, sum_ in enumerate(("s1", "s2")):
                m = pow(INVERSES[k], h - got, MODULUS)
                out = own[min(h, n) - 1][sum_] if h else 0
                shift += [m, ((theirs[-1][sum_] if got else 0) - m * out) % MODULUS]
            end = heads[-1]["depth"], heads[-1]["k1"], heads[-1]["k2"]
            if n > h:
                end = got + n - h, (shift[0] * x["whole"]["s1"] + shift[1]) % MODULUS, (shift[2] * x["whole"]["s2"] + shift[3]) % MODULUS
            rows.append((x["conv_id"], n, heads, h, got - h, *shift, *end))
        return common.record(schema, *zip(*rows, strict=True))

    ddl = "conv_id long, n long, heads array<struct<depth: long, k1: long, k2: long, p1: long, p2: long, size: long>>, skip long, move long, m1 long, a1 long, m2 long, a2 long, depth long, k1 long, k2 long"
    return settle(common.arrow_map(both, run, ddl))


def partial_tries(turns: DataFrame, convs: DataFrame, total: int) -> DataFrame:
    """A row a node and task (and ``NODES`` nodes): ``depth, k1, k2, p1, p2, size, n, conv_id``, the last two its members and the least of them."""
    names = ["depth", "k1", "k2", "p1", "p2", "size", "n", "conv_id"]
    schema = pa.schema([(k, pa.int64()) for k in names])

    def emit(held: dict) -> pa.RecordBatch:
        return common.record(schema, *zip(*((*node, *rest) for node, rest in held.items()), strict=True))

    def combine(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list] = {}
        for conv, depth, k1, k2, p1, p2, size in rows:
            got = held.get((depth, k1, k2))
            if got is None:
                if len(held) >= NODES:
                    yield emit(held)
                    held.clear()
                held[depth, k1, k2] = [p1, p2, size, 1, conv]
            else:
                got[3] += 1
                got[4] = min(got[4], conv)
        if held:
            yield emit(held)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return combine((x["conv_id"], *h.values()) for batch in batches for x in batch.to_pylist() for h in x["heads"])

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for c, rank, size, q1, q2, s1, s2, move, m1, a1, m2, a2 in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                    yield c, rank + move + 1, (m1 * s1 + a1) % MODULUS, (m2 * s2 + a2) % MODULUS, (m1 * q1 + a1) % MODULUS, (m2 * q2 + a2) % MODULUS, size

        return combine(rows())

    ddl = ", ".join(f"{k} long" for k in names)
    shift = convs.select("conv_id", "n", "skip", "move", "m1", "a1", "m2", "a2")
    own = common.join_groups(turns, shift, "conv_id", "n", total).where("rank >= skip")
    own = own.select("conv_id", "rank", "size", "q1", "q2", "s1", "s2", "move", "m1", "a1", "m2", "a2")
    return convs.select("conv_id", "heads").mapInArrow(heads, ddl).unionByName(own.mapInArrow(tails, ddl))


def merged(partial: DataFrame) -> DataFrame:
    """One row a node: partial tries are merged by node within groups of tasks, then over all."""
    sums = [F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("size").alias("size"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")]
    near = partial.withColumn("part", F.spark_partition_id() % GROUPS).groupBy(*NODE, "part").agg(*sums)
    return near.groupBy(*NODE).agg(*sums)


def end_digests(convs: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends``: SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas."""
    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    order = [*NODE, "conv_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            out = []
            for *at, conv in zip(*(batch.column(k).to_pylist() for k in order), strict=True):
                if at != node or len(ids) >= IDS:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = at, []
                ids.append(conv)
            if out:
                yield common.record(schema, *zip(*out, strict=True))
        if ids:
            yield common.record(schema, *zip((*node, ids[0], ",".join(map(str, ids))), strict=True))

    digests = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *at, ids in zip(*(batch.column(k).to_pylist() for k in (*NODE, "ids")), strict=True):
                if at != node:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = at, hashlib.sha256()
                    sha.update(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield common.record(digests, *zip(*out, strict=True))
        if node:
            yield common.record(digests, *zip((*node, sha.hexdigest()), strict=True))

    spread = convs.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    packed = spread.mapInArrow(pack, "depth long, k1 long, k2 long, first long, ids string")
    return packed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "depth long, k1 long, k2 long, ends string")


def join_above(rows: DataFrame, above: DataFrame, total: int) -> DataFrame:
    """``rows`` left-joined with ``above`` by node; ``heirs`` is how many rows name a node of ``above``. Those that many name are broadcast."""
    limit = max(HOT_ROWS, total // common.HOT_KEYS)
    added = [c for c in above.columns if c not in (*NODE, "heirs")]
    named = lambda df, mark: df.select(*[F.col(c).alias(f"to_{c}") for c in NODE], *added, *mark)
    hot = rows.join(F.broadcast(named(above.where(F.col("heirs") > limit), [F.lit(True).alias("hot")])), [f"to_{c}" for c in NODE], "left")
    there = hot.where("hot").drop("hot")
    rest = hot.where("hot IS NULL").drop("hot", *added).join(named(above.where(F.col("heirs") <= limit), []), [f"to_{c}" for c in NODE], "left")
    return there.unionByName(rest)


def summed(live: DataFrame, total: int) -> DataFrame:
    """``leaves`` and ``saved`` of each node become the sums over its subtree.

    After the round of distance d a node holds the sums of its descendants that are
    fewer than 2 d levels below, and names its ancestor 2 d levels above.
    """
    deepest = live.agg(F.max("depth")).first()[0]
    live, distance = live.withColumnRenamed("p1", "u1").withColumnRenamed("p2", "u2"), 1
    while deepest is not None and distance <= deepest:
        handed = live.where(F.col("depth") >= distance).groupBy((F.col("depth") - distance).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2"))
        handed = handed.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("heirs"))
        live = live.join(handed, NODE, "left").withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
        live = settle(live.drop("more_leaves", "more_saved"))
        if 2 * distance <= deepest:
            far = live.where(F.col("depth") >= 2 * distance).drop("heirs").withColumn("to_depth", F.col("depth") - distance).withColumnsRenamed({"u1": "to_k1", "u2": "to_k2"})
            above = live.where("heirs IS NOT NULL").select(*NODE, "u1", "u2", "heirs")
            near = live.where(F.col("depth") < 2 * distance).drop("heirs")
            live = settle(join_above(far, above, total).drop("to_depth", "to_k1", "to_k2").unionByName(near))
        else:
            live = live.drop("heirs")
        distance *= 2
    return live


def prefix_trie(conversations: DataFrame, borrow=nobody) -> DataFrame:
    """A row a node of the trie of all conversations, each rebuilt by ``borrow`` first (see :func:`rebuilt`).

    Columns: ``conv_id`` the least member, ``depth``, ``parent_conv_id`` the
    parent's least member, ``n_convs`` members, ``n_children``, ``n_leaves``
    below (or itself), ``saved_tokens`` the bytes that sharing saves in its
    subtree, ``ends_sha256`` of the ids that end there.
    """
    common.session(conversations.sparkSession)
    rows = placed(conversations)
    held = summaries(rows)
    total = sum(x[2] for x in held.values())
    turns = ranked(rows, held)
    convs = rebuilt(turns, borrow)
    nodes = settle(merged(partial_tries(turns, convs, total)))
    # One aggregate adds to each node its children and its ends.
    gap = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    none = F.lit(None).cast("string").alias("ends")
    itself = nodes.select(*NODE, "p1", "p2", "size", "n", "conv_id", F.lit(0).cast("long").alias("kids"), F.lit(0).cast("long").alias("alone"), none)
    below = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), *gap("p1", "p2", "size", "n", "conv_id"), F.lit(1).cast("long").alias("kids"), (F.col("n") == 1).cast("long").alias("alone"), none)
    ends = end_digests(convs).select(*NODE, *gap("p1", "p2", "size", "n", "conv_id", "kids", "alone"), "ends")
    most = [F.max(c).alias(c) for c in ("p1", "p2", "size", "n", "conv_id", "ends")]
    whole = settle(itself.unionByName(below).unionByName(ends).groupBy(*NODE).agg(*most, F.sum("kids").alias("kids"), F.sum("alone").alias("alone")))
    # The parent's least member: of a parent with one member it is the node's own.
    shared = whole.where("n > 1").select(*NODE, F.col("conv_id").alias("above"), F.col("kids").alias("heirs"))
    named = whole.withColumn("to_depth", F.col("depth") - 1).withColumn("to_k1", F.col("p1")).withColumn("to_k2", F.col("p2"))
    named = join_above(named, shared, total).drop("to_depth", "to_k1", "to_k2")
    named = settle(named.withColumn("above", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))))
    single = named.where("n = 1").withColumn("leaves", F.lit(1).cast("long")).withColumn("saved", F.lit(0).cast("long"))
    live = named.where("n > 1").withColumn("leaves", F.col("alone") + (F.col("kids") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("size"))
    out = single.drop("p1", "p2").unionByName(summed(live, total).drop("u1", "u2"))
    return out.select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
