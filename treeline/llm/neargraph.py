"""Operator 6: embedding near-duplicates on a robust-pruned flat graph.

Vectors are compared by cosine in double precision; pairs of at least ``least``
link. Equal vectors are one class from the start and count by their number.

1. Centroids of a bounded sample cut the classes into shards that overlap: a
   class is in the shards of its nearest centroids, at most ``overlap`` of them
   and none more than ``margin`` degrees farther than the nearest, its home. Their
   number grows with the classes; beyond ``centroids`` they are a tree of two
   levels, the lower one fitted by tasks. A shard over ``shard`` classes is cut
   into parts by hash, and its classes are asked a part at a time, so no task
   holds an unbounded one.
2. In every part a graph is built: near neighbours and some far ones, each list
   pruned robustly (a candidate goes if a chosen neighbour is nearer to it by a
   factor). The lists of a class from all its shards are united.
3. Each class is searched in all parts of its home shard: greedily from the
   parts' medoids and its own node, then, from all that lies in range, on over
   the graph until nothing new does. Every link is verified by its cosine. A link
   that one side finds counts for both: the other side is credited where its own
   home doesn't hold the finder.
4. Recall is audited: a bounded sample is compared with all rows by brute force,
   over links and over rows, and the lower of the two counts. Below ``recall`` the
   index is built again with wider overlap and lists; if it stays below
   ``floor``, an error says so. The measured recall is the column ``recall``.

Work grows with the classes: each is in at most ``overlap`` parts of at most
``shard`` classes. Links leave a part as counts and as a forest, so large groups
don't become lists of pairs; a group in which very many different vectors all
link costs the square of its size in comparisons, as their number of links asks
for. Defined cases: vectors that are null, empty, zero or hold a null or
non-finite component link with nothing and are their own component; vectors of
different lengths don't link; equal vectors, repeated rows too, link with each
other; a row with a null id is linked, but no one's component.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import forest


@dataclass(frozen=True)
class Settings:
    least: float = 0.95
    #: Shards that a class is in at most, and degrees that a centroid may be farther than the nearest.
    overlap: int = 4
    margin: float = 8.0
    #: Degrees that centroids are apart at least: more than linked vectors are, so that a group of which all link has one shard.
    spread: float = 30.0
    #: Classes that one part of a shard holds.
    shard: int = 3_000
    #: Bounds of the driver's work: centroids of one level, sampled rows a centroid, bytes of a sample and of all centroids.
    centroids: int = 1_024
    rows_each: int = 24
    sample_bytes: int = 64 << 20
    centroid_bytes: int = 256 << 20
    #: Cells of the upper level in whose centroids a class looks for its nearest.
    cells: int = 6
    #: Neighbours of a node: near and far ones; candidates that they are pruned from; how strongly.
    near: int = 16
    far: int = 6
    candidates: int = 40
    alpha: float = 1.2
    beam: int = 12
    #: Rows of the audit, the recall that it asks for, and that below which there is no result.
    audit: int = 600
    recall: float = 0.97
    floor: float = 0.9


class RecallError(RuntimeError):
    """The index stays below the least recall."""


def unit_rows(vectors) -> np.ndarray:
    x = np.array(vectors, np.float64)
    # Scaled first, that squares neither overflow nor vanish.
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def prune(x: np.ndarray, node: np.ndarray, pool: np.ndarray, keep: int, alpha: float) -> np.ndarray:
    """Robust pruning of candidate lists, all rows at once; -1 fills up what is left."""
    held = x[pool]
    sims = np.matmul(held, x[node][:, :, None])[:, :, 0]
    sims[pool == node[:, None]] = -2
    order = np.argsort(-sims, axis=1, kind="stable")
    pool, sims, held = np.take_along_axis(pool, order, 1), np.take_along_axis(sims, order, 1), np.take_along_axis(held, order[:, :, None], 1)
    # Squared distances: a factor of alpha between distances is its square there.
    away, apart = np.maximum(0, 2 - 2 * sims), np.maximum(0, 2 - 2 * np.matmul(held, held.transpose(0, 2, 1)))
    alive = sims > -2
    out, rows = np.full((len(node), keep), -1, np.int32), np.arange(len(node))
    for k in range(keep):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = pool[rows, first][some]
        alive &= ~(some[:, None] & (alpha * alpha * apart[rows, first] <= away))
        alive[rows, first] = False
    return out


def build(x: np.ndarray, s: Settings) -> list[np.ndarray]:
    """Adjacency lists of a part: pruned near and far neighbours, and the reverse of all. Links are verified later, so single precision does."""
    x = x.astype(np.float32)
    n, rng = len(x), np.random.default_rng(len(x))
    lists = []
    for at in range(0, n, 256):
        node = np.arange(at, min(n, at + 256))
        sims = x[node] @ x.T
        k = min(s.candidates, n)
        pool = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        far = rng.integers(0, n, (len(node), min(3 * s.far, n)))
        lists.append(np.concatenate((prune(x, node, pool, s.near, s.alpha), prune(x, node, far, s.far, s.alpha)), axis=1))
    near = np.concatenate(lists)
    src, dst = np.repeat(np.arange(n), near.shape[1]), near.ravel().astype(np.int64)
    ok = dst >= 0
    edges = np.unique(np.concatenate((src[ok] * n + dst[ok], dst[ok] * n + src[ok])))
    return np.split(edges % n, np.searchsorted(edges // n, np.arange(1, n)))


def medoids(x: np.ndarray) -> np.ndarray:
    """About the square root of n rows, each the nearest to the mean of rows around it."""
    n = len(x)
    k = max(1, int(np.sqrt(n)))
    centers = x[np.linspace(0, n - 1, k).astype(int)]
    own = (x @ centers.T).argmax(1)
    found = []
    for j in range(k):
        if len(rows := np.flatnonzero(own == j)):
            found.append(rows[(x[rows] @ x[rows].mean(0)).argmax()])
    return np.array(found)


class Graph:
    """Adjacency as offsets and targets over the rows of ``x``."""

    def __init__(self, x: np.ndarray, lists: list[np.ndarray]):
        self.x, self.start = x, np.cumsum([0, *map(len, lists)])
        self.to = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
        self.entries = medoids(x)

    def beyond(self, q: np.ndarray, node: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours not yet seen of nodes, by query, each once; they are marked as seen."""
        size = self.start[node + 1] - self.start[node]
        k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        who, to = np.repeat(q, size), self.to[np.repeat(self.start[node], size) + k]
        new = ~seen[who, to]
        flat = np.unique(who[new] * len(self.x) + to[new])
        who, to = flat // len(self.x), flat % len(self.x)
        seen[who, to] = True
        return who, to

    def dots(self, q: np.ndarray, who: np.ndarray, to: np.ndarray) -> np.ndarray:
        out = np.empty(len(who))
        for at in range(0, len(who), 65536):
            part = slice(at, at + 65536)
            out[part] = np.einsum("ij,ij->i", q[who[part]], self.x[to[part]])
        return out

    def within(self, q: np.ndarray, own: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs in range; ``own`` is a query's own node or -1."""
        n = len(self.x)
        for at in range(0, len(q), 256):
            part, mine = q[at : at + 256], own[at : at + 256]
            b, rows = len(part), np.arange(len(part))
            seen = np.zeros((b, n), bool)
            first = self.entries[np.argsort(-(part @ self.x[self.entries].T), axis=1, kind="stable")[:, :4]]
            who, to = np.repeat(rows, first.shape[1]), first.ravel()
            who, to = np.concatenate((who, rows[mine >= 0])), np.concatenate((to, mine[mine >= 0]))
            flat = np.unique(who * n + to)
            who, to = flat // n, flat % n
            seen[who, to] = True
            ids, sims, done = np.full((b, s.beam), -1), np.full((b, s.beam), -9.0), np.ones((b, s.beam), bool)
            hits: list[tuple[np.ndarray, np.ndarray]] = []
            while len(who):
                value = self.dots(part, who, to)
                inside = value >= s.least
                hits.append((who[inside], to[inside]))
                # New nodes join the beam: at most as many as a query's longest new list.
                count = np.bincount(who, minlength=b)
                wide = np.full((b, int(count.max())), -1)
                deep = np.full(wide.shape, -9.0)
                column = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
                wide[who, column], deep[who, column] = to, value
                ids, sims, done = np.hstack((ids, wide)), np.hstack((sims, deep)), np.hstack((done, wide < 0))
                top = np.argsort(-sims, axis=1, kind="stable")[:, : s.beam]
                ids, sims, done = (np.take_along_axis(y, top, 1) for y in (ids, sims, done))
                left = ~done
                going = np.flatnonzero(left.any(1))
                turn = left[going].argmax(1)
                done[going, turn] = True
                who, to = self.beyond(going, ids[going, turn], seen)
                if not len(who) and len(going):
                    # All neighbours were known; the next nodes of the beam follow.
                    while not len(who) and (left := ~done).any():
                        going = np.flatnonzero(left.any(1))
                        turn = left[going].argmax(1)
                        done[going, turn] = True
                        who, to = self.beyond(going, ids[going, turn], seen)
            who, to = (np.concatenate(y) for y in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 2
            while len(who):
                yield who + at, to
                who, to = self.beyond(who, to, seen)
                inside = self.dots(part, who, to) >= s.least
                who, to = who[inside], to[inside]


def k_means(x: np.ndarray, k: int, spread: float, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; of centroids less than ``spread`` degrees apart that of the most rows stays, so that no dense group is cut through."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[at : at + 4096] @ c.T).argmax(1) for at in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        some = np.bincount(own, minlength=len(c)) > 0
        c[some] = total[some]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    kept: list[int] = []
    for j in np.argsort(-np.bincount(own, minlength=len(c)), kind="stable"):
        if not kept or (c[kept] @ c[j]).max() < np.cos(np.radians(spread)):
            kept.append(int(j))
    return c[kept]


@dataclass
class Cells:
    """Centroids of one vector length: of one level, or below each of ``upper`` those from ``first`` on."""

    lower: np.ndarray
    upper: np.ndarray | None = None
    first: np.ndarray | None = None

    def nearest(self, x: np.ndarray, k: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest centroids of each row and their cosines, the nearest first."""
        x = x.astype(np.float32)
        if self.upper is None:
            return top(x @ self.lower.T, k)
        held, _ = top(x @ self.upper.T, cells)
        ids, best = np.full((len(x), k), -1), np.full((len(x), k), -2, np.float32)
        for cell in np.unique(held):
            row = np.flatnonzero((held == cell).any(1))
            a, b = self.first[cell], self.first[cell + 1]
            if a == b:
                continue
            new, cosine = top(x[row] @ self.lower[a:b].T, k)
            ids_, best_ = np.hstack((ids[row], new + a)), np.hstack((best[row], cosine))
            order = np.argsort(-best_, axis=1, kind="stable")[:, :k]
            ids[row], best[row] = np.take_along_axis(ids_, order, 1), np.take_along_axis(best_, order, 1)
        return ids, best


def top(cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(cosine, order, 1)


@dataclass
class Plan:
    """Centroids by vector length, and into how many parts each shard is cut."""

    centroids: dict[int, Cells]
    parts: dict[tuple[int, int], int] = field(default_factory=dict)

    def near(self, x: np.ndarray, s: Settings) -> np.ndarray:
        """The shards of each row, its home first; -1 fills up."""
        c = self.centroids.get(x.shape[1])
        if c is None:
            return np.zeros((len(x), 1), np.int64)
        out = []
        for at in range(0, len(x), 2048):
            ids, cosine = c.nearest(x[at : at + 2048], s.overlap, s.cells)
            angle = np.degrees(np.arccos(np.clip(cosine, -1, 1)))
            out.append(np.where((angle <= angle[:, :1] + s.margin) & (cosine > -2), ids, -1))
        return np.concatenate(out)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of one length at a time: their places and their rows of length one."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        part = column if len(at) == len(sizes) else column.take(pa.array(at))
        yield at, unit_rows(part.flatten().to_numpy(zero_copy_only=False).reshape(-1, int(size)))


def vectors_of(rows: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`by_length` for a bounded table's column ``v``."""
    table = rows.toArrow()
    if len(table):
        yield from by_length(table["v"].combine_chunks())


def drawn(classes: DataFrame, rows: int, n: int) -> DataFrame:
    """About so many classes, chosen by hash."""
    return classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(min(1.0, rows / n) * (1 << 30)))


def centroids(classes: DataFrame, n: int, wide: int, s: Settings) -> dict[int, Cells]:
    """Centroids for about ``shard`` classes a shard, overlap included."""
    k = min(-(-n * s.overlap // s.shard), s.centroid_bytes // (4 * max(1, wide)))
    if k < 2:
        return {}
    bound = s.sample_bytes // (8 * max(1, wide))
    level = k if k <= s.centroids else min(s.centroids, int(np.ceil(np.sqrt(k))))
    rows = min(level * s.rows_each, bound)
    sample = drawn(classes, int(1.2 * rows) + 64, n).orderBy(F.xxhash64("rep")).limit(rows).select("v")
    upper = {x.shape[1]: k_means(x, level, s.spread).astype(np.float32) for _, x in vectors_of(sample)}
    if level == k:
        return {dim: Cells(c) for dim, c in upper.items()}
    # Two levels: each cell's sample is clustered by a task, and thinned where a cell has more than a task should hold.
    spark = classes.sparkSession
    tops, most = spark.sparkContext.broadcast(upper), bound
    cell = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("draw", pa.int64()), ("v", pa.list_(pa.float64()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draw = batch.column(0).to_numpy()
            for at, x in by_length(batch.column(1)):
                if (c := tops.value.get(x.shape[1])) is not None:
                    yield common.record(cell, np.full(len(at), x.shape[1], np.int32), (x.astype(np.float32) @ c.T).argmax(1).astype(np.int32), draw[at], listed(x))

    rows_ = drawn(classes, k * s.rows_each, n).select(F.xxhash64("rep", F.lit(2)).alias("draw"), "v")
    common.session(spark)
    dealt = common.settle(rows_.mapInArrow(assign, "dim int, cell int, draw long, v array<double>"))
    sizes = dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    thinned = dealt.join(F.broadcast(sizes), ["dim", "cell"]).where(F.pmod("draw", F.lit(1 << 30)) < F.lit(most) / F.col("n") * (1 << 30)).select("dim", "cell", "n", "v")

    def cluster(table: pa.Table) -> pa.Table:
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        c = k_means(x, max(1, min(s.centroids, round(table["n"][0].as_py() / s.rows_each))), s.spread)
        return pa.table({"dim": table["dim"].take(pa.array([0] * len(c))), "cell": table["cell"].take(pa.array([0] * len(c))), "v": listed(c)})

    found = thinned.groupBy("dim", "cell").applyInArrow(cluster, "dim int, cell int, v array<double>").toArrow().sort_by([("dim", "ascending"), ("cell", "ascending")])
    out = {}
    for dim, c in upper.items():
        mine = found.filter(pc.equal(found["dim"], dim))
        lower = mine["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
        out[dim] = Cells(lower, c, np.searchsorted(mine["cell"].to_numpy(), np.arange(len(c) + 1)))
    return out


def listed(x: np.ndarray) -> pa.ListArray:
    """Rows of one length as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


UNIT = "dim int, shard int, part int, turn int, rep long, many long, home int, data boolean, query boolean, near array<int>, v array<double>"
UNIT_SCHEMA = pa.schema([
    ("dim", pa.int32()), ("shard", pa.int32()), ("part", pa.int32()), ("turn", pa.int32()), ("rep", pa.int64()), ("many", pa.int64()), ("home", pa.int32()),
    ("data", pa.bool_()), ("query", pa.bool_()), ("near", pa.list_(pa.int32())), ("v", pa.list_(pa.float64())),
])


def sizes(classes: DataFrame, plan: Plan, s: Settings) -> dict[tuple[int, int], int]:
    """Into how many parts the shards are cut that hold more than one part should."""
    held = classes.sparkSession.sparkContext.broadcast(plan)
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("n", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for _, x in by_length(batch.column(0)):
            ids, n = np.unique(held.value.near(x, s), return_counts=True)
            out += [(x.shape[1], int(i), int(c)) for i, c in zip(ids, n, strict=True) if i >= 0]
        return common.record(schema, *map(list, zip(*out, strict=True)))

    counted = common.arrow_map(classes.select("v"), run, "dim int, shard int, n long").groupBy("dim", "shard").agg(F.sum("n").alias("n")).where(F.col("n") > s.shard).toPandas()
    return {(int(r.dim), int(r.shard)): -(-int(r.n) // s.shard) for r in counted.itertuples()}


def deal(classes: DataFrame, plan: Plan, s: Settings) -> DataFrame:
    """Rows for each unit of work: a part of a shard with the classes that are asked in it, again a part of those at home there."""
    held = classes.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, many, salt = (batch.column(k).to_numpy() for k in (0, 1, 2))
            for at, x in by_length(batch.column(3)):
                near = held.value.near(x, s)
                row, place = np.nonzero(near >= 0)
                shard = near[row, place]
                ids, which = np.unique(shard, return_inverse=True)
                parts = np.array([held.value.parts.get((x.shape[1], int(i)), 1) for i in ids], np.int64)[which]
                mine = salt[at][row] % parts
                # A class belongs to a part, whatever is asked there; and it is asked in every part of its home.
                k = np.repeat(np.arange(len(row)), parts)
                step = np.arange(len(k)) - np.repeat(np.cumsum(parts) - parts, parts)
                home, own = place[k] == 0, step == mine[k]
                asked = np.flatnonzero(home & ~own)
                k, part, turn = (np.concatenate(z) for z in ((k, k[asked]), (mine[k], step[asked]), (step, mine[k[asked]])))
                data = np.arange(len(k)) < len(home)
                query = np.concatenate((home & own, np.ones(len(asked), bool)))
                members = pa.array([m[m >= 0] for m in near.astype(np.int32)], pa.list_(pa.int32()))
                for a in range(0, len(k), 8192):
                    q = slice(a, a + 8192)
                    r = row[k[q]]
                    yield common.record(
                        UNIT_SCHEMA, np.full(len(r), x.shape[1], np.int32), shard[k[q]].astype(np.int32), part[q].astype(np.int32), turn[q].astype(np.int32),
                        rep[at][r], many[at][r], near[r, 0].astype(np.int32), pa.array(data[q]), pa.array(query[q]), members.take(pa.array(r)), listed(x[r]),
                    )

    common.session(classes.sparkSession)
    return classes.select("rep", "many", F.abs(F.xxhash64("rep") % (1 << 40)).alias("salt"), "v").mapInArrow(run, UNIT)


def adjacency(units: DataFrame, s: Settings) -> DataFrame:
    """``(rep, to)``: each class' neighbours, united over all parts that hold it."""

    def fn(table: pa.Table) -> pa.Table:
        t = table.sort_by("rep")
        rep, x = t["rep"].to_numpy(), vectors(t)
        return pa.table({"rep": pa.array(rep, pa.int64()), "to": pa.array([rep[a] for a in build(x, s)], pa.list_(pa.int64()))})

    lists = units.where("data and part = turn").select("dim", "shard", "part", "rep", "v").groupBy("dim", "shard", "part").applyInArrow(fn, "rep long, to array<long>")
    return lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to"))


def vectors(table: pa.Table) -> np.ndarray:
    return table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def search(units: DataFrame, lists: DataFrame, s: Settings) -> DataFrame:
    """``(a, b, n)``: with b null, n vectors that class a links with; else an edge of the units' forests."""

    def fn(table: pa.Table) -> pa.Table:
        t = table.sort_by("rep")
        rep, many, home = (t[c].to_numpy() for c in ("rep", "many", "home"))
        data, query = (np.flatnonzero(t[c].to_numpy(zero_copy_only=False)) for c in ("data", "query"))
        count = np.zeros(len(rep), np.int64)
        label = np.arange(len(rep))
        if len(data) and len(query):
            x, member = vectors(t), rep[data]
            known = t["to"].take(pa.array(data)).to_pylist()
            graph = Graph(x[data], [local(np.array(k or [], np.int64), member) for k in known])
            place = np.full(len(rep), -1)
            place[data] = np.arange(len(data))
            met = np.zeros((len(query), len(data)), bool)
            for q, node in graph.within(x[query], place[query], s):
                met[q, node] = True
            # Of two that are both asked here, what one finds holds for both.
            both = np.flatnonzero(place[query] >= 0)
            square = met[np.ix_(both, place[query][both])]
            met[np.ix_(both, place[query][both])] = square | square.T
            met[both, place[query][both]] = False
            count[query] += met @ many[data]
            # A class whose home doesn't hold the one that found it can't find that one itself.
            near = np.full((len(query), s.overlap), -1)
            for k, m in enumerate(t["near"].take(pa.array(query)).to_pylist()):
                near[k, : len(m)] = m
            able = np.zeros_like(met)
            for m in near.T:
                able |= m[:, None] == home[data][None]
            count[data] += many[query] @ (met & ~able)
            step = max(1, 1_000_000 // len(data))
            label = forest(len(rep), ((query[at + i], data[j]) for at in range(0, len(query), step) for i, j in [np.nonzero(met[at : at + step])]))
        child, found = np.flatnonzero(label != np.arange(len(rep))), np.flatnonzero(count)
        return pa.table({
            "a": pa.array(np.concatenate((rep[found], rep[child])), pa.int64()),
            "b": pa.array(np.concatenate((rep[found], rep[label[child]])), pa.int64(), mask=np.arange(len(found) + len(child)) < len(found)),
            "n": pa.array(np.concatenate((count[found], np.zeros(len(child), np.int64))), pa.int64()),
        })

    whole = units.join(lists.withColumn("data", F.lit(True)), ["rep", "data"], "left")
    columns = ["dim", "shard", "part", "turn", "rep", "many", "home", "data", "query", "near", "v", "to"]
    return whole.select(*columns).groupBy("dim", "shard", "part", "turn").applyInArrow(fn, "a long, b long, n long")


def local(ids: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Places of those ids that are members; ``members`` are sorted."""
    if not len(ids):
        return ids
    at = np.minimum(np.searchsorted(members, ids), len(members) - 1)
    return at[members[at] == ids]


def audit(classes: DataFrame, counts: DataFrame, s: Settings) -> float | None:
    """Recall on samples, chosen by hash and compared with all rows by brute force: over links, or as the mean over rows that have some, whichever is lower.

    One sample is of all rows and one of those with found links, so that links are
    measured where only few rows have any. None if no row of either has a link:
    then nothing is measured.
    """
    by_hash = lambda df: df.orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(s.audit).select("rep", "v")
    table = by_hash(classes).unionByName(by_hash(classes.join(counts.where("n > 0").select("rep"), "rep"))).dropDuplicates(["rep"]).toArrow()
    if not len(table):
        return None
    names = table["rep"].to_numpy()
    asked = classes.sparkSession.sparkContext.broadcast([(x, names[at]) for at, x in by_length(table["v"].combine_chunks())])
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rep, many = (batch.column(k).to_numpy() for k in (0, 1))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for at, x in by_length(batch.column(2)):
            for q, mine in asked.value:
                if q.shape[1] == x.shape[1]:
                    linked = (q @ x.T >= s.least) & (mine[:, None] != rep[at][None])
                    n = linked @ many[at]
                    out.append((mine[n > 0], n[n > 0]))
        return common.record(schema, *(np.concatenate(z) for z in zip(*out, strict=True))) if out else None

    true = common.arrow_map(classes.select("rep", "many", "v"), run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    joined = true.join(counts.select(F.col("rep"), F.col("n").alias("found")), "rep", "left").select("n", F.least("n", F.coalesce("found", F.lit(0))).alias("found"))
    right, total, mean = joined.agg(F.sum("found"), F.sum("n"), F.avg(F.col("found") / F.col("n"))).first()
    return None if not total else min(right / total, mean)


def near_duplicates(embeddings: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept, recall`` for every row of ``embeddings(vec_id, embedding)``; ``recall`` is the audit's, the same in all rows, and null where no sampled row has a link."""
    s = settings or Settings()
    rows = common.pick(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("v", F.when(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)), F.col("v")))
    # A class is named by its least id, or if all are null, by a number below zero that its vector gives.
    alone = -F.shiftrightunsigned(F.xxhash64("v"), 1) - 1
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("many"))
    classes = common.settle(classes.select(F.coalesce("least", alone).alias("rep"), "least", "many", "v"))
    n, wide = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    recall: float | None = None
    for k in range(3):
        if k:
            s = replace(s, margin=1.5 * s.margin, overlap=2 * s.overlap, near=2 * s.near, far=2 * s.far, candidates=2 * s.candidates, beam=2 * s.beam)
        counts, edges = linked(classes, n, wide, s)
        recall = audit(classes, counts, s)
        if recall is None or recall >= s.recall:
            break
    if recall is not None and recall < s.floor:
        raise RecallError(f"recall {recall:.3f} is below {s.floor} after the widest index")
    if recall is not None and recall < s.recall:
        warnings.warn(f"recall {recall:.3f} is below {s.recall} after the widest index", stacklevel=2)
    roots = common.components(edges)
    named = classes.select("rep", "least", "many").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("rep", "least", F.coalesce("root", "rep").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_rep = named.join(least, "root").select("rep", "n_links", "component_id")
    by_vector = common.settle(classes.select("rep", "many", "v").join(by_rep, "rep").select("v", "many", "n_links", "component_id"))
    # Rows without a usable vector meet nothing, so they take no part in the join.
    lone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    usable = rows.where("v is not null")
    out = common.join_groups(usable, by_vector, "v", "many", classes.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).unionByName(lone)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(recall).cast("double").alias("recall"))


def linked(classes: DataFrame, n: int, wide: int, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Links' counts by class and edges that connect what is linked."""
    plan = Plan(centroids(classes, n, wide, s))
    if n > s.shard // 2:
        plan.parts = sizes(classes, plan, s)
    units = common.settle(deal(classes, plan, s))
    lists = common.settle(adjacency(units, s))
    found = common.settle(search(units, lists, s))
    counts = common.settle(found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n")))
    return counts, found.where("b is not null").select("a", "b")
