"""Operator 12: periodic runs of words, found on a harmonic grid.

A run is a stretch of words whose smallest period q fits at least twice (and at
least ``least`` words long) that no neighbouring word extends. For each period p
the places 0, p, 2p, ... are a grid; a run of period p holds two neighbours of it.
For neighbours x and x + p the longest common extension forward gives where the
stretch of period p ends, that backward where it starts. There are n/p neighbours
for p, so n log n in all. Extensions are range minima over the longest common
prefixes of neighbouring suffixes: a suffix array of the words for forward, one
of the reversed words for backward. Neighbours whose words differ are no part of a
stretch and aren't asked. A stretch of period p that fits twice and has a smaller
period q has q dividing p (Fine and Wilf) and is the run of q itself, so of equal
stretches the smallest period is kept.

The texts of an Arrow batch are one array of words, numbered apart by document, so
that nothing extends across texts and a short text costs no calls of its own.
Texts are never shuffled; a text is the unit of work. Memory is bounded by the
bytes of a batch, for a longer text by its own words (100 to 250 bytes a word,
measured, and a block of ``BLOCK`` pairs of places).

Defined cases: a null or empty text, or one of blanks, has no words, no run and
the collapsed text ''. Repeated rows give equal rows. A null ``doc_id`` stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of the shortest run.
LEAST = 12
#: Pairs of places that are looked at together, and places of a block of range minima.
BLOCK, SPAN = 1 << 20, 16

#: For a document's id and its number of words: which word stands at each place, or None for the words as they are.
Rewrite = Callable[[int | None, int], np.ndarray | None]


class RangeMin:
    """Least values of ranges: running minima inside blocks, a sparse table over the blocks."""

    def __init__(self, values: np.ndarray):
        self.values = np.full(-(-max(len(values), 1) // SPAN) * SPAN, np.iinfo(np.int32).max, np.int32)
        self.values[: len(values)] = values
        blocks = self.values.reshape(-1, SPAN)
        self.ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        rows = [blocks.min(axis=1)]
        while 2 << len(rows) - 1 <= len(blocks):
            half, last = 1 << len(rows) - 1, rows[-1]
            row = last.copy()
            row[: len(last) - half] = np.minimum(last[:-half], last[half:])
            rows.append(row)
        self.table = np.stack(rows)

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value of each ``low .. high``, both included."""
        first, last = low // SPAN, high // SPAN
        out = np.minimum(self.behind[low], self.ahead[high])
        wide = np.flatnonzero(last - first > 1)
        if len(wide):
            begin, end = first[wide] + 1, last[wide]
            level = np.frexp((end - begin).astype(np.float64))[1] - 1
            out[wide] = np.minimum(out[wide], np.minimum(self.table[level, begin], self.table[level, end - (1 << level.astype(np.int64))]))
        near = np.flatnonzero(first == last)
        if len(near):
            at, stop = low[near], high[near]
            got = self.values[at]
            while len(left := np.flatnonzero(at < stop)):
                near, at, stop, got = near[left], at[left] + 1, stop[left], got[left]
                got = np.minimum(got, self.values[at])
                out[near] = got
            same = np.flatnonzero(low == high)
            out[same] = self.values[low[same]]
        return out


class Extensions:
    """How far two suffixes agree: suffix array by doubling, common prefixes of its neighbours, range minima.

    ``stop`` is for each place where its document ends; words of different
    documents differ.
    """

    def __init__(self, words: np.ndarray, stop: np.ndarray):
        n = len(words)
        order = np.argsort(words, kind="stable")
        head = np.ones(n + 1, bool)
        head[1:n] = words[order[1:]] != words[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
        #: Ranks by the first 1, 2, 4, ... words; equal ranks are equal words, as ends of documents differ in length.
        levels = [rank.astype(np.int32)]
        size = 1
        while len(places := np.flatnonzero(~(head[:n] & head[1:]))):
            at = order[places]
            far = at + size
            second = np.where(far < stop[at], rank[np.minimum(far, n - 1)] + 1, 0)
            key = rank[at] * (n + 1) + second
            by = np.argsort(key, kind="stable")
            order[places], key = at[by], key[by]
            new = np.ones(len(places), bool)
            new[1:] = key[1:] != key[:-1]
            head[places] = new
            rank[order[places]] = np.maximum.accumulate(np.where(new, places, 0))
            size *= 2
            levels.append(rank.astype(np.int32))
        self.rank = rank
        common_prefix = np.zeros(n, np.int32)
        places = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
        a, b = order[places - 1], order[places]
        found = np.zeros(len(places), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < stop[order[places - 1]]) & (b < stop[order[places]]))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            found[same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
            levels.pop()
        common_prefix[places] = found
        self.minima = RangeMin(common_prefix)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words on which the suffixes at ``a`` and ``b`` agree; ``a`` and ``b`` differ."""
        a, b = self.rank[a], self.rank[b]
        return self.minima.least(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def smallest_periods(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its smallest period, by start and period."""
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(by), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs in ``words``, the documents of ``sizes`` words one after another, by start and period."""
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    n = len(words)
    none = np.zeros(0, np.int64)
    document = np.repeat(np.arange(len(sizes)), sizes)
    words = np.unique(document * (np.int64(words.max(initial=0)) + 1) + words, return_inverse=True)[1].astype(np.int64)
    # Periods of each document: 1 .. n/2, of documents that can hold a run at all.
    most = np.where(sizes >= least, sizes // 2, 0)
    if not most.sum():
        return none, none, none
    first, stop = firsts[document], ends[document]
    forward = Extensions(words, stop)
    backward = Extensions(words[::-1], n - first[::-1])
    whose = np.repeat(np.arange(len(sizes)), most)
    periods = np.arange(len(whose)) - np.repeat(np.cumsum(most) - most, most) + 1
    pairs = (sizes[whose] - 1) // periods
    upto = np.cumsum(pairs)
    held = [none, none, none]
    at = 0
    while at < len(whose):
        until = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, "right")))
        count = pairs[at:until]
        p = np.repeat(periods[at:until], count)
        step = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)
        x = np.repeat(firsts[whose[at:until]], count) + step * p
        same = np.flatnonzero(words[x] == words[x + p])
        at = until
        if not len(same):
            continue
        x, p = x[same], p[same]
        end = x + p + forward.of(x, x + p)
        start = x.copy()
        back = np.flatnonzero(x > first[x])
        back = back[words[x[back] - 1] == words[x[back] + p[back] - 1]]
        start[back] -= backward.of(n - x[back], n - x[back] - p[back])
        good = end - start >= np.maximum(least, 2 * p)
        if good.any():
            held = list(smallest_periods(*(np.concatenate(z) for z in zip(held, (start[good], end[good], p[good]), strict=True))))
    return tuple(held)


def numbered(texts: list[bytes], ids: list[int | None], rewrite: Rewrite | None) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, their numbers one after another, and words a text."""
    number: dict[bytes, int] = {}
    held = []
    for text, i in zip(texts, ids, strict=True):
        words = text.split()  # blanks are \x20 and \x09-\x0D
        source = rewrite(i, len(words)) if rewrite else None
        held.append(words if source is None else [words[k] for k in source.tolist()])
    flat = [number.setdefault(w, len(number)) for words in held for w in words]
    return held, np.array(flat, np.int64), np.array([len(w) for w in held], np.int64)


def periodic_runs(docs: DataFrame, *, least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` per row of ``docs``.

    ``runs`` are structs of start, length and period by start, then period.
    ``collapsed`` are the words, joined by one space, without those that any run
    contains after its first period. ``rewrite`` puts other words of a text in
    the places of its words first.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
        held, words, sizes = numbered(texts, batch.column(0).to_pylist(), rewrite)
        start, end, period = find_runs(words, sizes, least)
        ends = np.cumsum(sizes)
        firsts = ends - sizes
        # A word is dropped where more runs have begun to drop than have ended.
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, end, -1)
        kept = np.cumsum(edge[:-1]) == 0
        bounds = np.searchsorted(start, np.append(firsts, len(words))) if len(firsts) else np.zeros(1, np.int64)
        whose = np.searchsorted(ends, start, "right")
        runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(start - firsts[whose]), pa.array(end - start), pa.array(period)], fields=list(run_type)))
        collapsed = [
            b" ".join(w if low == high else [x for x, keep in zip(w, kept[a : a + len(w)].tolist(), strict=True) if keep])
            for w, a, low, high in zip(held, firsts.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        ]
        return common.record(schema, batch.column(0).cast(pa.int64()), sizes, runs, pa.array(collapsed, pa.binary()).cast(pa.string()))

    ddl = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return common.arrow_map(common.pick(docs, "doc_id", "text"), run, ddl)


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth document by the hash of its id gets a tail that repeats its first words; a null id none."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def summary(found: DataFrame) -> DataFrame:
    """Of :func:`periodic_runs`: the number of runs, the longest one (of equal ones the first, then of the smallest period), and digests of runs and collapsed text."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("m", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("m.start")).alias("start"), F.col("m.length").alias("length"), (-F.col("m.period")).alias("period"),
        F.expr("1000 * m.length div -m.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
