"""DEFLATE blocks bit by bit: exact sizes of stored, fixed and dynamic blocks, split points, and the stream itself.

A text's parse (``lz``) is cut where the exact bits of its parts fall; each block is
written in the way that takes fewest bits. Code lengths are told with the repeats
of which a search over the three repeat codes finds the shortest header.

Defined cases: null and empty data is one empty fixed block. A text is a unit of work.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.session import dealt

from .codec import code_lengths, codes
from .lz import Found, Sums, code_bits, distance_code, length_code, matches, search, squeeze

# The order in which lengths of code-length codes are told, and the extra bits of the three repeats.
ORDER = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15]
PLACE = {s: k for k, s in enumerate(ORDER)}
REPEATS = {16: 2, 17: 3, 18: 7}
END, STORED_MOST = 256, 65_535
#: Cuts of one text at most, and symbols of the shortest block that is cut.
CUTS, SHORTEST = 14, 20

Store = list[tuple[int, int]]


def fixed_lengths() -> tuple[list[int], list[int]]:
    return [8] * 144 + [9] * 112 + [7] * 24 + [8] * 8, [5] * 30


def histogram(store: Store) -> tuple[list[int], list[int], int]:
    """Counts of literal and distance symbols with the end of the block, and the extra bits."""
    literal, distance, extra = Counter({END: 1}), Counter(), 0
    for a, d in store:
        if d:
            (s, b), (t, c) = length_code(a), distance_code(d)
            literal[s] += 1
            distance[t] += 1
            extra += b + c
        else:
            literal[a] += 1
    return [literal[k] for k in range(286)], [distance[k] for k in range(30)], extra


def lengths(counts: list[int], most: int) -> list[int]:
    """Lengths of an optimal code: by merging the two rarest, unless that goes beyond ``most`` bits."""
    out = [0] * len(counts)
    for k, n in lengths_of({k: n for k, n in enumerate(counts) if n}, most, len(counts)).items():
        out[k] = n
    return out


def lengths_of(counts: dict[int, int], most: int, size: int) -> dict[int, int]:
    """:func:`lengths` of the symbols, below ``size``, that are counted at all."""
    if len(counts) < 3:
        return dict.fromkeys(counts, 1)
    heap = [(n, k) for k, n in counts.items()]
    heapq.heapify(heap)
    above: dict[int, int] = {}
    new = size
    while len(heap) > 1:
        a, x = heapq.heappop(heap)
        b, y = heap[0]
        above[x] = above[y] = new
        heapq.heapreplace(heap, (a + b, new))
        new += 1
    depth = {new - 1: 0}
    for k in range(new - 2, size - 1, -1):
        depth[k] = depth[above[k]] + 1
    out = {k: depth[above[k]] + 1 for k in counts}
    if max(out.values()) <= most:
        return out
    used = sorted(out)
    return dict(zip(used, code_lengths([counts[k] for k in used], most), strict=True))


def trees(literal: list[int], distance: list[int]) -> tuple[list[int], list[int]]:
    """Code lengths of a dynamic block; a distance code is told even if none is used."""
    a, b = lengths(literal, 15), lengths(distance, 15)
    # Old readers ask for two distance codes.
    for k in (0, 1):
        if sum(n > 0 for n in b) < 2 and not b[k]:
            b[k] = 1
    return a, b


def repeated(lengths: list[int], use: tuple[bool, bool, bool]) -> list[tuple[int, int]]:
    """Code lengths as symbols and extra values, with the repeats that may be used."""
    out, at = [], 0
    while at < len(lengths):
        value, run = lengths[at], 1
        while at + run < len(lengths) and lengths[at + run] == value:
            run += 1
        at += run
        if value == 0:
            while use[2] and run >= 11:
                n = min(run, 138)
                out.append((18, n - 11))
                run -= n
            while use[1] and run >= 3:
                n = min(run, 10)
                out.append((17, n - 3))
                run -= n
        elif use[0] and run >= 4:
            out.append((value, 0))
            run -= 1
            while run >= 3:
                n = min(run, 6)
                out.append((16, n - 3))
                run -= n
        out += [(value, 0)] * run
    return out


def header(a: list[int], b: list[int]) -> tuple[int, list[tuple[int, int]], list[int], int, int]:
    """The shortest way to tell the code lengths: bits, symbols, their own code lengths, and how many lengths of each tree."""
    n_literal = max(257, max(k + 1 for k, x in enumerate(a) if x))
    n_distance = max(1, max((k + 1 for k, x in enumerate(b) if x), default=1))
    best = None
    for ways in range(8):
        symbols = repeated(a[:n_literal] + b[:n_distance], (bool(ways & 1), bool(ways & 2), bool(ways & 4)))
        counts = Counter(s for s, _ in symbols)
        own = lengths([counts[k] for k in range(19)], 7)
        told = max(4, max(k + 1 for k, s in enumerate(ORDER) if own[s]))
        bits = 14 + 3 * told + sum(own[s] + REPEATS.get(s, 0) for s, _ in symbols)
        if best is None or bits < best[0]:
            best = bits, symbols, own, n_literal, n_distance
    return best


@functools.cache
def zeros(run: int, tens: bool, hundreds: bool) -> tuple[int, int, int]:
    """How many zeros, short and long repeats tell a run of zeros, with the repeats that may be used."""
    said = Counter(s for s, _ in repeated([0] * run, (False, tens, hundreds)))
    return said[0], said[17], said[18]


def header_bits(a: dict[int, int], b: dict[int, int]) -> int:
    """The bits of :func:`header`, counted from the runs of lengths alone."""
    n_literal = max(257, max(a) + 1)
    spots = [(k, a[k]) for k in sorted(a)] + [(n_literal + k, b[k]) for k in sorted(b)]
    gaps: Counter = Counter()
    plain: Counter = Counter()  # without repeats of lengths
    told: Counter = Counter()  # with them
    at, value, run = 0, 0, 0
    for spot, n in [*spots, (spots[-1][0] + 1, 0)]:
        if spot == at and n == value:
            run += 1
        else:
            if run:
                plain[value] += run
                many, left = divmod(run - 1, 6) if run >= 4 else (0, run - 1)
                if run >= 4 and left >= 3:
                    many, left = many + 1, 0
                told[value] += 1 + left
                told[16] += many
            if spot > at:
                gaps[spot - at] += 1
            value, run = n, 1
        at = spot + 1
    best, seen = None, set()
    for tens, hundreds in ((False, False), (True, False), (False, True), (True, True)):
        none = few = lot = 0
        for gap, times in gaps.items():
            x, y, z = zeros(gap, tens, hundreds)
            none, few, lot = none + times * x, few + times * y, lot + times * z
        if (none, few, lot) in seen:
            continue
        seen.add((none, few, lot))
        for way in (plain, told) if told[16] else (plain,):
            counts = {k: n for k, n in {**way, 0: none, 17: few, 18: lot}.items() if n}
            last = max(4, max(PLACE[k] for k in counts) + 1)
            bits = 14 + 3 * last + code_bits(counts.values(), 7) + 2 * counts.get(16, 0) + 3 * few + 7 * lot
            if best is None or bits < best:
                best = bits
    return best


def stored_bits(size: int, at: int = 0) -> int:
    """Bits of stored blocks that begin at a bit of a byte."""
    total, left = 0, size
    while True:
        here = min(left, STORED_MOST)
        total += 3 + (-(at + total + 3)) % 8 + 32 + 8 * here
        left -= here
        if not left:
            return total


def fixed_bits(store: Store) -> int:
    literal, distance, extra = histogram(store)
    a, b = fixed_lengths()
    return 3 + extra + sum(n * x for n, x in zip(literal, a)) + sum(n * x for n, x in zip(distance, b, strict=True))


def dynamic_bits(store: Store) -> int:
    return Stretches(store).dynamic(0, len(store))


class Stretches(Sums):
    """Exact bits of a parse's stretches as blocks, each found once."""

    def __init__(self, store: Store):
        super().__init__(store)
        of_literal, of_distance = fixed_lengths()
        self.fixed = [0]
        for a, d in store:
            self.fixed.append(self.fixed[-1] + (of_literal[length_code(a)[0]] + of_distance[distance_code(d)[0]] if d else of_literal[a]))
        self.held: dict[tuple[int, int], int] = {}
        self.told: dict[tuple[int, int], int] = {}

    def dynamic(self, a: int, b: int) -> int:
        if (a, b) not in self.told:
            self.told[a, b] = self.told_bits(a, b)
        return self.told[a, b]

    def told_bits(self, a: int, b: int) -> int:
        literal, distance, extra = self.counts(a, b)
        x, y = lengths_of(literal, 15, 286), lengths_of(distance, 15, 30)
        for k in (0, 1):
            if len(y) < 2 and k not in y:
                y[k] = 1
        return 3 + header_bits(x, y) + extra + sum(n * x[k] for k, n in literal.items()) + sum(n * y[k] for k, n in distance.items())

    @functools.cached_property
    def table(self) -> np.ndarray:
        """Counts of 286 literals and 30 distances before each symbol."""
        out = np.zeros((len(self.literal) + 1, 316), np.uint16)
        out[np.arange(1, len(out)), self.literal] = 1
        out[np.flatnonzero(np.diff(self.far)) + 1, np.array(self.distance, np.int64) + 286] = 1
        return out.cumsum(axis=0, dtype=np.uint16)

    def ways(self, a: int, b: int) -> dict[str, int]:
        """:func:`block_bits` of a stretch."""
        fixed = 3 + self.extra[b] - self.extra[a] + self.fixed[b] - self.fixed[a] + 7
        return {"stored": stored_bits(self.size[b] - self.size[a]), "fixed": fixed, "dynamic": self.dynamic(a, b)}

    def least(self, a: int, b: int) -> int:
        """:func:`least_bits` of a stretch."""
        if (a, b) not in self.held:
            self.held[a, b] = min(self.ways(a, b).values())
        return self.held[a, b]


def size_of(store: Store) -> int:
    return sum(a if d else 1 for a, d in store)


def block_bits(store: Store) -> dict[str, int]:
    """Exact bits of a block in each of the three ways."""
    return Stretches(store).ways(0, len(store))


def least_bits(store: Store) -> int:
    return min(block_bits(store).values())


def cutting(bits: Stretches, most: int) -> Iterator[list[tuple[int, int]]]:
    """:func:`split` of a parse: yields stretches whose bits are to be held when it goes on, returns the places.

    A stretch is cut where its bits are low: of all places if they are few, else in finer and finer steps around the lowest.
    """
    bounds, dead, held = [0, len(bits.literal)], set(), bits.held

    def sums(a: int, b: int, places: Iterable[int]) -> Iterator[list[tuple[int, int]]]:
        if wanted := [x for p in places for x in ((a, p), (p, b)) if x not in held]:
            yield wanted

    while len(bounds) - 2 < most:
        best = None
        for a, b in zip(bounds, bounds[1:]):
            if (a, b) in dead or b - a < SHORTEST:
                continue
            cost = lambda p, a=a, b=b: held[a, p] + held[p, b]
            low, high = a + 1, b - 1
            while high - low > 64:
                places = [low + (high - low) // 9 * k for k in range(10)]
                yield from sums(a, b, places)
                k = min(range(10), key=lambda k, places=places, cost=cost: cost(places[k]))
                low, high = places[max(0, k - 1)], places[min(9, k + 1)]
            yield from sums(a, b, range(low, high + 1))
            if (a, b) not in held:
                yield [(a, b)]
            at = min(range(low, high + 1), key=cost)
            gain = held[a, b] - cost(at)
            if gain <= 0:
                dead.add((a, b))
            elif best is None or gain > best[0]:
                best = gain, at
        if best is None:
            break
        bounds = sorted([*bounds, best[1]])
    return bounds[1:-1]


def splits(parses: list[Stretches], most: int = CUTS) -> list[list[int]]:
    """:func:`split` of several parses at once: what all of them ask for is counted together."""
    out: list = [None] * len(parses)
    talks = {k: cutting(p, most) for k, p in enumerate(parses)}
    while talks:
        asked = []
        for k, talk in list(talks.items()):
            try:
                asked.append((parses[k], next(talk)))
            except StopIteration as end:
                out[k] = end.value
                del talks[k]
        hold(asked)
    return out


def split(store: Store, most: int = CUTS) -> list[int]:
    """Places of a parse at which cutting lowers its bits, the block that gains most first."""
    return splits([Stretches(store)], most)[0]


# ---- bits of many stretches at once ---------------------------------------------------------------------------------

#: Symbols of a parse up to which its stretches are counted by arrays, and stretches that are counted together.
ARRAYS, TOGETHER = 4096, 4096
NEVER = 1 << 40


def depths_of(counts: np.ndarray) -> np.ndarray:
    """For each row the code lengths of :func:`lengths_of`, 0 of what isn't counted, however long; of equal counts the lower column goes first."""
    rows, wide = counts.shape
    out = np.zeros((rows, wide), np.int64)
    many = (counts > 0).sum(axis=1)
    most = int(many.max(initial=0))
    if most == 0:
        return out
    keys = np.where(counts > 0, counts.astype(np.int64) * 1024 + np.arange(wide), NEVER * 1024)
    keys.sort(axis=1)
    column = keys[:, :most] & 1023
    # Place by place: a row of an array has that place of all rows; ``low`` and ``at`` are where each row's next leaf and tree lie in them.
    leaf = np.full((most + 1, rows), NEVER, np.int64)
    leaf[:most] = (keys[:, :most] >> 10).T
    tree = np.full((most + 2, rows), NEVER, np.int64)
    of_leaf, of_tree = np.zeros((most + 1, rows), np.int32), np.zeros((most + 2, rows), np.int32)
    every = np.arange(rows)
    low, at = every.copy(), every.copy()
    leaves, trees, to_leaf, to_tree = leaf.ravel(), tree.ravel(), of_leaf.ravel(), of_tree.ravel()
    for step in range(most - 1):
        on = (many - 1 > step) * rows
        weight = 0
        for _ in (0, 1):
            x, y = leaves.take(low), trees.take(at)
            first = x <= y
            weight = weight + np.minimum(x, y)
            # What isn't taken now is written again when it is.
            to_leaf[low] = step
            to_tree[at] = step
            low += on * first
            at += on * ~first
        tree[step] = np.where(on, weight, NEVER)
    depth = np.zeros((most + 2, rows), np.int64)
    for step in range(most - 2, -1, -1):
        depth[step] = np.where(step < many - 2, depth.ravel().take(of_tree[step] * rows + every) + 1, 0)
    lengths = np.empty((most, rows), np.int64)
    for k in range(most):
        lengths[k] = np.where(k < many, depth.ravel().take(of_leaf[k] * rows + every) + 1, 0)
    lengths[:, many == 1] = (np.arange(most)[:, None] < 1).astype(np.int64)
    held = np.arange(most)[None, :] < many[:, None]
    out[np.nonzero(held)[0], column[held]] = lengths.T[held]
    return out


@functools.cache
def zero_runs() -> np.ndarray:
    """:func:`zeros` for each of the four ways and each run."""
    return np.array([[zeros(run, *way) for run in range(len(ORDER) + 320)] for way in ((False, False), (True, False), (False, True), (True, True))])


def headers(lengths: np.ndarray) -> np.ndarray:
    """:func:`header_bits` of each row of 286 literal and 30 distance code lengths."""
    rows = len(lengths)
    n_literal = np.maximum(257, 286 - (lengths[:, 285::-1] > 0).argmax(axis=1))
    n_distance = 30 - (lengths[:, :285:-1] > 0).argmax(axis=1)
    place = np.arange(317)[None, :]
    # Distances come right behind the last literal that is told.
    source = np.where(place < n_literal[:, None], place, place - n_literal[:, None] + 286)
    said = np.where(place < (n_literal + n_distance)[:, None], np.take_along_axis(lengths.astype(np.int8), np.minimum(source, 315), axis=1), np.int8(-1))
    new = np.ones(said.shape, bool)
    new[:, 1:] = said[:, 1:] != said[:, :-1]
    row, start = np.nonzero(new)
    value = said[row, start].astype(np.int64)
    run = np.diff(row * 317 + start, append=rows * 317)
    told = value > 0
    r, v, n = row[told], value[told], run[told]
    left, many = n - 1, np.zeros(len(n), np.int64)
    long = n >= 4
    many[long], left[long] = np.divmod(n[long] - 1, 6)
    more = long & (left >= 3)
    many += more
    left[more] = 0
    add = lambda at, what, size: np.bincount(at, what, size).astype(np.int64)
    plain = add(r * 16 + v, n, rows * 16).reshape(rows, 16)
    repeats = add(r * 16 + v, 1 + left, rows * 16).reshape(rows, 16)
    copies = add(r, many, rows)
    empty = value == 0
    spots = np.array([PLACE[k] + 1 for k in range(19)])
    best, seen = np.full(rows, NEVER), []
    for table in zero_runs():
        x = table[run[empty]]
        none, few, lot = said = [add(row[empty], x[:, k], rows) for k in range(3)]
        fresh = np.ones(rows, bool)
        for other in seen:
            fresh &= ~np.logical_and.reduce([a == b for a, b in zip(said, other, strict=True)])
        seen.append(said)
        for way, again, on in ((plain, np.zeros(rows, np.int64), fresh), (repeats, copies, fresh & (copies > 0))):
            if not on.any():
                continue
            c = np.column_stack([none, way[:, 1:], again, few, lot])[on]
            depth = depths_of(c)
            bits = (c * depth).sum(axis=1)
            for k in np.flatnonzero(depth.max(axis=1) > 7):
                bits[k] = code_bits([int(n) for n in c[k] if n], 7)
            last = np.maximum(4, np.where(c > 0, spots, 0).max(axis=1))
            best[on] = np.minimum(best[on], 14 + 3 * last + bits + (2 * again + 3 * few + 7 * lot)[on])
    return best


def dynamic_of(counts: np.ndarray) -> np.ndarray:
    """Bits of dynamic blocks without the symbols' extra bits, of rows of 286 literal and 30 distance counts; -1 where a code is beyond 15 bits."""
    lengths = np.zeros(counts.shape, np.int64)
    for part in (slice(0, 286), slice(286, 316)):
        used = np.flatnonzero(counts[:, part].any(axis=0)) + part.start
        if len(used):
            lengths[:, used] = depths_of(counts[:, used])
    for k in (286, 287):
        lengths[((lengths[:, 286:] > 0).sum(axis=1) < 2) & (lengths[:, k] == 0), k] = 1
    return np.where(lengths.max(axis=1) > 15, -1, 3 + headers(lengths) + (lengths * counts).sum(axis=1))


def hold(asked: list[tuple[Stretches, list[tuple[int, int]]]]) -> None:
    """Find the least bits of stretches, those of many short parses together."""
    wanted = []
    for parse, stretches in asked:
        if len(parse.literal) > ARRAYS:
            for a, b in stretches:
                parse.least(a, b)
        else:
            wanted += [(parse, a, b) for a, b in dict.fromkeys(stretches)]
    for k in range(0, len(wanted), TOGETHER):
        part = wanted[k : k + TOGETHER]
        counts = np.stack([p.table[b] for p, _, b in part]).astype(np.int64) - np.stack([p.table[a] for p, a, _ in part])
        counts[:, END] += 1
        for (parse, a, b), bits in zip(part, dynamic_of(counts).tolist(), strict=True):
            if bits >= 0:
                parse.told[a, b] = bits + parse.extra[b] - parse.extra[a]
            parse.least(a, b)


class Bits:
    """Bits written from the lowest of each byte up."""

    def __init__(self) -> None:
        self.held, self.at = 0, 0

    def put(self, value: int, size: int) -> None:
        self.held |= value << self.at
        self.at += size

    def code(self, value: int, size: int) -> None:
        """A prefix code, its first bit first."""
        self.put(int(format(value, f"0{size}b")[::-1], 2) if size else 0, size)

    def data(self) -> bytes:
        return self.held.to_bytes((self.at + 7) // 8, "little")


# The least length and distance of each symbol.
LENGTH_BASE = {s: min(n for n in range(3, 259) if length_code(n)[0] == s) for s in range(257, 286)}


def distance_base(symbol: int) -> int:
    return symbol + 1 if symbol < 4 else (2 + symbol % 2 << symbol // 2 - 1) + 1


def put_symbols(out: Bits, store: Store, a: list[int], b: list[int]) -> None:
    literal, distance = codes(a), codes(b)
    for x, d in store:
        if not d:
            out.code(literal[x], a[x])
            continue
        (s, n), (t, m) = length_code(x), distance_code(d)
        out.code(literal[s], a[s])
        out.put(x - LENGTH_BASE[s], n)
        out.code(distance[t], b[t])
        out.put(d - distance_base(t), m)
    out.code(literal[END], a[END])


def put_block(out: Bits, store: Store, data: bytes, last: bool, sizes: dict[str, int] | None = None) -> str:
    """Write a block in the way of fewest bits from here; returns which."""
    sizes = (sizes or block_bits(store)) | {"stored": stored_bits(len(data), out.at % 8)}
    way = min(("fixed", "dynamic", "stored"), key=lambda k: sizes[k])
    if way == "stored":
        for k in range(0, max(1, len(data)), STORED_MOST):
            part = data[k : k + STORED_MOST]
            out.put(int(last and k + STORED_MOST >= len(data)), 3)
            out.at += -out.at % 8
            out.put(len(part), 16)
            out.put(len(part) ^ 0xFFFF, 16)
            out.put(int.from_bytes(part, "little"), 8 * len(part))
        return way
    out.put(int(last) | {"fixed": 1, "dynamic": 2}[way] << 1, 3)
    if way == "fixed":
        put_symbols(out, store, *fixed_lengths())
        return way
    a, b = trees(*histogram(store)[:2])
    _, symbols, own, n_literal, n_distance = header(a, b)
    told = max(4, max(k + 1 for k, s in enumerate(ORDER) if own[s]))
    out.put(n_literal - 257, 5)
    out.put(n_distance - 1, 5)
    out.put(told - 4, 4)
    for s in ORDER[:told]:
        out.put(own[s], 3)
    said = codes(own)
    for s, x in symbols:
        out.code(said[s], own[s])
        out.put(x, REPEATS.get(s, 0))
    put_symbols(out, store, a, b)
    return way


def deflate(data: bytes, optimal: bool = True, found: Found | None = None) -> tuple[bytes, list[int], list[str]]:
    """The compressed stream, the bytes at which its blocks end, and the way of each block."""
    store = parsed(data, search(data) if found is None else found, optimal)
    parse = Stretches(store)
    return streamed(data, store, parse, *splits([parse]))


def parsed(data: bytes, found: Found, optimal: bool = True) -> Store:
    store = matches(data, found)
    return squeeze(data, store, found=found) if optimal and data else store


def streamed(data: bytes, store: Store, parse: Stretches, cuts: list[int]) -> tuple[bytes, list[int], list[str]]:
    """:func:`deflate` of a parse that is cut at these places."""
    bounds = [0, *cuts, len(store)]
    out, ends, ways, at = Bits(), [], [], 0
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        n = size_of(store[a:b])
        ways.append(put_block(out, store[a:b], data[at : at + n], k == len(bounds) - 2, parse.ways(a, b)))
        at += n
        ends.append(at)
    return out.data(), ends, ways


#: Texts that are cut together, and their bytes at most.
TEXTS, BYTES = 128, 1 << 16
PACKED = pa.schema([("doc_id", pa.int64()), ("packed", pa.binary()), ("ends", pa.list_(pa.int64())), ("ways", pa.list_(pa.string())), ("stored", pa.int64()), ("fixed", pa.int64()), ("dynamic", pa.int64())])


def packed(df: DataFrame) -> DataFrame:
    """``doc_id, packed, ends, ways, stored, fixed, dynamic`` of ``df(doc_id, data)``: the stream, its blocks, and the bits of the whole as one block of each way."""

    def several(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        stores, sizes = [], []
        for data in texts:
            found = search(data)
            stores.append(parsed(data, found))
            sizes.append(block_bits(matches(data, found)))
        parses = [Stretches(s) for s in stores]
        streams = [streamed(*x) for x in zip(texts, stores, parses, splits(parses), strict=True)]
        rows = [(i, *stream, *(size[k] for k in ("stored", "fixed", "dynamic"))) for i, stream, size in zip(ids, streams, sizes, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PACKED, strict=True)], schema=PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, size = [], [], 0
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(bytes(data or b""))
                size += len(texts[-1])
                if len(texts) == TEXTS or size >= BYTES:
                    yield several(ids, texts)
                    ids, texts, size = [], [], 0
            if texts:
                yield several(ids, texts)

    ddl = "doc_id long, packed binary, ends array<long>, ways array<string>, stored long, fixed long, dynamic long"
    # Work is dear a byte, so small inputs are dealt out too.
    return dealt(df.select(F.col("doc_id").cast("long"), "data")).mapInArrow(run, ddl)


def entropy(counts: list[int]) -> float:
    """Bits of all symbols by their shares: no code takes fewer."""
    total = sum(counts)
    return sum(n * (math.log2(total) - math.log2(n)) for n in counts if n)
