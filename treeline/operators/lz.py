"""LZ77 parsing, costs of blocks and where to cut them."""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.session import dealt

from .codec import code_lengths

WINDOW, LONGEST, SHORTEST, TRIES = 32768, 258, 3, 64


#: For each byte the matches that begin there, nearest first: least and greatest length, and the distance at which these are first reached.
Found = list[list[tuple[int, int, int]]]


def search(data: bytes) -> Found:
    """What can be copied at each byte; it depends on the bytes alone, so all parses of a text share it."""
    heads: dict[bytes, list[int]] = {}
    out: Found = []
    n = len(data)
    for at in range(n):
        here: list[tuple[int, int, int]] = []
        if at + SHORTEST <= n:
            held = heads.setdefault(data[at : at + SHORTEST], [])
            longest, most = SHORTEST - 1, min(LONGEST, n - at)
            whole = data[at : at + most]
            for j in reversed(held[-TRIES:]):
                if at - j > WINDOW or longest == most:
                    break
                if data[j + longest] != whole[longest]:  # nearer places have all shorter lengths already
                    continue
                k = most
                if data[j : j + most] != whole:
                    k = SHORTEST
                    while data[j + k] == whole[k]:
                        k += 1
                if k > longest:
                    here.append((longest + 1, k, at - j))
                    longest = k
            held.append(at)
        out.append(here)
    return out


def matches(data: bytes, found: Found | None = None) -> list[tuple[int, int]]:
    """A greedy parse with one step of looking ahead: ``(byte, 0)`` or ``(length, distance)``."""
    found = search(data) if found is None else found
    out: list[tuple[int, int]] = []
    at, n = 0, len(data)
    while at < n:
        _, size, far = found[at][-1] if found[at] else (0, 0, 0)
        if size >= SHORTEST and size < LONGEST and at + 1 < n and found[at + 1] and found[at + 1][-1][1] > size + 1:
            size = 0  # a literal now lets a longer match follow
        if size < SHORTEST:
            out.append((data[at], 0))
            at += 1
            continue
        out.append((size, far))
        at += size
    return out


def expand(store: list[tuple[int, int]]) -> bytes:
    out = bytearray()
    for a, d in store:
        if d and d >= a:
            out += out[-d : len(out) - d + a]
        elif d:
            for _ in range(a):
                out.append(out[-d])
        else:
            out.append(a)
    return bytes(out)


def length_code(n: int) -> tuple[int, int]:
    """Symbol and extra bits of a match length."""
    d = n - 3
    if n == 258 or d < 8:
        return (285 if n == 258 else 257 + d), 0
    bits = d.bit_length() - 3
    return 257 + 4 * bits + (d >> bits), bits


SIZES = {n: length_code(n) for n in range(SHORTEST, LONGEST + 1)}


def distance_code(n: int) -> tuple[int, int]:
    d = n - 1
    if d < 4:
        return d, 0
    bits = d.bit_length() - 2
    return 2 * (bits + 1) + (d >> bits & 1), bits


class Sums:
    """A parse as symbols with running sums, so that a stretch of it is counted without reading its matches again."""

    def __init__(self, store: list[tuple[int, int]]):
        self.literal, self.distance, self.extra, self.size, self.far = [], [], [0], [0], [0]
        for a, d in store:
            extra = 0
            if d:
                (s, b), (t, c) = SIZES[a], distance_code(d)
                self.literal.append(s)
                self.distance.append(t)
                extra = b + c
            else:
                self.literal.append(a)
            self.extra.append(self.extra[-1] + extra)
            self.size.append(self.size[-1] + (a if d else 1))
            self.far.append(len(self.distance))

    def counts(self, a: int, b: int) -> tuple[Counter, Counter, int]:
        """Counts of literal and distance symbols with the end of the block, and the extra bits."""
        literal = Counter(self.literal[a:b])
        literal[256] += 1
        return literal, Counter(self.distance[self.far[a] : self.far[b]]), self.extra[b] - self.extra[a]

    def bits(self, a: int, b: int) -> int:
        """:func:`dynamic_bits` of a stretch."""
        literal, distance, extra = self.counts(a, b)
        return sum(code_bits(c.values(), 15) + 5 * len(c) for c in (literal, distance)) + extra + 17


def code_bits(counts: Iterable[int], most: int) -> int:
    """Bits of all symbols under an optimal code of at most ``most`` bits: the sums of the two rarest, merged in turn."""
    given = sorted(counts)
    if len(given) < 3:
        return sum(given)
    # Weight and height in one number; of equal weights the lower tree is first, so no tree of that sum is lower.
    leaves, merged, total, low, at, last = [n << 6 for n in given], [], 0, 0, 0, len(given)
    for _ in range(last - 1):
        pair = []
        for _ in (0, 1):
            if low < last and (at >= len(merged) or leaves[low] <= merged[at]):
                pair.append(leaves[low])
                low += 1
            else:
                pair.append(merged[at])
                at += 1
        x, y = pair
        weight = (x >> 6) + (y >> 6)
        total += weight
        merged.append(weight << 6 | min(63, max(x & 63, y & 63) + 1))
    if merged[-1] & 63 <= most:
        return total
    return sum(n * b for n, b in zip(given, code_lengths(given, most), strict=True))


def dynamic_bits(store: list[tuple[int, int]]) -> int:
    """Bits of a block with codes of its own, a flat cost for telling them included."""
    return Sums(store).bits(0, len(store))


def stored_bits(size: int) -> int:
    """Bits of a block that is only copied, in pieces of 65535 bytes."""
    return 8 * size + 40 * max(1, math.ceil(size / 65535))


def cuts(store: list[tuple[int, int]], most: int = 15) -> list[int]:
    """Places to cut a parse into blocks so that the sum of their bits falls; each cut is the best of a coarse-to-fine search."""
    blocks, done, bits = [0, len(store)], set(), functools.cache(Sums(store).bits)
    while len(blocks) - 1 < most:
        gains = []
        for a, b in zip(blocks, blocks[1:]):
            if (a, b) in done or b - a < 20:
                continue
            whole = bits(a, b)
            low, high = a + 1, b - 1
            while high - low > 8:
                places = sorted({low + (high - low) * k // 8 for k in range(9)})
                found = min(places, key=lambda p: bits(a, p) + bits(p, b))
                k = places.index(found)
                low, high = places[max(0, k - 1)], places[min(len(places) - 1, k + 1)]
            found = min(range(low, high + 1), key=lambda p: bits(a, p) + bits(p, b))
            gain = whole - bits(a, found) - bits(found, b)
            if gain > 0:
                gains.append((gain, found))
            else:
                done.add((a, b))
        if not gains:
            break
        blocks = sorted([*blocks, max(gains)[1]])
    return blocks[1:-1]


def symbol_costs(store: list[tuple[int, int]]) -> tuple[dict[int, float], dict[int, float]]:
    """Bits of each literal, length and distance symbol by its share among those of a parse; a symbol never seen costs as if seen once."""
    literal, distance = Counter({256: 1}), Counter()
    for a, d in store:
        literal[length_code(a)[0] if d else a] += 1
        if d:
            distance[distance_code(d)[0]] += 1

    def bits(counts: Counter, most: int) -> dict[int, float]:
        whole = math.log2(max(1, counts.total()))
        return {s: whole - math.log2(max(1, counts[s])) for s in range(most)}

    return bits(literal, 286), bits(distance, 30)


def cheapest(data: bytes, literal: dict[int, float], distance: dict[int, float], found: Found | None = None) -> list[tuple[int, int]]:
    """The parse of least cost under given bits of symbols: shortest path over the bytes, each length at its nearest distance."""
    found = search(data) if found is None else found
    n = len(data)
    cost, step = [0.0] + [math.inf] * n, [(0, 0)] * (n + 1)
    far_cost: dict[int, float] = {}
    of_size = [(literal[s], b) for s, b in SIZES.values()]
    for at in range(n):
        here = cost[at]
        if here + literal[data[at]] < cost[at + 1]:
            cost[at + 1], step[at + 1] = here + literal[data[at]], (data[at], 0)
        for low, high, d in found[at]:
            if d not in far_cost:
                s, b = distance_code(d)
                far_cost[d] = distance[s] + b
            far = far_cost[d]
            for size, (x, b) in enumerate(of_size[low - SHORTEST : high - SHORTEST + 1], low):
                if (c := here + x + b + far) < cost[at + size]:
                    cost[at + size], step[at + size] = c, (size, d)
    out, at = [], n
    while at:
        a, d = step[at]
        out.append((a, d))
        at -= a if d else 1
    return out[::-1]


def squeeze(data: bytes, store: list[tuple[int, int]], rounds: int = 15, found: Found | None = None) -> list[tuple[int, int]]:
    """The cheapest parse found by turns: bits of symbols from the last parse, then the parse of least cost under them, until neither falls."""
    found = search(data) if found is None else found
    best, least, last = store, dynamic_bits(store), math.inf
    for _ in range(rounds):
        store = cheapest(data, *symbol_costs(store), found)
        bits = dynamic_bits(store)
        if bits < least:
            best, least = store, bits
        if bits >= last:
            break
        last = bits
    return best


def parse(df: DataFrame) -> DataFrame:
    """``doc_id, n_symbols, n_matches, bits, split_bits, best_bits, digest, last_length, last_distance`` of ``df(doc_id, data binary)``.

    ``bits`` are of the greedy parse, ``split_bits`` of it cut into blocks,
    ``best_bits`` of the parse of least cost; ``digest`` is the MD5 of what both expand to (null if they differ).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_symbols", pa.int64()), ("n_matches", pa.int64()), ("bits", pa.float64()), ("split_bits", pa.float64()), ("best_bits", pa.float64()), ("digest", pa.string()), ("last_length", pa.int64()), ("last_distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = bytes(data or b"")
                found = search(data)
                store = matches(data, found)
                at, best, out = [0, *cuts(store), len(store)], squeeze(data, store, found=found), expand(store)
                last = next(((a, d) for a, d in reversed(store) if d), (None, None))
                same = hashlib.md5(out).hexdigest() if expand(best) == out else None
                rows.append((i, len(store), sum(d > 0 for _, d in store), dynamic_bits(store), sum(dynamic_bits(store[a:b]) for a, b in zip(at, at[1:])), dynamic_bits(best), same, *last))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    # Work is dear a byte, so small inputs are dealt out too.
    return dealt(df.select(F.col("doc_id").cast("long"), "data")).mapInArrow(run, "doc_id long, n_symbols long, n_matches long, bits double, split_bits double, best_bits double, digest string, last_length long, last_distance long")
