"""Automata over sequences of tokens: counted, optional and all-of parts, run over events by composing what stretches do.

A pattern is compiled on the driver to a deterministic automaton, its states being
what may still follow. A stretch of events is a map from states to states, and maps
compose, so a key's events need not lie in one task: ranges of (key, order) yield a
map a key, and a key's few maps are composed in order. A range's first key has a map
of all states, as it may have begun before; the others begin there, so they have the
start state's alone, and only first and last keys meet in a shuffle. Counters and all-of sets
are part of the state; ``STATES`` bounds their number. A key's maps meet in one row,
as many numbers as it spans ranges times the automaton has states.

Defined cases: a null token fits no pattern; events of equal order go by token;
a key without events has no row; an empty pattern accepts no event.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.session import values, written

#: States that a pattern may have at most.
STATES = 5_000
#: Keys' maps that are held before they are handed on.
ROWS = 10_000


class PatternError(ValueError):
    """A pattern that has too many states."""


# Patterns are tuples: ("token", t), ("sequence", p, q), ("either", p, q), ("times", p, low, high), ("all", frozenset), ("nothing",), ("never",)
NOTHING, NEVER = ("nothing",), ("never",)


def token(name: str) -> tuple:
    return ("token", name)


def sequence(*parts: tuple | str) -> tuple:
    out = NOTHING
    for p in reversed(parts):
        p = token(p) if isinstance(p, str) else p
        out = NEVER if NEVER in (p, out) else p if out == NOTHING else out if p == NOTHING else sequence(p[1], sequence(p[2], out)) if p[0] == "sequence" else ("sequence", p, out)
    return out


def either(*parts: tuple | str) -> tuple:
    """Alternatives in a fixed order, each once."""
    flat: set[tuple] = set()
    for p in parts:
        p = token(p) if isinstance(p, str) else p
        while p[0] == "either":
            flat.add(p[1])
            p = p[2]
        flat.add(p)
    flat.discard(NEVER)
    out = NEVER
    for p in sorted(flat, key=repr, reverse=True):
        out = p if out == NEVER else ("either", p, out)
    return out


def times(part: tuple | str, low: int = 0, high: int | None = None) -> tuple:
    """So many repeats; ``high`` None is any number."""
    p = token(part) if isinstance(part, str) else part
    if high == 0 or p == NOTHING:
        return NOTHING
    return p if (low, high) == (1, 1) else ("times", p, low, high)


def optional(part: tuple | str) -> tuple:
    return times(part, 0, 1)


def all_of(*parts: tuple | str) -> tuple:
    """Each part once, in any order; parts that may be empty may be left out."""
    held = [token(p) if isinstance(p, str) else p for p in parts]
    return _all(tuple(sorted(held, key=repr)))


def _all(parts: tuple) -> tuple:
    return NOTHING if not parts else parts[0] if len(parts) == 1 else ("all", parts)


def empty(p: tuple) -> bool:
    """Whether nothing fits a pattern."""
    kind = p[0]
    if kind == "sequence":
        return empty(p[1]) and empty(p[2])
    if kind == "either":
        return empty(p[1]) or empty(p[2])
    if kind == "times":
        return p[2] == 0 or empty(p[1])
    return all(map(empty, p[1])) if kind == "all" else kind == "nothing"


def after(p: tuple, t: str) -> tuple:
    """What may follow a token."""
    kind = p[0]
    if kind == "token":
        return NOTHING if p[1] == t else NEVER
    if kind == "sequence":
        first = sequence(after(p[1], t), p[2])
        return either(first, after(p[2], t)) if empty(p[1]) else first
    if kind == "either":
        return either(after(p[1], t), after(p[2], t))
    if kind == "times":
        low, high = max(0, p[2] - 1), None if p[3] is None else p[3] - 1
        return sequence(after(p[1], t), times(p[1], 0 if empty(p[1]) else low, high))
    if kind == "all":
        return either(*[sequence(after(q, t), _all(p[1][:k] + p[1][k + 1 :])) for k, q in enumerate(p[1])])
    return NEVER


def named(p: tuple) -> set[str]:
    if p[0] == "token":
        return {p[1]}
    if p[0] == "all":
        return set().union(*map(named, p[1]))
    return set().union(*(named(q) for q in p[1:] if isinstance(q, tuple)))


@dataclass
class Automaton:
    """States by number, 0 the first; ``moves[state][token number]`` is the next state or -1."""

    tokens: list[str]
    moves: list[list[int]]
    final: list[bool]

    def next(self, state: int) -> list[str]:
        """The tokens that may come in a state."""
        return [t for t, to in zip(self.tokens, self.moves[state], strict=True) if to >= 0]


def compile(pattern: tuple | str) -> Automaton:
    pattern = token(pattern) if isinstance(pattern, str) else pattern
    names = sorted(named(pattern))
    number, todo, moves = {pattern: 0}, [pattern], []
    while len(moves) < len(todo):
        row = []
        for t in names:
            to = after(todo[len(moves)], t)
            if to == NEVER:
                row.append(-1)
                continue
            if to not in number:
                if len(number) >= STATES:
                    raise PatternError(f"more than {STATES} states")
                number[to] = len(todo)
                todo.append(to)
            row.append(number[to])
        moves.append(row)
    # A state from which no end can be reached may follow nothing.
    final = [empty(p) for p in todo]
    alive = {k for k, f in enumerate(final) if f}
    while more := {k for k, row in enumerate(moves) if k not in alive and alive.intersection(row)}:
        alive |= more
    return Automaton(names, [[to if to in alive else -1 for to in row] for row in moves], final)


def run(events: DataFrame, key: str, order: Column, token_column: str, automaton: Automaton) -> DataFrame:
    """``key, n, accepted, failed_at, next`` per key of ``events``.

    ``failed_at`` is the number, from 0, of the first event that nothing allows
    (null if there is none), ``next`` what may come after the last event.
    """
    number = {t: k for k, t in enumerate(automaton.tokens)}
    states, moves = len(automaton.moves), [[*row, -1] for row in automaton.moves]
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("key", pa.string()), ("whole", pa.bool_()), ("n", pa.int64()), ("to", pa.list_(pa.int32())), ("dead", pa.list_(pa.int64()))])

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, name, n = None, 0, None, 0
        to: list[int] = []
        dead: list[int | None] = []
        alive: list[int] = []
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for b in batches:
            for p, k, t in zip(*(values(b.column(c)) for c in ("part", "key", "token")), strict=True):
                if part is None or k != name:
                    if part is not None:
                        rows.append((part, seq, name, seq > 1, n, to, dead))
                    # Only the first key may have begun in a range before, in any state; the others begin here.
                    held = states if part is None else 1
                    part, seq, name, n = p, seq + 1, k, 0
                    to, dead, alive = list(range(held)), [None] * held, list(range(held))
                if alive:
                    step, left = number.get(t, -1), []
                    for s in alive:
                        to[s] = moves[to[s]][step]
                        if to[s] < 0:
                            dead[s] = n
                        else:
                            left.append(s)
                    alive = left
                n += 1
            if len(rows) > ROWS:
                yield packed()
        if part is not None:
            rows.append((part, seq, name, False, n, to, dead))
            yield packed()

    rows = events.select(F.col(key).cast("string").alias("key"), order.alias("at"), F.col(token_column).alias("token"))
    sort = [F.col("key").asc_nulls_first(), F.col("at").asc_nulls_first(), F.col("token").asc_nulls_first()]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).select(F.spark_partition_id().cast("long").alias("part"), "key", "token")
    maps = written(placed.mapInArrow(stretch, "part long, seq long, key string, whole boolean, n long, to array<int>, dead array<long>"))
    # The first and last keys' maps, one a range that they span, composed in order; the others lie in one range.
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("dead"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "seq", "n", "to", "dead")))
    step = lambda acc, x: F.struct(
        F.when(acc["state"] < 0, -1).otherwise(F.get(x["to"], acc["state"])).alias("state"), (acc["n"] + x["n"]).alias("n"),
        F.when(acc["state"] < 0, acc["dead"]).otherwise(acc["n"] + F.get(x["dead"], acc["state"])).alias("dead"),
    )
    inner = maps.where("whole").select("key", F.struct(F.get("to", F.lit(0)).alias("state"), "n", F.get("dead", F.lit(0)).alias("dead")).alias("x"))
    done = inner.unionByName(maps.where("NOT whole").groupBy("key").agg(F.aggregate(ordered, start, step).alias("x")))
    tails = F.array(*[F.array(*map(F.lit, automaton.next(s))).cast("array<string>") for s in range(states)])
    finals = F.array(*map(F.lit, automaton.final))
    ok = F.col("x.state") >= 0
    return done.select(
        F.col("key").alias(key), F.col("x.n").alias("n"), F.coalesce(ok & F.get(finals, F.col("x.state")), F.lit(False)).alias("accepted"), F.col("x.dead").alias("failed_at"),
        F.when(ok, F.get(tails, F.col("x.state"))).alias("next"),
    )
