"""Compression: containers, code lengths, block sizes and entropy."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

WINDOW_BITS = {"deflate": -15, "zlib": 15, "gzip": 31}


def compressed(data: Column, container: str = "zlib", level: int = 9) -> Column:
    """The bytes compressed into a container, in Arrow batches."""
    bits = WINDOW_BITS[container]

    @pandas_udf("binary")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for b in s:
                c = zlib.compressobj(level, zlib.DEFLATED, bits)
                out.append(None if b is None else c.compress(bytes(b)) + c.flush())
            yield pd.Series(out)

    return pack(data)


def decompressed(data: Column, container: str = "zlib") -> Column:
    bits = WINDOW_BITS[container]

    @pandas_udf("binary")
    def unpack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if b is None else zlib.decompress(bytes(b), bits) for b in s])

    return unpack(data)


#: Texts of a batch that are made Python objects at a time.
SLICE = 64


def round_trips(df: DataFrame, id_column: str, data_column: str, containers: list[str], level: int = 9) -> DataFrame:
    """The id, ``n_bytes``, and for each container ``<container>_md5`` of what comes out of it and ``<container>_bytes``, its size.

    A text goes into its containers and out again on its own, so beside the batch that
    it is given a worker holds one text's containers. Of a null text all is null.
    """
    schema = pa.schema([(id_column, pa.int64()), ("n_bytes", pa.int64()), *[x for c in containers for x in ((f"{c}_md5", pa.string()), (f"{c}_bytes", pa.int64()))]])

    def one(key: int | None, data: bytes | None) -> tuple:
        if data is None:
            return key, None, *[None] * (2 * len(containers))
        told: list = []
        for bits in map(WINDOW_BITS.__getitem__, containers):
            c = zlib.compressobj(level, zlib.DEFLATED, bits)
            held = c.compress(data) + c.flush()
            told += [hashlib.md5(zlib.decompress(held, bits)).hexdigest(), len(held)]
        return key, len(data), *told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(key, data) for k in range(0, batch.num_rows, SLICE) for key, data in zip(*(c.to_pylist() for c in batch.slice(k, SLICE).columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)
    return df.select(F.col(id_column).cast("long"), F.col(data_column).cast("binary")).mapInArrow(run, ddl)


def adler32(data: Column) -> Column:
    @pandas_udf("long")
    def check(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if b is None else zlib.adler32(bytes(b)) for b in s])

    return check(data)


def entropy_bits(counts: DataFrame, group: list[str], n: str = "n") -> DataFrame:
    """Ideal bits of each symbol: log2 of the sum less log2 of the count; of a symbol never seen, log2 of the sum."""
    total = F.sum(n).over(Window.partitionBy(*group))
    return counts.withColumn("bits", F.when(F.col(n) == 0, F.log2(total)).otherwise(F.greatest(F.log2(total) - F.log2(F.col(n)), F.lit(0.0))))


def length_symbol(n: Column) -> Column:
    """The DEFLATE symbol of a match length of 3 to 258."""
    d = n - 3
    bits = F.greatest(F.floor(F.log2(F.greatest(d, F.lit(1)).cast("double"))) - 2, F.lit(0))
    return F.when(n == 258, 285).when(d < 8, d + 257).otherwise(257 + bits * 4 + F.shiftright(d, 0) / F.pow(F.lit(2.0), bits)).cast("int")


def length_extra_bits(n: Column) -> Column:
    d = (n - 3).cast("double")
    return F.when((n == 258) | (d < 8), 0).otherwise(F.floor(F.log2(F.greatest(d, F.lit(1.0)))) - 2).cast("int")


def distance_symbol(n: Column) -> Column:
    """The DEFLATE symbol of a distance of 1 to 32768."""
    d = (n - 1).cast("double")
    top = F.floor(F.log2(F.greatest(d, F.lit(1.0))))
    second = F.floor(d / F.pow(F.lit(2.0), top - 1)) % 2
    return F.when(d < 4, d).otherwise(2 * top + second).cast("int")


def distance_extra_bits(n: Column) -> Column:
    d = (n - 1).cast("double")
    return F.when(d < 4, 0).otherwise(F.floor(F.log2(F.greatest(d, F.lit(1.0)))) - 1).cast("int")


def code_lengths(counts: list[int], most: int) -> list[int]:
    """Optimal prefix code lengths of at most ``most`` bits, by package-merge."""
    used = [(n, (k,)) for k, n in enumerate(counts) if n > 0]
    lengths = [0] * len(counts)
    if len(used) <= 1:
        for _, (k,) in used:
            lengths[k] = 1
        return lengths
    coins = sorted(used)
    rows = coins
    for _ in range(most - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(rows[::2], rows[1::2])]
        rows = list(heapq.merge(coins, pairs))
    for _, symbols in rows[: 2 * len(used) - 2]:
        for k in symbols:
            lengths[k] += 1
    return lengths


# Runs of at least so many zeros, or of another count, are left; counts nearer than so much to a stretch's start are one with it.
ZEROS, EQUALS, NEAR = 5, 7, 4


def smooth(counts: list[int]) -> list[int]:
    """Counts made alike where they nearly are, so that the lengths of their codes repeat and tell shortly.

    Long runs stay. Elsewhere counts that are near the first four of a stretch
    become the stretch's mean, at least one where any was; zeros at the end stay.
    """
    size = max((k + 1 for k, n in enumerate(counts) if n), default=0)
    left, at = set(), 0
    for value, run in itertools.groupby(counts[:size]):
        long = len(list(run))
        if long >= (EQUALS if value else ZEROS):
            left.update(range(at, at + long))
        at += long
    out, begin, level = list(counts), 0, counts[0] if size else 0
    for k in range(size + 1):
        if k < size and k not in left and abs(counts[k] - level) < NEAR:
            continue
        stretch = counts[begin:k]
        if len(stretch) >= 4 or len(stretch) == 3 and not any(stretch):
            mean = max(1, (sum(stretch) + len(stretch) // 2) // len(stretch)) if any(stretch) else 0
            out[begin:k] = [mean] * len(stretch)
        begin, level = k, (sum(counts[k : k + 4]) + 2) // 4 if k < size - 3 else counts[k] if k < size else 0
    return out


def smoothed(counts: Column) -> Column:
    """:func:`smooth` for arrays of counts, in Arrow batches."""

    @pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if c is None else smooth([int(x) for x in c]) for c in s], dtype=object)

    return run(counts)


def codes(lengths: list[int]) -> list[int]:
    """Canonical codes of code lengths."""
    out, code = [0] * len(lengths), 0
    for size in range(1, max(lengths, default=0) + 1):
        for k, n in enumerate(lengths):
            if n == size:
                out[k] = code
                code += 1
        code <<= 1
    return out
