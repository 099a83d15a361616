"""Helpers that every operator of this subpackage shares.

All of them are bounded on the driver: nothing here collects rows that grow
with the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.session import settle, shared_dir, ship

#: Bytes handed to Python at a time: texts may be long, so rows alone are no bound. A longer row is a batch of its own.
BATCH_BYTES = 4 << 20
BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def session(spark: SparkSession) -> SparkSession:
    """Set what the Arrow operators need: batches bounded in bytes, unless the session has a bound, and this package on the executors.

    Plans run after this returns, so the bound stays; nothing else of the session is touched.
    """
    ship(spark)
    if spark.conf.get(BOUND, None) is None:
        spark.conf.set(BOUND, str(BATCH_BYTES))
    return spark


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own below the shared one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def publish(spark: SparkSession, kind: str, chunks: Iterable[bytes]) -> str:
    """Write a file below the shared folder and hand it to every executor; its name there is for ``SparkFiles.get``."""
    place = scratch(spark, kind)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    stream = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path)
    for chunk in chunks:
        stream.write(bytearray(chunk))
    stream.close()
    spark.sparkContext.addFile(place)
    return place.rpartition("/")[2]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name.

    Works by position, so extra columns whose names clash with ours, also in
    another case, do no harm. The first of equal names is taken.
    """
    held = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(held))])
    return plain.select(*[F.col(f"c{held.index(n)}").alias(n) for n in names])


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty string."""
    return [x if x is not None else "" for x in column.to_pylist()]


def arrow_map(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, *, setup: Callable[[], object] | None = None
) -> DataFrame:
    """mapInArrow with one call of ``fn`` a batch; ``setup()`` runs once a task and its value is passed too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = setup() if setup else None
        for batch in batches:
            if batch.num_rows:
                out = fn(batch, held) if setup else fn(batch)
                if out is not None and out.num_rows:
                    yield out

    session(df.sparkSession)
    return df.mapInArrow(run, schema)


def record(schema: pa.Schema, *columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Keys of a join that may be hot at most, and rows from which a key is hot at least.
HOT_KEYS, HOT_ROWS = 1_000, 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups``, one row a key with the number of its rows in ``count``.

    Keys of over ``HOT_ROWS`` rows and over a ``HOT_KEYS``-th of all are at most
    ``HOT_KEYS``: these are broadcast, so their rows stay where they are; all
    others meet in an equi-join whose keys are all small.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = groups.where(F.col(count) > limit).drop(count)
    warm = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(count) <= limit).drop(count), key)
    return rows.join(F.broadcast(hot), key).unionByName(warm)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as rows ``(node, root)``, one per node.

    Contraction: each node points to the neighbour of the least hash, if that
    is less than its own; edges are renamed by the pointers, loops and repeats
    dropped, until none is left. As the order is a hash, the expected number of
    rounds is logarithmic. Every step is an aggregate with partial sums or an
    equi-join that can be split, so a node with very many neighbours is no
    bottleneck. A component's root is one of its nodes.
    """
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = settle(edges.where("a <> b").select("a", "b").distinct())
    parts: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), ranked("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), ranked("a").alias("to")))
        near = both.groupBy("node").agg(F.min("to").alias("to"))
        point = settle(near.select("node", F.least(F.col("to"), ranked("node"))["v"].alias("parent")))
        parts.append(point)
        left = edges.join(point.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
        moved = left.join(point.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        edges = settle(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not parts:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # A node that is its own parent in one round may still be renamed in a later one.
    held = parts[-1].select("node", F.col("parent").alias("root"))
    for point in reversed(parts[:-1]):
        up = held.select(F.col("node").alias("parent"), F.col("root").alias("far"))
        held = settle(point.join(up, "parent", "left").select("node", F.coalesce("far", "parent").alias("root")))
    return held
