"""A Spark session with the settings that the engine expects."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once an application, so that Python workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        path = os.path.join(tempfile.mkdtemp(prefix="treeline-"), "treeline-package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(HERE):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(HERE)))
        spark.sparkContext.addPyFile(path)
    return spark


def session(name: str = "treeline", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC, and whatever ``conf`` says (dots written as double underscores)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the star schema by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and driver and executors are one process (tests, a
    single machine) a folder of our own is made and set; elsewhere it is an
    error, as no other machine would see that folder.
    """
    context = spark.sparkContext._jsc.sc()
    where, held = spark.conf.get("spark.checkpoint.dir", None), context.getCheckpointDir()
    if where is None and held.isDefined():
        where = held.get()
    if where is None:
        if not context.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="treeline-")
    if held.isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out by all their columns, for work that is dear a row: as many parts as cores or shuffle partitions, never merged again."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *df.columns)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, eagerly."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, **options: int) -> str:
    """The folder below :func:`shared_dir` to which the rows are written in compressed columns, a file a partition in their order."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows written down (:func:`stored`) and read from there, for large tables that are read several times."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df))


def values(column: pa.Array) -> list:
    """An Arrow column as a list: ``to_pylist`` makes an object of each value first, which is ten times as slow."""
    if pa.types.is_string(column.type) or (not column.null_count and pa.types.is_primitive(column.type)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()
