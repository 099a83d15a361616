"""Structured Streaming: incremental parsing, delta accumulation, restart; and event-time windows, which are an addition."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treeline.session import shared_dir


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder where all executors can write: below ``spark.checkpoint.dir``."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's files as a stream, one file a batch; the table is a file or a folder of files."""
    place = f"{sf_dir}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(place).schema).option("maxFilesPerTrigger", 1)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory():
        return stream.parquet(place)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet; a second call with the same folder goes on where the first ended."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_latest(stream: DataFrame, folder: str, key: str, version: str) -> DataFrame:
    """Run an updating stream over all that is there; of each key the row of the greatest ``version`` counts.

    A batch's rows lie in a folder of its number, written over if the batch runs
    again, so a restart repeats nothing.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{folder}/out")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in stream.columns if c != key]), version).alias("row")).select(key, "row.*")


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by event-time window and type; rows later than ``late`` are not counted (addition)."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def accumulate(pieces: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Pieces joined per key over any number of batches; a batch updates the keys that it has pieces of, with the text so far.

    State holds a key's pieces in order, as many as a response has.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for b in batches:
            held += [f"{o:012d}\x1f{t}" for o, t in zip(b[order], b[text], strict=True)]
        held.sort()
        state.update((held,))
        yield pd.DataFrame({key: [k[0]], "n": [len(held)], "content": ["".join(x.partition("\x1f")[2] for x in held)]})

    return pieces.groupBy(key).applyInPandasWithState(step, f"{key} long, n long, content string", "held array<string>", "update", GroupStateTimeout.NoTimeout)
