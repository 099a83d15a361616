"""Files as tables: trees of sources, listings, whole files, compressed and pluggable inputs, prompts with includes."""

from __future__ import annotations

import fnmatch
import glob as globbing
import lzma
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.functions import pandas_udf


def source_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".c", ".h", ".rs"), skip: str = "png") -> DataFrame:
    """``file, text`` of all sources below a folder, paths with ``skip`` in them left out."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").text(root, wholetext=True)
    df = df.select(F.regexp_replace(F.input_file_name(), "^file:/*", "/").alias("file"), F.col("value").alias("text"))
    return df.where(~F.contains("file", F.lit(skip))) if skip else df


def listing(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Paths below a folder, relative to it, sorted; the files aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root)
    base = root.rstrip("/") + "/"
    return df.select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base), "").alias("path"), "length").orderBy("path")


def expand_compressed(data: Column, path: Column) -> Column:
    """Bytes of xz files expanded; other files as they are (Spark's readers expand gz, bz2 and zst by themselves)."""

    @pandas_udf("binary")
    def expand(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for blobs, names in batches:
            yield pd.Series([lzma.decompress(bytes(b)) if n.endswith(".xz") else bytes(b) for b, n in zip(blobs, names, strict=True)])

    return expand(data, path)


class LinesSource(DataSource):
    """A pluggable input: ``spark.read.format("lines")`` gives numbered lines, of the option ``texts`` (a JSON list) or of a ``folder`` that the output of the same name wrote.

    A folder's files are dealt into partitions of about ``split`` lines (1,000,000),
    told by the list of committed files alone; ``doc`` is a file's place in that list.
    """

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "doc int, line int, text string"

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return LinesWriter(self.options, [f.name for f in schema.fields].index("text"))


@dataclass
class Written(WriterCommitMessage):
    """A file that a task wrote, and its lines."""

    name: str
    lines: int


class LinesWriter(DataSourceWriter):
    """A pluggable output: ``df.write.format("lines").option("folder", uri).mode("append").save()`` writes the column ``text``, a line a row.

    Each task writes a file of its own, gzip if the option ``codec`` says so; the
    folder's ``_lines`` names the files of tasks that were committed, so that what
    a lost attempt left is known not to count.
    """

    def __init__(self, options: dict, column: int):
        self.folder, self.codec, self.column = options["folder"], options.get("codec"), column

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, root = pafs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        task, n = TaskContext.get(), 0
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.txt" + (".gz" if self.codec == "gzip" else "")
        with store.open_output_stream(f"{root}/{name}", compression=self.codec) as out:
            for row in rows:
                out.write(f"{row[self.column]}\n".encode())
                n += 1
        return Written(name, n)

    def commit(self, messages: list) -> None:
        store, root = pafs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_lines") as out:
            out.write("".join(f"{m.name}\t{m.lines}\n" for m in messages if m is not None).encode())

    def abort(self, messages: list) -> None:
        store, root = pafs.FileSystem.from_uri(self.folder)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


def decoded(data: Column, encoding: Column, handlers: dict[str, Callable[[bytes], str]] | None = None) -> Column:
    """``text, error``: bytes by the name of their encoding, a registered handler's or one that Python knows; what can't be read is an error."""
    held = {k.lower(): v for k, v in (handlers or {}).items()}

    def one(b: bytes | None, name: str | None) -> tuple[str | None, str | None]:
        if b is None or name is None:
            return None, None
        try:
            return held[name.lower()](bytes(b)) if name.lower() in held else bytes(b).decode(name), None
        except LookupError:
            return None, f"unknown encoding {name}"
        except ValueError:
            return None, f"not {name}"

    @pandas_udf("text string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for blobs, names in batches:
            yield pd.DataFrame([one(b, n) for b, n in zip(blobs, names, strict=True)], columns=["text", "error"])

    return run(data, encoding)


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        import json

        self.folder, self.split = options.get("folder"), int(options.get("split", 1_000_000))
        self.texts = json.loads(options.get("texts", "[]"))

    def partitions(self) -> list[InputPartition]:
        if not self.folder:
            return [InputPartition(k) for k in range(len(self.texts))]
        store, root = pafs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(f"{root}/_lines") as held:
            listed = [line.split("\t") for line in held.read().decode().splitlines()]
        out, now, size = [], [], 0
        for k, (name, lines) in enumerate(listed):
            if now and size + int(lines) > self.split:
                out.append(InputPartition(now))
                now, size = [], 0
            now.append((k, name))
            size += int(lines)
        return [*out, InputPartition(now)] if now else out or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not self.folder:
            for k, line in enumerate(self.texts[partition.value].split("\n"), start=1):
                yield partition.value, k, line
            return
        import io

        store, root = pafs.FileSystem.from_uri(self.folder)
        for doc, name in partition.value:
            with store.open_input_stream(f"{root}/{name}", compression="gzip" if name.endswith(".gz") else None) as held:
                for k, line in enumerate(io.TextIOWrapper(held, encoding="utf-8", newline="\n"), start=1):
                    yield doc, k, line.removesuffix("\n")


def discover(rows: DataFrame, name: Column, marker: Column, *, names: list[str] = (), markers: list[str] = (), without_names: list[str] = (), without_markers: list[str] = ()) -> DataFrame:
    """Rows whose name and marker match one of the shell patterns (any, if none is given) and none of those that leave out."""
    like = lambda c, patterns: F.coalesce(c.rlike("|".join(r"\A" + fnmatch.translate(p).removesuffix(r"\Z").removesuffix(r"\z") + r"\z" for p in patterns)), F.lit(False))
    kept = rows
    for c, wanted, unwanted in ((name, names, without_names), (marker, markers, without_markers)):
        if wanted:
            kept = kept.where(like(c, wanted))
        if unwanted:
            kept = kept.where(~like(c, unwanted))
    return kept


INCLUDE = re.compile(r"\{\{include:\s*([^}]+?)\s*\}\}")


def expand_prompt(path: str, seen: tuple[str, ...] = ()) -> str:
    """A prompt with its ``{{include: path-or-glob}}`` expanded, each file wrapped in a tag that names it; loops are errors."""
    path = os.path.abspath(path)
    if path in seen:
        raise ValueError(f"{path} includes itself")
    with open(path, encoding="utf-8") as f:
        text = f.read()

    def include(m: re.Match) -> str:
        found = sorted(globbing.glob(os.path.join(os.path.dirname(path), m.group(1)), recursive=True))
        if not found:
            raise FileNotFoundError(m.group(1))
        return "\n".join(f'<file name="{os.path.relpath(p, os.path.dirname(path))}">\n{expand_prompt(p, (*seen, path))}\n</file>' for p in found)

    return INCLUDE.sub(include, text)


def find_config(start: str, name: str) -> str | None:
    """The nearest file of a name in a folder or one above it."""
    at = os.path.abspath(start)
    while True:
        if os.path.exists(p := os.path.join(at, name)):
            return p
        if (up := os.path.dirname(at)) == at:
            return None
        at = up
