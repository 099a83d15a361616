"""Documents from binary files: compression by their first bytes, encodings by marks, declarations and meta elements.

Files are found and split by size by Spark's own ``binaryFile`` reader, wherever
they lie; bytes become text in Arrow batches. A file that can't be expanded or
decoded is a row with an error.

Defined cases: an empty file has no row, as Spark's reader leaves it out; empty bytes are an empty text in UTF-8; bytes without any sign of
an encoding are UTF-8 if they are valid, else windows-1252; expanded data beyond
``most`` bytes is an error, and is not expanded further; truncated files are errors.
"""

from __future__ import annotations

import bz2
import codecs
import gzip
import io
import lzma
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# First bytes of compressed files and of texts with a mark.
MAGIC = {b"\x1f\x8b": "gzip", b"\xfd7zXZ\x00": "xz", b"BZh": "bzip2"}
MARKS = [(b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")]
PLAIN = [(b"<\x00?\x00", "utf-16-le"), (b"\x00<\x00?", "utf-16-be"), (b"<\x00\x00\x00", "utf-32-le"), (b"\x00\x00\x00<", "utf-32-be")]
DECLARED = re.compile(rb"""^\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z][\w.:-]*)""")
META = re.compile(rb"""(?i)<meta\s[^>]*?charset\s*=\s*["']?\s*([A-Za-z][\w.:-]*)""")
#: Bytes in which a declaration or meta element is looked for, and by default the most that a file may expand to.
HEAD, MOST = 1024, 1 << 30


def expanded(data: bytes, most: int = MOST) -> tuple[str, bytes]:
    """How a file is compressed, told by its first bytes, and what it holds; compressed in itself several times is expanded once."""
    kind = next((k for magic, k in MAGIC.items() if data.startswith(magic)), "none")
    if kind == "none":
        return kind, data
    opened = {"gzip": gzip.open, "xz": lzma.open, "bzip2": bz2.open}[kind](io.BytesIO(data))
    out = opened.read(most + 1)
    if len(out) > most:
        raise ValueError(f"more than {most} bytes")
    return kind, out


def encoding(data: bytes) -> tuple[str, int]:
    """The encoding of a text's bytes and the length of its mark."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name, len(mark)
    for head, name in PLAIN:
        if data.startswith(head):
            return name, 0
    found = DECLARED.match(data[:HEAD]) or META.search(re.sub(rb"(?s)<!--.*?-->", b"", data[:HEAD]))
    if found:
        name = found[1].decode().lower()
        # What is read as ASCII so far is no UTF-16, whatever it says.
        return ("utf-8" if name.startswith(("utf-16", "utf-32")) else name), 0
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return "windows-1252", 0
    return "utf-8", 0


def read(data: bytes | None, most: int = MOST) -> tuple[str | None, str | None, str | None, str | None]:
    """``codec, encoding, text, error`` of a file's bytes."""
    try:
        codec, plain = expanded(bytes(data or b""), most)
    except (OSError, EOFError, ValueError, lzma.LZMAError) as e:
        return None, None, None, str(e) if str(e).startswith("more than") else "cannot be expanded"
    name, mark = encoding(plain)
    try:
        return codec, codecs.lookup(name).name, plain[mark:].decode(name), None
    except LookupError:
        return codec, name, None, f"unknown encoding {name}"
    except UnicodeDecodeError:
        return codec, codecs.lookup(name).name, None, f"not {name}"


def texts(data: Column, most: int = MOST) -> Column:
    """:func:`read` for a column of bytes."""

    @pandas_udf("codec string, encoding string, text string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([read(b, most) for b in s], columns=["codec", "encoding", "text", "error"])

    return run(data)


def documents(spark: SparkSession, folder: str, pattern: str = "*", most: int = MOST) -> DataFrame:
    """``path, codec, encoding, text, error`` of all files below a folder whose name fits, paths relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    base = re.escape(re.sub("^[a-z]+:/*", "/", folder).rstrip("/"))
    return found.select(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{base}/", "").alias("path"), texts(F.col("content"), most).alias("x")).select("path", "x.*")


def write_files(files: DataFrame, folder: str) -> int:
    """Write ``files(path, content)`` below a folder that driver and executors share; a task that runs again writes the same files. Returns how many."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, root = pafs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                full = f"{root}/{path}"
                if (parent := full.rpartition("/")[0]) not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(full, compression=None) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
