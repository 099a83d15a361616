"""Regex search with line context, and patches."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(files: DataFrame, patterns: list[str], context: int = 5) -> DataFrame:
    """``pattern, file, line, context``: lines in which a pattern is found, with lines around them.

    Works on the array of a file's lines, so context needs neither a window nor a shuffle.
    """
    lines = F.split("text", "\n")
    rows = files.select("file", lines.alias("lines")).select("file", "lines", F.posexplode("lines").alias("at", "held"))
    named = F.explode(F.array(*[F.lit(p) for p in patterns])).alias("pattern")
    first = F.greatest(F.col("at") - context, F.lit(0))
    around = F.slice("lines", first + 1, F.least(F.col("at") + context + 1, F.size("lines")) - first)
    return rows.select("*", named).where(F.expr("held rlike pattern")).select("pattern", "file", (F.col("at") + 1).alias("line"), F.array_join(around, "\n").alias("context"))


def grouped(hits: DataFrame) -> DataFrame:
    """Hits by pattern, in order of file and line."""
    return hits.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("file", "line", "context"))).alias("hits"))


BLOCK = re.compile(r"<<<<<<< SEARCH\n(.*?)\n?=======\n(.*?)\n?>>>>>>> REPLACE", re.DOTALL)


def parse_patch(patch: str) -> list[tuple[str, str]]:
    """The search and replace texts of a patch's blocks."""
    return [(m.group(1), m.group(2)) for m in BLOCK.finditer(patch)]


def squeezed(text: str) -> str:
    return "\n".join(" ".join(line.split()) for line in text.split("\n"))


def apply_patch(content: str, patch: str, threshold: float = 0.85) -> tuple[str, str | None]:
    """The patched text and the first error: exact match, then by squeezed white space, then the most similar lines."""
    blocks = parse_patch(patch)
    if not blocks:
        return content, "no search block"
    for search_text, replace in blocks:
        if search_text in content:
            content = content.replace(search_text, replace, 1)
            continue
        lines, wanted = content.split("\n"), search_text.split("\n")
        best: tuple[float, int, int] = (0.0, 0, 0)
        for n in (len(wanted), len(wanted) + 1, len(wanted) - 1):
            for at in range(len(lines) - n + 1 if n > 0 else 0):
                part = "\n".join(lines[at : at + n])
                if squeezed(part) == squeezed(search_text):
                    best = (2.0, at, n)
                elif best[0] < 2:
                    ratio = difflib.SequenceMatcher(None, part, search_text).ratio()
                    if ratio > best[0]:
                        best = (ratio, at, n)
        if best[0] < threshold:
            return content, "search text not found"
        lines[best[1] : best[1] + best[2]] = replace.split("\n")
        content = "\n".join(lines)
    return content, None


def patch_files(files: DataFrame) -> DataFrame:
    """``file, text, error`` of ``files(file, text, patch)``."""
    schema = pa.schema([("file", pa.string()), ("text", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(f, *apply_patch(t or "", p or "")) for f, t, p in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = list(zip(*done, strict=True)) if done else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=schema)

    return files.select("file", "text", "patch").mapInArrow(run, "file string, text string, error string")
