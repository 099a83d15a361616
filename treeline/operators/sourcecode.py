"""Symbols of C and Rust sources: extraction, calls, signatures, merging, filters, reports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOLS = "file string, name string, kind string, language string, signature string, is_static boolean, is_definition boolean, line int, line_count int, calls array<string>, types array<string>"
SCHEMA = pa.schema([
    ("file", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("language", pa.string()), ("signature", pa.string()), ("is_static", pa.bool_()), ("is_definition", pa.bool_()),
    ("line", pa.int32()), ("line_count", pa.int32()), ("calls", pa.list_(pa.string())), ("types", pa.list_(pa.string())),
])

# Words that are no symbols.
KEYWORDS = {
    "if", "else", "for", "while", "do", "switch", "case", "default", "return", "break", "continue", "goto", "sizeof", "typedef", "struct", "union", "enum", "static", "const", "extern", "inline",
    "void", "int", "char", "long", "short", "unsigned", "signed", "float", "double", "bool", "size_t", "fn", "let", "mut", "pub", "impl", "match", "use", "mod", "crate", "self", "Self", "as", "in", "loop", "unsafe", "where", "trait", "type", "move", "ref",
}
C_BLANK = re.compile(r'/\*.*?\*/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'', re.DOTALL)
C_FUNCTION = re.compile(r"(?m)^(?P<head>[A-Za-z_][\w \t*\n]*?[\s*])(?P<name>[A-Za-z_]\w*)\s*\((?P<args>[^;{}()]*(?:\([^()]*\)[^;{}()]*)*)\)\s*(?P<end>[;{])")
C_AGGREGATE = re.compile(r"(?m)^[ \t]*(?P<typedef>typedef\s+)?(?P<kind>struct|union|enum)\s+(?P<name>[A-Za-z_]\w*)?\s*\{")
C_TYPEDEF = re.compile(r"(?m)^[ \t]*typedef\s+(?!.*\{)(?P<body>[^;]+?)\b(?P<name>[A-Za-z_]\w*)\s*;")
C_DEFINE = re.compile(r"(?m)^[ \t]*#[ \t]*define[ \t]+(?P<name>[A-Za-z_]\w*)(?P<args>\([^)]*\))?[ \t]*(?P<body>[^\n]*)$")
RUST_ITEM = re.compile(r"(?m)^[ \t]*(?P<pub>pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:extern\s+(?:\"C\"\s+)?)?(?P<kind>fn|struct|enum|trait|const|static)\s+(?:mut\s+)?(?P<name>[A-Za-z_]\w*)")
CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
IDENTIFIER = re.compile(r"\b[A-Za-z_]\w*\b")


def blanked(text: str) -> str:
    """Comments and literals overwritten by blanks of the same shape, so that offsets stay."""
    return C_BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def block_end(text: str, brace: int) -> int:
    """Offset after the brace that closes the one at ``brace``."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, brace):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def signature(text: str) -> str:
    """Up to the body, lines squeezed; of more than four lines the first three."""
    lines = [x for x in (" ".join(line.split()) for line in text.partition("{")[0].rstrip(" ;\n").splitlines()) if x]
    return "\n".join(lines[:3] + ["..."] if len(lines) > 4 else lines)


def symbols_of(file: str, text: str) -> Iterator[tuple]:
    """Symbols of one file, in order."""
    plain, rust = blanked(text), file.endswith(".rs")
    line = lambda at: plain.count("\n", 0, at) + 1

    def row(name: str, kind: str, begin: int, end: int, static: bool, defined: bool) -> tuple:
        body = plain[begin:end]
        inner = body.partition("{")[2]
        calls = sorted({c for c in CALL.findall(inner) if c not in KEYWORDS and c != name}) if kind == "function" else []
        head = body if kind != "function" else body.partition("{")[0]
        types = sorted({w for w in IDENTIFIER.findall(head) if w not in KEYWORDS and w != name and (w[0].isupper() or w.endswith("_t"))})
        return file, name, kind, "rust" if rust else "c", signature(text[begin:end]), static, defined, line(begin), body.rstrip().count("\n") + 1, calls, types

    if rust:
        for m in RUST_ITEM.finditer(plain):
            stop = re.compile(r"[{;]").search(plain, m.end())
            brace = stop is not None and stop.group() == "{"
            end = block_end(plain, stop.start()) if brace else stop.end() if stop else len(plain)
            yield row(m["name"], {"fn": "function", "const": "constant", "static": "constant"}.get(m["kind"], m["kind"]), m.start(), end, m["pub"] is None, True)
        return
    taken = 0
    for m in C_FUNCTION.finditer(plain):
        if m.start() < taken or m["name"] in KEYWORDS or m["head"].split()[:1] in (["return"], ["else"], ["typedef"]):
            continue
        defined = m["end"] == "{"
        end = block_end(plain, m.end() - 1) if defined else m.end()
        taken = end
        yield row(m["name"], "function", m.start(), end, "static" in m["head"].split(), defined)
    for m in C_AGGREGATE.finditer(plain):
        end = block_end(plain, m.end() - 1)
        after = re.compile(r"\s*([A-Za-z_]\w*)?\s*;").match(plain, end)
        name = (after.group(1) if m["typedef"] and after and after.group(1) else m["name"]) or ""
        if name:
            yield row(name, m["kind"], m.start(), after.end() if after else end, False, True)
    for m in C_TYPEDEF.finditer(plain):
        yield row(m["name"], "typedef", m.start(), m.end(), False, True)
    for m in C_DEFINE.finditer(plain):
        yield row(m["name"], "macro" if m["args"] else "define", m.start(), m.end(), False, bool(m["body"].strip()))


def extract(files: DataFrame) -> DataFrame:
    """Symbols of ``files(file, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [s for file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for s in symbols_of(file or "", text or "")]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in SCHEMA]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    return files.select("file", "text").mapInArrow(run, SYMBOLS)


def call_edges(symbols: DataFrame) -> DataFrame:
    """``src, dst`` for each distinct call of a known symbol."""
    calls = symbols.where("kind = 'function'").select(F.col("name").alias("src"), F.explode("calls").alias("dst")).distinct()
    return calls.join(symbols.select(F.col("name").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def noise(name: Column) -> Column:
    """Names that are no symbols of their own."""
    return name.isin(*sorted(KEYWORDS)) | (F.length(name) <= 1) | name.rlike("^__.*__$")


def kept(in_header: Column, is_static: Column, line_count: Column) -> Column:
    """Declared in a header, or of more than ten lines and not static."""
    return in_header | (~is_static & (line_count > 10))


def guard(name: Column, body: Column) -> Column:
    """Header guards and defines without a body."""
    return name.rlike(r"(_H|_H_|_H__|_INCLUDED)$") | (F.trim(body) == "")


def merge(symbols: DataFrame) -> DataFrame:
    """Declarations and definitions of ``(name, language)`` in one row: first locations, all dependencies, most lines."""
    key = F.struct("file", "line")
    declared = lambda cond: F.min(F.when(cond, key))["file"]
    return symbols.groupBy("name", "language").agg(
        declared(~F.col("is_definition")).alias("declaration_file"), declared(F.col("is_definition")).alias("definition_file"), F.bool_or("is_static").alias("is_static"), F.max("line_count").alias("line_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("calls")))).alias("calls"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"), F.count(F.lit(1)).alias("n"),
    )


def unify(structs: DataFrame, typedefs: DataFrame) -> DataFrame:
    """Structs with the typedef that names them: the same name first, then without an underscore in front, then by the typedef's body."""
    s, t = structs.select(F.col("name").alias("struct")), typedefs.select(F.col("name").alias("typedef"), "body")
    by = F.struct
    keys = s.select("struct", F.explode(F.array(by(F.lit(0).alias("rank"), F.col("struct").alias("k")), by(F.lit(1).alias("rank"), F.regexp_replace("struct", "^_+", "").alias("k")))).alias("x")).select("struct", "x.*")
    named = keys.join(t.withColumn("k", F.col("typedef")), "k").select("struct", "typedef", "rank")
    inside = t.withColumn("struct", F.regexp_extract("body", r"struct\s+(\w+)", 1)).join(s, "struct").select("struct", "typedef", F.lit(2).alias("rank"))
    w = Window.partitionBy("struct").orderBy("rank", "typedef")
    return named.unionByName(inside).withColumn("n", F.row_number().over(w)).where("n = 1").select("struct", "typedef")
