"""Trees and rows as text of other forms: HTML, outlines, YAML; arithmetic read from text; paths within a folder."""

from __future__ import annotations

import ast
import operator
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from treeline.functions import text as ft
from treeline.functions.xpath import number_to_string
from treeline.operators import nodes as nodes_
from treeline.operators.nodes import escape_attribute, escape_text
from treeline.session import settle
from treeline.sources.markup import VOID

# Elements whose text is not escaped, and attributes that need no value.
PLAIN = ["script", "style"]
FLAGS = ["checked", "compact", "declare", "defer", "disabled", "ismap", "multiple", "nohref", "noresize", "noshade", "nowrap", "readonly", "selected"]


def serialize_html(nodes: DataFrame, which: Column, whole: bool = False) -> DataFrame:
    """``doc_id, pre, html``: the subtree of each chosen element as HTML; elements without content don't close; ``whole`` as in :func:`treeline.operators.nodes.serialize`."""
    kind, name, value = F.col("kind"), F.col("name"), F.col("value")
    flag = name.isin(FLAGS) & ((value == "") | (value == name))
    held = escape_attribute(value)
    link = F.when(name.isin("href", "src", "action"), F.replace(F.trim(held), F.lit(" "), F.lit("%20"))).otherwise(held)
    attr = F.concat(F.lit(" "), name, F.when(flag, "").otherwise(F.concat(F.lit('="'), link, F.lit('"'))))
    said = F.when(kind == "element", F.concat(F.lit("<"), name)).when(kind == "attr", attr).when(kind.isin("text", "cdata"), escape_text(value))
    said = said.when(kind == "comment", F.concat(F.lit("<!--"), value, F.lit("-->"))).when(kind == "pi", F.concat(F.lit("<?"), name, F.lit(" "), value, F.lit(">")))
    turn = F.when(kind == "element", F.when(name.isin(PLAIN), nodes_.PLAIN).otherwise(nodes_.ELEMENT)).when(kind.isin("attr", "ns"), nodes_.ATTRIBUTE).otherwise(nodes_.LEAF)
    other = F.when((kind == "element") & ~name.isin(sorted(VOID)), F.concat(F.lit("</"), name, F.lit(">"))).when(kind.isin("text", "cdata"), value)
    return nodes_.texts_of(nodes, which, turn, said, other, None, whole).withColumnRenamed("text", "html")


def inner_xml(xml: Column) -> Column:
    """What lies between the outermost tags of an element's text."""
    return F.when(F.endswith(xml, F.lit("/>")) & ~xml.rlike(r"</[^<>]*>\z"), F.lit("")).otherwise(F.regexp_replace(xml, r"(?s)\A<(?:[^<>\"]|\"[^\"]*\")*>(.*)</[^<>]*>\z", "$1"))


def dump(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id, dump``: a node-set as an outline, numbered in document order: elements with their attributes, texts with their content."""
    place = F.array_position(F.col("all"), F.col("pre"))
    numbers = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("pre")).alias("all"))
    a = nodes.where("kind = 'attr'").select("doc_id", F.col("parent").alias("pre"), F.struct("pre", F.concat(F.lit("    ATTRIBUTE "), "name", F.lit("\n      TEXT\n        content="), "value", F.lit("\n")).alias("x")).alias("a"))
    attrs = a.join(found.select("doc_id", "pre").distinct(), ["doc_id", "pre"], "left_semi").groupBy("doc_id", "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda s: s["x"]), "").alias("attrs"))
    said = F.when(F.col("kind") == "element", F.concat(F.lit("ELEMENT "), "name", F.lit("\n"), F.coalesce("attrs", F.lit("")))).when(F.col("kind") == "attr", F.concat(F.lit("ATTRIBUTE "), "name", F.lit("\n    TEXT\n      content="), "value", F.lit("\n")))
    said = said.when(F.col("kind") == "text", F.concat(F.lit("TEXT\n    content="), "value", F.lit("\n"))).when(F.col("kind") == "comment", F.concat(F.lit("COMMENT\n    content="), "value", F.lit("\n"))).when(F.col("kind") == "document", F.lit(" /\n")).otherwise(F.concat(F.lit("PI "), "name", F.lit("\n    content="), "value", F.lit("\n")))
    rows = found.dropDuplicates(["doc_id", "pre"]).join(attrs, ["doc_id", "pre"], "left").join(numbers, "doc_id").select("doc_id", "pre", F.concat(place.cast("string"), F.lit("  "), said).alias("line"), F.size("all").alias("n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "line"))), lambda s: s["line"]), "")
    return rows.groupBy("doc_id").agg(F.concat(F.lit("Object is a Node Set :\nSet contains "), F.max("n").cast("string"), F.lit(" nodes:\n"), lines).alias("dump"))


def scalar_dump(value: Column, kind: str) -> Column:
    """A value as the tests print it."""
    names = {"string": "string", "number": "number", "boolean": "Boolean"}
    text = {"string": lambda c: c, "number": number_to_string, "boolean": lambda c: F.when(c, "true").otherwise("false")}[kind](value)
    return F.concat(F.lit(f"Object is a {names[kind]} : "), text)


def yaml_text(c: Column) -> Column:
    """A text as a YAML scalar: plain where that reads back as the same text, quoted otherwise."""
    plain = c.rlike(r"\A[A-Za-z_][A-Za-z0-9_ ./()-]*\z") & ~c.rlike(r" \z") & ~F.lower(c).isin("true", "false", "null", "yes", "no", "on", "off", "y", "n")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return F.when(c.isNull(), F.lit("null")).when(plain, c).otherwise(quoted)


def yaml_block(fields: dict[str, Column], lists: dict[str, Column]) -> Column:
    """Fields, then lists of texts, as a YAML mapping."""
    lines = [F.concat(F.lit(f"{k}: "), yaml_text(c), F.lit("\n")) for k, c in fields.items()]
    items = [F.concat(F.lit(f"{k}:"), F.when(F.size(c) == 0, F.lit(" []\n")).otherwise(F.concat(F.lit("\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), yaml_text(x), F.lit("\n"))), "")))) for k, c in lists.items()]
    return F.concat(*lines, *items)


# Operators of the calculator.
OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
#: Longest expression and greatest exponent that are calculated.
LONGEST, POWER = 1_000, 64


def calculate(text: str | None) -> tuple[float | None, str | None]:
    """The value of an arithmetic expression, or what is wrong with it. Only numbers, signs, parentheses and operators are read.

    Expressions of over ``LONGEST`` characters and exponents above ``POWER`` are errors.
    """

    def value(e: ast.AST) -> float:
        if isinstance(e, ast.Constant) and type(e.value) in (int, float):
            return e.value
        if isinstance(e, ast.UnaryOp) and isinstance(e.op, (ast.UAdd, ast.USub)):
            return value(e.operand) if isinstance(e.op, ast.UAdd) else -value(e.operand)
        if isinstance(e, ast.BinOp) and type(e.op) in OPERATORS:
            a, b = value(e.left), value(e.right)
            if isinstance(e.op, ast.Pow) and abs(b) > POWER:
                raise ValueError("exponent too large")
            return OPERATORS[type(e.op)](a, b)
        raise ValueError("not arithmetic")

    if text is None or len(text) > LONGEST:
        return None, "no expression" if text is None else "too long"
    try:
        return float(value(ast.parse(text.strip(), mode="eval").body)), None
    except ZeroDivisionError:
        return None, "division by zero"
    except (SyntaxError, MemoryError, RecursionError):
        return None, "not arithmetic"
    except (ValueError, OverflowError, TypeError) as e:
        return None, str(e)


def calculated(text: Column) -> Column:
    """``value, error`` of arithmetic expressions, in Arrow batches."""

    @pandas_udf("value double, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([calculate(t) for t in b], columns=["value", "error"])

    return run(text)


def within(root: Column, path: Column) -> Column:
    """Whether a path, read from a folder, stays in it: absolute paths and ``..`` are followed by their text alone."""
    base = F.regexp_replace(ft.normalize_path(root), "(?<=.)/+$", "")
    full = ft.normalize_path(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(base, F.lit("/"), path)))
    full = F.regexp_replace(full, "(?<=.)/+$", "")
    return (full == base) | F.startswith(full, F.concat(base, F.lit("/"))) | (base == "/")


def nearest_config(folders: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """``folder, config``: for each folder the file of a name in it or in the nearest folder above it; null if there is none.

    ``files(path)`` is a listing. A folder meets only the folders above it, as many as it has parts, in an equi-join.
    """
    parts = F.split(F.regexp_replace("folder", "/+$", ""), "/")
    ups = folders.select("folder").distinct().select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("up"))
    held = files.where(F.regexp_extract("path", "[^/]*$", 0) == name).select(F.regexp_replace("path", "/?[^/]*$", "").alias("up"), F.col("path").alias("config"))
    return ups.join(held, "up", "left").groupBy("folder").agg(F.max_by("config", F.when(F.col("config").isNotNull(), F.length("up"))).alias("config"))


def expanded(prompts: DataFrame, library: DataFrame) -> DataFrame:
    """``name, text, error``: prompts with their ``{{include: name}}`` replaced by the texts of a library, each in a tag that names it.

    Texts are put together from the leaves up: a text is ready once all that it
    includes are, a round a level, so chains may be of any depth. What is never ready
    includes a loop, which is an error, as is a missing name below a text.
    """
    mark = r"\{\{include:\s*([^}]+?)\s*\}\}"
    own = prompts.select(F.lit(True).alias("top"), "name", "text").unionByName(library.select(F.lit(False).alias("top"), "name", "text"))
    cut = own.select("top", "name", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), mark, "\x00\x01$1\x00"), "\x00")).alias("k", "piece"))
    wanted = F.when(F.startswith("piece", F.lit("\x01")), F.substring("piece", 2, 1 << 30))
    there = library.select(F.col("name").alias("wanted"), F.lit(True).alias("there")).distinct()
    left = settle(cut.withColumn("wanted", wanted).join(there, "wanted", "left"))
    tops = settle(prompts.select("name", F.col("text").isNull().alias("none")))
    done = left.limit(0).select("top", "name", F.lit("").alias("said"), F.lit("").alias("error"))
    while True:
        ready = done.where("NOT top").select(F.col("name").alias("wanted"), "said", F.col("error").alias("below"), F.lit(True).alias("known"))
        met = left.join(ready, "wanted", "left")
        said = F.when(F.col("wanted").isNull(), F.col("piece")).otherwise(F.concat(F.lit('<file name="'), "wanted", F.lit('">\n'), "said", F.lit("\n</file>")))
        error = F.when(F.col("wanted").isNotNull() & F.col("there").isNull(), F.concat("wanted", F.lit(" is missing"))).otherwise(F.col("below"))
        rows = met.groupBy("top", "name").agg(
            F.bool_and(F.col("wanted").isNull() | F.col("known").isNotNull()).alias("all"), F.min(error).alias("error"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce(said, F.lit("")).alias("s")))), lambda x: x["s"]), "").alias("said"),
        )
        fresh = settle(rows.where(F.col("all") | F.col("error").isNotNull()).select("top", "name", "said", "error"))
        if fresh.isEmpty():
            break
        done = done.unionByName(fresh)
        left = left.join(fresh.select("top", "name"), ["top", "name"], "left_anti")
    found = tops.join(done.where("top").select("name", "said", "error", F.lit(True).alias("known")), "name", "left")
    return found.select("name", F.when(F.col("error").isNull() & ~F.col("none"), F.col("said")).alias("text"), F.when(F.col("known").isNull(), "includes itself").otherwise(F.col("error")).alias("error"))
