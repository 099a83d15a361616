"""The operators whose other queries are small cases, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import datatypes as dt
from treeline.functions import text as ft
from treeline.operators import sourcecode, textsearch, toolbox
from treeline.plans.scalars import over
from treeline.registry import registry
from treeline.session import table

K, SIZE, ORDER = F.col, lambda: F.col("p_size"), lambda: F.col("o_orderkey")


def pick(*values: str):
    """One of several texts by the remainder of a number."""
    return lambda n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


over("d01_valid_columns", "orders", {"k": lambda: ORDER(), "int_ok": lambda: dt.valid(ORDER().cast("string"), "int"), "byte_ok": lambda: dt.valid(ORDER().cast("string"), "byte"), "name_ok": lambda: dt.valid(F.col("o_orderstatus"), "NCName"), "token_ok": lambda: dt.valid(F.col("o_orderpriority"), "NMTOKEN"), "digits_ok": lambda: dt.valid(F.col("o_orderpriority"), "NCName")},
     "SELECT o_orderkey AS k, true AS int_ok, o_orderkey < 128 AS byte_ok, true AS name_ok, NOT contains(o_orderpriority, ' ') AS token_ok, false AS digits_ok FROM orders")
over("d02_valid_dates", "orders", {"k": lambda: ORDER(), "date_ok": lambda: dt.valid(F.concat(F.date_format("o_orderdate", "yyyy-"), F.when(ORDER() % 9 == 0, "02-30").otherwise(F.date_format("o_orderdate", "MM-dd"))), "date"), "time_ok": lambda: dt.valid(F.format_string("%02d:%02d:00", (ORDER() % 26).cast("int"), (ORDER() % 60).cast("int")), "time"), "leap_ok": lambda: dt.valid(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-29")), "date")},
     "SELECT o_orderkey AS k, o_orderkey % 9 <> 0 AS date_ok, o_orderkey % 26 < 24 OR (o_orderkey % 26 = 24 AND o_orderkey % 60 = 0) AS time_ok, year(o_orderdate) % 4 = 0 AS leap_ok FROM orders")
over("d03_durations_of_parts", "part", {"p_partkey": lambda: F.col("p_partkey"), "months": lambda: dt.duration(F.format_string("P%sY%sM2D", SIZE(), SIZE()))["months"], "seconds": lambda: dt.duration(F.format_string("-PT%sM%s.5S", SIZE(), SIZE()))["seconds"]},
     "SELECT p_partkey, 13 * p_size AS months, -(60 * p_size + p_size + 0.5)::DOUBLE AS seconds FROM part")
over("d05_durations_compared", "part", {"p_partkey": lambda: F.col("p_partkey"), "cmp": lambda: dt.compare_durations(dt.duration(F.format_string("P%sM", SIZE())), dt.duration(F.lit("P2Y"))), "days": lambda: dt.compare_durations(dt.duration(F.format_string("P%sD", SIZE())), dt.duration(F.lit("P1M")))},
     "SELECT p_partkey, sign(p_size - 24)::INT AS cmp, CASE WHEN p_size < 28 THEN -1 WHEN p_size > 31 THEN 1 ELSE 2 END AS days FROM part")
over("d07_decimals_compared", "part", {"p_partkey": lambda: F.col("p_partkey"), "cmp": lambda: dt.compare_floats(F.concat(F.lit("00"), SIZE().cast("string"), F.lit(".500")).try_cast("decimal(38,8)"), F.concat(SIZE().cast("string"), F.when(SIZE() % 2 == 0, ".5").otherwise(".50001")).try_cast("decimal(38,8)")), "floats": lambda: dt.compare_floats(F.col("p_retailprice"), SIZE() * 50.0)},
     "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0 ELSE -1 END AS cmp, sign(p_retailprice - p_size * 50.0)::INT AS floats FROM part")
over("d10_canonical_numbers", "part", {"p_partkey": lambda: F.col("p_partkey"), "decimal": lambda: dt.canonical(F.concat(F.lit("+0"), SIZE().cast("string"), F.lit(".50")), "decimal"), "whole": lambda: dt.canonical(F.concat(F.lit("-00"), SIZE().cast("string")), "integer"), "hex": lambda: dt.canonical(F.lower(F.hex(F.col("p_brand"))), "hexBinary")},
     "SELECT p_partkey, p_size || '.5' AS decimal, '-' || p_size AS whole, hex(encode(p_brand)) AS hex FROM part")
over("f10_schema_patterns", "part", {"p_partkey": lambda: F.col("p_partkey"), "brand": lambda: dt.whole(F.col("p_brand"), dt.java_pattern("Brand#[1-3]{1,2}")), "consonant": lambda: dt.whole(F.substring("p_name", 1, 1), dt.java_pattern("[a-z-[aeiou]]")), "name": lambda: dt.whole(F.col("p_type"), dt.java_pattern(r"\i\c*"))},
     "SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[1-3]{1,2}') AS brand, p_name[1] NOT IN ('a', 'e', 'i', 'o', 'u') AS consonant, NOT contains(p_type, ' ') AS name FROM part")
over("f15_blocks_of_texts", "documents", {"doc_id": lambda: F.col("doc_id"), "latin1": lambda: dt.whole(F.substring("text", 1, 1), dt.java_pattern(r"\p{IsLatin-1Supplement}")), "upper": lambda: dt.whole(F.substring("text", 1, 1), dt.java_pattern(r"\p{Lu}"))},
     r"SELECT doc_id, text <> '' AND unicode(left(text, 1)) BETWEEN 128 AND 255 AS latin1, regexp_full_match(left(text, 1), '\p{Lu}') AS upper FROM documents")
over("f17_kept_parts", "part", {"p_partkey": lambda: F.col("p_partkey"), "kept": lambda: sourcecode.kept(SIZE() % 3 == 0, SIZE() % 2 == 0, SIZE())}, "SELECT p_partkey, p_size % 3 = 0 OR (p_size % 2 <> 0 AND p_size > 10) AS kept FROM part")
over("f18_guards_of_parts", "part", {"p_partkey": lambda: F.col("p_partkey"), "guard": lambda: sourcecode.guard(F.concat(F.lit("P_"), pick("H", "MAX", "H", "EMPTY")(SIZE())), pick("1", "64", "1", " ")(SIZE()))}, "SELECT p_partkey, p_size % 4 <> 1 AS guard FROM part")
over("t12_paths_of_parts", "part", {"p_partkey": lambda: F.col("p_partkey"), "normal": lambda: ft.normalize_path(F.concat(F.lit("/a/./"), F.regexp_replace("p_name", " ", "/../"), F.lit("/x/..")))}, "SELECT p_partkey, '/a/' || split_part(p_name, ' ', -1) || '/' AS normal FROM part")
over("t14_public_ids_of_parts", "part", {"p_partkey": lambda: F.col("p_partkey"), "normal": lambda: ft.public_id(F.concat(F.lit("  -//"), F.regexp_replace("p_name", " ", "  \n"), F.lit("//EN "))), "unwrapped": lambda: ft.unwrap_urn(F.concat(F.lit("urn:publicid:-:"), F.regexp_replace("p_name", " ", "+"), F.lit(":EN")))}, "SELECT p_partkey, '-//' || p_name || '//EN' AS normal, '-//' || p_name || '//EN' AS unwrapped FROM part")
over("t18_types_of_literals", "part", {"p_partkey": lambda: F.col("p_partkey"), "kind": lambda: ft.literal_type(F.when(SIZE() % 5 == 0, SIZE().cast("string")).when(SIZE() % 5 == 1, F.concat(SIZE().cast("string"), F.lit(".25"))).when(SIZE() % 5 == 2, F.concat(F.lit('"'), "p_name", F.lit('"'))).when(SIZE() % 5 == 3, F.concat(F.lit("0x"), F.hex(SIZE()))).otherwise(F.concat(F.lit("F("), "p_brand", F.lit(")"))))},
     "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'i32' WHEN 1 THEN 'f64' WHEN 2 THEN '&str' WHEN 3 THEN 'u32' ELSE 'error' END AS kind FROM part")
over("s13_bom_of_texts", "documents", {"doc_id": lambda: F.col("doc_id"), "encoding": lambda: ft.bom_encoding(F.concat(F.unhex(pick("EFBBBF", "FEFF", "FFFE", "")(F.col("doc_id"))), F.encode(F.concat(F.lit("x"), F.col("text")), "UTF-8")))}, "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'UTF-16BE' WHEN 2 THEN 'UTF-16LE' END AS encoding FROM documents")
over("s15_aliases_of_sources", "documents", {"doc_id": lambda: F.col("doc_id"), "canonical": lambda: ft.canonical_encoding(pick("latin1", "Utf8", "utf-8", "own")(F.col("doc_id")), {"OWN": "ISO-8859-2"})}, "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ISO-8859-1' WHEN 3 THEN 'ISO-8859-2' ELSE 'UTF-8' END AS canonical FROM documents")


@registry.add("d04_dates_compared", "SELECT o_orderkey AS k, (1 - o_orderkey % 3)::INT AS cmp FROM orders")
def d04_dates_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's date against the day before, the same day and the day after."""
    o = table(spark, sf_dir, "orders").select(ORDER().alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("a"), F.date_format(F.date_add(F.to_date("o_orderdate"), (ORDER() % 3 - 1).cast("int")), "yyyy-MM-dd").alias("b"))
    parts = o.select("k", dt.date_parts(F.col("a")).alias("x"), dt.date_parts(F.col("b")).alias("y"))
    return parts.select("k", dt.compare_dates(F.col("x"), F.col("y")).alias("cmp"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A C source for each part: a constant, a helper, and a function that calls it."""
    form = "#define SIZE_%1$s %2$s\nstatic int helper_%1$s(int a) {\n  return a + SIZE_%1$s; /* not helper_0(a) */\n}\nint fn_%1$s(int a);\nint fn_%1$s(int a) {\n  return helper_%1$s(a);\n}\n"
    return table(spark, sf_dir, "part").select(F.format_string("p%s.c", "p_partkey").alias("file"), F.format_string(form, "p_partkey", "p_size").alias("text"))


@registry.add("n27_symbols_of_parts", "SELECT 'p' || p_partkey || '.c' AS file, name || p_partkey AS name, kind, is_static, is_definition, line FROM part, (VALUES ('SIZE_', 'define', false, true, 1), ('helper_', 'function', true, true, 2), ('fn_', 'function', false, false, 5), ('fn_', 'function', false, true, 6)) v(name, kind, is_static, is_definition, line)")
def n27_symbols_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of one source a part."""
    return sourcecode.extract(code(spark, sf_dir)).select("file", "name", "kind", "is_static", "is_definition", "line")


@registry.add("n29_calls_of_parts", "SELECT 'fn_' || p_partkey AS src, 'helper_' || p_partkey AS dst FROM part")
def n29_calls_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between the symbols of all sources."""
    return sourcecode.call_edges(sourcecode.extract(code(spark, sf_dir)))


@registry.add("j13_merged_parts", "SELECT name || p_partkey AS name, CASE WHEN name = 'fn_' THEN 'p' || p_partkey || '.c' END AS declaration_file, 'p' || p_partkey || '.c' AS definition_file, n FROM part, (VALUES ('fn_', 2), ('helper_', 1)) v(name, n)")
def j13_merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations and definitions of all sources in one row a function."""
    merged = sourcecode.merge(sourcecode.extract(code(spark, sf_dir)).where("kind = 'function'"))
    return merged.select("name", "declaration_file", "definition_file", F.col("n").cast("int").alias("n"))


@registry.add("k09_map_of_parts", "SELECT 'p' || p_partkey || '.c' AS file, 'fn_' || p_partkey || ',helper_' || p_partkey AS names FROM part")
def k09_map_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions by file, sorted."""
    s = sourcecode.extract(code(spark, sf_dir)).where("kind = 'function' and is_definition")
    return s.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@registry.add("j12_unified_parts", "SELECT 'S' || p_partkey AS struct, 'T' || p_partkey AS typedef FROM part WHERE p_partkey % 2 = 0")
def j12_unified_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs of all parts with the typedefs of every second one."""
    p = table(spark, sf_dir, "part")
    typedefs = p.where("p_partkey % 2 = 0").select(F.format_string("T%s", "p_partkey").alias("name"), F.format_string("struct S%s", "p_partkey").alias("body"))
    return sourcecode.unify(p.select(F.format_string("S%s", "p_partkey").alias("name")), typedefs)


@registry.add("m04_patched_parts", "SELECT 'f' || p_partkey AS file, CASE WHEN p_partkey % 3 = 2 THEN p_name || chr(10) || 'if  (' || p_type || ')' || chr(10) || 'end' ELSE p_name || chr(10) || 'X' || p_partkey || chr(10) || 'end' END AS text, CASE WHEN p_partkey % 3 = 2 THEN 'search text not found' END AS error FROM part")
def m04_patched_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch for each part's text: exact, by squeezed white space, and one that fits nowhere."""
    k = F.col("p_partkey")
    wanted = F.when(k % 3 == 0, F.concat(F.lit("if  ("), "p_type", F.lit(")"))).when(k % 3 == 1, F.concat(F.lit("if ("), "p_type", F.lit(")"))).otherwise(F.lit("0123456789 0123456789 0123456789"))
    block = F.concat(F.lit("<<<<<<< SEARCH\n"), wanted, F.lit("\n=======\nX"), k.cast("string"), F.lit("\n>>>>>>> REPLACE"))
    rows = table(spark, sf_dir, "part").select(F.format_string("f%s", "p_partkey").alias("file"), F.concat("p_name", F.lit("\nif  ("), "p_type", F.lit(")\nend")).alias("text"), block.alias("patch"))
    return textsearch.patch_files(rows)


@registry.add("e01_calls_of_parts", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{"result": ' || (p_partkey + p_size) || '}' WHEN 1 THEN '{"details": ["missing argument b"], "error": "invalid arguments"}' ELSE '{"details": ["add"], "error": "unknown tool sub"}' END AS result FROM part""")
def e01_calls_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool called for each part: with its arguments, with one missing, and one that isn't there."""
    box = toolbox.Toolbox()

    @box.register
    def add(a: int, b: int) -> int:
        """The sum."""
        return a + b

    k = F.col("p_partkey")
    args = F.when(k % 3 == 1, F.to_json(F.struct(k.alias("a")))).otherwise(F.to_json(F.struct(k.alias("a"), F.col("p_size").alias("b"))))
    return table(spark, sf_dir, "part").select("p_partkey", box.column(F.when(k % 3 == 2, "sub").otherwise("add"), args).alias("result"))


@registry.add("e12_roles_called", "SELECT conv_id, bool_or(role = 'assistant') AS called FROM conversations GROUP BY ALL")
def e12_roles_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a name was called in each conversation: the roles are the calls."""
    calls = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("name"), F.lit("{}").alias("args"))).alias("calls"))
    return calls.select("conv_id", toolbox.tool_called(F.col("calls"), "assistant").alias("called"))
