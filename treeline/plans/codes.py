"""Queries of blocks, codes, checksums, binary sources, and code made from symbols, over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from treeline.functions import datatypes as dt
from treeline.operators import codec, codemap, deflate, sourcecode
from treeline.registry import registry
from treeline.session import table
from treeline.sources import binary, files, markup
from treeline.streaming import streams


@registry.add("c05_block_bits", "SELECT p_partkey AS doc_id, 8 * strlen(p_brand) + 40 AS stored, 10 + 8 * strlen(p_brand) AS fixed, 'fixed' AS way, (10 + 8 * strlen(p_brand) + 7) // 8 AS n_bytes, md5(p_brand) AS digest FROM part")
def c05_block_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact bits of texts too short for matches: eight a letter in a fixed block, and which way is taken."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.encode("p_brand", "UTF-8").alias("data"))
    got = deflate.packed(p)
    return got.select("doc_id", "stored", "fixed", F.array_join("ways", ",").alias("way"), F.octet_length("packed").cast("long").alias("n_bytes"), F.md5(codec.decompressed(F.col("packed"), "deflate")).alias("digest"))


@registry.add("c02_blocks", "SELECT c_custkey AS doc_id, md5(repeat('0123456789', 3) || string_agg(o_orderkey::VARCHAR || '.' || o_orderpriority, ';' ORDER BY o_orderkey) || c_name) AS digest, strlen(repeat('0123456789', 3) || string_agg(o_orderkey::VARCHAR || '.' || o_orderpriority, ';' ORDER BY o_orderkey) || c_name)::BIGINT AS last_end, true AS ascending FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def c02_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams cut into blocks of the least bits, read back by another inflater; the blocks' ends cover the text in order."""
    said = F.struct("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("."), "o_orderpriority").alias("s"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["s"]), ";").alias("s"))
    c = table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"))
    data = F.encode(F.concat(F.lit("0123456789" * 3), "s", "c_name"), "UTF-8")
    got = deflate.packed(c.select(F.col("c_custkey").alias("doc_id"), data.alias("data")))
    ordered = F.forall(F.sequence(F.lit(1), F.size("ends")), lambda k: (k == 1) | (F.element_at("ends", k) > F.element_at("ends", F.greatest(k - 1, F.lit(1)))))
    return got.select("doc_id", F.md5(codec.decompressed(F.col("packed"), "deflate")).alias("digest"), F.element_at("ends", -1).alias("last_end"), ordered.alias("ascending"))


@registry.add("c04_supplier_codes", "SELECT l_suppkey, sum(n)::BIGINT AS n, (CASE count(*) WHEN 1 THEN sum(n) WHEN 2 THEN sum(n) ELSE 2 * sum(n) - max(n) END)::BIGINT AS bits, CASE count(*) WHEN 1 THEN 0.5 ELSE 1.0 END AS kraft FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def c04_supplier_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths for each supplier's return flags: all bits, and whether the code is complete."""

    @pandas_udf("array<int>")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([codec.code_lengths([int(n) for n in c], 15) for c in s], dtype=object)

    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("l_suppkey").agg(F.array_sort(F.collect_list("n")).alias("counts")).withColumn("lengths", lengths("counts"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return per.select(
        "l_suppkey", total("counts").alias("n"), total(F.zip_with("counts", "lengths", lambda n, b: n * b)).alias("bits"),
        F.aggregate("lengths", F.lit(0.0), lambda acc, b: acc + F.pow(F.lit(2.0), -b)).alias("kraft"),
    )


LENGTHS = "(3,257,0),(4,258,0),(5,259,0),(6,260,0),(7,261,0),(8,262,0),(9,263,0),(10,264,0),(11,265,1),(13,266,1),(15,267,1),(17,268,1),(19,269,2),(23,270,2),(27,271,2),(31,272,2),(35,273,3),(43,274,3),(51,275,3),(59,276,3),(67,277,4),(83,278,4),(99,279,4),(115,280,4),(131,281,5),(163,282,5),(195,283,5),(227,284,5),(258,285,0)"


@registry.add("c06_symbols_of_parts", f"""WITH l(base, symbol, extra) AS (VALUES {LENGTHS}), d AS (SELECT s AS symbol, CASE WHEN s < 4 THEN s + 1 ELSE (2 + s % 2) * (1 << (s // 2 - 1)) + 1 END AS base, greatest(s // 2 - 1, 0) AS extra FROM range(30) r(s)),
p AS (SELECT p_partkey, 3 + p_partkey % 256 AS n, 1 + (p_partkey * 7919) % 32768 AS far FROM part)
SELECT p_partkey, (SELECT arg_max(symbol, base) FROM l WHERE base <= n)::INT AS length_symbol, (SELECT arg_max(extra, base) FROM l WHERE base <= n)::INT AS length_bits, (SELECT arg_max(symbol, base) FROM d WHERE base <= far)::INT AS dist_symbol, (SELECT arg_max(extra, base) FROM d WHERE base <= far)::INT AS dist_bits FROM p""")
def c06_symbols_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and extra bits of a length and a distance for each part, against the format's own tables."""
    n, far = 3 + F.col("p_partkey") % 256, 1 + (F.col("p_partkey") * 7919) % 32768
    return table(spark, sf_dir, "part").select("p_partkey", codec.length_symbol(n).alias("length_symbol"), codec.length_extra_bits(n).alias("length_bits"), codec.distance_symbol(far).alias("dist_symbol"), codec.distance_extra_bits(far).alias("dist_bits"))


@registry.add("c08_checksums_of_parts", """
WITH crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
p AS (SELECT p_partkey, [CAST(ord(c) AS BIGINT) FOR c IN string_split(p_name || p_type, '')] AS b FROM part),
n AS (SELECT p_partkey, b, len(b) AS n FROM p)
SELECT p_partkey, xor(list_reduce(list_prepend(4294967295, b), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295)::BIGINT AS crc,
  (((n + list_sum([b[i] * (n - i + 1) FOR i IN range(1, n + 1)])) % 65521) * 65536 + (1 + list_sum(b)) % 65521)::BIGINT AS adler FROM n, crc_table""")
def c08_checksums_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both checksums of each part's texts."""
    data = F.encode(F.concat("p_name", "p_type"), "UTF-8")
    return table(spark, sf_dir, "part").select("p_partkey", F.crc32(data).alias("crc"), codec.adler32(data).alias("adler"))


# ---- binary sources -----------------------------------------------------------------------------------------------


@registry.add("s21_binary_files", """SELECT 'd' || page_id % 5 || '/' || page_id || '.html' AS path, CASE (page_id // 4) % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'gzip' WHEN 2 THEN 'xz' END AS codec, CASE WHEN (page_id // 4) % 4 < 3 THEN CASE page_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16-be' WHEN 2 THEN 'iso8859-1' ELSE 'utf-8' END END AS encoding,
CASE WHEN (page_id // 4) % 4 < 3 THEN md5(CASE page_id % 4 WHEN 2 THEN '<html><meta charset="iso-8859-1">é ' || url ELSE html END) END AS digest, CASE WHEN (page_id // 4) % 4 = 3 THEN 'cannot be expanded' END AS error FROM pages""")
def s21_binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files in four encodings, plain, gzip, xz and broken, read back by their bytes alone."""
    k, way = F.col("page_id") % 4, F.floor(F.col("page_id") / 4) % 4
    latin = F.encode(F.concat(F.lit('<html><meta charset="iso-8859-1">é '), "url"), "ISO-8859-1")
    body = F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("html", "UTF-8"))).when(k == 1, F.encode("html", "UTF-16")).when(k == 2, latin).otherwise(F.encode("html", "UTF-8"))

    @pandas_udf("binary")
    def pack(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import lzma

        for data, how in batches:
            yield pd.Series([lzma.compress(bytes(b)) if h == 2 else b for b, h in zip(data, how, strict=True)])

    zipped = codec.compressed(body, "gzip")
    content = F.when(way == 1, zipped).when(way == 3, F.substring(zipped, 1, 20)).otherwise(pack(body, way))
    folder = streams.shared_folder(spark, "binary")
    pages = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("d"), (F.col("page_id") % 5).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html"))
    binary.write_files(pages.select(path.alias("path"), content.alias("content")), folder)
    return binary.documents(spark, folder, "*.html").select("path", "codec", "encoding", F.md5("text").alias("digest"), "error")


# ---- code from symbols --------------------------------------------------------------------------------------------


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, text``: a header and a C source for each part, and Rust for some of them."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    forms = {
        "h": "int fn_%1$s(int a);\n", "c": "#define SIZE_%1$s %2$s\nstatic int helper_%1$s(int a) {\n  return a + SIZE_%1$s;\n}\nint fn_%1$s(int a) {\n  return helper_%1$s(a);\n}\n",
        "rs": "pub fn fn_%1$s(a: i32) -> i32 {\n    a + %2$s\n}\n",
    }
    rust = forms["rs"].replace("a + %2$s", "unimplemented!()")
    one = lambda rows, name, form: rows.select(F.format_string(name, "p_partkey").alias("file"), F.format_string(form, "p_partkey", "p_size").alias("text"))
    k = F.col("p_partkey") % 5
    out = one(p, "p%s.h", forms["h"]).unionByName(one(p, "p%s.c", forms["c"])).unionByName(one(p.where(k >= 1), "p%s_ffi.rs", 'extern "C" fn fn_%1$s(a: i32) -> i32;\n'))
    return out.unionByName(one(p.where(k == 2), "p%s.rs", rust)).unionByName(one(p.where(k >= 3), "p%s.rs", forms["rs"]))


@registry.add("k09_markdown", """SELECT 'p' || p_partkey || '.c' AS file, '## p' || p_partkey || '.c' || chr(10) || chr(10) || '### Defines' || chr(10) || '- **SIZE_' || p_partkey || '**:1' || chr(10) || '  ```c' || chr(10) || '  #define SIZE_' || p_partkey || ' ' || p_size || chr(10) || '  ```' || chr(10) || chr(10)
|| '### Functions' || chr(10) || '- **fn_' || p_partkey || '**:5 (1 deps)' || chr(10) || '  ```c' || chr(10) || '  int fn_' || p_partkey || '(int a)' || chr(10) || '  ```' || chr(10) || '- **helper_' || p_partkey || '**:2 [STATIC]' || chr(10) || '  ```c' || chr(10) || '  static int helper_' || p_partkey || '(int a)' || chr(10) || '  ```' || chr(10) AS markdown FROM part""")
def k09_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository maps in Markdown, a section a file, with kinds, lines, dependencies and signatures."""
    s = sourcecode.extract(sources(spark, sf_dir)).where("language = 'c'")
    s = codemap.newest(s).withColumns({"n_deps": F.size("calls"), "in_cycle": F.lit(False)})
    return codemap.repository_map(s)


@registry.add("n30_locations_of_parts", """SELECT name || p_partkey AS name, CASE WHEN name = 'fn_' THEN 'p' || p_partkey || '.h' END AS header, 'p' || p_partkey || '.c' AS source, CASE WHEN name = 'fn_' AND p_partkey % 5 >= 2 THEN 'p' || p_partkey || '.rs' END AS rust, CASE WHEN name = 'fn_' AND p_partkey % 5 >= 1 THEN 'p' || p_partkey || '_ffi.rs' END AS binding,
'p' || p_partkey || '.c' AS file, CASE WHEN name <> 'fn_' OR p_partkey % 5 = 0 THEN 'p' || p_partkey || '.c' WHEN p_partkey % 5 = 1 THEN 'p' || p_partkey || '_ffi.rs' ELSE 'p' || p_partkey || '.rs' END AS code_file FROM part, (VALUES ('fn_'), ('helper_'), ('SIZE_')) v(name)""")
def n30_locations_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each symbol lies: header, source, Rust, binding; which one is shown, and where its code is read."""
    return codemap.locations(sourcecode.extract(sources(spark, sf_dir)))


@registry.add("j14_port_status", """SELECT name || p_partkey AS name, errors = '' AS done, errors FROM (SELECT p_partkey, name, concat_ws('; ',
  CASE WHEN name <> 'fn_' OR p_partkey % 5 = 0 THEN 'FFI binding for ''' || name || p_partkey || ''' not found' END,
  CASE WHEN name = 'SIZE_' THEN NULL WHEN name = 'helper_' OR p_partkey % 5 < 2 THEN 'Rust implementation for ''' || name || p_partkey || ''' not found' WHEN p_partkey % 5 = 2 THEN 'Implementation for ''' || name || p_partkey || ''' is still a stub' END,
  CASE WHEN name = 'SIZE_' THEN NULL WHEN name = 'helper_' OR p_partkey % 5 < 3 THEN 'Fuzz test for ''' || name || p_partkey || ''' not found' WHEN p_partkey % 5 = 3 THEN 'Fuzz test for ''' || name || p_partkey || ''' not properly defined' END) AS errors FROM part, (VALUES ('fn_'), ('helper_'), ('SIZE_')) v(name))""")
def j14_port_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each C symbol whether its binding, implementation and fuzz test are there."""
    files = sources(spark, sf_dir)
    bodies = files.where("file LIKE '%.rs' AND NOT file LIKE '%ffi.rs'").select(F.regexp_extract("text", r"fn (\w+)", 1).alias("name"), "text")
    p = table(spark, sf_dir, "part").where("p_partkey % 5 >= 3")
    fuzz = p.select(F.format_string("fn_%s", "p_partkey").alias("name"), F.concat(F.when(F.col("p_partkey") % 5 == 3, "").otherwise("fuzz_target!(|a| "), F.format_string("fn_%s(a))", "p_partkey")).alias("text"))
    got = codemap.port_status(sourcecode.extract(files), bodies, fuzz)
    return got.select("name", "done", F.array_join("errors", "; ").alias("errors"))


@registry.add("t19_transpiled", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'pub const K: i32 = ' || p_size || ';' WHEN 1 THEN 'pub const K: u32 = ' || p_size || ';' WHEN 2 THEN 'pub const K: [f64; 2] = [' || p_size || '.5, 2.0];' WHEN 3 THEN 'pub const K: &str = "' || p_name || '";'
WHEN 4 THEN '#[repr(C)]' || chr(10) || '#[derive(Debug, Clone, Copy, PartialEq, Eq)]' || chr(10) || 'pub enum K {' || chr(10) || '    A_' || p_size || ' = ' || p_size || ',' || chr(10) || '    B,' || chr(10) || '}' END AS code, CASE WHEN p_partkey % 6 = 5 THEN 'no simple value' END AS error FROM part""")
def t19_transpiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defines, constants, arrays, strings and enums as Rust, and what isn't one literal."""
    k = F.col("p_partkey") % 6
    forms = ["#define K %1$sUL", "static const unsigned int K = %1$su;", "const double K[] = { %1$s.5f, 2.0 };", 'const char *K = "%2$s";', "enum K { /* first */ A_%1$s = %1$s,\n  B, // last\n}", "#define K (%1$s + 1)"]
    texts = F.array(*[F.format_string(f, "p_size", "p_name") for f in forms])
    kinds = F.array(*map(F.lit, ("define", "const", "const", "const", "enum", "define")))
    got = codemap.transpiled(F.element_at(kinds, (k + 1).cast("int")), F.lit("K"), F.element_at(texts, (k + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", got.alias("x")).select("p_partkey", "x.code", "x.error")


@registry.add("f19_typedefs_of_parts", "SELECT p_partkey, p_partkey % 6 NOT IN (2, 3) AS simple FROM part")
def f19_typedefs_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typedef for each part: a basic type, a struct's name, a body, another type, a pointer, a name in another case."""
    forms = ["typedef unsigned long C%1$s;", "typedef struct _N%1$s N%1$s;", "typedef struct { int x; } N%1$s;", "typedef Node%1$s Edge%1$s;", "typedef int (*H%1$s)(void *);", "typedef my_node%1$s MyNode%1$s;"]
    text = F.element_at(F.array(*[F.format_string(f, "p_partkey") for f in forms]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", codemap.simple_typedef(text).alias("simple"))


# ---- entities, pluggable input, types -----------------------------------------------------------------------------


@registry.add("t16_entities_of_texts", "SELECT doc_id, md5(text) AS decoded, (strlen(text) - strlen(replace(text, 'é', ''))) // 2 AS eacute, text IS NOT NULL AND regexp_full_match(text, '[ -~\\t\\n\\r]*') AS ascii FROM documents")
def t16_entities_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with their characters as entities, by name or number, and read back."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", markup.entities(F.col("text")).alias("e"))
    named = F.regexp_count("e", F.lit("&eacute;")).cast("long")
    plain = F.coalesce(~F.col("text").rlike("[^ -~\\t\\n\\r]"), F.lit(False))
    return d.select("doc_id", F.md5(markup.entities(F.col("e"), decode=True)).alias("decoded"), named.alias("eacute"), plain.alias("ascii"))


@registry.add("s17_read_back", "SELECT doc_id % 10 AS k, count(*) AS n, sum(strlen(source))::BIGINT AS size FROM documents GROUP BY ALL")
def s17_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written by the pluggable output and read by the input, its files dealt into partitions by their lines."""
    spark.dataSource.register(files.LinesSource)
    folder = streams.shared_folder(spark, "plugged")
    rows = table(spark, sf_dir, "documents").select(F.lit(0).alias("doc"), F.lit(0).alias("line"), F.concat((F.col("doc_id") % 10).cast("string"), F.lit(" "), F.col("source")).alias("text"))
    rows.repartition(7).write.format("lines").option("folder", folder).option("codec", "gzip").mode("append").save()
    got = spark.read.format("lines").option("folder", folder).option("split", "300").load()
    return got.groupBy(F.substring("text", 1, 1).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.substring("text", 3, 1 << 30))).cast("long").alias("size"))


@registry.add("d12_types_of_parts", "SELECT p_partkey, name, base, depth FROM part JOIN (VALUES (0, 'byte', 'short', 6), (1, 'ID', 'NCName', 6), (2, 'token', 'normalizedString', 3), (3, 'unsignedByte', 'unsignedShort', 7), (4, 'decimal', 'anySimpleType', 1)) v(k, name, base, depth) ON k = p_partkey % 5")
def d12_types_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type for each part with its base and its depth, looked up in the table of all built-in types."""
    known = spark.createDataFrame([(n, dt.TYPES[n][0], len(dt.ancestry(n)) - 1) for n in dt.TYPES], "name string, base string, depth int")
    name = F.element_at(F.array(*map(F.lit, ("byte", "ID", "token", "unsignedByte", "decimal"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).join(F.broadcast(known), "name").select("p_partkey", "name", "base", "depth")
