"""What is made of extracted symbols: a map in Markdown, locations by role, port status, transpiled constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions.text import literal_type

#: Signatures shorter than this are shown in maps.
SHOWN = 100
#: Kinds of symbols that have an implementation and a fuzz test.
IMPLEMENTED = ("function",)


def repository_map(symbols: DataFrame) -> DataFrame:
    """``file, markdown``: a section a file, its symbols by kind, then by name.

    ``symbols(file, kind, name, line, signature, language, n_deps, is_static, in_cycle)``;
    a file's section is a row, so no map of all files is held in one place.
    """
    flag = lambda name, text: F.when(F.coalesce(F.col(name), F.lit(False)), text).otherwise("")
    item = F.concat(
        F.lit("- **"), "name", F.lit("**"), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")),
        F.when(F.col("n_deps") > 0, F.concat(F.lit(" ("), F.col("n_deps").cast("string"), F.lit(" deps)"))).otherwise(""), flag("in_cycle", " [CYCLE]"), flag("is_static", " [STATIC]"),
        F.when(F.length("signature") < SHOWN, F.concat(F.lit("\n  ```"), "language", F.lit("\n  "), "signature", F.lit("\n  ```"))).otherwise(""),
    )
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"]), "\n")
    kinds = symbols.groupBy("file", "kind").agg(lines(F.struct("name", "line", item.alias("text"))).alias("items"))
    section = F.concat(F.lit("### "), F.initcap("kind"), F.lit("s\n"), "items", F.lit("\n")).alias("text")
    return kinds.groupBy("file").agg(F.concat(F.lit("## "), F.col("file"), F.lit("\n\n"), lines(F.struct("kind", section))).alias("markdown"))


def locations(symbols: DataFrame) -> DataFrame:
    """``name, header, source, rust, binding, file, code_file``: a symbol's places by what file they lie in, and the ones that are taken.

    ``file`` is the C symbol's, if there is one; ``code_file`` is where its code is
    read, with Rust first; definitions go before declarations.
    """
    at = lambda test: F.min(F.when(test, F.col("file")))
    ends = lambda s: F.endswith("file", F.lit(s))
    rust = ends(".rs") & ~F.contains("file", F.lit("ffi.rs"))
    first = lambda language: F.struct((F.col("language") != language).alias("other"), (~F.col("is_definition")).alias("declared"), "file", "line")
    return symbols.groupBy("name").agg(
        at(ends(".h")).alias("header"), at(ends(".c") & F.col("is_definition")).alias("source"), at(rust).alias("rust"), at(ends("ffi.rs")).alias("binding"),
        F.min(first("c"))["file"].alias("file"), F.min(first("rust"))["file"].alias("code_file"),
    )


def port_status(symbols: DataFrame, rust_texts: DataFrame, fuzz: DataFrame) -> DataFrame:
    """``name, done, errors``: for each C symbol whether its binding, implementation and fuzz test are there.

    ``rust_texts(name, text)`` are the bodies of Rust definitions, ``fuzz(name, text)`` the
    fuzz targets. Symbols of other kinds need the binding alone.
    """
    c = symbols.where("language = 'c'").groupBy("name").agg(F.bool_or(F.col("kind").isin(*IMPLEMENTED)).alias("implemented"))
    bound = symbols.where("file LIKE '%ffi.rs'").select("name", F.lit(True).alias("bound")).distinct()
    body = rust_texts.groupBy("name").agg(F.lit(True).alias("has_body"), F.bool_or(F.contains("text", F.lit("unimplemented!()"))).alias("stub"))
    target = fuzz.groupBy("name").agg(F.lit(True).alias("has_fuzz"), F.bool_or(F.contains("text", F.col("name")) & F.contains("text", F.lit("fuzz_target!"))).alias("defined"))
    all_ = c.join(bound, "name", "left").join(body, "name", "left").join(target, "name", "left")
    needs = F.col("implemented")
    errors = F.array_compact(F.array(
        F.when(F.col("bound").isNull(), F.concat(F.lit("FFI binding for '"), "name", F.lit("' not found"))),
        F.when(needs & F.col("has_body").isNull(), F.concat(F.lit("Rust implementation for '"), "name", F.lit("' not found"))).when(needs & F.col("stub"), F.concat(F.lit("Implementation for '"), "name", F.lit("' is still a stub"))),
        F.when(needs & F.col("has_fuzz").isNull(), F.concat(F.lit("Fuzz test for '"), "name", F.lit("' not found"))).when(needs & ~F.col("defined"), F.concat(F.lit("Fuzz test for '"), "name", F.lit("' not properly defined"))),
    ))
    return all_.select("name", (F.size(errors) == 0).alias("done"), errors.alias("errors"))


# Words of C types and the Rust types that they are, the first that fits counts.
RUST_TYPES = [
    ("unsigned long", "u64"), ("unsigned", "u32"), ("long", "i64"), ("int", "i32"), ("float", "f32"), ("double", "f64"),
]


def transpiled(kind: Column, name: Column, text: Column) -> Column:
    """``code, error``: defines, constants and enums as Rust; what isn't one literal is an error.

    ``text`` is the symbol's source. Null text is an error.
    """
    body = F.trim(F.regexp_extract(text, r"#[ \t]*define[ \t]+\w+[ \t]+(.*)", 1))
    bare = lambda v: F.regexp_replace(v, r"^(-?(?:0[xX][0-9A-Fa-f]+|[0-9][0-9.eE+-]*?))[uUlLfF]+$", "$1")
    define_type = literal_type(body)
    declared = F.regexp_extract(text, r"(?s)^(.*?)\b\w+\s*(?:\[[^\]]*\])?\s*=", 1)
    value = F.trim(F.regexp_extract(text, r"(?s)=\s*(.*?)\s*;", 1))
    const_type = F.when(F.contains(declared, F.lit("*")) & F.contains(declared, F.lit("char")), "&str")
    for words, rust in RUST_TYPES:
        const_type = const_type.when(F.contains(declared, F.lit(words)), rust)
    const_type = F.when(const_type.isNotNull(), const_type).otherwise(literal_type(value))
    list_ = value.rlike(r"(?s)^\{.*\}$")
    elements = F.transform(F.filter(F.split(F.regexp_extract(value, r"(?s)^\{(.*)\}$", 1), r"\s*,\s*"), lambda x: F.trim(x) != ""), lambda x: bare(F.trim(x)))
    simple = F.when(list_, F.forall(elements, lambda x: literal_type(x) != "error")).otherwise(literal_type(value) != "error")
    const_value = F.when(list_, F.concat(F.lit("["), F.array_join(elements, ", "), F.lit("]"))).otherwise(bare(value))
    const_full = F.when(list_, F.concat(F.lit("["), const_type, F.lit("; "), F.size(elements).cast("string"), F.lit("]"))).otherwise(const_type)
    const = lambda t, v: F.concat(F.lit("pub const "), name, F.lit(": "), t, F.lit(" = "), v, F.lit(";"))
    members = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_extract(text, r"(?s)\{(.*)\}", 1), r"(?s)/\*.*?\*/|//[^\n]*", ""), ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    good = F.forall(members, lambda x: x.rlike(r"^\w+( ?= ?(-?[0-9]+|0[xX][0-9A-Fa-f]+))?$"))
    variants = F.array_join(F.transform(members, lambda x: F.concat(F.lit("    "), F.regexp_replace(x, " ?= ?", " = "), F.lit(","))), "\n")
    enum = F.concat(F.lit("#[repr(C)]\n#[derive(Debug, Clone, Copy, PartialEq, Eq)]\npub enum "), name, F.lit(" {\n"), variants, F.lit("\n}"))
    code = (
        F.when((kind == "define") & (define_type != "error"), const(define_type, bare(body))).when((kind == "const") & simple, const(const_full, const_value))
        .when((kind == "enum") & good & (F.size(members) > 0), enum)
    )
    error = F.when(~F.coalesce(kind, F.lit("")).isin("define", "const", "enum"), F.concat_ws(" ", F.lit("no literal kind:"), kind)).when((kind == "enum") & (F.size(members) == 0), "no variants").otherwise("no simple value")
    return F.struct(code.alias("code"), F.when(code.isNull(), error).alias("error"))


def simple_typedef(text: Column) -> Column:
    """Typedefs that only rename: without a body, a pointer, a struct or a basic type, or a name that differs in case and underscores alone."""
    plain = F.regexp_replace(F.regexp_replace(text, r"^\s*typedef\s+", ""), r"\s*;\s*$", "")
    words = F.filter(F.split(plain, r"\W+"), lambda w: ~w.isin("", "unsigned", "signed", "const", "volatile"))
    same = F.lower(F.regexp_replace(F.element_at(words, 1), "_", "")) == F.lower(F.regexp_replace(F.element_at(words, 2), "_", ""))
    two = (F.size(words) == 2) & (F.element_at(words, 1).isin("int", "char", "float", "double", "void", "long", "short") | same)
    open_ = F.contains(text, F.lit("{")) & F.contains(text, F.lit("}"))
    return ~open_ & (F.contains(text, F.lit("*")) | F.contains(text, F.lit("struct")) | two | (F.size(words) <= 1))


def with_cycles(symbols: DataFrame, cyclic: DataFrame) -> DataFrame:
    """``symbols`` with ``in_cycle`` from ``cyclic(name)``."""
    return symbols.join(cyclic.select("name", F.lit(True).alias("in_cycle")).distinct(), "name", "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))


def newest(symbols: DataFrame) -> DataFrame:
    """One row a name and language: the definition, or else the first declaration."""
    w = Window.partitionBy("name", "language").orderBy((~F.col("is_definition")).cast("int"), "file", "line")
    return symbols.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
