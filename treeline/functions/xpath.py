"""XPath 1.0 casts, comparisons, arithmetic and string functions as Column expressions.

Everything is a built-in expression, so it stays inside whole-stage code
generation. Numbers are IEEE doubles; where Spark's own rules differ (NaN equals
NaN, division by zero raises, rounding) the difference is spelt out here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: Whole numbers from here on have no fraction; floor() and ceil() would leave the range of long.
WHOLE = 9007199254740992.0
#: Lexical form of a number: optional minus, digits with an optional point, optional exponent.
NUMBER = r"^[ \t\r\n]*-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+\-]?[0-9]+)?[ \t\r\n]*$"


def string_to_number(s: Column) -> Column:
    """number(string): NaN unless the whole string is a number; an exponent is allowed, a leading plus is not."""
    return F.when(s.rlike(NUMBER), F.trim(F.translate(s, "\t\r\n", "   ")).try_cast("double")).otherwise(F.lit(NAN))


def boolean_to_number(b: Column) -> Column:
    return F.when(b, F.lit(1.0)).otherwise(F.lit(0.0))


def number_to_boolean(n: Column) -> Column:
    return (n != 0) & ~F.isnan(n)


def string_to_boolean(s: Column) -> Column:
    return F.length(s) > 0


def boolean_to_string(b: Column) -> Column:
    return F.when(b, F.lit("true")).otherwise(F.lit("false"))


def stripped(s: Column) -> Column:
    """A decimal without trailing zeros, and without a point that nothing follows."""
    return F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+(?=$|e)", "$1"), r"\.(?=$|e)", "")


def number_to_string(n: Column) -> Column:
    """string(number): plain 32-bit integers, else up to 15 significant digits, scientific beyond 1e9 or below 1e-5."""
    size = F.abs(n)
    scientific = stripped(F.format_string("%.14e", n))
    place = F.log10(size).cast("int")  # cut toward zero
    fixed = F.lit(None).cast("string")
    for p in range(9, -6, -1):
        digits = 15 - p - (1 if p > 0 else 0)
        fixed = F.when(place == p, stripped(F.format_string(f"%.{digits}f", n))).otherwise(fixed)
    plain = (n > -2147483648.0) & (n < 2147483647.0) & (n == F.rint(n))
    return (
        F.when(F.isnan(n), F.lit("NaN"))
        .when(n == INF, F.lit("Infinity"))
        .when(n == -INF, F.lit("-Infinity"))
        .when(n == 0, F.lit("0"))
        .when(plain, n.cast("int").cast("string"))
        .when((size > 1e9) | (size < 1e-5), scientific)
        .otherwise(fixed)
    )


def passes(n: Column) -> Column:
    """Whether rounding leaves a number as it is: NaN, infinite, or too large to have a fraction."""
    return F.isnan(n) | (F.abs(n) >= WHOLE)


def below_zero(n: Column) -> Column:
    """Whether a number has a minus sign, negative zero included."""
    return (n < 0) | ((n == 0) & (n.cast("string") == "-0.0"))


def whole(n: Column, rounded: Column) -> Column:
    """A rounded number; where that is zero, it keeps the sign."""
    return F.when(passes(n), n).when((rounded == 0) & below_zero(n), F.lit(-0.0)).otherwise(rounded.cast("double"))


def floor(n: Column) -> Column:
    return whole(n, F.floor(n))


def ceiling(n: Column) -> Column:
    return whole(n, F.ceil(n))


def xround(n: Column) -> Column:
    """round(): halves go toward positive infinity."""
    return whole(n, F.floor(n + 0.5))


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    return a * b


def divide(a: Column, b: Column) -> Column:
    """IEEE division: by zero gives an infinity of the signs' product, zero or NaN by zero gives NaN."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(below_zero(a) == below_zero(b), F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """The remainder of truncating division; the dividend's sign stays."""
    odd = F.isnan(a) | F.isnan(b) | (F.abs(a) == INF) | (b == 0)
    return F.when(odd, F.lit(NAN)).when(F.abs(b) == INF, a).otherwise(F.try_mod(a, b))


def numbers_equal(a: Column, b: Column) -> Column:
    """IEEE equality: NaN equals nothing."""
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def numbers_differ(a: Column, b: Column) -> Column:
    return ~numbers_equal(a, b)


def compare(op: str, a: Column, b: Column) -> Column:
    """``< <= > >=`` on numbers; false if either is NaN."""
    known = ~F.isnan(a) & ~F.isnan(b)
    return known & {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def contains(s: Column, part: Column) -> Column:
    return F.contains(s, part)


def starts_with(s: Column, part: Column) -> Column:
    return F.startswith(s, part)


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """Characters at positions p with round(start) <= p < round(start) + round(length); no NaN bound holds any."""
    first = xround(start)
    long = F.length(s).cast("double")
    begin = F.greatest(first, F.lit(1.0))
    if length is None:
        end = long + 1
        none = F.isnan(first)
    else:
        stop = first + xround(length)
        end = F.least(stop, long + 1)
        none = F.isnan(first) | F.isnan(stop)
    none = none | (begin >= end)
    return F.when(none, F.lit("")).otherwise(F.substring(s, F.when(none, F.lit(1.0)).otherwise(begin).cast("int"), F.when(none, F.lit(0.0)).otherwise(end - begin).cast("int")))


def substring_before(s: Column, part: Column) -> Column:
    at = F.position(part, s)
    return F.when(at > 0, F.left(s, at - 1)).otherwise(F.lit(""))


def substring_after(s: Column, part: Column) -> Column:
    at = F.position(part, s)
    return F.when(at > 0, F.substring(s, at + F.length(part), F.length(s))).otherwise(F.lit(""))


def normalize_space(s: Column) -> Column:
    """Blank, tab, CR and LF only."""
    return F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))


def translate(s: Column, source: str, target: str) -> Column:
    """Characters of ``source`` become those of ``target`` at their first place there, or go."""
    return F.translate(s, source, target)


def lang_matches(value: Column, wanted: Column) -> Column:
    """lang(): equal, or a prefix up to a hyphen, whatever the case."""
    v, w = F.lower(value), F.lower(wanted)
    return F.coalesce((v == w) | F.startswith(v, F.concat(w, F.lit("-"))), F.lit(False))
