"""Values of the built-in schema types: lexical checks, parsed forms, comparison, facets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.functions.text import collapse

NAME_START = r"[:_A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}\x{200C}-\x{200D}\x{2070}-\x{218F}\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}]"
NAME_CHAR = NAME_START[:-1] + r"\-.0-9\x{B7}\x{300}-\x{36F}\x{203F}-\x{2040}]"
NC_START, NC_CHAR = NAME_START.replace(":", "", 1), NAME_CHAR.replace(":", "", 1)
TZ = r"(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
YEAR, MONTH, DAY = r"-?([1-9][0-9]{3,}|0[0-9]{3})", r"(0[1-9]|1[0-2])", r"(0[1-9]|[12][0-9]|3[01])"
TIME = r"(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?)"
INTEGER = r"[+-]?[0-9]+"
DURATION = r"-?P(?=[0-9T])([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T(?=[0-9])([0-9]+H)?([0-9]+M)?([0-9]+(\.[0-9]+)?S)?)?"

#: Base type and lexical form of each built-in type (None: that of its base).
TYPES: dict[str, tuple[str | None, str | None]] = {
    "anySimpleType": (None, r"[\s\S]*"), "string": ("anySimpleType", r"[\s\S]*"), "normalizedString": ("string", r"[^\t\r\n]*"), "token": ("normalizedString", r"(\S+( \S+)*)?"),
    "language": ("token", r"[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*"), "NMTOKEN": ("token", NAME_CHAR + "+"), "Name": ("token", NAME_START + NAME_CHAR + "*"), "NCName": ("Name", NC_START + NC_CHAR + "*"),
    "ID": ("NCName", None), "IDREF": ("NCName", None), "ENTITY": ("NCName", None), "NMTOKENS": ("anySimpleType", f"{NAME_CHAR}+( {NAME_CHAR}+)*"), "IDREFS": ("anySimpleType", f"{NC_START}{NC_CHAR}*( {NC_START}{NC_CHAR}*)*"),
    "ENTITIES": ("anySimpleType", f"{NC_START}{NC_CHAR}*( {NC_START}{NC_CHAR}*)*"), "anyURI": ("anySimpleType", r"[^\s<>\"{}|\\^`]*"), "QName": ("anySimpleType", f"({NC_START}{NC_CHAR}*:)?{NC_START}{NC_CHAR}*"), "NOTATION": ("anySimpleType", f"({NC_START}{NC_CHAR}*:)?{NC_START}{NC_CHAR}*"),
    "boolean": ("anySimpleType", r"true|false|1|0"), "decimal": ("anySimpleType", r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)"), "integer": ("decimal", INTEGER), "nonPositiveInteger": ("integer", INTEGER), "negativeInteger": ("nonPositiveInteger", INTEGER),
    "nonNegativeInteger": ("integer", INTEGER), "positiveInteger": ("nonNegativeInteger", INTEGER), "long": ("integer", INTEGER), "int": ("long", INTEGER), "short": ("int", INTEGER), "byte": ("short", INTEGER),
    "unsignedLong": ("nonNegativeInteger", INTEGER), "unsignedInt": ("unsignedLong", INTEGER), "unsignedShort": ("unsignedInt", INTEGER), "unsignedByte": ("unsignedShort", INTEGER),
    "float": ("anySimpleType", r"NaN|-?INF|[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"), "double": ("anySimpleType", r"NaN|-?INF|[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"),
    "dateTime": ("anySimpleType", f"{YEAR}-{MONTH}-{DAY}T{TIME}{TZ}"), "date": ("anySimpleType", f"{YEAR}-{MONTH}-{DAY}{TZ}"), "time": ("anySimpleType", TIME + TZ), "gYear": ("anySimpleType", YEAR + TZ), "gYearMonth": ("anySimpleType", f"{YEAR}-{MONTH}{TZ}"),
    "gMonth": ("anySimpleType", f"--{MONTH}{TZ}"), "gMonthDay": ("anySimpleType", f"--{MONTH}-{DAY}{TZ}"), "gDay": ("anySimpleType", f"---{DAY}{TZ}"), "duration": ("anySimpleType", DURATION),
    "hexBinary": ("anySimpleType", r"([0-9A-Fa-f]{2})*"), "base64Binary": ("anySimpleType", r"(([A-Za-z0-9+/] ?){4})*(([A-Za-z0-9+/] ?){2}[AEIMQUYcgkosw048] ?=|[A-Za-z0-9+/] ?[AQgw] ?= ?=)?"),
}
RANGES = {
    "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 65535), "unsignedByte": (0, 255),
}


def whole(s: Column, pattern: str) -> Column:
    """Whether a pattern matches the whole string; schema patterns are anchored."""
    return s.rlike(rf"\A(?:{pattern})\z")


def form(name: str) -> str:
    base, pattern = TYPES[name]
    return pattern if pattern is not None else form(base)


def ancestry(name: str) -> list[str]:
    """A type and its bases."""
    return [name, *(ancestry(TYPES[name][0]) if TYPES[name][0] else [])]


def magnitude(s: Column) -> Column:
    """The digits of an integer's text without sign and leading zeros; zero has none."""
    return F.regexp_replace(s, r"^[+-]?0*", "")


def reaches(s: Column, bound: int) -> Column:
    """Whether an integer's text, its sign aside, is at least a number, whatever its length."""
    digits, size = magnitude(s), len(str(bound)) if bound else 0
    return (F.length(digits) > size) | ((F.length(digits) == size) & (digits >= F.lit(str(bound) if bound else "")))


def at_least(s: Column, low: int) -> Column:
    minus = F.startswith(s, F.lit("-")) & (magnitude(s) != "")
    return ~minus & reaches(s, low) if low > 0 else ~minus | ~reaches(s, 1 - low)


def at_most(s: Column, high: int) -> Column:
    minus = F.startswith(s, F.lit("-")) & (magnitude(s) != "")
    return minus & reaches(s, -high) if high < 0 else minus | ~reaches(s, high + 1)


def valid(s: Column, name: str) -> Column:
    """Whether a string is in the lexical space of a built-in type, white space treated as the type does."""
    text = s if name == "string" else F.translate(s, "\t\r\n", "   ") if name == "normalizedString" else collapse(s)
    ok = whole(text, form(name))
    if name in RANGES:
        low, high = RANGES[name]
        ok = ok & (at_least(text, low) if low is not None else F.lit(True)) & (at_most(text, high) if high is not None else F.lit(True))
    if name in ("date", "dateTime"):
        # Years beyond four digits are checked by the pattern alone.
        day = F.regexp_extract(text, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
        ok = ok & ((day == "") | day.try_cast("date").isNotNull())
    return F.coalesce(ok, F.lit(False))


def date_parts(s: Column) -> Column:
    """Year, month, day, seconds of the day and minutes east of UTC; absent parts are null."""
    x = lambda p, k: F.nullif(F.regexp_extract(s, p, k), F.lit(""))
    date = r"^(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})"
    clock = r"([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?)"
    zone = r"(Z|[+-][0-9]{2}:[0-9]{2})$"
    z = x(zone, 1)
    east = F.when(z == "Z", 0).otherwise(F.concat(F.substring(z, 1, 1), F.lit("1")).try_cast("int") * (F.substring(z, 2, 2).try_cast("int") * 60 + F.substring(z, 5, 2).try_cast("int")))
    t = F.regexp_extract(s, rf"(?:T|^){clock}", 1)
    seconds = F.when(t != "", t.try_cast("int") * 3600 + F.regexp_extract(s, rf"(?:T|^){clock}", 2).try_cast("int") * 60 + F.regexp_extract(s, rf"(?:T|^){clock}", 3).try_cast("double"))
    return F.struct(x(date, 1).try_cast("long").alias("year"), x(date, 2).try_cast("int").alias("month"), x(date, 3).try_cast("int").alias("day"), seconds.alias("seconds"), F.when(z.isNotNull(), east).alias("tz"))


def instant(p: Column, tz: Column) -> Column:
    """Seconds since the epoch of date parts, with a time zone in minutes."""
    days = F.datediff(F.make_date(p["year"].cast("int"), p["month"], p["day"]), F.lit("1970-01-01").cast("date"))
    return days * 86400.0 + F.coalesce(p["seconds"], F.lit(0.0)) - tz * 60.0


def compare_dates(a: Column, b: Column) -> Column:
    """-1, 0, 1, or 2 where one side lacks a time zone and both orders are possible within 14 hours."""
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    one = a["tz"].isNull() != b["tz"].isNull()
    same = sign(instant(a, F.coalesce(a["tz"], F.lit(0))), instant(b, F.coalesce(b["tz"], F.lit(0))))
    at = lambda p, m: instant(p, F.coalesce(p["tz"], F.lit(m)))
    low, high = sign(at(a, 840), at(b, 840)), sign(at(a, -840), at(b, -840))
    low_b, high_b = sign(at(a, 840), at(b, -840)), sign(at(a, -840), at(b, 840))
    settled = F.when((low == high) & (low_b == high_b) & (low == low_b), low).otherwise(2)
    return F.when(one, settled).otherwise(same)


def duration(s: Column) -> Column:
    """Months, days and seconds of a duration."""
    n = lambda p: F.coalesce(F.nullif(F.regexp_extract(s, p, 1), F.lit("")).try_cast("double"), F.lit(0.0))
    minus = F.when(F.startswith(s, F.lit("-")), -1.0).otherwise(1.0)
    date, time = r"^-?P[^T]*?", r"T.*?"
    return F.struct(
        (minus * (n(rf"{date}([0-9]+)Y") * 12 + n(rf"{date}([0-9]+)M"))).cast("long").alias("months"), (minus * n(rf"{date}([0-9]+)D")).cast("long").alias("days"),
        (minus * (n(rf"{time}([0-9]+)H") * 3600 + n(rf"{time}([0-9]+)M") * 60 + n(rf"{time}([0-9]+(?:\.[0-9]+)?)S")) + 0.0).alias("seconds"),
    )


# The fewest and the most days that so many months, fewer than twelve, have.
FEWEST = [0, 28, 59, 89, 120, 150, 181, 212, 242, 273, 303, 334]
MOST = [0, 31, 62, 92, 123, 153, 184, 215, 245, 276, 306, 337]


def compare_durations(a: Column, b: Column) -> Column:
    """-1, 0, 1, or 2 where months of 28 to 31 days leave the order open. Whole days count against months; what is left of a day doesn't."""
    months = a["months"] - b["months"]
    seconds = a["seconds"] - b["seconds"]
    carry = (seconds / 86400.0).cast("long")
    days, rest = a["days"] - b["days"] + carry, seconds - carry * 86400.0
    # Against the side with more months stand the other's days.
    ahead = F.when(months > 0, F.lit(1)).otherwise(F.lit(-1))
    against = -ahead * days
    size = F.abs(months)
    years, odd = F.floor(size / 12), (size % 12 + 1).cast("int")
    long = 365 * years + F.floor((years + 3) / 4)
    most = long + F.element_at(F.array(*map(F.lit, MOST)), odd)
    fewest = F.when(years > 0, long - 1).otherwise(0) + F.element_at(F.array(*map(F.lit, FEWEST)), odd)
    plain = F.when(days != 0, F.signum(days.cast("double"))).otherwise(F.signum(rest))
    same_side = (against <= 0) & (ahead * rest >= 0)
    return F.when(months == 0, plain.cast("int")).when(same_side, ahead).when(most < against, -ahead).when(fewest > against, ahead).otherwise(2)


def compare_floats(a: Column, b: Column) -> Column:
    """NaN equals itself and is greater than all, as Spark orders it."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def violations(s: Column, facets: dict[str, object]) -> Column:
    """The names of the facets that a value breaks."""
    number = s.try_cast("decimal(38,10)")
    bound = lambda v: F.lit(str(v)).cast("decimal(38,10)")
    digits = F.length(F.regexp_replace(F.regexp_replace(s, r"^[+-]?0*", ""), r"[^0-9]", ""))
    checks = {
        "minInclusive": lambda v: number < bound(v), "minExclusive": lambda v: number <= bound(v), "maxInclusive": lambda v: number > bound(v), "maxExclusive": lambda v: number >= bound(v),
        "totalDigits": lambda v: digits > v, "fractionDigits": lambda v: F.length(F.regexp_extract(s, r"\.([0-9]*?)0*$", 1)) > v, "length": lambda v: F.length(s) != v, "minLength": lambda v: F.length(s) < v,
        "maxLength": lambda v: F.length(s) > v, "pattern": lambda v: ~whole(s, v), "enumeration": lambda v: ~s.isin(*v), "whiteSpace": lambda v: s != collapse(s) if v == "collapse" else F.lit(False),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(checks[k](v), F.lit(True)), F.lit(k)) for k, v in facets.items()]))


def canonical(s: Column, name: str) -> Column:
    """The canonical form of booleans, decimals, integers and binary values."""
    t = collapse(s)
    if name == "boolean":
        return F.when(t.isin("1", "true"), "true").when(t.isin("0", "false"), "false")
    if name == "hexBinary":
        return F.upper(t)
    if name in RANGES or name == "integer":
        sign = F.when(F.startswith(t, F.lit("-")), "-").otherwise("")
        return F.when(whole(t, "[+-]?[0-9]+"), F.when(magnitude(t) == "", "0").otherwise(F.concat(sign, magnitude(t))))
    if name == "decimal":
        plain = F.regexp_replace(F.regexp_replace(t, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
        dotted = F.when(plain.contains("."), F.regexp_replace(plain, r"0+$", "")).otherwise(F.concat(plain, F.lit(".")))
        full = F.regexp_replace(F.regexp_replace(F.regexp_replace(dotted, r"\.$", ".0"), r"^\.", "0."), r"^-\.", "-0.")
        return F.when(full == "-0.0", "0.0").otherwise(full)
    return t


def java_pattern(pattern: str) -> str:
    """A schema regular expression in Java's syntax: name classes, block names, class subtraction."""
    out = pattern.replace(r"\i", NAME_START).replace(r"\c", NAME_CHAR)
    import re

    out = re.sub(r"\\([pP])\{Is([A-Za-z0-9\-]+)\}", r"\\\1{In\2}", out)
    return re.sub(r"\[((?:[^\[\]\\]|\\.)+)-\[((?:[^\[\]\\]|\\.)+)\]\]", lambda m: f"[{m.group(1)}&&[^{m.group(2)}]]" if m.group(2)[0] != "^" else f"[{m.group(1)}&&[{m.group(2)[1:]}]]", out)
