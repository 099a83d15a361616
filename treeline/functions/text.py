"""String, URI and encoding functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(s: Column) -> Column:
    """Lower case of A-Z alone; lower() would fold all of Unicode."""
    return F.translate(s, UPPER, LOWER)


def equal(a: Column, b: Column) -> Column:
    """Bytewise, null equals null."""
    return a.eqNullSafe(b)


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return ascii_lower(a).eqNullSafe(ascii_lower(b))


def sign(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by bytes; null sorts first."""
    return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)


def find(s: Column, part: Column) -> Column:
    """0-based place of ``part``, -1 if absent."""
    return F.position(part, s) - 1


def bytes_slice(s: Column, start: int, length: int) -> Column:
    """Bytes ``start .. start + length``, 0-based, as text."""
    return F.decode(F.substring(F.encode(s, "UTF-8"), start + 1, length), "UTF-8")


def chars_slice(s: Column, start: int, length: int) -> Column:
    return F.substring(s, start + 1, length)


def collapse(s: Column) -> Column:
    """White space facet ``collapse``."""
    return F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))


def whitespace_replace(s: Column) -> Column:
    """White space facet ``replace``."""
    return F.translate(s, "\t\r\n", "   ")


def normalize_lines(s: Column) -> Column:
    """Each line trimmed and its white space squeezed; empty lines stay."""
    return F.array_join(F.transform(F.split(s, "\n"), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"\s+", " ")), "\n")


#: RFC 3986, appendix B, with the authority taken apart.
URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^:/?#]*)(?::([0-9]*))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
URI_PARTS = ["scheme", "user", "server", "port", "path", "query", "fragment"]


def uri(s: Column) -> Column:
    """A URI as a struct of its parts; what is absent is null."""
    parts = []
    for k, name in enumerate(URI_PARTS, start=1):
        part = F.regexp_extract(s, URI, k)
        held = {"scheme": s.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), "query": s.rlike(r"^[^#]*\?"), "fragment": s.contains("#"), "path": s.isNotNull()}.get(name, part != "")
        parts.append((F.when(held, part).try_cast("int") if name == "port" else F.when(held, part)).alias(name))
    return F.struct(*parts)


def uri_text(u: Column) -> Column:
    """A struct of parts as a URI."""
    mark = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), c.cast("string"), F.lit(after)), F.lit(""))
    server = F.when(u["server"].isNotNull(), F.concat(F.lit("//"), mark("", u["user"], "@"), u["server"], mark(":", u["port"]))).otherwise(F.lit(""))
    return F.concat(mark("", u["scheme"], ":"), server, F.coalesce(u["path"], F.lit("")), mark("?", u["query"]), mark("#", u["fragment"]))


def normalize_path(p: Column) -> Column:
    """Dot segments removed; ``..`` at the start of a relative path stays, above a root it goes."""
    rooted = F.startswith(p, F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    up = F.lit("..")
    fold = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == up) & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != up), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == up) & rooted, acc).otherwise(F.concat(acc, F.array(x))),
    )
    last = p.rlike(r"(^|/)\.{0,2}$") & (F.size(fold) > 0) & (F.try_element_at(fold, F.lit(-1)) != up)
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(fold, "/"), F.when(last, F.lit("/")).otherwise(F.lit("")))


def resolve(ref: Column, base: Column) -> Column:
    """RFC 3986, section 5.2: a reference against a base URI."""
    r, b = uri(ref), uri(base)
    folder = F.regexp_replace(b["path"], r"[^/]*$", "")
    merged = F.when(b["server"].isNotNull() & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(folder, r["path"]))
    own = r["scheme"].isNotNull()
    host = own | r["server"].isNotNull()
    same = ~host & (r["path"] == "")
    path = F.when(host, normalize_path(r["path"])).when(same, b["path"]).when(F.startswith(r["path"], F.lit("/")), normalize_path(r["path"])).otherwise(normalize_path(merged))
    pick = lambda name, mine: F.when(mine, r[name]).otherwise(b[name]).alias(name)
    return uri_text(F.struct(pick("scheme", own), pick("user", host), pick("server", host), pick("port", host), path.alias("path"), F.when(same & r["query"].isNull(), b["query"]).otherwise(r["query"]).alias("query"), r["fragment"].alias("fragment")))


def uri_unescape(s: Column) -> Column:
    """%XX decoded; malformed escapes and plus signs stay."""
    safe = F.replace(F.regexp_replace(s, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(safe)


def uri_escape(s: Column, keep: str = "") -> Column:
    """Bytes outside the unreserved characters and ``!*'()@`` become %XX, but for those in ``keep``."""
    out = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    for c in "~!'()@" + keep:
        code = "".join(f"%{b:02X}" for b in c.encode())
        out = F.replace(out, F.lit(code), F.lit(c))
    return out


def qname(s: Column) -> Column:
    """Prefix and local part; no prefix without a colon between two names."""
    has = s.rlike(r"^[^:]+:.+$")
    return F.struct(F.when(has, F.substring_index(s, ":", 1)).alias("prefix"), F.when(has, F.regexp_replace(s, r"^[^:]+:", "")).otherwise(s).alias("local"))


def public_id(s: Column) -> Column:
    """A public identifier with its white space collapsed."""
    return F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))


def unwrap_urn(s: Column) -> Column:
    """``urn:publicid:`` decoded: + is a blank, : is //, ; is ::, and a few escapes."""
    body = F.regexp_replace(s, r"^urn:publicid:", "")
    for plain, code in (("+", " "), (":", "//"), (";", "::"), ("%2B", "+"), ("%3A", ":"), ("%2F", "/"), ("%3B", ";"), ("%27", "'"), ("%3F", "?"), ("%23", "#"), ("%25", "%")):
        body = F.replace(body, F.lit(plain), F.lit(code))
    return F.when(F.startswith(s, F.lit("urn:publicid:")), body).otherwise(s)


#: Literal text of a #define, and the type that it has there.
def literal_type(s: Column) -> Column:
    t = F.trim(s)
    number = F.regexp_replace(t, r"[uUlL]+$", "")
    small = F.coalesce(number.try_cast("decimal(38,0)") <= F.lit("2147483647").cast("decimal(38,0)"), F.lit(False))
    return (
        F.when(t.rlike(r'^"'), "&str").when(t.rlike(r"^'"), "char").when(t.isin("true", "false", "TRUE", "FALSE"), "bool")
        .when(t.rlike(r"^[0-9]+[uUlL]*$"), F.when(small, "i32").otherwise("u32")).when(t.rlike(r"^-[0-9]+$"), "i32").when(t.rlike(r"^0[xX][0-9A-Fa-f]+[uUlL]*$"), "u32")
        .when(t.rlike(r"^-?[0-9]*\.[0-9]+([eE][+-]?[0-9]+)?[fF]?$"), "f64").otherwise("error")
    )


def utf8_valid(b: Column) -> Column:
    return F.is_valid_utf8(b)


def bom_encoding(b: Column) -> Column:
    """The encoding that the first bytes give away."""
    head = F.hex(F.substring(b, 1, 4))
    return (
        F.when(F.startswith(head, F.lit("EFBBBF")), "UTF-8").when(head == "3C3F786D", "UTF-8").when(head.isin("0000003C"), "UCS-4BE").when(head.isin("3C000000"), "UCS-4LE")
        .when(head == "4C6FA794", "EBCDIC").when(head.isin("3C003F00"), "UTF-16LE").when(head.isin("003C003F"), "UTF-16BE").when(F.startswith(head, F.lit("FEFF")), "UTF-16BE").when(F.startswith(head, F.lit("FFFE")), "UTF-16LE")
    )


# Names under which encodings go.
ENCODING_ALIASES = {"UTF8": "UTF-8", "ISO-LATIN-1": "ISO-8859-1", "LATIN1": "ISO-8859-1", "ASCII": "US-ASCII", "UTF16": "UTF-16", "UCS-2": "UTF-16"}


def canonical_encoding(s: Column, aliases: dict[str, str] | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for pair in (ENCODING_ALIASES | (aliases or {})).items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(s)), F.upper(s))
