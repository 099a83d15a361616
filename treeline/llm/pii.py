"""Operator 8: format-preserving Feistel pseudonyms for personal data.

Numbers, dates and addresses are found by pattern, validated (Luhn, mod 97,
calendar, octets), and replaced by a keyed permutation of the same format: a
valid card number becomes another valid one, a date another date written alike.
The permutation depends on the key, the kind and the format alone, so equal
values stay equal in every document, and whoever holds the key can invert it.

It is a Feistel network over two halves of bits with BLAKE2b as round function,
walked along its cycle until the value lies in the format's domain again. Values
have no greatest length: long ones are permuted in pieces of ``PIECE`` characters,
each by its place. Letters of any script stay letters of their block and case.

The key is an argument; :func:`configured_key` takes it from the session's
setting ``spark.treeline.pii.key`` and warns where only the example key is at hand.

What has no form of its own stays: ten digits without a mark (a count as well as a
phone number), addresses without a dot behind the at sign, keys of many lines. The
image of an IPv6 address is spelt with all its groups, so that an address is linked
however it is spelt. Months are spelt in the language in which their name is found
first, so a name that two languages share, or that is its own short form, may come
back spelt otherwise; the date is the same.

Each text is read once, where its lines hold a digit or an at sign; nothing is
shuffled or gathered, so hot sources and copies cost what other rows cost.

Defined cases: null stays null, an empty text stays empty; a text without
personal data is returned as it is; repeated rows give equal rows; a value that
fails its validation is no card, date or address, and keeps its form unless
another kind (a long number) holds for it.
"""

from __future__ import annotations

import datetime
import functools
import ipaddress
import json
import re
import warnings
from collections import Counter
from collections.abc import Callable
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: For tests and examples; a deployment passes its own secret.
EXAMPLE_KEY = b"treeline example key"
ROUNDS = 8
#: Characters of a long value that are permuted together.
PIECE = 128

# Month names of the four languages of the corpus.
MONTHS = [
    ["january", "januar", "janvier", "enero"],
    ["february", "februar", "février", "febrero"],
    ["march", "märz", "mars", "marzo"],
    ["april", "april", "avril", "abril"],
    ["may", "mai", "mai", "mayo"],
    ["june", "juni", "juin", "junio"],
    ["july", "juli", "juillet", "julio"],
    ["august", "august", "août", "agosto"],
    ["september", "september", "septembre", "septiembre"],
    ["october", "oktober", "octobre", "octubre"],
    ["november", "november", "novembre", "noviembre"],
    ["december", "dezember", "décembre", "diciembre"],
]
MONTH_OF = {name: (k + 1, lang) for k, names in enumerate(MONTHS) for lang, name in reversed(list(enumerate(names)))}
# Their short forms, in the same order; a full stop may follow.
SHORT_MONTHS = [
    ["jan", "jan", "janv", "ene"], ["feb", "feb", "févr", "feb"], ["mar", "mär", "mars", "mar"], ["apr", "apr", "avr", "abr"], ["may", "mai", "mai", "may"], ["jun", "jun", "juin", "jun"],
    ["jul", "jul", "juil", "jul"], ["aug", "aug", "août", "ago"], ["sep", "sep", "sept", "sept"], ["oct", "okt", "oct", "oct"], ["nov", "nov", "nov", "nov"], ["dec", "dez", "déc", "dic"],
]
SHORT_OF = {name: (k + 1, lang) for k, names in enumerate(SHORT_MONTHS) for lang, name in reversed(list(enumerate(names))) if name not in MONTH_OF}
_MONTH = "(?:" + "|".join(sorted(MONTH_OF, key=lambda m: (-len(m), m))) + "|(?:" + "|".join(sorted(SHORT_OF, key=lambda m: (-len(m), m))) + r")(?![^\W\d_])\.?)"

#: In order of preference where several hold at one place.
PATTERN = re.compile(
    rf"""
    (?P<email>(?<![\w.%+\-])[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{{2,}}(?!\w))
    |(?P<secret>(?<![A-Za-z0-9])(?i:password|passwd|passphrase|pwd|secret|token|api[_ \-]?key|access[_ \-]?key)["']?[ ]?[=:][ ]?["']?(?=[A-Za-z_+/\-]*[0-9])[A-Za-z0-9_+/\-]{{6,}})
    |(?P<key>(?<![A-Za-z0-9_\-])(?:AKIA|ASIA|ghp_|gho_|github_pat_|sk-|sk_live_|xoxb-|xoxp-|AIza)[A-Za-z0-9_\-]{{16,}}(?![A-Za-z0-9_\-]))
    |(?P<hex>(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{{32,}}|[0-9A-F]{{32,}})(?![0-9A-Za-z]))
    |(?P<iban>(?<![0-9A-Za-z])(?:[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?|[a-z]{{2}}[0-9]{{2}}(?=[a-z]*(?:[0-9][a-z]*){{10}})[a-z0-9]{{11,30}})(?![0-9A-Za-z]))
    |(?P<ip>(?<![0-9.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?![0-9]|\.[0-9]))
    |(?P<ip6>(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{0,4}}(?![0-9A-Za-z:]))
    |(?P<jwt>(?<![\w.\-])eyJ[\w\-]{{8,}}\.[\w\-]{{8,}}\.[\w\-]{{8,}}(?![\w.\-]))
    |(?P<iso>(?<![0-9\-/])[0-9]{{4}}(?P<mark>[\-/])[0-9]{{2}}(?P=mark)[0-9]{{2}}(?![0-9]|[\-/][0-9]))
    |(?P<day>(?<![0-9./\-])[0-9]{{1,2}}(?P<sep>[./\-])[0-9]{{1,2}}(?P=sep)[0-9]{{4}}(?![0-9]|[./\-][0-9]))
    |(?P<short>(?<![0-9./\-])(?:[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}|[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{2}})(?![0-9]|[./\-][0-9]))
    |(?P<named>(?<![0-9A-Za-z])[0-9]{{1,2}}\.?[ ](?:de[ ])?(?i:{_MONTH}),?[ ](?:de[ ])?[0-9]{{4}}(?![0-9]))
    |(?P<first>(?<![A-Za-z])(?i:{_MONTH})[ ][0-9]{{1,2}},[ ][0-9]{{4}}(?![0-9]))
    |(?P<ssn>(?<![0-9\-])[0-9]{{3}}(?P<gap>[- ])[0-9]{{2}}(?P=gap)[0-9]{{4}}(?![0-9]|-[0-9]))
    |(?P<phone>(?<![0-9A-Za-z+])\+[0-9]{{1,3}}(?:[ .\-]?\([0-9]{{1,4}}\)|[ .\-]?[0-9]{{1,12}})(?:[ .\-]?[0-9]{{2,12}}){{0,5}}(?![0-9])
        |(?<![0-9(+.\-])(?:\([0-9]{{3}}\)[ ]?|[0-9]{{3}}[ .\-])[0-9]{{3}}[ .\-][0-9]{{4}}(?![0-9]|[.\-][0-9])
        |(?<![0-9/.\-+])0[0-9]{{1,4}}/[ ]?[0-9]{{4,9}}(?![0-9/])
        |(?<!\w)(?i:tel|phone|telephone|mobile|cell|fax|telefon|handy|téléphone|teléfono|móvil)[.:]?[ ]{{1,2}}[0-9]{{8,15}}(?![0-9]))
    |(?P<number>(?<![0-9])(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ .\-][0-9]{{4}}){{2}}[ .\-][0-9]{{1,7}}|[0-9]{{4}}[ \-][0-9]{{6}}[ \-][0-9]{{5}})(?![0-9]))
    """,
    re.VERBOSE,
)
ANCHOR = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


class Permuter:
    """Keyed permutations of ``range(size)``."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = blake2b(key, digest_size=32).digest(), back

    def number(self, value: int, size: int, kind: str, holds: Callable[[int], bool] | None = None) -> int:
        """The image of ``value`` among the numbers below ``size`` for which ``holds`` is true."""
        if size < 2:
            return value
        half = ((size - 1).bit_length() + 1) // 2
        mask, wide = (1 << half) - 1, (half + 7) // 8
        tag = f"{kind}:{size}".encode()
        rounds = range(ROUNDS - 1, -1, -1) if self.back else range(ROUNDS)
        while True:
            left, right = value >> half, value & mask
            for k in rounds:
                if self.back:
                    left, right = right ^ self.mix(left, k, tag, wide, mask), left
                else:
                    left, right = right, left ^ self.mix(right, k, tag, wide, mask)
            value = left << half | right
            if value < size and (holds is None or holds(value)):
                return value

    def mix(self, half: int, k: int, tag: bytes, wide: int, mask: int) -> int:
        said, size = half.to_bytes(wide, "big") + bytes([k]) + tag, wide + 8
        blocks = [blake2b(said + n.to_bytes(4, "big") * (n > 0), key=self.key, digest_size=min(64, size)).digest() for n in range(-(-size // 64))]
        return int.from_bytes(b"".join(blocks), "big") & mask

    def string(self, text: str, alphabet: str, kind: str, holds: Callable[[str], bool] | None = None) -> str:
        """The image of ``text`` among the strings of its length over ``alphabet``."""
        base, value, n = len(alphabet), 0, len(text)
        for c in text:
            value = value * base + alphabet.index(c)

        def spelt(x: int) -> str:
            out = []
            for _ in range(n):
                x, d = divmod(x, base)
                out.append(alphabet[d])
            return "".join(reversed(out))

        return spelt(self.number(value, base**n, f"{kind}:{n}", holds and (lambda x: holds(spelt(x)))))


DIGITS, LETTERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
FROM, UNTIL = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()


def refill(form: str, chars: str, which: Callable[[str], bool]) -> str:
    """``form`` with its characters of a kind replaced in order, in the case that they had."""
    new = iter(chars)
    return "".join((n.upper() if c.isupper() else n) if which(c) and (n := next(new)) else c for c in form)


def is_digit(c: str) -> bool:
    return "0" <= c <= "9"


@functools.cache
def block_letters(block: int, cased: bool) -> str:
    """The lower-case (or caseless) letters among 64 code points whose upper case is one letter that leads back."""
    letters = (c for c in map(chr, range(64 * block, 64 * block + 64)) if c.isalpha() and c == c.lower() and (c.upper() != c) == cased)
    return "".join(c for c in letters if not cased or (len(c.upper()) == 1 and c.upper().lower() == c))


def alphabet(c: str) -> str:
    """What a character may become, case aside; nothing if it stays."""
    if c.isascii():
        return DIGITS if c.isdigit() else LETTERS if c.isalpha() else ""
    low = c.lower()
    if len(low) != 1 or not c.isalpha() or c not in (low, low.upper()):
        return ""
    found = block_letters(ord(low) >> 6, low.upper() != low)
    return found if low in found else ""


def letters_and_digits(p: Permuter, text: str, kind: str) -> str:
    """Letters among the letters of their block, digits among digits; case and all else stay."""
    out = list(text)
    places = [(k, a) for k, c in enumerate(text) if (a := alphabet(c))]
    for at in range(0, len(places), PIECE):
        part, value, size = places[at : at + PIECE], 0, 1
        for k, a in part:
            value, size = value * len(a) + a.index(text[k].lower()), size * len(a)
        value = p.number(value, size, f"{kind}:{at}")
        for k, a in reversed(part):
            value, d = divmod(value, len(a))
            out[k] = a[d].upper() if text[k].isupper() else a[d]
    return "".join(out)


def configured_key(spark: SparkSession) -> bytes:
    """The session's key; without one the example key, of which a warning is given."""
    held = spark.conf.get("spark.treeline.pii.key", None)
    if held is None:
        warnings.warn("spark.treeline.pii.key is unset: pseudonyms are made with the public example key", stacklevel=2)
    return EXAMPLE_KEY if held is None else held.encode()


def shifted(p: Permuter, year: int, month: int, day: int, late: bool = False) -> datetime.date | None:
    """The pseudonym of a date of 1900 to 2099; None if there is no such date. ``late``: among those after the 12th."""
    try:
        at = datetime.date(year, month, day).toordinal() - FROM
    except ValueError:
        return None
    if not 0 <= at < UNTIL - FROM:
        return None
    after = (lambda x: datetime.date.fromordinal(FROM + x).day > 12) if late else None
    return datetime.date.fromordinal(FROM + p.number(at, UNTIL - FROM, "date", after))


def email(p: Permuter, text: str) -> str | None:
    name, _, host = text.rpartition("@")
    host, _, top = host.rpartition(".")
    return f"{letters_and_digits(p, name, 'mailbox')}@{letters_and_digits(p, host, 'host')}.{top}"


def secret(p: Permuter, text: str) -> str | None:
    """A value after a name that says it is secret; hexadecimal ones link with those that stand alone."""
    value = re.search(r"[A-Za-z0-9_+/\-]+$", text).group()
    plain = re.fullmatch("[0-9a-f]+|[0-9A-F]+", value) is not None
    return text[: len(text) - len(value)] + ((hexadecimal(p, value) if plain else None) or letters_and_digits(p, value, "secret"))


def key(p: Permuter, text: str) -> str | None:
    m = re.match("AKIA|ASIA|ghp_|gho_|github_pat_|sk-|sk_live_|xoxb-|xoxp-|AIza", text)
    tail = text[m.end() :]
    return m.group() + letters_and_digits(p, tail, "key") if any(map(is_digit, tail)) else None


def hexadecimal(p: Permuter, text: str) -> str | None:
    if not any(map(is_digit, text)):
        return None
    low = text.lower()
    new = "".join(p.string(low[k : k + PIECE], HEX, f"hex{k or ''}") for k in range(0, len(low), PIECE))
    return new.upper() if text.upper() == text else new


def iban(p: Permuter, text: str) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or mod97(plain) != 1:
        return None
    land = plain[:2].lower()
    body = letters_and_digits(p, plain[4:].lower(), f"iban{land}")
    new = f"{land}{98 - mod97(f'{land}00{body}'):02d}{body}"
    return refill(text, new, lambda c: c != " ")


def ip(p: Permuter, text: str) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or (x != "0" and x[0] == "0") for x in parts):
        return None
    at = int(ipaddress.IPv4Address(text))
    for base, bits in ((0x0A000000, 24), (0xAC100000, 20), (0xC0A80000, 16)):
        if at >> bits == base >> bits:
            return str(ipaddress.IPv4Address(base + p.number(at - base, 1 << bits, "ip")))
    if not outside(at):
        return None
    return str(ipaddress.IPv4Address(p.number(at, 1 << 32, "ip", outside)))


def outside(at: int) -> bool:
    """Whether an IPv4 address is neither of a private net, nor of this host, nor of multicast or above."""
    return not (at >> 24 in (0, 10, 127) or at >> 20 == 0xAC1 or at >> 16 == 0xC0A8 or at >> 24 >= 224)


def ip6(p: Permuter, text: str) -> str | None:
    try:
        at = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    if int(at) < 1 << 16:
        return None
    net, host = int(at) >> 112, int(at) & ((1 << 112) - 1)
    return str(ipaddress.IPv6Address(net << 112 | p.number(host, 1 << 112, "ip6")))


def iso(p: Permuter, text: str) -> str | None:
    new = shifted(p, int(text[:4]), int(text[5:7]), int(text[8:]))
    return new and new.isoformat().replace("-", text[4])


def jwt(p: Permuter, text: str) -> str | None:
    """Three parts of letters, digits and signs, as web tokens are; what tells that it is one stays."""
    return "eyJ" + letters_and_digits(p, text[3:], "token") if any(map(is_digit, text)) else None


def day(p: Permuter, text: str) -> str | None:
    sep = re.search(r"[./\-]", text).group()
    a, b, year = text.split(sep)
    wide = 2 if len(a) == 2 and len(b) == 2 else 1
    if new := shifted(p, int(year), int(b), int(a)):
        return f"{new.day:0{wide}d}{sep}{new.month:0{wide}d}{sep}{new.year:04d}"
    # Month first only where day first makes no date; so is its image, that it reads back alike.
    if new := shifted(p, int(year), int(a), int(b), late=True):
        return f"{new.month:0{wide}d}{sep}{new.day:0{wide}d}{sep}{new.year:04d}"
    return None


def short(p: Permuter, text: str) -> str | None:
    """A date whose year has two digits: one of 1950 to 2049."""
    sep = "/" if "/" in text else "."
    a, b, y = text.split(sep)
    wide = 2 if len(a) == 2 and len(b) == 2 else 1
    begin, end = datetime.date(1950, 1, 1).toordinal(), datetime.date(2050, 1, 1).toordinal()
    for d, m, late in ((a, b, False), (b, a, True))[: 2 if sep == "/" else 1]:  # month first only where day first makes no date, and with strokes
        try:
            at = datetime.date((1900 if int(y) >= 50 else 2000) + int(y), int(m), int(d)).toordinal() - begin
        except ValueError:
            continue
        new = datetime.date.fromordinal(begin + p.number(at, end - begin, "short date", (lambda x: datetime.date.fromordinal(begin + x).day > 12) if late else None))
        one, two = (new.month, new.day) if late else (new.day, new.month)
        return f"{one:0{wide}d}{sep}{two:0{wide}d}{sep}{new.year % 100:02d}"
    return None


def named(p: Permuter, text: str) -> str | None:
    d, name, year = re.fullmatch(rf"(\d+)\.? (?:de )?({_MONTH}),? (?:de )?(\d+)", text, re.IGNORECASE).groups()
    return by_name(p, text, d, name, year)


def first(p: Permuter, text: str) -> str | None:
    name, d, year = re.fullmatch(rf"({_MONTH}) (\d+), (\d+)", text, re.IGNORECASE).groups()
    return by_name(p, text, d, name, year)


def by_name(p: Permuter, text: str, d: str, name: str, year: str) -> str | None:
    name = name.rstrip(".")
    held, names = (MONTH_OF, MONTHS) if name.lower() in MONTH_OF else (SHORT_OF, SHORT_MONTHS)
    month, lang = held[name.lower()]
    new = shifted(p, int(year), month, int(d))
    if new is None:
        return None
    spelt = names[new.month - 1][lang]
    spelt = spelt.upper() if name.isupper() else spelt.capitalize() if name[0].isupper() else spelt
    at = text.index(name)
    head, tail = text[:at], text[at + len(name) :]
    if spelt.lower() in MONTH_OF:  # a whole name has no full stop
        tail = tail.removeprefix(".")
    number = lambda s: re.sub(r"\d+", lambda m: str(new.year) if m.group() == year else str(new.day), s)
    return number(head) + spelt + number(tail)


def valid_ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def ssn(p: Permuter, text: str) -> str | None:
    digits = text.replace("-", "").replace(" ", "")
    return refill(text, p.string(digits, DIGITS, "ssn", valid_ssn), is_digit) if valid_ssn(digits) else None


def phone(p: Permuter, text: str) -> str | None:
    digits = "".join(filter(is_digit, text))
    if not 8 <= len(digits) <= 15:
        return None
    code = 0
    if text[0] == "+":  # the country code stays
        code = 1 if digits[0] in "17" else len(re.match(r"\+(\d{1,3})", text).group(1)) if re.match(r"\+\d{1,3}\D", text) else 2
    return refill(text, digits[:code] + p.string(digits[code:], DIGITS, f"phone{digits[:code] or 1}"), is_digit)


def number(p: Permuter, text: str) -> str | None:
    digits = "".join(filter(is_digit, text))
    if not 13 <= len(digits) <= 19:
        return None
    if luhn(digits):
        body = p.string(digits[:-1], DIGITS, "card")
        new = body + next(c for c in DIGITS if luhn(body + c))
    else:
        new = p.string(digits, DIGITS, "account", lambda x: not luhn(x))
    return refill(text, new, is_digit)


KINDS: dict[str, Callable[[Permuter, str], str | None]] = {
    "email": email, "secret": secret, "key": key, "hex": hexadecimal, "jwt": jwt, "iban": iban, "ip": ip, "ip6": ip6, "iso": iso,
    "day": day, "short": short, "named": named, "first": first, "ssn": ssn, "phone": phone, "number": number,
}


def pseudonyms(text: str, p: Permuter, found: Counter | None = None) -> str:
    """The text with its personal data replaced."""
    out, at, done = [], 0, 0
    for anchor in ANCHOR.finditer(text):
        if anchor.start() < done:
            continue
        begin = text.rfind("\n", 0, anchor.start()) + 1
        end = text.find("\n", anchor.start())
        done = end = len(text) if end < 0 else end
        place = begin
        while (m := PATTERN.search(text, place, end)) is not None:
            kind = {"sep": "day", "gap": "ssn", "mark": "iso"}.get(m.lastgroup, m.lastgroup)
            new = KINDS[kind](p, m.group())
            place = m.end()
            if new is None and kind != "number" and (n := NUMBER.match(m.group())) and (new := number(p, n.group())):
                kind, place = "number", m.start() + n.end()
            if new is None:  # not valid; what begins further on may be
                place = m.start() + len(STEP.match(m.group()).group())
                continue
            out += [text[at : m.start()], new]
            at = place
            if found is not None:
                found[kind] += 1
    return "".join([*out, text[at:]]) if out else text


NUMBER = re.compile(r"[0-9]{13,19}(?![0-9])")
STEP = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, n_found long, kinds string`` per row; ``kinds`` counts what was replaced, as JSON."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_found", pa.int64()), ("kinds", pa.string())])

    def run(batch: pa.RecordBatch, p: Permuter) -> pa.RecordBatch:
        texts, totals, kinds = [], [], []
        for text in batch.column(1).to_pylist():
            found: Counter[str] = Counter()
            texts.append(text if not text else pseudonyms(text, p, found))
            totals.append(found.total())
            kinds.append(json.dumps(found, sort_keys=True))
        return common.record(schema, batch.column(0).cast(pa.int64()), texts, totals, kinds)

    return common.arrow_map(common.pick(docs, "doc_id", "text"), run, "doc_id long, text string, n_found long, kinds string", setup=lambda: Permuter(key))


def pseudonymize_rows(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with ``text`` replaced and ``n_chars``, if there, counted again; all other columns as they were."""
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batch: pa.RecordBatch, p: Permuter) -> pa.RecordBatch:
        texts = [t if not t else pseudonyms(t, p) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if size >= 0:
            columns[size] = pa.array([n if t is None else len(t) for t, n in zip(texts, batch.column(size).to_pylist(), strict=True)], batch.schema.field(size).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return common.arrow_map(plain, run, plain.schema, setup=lambda: Permuter(key)).toDF(*names)
