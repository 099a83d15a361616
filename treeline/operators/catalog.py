"""Catalogs: where public identifiers, system identifiers and URIs are to be found.

XML catalogs and the older text form are read from a library of named texts;
nothing is opened outside of it. Identifiers are resolved as the standard orders
it: an exact entry, the longest rewritten prefix, the longest suffix, then the
catalogs that the longest prefix delegates to and none else, then the next
catalogs. A catalog that leads back to itself ends there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

NS = "{urn:oasis:names:tc:entity:xmlns:xml:catalog}"
BASE = "{http://www.w3.org/XML/1998/namespace}base"
# Entries by the attributes that hold their key and their value.
ENTRIES = {
    "public": ("publicId", "uri"), "system": ("systemId", "uri"), "uri": ("name", "uri"), "rewriteSystem": ("systemIdStartString", "rewritePrefix"), "rewriteURI": ("uriStartString", "rewritePrefix"),
    "systemSuffix": ("systemIdSuffix", "uri"), "uriSuffix": ("uriSuffix", "uri"), "delegatePublic": ("publicIdStartString", "catalog"), "delegateSystem": ("systemIdStartString", "catalog"), "delegateURI": ("uriStartString", "catalog"),
}
WORD = re.compile(r"--.*?--|\"([^\"]*)\"|'([^']*)'|([^\s\"']+)", re.DOTALL)


def public_id(text: str) -> str:
    """A public identifier with white space normalised; one wrapped in a URN is unwrapped."""
    if text.startswith("urn:publicid:"):
        out = re.sub("[:;+]", lambda m: {":": "//", ";": "::", "+": " "}[m.group()], text[13:])
        return re.sub("%(2B|3A|2F|3B|27|3F|23|25)", lambda m: chr(int(m.group(1), 16)), out)
    return " ".join(text.split())


@dataclass
class Catalog:
    """Entries by kind, the next catalogs, and whether public entries count beside a system identifier."""

    name: str
    library: dict[str, str]
    entries: dict[str, dict[str, str]] = field(default_factory=lambda: {k: {} for k in ENTRIES})
    following: list[str] = field(default_factory=list)
    #: Public entries that hold only where there is no system identifier.
    modest: set[str] = field(default_factory=set)

    @classmethod
    def load(cls, library: dict[str, str], name: str) -> Catalog:
        """Read a catalog; one that is missing or broken is empty."""
        out = cls(name, library)
        text = library.get(name, "")
        if text.lstrip().startswith("<"):
            try:
                out.read_xml(ElementTree.fromstring(text), name, True)
            except ElementTree.ParseError:
                pass
        else:
            out.read_text(text)
        return out

    def add(self, kind: str, key: str, value: str) -> bool:
        """Add an entry, or give one another value; returns whether anything changed."""
        if kind not in self.entries or self.entries[kind].get(key) == value:
            return False
        self.entries[kind][key] = value
        return True

    def remove(self, value: str) -> int:
        """Remove the entries with a key or a value; returns how many."""
        n = 0
        for held in self.entries.values():
            for k in [k for k, v in held.items() if value in (k, v)]:
                del held[k]
                n += 1
        return n

    def read_xml(self, e: ElementTree.Element, base: str, prefer: bool) -> None:
        base = urljoin(base, e.get(BASE, ""))
        prefer = {"public": True, "system": False}.get(e.get("prefer", ""), prefer)
        for c in e:
            kind = c.tag.removeprefix(NS)
            if kind in ENTRIES:
                key, value = (c.get(a) for a in ENTRIES[kind])
                if key is not None and value is not None:
                    key = public_id(key) if "ublic" in kind else key
                    self.entries[kind].setdefault(key, urljoin(urljoin(base, c.get(BASE, "")), value))
                    if kind == "public" and not prefer:
                        self.modest.add(key)
            elif kind == "nextCatalog" and c.get("catalog"):
                self.following.append(urljoin(base, c.get("catalog")))
            elif kind == "group":
                self.read_xml(c, base, prefer)

    def read_text(self, text: str) -> None:
        words = [next(g for g in m.groups() if g is not None) for m in WORD.finditer(text) if m.lastindex]
        base, at, override = self.name, 0, False
        kinds = {"PUBLIC": "public", "SYSTEM": "system", "DELEGATE": "delegatePublic"}
        while at < len(words):
            word = words[at].upper()
            if word in kinds and at + 2 < len(words):
                key = public_id(words[at + 1]) if word != "SYSTEM" else words[at + 1]
                self.entries[kinds[word]].setdefault(key, urljoin(base, words[at + 2]))
                if word == "PUBLIC" and not override:
                    self.modest.add(key)
                at += 3
            elif word in ("CATALOG", "BASE", "OVERRIDE") and at + 1 < len(words):
                if word == "CATALOG":
                    self.following.append(urljoin(base, words[at + 1]))
                elif word == "BASE":
                    base = urljoin(base, words[at + 1])
                else:
                    override = words[at + 1].upper() == "YES"
                at += 2
            else:
                at += 1

    def other(self, name: str, seen: tuple[str, ...]) -> Catalog | None:
        return None if name in seen or len(seen) > 50 else Catalog.load(self.library, name)

    def one(self, kinds: tuple[str, str, str, str], value: str, seen: tuple[str, ...]) -> tuple[str | None, bool]:
        """What this catalog says of an identifier, and whether nobody else may be asked."""
        exact, rewrite, suffix, delegate = kinds
        if exact and value in self.entries[exact]:
            return self.entries[exact][value], True
        if rewrite and (held := [k for k in self.entries[rewrite] if value.startswith(k)]):
            k = max(held, key=len)
            return self.entries[rewrite][k] + value[len(k) :], True
        if suffix and (held := [k for k in self.entries[suffix] if value.endswith(k)]):
            return self.entries[suffix][max(held, key=len)], True
        if held := sorted((k for k in self.entries[delegate] if value.startswith(k)), key=len, reverse=True):
            for name in dict.fromkeys(self.entries[delegate][k] for k in held):
                if (c := self.other(name, seen)) is not None and (found := c.ask(kinds, value, (*seen, name))) is not None:
                    return found, True
            return None, True
        return None, False

    def ask(self, kinds: tuple[str, str, str, str], value: str, seen: tuple[str, ...]) -> str | None:
        found, final = self.one(kinds, value, seen)
        if final:
            return found
        for name in self.following:
            if (c := self.other(name, seen)) is not None and (found := c.ask(kinds, value, (*seen, name))) is not None:
                return found
        return None

    def system(self, value: str) -> str | None:
        return self.ask(("system", "rewriteSystem", "systemSuffix", "delegateSystem"), value, (self.name,))

    def public(self, value: str) -> str | None:
        return self.ask(("public", "", "", "delegatePublic"), public_id(value), (self.name,))

    def uri(self, value: str) -> str | None:
        if value.startswith("urn:publicid:"):
            return self.public(value)
        return self.ask(("uri", "rewriteURI", "uriSuffix", "delegateURI"), value, (self.name,))

    def resolve(self, public: str | None, system: str | None) -> str | None:
        """The system identifier goes first; a public one counts beside it unless its entry is modest."""
        if system and system.startswith("urn:publicid:"):
            public, system = public or system, None
        if system and (found := self.system(system)) is not None:
            return found
        if public and not (system and public_id(public) in self.modest):
            return self.public(public)
        return None


def edited(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """``kind, key, value``: entries after a sequence of edits, as a table.

    ``entries(kind, key, value)``, one a kind and key; ``edits(seq, op, kind, key, value)``
    with ``op`` ``add`` (sets a key's value) or ``remove`` (of all entries whose key or
    value is ``value``). Of a key only the last ``add`` can stand, and it does unless a
    later ``remove`` names it, so no order of all edits is needed: one aggregate by
    key, and two anti-joins.
    """
    first = entries.select(F.lit(None).cast("long").alias("seq"), "kind", "key", "value")
    added = edits.where("op = 'add'").select(F.col("seq").cast("long"), "kind", "key", "value").unionByName(first)
    # The entries themselves come before all edits.
    last = added.groupBy("kind", "key").agg(F.max(F.struct(F.col("seq").isNotNull().alias("later"), "seq", "value")).alias("x")).select("kind", "key", "x.value", F.coalesce("x.seq", F.lit(-(1 << 62))).alias("at"))
    removed = edits.where("op = 'remove'").groupBy(F.col("value").alias("what")).agg(F.max(F.col("seq").cast("long")).alias("last"))
    left = last.join(removed, (F.col("value") == F.col("what")) & (F.col("last") > F.col("at")), "left_anti")
    return left.join(removed, (F.col("key") == F.col("what")) & (F.col("last") > F.col("at")), "left_anti").select("kind", "key", "value")


def resolved(library: dict[str, str], name: str, public: Column, system: Column) -> Column:
    """The resolution of a public and a system identifier by a catalog; null if it has none."""

    @pandas_udf("string")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        catalog = Catalog.load(library, name)
        for p, s in batches:
            yield pd.Series([catalog.resolve(a, b) for a, b in zip(p, s, strict=True)], dtype=object)

    return ask(public, system)


def resolved_uri(library: dict[str, str], name: str, uri: Column) -> Column:
    @pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        catalog = Catalog.load(library, name)
        for u in batches:
            yield pd.Series([None if x is None else catalog.uri(x) for x in u], dtype=object)

    return ask(uri)
