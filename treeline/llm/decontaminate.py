"""Operator 9: benchmark decontamination by a broadcast set of test n-grams.

Texts are lower-cased (A-Z) and cut into words, runs of digits, letters a-z and
characters outside ASCII. An item's windows are its runs of ``window``
consecutive words; an item of fewer words, but not none, is one window. A word
of a document is hit if it lies in an occurrence of any window.

The windows become sorted 64-bit hashes that point into the benchmark's words,
kept as numbers. A scan numbers a batch's words, hashes only stretches in which
every word is a benchmark word, looks the hashes up and compares the words
themselves, so a collision is no hit. The set is broadcast while the benchmark
has at most ``PASS_WORDS`` words, which is counted first; a larger one is taken
in parts of that size, one at a time, a pass over the documents each. A pass
hands on the hits of texts that have some, once a text, named by the text's
SHA-256, and equal texts have equal hits, so rows go by their own text whatever
their ids. Hits of at most ``BROADCAST`` different texts are broadcast; beyond
that, counts are joined by digest without the text, and only where rows or cleaned
texts are asked for does the text meet its digest in an equi-join.

Defined cases: a null or empty text has no words, no hit and is clean; a null or
empty item has no window; items with equal text are all counted; equal item ids
count once, a null one not at all (its passage still hits); repeated documents
give equal rows; an empty benchmark leaves everything clean.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Benchmark words that one pass broadcasts. An index takes about 100 bytes a word on the driver while it is built
#: (measured, each word another one) and half of that when sent.
PASS_WORDS = 1_000_000
#: Different texts with hits that are broadcast: their digests, or their masks and items (about 100 bytes and an eighth of a byte a word).
BROADCAST = 200_000
#: Windows compared at once.
BLOCK = 1 << 16

#: Every byte that is no word byte becomes a blank; A-Z become a-z.
PLAIN = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FACTOR, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split()


@dataclass
class Windows:
    """The different windows of one length in order of hash: where each begins in the benchmark's words, and its items' places."""

    length: int
    hashes: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    owners: np.ndarray


def hashed(ids: np.ndarray, starts: np.ndarray, length: int, factor: np.uint64 = FACTOR) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for k in range(length):
        out = (out + ids[starts + k].astype(np.uint64) + np.uint64(1)) * factor
        out ^= out >> np.uint64(29)
    return out


class Index:
    """The windows of a benchmark, or of a part of one."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        flat, begins, self.names = array("i"), array("q"), []
        for name, text in items:
            begins.append(len(flat))
            self.names.append(name)
            flat.extend(self.numbers.setdefault(w, len(self.numbers)) for w in words(text or ""))
        begins.append(len(flat))
        self.flat, at = np.array(flat, np.int32), np.array(begins, np.int64)
        sizes = np.diff(at)
        wide = np.minimum(sizes, window)
        self.lengths = [self.windows(int(n), at[:-1][wide == n], sizes[wide == n], np.flatnonzero(wide == n)) for n in np.unique(wide[wide > 0])]

    def windows(self, length: int, begin: np.ndarray, sizes: np.ndarray, item: np.ndarray) -> Windows:
        n = sizes - length + 1
        starts = np.repeat(begin, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        h, other = hashed(self.flat, starts, length), hashed(self.flat, starts, length, OTHER)
        order = np.lexsort((other, h))
        h, other, starts, owners = h[order], other[order], starts[order].astype(np.int32), np.repeat(item, n)[order].astype(np.int32)
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (other[1:] != other[:-1])))
        # Windows of equal hashes are one only if their words are equal.
        while len(odd := np.flatnonzero(~self.same(starts, starts[np.flatnonzero(new)][np.cumsum(new) - 1], length))):
            new[odd] = True
        first = np.flatnonzero(new)
        return Windows(length, h[first], starts[first], np.append(first, len(starts)), owners)

    def same(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the windows at two places hold the same words."""
        out, k = np.ones(len(a), bool), np.arange(length)
        for at in range(0, len(a), BLOCK):
            x, y = (z[at : at + BLOCK, None].astype(np.int64) + k for z in (a, b))
            out[at : at + BLOCK] = (self.flat[x] == self.flat[y]).all(1)
        return out

    def items(self, w: Windows, k: int) -> set[str]:
        return {self.names[o] for o in set(w.owners[w.first[k] : w.first[k + 1]].tolist())} - {None}

    def scan(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """For texts as lists of words: where each begins, whether each word is hit (a gap of one between texts), the items found by text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))
        gap = [b""]  # between texts; no word is empty
        flat = chain.from_iterable(chain.from_iterable(zip(texts, repeat(gap))))
        ids = np.fromiter(map(self.numbers.get, flat, repeat(-1)), np.int32, int(begin[-1]))
        unknown = np.concatenate(([0], np.cumsum(ids < 0)))
        marks, found = np.zeros(len(ids) + 1, np.int64), {}
        for w in self.lengths:
            if len(ids) < w.length:
                continue
            starts = np.flatnonzero(unknown[w.length :] == unknown[: len(ids) - w.length + 1])
            h = hashed(ids, starts, w.length)
            lo, hi = np.searchsorted(w.hashes, h, "left"), np.searchsorted(w.hashes, h, "right")
            while (more := lo < hi).any():  # more than one turn only where hashes collide
                at, row = starts[more], lo[more]
                k = np.arange(w.length)
                same = (ids[at[:, None] + k] == self.flat[w.starts[row].astype(np.int64)[:, None] + k]).all(1)
                for place, which in zip(at[same].tolist(), row[same].tolist(), strict=True):
                    found.setdefault(place, set()).update(self.items(w, which))
                np.add.at(marks, at[same], 1)
                np.add.at(marks, at[same] + w.length, -1)
                lo = lo + 1
        by_text: dict[int, set[str]] = {}
        if found:
            for place, who in zip(found, np.searchsorted(begin, list(found), "right") - 1, strict=True):
                by_text.setdefault(int(who), set()).update(found[place])
        return begin, np.cumsum(marks)[:-1] > 0, by_text


def passes(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The benchmark's items and in how many parts they are taken."""
    items = common.pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.select((F.octet_length(F.coalesce("text", F.lit(""))) / 2 + 1).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    return items, -(-total // PASS_WORDS) or 1


def index(items: DataFrame, parts: int, k: int, window: int):
    """One part's index, broadcast."""
    rows = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
    return items.sparkSession.sparkContext.broadcast(Index((tuple(r) for r in rows.toLocalIterator()), window))


def scanned(texts: list[str], held: Index) -> tuple[np.ndarray, list[np.ndarray], dict[int, set[str]]]:
    """The number of words, the hit words and the found items of each text."""
    cut = [words(t) for t in texts]
    begin, hit, found = held.scan(cut)
    n = np.fromiter(map(len, cut), np.int64, len(cut))
    return n, [hit[a:b] for a, b in zip(begin[:-1].tolist(), (begin[:-1] + n).tolist(), strict=True)], found


def bad(n_hit: np.ndarray, n_words: np.ndarray, share: int) -> np.ndarray:
    return (n_hit > 0) & (share * n_hit >= n_words)


def hits(docs: DataFrame, items: DataFrame, parts: int, window: int) -> DataFrame:
    """``(digest, n_words, masks, items)`` of every text with hits in any part: the masks of its passes, and the items' lists."""
    schema = pa.schema([("digest", pa.binary()), ("n_words", pa.int64()), ("mask", pa.binary()), ("items", pa.list_(pa.string()))])
    ddl, found = "digest binary, n_words long, mask binary, items array<string>", None
    for k in range(parts):
        held = index(items, parts, k, window)

        def run(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            texts = list(dict.fromkeys(common.strings(batch.column(0))))
            n, hit, items_ = scanned(texts, held.value)
            some = [j for j, h in enumerate(hit) if h.any()]
            return common.record(schema, [digest(texts[j]) for j in some], n[some], [np.packbits(hit[j]).tobytes() for j in some], [sorted(items_.get(j, ())) for j in some])

        # Copies of a text have the same hits: one of them is enough, and is chosen before anything is shuffled.
        once = common.arrow_map(common.pick(docs, "text"), run, ddl).groupBy("digest").agg(*[F.first(c).alias(c) for c in ("n_words", "mask", "items")])
        found = common.settle(once if found is None else found.unionByName(once))
        held.destroy()
    return found.groupBy("digest").agg(F.first("n_words").alias("n_words"), F.collect_list("mask").alias("masks"), F.collect_list("items").alias("items"))


def bounded(found: DataFrame) -> DataFrame:
    """Broadcast rows of hits if they are few, which is counted."""
    found = common.settle(found)
    return F.broadcast(found) if found.count() <= BROADCAST else found


def digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def united(masks: list[bytes], n: int) -> np.ndarray:
    """The words that any pass hit."""
    out = np.zeros(n, bool)
    for m in masks:
        out |= np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: int = SHARE, spans: bool = False) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    With ``spans`` also ``cleaned string``: the text without its hit words and
    what lies between two hit words next to each other.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), *[("cleaned", pa.string())] * spans])
    ddl = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", cleaned string" * spans

    def said(ids: pa.Array, texts: list[str], n: np.ndarray, hit: list[np.ndarray], items: list[set[str]]) -> pa.RecordBatch:
        n_hit = np.fromiter((int(h.sum()) for h in hit), np.int64, len(hit))
        names = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
        more = [[cleaned(t, h) for t, h in zip(texts, hit, strict=True)]] if spans else []
        return common.record(schema, ids.cast(pa.int64()), n, n_hit, [len(x) for x in items], names, bad(n_hit, n, share), *more)

    rows, (items, parts) = common.pick(docs, "doc_id", "text"), passes(benchmark)
    if parts == 1:
        held = index(items, 1, 0, window)

        def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = common.strings(batch.column(1))
            n, hit, found = scanned(texts, held.value)
            return said(batch.column(0), texts, n, hit, [found.get(k, set()) for k in range(len(texts))])

        return common.arrow_map(rows, whole, ddl)

    known = hits(docs, items, parts, window).select(F.col("digest").alias("d"), "masks", "items")
    own = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    if spans:

        def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = common.strings(batch.column(1))
            n = np.fromiter((len(words(t)) for t in texts), np.int64, len(texts))
            hit = [united(m or [], int(k)) for m, k in zip(batch.column(2).to_pylist(), n, strict=True)]
            return said(batch.column(0), texts, n, hit, [{x for part in p or [] for x in part} for p in batch.column(3).to_pylist()])

        return common.arrow_map(rows.join(bounded(known), own == F.col("d"), "left").select("doc_id", "text", "masks", "items"), joined, ddl)
    # Counts need no text: a text's words are counted where it is read, and its hits meet them by digest.
    counted = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("own", pa.binary())])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = common.strings(batch.column(1))
        return common.record(counted, batch.column(0).cast(pa.int64()), [len(words(t)) for t in texts], [digest(t) for t in texts])

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.column(1).to_numpy()
        hit = [united(m or [], int(k)) for m, k in zip(batch.column(2).to_pylist(), n, strict=True)]
        return said(batch.column(0), [], n, hit, [{x for part in p or [] for x in part} for p in batch.column(3).to_pylist()])

    narrow = common.arrow_map(rows, count, "doc_id long, n_words long, own binary")
    return common.arrow_map(narrow.join(bounded(known), F.col("own") == F.col("d"), "left").select("doc_id", "n_words", "masks", "items"), judge, ddl)


def cleaned(text: str, hit: np.ndarray) -> str:
    """The text without runs of hit words."""
    if not hit.any():
        return text
    data = text.encode("utf-8", "surrogatepass")
    where = [m.span() for m in WORD.finditer(data.lower())]
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True):
        out.append(data[at : where[a][0]])
        at = where[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all columns as they were.

    Each row goes by its own text. With a benchmark of several passes that is the
    text's digest among those of contaminated texts; the result is the same.
    """
    names, at = docs.columns, docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    items, parts = passes(benchmark)
    if parts == 1:
        held = index(items, 1, 0, window)

        def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, hit, _ = scanned(common.strings(batch.column(at)), held.value)
            n_hit = np.fromiter((int(h.sum()) for h in hit), np.int64, len(hit))
            return batch.filter(pa.array(~bad(n_hit, n, share)))

        return common.arrow_map(plain, whole, plain.schema).toDF(*names)
    schema = pa.schema([("d", pa.binary())])

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.column(1).to_numpy()
        n_hit = np.fromiter((int(united(m, int(k)).sum()) for m, k in zip(batch.column(2).to_pylist(), n, strict=True)), np.int64, len(n))
        return common.record(schema, batch.column(0).filter(pa.array(bad(n_hit, n, share))))

    gone = common.arrow_map(hits(docs, items, parts, window), judged, "d binary")
    own = F.unhex(F.sha2(F.coalesce(f"c{at}", F.lit("")), 256))
    return plain.join(bounded(gone), own == F.col("d"), "left_anti").toDF(*names)
