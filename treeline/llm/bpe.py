"""Operator 1: BPE encoding and decoding with a minimal acyclic transducer lexicon.

The most frequent words of the corpus are merged once, on the driver, and
compiled into a minimal acyclic automaton over bytes whose transitions carry
token ids (outputs are pushed as far to the front as sharing allows, so equal
suffixes share their states). The automaton is a flat file of integer arrays in
the folder all executors share; Spark hands it to each executor once
(``SparkContext.addFile``) and the Python workers map it into memory. Words that
it doesn't hold are merged exactly, lowest merge rank first. The lexicon only
decides speed: results are those of the tokenizer whatever it holds.

Which characters are letters, numbers or blanks, their lower-case forms and
their compositions differ between versions of Unicode, and the tokenizers
library holds several of them. The driver asks the library once for every code
point (:func:`alphabet`) and hands the answer to all workers, so that no result
depends on the Unicode version of an executor's Python.

Defined cases: a null or empty text has no token, the digest of nothing and the
decoded text ''. Repeated rows and ties give equal rows. Texts are never cut.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import io
import json
import mmap
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words compiled into the lexicon: a documented bound of the driver's work.
LEXICON_WORDS = 40_000
#: Words a worker remembers between batches; beyond it the memory is emptied. Longer ones than so many characters aren't remembered.
MEMO_WORDS, MEMO_CHARS = 300_000, 64
#: Bytes from which a word is merged with a heap.
LONG_WORD = 200


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


@dataclass(frozen=True)
class Alphabet:
    """How the tokenizers library sees characters: ranges of code points, and where it differs from this Python."""

    letters: list[tuple[int, int]]
    numbers: list[tuple[int, int]]
    blanks: list[tuple[int, int]]
    #: Lower-case forms, and the characters of which Python gives another.
    lower: dict[int, str]
    otherwise: str
    #: Characters that the library's composition doesn't know: they stand alone there.
    apart: str


def in_class(ranges: list[tuple[int, int]], last: int = sys.maxunicode) -> str:
    """The inside of a character class of those ranges up to a code point."""
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(min(b, last)))}" for a, b in ranges if a <= last)


@functools.cache
def alphabet() -> Alphabet:
    """Ask the installed library about every code point, a few seconds once a process."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    whole = "".join(every)

    def runs(kind: str) -> list[tuple[int, int]]:
        found = pre_tokenizers.Split(Regex(f"{kind}+"), "removed", invert=True).pre_tokenize_str(whole)
        return [(ord(run[0]), ord(run[-1])) for run, _ in found]

    said = normalizers.Lowercase().normalize_str("\n".join(c for c in every if c != "\n")).split("\n")
    lower = {ord(c): low for c, low in zip((c for c in every if c != "\n"), said, strict=True) if c != low}
    otherwise = [c for c in every if lower.get(ord(c), c) != c.lower()]
    # Composition: a character may differ only if it combines or takes part in a canonical decomposition.
    compose, apart = normalizers.NFC().normalize_str, set()
    for c in every:
        parts = unicodedata.normalize("NFD", c)
        if unicodedata.combining(c) and compose(pair := f"a\u0315{c}\u0300") != unicodedata.normalize("NFC", pair):
            apart.add(c)
        elif parts != c and not "\uac00" <= c <= "\ud7a3" and compose(parts) != unicodedata.normalize("NFC", parts):
            apart.update(c, parts[1:])
    return Alphabet(runs(r"\p{L}"), runs(r"\p{N}"), runs(r"\s"), lower, "".join(otherwise), "".join(sorted(apart)))


class Tokenizer:
    """What a BPE file in the JSON format of the tokenizers library says, as plain tables."""

    def __init__(self, path: str, characters: Alphabet | None = None):
        """``path`` is the tokenizer's file, or its whole text as :func:`read_tokenizer` gives it."""
        with io.StringIO(path) if path.startswith("{") else open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        after = "|".join(x[1:] for x in split.split("|") if x[0] == "'")
        held = characters or alphabet()

        def splitter(last: int):
            """The file's split for texts of characters up to ``last``; white space only parts words."""
            letters, numbers, blanks = (in_class(r, last) for r in (held.letters, held.numbers, held.blanks))
            return re.compile(f"[{letters}]+|[{numbers}]|'(?:{after})|[^{blanks}{letters}{numbers}]+").findall

        # Small classes are faster: most texts need Latin-1 alone, nearly all others no more than the basic plane.
        self.latin, self.basic, self.general = (splitter(n) for n in (0xFF, 0xFFFF, sys.maxunicode))
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.lower = held.lower
        self.otherwise = re.compile(f"[{re.escape(held.otherwise)}]").search if held.otherwise else None
        self.apart = re.compile(f"([{re.escape(held.apart)}]+)") if held.apart else None
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        self.letters = byte_letters()
        names = {i: t for t, i in (self.ids | self.added).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]

    def words(self, text: str) -> list[str]:
        """The words of a text: NFC, blanks joined, lower case letter by letter, then split."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            # A final capital sigma gets the form that it has elsewhere, as letters are looked at one by one.
            text = self.composed(text).replace("\u03a3", "\u03c3")
            text = text.translate(self.lower) if self.otherwise and self.otherwise(text) else text.lower()
            return self.general(text) if self.beyond(text) else self.basic(text)
        return self.latin(text.lower())

    def composed(self, text: str) -> str:
        """NFC as the library has it."""
        if self.apart is None or self.apart.search(text) is None:
            return unicodedata.normalize("NFC", text)
        return "".join(x if k % 2 else unicodedata.normalize("NFC", x) for k, x in enumerate(self.apart.split(text)))

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The text between added tokens, and the added tokens with their ids, in order."""
        if not self.added or not any(t in text for t in self.added):
            return [(text, None)]
        found, at = [], 0
        for m in self.special.finditer(text):
            found += [(text[at : m.start()], None), (m.group(), self.added[m.group()])]
            at = m.end()
        return [*found, (text[at:], None)]

    def merge(self, word: str) -> list[int]:
        """Exact BPE of one word: join the pair of lowest rank, leftmost first, until none is left."""
        parts = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.suffix
        get, none = self.ranks.get, len(self.ranks)
        if len(parts) > LONG_WORD:
            return self.merge_long(parts)
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            parts[k : k + 2] = [joined := parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((parts[k - 1], joined), none)
            if k < len(ranks):
                ranks[k] = get((joined, parts[k + 1]), none)
        return self.numbered(parts)

    def merge_long(self, parts: list[str]) -> list[int]:
        """The same for a very long word, in n log n: a heap of pairs over a linked list of parts."""
        get, n = self.ranks.get, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, k, p) for k, p in enumerate(zip(parts, parts[1:])) if (r := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k]
            if j < 0 or (parts[k], parts[j]) != pair or not pair[0]:
                continue
            parts[k], parts[j] = pair[0] + pair[1], ""
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (r := get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, (parts[left], parts[right])))
        return self.numbered([p for p in parts if p])

    def numbered(self, parts: list[str]) -> list[int]:
        # A part the vocabulary lacks has no unknown token to stand for it, so it is dropped.
        ids = self.ids
        return [ids[p] for p in parts if p in ids]


class Lexicon:
    """A minimal acyclic transducer from byte strings to id sequences.

    Layout: int32 arrays one after another. State ``s`` has the edges
    ``first[s] .. first[s + 1]``; an edge has a byte, a target and an output (a
    range of ``pool``). ``final[s]`` is -1, or the range number of the output
    that ends a word there.
    """

    MAGIC = 0x4D415431

    def __init__(self, data: bytes | mmap.mmap):
        head = np.frombuffer(data, np.int32, 6)
        assert head[0] == self.MAGIC, "not a lexicon"
        _, states, edges, ranges, pool, self.words = (int(x) for x in head)
        at = 6 * 4

        def take(n: int) -> np.ndarray:
            nonlocal at
            at += 4 * n
            return np.frombuffer(data, np.int32, n, at - 4 * n)

        self.first, self.final = take(states + 1), take(states)
        self.label, self.target, self.output = take(edges), take(edges), take(edges)
        self.start, self.pool = take(ranges + 1), take(pool)
        self.states = states
        # For lookups of many words at once: (state, byte) as one sorted key.
        self.keys = np.repeat(np.arange(states, dtype=np.int64), np.diff(self.first)) * 256 + self.label

    @classmethod
    def map(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def lookup(self, words: list[bytes]) -> list[bytes | None]:
        """Ids (little-endian, 4 bytes each) of each word; None where the lexicon lacks it.

        All words walk together, a byte a step.
        """
        n = len(words)
        if not n:
            return []
        size = np.fromiter(map(len, words), np.int64, n)
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        text = np.frombuffer(b"".join(words), np.uint8)
        state = np.zeros(n, np.int64)
        outputs: list[tuple[np.ndarray, np.ndarray]] = []
        alive = np.flatnonzero(size > 0)
        for step in range(int(size.max(initial=0)) if len(self.keys) else 0):
            alive = alive[(size[alive] > step) & (state[alive] >= 0)]
            if not len(alive):
                break
            key = state[alive] * 256 + text[begin[alive] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[edge] == key
            state[alive] = np.where(ok, self.target[edge], -1)
            said = self.output[edge[ok]]
            outputs.append((alive[ok][said > 0], said[said > 0]))
        if not len(self.keys):
            state[size > 0] = -1
        last = np.where(state >= 0, self.final[np.maximum(state, 0)], -1)
        found: list[list[bytes] | None] = [[] if x >= 0 else None for x in last.tolist()]
        start, pool = self.start, self.pool.tobytes()
        outputs.append((np.flatnonzero(last > 0), last[last > 0]))
        for who, said in outputs:
            for w, a, b in zip(who.tolist(), (start[said] * 4).tolist(), (start[said + 1] * 4).tolist(), strict=True):
                if (f := found[w]) is not None:
                    f.append(pool[a:b])
        return [None if f is None else b"".join(f) for f in found]


def compile_lexicon(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """The smallest automaton of the given words, with outputs as early as all words below allow.

    Words of over ``LONG_WORD`` bytes are left out; they are merged when they occur.
    """
    entries = {w: o for w, o in entries.items() if len(w) <= LONG_WORD}
    ranges: dict[tuple[int, ...], int] = {(): 0}
    held: dict[tuple, int] = {}  # a state by what leaves it: equal right languages share it
    states: list[tuple] = []

    def number(out: tuple[int, ...]) -> int:
        return ranges.setdefault(out, len(ranges))

    def prefix(outs: list[tuple[int, ...]]) -> tuple[int, ...]:
        a, b = min(outs), max(outs)
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return a[:k]

    def build(items: list[tuple[bytes, tuple[int, ...]]], depth: int) -> int:
        final, edges, k = -1, [], 0
        if items and len(items[0][0]) == depth:
            final, k = number(items[0][1]), 1
        while k < len(items):
            byte, end = items[k][0][depth], k + 1
            while end < len(items) and items[end][0][depth] == byte:
                end += 1
            below = items[k:end]
            common_out = prefix([o for _, o in below])
            edges.append((byte, build([(w, o[len(common_out) :]) for w, o in below], depth + 1), number(common_out)))
            k = end
        shape = (final, tuple(edges))
        if shape not in held:
            held[shape] = len(states)
            states.append(shape)
        return held[shape]

    root = build(sorted(entries.items()), 0)
    order = {root: 0}  # the start state comes first
    for s in range(len(states)):
        order.setdefault(s, len(order))
    by_place = sorted(range(len(states)), key=order.__getitem__)
    first, final, label, target, output = [0], [], [], [], []
    for s in by_place:
        end, edges = states[s]
        final.append(end)
        for byte, to, out in edges:
            label.append(byte), target.append(order[to]), output.append(out)
        first.append(len(label))
    pool = [i for out in ranges for i in out]
    start = np.cumsum([0, *map(len, ranges)])
    head = [Lexicon.MAGIC, len(states), len(label), len(ranges), len(pool), len(entries)]
    return b"".join(np.asarray(x, np.int32).tobytes() for x in (head, first, final, label, target, output, start, pool))


class Coder:
    """Encodes and decodes texts with a tokenizer's tables and a lexicon."""

    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon | None):
        self.tokenizer, self.lexicon, self.memo = tokenizer, lexicon, {}
        spell = [name.encode("utf-8", "surrogatepass") for name in tokenizer.names]
        self.spelt = np.frombuffer(b"".join(spell), np.uint8)
        self.spelt_at = np.cumsum([0, *map(len, spell)])

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of all words: those of short words are remembered, those of long ones are for this batch alone."""
        memo = self.memo
        if len(memo) + len(words) > MEMO_WORDS:
            memo.clear()
        new = [w for w in words if w not in memo]
        got = self.lexicon.lookup([w.encode("utf-8", "surrogatepass") for w in new]) if self.lexicon else [None] * len(new)
        merge, long = self.tokenizer.merge, {}
        for w, ids in zip(new, got, strict=True):
            (memo if len(w) <= MEMO_CHARS else long)[w] = np.asarray(merge(w), "<u4").tobytes() if ids is None else ids
        return memo | long if long else memo

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        t, cut = self.tokenizer, []
        for text in texts:
            cut.append([(t.words(s) if i is None else [], i) for s, i in t.segments(text)] if text else [])
        known = self.learn(set().union(*(words for parts in cut for words, _ in parts)))
        return [b"".join(b"".join(map(known.__getitem__, words)) if i is None else i.to_bytes(4, "little") for words, i in parts) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The tokenizer's decode() without a decoder: its token strings, a blank between each two."""
        return self.decode_bytes(ids).decode("utf-8", "surrogatepass")

    def decode_bytes(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(i):
            return b""
        a, size = self.spelt_at[i], self.spelt_at[i + 1] - self.spelt_at[i]
        ends = np.cumsum(size + 1)
        out = np.full(int(ends[-1]), 32, np.uint8)
        begin = ends - size - 1
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin, size) + place] = self.spelt[np.repeat(a, size) + place]
        return out[:-1].tobytes()


class Frequent:
    """The most frequent words of a stream in bounded memory, by lossy counting.

    Beyond ``room`` entries the least count that an entry must have goes up until
    half are gone; a word that a task holds more often than that is never lost.
    """

    def __init__(self, room: int):
        self.room, self.least, self.seen = room, 0, Counter()

    def update(self, words: list[str]) -> None:
        self.seen.update(words)
        while len(self.seen) > self.room:
            self.least += 1
            if len(left := {w: n for w, n in self.seen.items() if n > self.least}) <= self.room // 2:
                self.seen = Counter(left)

    def top(self, n: int) -> list[tuple[str, int]]:
        return sorted(self.seen.items(), key=lambda x: (-x[1], x[0]))[:n]


def read_tokenizer(path: str) -> str:
    """The tokenizer's file, read on the driver: its text goes to the tasks with the code, so no executor opens the path."""
    with open(path, encoding="utf-8") as f:
        return f.read().lstrip()


def count_words(docs: DataFrame, tokenizer_path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """How often the frequent words of the corpus occur, over all documents: ``(word, n)``.

    Each task counts its texts in bounded memory and hands on at most ``words``
    rows, so what is shuffled is bounded by the number of tasks, and a third of
    all rows with one text costs no more than others.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    held, said = alphabet(), read_tokenizer(tokenizer_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen = Tokenizer(said, held), Frequent(8 * words)
        for batch in batches:
            for text in common.strings(batch.column(0)):
                for s, i in t.segments(text):
                    if i is None:
                        seen.update([w for w in t.words(s) if len(w) <= LONG_WORD])
        top = seen.top(words)
        yield common.record(schema, [w for w, _ in top], [n for _, n in top])

    common.session(docs.sparkSession)
    return common.pick(docs, "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def publish_lexicon(docs: DataFrame, tokenizer_path: str, words: int = LEXICON_WORDS) -> str:
    """Compile the corpus' most frequent words and hand the file to every executor; returns its name."""
    spark = docs.sparkSession
    # Counts are binned by eighths of powers of two, so that the driver learns from a few hundred rows which words to take.
    counted = common.settle(count_words(docs, tokenizer_path, words).withColumn("bin", F.floor(8 * F.log2("n")).cast("int")))
    bins = counted.groupBy("bin").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("bin")).toPandas()
    whole = bins[bins["k"].cumsum() <= words]
    top = counted.where(F.col("bin") >= int(whole["bin"].min())).select("word").toPandas()["word"] if len(whole) else []
    t = Tokenizer(tokenizer_path)
    data = compile_lexicon({w.encode("utf-8", "surrogatepass"): tuple(t.merge(w)) for w in top})
    return common.publish(spark, "lexicon", [data])


def encode_decode(docs: DataFrame, tokenizer_path: str, *, keep_ids: bool = False, keep_text: bool = False, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Encode every text and decode it again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and with
    ``keep_ids`` / ``keep_text`` also ``ids array<int>`` / ``decoded string``.
    """
    name = publish_lexicon(docs, tokenizer_path, lexicon_words)
    extra = [("ids", pa.list_(pa.int32()))] * keep_ids + [("decoded", pa.string())] * keep_text
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *extra])
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def run(batch: pa.RecordBatch, coder: Coder) -> pa.RecordBatch:
        ids = coder.encode(common.strings(batch.column(1)))
        digests, decoded = [], []
        for x in ids:
            text = coder.decode_bytes(x)
            digests.append(hashlib.sha256(text).hexdigest())
            if keep_text:
                decoded.append(text.decode("utf-8", "surrogatepass"))
        more = [[np.frombuffer(x, "<i4") for x in ids]] * keep_ids + [decoded] * keep_text
        return common.record(schema, batch.column(0).cast(pa.int64()), [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], digests, *more)

    held, said = alphabet(), read_tokenizer(tokenizer_path)
    setup = lambda: Coder(Tokenizer(said, held), Lexicon.map(SparkFiles.get(name)))
    return common.arrow_map(common.pick(docs, "doc_id", "text"), run, ddl, setup=setup)
