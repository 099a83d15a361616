"""Operator 11: SentencePiece encoding and decoding of merge vocabularies by backtracking.

Text is parted before runs of blanks, which no piece crosses, and at ASCII
characters that no longer piece holds; each part is encoded from left to right. An Aho-Corasick automaton of the pieces gives the
longest piece that begins at each place. A piece may follow its left neighbour if
merging the two pieces' text alone, highest score first and leftmost among equals,
leaves just the two (re-merged once a pair, then remembered); otherwise the next
shorter piece that begins there is tried. If none is left, the place goes into a
bitfield of failed positions, the left neighbour is taken back and its shorter
forms are tried; no later way ends at a failed position. Neighbours that fit all
along are what the merges of the whole text leave, so there is one such way and
the ids are the library's own.

A character without a piece becomes its bytes' pieces. Pieces that merging never
makes are left out. Results don't depend on what a worker remembers. The model is
read on the driver and goes to the tasks with the code, so no executor opens its
file; its size is fixed by that file.

Defined cases: a null or empty text has no id and decodes to ''; U+2581 in a text
is a blank, as in the library; repeated rows give equal rows; texts and words of
any length are encoded whole, in time and memory proportional to their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Parts a worker remembers, none longer than so many characters; and pairs of pieces whose fit it remembers.
MEMO_PARTS, MEMO_CHARS, MEMO_PAIRS = 400_000, 64, 500_000
BLANK = "▁"
#: Fixed values of the model's format: the kind of merge models, and kinds of pieces.
MERGES = 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Fixed value: what the library decodes an unknown piece to.
UNKNOWN_TEXT = " ⁇ "


@dataclass(frozen=True)
class Model:
    """Pieces with scores and kinds by id, and whether a blank is put before a text."""

    pieces: tuple[tuple[str, float, int], ...]
    dummy_prefix: bool

    @classmethod
    def read(cls, path: str) -> Model:
        """The file's pieces. A model that rewrites texts or has pieces of other kinds is refused."""
        from sentencepiece import sentencepiece_model_pb2

        held = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            held.ParseFromString(f.read())
        form = held.normalizer_spec
        pieces = tuple((p.piece, p.score, p.type) for p in held.pieces)
        if held.trainer_spec.model_type != MERGES or not held.trainer_spec.byte_fallback or form.precompiled_charsmap or form.remove_extra_whitespaces or held.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} holds no merge model that takes texts as they are and falls back to bytes")
        if {kind for _, _, kind in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE} or any(BLANK in p.lstrip(BLANK) for p, _, kind in pieces if kind == NORMAL):
            raise ValueError(f"{path} has pieces of other kinds, or pieces that cross blanks")
        return cls(pieces, form.add_dummy_prefix)


class Coder:
    """Encodes and decodes; one per task."""

    def __init__(self, model: Model):
        self.dummy_prefix = model.dummy_prefix
        self.score = {p: s for p, s, kind in model.pieces if kind == NORMAL}
        self.id = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.text = [p for p, _, _ in model.pieces]
        self.size = [len(p) for p in self.text]
        made = {p for p in self.id if len(p) == 1 or self.merged(p) == [p]}
        self.matches = ahocorasick.Automaton()
        for p in made:
            self.matches.add_word(p, self.id[p])
        self.matches.make_automaton()
        #: The longest shorter piece that a piece begins with; -1 if none.
        self.shorter = [-1] * len(self.text)
        for p in made:
            self.shorter[self.id[p]] = next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in made), -1)
        self.known = {p for p in made if len(p) == 1}
        joint = {c for p in self.id if len(p) > 1 for c in p} | {BLANK}
        lone = "".join(f"\\x{b:02x}" for b in range(128) if chr(b) not in joint)
        self.parts = re.compile(f"{BLANK}+[^{BLANK}{lone}]*|[^{BLANK}{lone}]+" + f"|[{lone}]" * bool(lone)).findall
        #: Parts that are one piece.
        self.whole = {p: (self.id[p],) for p in made}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], int] = {}
        # For decoding: the bytes each id stands for, and which ids are bytes themselves.
        self.surface = [{NORMAL: p.replace(BLANK, " "), UNKNOWN: UNKNOWN_TEXT}.get(kind, "") for p, _, kind in model.pieces]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.blanks = {i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL and p.startswith(BLANK)}
        self.decimal = [str(i) for i in range(len(self.text))]

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves of a short text."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fit(self, left: int, token: int) -> int:
        """The longest of a piece and its shorter forms that stays as it is behind its left neighbour when the two are merged anew; -1 if none."""
        got = self.fits.get((left, token))
        if got is None:
            if len(self.fits) >= MEMO_PAIRS:
                self.fits.clear()
            a, b = self.text[left], self.text[token]
            got = token if self.merged(a + b) == [a, b] else self.fit(left, self.shorter[token]) if self.shorter[token] >= 0 else -1
            self.fits[left, token] = got
        return got

    def run(self, text: str) -> list[int]:
        """Ids of a part whose characters all have pieces."""
        n, size, fits, shorter = len(text), self.size, self.fits.get, self.shorter
        longest = [-1] * n
        for end, token in self.matches.iter(text):  # of one start the longer ones come later
            longest[end + 1 - size[token]] = token
        failed = bytearray(n // 8 + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                if tokens:
                    fit = fits((tokens[-1], token))
                    token = fit if fit is not None else self.fit(tokens[-1], token)
                    if token < 0:
                        break
                end = at + size[token]
                if not failed[end >> 3] >> (end & 7) & 1:
                    tokens.append(token)
                    at, token = end, longest[end] if end < n else -1
                    break
                token = shorter[token]
            else:
                token = -1
            if at < n and token < 0:
                failed[at >> 3] |= 1 << (at & 7)
                token = tokens.pop()
                at -= size[token]
        return tokens

    def part(self, text: str) -> tuple[int, ...]:
        known = self.known
        if text in self.whole:
            return self.whole[text]
        if known.issuperset(text):
            return tuple(self.run(text))
        ids: list[int] = []
        at, n = 0, len(text)
        while at < n:
            end = at
            while end < n and text[end] in known:
                end += 1
            if end > at:
                ids += self.run(text[at:end])
            if end < n:
                ids += [self.bytes[b] for b in text[end].encode("utf-8", "surrogatepass")]
            at = end + 1
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        ids: list[int] = []
        if not text:
            return ids
        memo = self.memo
        for part in self.parts(BLANK * self.dummy_prefix + text.replace(" ", BLANK)):
            got = memo.get(part)
            if got is None:
                got = self.part(part)
                if len(part) <= MEMO_CHARS:
                    if len(memo) >= MEMO_PARTS:
                        memo.clear()
                    memo[part] = got
            ids += got
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: runs of byte pieces are read as UTF-8, each byte that is none as U+FFFD; the blank put before a text goes."""
        byte_of, surface = self.byte_of, self.surface
        if byte_of.keys().isdisjoint(ids):
            text = "".join([surface[i] for i in ids])
        else:
            parts: list[str] = []
            held = bytearray()
            for i in ids:
                b = byte_of.get(i)
                if b is not None:
                    held.append(b)
                    continue
                if held:
                    parts.append(characters(held))
                    held.clear()
                parts.append(surface[i])
            parts.append(characters(held))
            text = "".join(parts)
        first = next((i for i in ids if surface[i] or i in byte_of), None) if self.dummy_prefix else None
        return text[1:] if first in self.blanks else text

    def joined(self, ids: Iterable[int]) -> str:
        """Decimal ids joined by commas."""
        decimal = self.decimal
        return ",".join([decimal[i] for i in ids])


def characters(held: bytes | bytearray) -> str:
    """UTF-8 to text; a byte that begins no whole character becomes U+FFFD alone."""
    try:
        return held.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(held):
            for size in (1, 2, 3, 4):
                try:
                    out.append(held[at : at + size].decode("utf-8"))
                    at += size
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids array<int>`` per row of ``docs``."""
    model = Model.read(model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batch: pa.RecordBatch, coder: Coder) -> pa.RecordBatch:
        return common.record(schema, batch.column(0).cast(pa.int64()), [coder.encode(t) for t in common.strings(batch.column(1))])

    return common.arrow_map(common.pick(docs, "doc_id", "text"), run, "doc_id long, ids array<int>", setup=lambda: Coder(model))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` per row of ``doc_id, ids``; null ids decode to ''."""
    model = Model.read(model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batch: pa.RecordBatch, coder: Coder) -> pa.RecordBatch:
        return common.record(schema, batch.column(0).cast(pa.int64()), [coder.decode(ids or []) for ids in batch.column(1).to_pylist()])

    return common.arrow_map(common.pick(encoded, "doc_id", "ids"), run, "doc_id long, text string", setup=lambda: Coder(model))


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode every text and decode its ids, in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row of ``docs``."""
    model = Model.read(model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batch: pa.RecordBatch, coder: Coder) -> pa.RecordBatch:
        counts, ids_digests, text_digests = [], [], []
        for text in common.strings(batch.column(1)):
            ids = coder.encode(text)
            counts.append(len(ids))
            ids_digests.append(hashlib.sha256(coder.joined(ids).encode()).hexdigest())
            text_digests.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
        return common.record(schema, batch.column(0).cast(pa.int64()), counts, ids_digests, text_digests)

    return common.arrow_map(common.pick(docs, "doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", setup=lambda: Coder(model))
