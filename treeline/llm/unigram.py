"""Operator 7: token counts of a tokenizer by count-only dynamic programming.

The vocabulary's pieces are an Aho-Corasick automaton. Text is parted before runs
of blanks, which no piece crosses, and over each part dynamic programming carries
what its ends need and no path:

* Unigram vocabularies (``UnigramCounter``): for each end the best score and the
  number of tokens on the way there. Ties go as in the tokenizers library's
  Unigram model: of the ways to an end, that with the earliest last start stands
  unless a later one scores strictly higher, and a character that no single piece
  covers may be unknown, ten below the least score. An unknown stretch counts as
  the bytes of its pieces if the vocabulary has all of them, else as one token.
* Merge vocabularies (``MergeCounter``): for each end the last token of the
  prefix that ends there and the number of tokens. Of the pieces that the
  automaton reports at an end, the last token is the one that its left neighbour
  leaves whole: merging the two pieces' text alone, highest score first and
  leftmost among equals, gives just the two. Such neighbours all along are what
  the merges of the whole text leave, so the counts are SentencePiece's own.

A best score over merge ranks is no tokenizer's result, so the kind of the
vocabulary decides. A worker remembers the short parts it has counted; texts are
read once and never shuffled. The vocabulary's size is fixed by its file.

Defined cases: a null or empty text has 0 tokens and score 0; repeated rows give
equal rows; texts and words of any length are counted whole.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Parts a worker remembers, none longer than so many characters; and pairs of pieces whose fit it remembers.
MEMO_PARTS, MEMO_CHARS, MEMO_PAIRS = 400_000, 64, 500_000
BLANK = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """What both kinds share: parts of a text, and the memory of counted ones."""

    memo: dict[str, tuple[int, float]]

    def part(self, text: str) -> tuple[int, float]:
        raise NotImplementedError

    def count(self, text: str) -> tuple[int, float]:
        """Tokens and score of a whole text."""
        if not text:
            return 0, 0.0
        memo, tokens, score = self.memo, 0, 0.0
        for part in self.parts(text):
            got = memo.get(part)
            if got is None:
                got = self.part(part)
                if len(part) <= MEMO_CHARS:
                    if len(memo) >= MEMO_PARTS:
                        memo.clear()
                    memo[part] = got
            tokens += got[0]
            score += got[1]
        return tokens, score


class UnigramCounter(Counter):
    """Counts by the best score; the score is the sum of the parts' best."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0):
        self.scores: dict[str, float] = {}
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.scores[piece] = score  # of equal pieces the last holds, as in the library
        for piece, score in self.scores.items():
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes_known = all(f"<0x{b:02X}>" in self.scores for b in range(256))
        self.known_bytes = {b for b in range(256) if f"<0x{b:02X}>" in self.scores}
        self.unknown_piece = pieces[unknown][0]
        self.memo: dict[str, tuple[int, float]] = {}

    def part(self, text: str) -> tuple[int, float]:
        """Tokens and best score of one part.

        The automaton reports the matches of an end longest first, that is by
        start, so of equal scores the first is kept.
        """
        n = len(text)
        best: list[float] = [0.0] * (n + 1)
        count = [0] * (n + 1)
        #: Where the unknown stretch that ends here began; -1 after a known piece.
        since = [-1] * (n + 1)
        at, single = 0, False
        found: float | None = None
        for end, (size, score) in self.matches.iter(text):
            while at < end:
                if not single:
                    self.settle(text, at, found, best, count, since)
                at, found, single = at + 1, None, False
            total = best[end + 1 - size] + score
            if found is None or total > found:
                best[end + 1] = found = total
                count[end + 1] = count[end + 1 - size] + 1
            if size == 1:
                single = True
        while at < n:
            if not single:
                self.settle(text, at, found, best, count, since)
            at, found, single = at + 1, None, False
        return count[n], best[n]

    def settle(self, text: str, at: int, found: float | None, best: list[float], count: list[int], since: list[int]) -> None:
        """A character that no single piece covers: the way on which it is unknown."""
        total = best[at] + self.unknown
        if found is None or total > found:
            begin = at if since[at] < 0 else since[at]
            best[at + 1], since[at + 1] = total, begin
            count[at + 1] = count[begin] + self.stretch(text, begin, at, count, since)

    def stretch(self, text: str, begin: int, at: int, count: list[int], since: list[int]) -> int:
        """Tokens of the unknown stretch ``begin .. at``, its last character included."""
        if self.bytes_known:
            return (count[at] - count[begin]) + len(text[at].encode("utf-8", "surrogatepass"))
        held = set(text[begin : at + 1].encode("utf-8", "surrogatepass"))
        return len(text[begin : at + 1].encode("utf-8", "surrogatepass")) if held <= self.known_bytes else 1

    def parts(self, text: str) -> list[str]:
        text = text.replace(" ", BLANK)
        return WORDS(text if text[0] == BLANK else BLANK + text)


class MergeCounter(Counter):
    """Counts what merging leaves; the score is the sum of the tokens' scores, unknown characters' aside."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.scores = {p: s for p, s in pieces if p and not SPECIAL(p)}
        self.matches = ahocorasick.Automaton()
        for piece in self.scores:
            self.matches.add_word(piece, piece)
        self.matches.make_automaton()
        self.memo: dict[str, tuple[int, float]] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        # Characters that no longer piece holds part a text as blanks do.
        joint = {c for p in self.scores if len(p) > 1 for c in p} | {BLANK}
        lone = "".join(f"\\x{b:02x}" for b in range(128) if chr(b) not in joint)
        self.runs = re.compile(f"{BLANK}+[^{BLANK}{lone}]*|[^{BLANK}{lone}]+" + f"|[{lone}]" * bool(lone)).findall

    def parts(self, text: str) -> list[str]:
        return self.runs(BLANK + text.replace(" ", BLANK))

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves of a short text."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fit(self, left: str, right: str) -> bool:
        """Whether two neighbours stay as they are; of nothing and a piece, whether merges lead to the piece at all."""
        if len(self.fits) >= MEMO_PAIRS:
            self.fits.clear()
        got = self.fits[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return got

    def part(self, text: str) -> tuple[int, float]:
        n, fits, scores = len(text), self.fits.get, self.scores
        #: The last token of each prefix, the number of tokens and their score.
        last, count, score = [""] * (n + 1), [0] * (n + 1), [0.0] * (n + 1)
        done = 0
        for end, piece in self.matches.iter(text):
            if end < done:
                continue  # the last token that ends here is known
            while done < end:  # no piece fitted: the character has none
                self.unknown(text, done, last, count, score)
                done += 1
            begin = end + 1 - len(piece)
            left = last[begin]
            fit = fits((left, piece))
            if fit if fit is not None else self.fit(left, piece):
                done = end + 1
                last[done], count[done], score[done] = piece, count[begin] + 1, score[begin] + scores[piece]
        while done < n:
            self.unknown(text, done, last, count, score)
            done += 1
        return count[n], score[n]

    def unknown(self, text: str, at: int, last: list[str], count: list[int], score: list[float]) -> None:
        """A character that no piece covers is its bytes."""
        last[at + 1], score[at + 1] = text[at], score[at]
        count[at + 1] = count[at] + len(text[at].encode("utf-8", "surrogatepass"))


#: Pieces that stand for no text: controls and bytes.
SPECIAL = re.compile("<unk>|</?s>|<0x[0-9A-F]{2}>").fullmatch
WORDS = re.compile(f"{BLANK}[^{BLANK}]*").findall


def token_counts(docs: DataFrame, model_path: str, *, kind: str) -> DataFrame:
    """``doc_id, n_chars, n_tokens, best_score`` per row of ``docs``.

    ``kind`` says what the SentencePiece file holds: ``unigram`` or ``bpe``.
    ``n_chars`` are code points; ``best_score`` is the sum of the tokens' scores.
    """
    counters = {"unigram": UnigramCounter, "bpe": MergeCounter}
    pieces = vocabulary(model_path)  # read on the driver, so that no executor opens the file
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("best_score", pa.float64())])

    def run(batch: pa.RecordBatch, counter: Counter) -> pa.RecordBatch:
        texts = common.strings(batch.column(1))
        got = list(map(counter.count, texts))
        return common.record(schema, batch.column(0).cast(pa.int64()), list(map(len, texts)), [t for t, _ in got], [s for _, s in got])

    return common.arrow_map(common.pick(docs, "doc_id", "text"), run, "doc_id long, n_chars long, n_tokens long, best_score double", setup=lambda: counters[kind](pieces))
