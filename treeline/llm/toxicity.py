"""Operator 4: toxicity with noisy-channel deobfuscation.

1. A character trigram model is counted over every document (28 symbols, so the
   table is bounded whatever the corpus).
2. Disguised words are restored: a token that mixes letters with look-alike
   digits and signs, repeats letters or is spaced out becomes a lattice of the
   letters that it may stand for, and Viterbi takes the path of the highest
   channel and model score. Letters of other scripts that look like Latin ones
   and stand among them have two arcs. Plain tokens have a single path, themselves.
3. A logistic regression over words and word beginnings of the restored text is
   fitted on at most ``TRAIN_ROWS`` labelled rows outside the held-out fifth,
   chosen by hash, and scores every document. A text that holds a feature which
   nearly only toxic rows had scores at least that feature's share.

Labels, lang, source and doc_id are no inputs of a score. Documents are never
shuffled: counts are summed before they leave a task, the training rows are
picked by a broadcast of at most ``TRAIN_ROWS`` ids.

Defined cases: null and empty texts are scored as texts without words; without
labels of both kinds every score is the share of toxic rows (0 without rows) and
nothing is restored; several labels of a document count as toxic if any is;
repeated rows give equal rows; a null id is not held out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that fit the classifier, and features that it may weigh.
TRAIN_ROWS = 16_000
FEATURES = 3_000
MEMO_TOKENS = 200_000
#: Least hashes by which copies among the training rows are found.
SKETCHES = 4

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the model: 0 a word's edge, 1 to 26 letters, 27 any other letter.
SYMBOLS = 28
# What signs may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
# Letters of other scripts that look like a Latin one, each with it.
HOMOGLYPHS = dict(zip("авекмнорстухіѕјԁԛԝαεικνορτυχ", "abekmhopctyxisjdqwaeiknoptux", strict=True)) | {chr(0xFF41 + k): c for k, c in enumerate(LETTERS)}
#: Log costs of the channel: a look-alike, a letter said again, a sign put between letters, a look-alike put there, a sign that stands for itself.
ALIKE, AGAIN, BETWEEN, STRAY, ITSELF = -1.0, -1.2, -1.5, -9.0, -8.0
#: A feature must beat chance on the training rows by the logarithm of the number of features tried and so many nats more.
GAIN = 1.0
#: A feature of at least this share of toxic rows speaks for itself, whatever else a text holds.
PURE = 0.99

#: Letters that are words of the corpus' languages.
ALONE = "aeioyu"
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+€£])(?:[ .\-_*·]{1,2}(?:[^\W_]|[@$!|+€£])){2,}(?![^\W_])")
PLAIN = re.compile(r"[^\W\d_]+")
EDGE = re.compile(r"^[^\w@$!|+(€£¡§]+|[^\w@$|+€£§]+$|(?<=\w)([@$|+€£§!(])\1{2,}$")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
LETTER = re.compile(r"[^\W\d_]")
LATIN = re.compile("[a-z]")
GLYPH = re.compile(f"[{''.join(HOMOGLYPHS)}]")
WIDE = re.compile("[\uff41-\uff5a]")
#: One or two letters that are starred out.
MASKED = re.compile("([a-z]+)([*]{1,2})([a-z]+)")
DOUBLE = re.compile(r"([^\W\d_])\1+")
SIGNS = re.compile(f"[{re.escape(''.join(LOOKALIKES))}]{{3,12}}")
PARTS = re.compile(r"[^\W\d_]+")


def symbol_table() -> np.ndarray:
    """The model's symbol of each Latin-1 character."""
    return np.array([0 if not chr(c).isalpha() else LETTERS.index(chr(c).lower()) + 1 if chr(c).lower() in LETTERS else 27 for c in range(256)], np.int64)


TABLE = symbol_table()


def symbols(text: str) -> np.ndarray:
    """The symbols of a text, with an edge at either end; letters outside Latin-1 count as other letters."""
    # 0xFF is a letter, so what Latin-1 lacks is encoded as one if it is a letter, and as a blank if not.
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        data = "".join(c if c < "Ā" else "ÿ" if c.isalpha() else " " for c in text).encode("latin-1")
    return TABLE[np.frombuffer(b" " + data + b" ", np.uint8)]


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """How often each trigram of symbols occurs, over all documents and whole texts."""
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in common.strings(batch.column(0)):
                s = symbols(text)
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3) if len(s) > 2 else 0
        held = np.flatnonzero(total)
        yield common.record(schema, held.astype(np.int32), total[held])

    common.session(docs.sparkSession)
    rows = common.pick(docs, "text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(SYMBOLS**3)
    total[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return total.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_model(counts: np.ndarray) -> list:
    """Log probabilities of a symbol after two others, smoothed by those after one and after none."""
    one = counts.sum((0, 1)) + 1.0
    one /= one.sum()
    two = counts.sum(0) + 20 * one
    two /= two.sum(1, keepdims=True)
    three = counts + 20 * two[None]
    return np.log(three / three.sum(2, keepdims=True)).tolist()


def symbol(c: str) -> int:
    k = LETTERS.find(c)
    return k + 1 if k >= 0 else 27 if c.isalpha() else 0


def decode(token: str, model: list) -> str:
    """The most probable reading of a token: Viterbi over the last two symbols and the last sign read."""
    # A state: (symbol before, symbol, last letter) -> (score, letters so far).
    states: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
    for c in token:
        letter = c.isalpha()
        reads = [(c, 0.0), *([(HOMOGLYPHS[c], ALIKE)] if c in HOMOGLYPHS else [])] if letter else [(x, ALIKE) for x in LOOKALIKES.get(c, "")]
        step: dict[tuple[int, int, str], tuple[float, str]] = {}

        def offer(key: tuple[int, int, str], score: float, said: str, step=step) -> None:
            if key not in step or score > step[key][0]:
                step[key] = (score, said)

        for (a, b, last), (score, said) in states.items():
            for x, cost in reads:
                s = symbol(x)
                offer((b, s, x), score + cost + model[a][b][s], said + x)
                if x == last:
                    offer((a, b, last), score + cost + AGAIN, said)
            if not letter:
                offer((a, b, last), score + (STRAY if reads else BETWEEN), said)
                # It stands for itself: the word ends here and another begins.
                offer((b, 0, ""), score + ITSELF + (model[a][b][0] if b else 0.0), said + " " if b else said)
        states = step
    _, said = max(((s + (model[a][b][0] if b else 0.0), said) for (a, b, _), (s, said) in states.items()), default=(0.0, ""))
    return said


def disguised(token: str) -> bool:
    """Whether a token has more than one reading: look-alikes or signs among letters, or a letter three times."""
    if not token.isascii() and (WIDE.search(token) or GLYPH.search(token) and LATIN.search(token)):
        return True
    return not PLAIN.fullmatch(token) and LETTER.search(token) is not None or TRIPLE.search(token) is not None


def restore_token(token: str, model: list) -> str:
    token = EDGE.sub("", EDGE.sub("", token))
    return decode(token, model) if disguised(token) else token


def unspaced(text: str) -> str:
    """Spaced-out words closed up: 'i d i o t' becomes 'i.d.i.o.t', one token of the lattice.

    The first letter may be a word by itself, as in 'a c l o w n', so what
    follows it is a token of its own too.
    """

    def closed(m: re.Match) -> str:
        word = re.sub(r"[ .\-_*·]{1,2}", ".", m.group())
        return f"{word} {word[2:]}" if word.count(".") > 3 and word[0] in ALONE else word

    return SPACED.sub(closed, text)


def restore(text: str, model: list) -> str:
    """The text as it may have been meant, lower-cased, tokens parted by single blanks."""
    return " ".join(restore_token(t, model) for t in unspaced(text.lower()).split())


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return ["=" + word, *(word[:k] for k in range(4, min(9, len(word) + 1)))]


@dataclass
class Model:
    """A fitted classifier: weights of features, of the length, and the score of texts without any."""

    language: list
    numbers: dict[str, int]
    weights: np.ndarray
    #: Smoothed share of toxic rows among those with the feature, 0 if it isn't pure.
    shares: np.ndarray
    length: float
    bias: float


class Reader:
    """Reads texts with a model; remembers what tokens say."""

    def __init__(self, language: list, numbers: dict[str, int] | None):
        self.language, self.numbers, self.memo = language, numbers, {}

    def token(self, token: str) -> tuple:
        """What a token says: its features' numbers, or the features themselves if none are chosen yet."""
        words = PARTS.findall(restore_token(token, self.language))
        said = {f for w in words for f in features(w)}
        if self.numbers is None:
            return tuple(said)
        # Repeated letters and numbers are mostly meant as they stand; only a learned word, or a beginning of at least four letters, is read into them.
        for w in words:
            if DOUBLE.search(w):
                said.update(features(DOUBLE.sub(r"\1", w)))
        if SIGNS.fullmatch(token):
            said.update(f for w in PARTS.findall(decode(token, self.language)) for f in features(w))
        if m := MASKED.fullmatch(EDGE.sub("", token)):
            # Of all letters that may be meant, those count that give a learned word, or a beginning that has them.
            before, stars, after = m.groups()
            for filled in product(LETTERS, repeat=len(stars)):
                said.update(f for f in features(before + "".join(filled) + after) if len(f) > len(before) + len(stars) + f.startswith("="))
        return tuple(n for f in said if (n := self.numbers.get(f)) is not None)

    def text(self, text: str) -> tuple[set, int]:
        """The features of a text and how many tokens it has."""
        tokens = unspaced(text.lower()).split()
        memo, own = self.memo, set(tokens)
        if len(memo) > MEMO_TOKENS:
            memo.clear()
        for t in own:
            if t not in memo:
                memo[t] = self.token(t)
        return set().union(*filter(None, map(memo.__getitem__, own))), len(tokens)


def held_out(ids: list[int | None]) -> list[bool]:
    return [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``text, toxic`` of at most ``rows`` labelled documents outside the held-out fifth, chosen by hash, copies once."""
    known = common.pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    chosen = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    rows_ = common.settle(common.pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    # Copies would make any word of theirs look telling, so of texts that share a sketch one is learned from.
    schema = pa.schema([("doc_id", pa.int64()), *((f"m{k}", pa.int64()) for k in range(SKETCHES))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.stack([sketch(t) for t in common.strings(batch.column(1))])
        return common.record(schema, batch.column(0).cast(pa.int64()), *got.T)

    ddl = "doc_id long" + "".join(f", m{k} long" for k in range(SKETCHES))
    sketches = common.arrow_map(rows_.select("doc_id", "text"), run, ddl).toPandas().sort_values("doc_id").drop_duplicates("doc_id")
    for k in range(SKETCHES):
        sketches = sketches.drop_duplicates(f"m{k}")
    kept = docs.sparkSession.createDataFrame([(int(i),) for i in sketches["doc_id"]], "doc_id long")
    return rows_.dropDuplicates(["doc_id"]).join(F.broadcast(kept), "doc_id", "left_semi").select("text", "toxic")


def sketch(text: str) -> np.ndarray:
    """Least hashes of a text's runs of three tokens, as signed numbers: near copies share most of them."""
    t = text.lower().split()
    runs = [" ".join(t[k : k + 3]).encode("utf-8", "surrogatepass") for k in range(max(1, len(t) - 2))]
    h = np.fromiter(map(zlib.crc32, runs), np.uint64, len(runs)) * np.uint64(0x9E3779B97F4A7C15)
    return np.array([((h ^ (h >> np.uint64(29))) * np.uint64(2 * k + 0xBF58476D1CE4E5B9)).min() for k in range(SKETCHES)], np.uint64).view(np.int64)


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, size: int = FEATURES) -> Model:
    """Count the character model over all of ``docs``, then fit the classifier."""
    language = log_model(count_trigrams(docs))
    spark = docs.sparkSession
    train = common.settle(training_rows(docs, labels, rows))
    total, toxic = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < total:
        share = toxic / total if total else 0.0
        return Model(language, {}, np.zeros(0), np.zeros(0), 0.0, float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))
    held = spark.sparkContext.broadcast(language)
    pair = pa.schema([("feature", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])

    def tally(batch: pa.RecordBatch, reader: Reader) -> pa.RecordBatch:
        seen: dict[tuple[str, int], int] = {}
        for text, y in zip(common.strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            for f in reader.text(text)[0]:
                seen[f, y] = seen.get((f, y), 0) + 1
        return common.record(pair, [f for f, _ in seen], [y for _, y in seen], list(seen.values()))

    tallied = common.arrow_map(train, tally, "feature string, toxic int, n long", setup=lambda: Reader(held.value, None))
    by = common.settle(tallied.groupBy("feature").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("bad"), F.sum("n").alias("n")))
    least = GAIN + float(np.log(max(1, by.count())))
    by = by.where("bad >= 4")
    # Log-likelihood ratio of the feature's share of toxic rows against the share of all, for features that speak for toxic.
    rate = toxic / total
    gain = F.expr(f"bad * ln(bad / n / {rate}D) + if(n > bad, (n - bad) * ln((n - bad) / n / {1 - rate}D), 0)")
    ranked = by.withColumn("gain", F.round(gain, 6)).where((F.col("bad") > 1.5 * rate * F.col("n")) & (F.col("gain") >= least))
    chosen = ranked.orderBy(F.desc("gain"), "feature").limit(size).toPandas()
    numbers = {f: k for k, f in enumerate(distinct_features(chosen))}
    counted = chosen.set_index("feature").loc[list(numbers)]
    shares = ((counted["bad"] + rate) / (counted["n"] + 1)).to_numpy(float)
    shares[shares < PURE * (1 - 1 / (counted["n"].to_numpy(float) + 1))] = 0.0
    named = spark.sparkContext.broadcast(numbers)
    row = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("said", pa.list_(pa.int32()))])

    def featurize(batch: pa.RecordBatch, reader: Reader) -> pa.RecordBatch:
        got = [reader.text(t) for t in common.strings(batch.column(0))]
        return common.record(row, batch.column(1), [n for _, n in got], [sorted(s) for s, _ in got])

    rows_ = common.arrow_map(train, featurize, "toxic int, n long, said array<int>", setup=lambda: Reader(held.value, named.value)).toPandas()
    rows_ = rows_.assign(key=[(int(t), int(n), tuple(map(int, s))) for t, n, s in zip(rows_["toxic"], rows_["n"], rows_["said"])]).sort_values("key")
    weights, length, bias = logistic([np.asarray(s, np.int64) for s in rows_["said"]], rows_["n"].to_numpy(float), rows_["toxic"].to_numpy(float), len(numbers))
    return Model(language, numbers, weights, shares, length, bias)


def distinct_features(rows) -> list[str]:
    """Of beginnings that one another contain and occur in as many rows, the longest; a word only where it says more than its beginnings."""
    counts = {f: (b, n) for f, b, n in zip(rows["feature"], rows["bad"], rows["n"], strict=True)}
    same = lambda f, g: counts.get(f) == counts.get(g)
    longer = {g[:-1] for g in counts if g[0] != "=" and same(g[:-1], g)}
    return [f for f in counts if not (same(f, f[1:][:8]) if f[0] == "=" else f in longer)]


def logistic(said: list[np.ndarray], n: np.ndarray, y: np.ndarray, size: int, *, steps: int = 1500, decay: float = 1e-5) -> tuple[np.ndarray, float, float]:
    """L2-penalised logistic regression by Nesterov's accelerated gradient on all rows."""
    row = np.repeat(np.arange(len(said)), [len(s) for s in said])
    col = np.concatenate(said) if len(row) else np.zeros(0, np.int64)
    wide = np.log1p(n) / 4 - 1.5
    w = np.zeros(size + 2)
    v = w.copy()
    rate = 4.0 / max(4.0, np.mean([len(s) for s in said]) + 2)
    for k in range(steps):
        z = np.bincount(row, v[col], len(y)) + v[-2] * wide + v[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.concatenate((np.bincount(col, g[row], size), [g @ wide, g.sum()])) + decay * v * (np.arange(size + 2) < size)
        new = v - 4 * rate * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-2], float(w[-2]), float(w[-1])


def scores(texts: list[str], reader: Reader, model: Model) -> np.ndarray:
    out = np.zeros(len(texts))
    for k, text in enumerate(texts):
        said, n = reader.text(text)
        z = model.bias + model.length * (np.log1p(n) / 4 - 1.5) + (model.weights[list(said)].sum() if said else 0.0)
        out[k] = max(1 / (1 + np.exp(-np.clip(z, -30, 30))), model.shares[list(said)].max(initial=0.0))
    return out


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))

    def run(batch: pa.RecordBatch, reader: Reader) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        got = scores(common.strings(batch.column(1)), reader, held.value)
        return common.record(schema, batch.column(0).cast(pa.int64()), held_out(ids), got, (got >= 0.5).astype(np.int32))

    setup = lambda: Reader(held.value.language, held.value.numbers)
    return common.arrow_map(common.pick(docs, "doc_id", "text"), run, "doc_id long, held_out boolean, score double, predicted int", setup=setup)


def keep_clean(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, all columns as they were."""
    names, at = docs.columns, docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batch: pa.RecordBatch, reader: Reader) -> pa.RecordBatch:
        return batch.filter(pa.array(scores(common.strings(batch.column(at)), reader, held.value) < 0.5))

    return common.arrow_map(plain, run, plain.schema, setup=lambda: Reader(held.value.language, held.value.numbers)).toDF(*names)


def restored(docs: DataFrame) -> DataFrame:
    """``doc_id, restored string``: the texts as Viterbi reads them."""
    schema = pa.schema([("doc_id", pa.int64()), ("restored", pa.string())])
    held = docs.sparkSession.sparkContext.broadcast(log_model(count_trigrams(docs)))
    run = lambda batch: common.record(schema, batch.column(0).cast(pa.int64()), [restore(t, held.value) for t in common.strings(batch.column(1))])
    return common.arrow_map(common.pick(docs, "doc_id", "text"), run, "doc_id long, restored string")
