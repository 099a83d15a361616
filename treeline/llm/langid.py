"""Operator 5: language identification by the nearest of several centroids.

A text becomes a TF-IDF vector of hashed character 1-, 2- and 3-grams of its
lower-cased letters, scaled to length one. Each language has ``CENTROIDS``
centroids (spherical k-means over a bounded sample of its rows), and a text has
the language of the centroid of the greatest cosine. A text farther from it than
nearly all training texts of that centroid is marked as rejected.

Only text and lang of rows outside the held-out fifth are learned from: document
frequencies over all of them, summed in each task before they are shuffled;
centroids from about ``SAMPLE`` different texts a language, chosen by hash, for
every value of lang. The centroids are one file, written row by row and mapped
into memory by the workers, so their number is bounded by disk alone. lang, source
and doc_id are no inputs of a prediction. Texts are read whole and never shuffled: the sample's
rows become vectors first, and copies are one row before they meet.

Defined cases: null, empty and letterless texts are ``und`` with score 0, as is
every text if nothing can be learned; a language of a single text, however often
repeated, is learned from it; ties go to the language that sorts first; repeated
rows give equal rows; a null id is not held out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import held_out

BUCKETS = 1 << 13
CENTROIDS = 4
#: Different texts a language that its centroids are fitted on, about.
SAMPLE = 800
#: Languages whose rates of sampling are broadcast; those of more are joined by language.
BROADCAST = 100_000
#: Texts whose vectors are held at once.
BLOCK = 256
#: Of a centroid's training rows, the share that lies beyond its limit of distance.
BEYOND = 0.002

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each character is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams(text: str) -> np.ndarray | None:
    """How often each bucket's n-grams occur; None if the text has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[codes]
    if not letter.any():
        return None
    # What is no letter parts words; a run of it counts once.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, np.uint32(32))[keep]
    codes = np.pad(codes, (int(codes[0] != 32), int(codes[-1] != 32)), constant_values=32)
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[1:] * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + codes[2:] * np.uint32(0x165667B1)
    shift = np.uint32(33 - BUCKETS.bit_length())
    return np.bincount(np.concatenate((one >> shift, two >> shift, three >> shift)).astype(np.int64), minlength=BUCKETS)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    return v / max(float(np.sqrt(v @ v)), 1e-12)


@dataclass
class Model:
    """Centroids of length one by row, the language and the least cosine of each, and the weights of buckets."""

    idf: np.ndarray
    langs: list[str]
    #: An array, or the name of the file that Spark has handed to driver and executors.
    centroids: np.ndarray | str
    limits: np.ndarray

    def mapped(self) -> np.ndarray:
        if isinstance(self.centroids, str):
            self.centroids = np.memmap(SparkFiles.get(self.centroids), np.float32, "r", shape=(len(self.langs), BUCKETS))
        return self.centroids

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[bool]]:
        """Language, score and whether it is rejected, of each text."""
        parts = [self.block(texts[k : k + BLOCK]) for k in range(0, len(texts), BLOCK)]
        return [x for p in parts for x in p[0]], np.concatenate([np.zeros(0), *(p[1] for p in parts)]), [x for p in parts for x in p[2]]

    def block(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[bool]]:
        found = [grams(t) if t else None for t in texts]
        langs, scores, rejected = ["und"] * len(texts), np.zeros(len(texts)), [True] * len(texts)
        known = [k for k, g in enumerate(found) if g is not None]
        if known and len(self.langs):
            cosine = np.stack([vector(found[k], self.idf) for k in known]) @ self.mapped().T
            best = cosine.argmax(1)
            for k, b, c in zip(known, best.tolist(), cosine[np.arange(len(known)), best].tolist(), strict=True):
                langs[k], scores[k], rejected[k] = self.langs[b], min(1.0, max(0.0, c)), bool(c < self.limits[b])
        return langs, scores, rejected


def clusters(x: np.ndarray, k: int, rounds: int = 12, least: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids and the rows' places.

    It starts from rows at even steps of distance from the mean; a cluster of
    fewer than ``least`` of the rows is a few odd texts and goes.
    """
    mean = x.mean(0)
    order = np.argsort(-(x @ mean), kind="stable")
    c = x[order[np.linspace(0, 0.9 * (len(x) - 1), min(k, len(x))).astype(int)]].copy()
    own = (x @ c.T).argmax(1)
    for _ in range(rounds):
        held = [m for j in range(len(c)) if (m := own == j).sum() >= max(1, least * len(x))]
        c = np.stack([x[m].mean(0) for m in held] or [mean])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(1)
    return c, own


def learn(docs: DataFrame, *, centroids: int = CENTROIDS, sample: int = SAMPLE) -> Model:
    """Fit a model on ``docs(doc_id, text, lang)`` outside the held-out fifth."""
    rows = common.pick(docs, "doc_id", "text", "lang").where("lang is not null and text is not null and coalesce(crc32(cast(doc_id as string)) % 5, 1) <> 0")
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in common.strings(batch.column(0)):
                if (g := grams(text)) is not None:
                    df += g > 0
                    total += 1
        held = np.flatnonzero(df)
        yield common.record(schema, [*held.tolist(), -1], [*df[held].tolist(), total])

    spark = common.session(docs.sparkSession)
    counted = rows.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = int(counted.loc[counted["bucket"] < 0, "n"].sum())
    idf = np.zeros(BUCKETS, np.float32)
    if not total:
        return Model(idf, [], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    grown = counted[counted["bucket"] >= 0]
    idf[grown["bucket"].to_numpy(np.int64)] = np.log((1 + total) / (1 + grown["n"].to_numpy(float))) + 0.1
    # Different texts are counted, and drawn by their hash, so that copies crowd no other text out; the one of least hash is always drawn.
    lettered = rows.where(F.col("text").rlike(r"\p{L}"))
    known = lettered.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("h").alias("texts"), F.min("h").alias("least"))
    known = common.settle(known)
    if known.count() <= BROADCAST:
        near = lettered.join(F.broadcast(known), "lang")
    else:
        near = common.join_groups(lettered, known, "lang", "rows", total)
    drawn = (F.pmod("h", F.lit(1 << 20)) < F.lit(sample) / F.col("texts") * (1 << 20)) | (F.col("h") == F.col("least"))
    chosen = near.where(drawn).select("lang", "text", "h")
    held = spark.sparkContext.broadcast(idf)
    row = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("v", pa.binary())])

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        once = {(lang, h): text for lang, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
        got = [(lang, h, vector(g, held.value).tobytes()) for (lang, h), text in once.items() if (g := grams(text)) is not None]
        return common.record(row, *map(list, zip(*got, strict=True))) if got else None

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v, np.float32) for v in group.sort_values("h")["v"]])
        c, own = clusters(x, centroids)
        near = (x * c[own]).sum(1)
        used = [j for j in range(len(c)) if (own == j).any()]
        return pd.DataFrame({"lang": key[0], "centroid": [c[j].astype(np.float32).tobytes() for j in used], "edge": [float(np.quantile(near[own == j], BEYOND)) for j in used]})

    once = common.arrow_map(chosen, vectors, "lang string, h long, v binary").groupBy("lang", "h").agg(F.first("v").alias("v"))
    fitted = common.settle(once.groupBy("lang").applyInPandas(fit, "lang string, centroid binary, edge double"))
    langs: list[str] = []
    limits: list[float] = []

    def rows_of() -> Iterator[bytes]:
        for r in fitted.orderBy("lang", "centroid").toLocalIterator():
            langs.append(r.lang)
            limits.append(r.edge)
            yield bytes(r.centroid)

    return Model(idf, langs, common.publish(spark, "centroids", rows_of()), np.array(limits))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    held = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return common.record(schema, batch.column(0).cast(pa.int64()), held_out(batch.column(0).to_pylist()), *held.value.predict(common.strings(batch.column(1))))

    return common.arrow_map(common.pick(docs, "doc_id", "text"), run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
