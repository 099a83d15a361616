"""A corpus pipeline over ``documents`` in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of documents; the last returns what its tokenizer makes of
each document. Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm import bpe, common, decontaminate, pii, simhash, toxicity
from treeline.llm.queries import tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents predicted toxic go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: contaminated documents go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: personal data becomes pseudonyms of the same format."""
    return pii.pseudonymize_rows(docs, pii.configured_key(spark))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token counts and digests of ids and decoded texts."""
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("bpe", tokenized),
]

#: Scores, fingerprints and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's rows are deleted when the next one's are written; those of the last but one are read by the result and stay."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        where = common.scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
        if last is not None:
            common.remove(spark, last)
        last = where
    return STAGES[-1][1](spark, docs, sf_dir)
