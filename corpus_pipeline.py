"""From raw documents to token statistics: five stages, each over all that the last one kept.

1. toxicity: documents that score 0.5 or more go.
2. simhash: of each near-duplicate component the document of least id stays.
3. decontaminate: documents that hold a benchmark window go.
4. pii: personal data in the texts is replaced by its kind; every document stays.
5. bpe: texts are encoded and decoded again; the result has ids' count and digests.

Each stage's result is written as Parquet in the shared folder and read again, so
a stage never recomputes the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bpe, decontam, pii, simhash, toxicity
from parley.llm.queries import tokenizer_path
from parley.llm.store import Staged, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return toxicity.keep_civil(spark, docs, labels.where(~toxicity.held_out(F.col("doc_id"))))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_rows(spark, docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pii.redact(spark, docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else done


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_copies),
    ("decontaminate", without_benchmark),
    ("pii", without_personal_data),
    ("bpe", as_tokens),
]

#: The classifier, the fingerprints' hash and the encoder are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        new = Staged(spark, stage(spark, docs, sf_dir), name)
        if last:
            last.drop()  # the new table is complete and no longer reads it
        docs, last = new.df, new
    return STAGES[-1][1](spark, docs, sf_dir)
