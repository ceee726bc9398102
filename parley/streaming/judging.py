"""Judging a stream of conversations against the statistics of a corpus, not of the batch they came in.

A version fixes what a row's score depends on: document frequencies, and the question's
terms. Under one version a score is a function of the row alone. Each batch leaves, under
its own id, its rows' term counts and scores, its document frequencies, and the moments
and top scores that the cut needs; a batch that is run again overwrites its own part. The
cut is taken from the moments of all batches when values are read, so every row is
measured by one cut and the order of batches does not matter: scores have six decimals
and are added up as decimals, exactly.

``refresh`` makes a new version: frequencies of the corpus and of all batches are added
up, and the stored term counts are scored again; no text is read twice.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.functions import text as tx
from parley.operators import judge, select
from parley.sources.tables import held

#: Greatest scores that a batch hands on: the cut needs the mean of three.
TOP = 3


class StreamJudge:
    """One question over a corpus and what streams in; ``folder`` is shared storage that belongs to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def begin(cls, folder: str, question: str, corpus: judge.Index) -> StreamJudge:
        """Starts with a corpus, which is batch -1, and the question widened on it."""
        self = cls(corpus.docs.sparkSession, folder)
        counts = held(tx.term_counts(corpus.docs, "id", "text", stems=True), "counts")
        self._fix(0, question, tx.counted_frequencies(counts), corpus.docs.count(), counts)
        self._keep(0, -1, corpus.docs, counts)
        return self

    # -- versions ---------------------------------------------------------------

    def _fix(self, version: int, question: str, df: DataFrame, n: int, counts: DataFrame) -> None:
        """Writes a version: its vocabulary, and the question's terms, widened on the rows at hand."""
        vocab = held(tx.vocabulary(df, F.lit(n)), "vocabulary")
        rows = held(tx.weighted_rows(counts, vocab, vocab.count()), "rows")
        asked = judge.analyse(question, vocab)
        near = judge.nearest_terms(rows, asked.weights)
        gate = sorted({*asked.gate, *[t for t in near if t not in asked.weights]})
        first = held(judge.score(judge.with_any(rows, near), rows.select("id"), near, gate), "scores")
        wider = judge.expand(first, rows, near)
        vocab.write.mode("overwrite").parquet(f"{self.folder}/vocabulary/version={version}")
        about = {"question": question, "negated": asked.negated, "weights": wider, "gate": sorted({*gate, *[t for t in wider if t not in near]})}
        self.spark.createDataFrame([(version, json.dumps(about, sort_keys=True))], "number int, about string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/version={version}")

    def current(self) -> tuple[int, dict]:
        row = self.spark.read.parquet(f"{self.folder}/versions").orderBy(F.desc("number")).first()
        return row.number, json.loads(row.about)

    def refresh(self) -> int:
        """A new version from the frequencies of all batches; their rows are scored again from their term counts."""
        version, about = self.current()
        counts = self.spark.read.parquet(f"{self.folder}/counts")
        df = self.spark.read.parquet(f"{self.folder}/frequencies").groupBy("token").agg(F.sum("df").alias("df"))
        self._fix(version + 1, about["question"], held(df, "frequencies"), counts.count(), counts.select("id", "terms", "counts"))
        texts = self.spark.read.parquet(f"{self.folder}/texts")
        for batch in sorted(r.batch for r in counts.select("batch").distinct().collect()):  # as many as there were batches
            self._score(version + 1, batch, texts.where(F.col("batch") == batch).select("id", "text"), counts.where(F.col("batch") == batch).select("id", "terms", "counts"))
        return version + 1

    # -- batches ----------------------------------------------------------------

    def _write(self, df: DataFrame, what: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{what}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _keep(self, version: int, batch: int, docs: DataFrame, counts: DataFrame) -> None:
        docs = self._write(docs.select("id", F.coalesce("text", F.lit("")).alias("text")), "texts", batch)
        counts = self._write(counts, "counts", batch)
        self._write(tx.counted_frequencies(counts), "frequencies", batch)
        self._score(version, batch, docs, counts)

    def _score(self, version: int, batch: int, docs: DataFrame, counts: DataFrame) -> None:
        _, about = self.current()
        vocab = self.spark.read.parquet(f"{self.folder}/vocabulary/version={version}")
        rows = tx.weighted_rows(counts, vocab, vocab.count())
        found = judge.score(judge.with_any(rows, about["weights"]), docs.select("id"), about["weights"], about["gate"]).join(judge.evidence(docs, about["weights"]), "id")
        scores = self._write(found, f"scores/version={version}", batch)
        s = F.col("score").cast("decimal(12,6)")
        top = F.array(*[F.lit(r.score) for r in scores.orderBy(F.desc("score")).limit(TOP).collect()]).cast("array<double>")
        self._write(scores.agg(F.count("*").alias("n"), F.coalesce(F.sum(s), F.lit(0)).cast("decimal(38,6)").alias("total"), F.coalesce(F.sum(s * s), F.lit(0)).cast("decimal(38,12)").alias("squares")).withColumn("top", top), f"moments/version={version}", batch)

    def batch(self, rows: DataFrame, batch: int) -> None:
        """Judges the rows (id, text) of a batch under the current version; a repeated batch id replaces its own rows."""
        docs = held(rows.select("id", "text"), "batch")
        self._keep(self.current()[0], batch, docs, tx.term_counts(docs.withColumn("text", F.coalesce("text", F.lit(""))), "id", "text", stems=True))

    def run(self, docs: DataFrame, checkpoint: str) -> StreamingQuery:
        return docs.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    # -- values -----------------------------------------------------------------

    def scores(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/scores/version={self.current()[0]}").select("id", "score", "quote")

    def cut(self) -> tuple[float, float]:
        """The cut and the spread that ``judge.cut`` gives for all scores, from the moments of the batches."""
        moments = self.spark.read.parquet(f"{self.folder}/moments/version={self.current()[0]}")
        n, total, squares = moments.agg(F.sum("n"), F.sum("total"), F.sum("squares")).first()
        top = [r.x for r in moments.select(F.explode("top").alias("x")).orderBy(F.desc("x")).limit(TOP).collect()]
        if not n or not top or top[0] <= 0:
            return math.inf, 0.0
        mean = float(total) / n
        spread = math.sqrt(max(float(squares * n - total * total), 0.0)) / n
        at = max(0.20 * sum(top) / len(top), 0.02, mean + 2 * spread)
        scores = self.scores()
        if scores.where(F.col("score") >= at).count() > 0.5 * n:
            at = max(at, select.percentile(scores, "score", 0.5))
        return at, spread

    def values(self) -> DataFrame:
        """Rows (id, score, value, confidence, quote) of the corpus and everything that came in."""
        scores = self.scores()
        return judge.verdicts(scores, *self.cut(), self.current()[1]["negated"]).join(scores.select("id", "quote"), "id")
