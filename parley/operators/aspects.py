"""Reusable questions and their stored values: catalogue, versions, incremental evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import scalar
from parley.operators import aggregate, joins, judge
from parley.sources import remote
from parley.sources.tables import Store, held

ASPECT = "id string, question string, type string, labels array<string>, version int"
VALUE = "id string, aspect_id string, value_json string, confidence double, score double, evidence_quote string, status string, cost double"
#: docs (id, text), question -> rows (id, score, value, confidence, quote), with cost and status where the judge gives them
Judge = Callable[[DataFrame, str], DataFrame]


def local_judge(docs: DataFrame | judge.Index, question: str, scoped: Callable[[str], DataFrame | None] | None = None) -> DataFrame:
    return judge.judge(docs, question, scoped)[0]


class Aspects:
    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def catalogue(self) -> DataFrame:
        return self.store.table("aspects") if self.store.exists("aspects") else self.spark.createDataFrame([], ASPECT)

    def values(self) -> DataFrame:
        return self.store.table("aspect_values") if self.store.exists("aspect_values") else self.spark.createDataFrame([], VALUE)

    def ensure(self, question: str, kind: str = "boolean", labels: list[str] | None = None, replaces: str | None = None) -> str:
        """The id of this question; an equal one is reused, a changed one is a new version that keeps its labels."""
        known = self.catalogue().where((F.col("question") == question) & (F.col("type") == kind)).orderBy(F.desc("version")).first()
        if known:
            return known.id
        old = self.catalogue().where(F.col("id") == replaces).first() if replaces else None
        version = old.version + 1 if old else 1
        number = self.catalogue().count() + 1
        row = (f"aspect-{number:06d}", question, kind, labels or (old.labels if old else []), version)
        self.store.append("aspects", self.spark.createDataFrame([row], ASPECT))
        return row[0]

    def evaluate(self, aspect_id: str, docs: DataFrame, by: Judge | None = None, scoped: Callable[[str], DataFrame | None] | None = None, budget: float | None = None, index: Callable[[], judge.Index] | None = None) -> DataFrame:
        """Judges ``docs`` as soon as one of them has no value yet; a repeated call finds nothing to do.

        The local judge cuts the scores of a whole corpus, so it judges all of ``docs`` anew,
        and values never come from two cuts. A judge of single rows (``by``) gets only the
        rows that have no value. If it stops, what it has judged is stored before
        ``BudgetExceeded`` or ``ProviderUnavailable`` is raised; ``budget`` bounds what all
        judgments may have cost when a call begins. ``index`` gives the local judge an index of ``docs``, ids as text.
        """
        question = self.catalogue().where(F.col("id") == aspect_id).first().question
        text = docs.select(F.col("id").cast("string").alias("id"), "text")
        left = joins.pending(text, self.of(aspect_id), "id")
        if not left.isEmpty():
            if by and budget is not None and self.spent() >= budget:
                raise remote.BudgetExceeded(f"the budget of {budget} is spent")
            judged = held(by(left, question), "judged") if by else local_judge(index() if index else text, question, scoped)
            stopped = []
            if "status" in judged.columns:
                stopped = [r.status for r in judged.where(F.col("status") != remote.COMPLETE).select("status").distinct().collect()]  # two reasons at most
                judged = judged.where(F.col("status") == remote.COMPLETE).drop("status")
            judged = judged if "cost" in judged.columns else judged.withColumn("cost", F.lit(0.0))
            new = judged.select("id", F.lit(aspect_id).alias("aspect_id"), F.to_json(F.struct("value")).alias("j"), "confidence", "score", F.col("quote").alias("evidence_quote"), F.lit("complete").alias("status"), "cost")
            new = new.withColumn("value_json", F.get_json_object("j", "$.value")).drop("j")
            if self.store.exists("aspect_values"):
                self.store.migrate("aspect_values", {"cost": 0.0})  # values of stores written before costs were kept
            self.store.upsert("aspect_values", new.select("id", "aspect_id", "value_json", "confidence", "score", "evidence_quote", "status", "cost"), ["id", "aspect_id"])
            if remote.BUDGET in stopped:
                raise remote.BudgetExceeded("the judge may spend no more")
            if stopped:
                raise remote.ProviderUnavailable("the judge's provider failed")
        return self.of(aspect_id)

    def spent(self) -> float:
        """What all stored judgments have cost."""
        values = self.values()
        return 0.0 if "cost" not in values.columns else float(values.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0])

    def of(self, aspect_id: str) -> DataFrame:
        return self.values().where(F.col("aspect_id") == aspect_id)

    def groups(self, aspect_id: str, eligible: DataFrame) -> DataFrame:
        """Grouped answer over complete values of eligible rows, yes before no."""
        rows = joins.members(self.of(aspect_id).where("status = 'complete'"), eligible.select(F.col("id").cast("string").alias("id")), "id")
        keyed = rows.select("id", scalar.aspect_key(F.col("value_json")).alias("group_key"), scalar.aspect_value(F.col("value_json")).alias("value"))
        return aggregate.yes_first(aggregate.grouped(keyed))

    def verification(self, aspect_id: str, per: int = 5) -> DataFrame:
        return judge.sample(self.of(aspect_id).withColumnRenamed("value_json", "value"), per)

    def usage(self) -> DataFrame:
        """Every aspect with its number of complete values."""
        return joins.child_counts(self.catalogue().withColumnRenamed("id", "aspect_id"), self.values(), "aspect_id", F.col("status") == "complete", "n_values")

    def wide(self, ids: list[str]) -> DataFrame:
        """One row per conversation and a column per aspect."""
        return self.values().where(F.col("aspect_id").isin(ids)).groupBy("id").pivot("aspect_id", ids).agg(F.first("value_json"))
