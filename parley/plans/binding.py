"""Bindings: where the logical columns of a conversation live in a set of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import spans
from parley.plans.compiler import normalise
from parley.sources import tables


@dataclass
class Binding:
    """``traces`` has a row per conversation; ``columns`` maps logical names to its columns.

    ``bridge`` (id, tool) and ``span_table`` are optional; ``text`` is the column of a
    conversation's words.
    """

    traces: DataFrame
    columns: dict[str, Column] = field(default_factory=dict)
    bridge: DataFrame | None = None
    span_table: DataFrame | None = None
    text: str | None = None
    #: Words of one party of each conversation (id, text), by ``user`` or ``assistant``.
    said: Callable[[str], DataFrame | None] | None = None

    def get(self, name: str) -> Column:
        if name in self.columns:
            return self.columns[name]
        if name in self.traces.columns:
            return F.col(name)
        raise KeyError(f"this binding has no {name}")

    def has(self, build: Callable[[Callable[[str], Column]], Column] | None) -> bool:
        try:
            build is None or build(self.get)
        except KeyError:
            return False
        return True

    def catalogue(self, fields: tuple[str, ...] = ("app", "model", "error_code")) -> DataFrame:
        """Rows (field, value): the distinct non-empty values of each field, and the tools, from one scan each."""
        have = [f for f in fields if self.has(lambda get, f=f: get(f))]
        kind = "array<struct<field:string,value:string>>"
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), self.get(f).cast("string").alias("value")) for f in have]) if have else F.array()
        out = self.traces.select(F.inline(pairs.cast(kind)))
        if self.bridge is not None:
            out = out.unionByName(self.bridge.select(F.lit("tool").alias("field"), F.col("tool").cast("string").alias("value")))
        return out.where(F.col("value").isNotNull() & (F.col("value") != "")).distinct()

    def named(self, question: str, fields: tuple[str, ...] = ("app", "model", "error_code")) -> dict[str, list[str]]:
        return named(phrased(self.catalogue(fields)), question)


def phrased(catalogue: DataFrame) -> DataFrame:
    """Rows (field, value, phrase): how a question would write each value."""

    def run(batches):
        for batch in batches:
            yield batch.append_column("phrase", pa.array([normalise(v) for v in batch.column("value").to_pylist()], pa.string()))

    return catalogue.select("field", "value").mapInArrow(run, "field string, value string, phrase string")


def named(values: DataFrame, question: str) -> dict[str, list[str]]:
    """The values that a question's own words may name, however many there are in all.

    ``values`` has rows (field, value, phrase). Only those whose phrase is in the question
    come to the driver: a question of at most 400 characters holds a bounded number.
    """
    text = F.lit(normalise(question))
    out: dict[str, list[str]] = {}
    for r in values.where((F.length("phrase") >= 4) & F.contains(text, F.col("phrase"))).orderBy("field", "value").collect():
        out.setdefault(r.field, []).append(r.value)
    return out


def orders(spark: SparkSession, folder: str) -> Binding:
    """Orders as conversations: segment, status and priority are app, outcome and failure mode; parts' brands are tools."""
    customer = tables.read(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    rows = tables.read(spark, folder, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    line = tables.read(spark, folder, "lineitem")
    part = tables.read(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("tool"))
    bridge = line.select(F.col("l_orderkey").alias("id"), "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("id", "tool").agg(F.count("*").alias("calls"))
    names = {"id": "o_orderkey", "app": "c_mktsegment", "outcome": "o_orderstatus", "failure_mode": "o_orderpriority", "cost_usd": "o_totalprice", "started_at": "o_orderdate"}
    return Binding(rows, {k: F.col(v) for k, v in names.items()}, bridge, line)


#: Recorded facts that ``facts`` derives from an order's number: column, divisor of the number, values in turn.
RECORDED = (
    ("outcome", 1, ("resolved", "abandoned", "hallucination", "unmet request", "contradiction", "resolved", None)),
    ("failure_mode", 3, ("none", "none", "tool_loop", "wrong_answer", "hallucinated_tool", "refusal", "timeout", "context_overflow", "provider_error", "tool_error", None)),
    ("sentiment_end", 2, ("positive", "neutral", "frustrated", "angry", None)),
    ("intent_satisfied", 5, ("yes", "no", "unclear", None)),
    ("gave_up", 7, ("yes", "no", "no")),
    ("capture_completeness", 11, ("complete", "complete", "partial")),
    ("guardrail_status", 13, ("passed", "blocked", "passed", None)),
    ("model", 17, ("model-a", "model-b", "model-c")),
    ("provider", 19, ("north", "south")),
    ("error_code", 23, (None, "rate_limit_429", "timeout_504")),
    ("turn_word", 29, ("1", "2", "3", "4", "5", "6")),
)


def facts(spark: SparkSession, folder: str) -> Binding:
    """Orders as fully recorded conversations: every logical column, from the order's own number."""
    base = orders(spark, folder)
    turn = lambda div, values: F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.floor(F.col("o_orderkey") / (4 * div)), F.lit(len(values))).cast("int"))
    rows = base.traces.withColumns({name: turn(div, values) for name, div, values in RECORDED})
    names = {"id": "o_orderkey", "app": "c_mktsegment", "cost_usd": "o_totalprice", "started_at": "o_orderdate", **{n: n for n, _, _ in RECORDED}}
    columns = {k: F.col(v) for k, v in names.items()} | {"user_gave_up": F.col("gave_up") == "yes", "turns": F.col("turn_word").cast("int"), "intent_key": F.col("o_orderpriority"), "status": F.when(F.col("error_code").isNull(), "ok").otherwise("error")}
    return Binding(rows, columns, base.bridge, base.span_table)


def _said(messages: DataFrame, trace: str, order: str, kind: str, text: str, who: str) -> DataFrame:
    own = messages.where(F.col(kind) == who).groupBy(F.col(trace).alias("id")).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("m"))
    return own.select(F.col("id").cast("string").alias("id"), F.array_join(F.transform("m", lambda m: m[text]), " ").alias("text"))


def conversations(spark: SparkSession, folder: str) -> Binding:
    messages = tables.read(spark, folder, "conversations")
    shape = spans.trace_shape(messages, "conv_id", "turn", "role", "text").withColumnRenamed("spans", "n_spans")
    return Binding(shape, {"id": F.col("conv_id"), "ended_by": F.col("last_role"), "cost_usd": F.length("user_text").cast("double"), "tool_calls": F.col("n_spans")}, None, messages, "user_text", lambda who: _said(messages, "conv_id", "turn", "role", "text", who))


def events(spark: SparkSession, folder: str) -> Binding:
    rows = tables.read(spark, folder, "events")
    return Binding(rows, {"id": F.col("event_id"), "app": F.col("event_type"), "cost_usd": F.col("value"), "started_at": F.col("ts")})


def documents(spark: SparkSession, folder: str) -> Binding:
    rows = tables.read(spark, folder, "documents")
    return Binding(rows, {"id": F.col("doc_id"), "app": F.col("source"), "model": F.col("lang"), "tokens_input": F.col("n_chars"), "tokens_output": F.lit(0)}, None, None, "text")


def generated(traces: DataFrame, span_rows: DataFrame) -> Binding:
    """Generated traces with the columns their spans give them."""
    facts = traces.join(spans.derived_columns(span_rows), "trace_id")
    bridge = spans.tool_bridge(span_rows).withColumnRenamed("trace_id", "id")
    return Binding(facts, {"id": F.col("trace_id"), "user_gave_up": F.col("kind") == "loop", "rephrase_count": F.greatest(F.col("turns") - 1, F.lit(0))}, bridge, span_rows, "ask", lambda who: _said(span_rows, "trace_id", "idx", "type", "content_redacted", f"{who}_message"))
