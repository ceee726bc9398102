"""Deterministic synthetic traces and spans: each value is a hash of its row and the seed.

No ``rand()``: the same seed gives the same rows however they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

APPS = ("support desk", "travel planner", "code helper", "billing agent", "shop assistant")
WEIGHTS = (2.4, 1.8, 1.4, 1.2, 1.2)
TOOLS = ("search", "lookup_order", "send_mail", "calendar", "refund")
#: kind -> (outcome, failure mode, satisfied, sentiment)
EPISODES = {
    "solved": ("resolved", "none", "yes", "positive"), "partial": ("partial", "none", "unclear", "neutral"), "loop": ("abandoned", "tool_loop", "no", "frustrated"),
    "refused": ("refused", "refusal", "no", "angry"), "wrong": ("resolved", "wrong_answer", "no", "frustrated"), "upstream": ("error", "provider_error", "no", "frustrated"),
}
ASKS = ("Where is my {thing}?", "Please change the date of my {thing}.", "Why was I charged twice for the {thing}?", "Can you explain this {thing} to me?")
THINGS = ("order", "flight", "invoice", "subscription", "booking")


def unit(*key: Column, seed: int, tag: str) -> Column:
    """A number in [0, 1) that depends on the key, the seed and the tag alone."""
    return F.pmod(F.xxhash64(*key, F.lit(seed), F.lit(tag)), F.lit(1 << 30)) / float(1 << 30)


def pick(values: tuple, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.floor(at * len(values)).cast("int"))


def weighted(values: tuple, weights: tuple, at: Column) -> Column:
    total, so_far = sum(weights), 0.0
    out = F.lit(values[-1])
    steps = []
    for v, w in zip(values, weights):
        so_far += w / total
        steps.append((v, so_far))
    for v, edge in reversed(steps[:-1]):
        out = F.when(at < edge, F.lit(v)).otherwise(out)
    return out


def fill(template: Column, slots: dict[str, Column]) -> Column:
    """``{slot}`` replaced by each slot's value."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def traces(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Episode facts of n traces, before spans."""
    id_ = F.col("id")
    u = lambda tag: unit(id_, seed=seed, tag=tag)
    kinds = tuple(EPISODES)
    rows = spark.range(n).select(
        F.format_string("tr-%08d", id_).alias("trace_id"), id_.alias("n"), weighted(APPS, WEIGHTS, u("app")).alias("app"),
        F.when(u("error") < 0.035, F.lit("upstream")).otherwise(pick(kinds[:-1], u("kind"))).alias("kind"), pick(("model-a", "model-b"), u("model")).alias("model"),
        fill(pick(ASKS, u("ask")), {"thing": pick(THINGS, u("thing"))}).alias("ask"), (1 + F.floor(u("turns") * 4)).cast("int").alias("user_turns"), pick(TOOLS, u("tool")).alias("tool"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(u("time") * 30 * 86400).cast("long")).alias("started_at"), ((id_ % 113) != 0).alias("complete"),
    )
    facts = F.create_map(*[x for k, v in EPISODES.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    rows = rows.withColumn("_f", facts[F.col("kind")])
    for i, c in enumerate(("outcome", "failure_mode", "intent_satisfied", "sentiment_end")):
        rows = rows.withColumn(c, F.get("_f", F.lit(i)))
    return rows.withColumn("capture_completeness", F.when(F.col("complete"), "complete").otherwise("partial")).drop("_f", "complete")


def spans(of: DataFrame, seed: int = 42) -> DataFrame:
    """Ordered spans of generated traces: each turn is an ask, tool calls and an answer; the last may be an error."""
    turn = F.struct
    loop = F.when(F.col("kind") == "loop", 3).otherwise(1)
    steps = F.flatten(F.transform(F.sequence(F.lit(1), F.col("user_turns")), lambda t: F.concat(
        F.array(turn(F.lit("user_message").alias("type"), F.lit(None).cast("string").alias("name"), F.when(t == 1, F.col("ask")).otherwise(F.concat(F.lit("Again: "), F.col("ask"))).alias("content"))),
        F.flatten(F.array_repeat(F.array(
            turn(F.lit("tool_call").alias("type"), F.col("tool").alias("name"), F.concat(F.col("tool"), F.lit("()")).alias("content")),
            turn(F.lit("tool_result").alias("type"), F.col("tool").alias("name"), F.lit("ok").alias("content")),
        ), loop)),
        F.array(turn(F.lit("assistant_message").alias("type"), F.lit(None).cast("string").alias("name"), F.lit("Here is what I found.").alias("content"))),
    )))
    error = F.array(turn(F.lit("error").alias("type"), F.lit(None).cast("string").alias("name"), F.lit("upstream failed").alias("content")))
    flat = of.select("trace_id", F.posexplode(F.when(F.col("kind") == "upstream", F.concat(steps, error)).otherwise(steps)).alias("idx", "s"))
    u = lambda tag: unit(F.col("trace_id"), F.col("idx"), seed=seed, tag=tag)
    text = F.col("s.content")
    spoken = F.col("s.type").isin("assistant_message", "tool_call")
    return flat.select(
        F.concat_ws("-", "trace_id", F.col("idx").cast("string")).alias("id"), "trace_id", "idx", F.col("s.type").alias("type"), F.col("s.name").alias("name"),
        F.when(F.col("s.type").isin("user_message", "assistant_message"), (200 + F.floor(u("ms") * 2000)).cast("long")).alias("duration_ms"), F.when(spoken, F.length(text)).otherwise(0).cast("long").alias("tokens_in"),
        F.when(F.col("s.type") == "assistant_message", F.length(text)).otherwise(0).cast("long").alias("tokens_out"), F.when(spoken, F.round(0.0001 + u("cost") * 0.01, 6)).otherwise(0.0).alias("cost_usd"),
        F.when(F.col("s.type") == "error", "error").otherwise("ok").alias("status"), text.alias("content_redacted"), F.when(F.col("s.type") == "error", F.lit("provider_model_overloaded_529")).alias("error_code"),
    )
