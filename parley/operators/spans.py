"""Ordered views of a trace's spans; traces of any length are dealt over tasks by ``scan``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.scan import LIMIT, scan


def repeats(spans: DataFrame, trace: str, *same: str) -> DataFrame:
    """How often a span's kind and content occur in its trace; counted first, so copies are not sorted."""
    keys = (trace, *same)
    counted = spans.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.count("*").alias("repeat_count"))
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return spans.join(counted, cond).select(*spans.columns, "repeat_count")


def neighbours(spans: DataFrame, trace: str, order: list[str], kind: str, limit: int = LIMIT) -> DataFrame:
    return scan(spans, trace, order, limit).shift(previous=(kind, 1), next=(kind, -1)).done()


def around(spans: DataFrame, trace: str, order: list[str], kind: str, width: int = 2, limit: int = LIMIT) -> DataFrame:
    """The kinds of the spans up to ``width`` before and behind, in order."""
    beside = {f"_a{width - k}": (kind, k) for k in range(width, -width - 1, -1)}
    return scan(spans, trace, order, limit).shift(**beside).done().withColumn("around", F.array_compact(F.array(*beside))).drop(*beside)


def share_of(cost: str, whole: str) -> Column:
    return F.round(F.when(F.col(whole) > 0, 100 * F.col(cost) / F.col(whole)).otherwise(F.lit(0.0)), 4)


def cost_share(spans: DataFrame, trace: str, cost: str) -> DataFrame:
    """A span's cost in percent of its trace's; sums are joined back, so no trace is sorted or held."""
    sums = spans.groupBy(F.col(trace).alias("_trace")).agg(F.sum(cost).alias("_whole"))
    return spans.join(sums, F.col(trace).eqNullSafe(F.col("_trace"))).withColumn("cost_share", share_of(cost, "_whole")).drop("_trace", "_whole")


def positions(spans: DataFrame, trace: str, order: str, *same: str) -> DataFrame:
    """Rows (trace, same..., positions): one-based places of identical spans."""
    return spans.groupBy(trace, *same).agg(F.sort_array(F.collect_list(F.col(order) + 1)).alias("positions"))


def running(spans: DataFrame, trace: str, order: list[str], amount: str, base: Column | float = 0.0, limit: int = LIMIT) -> DataFrame:
    """What had accumulated before each span."""
    return scan(spans, trace, order, limit).before(_sum=amount).done().withColumn("running", F.round(F.coalesce("_sum", F.lit(0.0)) + base, 4)).drop("_sum")


def islands(spans: DataFrame, trace: str, order: list[str], same: list[str], sums: list[str], limit: int = LIMIT) -> DataFrame:
    """Adjacent equal spans as one row with their number and sums."""
    new = F.col("_place") == 1
    for i, c in enumerate(same):
        new = new | ~F.col(c).eqNullSafe(F.col(f"_before{i}"))
    beside = scan(spans, trace, order, limit).place("_place").shift(**{f"_before{i}": (c, 1) for i, c in enumerate(same)})
    marked = beside.then(lambda df: df.withColumn("_new", new.cast("int"))).before(_started="_new").done()
    marked = marked.withColumn("island", F.coalesce("_started", F.lit(0)) + F.col("_new"))
    return marked.groupBy(trace, "island", *same).agg(F.count("*").alias("n"), *[F.round(F.sum(c), 4).alias(c) for c in sums])


def trace_shape(spans: DataFrame, trace: str, order: str, role: str, text: str, user: str = "user") -> DataFrame:
    """One row per trace from one aggregation: turns, opening and closing facts, joined user texts."""
    mine = F.col(role) == user
    ordered = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(order, text)))), lambda x: x[text]), " ")
    return spans.groupBy(trace).agg(
        F.count("*").alias("spans"), F.count_if(mine).alias("turns"), F.max_by(role, order).alias("last_role"), F.min_by(text, order).alias("opening"),
        F.max_by(F.when(mine, F.col(text)), F.when(mine, F.col(order))).alias("last_user_text"), ordered(mine).alias("user_text"),
    )


def documents(spans: DataFrame, trace: str, order: str, kind: str, text: str, name: str | None = None, user: str = "user", speak: tuple[str, ...] = ("user", "assistant", "error")) -> DataFrame:
    """The four texts of a trace: retrieval, opening, intent and all user turns."""
    tool = F.concat(F.lit("tool "), F.col(name)) if name else F.lit(None).cast("string")
    ordered = lambda value: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v"))))), lambda x: x["v"]), " ")
    said, mine = F.when(F.col(kind).isin(*speak), F.col(text)), F.when(F.col(kind) == user, F.col(text))
    texts = spans.groupBy(trace).agg(
        F.min_by(text, order).alias("request"), ordered(F.coalesce(said, tool)).alias("said"), F.min_by(mine, F.when(mine.isNotNull(), F.col(order))).alias("opening"),
        ordered(F.coalesce(mine, tool)).alias("intent"), ordered(mine).alias("user_full"),
    )
    return texts.select(trace, F.concat_ws(" ", "request", "said").alias("document"), F.coalesce("opening", F.lit("")).alias("user_document"), F.col("intent").alias("intent_document"), F.col("user_full").alias("user_full_document"))


def derived_columns(spans: DataFrame) -> DataFrame:
    """Trace columns the ingest contract derives from spans."""
    kind, name = F.col("type"), F.col("name")
    call = (kind == "tool_call") & name.isNotNull()
    same = spans.where(call).groupBy("trace_id", "name", "content_redacted").agg(F.count("*").alias("n")).groupBy("trace_id").agg(F.max("n").alias("repeated_identical_calls"))
    own = spans.groupBy("trace_id").agg(
        F.count_if(kind == "user_message").alias("turns"), F.count_if(call).alias("tool_calls"), F.sort_array(F.collect_set(F.when(call, name))).alias("distinct_tools"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.sum("tokens_in").alias("tokens_input"), F.sum("tokens_out").alias("tokens_output"),
        F.greatest(F.coalesce(F.sum("duration_ms"), F.lit(0)), F.lit(400)).alias("duration_ms"), F.max_by("type", "idx").alias("last_span_type"),
        F.max("error_code").alias("error_code"), F.min_by("content_redacted", "idx").alias("user_request"),
    )
    own = own.withColumn("status", F.when(F.col("error_code").isNotNull(), "error").otherwise("ok")).withColumn("ended_by", F.when(F.col("last_span_type") == "error", "system").when(F.col("last_span_type") == "user_message", "user").otherwise("agent"))
    return own.join(same, "trace_id", "left").withColumn("repeated_identical_calls", F.coalesce("repeated_identical_calls", F.lit(0)))


def tool_bridge(spans: DataFrame) -> DataFrame:
    return spans.where((F.col("type") == "tool_call") & F.col("name").isNotNull()).groupBy("trace_id", F.col("name").alias("tool")).agg(F.count("*").alias("calls"))


def autopsy(traces: DataFrame, bridge: DataFrame, trace: str = "trace_id") -> DataFrame:
    """Rows (trace, autopsy): a conversation's opening, tools, size, cost, time and end in a few sentences.

    ``traces`` has the columns of ``derived_columns``; ``bridge`` has rows (trace, tool, calls).
    """
    called = bridge.groupBy(trace).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tool", "calls"))), lambda t: F.concat(t["tool"], F.lit(" x"), t["calls"].cast("string"))), ", ").alias("_tools"))
    tools = F.when(F.col("_tools").isNull(), F.lit("It called no tool.")).otherwise(F.concat(F.lit("It called "), F.col("_tools"), F.lit(".")))
    tokens = F.format_number((F.coalesce("tokens_input", F.lit(0)) + F.coalesce("tokens_output", F.lit(0))).cast("long"), 0)
    size = F.concat(F.lit("It took "), tokens, F.lit(" tokens, $"), F.format_string("%.4f", F.coalesce(F.col("cost_usd").cast("double"), F.lit(0.0))), F.lit(" and "), F.format_string("%.1f", F.coalesce("duration_ms", F.lit(0)) / 1000), F.lit(" seconds, and ended with the "), F.coalesce("ended_by", F.lit("unknown")), F.lit("."))
    opening = F.concat(F.lit("It opened with: “"), F.coalesce("user_request", F.lit("")), F.lit("”"))
    return traces.join(called, trace, "left").select(trace, F.concat_ws(" ", opening, tools, size).alias("autopsy"))


def explain(spans: DataFrame, trace: str, order: list[str], kind: str, cost: str, limit: int = LIMIT) -> DataFrame:
    """A sentence about each span: its place, its neighbours and its share of the cost."""
    counted = scan(spans.withColumn("_each", F.lit(1)), trace, order, limit).shift(previous=(kind, 1), next=(kind, -1)).place("place").whole(of="_each", _whole=cost)
    out = counted.done().withColumn("cost_share", share_of(cost, "_whole")).drop("_each", "_whole")
    after = F.when(F.col("previous").isNull(), F.lit("It opens the conversation")).otherwise(F.concat(F.lit("It follows a "), F.col("previous")))
    return out.withColumn("explanation", F.concat(F.lit("Step "), F.col("place").cast("string"), F.lit(" of "), F.col("of").cast("string"), F.lit(" is a "), F.col(kind), F.lit(". "), after, F.lit(" and holds "), F.format_string("%.1f", F.col("cost_share")), F.lit("% of its cost.")))
