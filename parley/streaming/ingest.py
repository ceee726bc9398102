"""Structured Streaming: new conversations through saved questions, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators.aspects import Aspects, Judge, local_judge


def read(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tumbling(events: DataFrame, ts: str = "ts", group: str = "event_type", value: str = "value", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum by window and group; in a stream, rows later than ``late`` behind the newest are dropped."""
    base = events.withColumn(ts, F.col(ts).cast("timestamp"))
    base = base.withWatermark(ts, late) if events.isStreaming else base
    return base.groupBy(F.window(ts, width).alias("w"), group).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), group, "n", "total")


def sliding(events: DataFrame, width: str, step: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    base = events.withColumn(ts, F.col(ts).cast("timestamp"))
    base = base.withWatermark(ts, late) if events.isStreaming else base
    return base.groupBy(F.window(ts, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", user: str = "user_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Runs of one user's events without a longer gap."""
    base = events.withColumn(ts, F.col(ts).cast("timestamp"))
    base = base.withWatermark(ts, late) if events.isStreaming else base
    return base.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def judge_stream(docs: DataFrame, aspects: Aspects, ids: list[str], checkpoint: str, by: Judge = local_judge) -> StreamingQuery:
    """Judges each micro-batch of (id, text) for saved questions; values are keyed, so a repeated batch adds nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        for aspect in ids:
            aspects.evaluate(aspect, rows.select("id", "text"), by)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
