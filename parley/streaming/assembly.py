"""Conversations put together from a stream of their spans, in any order and with repeats.

A conversation's spans are kept as state until it is whole: its last span is there and
every place from 0 up to it. It then goes out as its rows, all in one micro-batch, so any
batch operator can run over them. A conversation without a new span for ``gap`` of event
time goes out as it is, marked incomplete. State is keyed by conversation and lies in
RocksDB, so it may be larger than memory and outlives executors.

Repeats of a place are dropped (the first to come stays), also those behind a whole
conversation for as long as ``gap`` lasts. Spans behind the watermark are dropped by
Spark, as in any stream; one that comes after its conversation timed out opens it anew.
Spans without conversation or time belong to none (``unplaced`` gives them). A span
without a place goes out with its conversation and counts for nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StructType

from parley.operators.spans import derived_columns
from parley.sources.tables import held

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FACTS = "n long, last long, newest long, whole boolean"


class Assembly(StatefulProcessor):
    """State of one conversation: its spans, and (spans kept, last place if known, newest time, whether it went out whole)."""

    def __init__(self, schema: StructType, place: str, gap_ms: int):
        self.schema, self.place, self.gap = schema, place, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", self.schema)
        self.facts = handle.getValueState("facts", FACTS)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, last, newest, whole = self.facts.get() if self.facts.exists() else (0, None, None, False)
        if whole:
            return
        fresh, before = [], newest
        for row in rows:
            fresh.append(tuple(row[c] for c in self.schema.names))
            newest = row["_ms"] if newest is None else max(newest, row["_ms"])
            if row["_last"] and row[self.place] is not None:
                last = row[self.place] if last is None else max(last, row[self.place])
        self.spans.appendList(fresh)
        n += len(fresh)
        if last is not None and n > last:
            once = list(self._once())
            places = {row[self.place] for row in once}
            whole, n = all(p in places for p in range(last + 1)), len(once)
            if whole:
                self.spans.clear()
                yield from self._shown(once, False)
            else:
                self.spans.put([tuple(row) for row in once])
        self.facts.update((n, last, newest, whole))
        if newest != before:
            if before is not None:
                self.handle.deleteTimer(before + self.gap)
            self.handle.registerTimer(newest + self.gap)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.facts.get()[3]:
            yield from self._shown(self._once(), True)
        self.spans.clear()
        self.facts.clear()

    def _once(self) -> Iterator[Row]:
        seen = set()
        for values in self.spans.get():
            row = dict(zip(self.schema.names, values))
            if row[self.place] is None or row[self.place] not in seen:
                seen.add(row[self.place])
                yield Row(**row)

    def _shown(self, rows: Iterable[Row], incomplete: bool) -> Iterator[Row]:
        for row in rows:
            yield Row(**{c: row[c] for c in self.schema.names if c not in ("_ms", "_last")}, incomplete=incomplete)


def assembled(spans: DataFrame, last: Column, trace: str = "trace_id", place: str = "idx", ts: str = "ts", gap_ms: int = 1_800_000, late: str = "10 minutes") -> DataFrame:
    """A stream of the spans' rows, conversation by conversation, with ``incomplete``.

    ``last`` marks a conversation's last span; ``place`` counts from 0 within it.
    """
    spark = spans.sparkSession
    if spark.conf.get(PROVIDER[0], "") != PROVIDER[1]:
        raise ValueError(f"set {PROVIDER[0]} to {PROVIDER[1]}: conversations are kept as lists, which other state stores lack")
    kept = spans.where(F.col(trace).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    kept = kept.withColumns({"_ms": F.unix_millis(F.col(ts).cast("timestamp")), "_last": F.coalesce(last, F.lit(False))})
    return kept.groupBy(trace).transformWithState(Assembly(kept.schema, place, gap_ms), StructType(list(spans.schema.fields)).add("incomplete", BooleanType()), "append", "eventTime")


def unplaced(spans: DataFrame, trace: str = "trace_id", ts: str = "ts") -> DataFrame:
    """The spans that can belong to no conversation."""
    return spans.where(F.col(trace).isNull() | F.col(ts).isNull())


def derived_stream(closed: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes the derived columns of each assembled conversation, with ``capture_completeness``; a batch that is run again overwrites its own part."""

    def batch(rows: DataFrame, number: int) -> None:
        own = held(rows, "closed")  # read more than once below; state is advanced once
        whole = own.groupBy("trace_id").agg(F.when(F.bool_or("incomplete"), "partial").otherwise("complete").alias("capture_completeness"))
        derived_columns(own).join(whole, "trace_id").write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return closed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
