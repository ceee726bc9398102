import pytest
from pyspark.sql import functions as F

from parley.operators import spans
from parley.sources import generator
from parley.streaming import assembly, ingest


@pytest.fixture
def rocks(spark):
    spark.conf.set(*assembly.PROVIDER)
    yield spark
    spark.conf.unset(assembly.PROVIDER[0])


def timed(rows):
    """Spans with a time, and whether they are their conversation's last."""
    ends = rows.groupBy("trace_id").agg(F.max("idx").alias("_end"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("idx"))
    return rows.join(ends, "trace_id").withColumn("ts", at).withColumn("final", F.col("idx") == F.col("_end")).drop("_end")


def test_streamed_conversations_equal_the_batch(rocks, tmp_path):
    """Spans dealt over files in any order, a quarter of them twice; some conversations lack their last span, one a middle span."""
    rows = timed(generator.spans(generator.traces(rocks, 40)))
    cut = F.col("trace_id").isin("tr-00000003", "tr-00000011") & F.col("final") | (F.col("trace_id") == "tr-00000005") & (F.col("idx") == 1)
    kept = rows.where(~cut)
    far = kept.where("trace_id = 'tr-00000007' and idx = 0").withColumns({"trace_id": F.lit("far"), "ts": F.timestamp_seconds(F.lit(1_700_100_000)), "final": F.lit(False)})
    first = kept.unionByName(kept.where("crc32(id) % 4 = 0"))
    for i in range(3):  # one file a micro-batch
        first.where(F.crc32(F.concat("id", F.lit("f"))) % 3 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"a{i}"))
    far.coalesce(1).write.parquet(str(tmp_path / "in" / "z"))
    stream = rocks.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = assembly.derived_stream(assembly.assembled(stream, F.col("final")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = rocks.read.parquet(str(tmp_path / "out")).drop("batch")
    want = spans.derived_columns(kept).withColumn("capture_completeness", F.when(F.col("trace_id").isin("tr-00000003", "tr-00000011", "tr-00000005"), "partial").otherwise("complete"))
    shown = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert got.count() == 40
    assert shown(got) == shown(want)


def test_needs_a_state_store_with_lists(spark, tmp_path):
    rows = timed(generator.spans(generator.traces(spark, 2)))
    with pytest.raises(ValueError, match="providerClass"):
        assembly.assembled(ingest.read(spark, str(tmp_path), rows.schema), F.col("final"))


def test_repeats_and_spans_without_place_or_conversation(rocks, tmp_path):
    schema = "trace_id string, idx int, text string, ts timestamp, final boolean"
    at = lambda s: __import__("datetime").datetime.fromtimestamp(1_700_000_000 + s)
    batches = [
        [("a", 1, "end", at(1), True), (None, 0, "lost", at(0), False), ("a", None, "no place", at(1), False), ("b", 0, "only", at(0), True), ("c", 0, "open", at(0), None)],
        [("a", 1, "again", at(1), True), ("a", 0, "start", at(2), False)],
        [("a", 0, "repeat", at(3), False), ("c", 1, "untimed", None, True)],
        [("far", 0, "later", at(90_000), False)],
    ]
    for i, rows in enumerate(batches):
        rocks.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = assembly.assembled(stream, F.col("final"))
    out.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.trace_id, str(r.idx), r.incomplete) for r in rocks.table("closed").collect())
    assert got == [("a", "0", False), ("a", "1", False), ("a", "None", False), ("b", "0", False), ("c", "0", True)]
    assert rocks.table("closed").where("text in ('start', 'repeat')").count() == 1
    lost = assembly.unplaced(rocks.read.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")))
    assert sorted(r.text for r in lost.collect()) == ["lost", "untimed"]
