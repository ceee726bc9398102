import pytest
from pyspark.sql import functions as F

from parley.operators.aspects import Aspects
from parley.sources.tables import Store
from parley.streaming import ingest


def test_stream_windows_equal_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.tumbling(ingest.read(spark, str(tmp_path / "in"), events.schema), late="60 days")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("windows")) == key(ingest.tumbling(events))


def test_new_conversations_pass_through_saved_questions(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"text {i}") for i in range(6)], "id string, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "docs"))
    aspects = Aspects(Store(spark, str(tmp_path / "store")))
    aspect = aspects.ensure("is it even?")
    by = lambda rows, question: rows.select("id", F.lit(0.5).alias("score"), (F.col("id").cast("int") % 2 == 0).alias("value"), F.lit(0.9).alias("confidence"), F.col("text").alias("quote"))
    stream = ingest.read(spark, str(tmp_path / "docs"), docs.schema, per_trigger=1)
    ingest.judge_stream(stream, aspects, [aspect], str(tmp_path / "cp"), by).awaitTermination()
    got = {r.id: r.value_json for r in aspects.of(aspect).collect()}
    assert got == {str(i): str(i % 2 == 0).lower() for i in range(6)}
    again = aspects.evaluate(aspect, docs, by)
    assert again.count() == 6
    groups = aspects.groups(aspect, docs).collect()
    assert [(g.group_key, g["count"]) for g in groups] == [("yes", 3), ("no", 3)]
    newer = aspects.ensure("is it odd?", replaces=aspect)
    assert {r.id: r.version for r in aspects.catalogue().collect()} == {aspect: 1, newer: 2}
    assert {r.aspect_id: r.n_values for r in aspects.usage().collect()} == {aspect: 6, newer: 0}
    assert aspects.wide([aspect]).count() == 6


@pytest.mark.parametrize("gap", ["30 minutes", "2 hours"])
def test_sessions_cover_all_events(spark, data, gap):
    events = spark.read.parquet(f"{data}/events.parquet")
    assert ingest.sessions(events, gap).agg(F.sum("n")).first()[0] == events.count()


def test_streamed_judgments_do_not_depend_on_the_order_of_batches(spark, tmp_path):
    from parley.operators import judge
    from parley.streaming.judging import StreamJudge

    said = lambda i: f"refund wanted now {i}" if i % 7 == 0 else f"plain talk about thing{i % 11} and more"
    corpus = judge.index(spark.createDataFrame([(str(i), said(i)) for i in range(40)], "id string, text string"))
    parts = [spark.createDataFrame([(str(i), said(i)) for i in range(a, a + 10)] + [(f"none{a}", None)], "id string, text string") for a in (40, 50)]
    found = []
    for name, order in (("one", (0, 1)), ("two", (1, 0, 1))):  # the second repeats a batch
        own = StreamJudge.begin(str(tmp_path / name), "does the user want a refund?", corpus)
        for b in order:
            own.batch(parts[b], b)
        values = [sorted((r.id, r.score, r.value, r.confidence, r.quote) for r in own.values().collect())]
        assert own.refresh() == 1
        values.append(sorted((r.id, r.score, r.value, r.confidence, r.quote) for r in own.values().collect()))
        found.append(values)
    assert found[0] == found[1] and len(found[0][0]) == len(found[0][1]) == 62
    assert all(v == (i.isdigit() and int(i) % 7 == 0) for i, _, v, _, _ in found[0][1])
    at, spread = judge.cut(own.scores())
    assert own.cut() == pytest.approx((at, spread), rel=1e-9)


def test_a_stream_is_judged_against_its_corpus(spark, tmp_path):
    from parley.operators import judge
    from parley.streaming.judging import StreamJudge

    corpus = judge.index(spark.createDataFrame([(f"c{i}", f"refund wanted now {i}" if i % 7 == 0 else f"plain talk about thing{i % 11} and more") for i in range(40)], "id string, text string"))
    own = StreamJudge.begin(str(tmp_path / "state"), "does the user want a refund?", corpus)
    docs = spark.createDataFrame([(f"s{i}", "refund wanted now please" if i == 3 else "some talk") for i in range(6)], "id string, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    own.run(ingest.read(spark, str(tmp_path / "in"), docs.schema, per_trigger=1), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r.value for r in own.values().collect()}
    assert len(got) == 46 and got["s3"] and not got["s1"] and got["c7"]
