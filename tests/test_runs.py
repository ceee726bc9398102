import pytest
from pyspark.sql import functions as F

from parley.operators import cluster
from parley.plans.binding import generated
from parley.runs import Runs
from parley.sources import generator, remote
from parley.sources.tables import Store


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    from parley.engine import Engine

    traces = generator.traces(spark, 60)
    return Runs(Engine(spark, generated(traces, generator.spans(traces)), Store(spark, str(tmp_path_factory.mktemp("runs"))), now="2023-12-31 00:00:00"))


def test_a_shape_question_runs_at_once(runs):
    id_ = runs.create("Which app costs the most?")
    assert runs.get(id_)["status"] == "queued"
    answer = runs.execute(id_)
    assert runs.get(id_)["status"] == "complete"
    stored = runs.answer(id_)
    assert stored["denominator"] == answer.denominator == 60
    assert sum(g["count"] for g in stored["groups"]) == 60 and stored["headline"] == answer.headline
    with pytest.raises(ValueError):
        runs.execute(id_)


def test_a_judged_question_waits_and_can_be_reworded(runs):
    id_ = runs.create("How many people asked about a charged invoice?")
    row = runs.get(id_)
    assert row["status"] == "awaiting_confirmation" and row["rows"] == 60
    with pytest.raises(ValueError):
        runs.execute(id_)
    again = runs.create("How many people asked about a charged invoice?")
    runs.confirm(again, "does the user mention an invoice?")
    assert runs.resume(again).denominator == 60
    assert runs.engine.aspects.catalogue().where(F.col("question") == "does the user mention an invoice?").count() == 1
    with pytest.raises(KeyError):
        runs.get("nothing")


def test_remote_functions_are_retried_and_checked(spark):
    docs = spark.createDataFrame([(i, f"text {i}" if i else None) for i in range(150)], "id long, text string")
    rows = remote.encode(docs, lambda texts: [[len(t), 1.0] for t in texts], waits=()).collect()
    assert len(rows) == 150 and all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in rows)
    calls = []

    def flaky():
        calls.append(1)
        return [1] if len(calls) < 3 else [1, 2]

    assert remote.attempt(flaky, 2, waits=(0.0, 0.0)) == [1, 2] and len(calls) == 3
    with pytest.raises(ValueError):
        remote.attempt(lambda: [1], 2, waits=(0.0,))
    judge = remote.judge_by(lambda texts, q: [None if t == "text 3" else (t.endswith("1"), 0.8, t[:4] if t != "text 2" else "no such") for t in texts], waits=())
    got = {r.id: r for r in judge(docs, "does it end in one?").collect()}
    assert len(got) == 149 and 3 not in got and got[1].value and not got[4].value and got[2].quote == "" and got[4].quote == "text"


def test_terms():
    assert cluster.distinct_terms(["late parcel", "parcel", "late", "refund"]) == ["late parcel", "refund"]
    assert cluster.subtitle(["late_parcel", "parcel", "refund"]) == "Late parcel and refund"
    assert cluster.subject(["the order", "zebra order"], {"order": 1.0, "zebra": 5.0}) == "zebra order"
    assert cluster.subject(["order"], {"order": 1.0}) is None
    assert cluster.topical(["a", "b", "zz"], {"a": 1.0, "b": 2.0}) == ["b", "a", "zz"]


def test_a_stopped_judge_keeps_its_judgments_and_is_resumed(spark, tmp_path):
    from parley.engine import Engine

    traces = generator.traces(spark, 60)
    bound = generated(traces, generator.spans(traces))
    store, seen = Store(spark, str(tmp_path / "s")), []

    def engine(model, budget=None):
        return Engine(spark, bound, store, "2023-12-31 00:00:00", remote.judge_by(model, waits=()), budget)

    def poor(texts, question):
        if any("flight" in t for t in texts):
            raise remote.BudgetExceeded("no more")
        return [(True, 0.9, "", 0.5) for _ in texts]

    def down(texts, question):
        raise ConnectionError("down")

    remote_request, remote.REQUEST = remote.REQUEST, 1
    try:
        first = Runs(engine(poor), seen.append)
        id_ = first.create("How many people asked about a charged invoice?")
        first.confirm(id_)
        with pytest.raises(remote.BudgetExceeded):
            first.execute(id_)
        kept = first.engine.aspects.values().count()
        assert first.get(id_)["status"] == "paused_budget" and seen[-1]["done"] == kept < 60
        assert first.engine.aspects.spent() == kept * 0.5
        assert [e["status"] for e in first.events(id_)] == ["paused_budget"]
        second = Runs(engine(down))
        with pytest.raises(remote.ProviderUnavailable):
            second.resume(id_)
        assert second.get(id_)["status"] == "paused_provider"
        third = Runs(engine(remote.ladder(down, lambda texts, q: [(False, 0.8, "", 0.25) for _ in texts])))
        assert third.resume(id_).denominator == 60 and third.progress(id_)["done"] == 60
        assert third.engine.aspects.spent() == kept * 0.5 + (60 - kept) * 0.25
        status = third.engine.status()
        assert status["runs"] == {"complete": 1} and status["values"] == 60 and status["judge"] == "remote"
        fourth = engine(poor, budget=1.0)
        with pytest.raises(remote.BudgetExceeded):
            fourth.aspects.evaluate(fourth.aspects.ensure("another?"), fourth.docs(), fourth.judge, budget=fourth.budget)
    finally:
        remote.REQUEST = remote_request
