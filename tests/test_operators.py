import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import aggregate, cluster, joins, judge, similarity, spans
from parley.plans import answer, lower
from parley.plans.binding import Binding, generated
from parley.plans.compiler import Compiler
from parley.operators.aspects import Aspects
from parley.sources import generator, tables
from parley.sources.tables import Store, fingerprint


def test_grouped_by_hand(spark):
    rows = spark.createDataFrame([("a", "x", 2.0, True), ("b", "x", 1.0, True), ("c", "y", 4.0, True), ("d", "y", 9.0, False), ("e", None, None, True)], "id string, g string, v double, ok boolean")
    own = aggregate.rows_of(rows, F.col("id"), F.col("g"), F.col("v"), F.col("ok"))
    got = {r.group_key: (r["count"], r.total, r.value, r.share) for r in aggregate.grouped(own, "sum").collect()}
    assert got == {"x": (2, 3.0, 3.0, 0.5), "y": (1, 4.0, 4.0, 0.25), "unknown": (1, 0.0, 0.0, 0.25)}
    assert aggregate.totals(own).first().asDict() == {"denominator": 4, "value_sum": 7.0, "value_mean": 1.75}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, group_key string, value double")
    assert aggregate.grouped(none).count() == 0
    assert aggregate.fold_tail(aggregate.grouped(none)).count() == 0
    assert aggregate.totals(none).first().denominator == 0


def test_folded_average_is_over_rows(spark):
    rows = spark.createDataFrame([(str(i), f"g{i % 5}", float(i)) for i in range(25)], "id string, group_key string, value double")
    folded = {r.group_key: r for r in aggregate.fold_tail(aggregate.grouped(rows, "avg"), 2, "avg").collect()}
    assert set(folded) == {"g4", "g3", aggregate.OTHER}
    assert folded[aggregate.OTHER].value == pytest.approx(np.mean([i for i in range(25) if i % 5 < 3]))
    assert sum(r["count"] for r in folded.values()) == 25


def test_yes_comes_first(spark):
    groups = spark.createDataFrame([("no", 9, 9.0), ("yes", 1, 1.0), ("unknown", 20, 20.0)], "group_key string, count long, value double")
    assert [r.group_key for r in aggregate.yes_first(groups).collect()] == ["yes", "no", "unknown"]
    other = spark.createDataFrame([("no", 9, 9.0), ("maybe", 1, 1.0), ("yes", 20, 20.0)], "group_key string, count long, value double")
    assert [r.group_key for r in aggregate.yes_first(other).collect()] == ["yes", "no", "maybe"]


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, joins.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, joins.insert_missing(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]
    versions = spark.createDataFrame([("q", 1, "x"), ("q", 3, "z"), ("r", 1, "y")], "k string, version int, v string")
    assert sorted((r.k, r.v) for r in joins.latest(versions, ["k"], "version").collect()) == [("q", "z"), ("r", "y")]


def test_islands_and_neighbours(spark):
    rows = spark.createDataFrame([(1, i, c, 1.0) for i, c in enumerate("aabba")] + [(2, 0, None, 1.0), (2, 1, None, 1.0)], "t int, i int, c string, v double")
    got = sorted((r.t, r.island, r.n) for r in spans.islands(rows, "t", ["i"], ["c"], ["v"]).collect())
    assert got == [(1, 1, 2), (1, 2, 2), (1, 3, 1), (2, 1, 2)]


def test_generator_repeats_and_agrees_with_its_spans(spark):
    a, b = generator.traces(spark, 60), generator.traces(spark, 60).repartition(7)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    derived = {r.trace_id: r for r in spans.derived_columns(generator.spans(a)).collect()}
    for r in a.collect():
        d = derived[r.trace_id]
        assert d.turns == r.user_turns
        assert d.tool_calls == r.user_turns * (3 if r.kind == "loop" else 1)
        assert (d.status == "error") == (r.kind == "upstream")
        assert d.user_request == r.ask


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert not store.exists("t")
    store.append("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    store.upsert("t", spark.createDataFrame([(2, "B")], "k int, v string"), ["k"])
    store.insert_missing("t", spark.createDataFrame([(2, "no"), (3, "c")], "k int, v string"), ["k"])
    store.update("t", "k", 1, v="A")
    store.migrate("t", {"note": "none"})
    store.update_column("t", spark.createDataFrame([(3, "new")], "k int, note string"), "k", "note")
    assert sorted(map(tuple, store.table("t").collect())) == [(1, "A", "none"), (2, "B", "none"), (3, "c", "new")]
    before = fingerprint(store.table("t")).first()
    store.update("t", "k", 1, v="AA")
    assert fingerprint(store.table("t")).first() != before
    store.clear("t")
    assert store.table("t").count() == 0


def test_appends_write_new_rows_only_and_fold_in_time(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.MANY = 3
    store.append("t", spark.createDataFrame([(0, "a")], "k int, v string"))
    for i in range(1, 6):
        store.append("t", spark.createDataFrame([(i, "b", i)], "k int, v string, extra long"))
        assert store.table("t").count() == i + 1
    assert {r.k: r.extra for r in store.table("t").collect()} == {0: None, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    assert len(store._current("t")) == 2  # folded once
    store.append("t", spark.createDataFrame([(6, "only", 1)], "k int, v string, extra int"))
    store.upsert("t", spark.createDataFrame([(6, None, 9), (7, "new", 7)], "k int, v string, extra long"), ["k"], ["v"])
    assert [tuple(r) for r in store.table("t").where("k > 5").orderBy("k").collect()] == [(6, None, 1), (7, "new", 7)]


def test_nearest_terms_equal_the_plain_cosine(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["mail", "post", "card", "sun", "rain", "wind"], 4, p=[0.3, 0.25, 0.15, 0.1, 0.1, 0.1])) for _ in range(40)]
    counts = tx.term_counts(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", bigrams=False)
    vocab = tx.vocabulary(tx.counted_frequencies(counts), F.lit(40), ratio=1.0)
    rows = tx.weighted_rows(counts, vocab, vocab.count())
    by_term: dict = {}
    for r in tx.postings_of(rows).collect():
        by_term.setdefault(r.token, np.zeros(40))[r.id] = r.weight
    for at in (0.2, 0.4, 0.6):
        asked = {"mail": 1.0, "sun": 0.5}
        want = dict(asked)
        for q, w in asked.items():
            a = by_term[q]
            sims = sorted(((-(a @ b) / np.linalg.norm(a) / np.linalg.norm(b), t) for t, b in by_term.items() if t != q))
            for s, t in [x for x in sims if -x[0] >= at][:3]:
                want[t] = max(want.get(t, 0.0), w * -s * 0.6)
        got = judge.nearest_terms(rows, asked, at)
        assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_components_and_knn(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(20, 8)) * 0.1 + c for c in np.eye(8)[:3] * 3])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [0.0] * 8)], "id long, v array<double>")
    near = similarity.knn(vectors, "id", "v", 5, blocks=3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -1)
    for i in range(60):
        want = np.lexsort((np.arange(60), -s[i]))[:5].tolist()
        assert [r.right for r in near.where(F.col("left") == i).orderBy("rank").collect()] == want or i > 4
    found = {r.id: r.component for r in similarity.components(vectors.select("id"), similarity.mutual(near, 0.5)).collect()}
    assert found[99] == 99 and {found[i] // 20 for i in range(20)} == {0}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "left long, right long")
    assert {r.component for r in similarity.components(spark.range(41), chain).collect()} == {0}


def test_linkage_joins_similar_groups(spark):
    docs = {0: {"a": 1.0}, 1: {"a": 0.9, "b": 0.43}, 2: {"a": 0.8, "b": 0.6}, 3: {"a": 1.0}, 4: {"z": 1.0}, 5: {"z": 1.0}, 6: {"y": 1.0}, 7: {"y": 1.0}}
    postings = spark.createDataFrame([(i, t, w) for i, d in docs.items() for t, w in d.items()], "id long, token string, weight double")
    start = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 4), (6, 6), (7, 6)], "id long, group long")
    got = {r.id: r.group for r in cluster.link(postings, start).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6, 7: 6}


@pytest.mark.parametrize(("size", "local"), [(430, True), (40, False)])
def test_linkage_equals_merging_one_pair_at_a_time(spark, monkeypatch, size, local):
    monkeypatch.setattr(cluster, "MAX_LOCAL", size if local else 0)
    rng = np.random.default_rng(11)
    x = np.where(rng.random((size, 24)) < 0.12, rng.random((size, 24)), 0.0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rows = [(i, f"t{j}", float(x[i, j])) for i in range(size) for j in range(24) if x[i, j]]
    start = spark.createDataFrame([(i, i) for i in range(size)], "id long, group long")  # single rows
    got = {}
    for r in cluster.link(spark.createDataFrame(rows, "id long, token string, weight double"), start, floor=0.3).collect():
        got.setdefault(r.group, set()).add(r.id)
    sums, sizes, members = x.copy(), np.ones(size), [{i} for i in range(size)]
    while len(members) > 2:
        mean = np.round(sums @ sums.T / np.outer(sizes, sizes), 9)
        mean[np.tril_indices(len(members))] = -1
        i, j = divmod(int(mean.argmax()), len(members))
        if mean[i, j] < 0.3:
            break
        sums[i] += sums[j]
        sizes[i] += sizes[j]
        members[i] |= members.pop(j)
        sums, sizes = np.delete(sums, j, 0), np.delete(sizes, j)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, members)) and len(members) < size / 2
    alone = spark.createDataFrame([(1, 1), (2, 2)], "id long, group long")
    none = spark.createDataFrame([], "id long, token string, weight double")
    assert {r.id: r.group for r in cluster.link(none, alone).collect()} == {1: 1, 2: 2} and cluster.link(none, alone.limit(0)).count() == 0


def test_any_value_of_many_can_be_named(spark):
    from parley.plans.binding import Binding

    rows = spark.range(5000).select(F.col("id"), F.format_string("app-%05d", "id").alias("app"))
    bound = Binding(rows, {"id": F.col("id"), "app": F.col("app")})
    assert bound.catalogue().count() == 5000
    assert bound.named("How many conversations in App-04999?") == {"app": ["app-04999"]} and bound.named("how many conversations?") == {}


def test_kmeans_finds_blobs(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(15, 6)) * 0.1 + c for c in np.eye(6)[:3] * 4])
    found, _ = cluster.kmeans_cosine(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", 3)
    rows = found.collect()
    assert len({r.cluster for r in rows}) == 3
    assert all(len({r.cluster for r in rows if r.id // 15 == b}) == 1 for b in range(3))
    assert cluster.choose_k(x / np.linalg.norm(x, axis=1, keepdims=True)) == 3


def test_kmeans_seeds_a_group_of_one_in_a_larger_table(spark):
    n = 5000
    last = spark.range(n).orderBy(F.xxhash64("id").desc()).first().id
    rng = np.random.default_rng(4)
    x = np.eye(6)[np.arange(n) % 2] + rng.normal(size=(n, 6)) * 0.02
    x[last] = np.eye(6)[4]
    found, _ = cluster.kmeans_cosine(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", 3)
    sizes = {r.cluster: r.ids for r in found.groupBy("cluster").agg(F.collect_list("id").alias("ids")).collect()}
    assert sorted(map(len, sizes.values()))[0] == 1 and [last] in sizes.values()
    assert cluster.choose_k(similarity.unit(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:60])], "id long, v array<double>"), "id", "v")) == cluster.choose_k(x[:60] / np.linalg.norm(x[:60], axis=1, keepdims=True))


def test_judge_finds_what_is_asked(spark):
    said = [(i, f"My parcel number {i} arrived damaged by water and I want a refund." if i % 10 == 0 else f"Please move my flight number {i} to another day, thank you.") for i in range(60)]
    got, asked = judge.judge(spark.createDataFrame(said, "id long, text string"), "does the user report a damaged parcel?")
    rows = got.collect()
    assert asked.scope == "user" and not asked.negated
    assert {r.id for r in rows if r.value} == {i for i in range(60) if i % 10 == 0}
    assert all("damaged" in r.quote for r in rows if r.value)
    assert all(0.5 <= r.confidence <= 0.97 for r in rows)


def test_relaxation_drops_the_last_conditions(spark):
    rows = spark.createDataFrame([("1", "a", "timeout"), ("2", "a", "none")], "id string, app string, failure_mode string")
    bound = Binding(rows)
    spec = Compiler({"app": ["aaaa"]}).compile("conversations that timed out and refused")
    relaxed, dropped = lower.relax(spec, bound)
    assert [p.id for p in relaxed.predicates] == ["the_request_timed_out"] and [p.id for p in dropped] == ["the_agent_refused"]


def test_engine_end_to_end(spark, tmp_path):
    from parley.engine import Engine

    traces = generator.traces(spark, 120)
    bound = generated(traces, generator.spans(traces))
    engine = Engine(spark, bound, Store(spark, str(tmp_path)), now="2023-12-31 00:00:00")
    got = engine.ask("Which app costs the most?")
    assert got.denominator == 120 and got.excluded == 0 and abs(sum(g["share"] for g in got.groups) - 1) < 1e-5
    failed = engine.ask("how many conversations failed by app")
    assert 0 < failed.denominator < 120
    tools = engine.ask("conversations by tool")
    assert {g["group_key"] for g in tools.groups} <= set(generator.TOOLS)
    open_ended = engine.ask("What are people complaining about?")
    assert open_ended.spec.path == "layer2_cluster" and open_ended.denominator == 120
    asked = engine.ask("How many people asked about a charged invoice?")
    assert asked.spec.path == "layer3_aspect" and asked.denominator == 120
    again = engine.ask("How many people asked about a charged invoice?")
    assert again.groups == asked.groups and engine.aspects.catalogue().count() == 1
    assert engine.list_traces(page=1, size=10).count() == 10
    assert engine.trace_detail("tr-00000003").count() > 0
    assert engine.search("charged twice invoice").count() > 0
    assert [r.relevance for r in engine.search_traces("charged twice invoice", size=5).collect()] == sorted([r.score for r in engine.search("charged twice invoice", size=5).collect()], reverse=True)
    assert engine.lookup_error("tool_upstream_error")["title"] == "Tool upstream error" and not engine.lookup_error("nosuch")["known"]
    assert engine.lookup_error("provider_rate_limit_429")["explanation"].startswith("HTTP 429: Too Many Requests.")
    assert engine.representative_traces(3).count() == 3
    assert {"app", "cost"} <= {f["key"] for f in engine.list_shape_fields()}


def test_answers_must_add_up():
    with pytest.raises(ValueError):
        answer.Answer(Compiler().compile("conversations by app"), 3, 0, [{"group_key": "a", "count": 2, "share": 1.0}])


def test_ties_are_named():
    spec = Compiler().compile("conversations by app")
    tied = [{"group_key": k, "label": k, "value": 2.0, "count": 2, "share": 0.5} for k in "ab"]
    assert answer.interpretation(spec, tied) == "a and b are tied."


def test_fingerprints_see_every_change(spark):
    kind = "a int, b string"
    of = lambda rows: tuple(tables.fingerprint(spark.createDataFrame(rows, kind)).first())
    assert of([(1, "a"), (1, "a")]) != of([(2, "b"), (2, "b")])
    assert of([(None, "1")]) != of([(1, None)]) and of([(1, "")]) != of([(1, None)])
    assert of([(1, "a"), (2, "b")]) == of([(2, "b"), (1, "a")])
    assert of([])[0] == 0


def test_the_named_party_is_scored(spark):
    docs = spark.createDataFrame([(i, f"filler words number{i} talk plain") for i in range(40)] + [(100, "hello there refund please thanks"), (101, "hello there please refund thanks")], "id long, text string")
    said = {"user": spark.createDataFrame([(100, "refund please"), (101, "hello")], "id long, text string")}
    got = {r.id: r.score for r in judge.judge(docs, "does the user mention refunds?", lambda who: said.get(who))[0].collect()}
    assert got[100] > got[101] > 0 and len(got) == 42


def test_a_judge_of_rows_sees_pending_rows_only(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "s"))
    own, seen = Aspects(store), []

    def by(docs, question):
        seen.append(docs.count())
        return docs.select("id", F.lit(1.0).alias("score"), F.lit(True).alias("value"), F.lit(0.9).alias("confidence"), F.col("text").alias("quote"))

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "id long, text string")
    aspect = own.ensure("is it so?")
    own.evaluate(aspect, docs.where("id < 4"), by)
    own.evaluate(aspect, docs, by)
    assert seen == [4, 2] and own.of(aspect).count() == 6


def test_local_judgments_in_parts_equal_those_at_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"refund wanted now {i}" if i % 9 == 0 else f"plain talk about thing{i} and more") for i in range(60)], "id long, text string")
    found = []
    for name, parts in (("once", [docs]), ("parts", [docs.where("id < 30"), docs])):
        own = Aspects(tables.Store(spark, str(tmp_path / name)))
        aspect = own.ensure("does the user want a refund?")
        for part in parts:
            own.evaluate(aspect, part)
        found.append(sorted((r.id, r.value_json, r.score) for r in own.of(aspect).collect()))
    assert found[0] == found[1] and len(found[0]) == 60


def test_every_token_takes_part_in_the_projection(spark):
    from parley.operators import sparse, svd

    rows = [(i, f"{'cat' if i % 2 else 'dog'}{j}", 0.5) for i in range(40) for j in range(4)] + [(99, "once", 1.0)]
    own = sparse.vectors(spark.createDataFrame(rows, "id long, token string, weight double"))
    got = {r.id: np.array(r.v) for r in svd.encode(own, svd.fit(own, 9, dims=8)).collect()}
    assert len(got) == 41 and np.linalg.norm(got[99]) > 0
    assert got[0] @ got[2] > 0.99 and abs(got[0] @ got[1]) < 0.7


def test_the_dense_part_widens_and_softens_judgments(spark):
    """Words that keep the same company are near in the dense space, whether or not they ever meet."""
    talk = [f"the parcel {'cracked' if i % 2 else 'shattered'} inside its carton{i % 5}" for i in range(12)]
    talk += [f"billing asked about invoice{i % 6} and payment{i % 4}" for i in range(24)] + ["an order of tea came"]
    docs = spark.createDataFrame(list(enumerate(talk)), "id long, text string")
    own = judge.index(docs, dense=3)
    near = own.space.nearest_terms({"shatter": 1.0}, at=0.3, per=15)
    assert any(t.startswith("crack") for t in near) and near["shatter"] == 1.0
    asked = "did the parcel shatter?"
    plain = {r.id: r for r in judge.judge(docs, asked)[0].collect()}
    both = {r.id: r for r in judge.judge(own, asked)[0].collect()}
    assert len(both) == len(plain) == len(talk)
    assert min(both[i].score for i in range(12)) > max(both[i].score for i in range(12, 37))
    query = own.space.query({"parcel": 1.0})
    assert abs(sum(x * x for x in query) - 1) < 1e-9 and own.space.query({"nosuchword": 1.0}) == [0.0] * own.space.terms.width


def test_many_aliases_are_joined_with_the_same_result(spark, monkeypatch):
    said = ["my shipment failed. The ship sails", "ship it now!", "", None, "cancellation please\ncancel the order", "the ship the ship"]
    docs = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    counts = tx.term_counts(docs, "id", "text", stems=True)
    alias = tx.alias_rows(counts)
    shown = lambda df: {r.id: dict(zip(r.terms, r.counts)) for r in df.collect()}
    want = shown(tx.aliased_counts(docs, counts, alias))
    monkeypatch.setattr(tx, "BROADCAST_TOKENS", 0)
    assert alias.count() and shown(tx.aliased_counts(docs, counts, alias)) == want and want != shown(counts)


def test_outcomes_are_told_where_they_stand_out():
    assert answer.outcome({"count": 10, "resolved": 0, "gave_up": 4, "top_failure": "timeout", "top_failure_n": 3}) == "Of these, no one got what they asked for and 3 met with timeout and 4 gave up."
    assert answer.outcome({"count": 10, "resolved": 2, "gave_up": 0}) == "Of these, only 2 of 10 were resolved."
    assert answer.outcome({"count": 10, "resolved": 5, "gave_up": 1}) == "" and answer.outcome({}) == ""


def test_autopsies(spark):
    from parley.operators import spans

    kind = "trace_id string, user_request string, tokens_input long, tokens_output long, cost_usd double, duration_ms long, ended_by string"
    rows = spark.createDataFrame([("a", "Where is it?", 1000, 234, 0.01234, 2500, "user"), ("b", None, None, None, None, None, None)], kind)
    bridge = spark.createDataFrame([("a", "search", 2), ("a", "mail", 1)], "trace_id string, tool string, calls long")
    got = {r.trace_id: r.autopsy for r in spans.autopsy(rows, bridge).collect()}
    assert got["a"] == "It opened with: “Where is it?” It called mail x1, search x2. It took 1,234 tokens, $0.0123 and 2.5 seconds, and ended with the user."
    assert got["b"].endswith("It called no tool. It took 0 tokens, $0.0000 and 0.0 seconds, and ended with the unknown.")
    traces = generator.traces(spark, 30)
    all_spans = generator.spans(traces)
    assert spans.autopsy(spans.derived_columns(all_spans), spans.tool_bridge(all_spans)).where("autopsy is not null").count() == 30


def test_words_of_one_stem_meet_in_the_index(spark):
    from parley.engine import Engine
    from parley.plans.binding import Binding

    said = ["my shipment failed", "ship it now", "the ship was late", "cancellation please", "cancel the order", "hello there friend"]
    rows = spark.createDataFrame(list(enumerate(said)), "id long, text string")
    engine = Engine(spark, Binding(rows, {"id": F.col("id")}, text="text"))
    assert {r.id for r in engine.search("shipment").collect()} == {0, 1, 2} == {r.id for r in engine.search("ship").collect()}
