"""Sparse neighbours, order statistics and singular vectors against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import cluster, select, sparse, svd


def unit_rows(rng, n, terms, most, copies=0):
    """Random sparse unit vectors, with frequent and rare terms and exact copies, as {id: {token: weight}}."""
    out = {}
    for i in range(n):
        names = {f"t{int(terms * rng.random() ** 3)}" for _ in range(rng.integers(1, most))}
        w = rng.random(len(names)) + 0.05
        w /= np.sqrt((w * w).sum())
        out[i] = dict(zip(sorted(names), w.tolist()))
    for c in range(copies):
        out[n + c] = out[int(rng.integers(0, 6))]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, w) for i, own in rows.items() for t, w in own.items()], "id long, token string, weight double")


def plain_neighbours(rows, k, floor):
    out = []
    for i, a in rows.items():
        sims = [(-round(sum(w * b[t] for t, w in a.items() if t in b), 6), j) for j, b in rows.items() if j != i]
        best = sorted(s for s in sims if (-s[0] >= floor if floor > 0 else -s[0] > 0))[:k]
        out += [(i, j, rank + 1) for rank, (_, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("floor", "joined"), [(0.0, False), (0.0, True), (0.2, True), (0.45, False), (0.9, True)])
def test_neighbours_equal_brute_force(spark, monkeypatch, floor, joined):
    if joined:
        monkeypatch.setattr(sparse, "SCAN", 0)
    rows = unit_rows(np.random.default_rng(1), 150, 80, 9, copies=40)
    got = sparse.neighbours(frame(spark, rows), 4, floor)
    assert sorted((r.left, r.right, r["rank"]) for r in got.collect()) == plain_neighbours(rows, 4, floor)


def test_long_lists_and_crowded_classes_change_nothing(spark, monkeypatch):
    rows = unit_rows(np.random.default_rng(2), 80, 12, 6, copies=60)
    want = plain_neighbours(rows, 3, 0.0)
    monkeypatch.setattr(sparse, "SCAN", 0)
    monkeypatch.setattr(sparse, "LIST", 7)
    monkeypatch.setattr(sparse, "CROWD", 9)
    assert sorted((r.left, r.right, r["rank"]) for r in sparse.neighbours(frame(spark, rows), 3, 0.0).collect()) == want


def test_similar_pairs_and_chosen_askers(spark):
    rows = unit_rows(np.random.default_rng(3), 120, 60, 8)
    own = sparse.vectors(frame(spark, rows)).cache()
    dot = lambda a, b: round(sum(w * rows[b].get(t, 0.0) for t, w in rows[a].items()), 6)
    want = sorted((a, b) for a in rows for b in rows if a < b and dot(a, b) >= 0.5)
    assert sorted((r.left, r.right) for r in sparse.similar(own, 0.5).collect()) == want
    ask = spark.createDataFrame([(3,), (7,), (999,)], "id long")
    got = sparse.nearest(own, 2, 0.1, ask)
    assert sorted((r.left, r.right, r["rank"]) for r in got.collect()) == [x for x in plain_neighbours(rows, 2, 0.1) if x[0] in (3, 7)]


def test_few_candidates_are_verified(spark):
    """Rare terms decide: texts that share frequent terms alone are no candidates."""
    rows = {i: {"the": 0.3, "of": 0.3, f"rare{i // 2}": math.sqrt(1 - 0.18)} for i in range(400)}
    own = sparse.vectors(frame(spark, rows)).withColumn("least", F.lit(0.45))
    offered = sparse.prefixes(own, 1.0)
    assert sparse.candidates(offered, offered, 400, both_ways=True).count() == 200


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, token string, weight double")
    assert sparse.neighbours(none).count() == 0
    one = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "id long, token string, weight double")
    assert sparse.neighbours(one).count() == 0


def test_linkage_on_the_cluster_equals_that_on_the_driver(spark, monkeypatch):
    rows, floor = unit_rows(np.random.default_rng(5), 40, 40, 6, copies=6), 0.3
    alone = spark.createDataFrame([(i, i) for i in [*rows, 900, 901]], "id long, group long")
    want = {r.id: r.group for r in cluster.link(frame(spark, rows), alone, floor).collect()}
    assert want[900] == 900 and len(set(want.values())) < 40
    for local in (35,):
        monkeypatch.setattr(cluster, "MAX_LOCAL", local)
        assert {r.id: r.group for r in cluster.link(frame(spark, rows), alone, floor).collect()} == want


def test_planted_groups_are_found_whatever_the_rest(spark):
    rng = np.random.default_rng(6)
    rows = {}
    for i in range(120):
        theme = i % 4
        own = {f"theme{theme}_{j}": 1.0 for j in rng.choice(12, 7, replace=False)} | {f"own{i}": 0.6}
        norm = math.sqrt(sum(w * w for w in own.values()))
        rows[i] = {t: w / norm for t, w in own.items()}
    got = {r.id: r.cluster for r in cluster.graph_clusters(frame(spark, rows), spark.range(120).toDF("id")).collect()}
    assert len(set(got.values())) == 4 and all(got[i] == got[i % 4] for i in range(120))


# -- order statistics -------------------------------------------------------------


@pytest.mark.parametrize("kind", ["even", "ties", "wide", "one", "signs"])
def test_percentiles_equal_sorting(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    xs = {"even": rng.random(999), "ties": rng.integers(0, 4, 1000).astype(float), "wide": 10.0 ** rng.uniform(-9, 9, 400), "one": np.array([2.5]), "signs": np.concatenate([rng.normal(size=500), [0.0] * 300, [-1e300, 1e300]])}[kind]
    monkeypatch.setattr(select, "BUCKETS", 16)
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double")
    ranks = sorted({0, len(xs) // 3, len(xs) // 2, len(xs) - 1})
    assert select.at_ranks(df, "x", [*ranks, 10**9]) == [*np.sort(xs)[ranks].tolist(), xs.max()]
    for q in (0.5, 0.98):
        assert select.percentile(df, "x", q) == pytest.approx(df.agg(F.percentile("x", q)).first()[0], rel=1e-12)
    top = max(3, len(xs) // 50)
    assert select.mean_of_top(df, "x", top) == pytest.approx(np.sort(xs)[-top:].mean(), rel=1e-9)


def test_percentiles_of_nothing(spark):
    none = spark.createDataFrame([(None,)], "x double")
    assert select.percentile(none, "x", 0.5) is None and select.mean_of_top(none, "x", 3) == 0.0 and math.isnan(select.at_ranks(none, "x", [0])[0])


# -- singular vectors -------------------------------------------------------------


@pytest.mark.parametrize("small", [False, True])
def test_singular_values_and_subspace_equal_numpy(spark, monkeypatch, small):
    rng = np.random.default_rng(8)
    dense = rng.random((90, 12)) @ rng.random((12, 300)) * (rng.random((90, 300)) < 0.3)
    rows = [(i, np.flatnonzero(row).tolist(), row[np.flatnonzero(row)].tolist()) for i, row in enumerate(dense)]
    df = spark.createDataFrame([*rows, (90, [], [])], "id long, ranks array<bigint>, weights array<double>")
    if small:  # many blocks and many groups of columns
        monkeypatch.setattr(svd, "BLOCK", 64)
        monkeypatch.setattr(svd, "BYTES", 300 * 8 * 7)
    space = svd.fit(df, 300, dims=20, rounds=10, settled=0.003)
    _, values, right = np.linalg.svd(dense)
    assert np.allclose(space.values, values[:20], rtol=0.01)
    terms = np.zeros((300, 20))
    for r in space.vectors().collect():
        terms[r.rank] = r.v
    assert np.allclose(terms.T @ terms, np.eye(20), atol=1e-8)
    assert np.linalg.norm(right[:5] @ terms, axis=1).min() > 0.99  # the leading directions lie in the space
    want = dense @ terms
    got = {r.id: np.array(r.v) for r in svd.encode(df, space).collect()}
    for i in range(90):
        assert np.allclose(got[i], want[i] / np.linalg.norm(want[i]), atol=1e-9)
    assert set(got) == set(range(91)) and not got[90].any()
    q = space.query({5: 1.0, 9: 0.5, 10_000: 1.0})
    assert np.allclose(q, (terms[5] + 0.5 * terms[9]) / np.linalg.norm(terms[5] + 0.5 * terms[9]))
    cos = (terms / np.linalg.norm(terms, axis=1, keepdims=True)) @ (terms[5] / np.linalg.norm(terms[5]))
    order = [j for j in np.lexsort((np.arange(300), -np.round(cos, 9))) if j != 5][:3]
    assert [r["rank"] for r in space.nearest([5], 3, 0.0).orderBy(F.desc("sim"), "rank").collect()] == order


def test_a_matrix_of_few_directions_and_none(spark):
    df = spark.createDataFrame([(i, [0, 1, 2], [1.0, 2.0, 2.0]) for i in range(5)], "id long, ranks array<bigint>, weights array<double>")
    space = svd.fit(df, 3, dims=3)
    assert space.width == 1 and np.allclose(space.values, [3 * math.sqrt(5)])
    empty = svd.fit(df.limit(0), 0)
    assert empty.vectors().count() == 0 and empty.query({1: 1.0}).tolist() == [0.0]
