"""Packed sheets against the plain postings, and scans and searches that shuffle no vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import corpus, similarity, sparse
from tests.test_sparse import frame, plain_neighbours, unit_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[int(60 * rng.random() ** 2)] for _ in range(rng.integers(1, 30))) for _ in range(80)]
    rows = [(i, x) for i, x in enumerate([*texts, texts[3], "", None, "the. of!"])]
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


@pytest.mark.parametrize(("small", "many"), [(False, False), (True, False), (True, True)])
def test_sheets_give_the_plain_weights(spark, monkeypatch, docs, small, many):
    if small:  # many sheets, many ranges, and answers too large to be sent
        for name, value in (("SHEET", 100), ("TEXTS", 9), ("RANGE", 40), ("BYTES", 0)):
            monkeypatch.setattr(corpus, name, value)
    got = corpus.Corpus(docs, numbers=True, many=many)
    counts = tx.term_counts(docs, "id", "text")
    vocab = tx.vocabulary(tx.counted_frequencies(counts), F.lit(docs.count()))
    plain = tx.tfidf(tx.term_rows(counts), vocab)
    assert got.n_docs == 84 and {tuple(r) for r in got.vocab.collect()} == {tuple(r) for r in vocab.collect()}
    shown = lambda df: sorted((r.id, r.token, round(r.weight, 10)) for r in df.collect())
    want = shown(plain)
    assert shown(got.postings()) == want
    assert shown(tx.postings_of(got.rows())) == want
    assert shown(got.postings(["w1", "nosuchword"])) == [x for x in want if x[1] == "w1"]
    whole = {x[0] for x in want if x[1] == "w1"}
    assert shown(tx.postings_of(got.rows(["w1"]))) == [x for x in want if x[0] in whole]
    rows, n, parts = got.vectors(100 if small else 10**9)
    vectors = lambda df: sorted((r.id, list(r.ranks), [round(w, 10) for w in r.weights]) for r in df.collect())
    assert n == vocab.count() and vectors(rows) == vectors(sparse.vectors(plain))
    assert vectors(rows) == sorted(x for part in parts for x in vectors(part)) and (len(parts) > 1) == small


def test_postings_are_not_shuffled(docs):
    assert "Exchange hash" not in plan(corpus.Corpus(docs).postings())


def test_scans_shuffle_no_vectors(spark, monkeypatch):
    """Each pass has some vectors' lists; disk is for the best k of each vector, not for each pair of blocks."""
    monkeypatch.setattr(sparse, "LISTED", 60)
    monkeypatch.setattr(sparse, "MERGED", 2)
    rows = unit_rows(np.random.default_rng(12), 90, 50, 9)
    found = sparse.nearest(sparse.vectors(frame(spark, rows)), 3, 0.0)
    assert "CoGroups" not in plan(found)
    assert sorted((r.left, r.right, r["rank"]) for r in found.collect()) == plain_neighbours(rows, 3, 0.0)


@pytest.mark.parametrize("blocks", [1, 4])
def test_vectors_are_compared_without_a_shuffle(spark, blocks):
    """Copies, ties and fewer rows than k included; each pass writes the k best so far, not the pairs of blocks."""
    rng = np.random.default_rng(13)
    x = rng.integers(-2, 3, (70, 6)).astype(float)
    x[40:60] = x[7]
    rows = [(i * 3, v.tolist()) for i, v in enumerate(x) if v.any()]
    found = similarity.knn(spark.createDataFrame(rows, "id long, v array<float>").repartition(3), "id", "v", 4, blocks=blocks)
    assert "Exchange" not in plan(found) and "CoGroups" not in plan(found)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    want = []
    for i, a in unit.items():
        best = sorted((-round(float(a @ b), 6), j) for j, b in unit.items() if j != i)[:4]
        want += [(i, j, n + 1) for n, (_, j) in enumerate(best)]
    assert sorted((r.left, r.right, r["rank"]) for r in found.collect()) == sorted(want)
    few = spark.createDataFrame(rows[:2], "id long, v array<float>")
    assert similarity.knn(few, "id", "v", 4).count() == 2 and similarity.knn(few.limit(0), "id", "v").count() == 0
