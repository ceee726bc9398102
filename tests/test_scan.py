"""Scans of long keys against plain Python, with segments shorter than the reach of a shift."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import spans
from parley.operators.scan import scan

SCHEMA = "t string, i long, kind string, cost double"


def table(seed, n=600):
    """A key with half of the rows, a null key, keys of one row, null kinds."""
    r = random.Random(seed)
    keys = ["hot"] * 5 + [None, "a", "b", "c"]
    rows = [(r.choice(keys), i, r.choice(["x", "x", "y", None]), r.choice([None, 1.0, 2.5])) for i in range(n)]
    rows += [(f"single{i}", i, "x", 1.0) for i in range(5)]
    r.shuffle(rows)
    return rows


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda x: x[1]):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("limit", [1, 7, 80, 10_000])
def test_scans_of_long_keys_equal_plain_python(spark, limit):
    rows = table(limit)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert scan(df, "t", ["i"], limit).long == (limit < 10_000)
    want = {}
    for key, own in by_key(rows).items():
        total = sum(c or 0 for *_, c in own) if any(c is not None for *_, c in own) else None
        for p, (_, i, kind, cost) in enumerate(own):
            kinds = [own[q][2] if 0 <= q < len(own) else None for q in (p - 3, p - 1, p + 1, p + 2)]
            costs = [c for *_, c in own[:p] if c is not None]
            want[key, i] = (*kinds, p + 1, sum(costs) if costs else None, total)
    got = scan(df, "t", ["i"], limit).shift(a=("kind", 3), b=("kind", 1), c=("kind", -1), d=("kind", -2)).place("p").before(s="cost").whole(w="cost").done()
    assert got.columns == [*df.columns, "a", "b", "c", "d", "p", "s", "w"]
    assert {(r.t, r.i): (r.a, r.b, r.c, r.d, r.p, r.s, r.w) for r in got.collect()} == want


@pytest.mark.parametrize("limit", [2, 50])
def test_span_views_are_the_same_at_any_segment_length(spark, limit):
    df = spark.createDataFrame(table(9), SCHEMA)
    plain = lambda out: sorted(map(repr, out.collect()))
    for view in (
        lambda n: spans.neighbours(df, "t", ["i"], "kind", limit=n), lambda n: spans.around(df, "t", ["i"], "kind", limit=n), lambda n: spans.running(df, "t", ["i"], "cost", limit=n),
        lambda n: spans.islands(df, "t", ["i"], ["kind"], ["cost"], limit=n), lambda n: spans.explain(df, "t", ["i"], "kind", "cost", limit=n),
    ):
        assert plain(view(limit)) == plain(view(10_000))


def test_islands_go_across_segments(spark):
    rows = [("k", i, "x" if i < 300 else "y", 1.0) for i in range(400)] + [("other", 1, "x", 1.0)]
    got = spans.islands(spark.createDataFrame(rows, SCHEMA), "t", ["i"], ["kind"], ["cost"], limit=20)
    assert sorted((r.t, r.island, r.kind, r.n, r.cost) for r in got.collect()) == [("k", 1, "x", 300, 300.0), ("k", 2, "y", 100, 100.0), ("other", 1, "x", 1, 1.0)]


def test_a_long_key_is_many_tasks(spark):
    """A million rows of one key: no segment holds much more than its share."""
    df = spark.range(1_000_000).select(F.lit("k").alias("t"), "id", (F.col("id") % 3).cast("string").alias("kind"))
    ranged = scan(df, "t", ["id"])
    sizes = [r["count"] for r in ranged.rows.groupBy("_segment").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200_000
    out = ranged.shift(before=("kind", 1)).done()
    assert out.where(~F.col("before").eqNullSafe(F.when(F.col("id") > 0, ((F.col("id") - 1) % 3).cast("string")))).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert spans.islands(df, "t", ["i"], ["kind"], ["cost"]).count() == 0
    assert spans.explain(df, "t", ["i"], "kind", "cost").count() == 0
