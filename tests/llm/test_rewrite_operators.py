"""Fill-in-the-middle, periodic runs and the quality classifier against plain Python, with the odd cases each must define."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import fim, nbsvm, periods, queries

ODD = ["", None, " ", "\n\n", "a", "Hello, world! " * 3, "naïve café — 日本語 \U0001f600 \t\n x", "THE the The the", "word " * 400, "x" * 9000, "é" * 7000, "a<P>b", "tail <M>", "one\ntwo\n\nthree", "a < b <S", "áb   z" * 900]
CLASH = "doc_id long, text string, row string, output string, n int, runs int, _text string"


def frame(spark, texts, ids=None):
    # columns whose names operators use inside
    return spark.createDataFrame([(i, t, "k", "o", 7, 1, "u") for i, t in zip(ids or range(len(texts)), texts)], CLASH)


# -- fill in the middle -----------------------------------------------------------


def plain_units(text, unit):
    """Starts of units, by position."""
    blank = " \t\n\x0b\x0c\r"
    starts = {"char": lambda a, b: True, "word": lambda a, b: a in blank and b not in blank, "line": lambda a, b: a == "\n"}[unit]
    return [i for i in range(len(text)) if i == 0 or starts(text[i - 1], text[i])]


def plain_fim(doc_id, text, unit="char"):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    at = [*plain_units(text, unit), len(text)]
    n = len(at) - 1
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[: at[a]], text[at[a] : at[b]], text[at[b] :]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fim_equals_plain_cutting_and_restores(spark, unit):
    rng = random.Random(3)
    texts = ODD * 4 + ["".join(rng.choice("ab é日\n\t<SPM>") for _ in range(rng.randrange(60))) for _ in range(300)]
    ids = [*range(len(texts) - 1), None]
    df = frame(spark, texts, ids)
    got = {r.doc_id: r for r in fim.transform(df, unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()}
    assert len(got) == len(texts) and {r.form for r in got.values()} == {"plain", "psm", "spm"}
    for i, t in zip(ids, texts):
        assert (got[i].n, got[i].form, got[i].prefix_units, got[i].middle_units, got[i].output) == plain_fim(i, t, unit)
        assert got[i].back == (t or "") and got[i].row == "k" and got[i]._text == "u"


def test_fim_of_an_empty_table_repeats_and_bad_sentinels(spark):
    assert fim.transform(frame(spark, ["a"]).limit(0)).count() == 0
    twice = fim.transform(frame(spark, ["same text"] * 3, [5, 5, 5])).select("output").distinct()
    assert twice.count() == 1
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("", "x", "y"), ("<P>", "x<P>y", "z")):
        with pytest.raises(ValueError):
            fim.transform(frame(spark, ["a"]), sentinels=bad)


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_chunks_of_any_size_find_the_same_positions(chunk):
    raws = [t.encode() for t in ("", "é日本 a b", "", "x", "\n\n a  b\nc ", "é" * 50)]
    ends = np.cumsum([len(r) for r in raws])
    data = np.frombuffer(b"".join(raws), np.uint8)
    for unit in fim.STARTS:
        found = fim.Chunks(data, ends - [len(r) for r in raws], ends, unit, chunk)
        want = [[len(r.decode()[:i].encode()) for i in plain_units(r.decode(), unit)] for r in raws]
        assert found.n.tolist() == [len(w) for w in want]
        for rank in range(51):
            got = found.positions(np.array([min(rank, len(w)) for w in want])) - (ends - [len(r) for r in raws])
            assert got.tolist() == [[*w, len(r)][min(rank, len(w))] for w, r in zip(want, raws)]


def test_fim_query_equals_its_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    rel = con.sql(queries.ORACLES["op11_fim"])
    df = queries.op11_fim(spark, data).select(*rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


# -- periodic runs ----------------------------------------------------------------


def plain_runs(ws, min_words=6, min_repeats=4):
    """Every maximal stretch, period by period, with the smallest period of each."""
    found = {}
    for p in range(1, len(ws)):
        i = 0
        while i + p < len(ws):
            if ws[i] != ws[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(ws) and ws[j] == ws[j + p]:
                j += 1
            length = j + p - i
            if length >= max(min_words, min_repeats * p):
                found.setdefault((i, length), p)
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_collapsed(ws, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_equal_brute_force(spark):
    rng = random.Random(4)
    texts = list(ODD)
    for _ in range(400):
        some = [rng.choice("ab") if rng.random() < 0.8 else rng.choice("cdé") for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            cycle = [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
            some += cycle * rng.randrange(2, 9) + cycle[: rng.randrange(len(cycle))]
        texts.append(rng.choice([" ", "\t", "  \n"]).join(some))
    for least, times in ((6, 4), (2, 2), (5, 3)):
        got = {r.doc_id: r for r in periods.runs(frame(spark, texts), min_words=least, min_repeats=times).collect()}
        for i, t in enumerate(texts):
            ws = words_of(t)
            want = plain_runs(ws, least, times)
            assert [tuple(x) for x in got[i].runs] == want and got[i].n_words == len(ws)
            assert got[i].collapsed == plain_collapsed(ws, want) and got[i].output == "o"


def test_runs_of_long_texts_and_of_many_together():
    rng = random.Random(5)
    long = ["w"] * 3000 + [str(i) for i in range(2000)] + ["a", "b", "c"] * 1500 + [str(i % 700) for i in range(3000)]
    texts = [" ".join(long), "x", "", " ".join(str(rng.randrange(2)) for _ in range(3000)), " ".join(long[2999:3500]) * 2]
    n, runs, collapsed = periods._texts(texts, 6, 4)
    for t, k, r, c in zip(texts, n, runs, collapsed):
        ws = words_of(t)
        got = [(x["start"], x["length"], x["period"]) for x in r]
        assert k == len(ws) and c == plain_collapsed(ws, got)
        if len(ws) < 4000:
            assert got == plain_runs(ws)
    assert [(x["start"], x["length"], x["period"]) for x in runs[0]] == [(0, 3000, 1), (5000, 4500, 3), (9500, 3000, 700)]


def test_grid_blocks_do_not_change_the_runs(monkeypatch):
    texts = [" ".join(random.Random(i).choices("ab", k=200)) for i in range(20)] + ["a " * 500]
    want = periods._texts(texts, 6, 4)
    monkeypatch.setattr(periods, "AT_ONCE", 7)
    assert periods._texts(texts, 6, 4) == want


def test_period_query_equals_brute_force(spark, data):
    rows = {r.doc_id: r for r in queries.op12_periods(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ws, h = words_of(d.text), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and ws:
            n, g = len(ws), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
        found, r = plain_runs(ws), rows[d.doc_id]
        best = min(((-n, s, p) for s, n, p in found), default=None)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == ((len(found), best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (0, None, None, None, None))
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(ws, found).encode()).hexdigest()


def test_cycles_of_odd_rows(spark):
    rows = queries.with_cycles(spark.createDataFrame([(None, "a b"), (None, None), *[(i, t) for i in range(40) for t in ("", None, " x  y z ")]], "doc_id long, text string")).collect()
    changed = {r.doc_id for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0}
    assert changed and all(r.text in ("", None, " x  y z ", "a b") or r.doc_id in changed for r in rows)
    assert periods.runs(spark.createDataFrame([], CLASH)).count() == 0


# -- quality ----------------------------------------------------------------------


def test_shapes_and_features():
    assert nbsvm.shape("Hello,") == "Aa+," and nbsvm.shape("NOW!!!") == "A+!+" and nbsvm.shape("12.50$$") == "0.0$+" and nbsvm.shape("É1") == "A0"
    of, column = nbsvm.features(["a b", None, "", "a b a b", "b"])
    assert set(of.tolist()) == {0, 3, 4} and len(set(zip(of.tolist(), column.tolist()))) == len(of)
    alone = [nbsvm.features([t])[1].tolist() for t in ("a b", "a b a b", "b")]
    assert [column[of == i].tolist() for i in (0, 3, 4)] == alone  # a text's features do not depend on its neighbours


def test_descent_reaches_the_hinge_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    w, b = nbsvm.descend([(np.arange(5), row) for row in x], y, 5, rounds=4000, tolerance=1e-9)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()

    best = loss(w, b)
    for _ in range(300):  # convex, so no step nearby may be better
        step = rng.normal(size=6) * 10.0 ** rng.integers(-5, 0)
        assert loss(w + step[:5], b + step[5]) >= best - 1e-6


def test_ratios_and_calibration():
    good, bad = np.array([9.0, 0, 4]), np.array([0.0, 9, 4])
    r = nbsvm.ratios(good, bad)
    assert np.allclose(r, np.log([10 / 1, 1 / 10, 1.0]))
    rng = np.random.default_rng(2)
    m = rng.normal(size=20000)
    a, b = nbsvm.sigmoid_fit(m, rng.random(20000) < 1 / (1 + np.exp(-(1.5 * m - 0.5))))
    assert abs(a - 1.5) < 0.1 and abs(b + 0.5) < 0.1


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op13_quality(spark, folder).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == q for p, q in held) / len(held) >= 0.95


def test_quality_does_not_read_held_out_labels_or_ids(spark):
    good, bad = [f"the quiet garden {i} grows on" for i in range(30)], [f"BUY!! NOW!! {i}" for i in range(30)]
    docs = frame(spark, good + bad + [None, "", "garden again", "BUY!! IT!!"])
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)] + [(None, 1), (5, None), (61, 1)], "doc_id long, quality int")
    model = nbsvm.train(spark, docs, labels)
    got = {r.doc_id: r for r in nbsvm.score(docs.withColumn("quality_score", F.lit("clash")), model).collect()}
    assert got[62].quality_score > 0.5 > got[63].quality_score and got[60].quality_score == got[61].quality_score and got[0].row == "k"
    shifted = nbsvm.score(docs.withColumn("doc_id", F.col("doc_id") + 1000), model)
    assert sorted(r.quality_score for r in shifted.collect()) == sorted(r.quality_score for r in got.values())


def test_quality_without_labels_of_both_classes(spark):
    docs, none = frame(spark, ["a b", None]), spark.createDataFrame([], "doc_id long, quality int")
    assert {r.quality_score for r in nbsvm.score(docs, nbsvm.train(spark, docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert {r.quality_score for r in nbsvm.score(docs, nbsvm.train(spark, docs, one)).collect()} == {1.0}
    assert nbsvm.score(docs.limit(0), nbsvm.train(spark, docs.limit(0), one)).count() == 0
