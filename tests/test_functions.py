from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from parley.functions import scalar
from parley.functions import text as tx
from parley.sources import tables


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_aspect_keys(spark):
    raw = ["true", "false", "null", None, "3.0", "0.1", "1234567.0", "0.00001", "-12", '"  late delivery "', '""']
    want = ["yes", "no", "unknown", "unknown", "3", "0.1", "1.23457e+06", "1e-05", "-12", "late delivery", "unknown"]
    got = [r.k for r in spark.createDataFrame(list(enumerate(raw)), "i int, v string").select("i", scalar.aspect_key(F.col("v")).alias("k")).orderBy("i").collect()]
    assert got == want


def test_weeks_start_on_monday(spark):
    days = ["2024-01-01", "2024-01-07", "2024-01-08", "2023-01-01", "2023-01-02"]
    got = [r.w for r in spark.createDataFrame([(d,) for d in days], "d string").select(scalar.week(F.to_timestamp("d")).alias("w")).collect()]
    assert got == ["2024-W01", "2024-W01", "2024-W02", "2023-W00", "2023-W01"]


def test_display(spark):
    v = F.lit(0.05)
    assert one(spark, scalar.shown_value(v, "usd", F.lit(0.05))) == "$0.0500"
    assert one(spark, scalar.shown_value(F.lit(1234.5), "usd", F.lit(2000.0))) == "$1,234.50"
    assert one(spark, scalar.shown_value(F.lit(1500.0), "ms", v)) == "1.5s"
    assert one(spark, scalar.shown_value(F.lit(3.0), "plain", v)) == "3"
    assert one(spark, scalar.humanise(F.lit("tool_loop"))) == "Tool loop"
    assert one(spark, scalar.humanise(F.lit("2024-01-02"))) == "2024-01-02"


def test_search_escapes_wildcards(spark):
    rows = spark.createDataFrame([("100%",), ("1000",), (None,)], "s string")
    assert [r.s for r in rows.where(scalar.contains_any([F.col("s")], "0%")).collect()] == ["100%"]


def test_stems(spark):
    words = ["orders", "classes", "cities", "booking", "stopped", "bus", "is", "tried", "running", "less"]
    got = [r.x for r in spark.createDataFrame([(w,) for w in words], "w string").select(tx.stem(F.col("w")).alias("x")).collect()]
    assert got == ["order", "class", "city", "book", "stop", "bus", "is", "try", "run", "less"]


def test_bigrams_stay_in_sentences(spark):
    got = one(spark, tx.tokens(F.lit("Refund my order. Late parcel")))
    assert got == ["refund", "order", "refund_order", "late", "parcel", "late_parcel"]


def test_redaction(spark):
    texts = ["Mail a@b.com or A@B.com, not c@d.org.", "Call +49 170 1234567 now", "key sk-abcdef123456", "nothing 12 here", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.r for r in tx.redact(rows, "t", "r").orderBy("i").collect()]
    assert got == ["Mail [EMAIL_1] or [EMAIL_1], not [EMAIL_2].", "Call [PHONE_1] now", "key [SECRET_1]", "nothing 12 here", "", None]


def test_literal_quotes(spark):
    rows = spark.createDataFrame([("late", "it was late"), ("Late", "it was late"), ("", "x"), ("a@b.com", "mail a@b.com"), (None, "x")], "q string, s string")
    assert [r.x for r in rows.select(tx.literal_quote(F.col("q"), F.col("s")).alias("x")).collect()] == [True, False, False, False, False]


def test_labels_and_quotes(spark):
    assert one(spark, tx.first_sentence_label(F.lit("Where is it? I paid."))) == "Where is it"
    assert one(spark, tx.first_sentence_label(F.lit("word " * 40))).endswith("…")
    assert one(spark, tx.select_quote(F.lit("Hi. Where is my order?"), F.lit("No."), F.lit(1))) == "Where is my order?"


def test_secrets_and_repeats_are_redacted(spark):
    import re

    from parley.functions import text as tx

    rows = ["sk-live-9f2b71c4ad55e0 and SK-LIVE-9F2B71C4AD55E0", "password-abcdef123456 bearer_Zz9Zz9Zz9Zz9 access_token-0123456789ab rk-aaaaaaaaaaaa", "api_key-v2_0123456789 secret-short call +1 (555) 123-4567 or 555 123 4567 89, mail A@b.co a@B.CO", "", "plain"]

    def plain(text):
        for kind, pattern in tx.REDACTIONS:
            seen = {}
            text = re.sub(pattern, lambda m, kind=kind, seen=seen: seen.setdefault(m[0].lower(), f"[{kind}_{len(seen) + 1}]"), text)
        return text

    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    got = {r.i: (r.redacted, r.personal) for r in tx.redact(df, "text").withColumn("personal", tx.has_personal_data(F.col("text"))).collect()}
    assert {i: r for i, (r, _) in got.items()} == {i: plain(t) for i, t in enumerate(rows)}
    assert "password" not in got[1][0] and [p for _, p in (got[i] for i in range(5))] == [True, True, True, False, False]
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").where("text is not null")
    assert [r.redacted for r in tx.redact(data, "text").collect()] == [plain(r.text) for r in data.collect()]


def test_counted_terms_equal_the_tokens_of_columns(spark):
    from parley.functions import text as tx

    docs = spark.createDataFrame([(0, "Refunded twice! The refunds, classes; stopping trying cities a b."), (1, None), (2, ""), (3, "running running run.run ÀÉ x2 boxes buzzes")], "id long, text string")
    for stems in (False, True):
        want = sorted(map(tuple, tx.term_frequencies(docs, "id", tx.tokens(F.col("text"), stems=stems)).collect()))
        assert sorted(map(tuple, tx.term_rows(tx.term_counts(docs, "id", "text", stems=stems)).collect())) == want
    counts = tx.term_counts(docs, "id", "text")
    vocab = tx.vocabulary(tx.counted_frequencies(counts), F.lit(4))
    shown = lambda df: sorted((r.id, r.token, round(r.weight, 9)) for r in df.collect())
    assert shown(tx.weights(counts, vocab, vocab.count())) == shown(tx.weights(counts, vocab))


@pytest.mark.parametrize(("master", "named"), [("spark://host:7077", None), ("spark://host:7077", "hdfs://host/shared/"), ("local[4]", None)])
def test_a_cluster_needs_a_shared_folder(master, named):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context)
    if named or master.startswith("local"):
        assert tables.shared_dir(session) == (named or tables.LOCAL_DEFAULT).rstrip("/")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_dir(session)
