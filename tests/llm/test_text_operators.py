"""Operators over texts against plain Python, with the odd cases each must define."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import bpe, decontam, maxent, pii, simhash, tokenfile, toxicity
from parley.llm.queries import tokenizer_path

ODD = ["", None, " ", "a", "Hello, world! " * 3, "naïve café — 日本語 \U0001f600 \t\n x", "THE the The the", "word " * 400, "x" * 3000, "é" * 700, "0 1 22 333 4,444.5", "áb   z", "<|endoftext|> tail"]
RANKS = "byte_bpe_50k.tiktoken"


def frame(spark, texts, name="doc_id"):
    # columns whose names operators use inside
    return spark.createDataFrame([(i, t, "k", 1.0, 7) for i, t in enumerate(texts)], f"{name} long, text string, row string, score double, fp int")


@pytest.fixture(scope="module")
def sample(spark, data):
    return [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").orderBy("doc_id").limit(60).collect()]


# -- byte-level BPE -------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(tokenizer_path(RANKS)), special_tokens={})


def test_bpe_equals_the_library_and_round_trips(spark, encoding, sample):
    texts = ODD + sample
    rows = bpe.encode(frame(spark, texts), tokenizer_path(RANKS), decoded="decoded").collect()
    for r in rows:
        assert r.ids == encoding.encode_ordinary(texts[r.doc_id] or "")
        assert r.decoded == (texts[r.doc_id] or "")
    d = {r.doc_id: r for r in bpe.digests(frame(spark, texts), tokenizer_path(RANKS)).collect()}
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert d[i].n_tokens == len(ids)
        assert d[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert d[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_decodes_columns_and_replaces_clashing_names(spark, encoding):
    df = frame(spark, ODD).withColumn("ids", F.lit("clash"))
    coded = bpe.encode(df, tokenizer_path(RANKS))
    assert dict(coded.dtypes)["ids"] == "array<int>" and {"row", "score", "fp"} <= set(coded.columns)
    back = bpe.decode(coded, tokenizer_path(RANKS), "ids", "text")
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode(df.limit(0), tokenizer_path(RANKS)).count() == 0


def test_utf8_machine_is_incremental(encoding):
    codec = bpe.codec(tokenizer_path(RANKS), bpe.default_pattern())
    for raw in (b"\xf0\x9f\x98\x80", b"\xe6\x97\xa5\xff\xe6\x97", b"ok\x80\xc3", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xc3\xa9" * 5):
        text, state = "", b""
        for x in raw:
            out, state = bpe.Utf8Machine.feed(state, bytes((x,)))
            text += out
        assert text + "�" * bool(state) == raw.decode("utf-8", "replace")
        ids = [codec.machine.ranks[bytes((x,))] for x in raw]
        assert codec.decode(ids) == raw.decode("utf-8", "replace")


def test_long_pieces_leave_in_parts(encoding):
    machine = bpe.codec(tokenizer_path(RANKS), bpe.default_pattern()).machine
    for text in ("ab" * 4000, "etaoin shrdlu".replace(" ", "") * 500, "a" * 5000):
        raw = text.encode()
        got = list(machine.stream(raw[i : i + 700] for i in range(0, len(raw), 700)))
        assert got == encoding.encode_ordinary(text)


# -- token files ----------------------------------------------------------------


def test_packing_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1001):
        x = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = tokenfile.pack(x)
        assert np.array_equal(tokenfile.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n), x)


def test_token_files_equal_the_library(spark, sample):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ODD + sample + ["It's  don't WE'LL 12ab ǅ İ ΑΣ Σ. ﬁ naïve-- a|b\x1cq"]
    got = {r.doc_id: r for r in tokenfile.digests(spark, frame(spark, texts).repartition(3), path, end_id=2).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_of_repeated_null_and_no_rows(spark, monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    df = spark.createDataFrame([(5, "b"), (5, "b"), (None, "a"), (1, None)], "doc_id long, text string")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens) for r in tokenfile.digests(spark, df, path, 2).collect()))
    assert got == [(False, 0, 0, 2), (True, 1, 2, 1), (True, 5, 3, 2), (True, 5, 5, 2)]
    assert tokenfile.digests(spark, df.limit(0), path, 2).count() == 0


def test_pieces_with_blanks_of_another_tokenizer_are_kept_whole(spark, tmp_path):
    from tokenizers import Tokenizer, models

    own = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, " ": 2, "a ": 3, "a b": 4, "bb": 5}, merges=[("a", " "), ("a ", "b"), ("b", "b")]))
    own.save(str(tmp_path / "other.json"))
    texts = ["a b a", "bb a bbb", "", None, "ab  a b"]
    got = {r.doc_id: r for r in tokenfile.digests(spark, frame(spark, texts), str(tmp_path / "other.json"), end_id=5).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 5], "<u4")
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


# -- personal data --------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            v, digits = m.group(), re.sub("[^0-9]", "", m.group())
            luhn = sum(d - 9 * (d > 9) for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), n, m.end()))
    return sorted(out)


PII = [
    "a.b@c.de.f%x@y.z a@b@c.com, .@a.b.. 1.2.3.4.5 256.1.1.1 001.2.3.004 99999999999999.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111, 4111111111111111 1 41111111111111111111 é4111111111111111 4111111111111112",
    "+1 (017) 555-7713 x +12345 + 1 +1234567890123456 +49 123 4567 890.", "+1 234 567 890 4111111111111111", "\U0001d4b3 a@b.co \U0001d4b3", "a" * 20000 + "@" + "b.c" * 3000, "1 " * 3000, *ODD,
]


def test_base_spans_equal_plain_patterns(spark, sample):
    texts = PII + sample
    got = {r.doc_id: r for r in pii.detect(spark, frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [tuple(x) for x in got[i].base] == plain_spans(t)
    assert pii.detect(spark, frame(spark, texts).limit(0)).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    known = [f"please call badge number {100000 + i}@site{i % 7}.org today" for i in range(60)]
    unseen = ["please call badge number 55512345 today", "please call badge number HX-778899 now", "in the year 20240101 nothing"]
    got = {r.doc_id: r for r in pii.detect(spark, frame(spark, known + unseen)).collect()}
    found = {i: [(known + unseen)[i][s.start : s.end] for s in got[i].spans if s.kind == 4] for i in (60, 61, 62)}
    assert found == {60: ["55512345"], 61: ["HX-778899"], 62: []}
    assert all(not [s for s in got[i].spans if s.kind == 4] for i in range(60))


def test_every_base_kind_seeds_contexts(spark):
    def card(i):
        body = f"411122{i:09d}"
        digits = [int(c) for c in reversed(body)]
        body += str(-sum(d if n % 2 else 2 * d - 9 * (d > 4) for n, d in enumerate(digits)) % 10)
        return " ".join(body[k : k + 4] for k in range(0, 16, 4))

    known = [f"reach me under +1 ({100 + i}) 555-{1000 + i} today" for i in range(40)] + [f"paid by card {card(i)} then" for i in range(40)] + [f"on host address 1.2.3.{i + 10} now" for i in range(40)]
    known += [f"x 7 mail: <u{i}@site.org>" for i in range(40)]
    long_id = "7" * 90
    unseen = [("reach me under (132) 555 1352, today", "(132) 555 1352"), ("paid by card 9999 8888 7777 then", "9999 8888 7777"), ("on host address 20250101 now", "20250101"), ("x 8 mail: " + long_id, long_id), ("some plain words 20250101 now", None)]
    texts = known + [t for t, _ in unseen]
    got = {r.doc_id: r for r in pii.detect(spark, frame(spark, texts)).collect()}
    found = {i: [texts[i][s.start : s.end] for s in r.spans if s.kind == 4] for i, r in got.items()}
    assert all(got[i].base and not found[i] for i in range(len(known)))
    assert [found[len(known) + n] for n in range(len(unseen))] == [[v] * (v is not None) for _, v in unseen]


def test_a_text_of_many_numbers_stays_near_linear(spark):
    """Tens of thousands of matches and overlapping candidates in one text: sorted and cut in blocks, never pair by pair."""
    some = [f"10.0.{i % 256}.{i // 256 % 256}" if i % 3 else f"{7000000 + i} +1 234 567 {1000 + i % 9000} u{i}@x.yz" for i in range(20_000)]
    text = " ".join(some)
    row = pii.detect(spark, frame(spark, [text])).collect()[0]
    assert [tuple(x) for x in row.base] == plain_spans(text)
    short = " ".join(some[:3000])
    assert pii.redact(spark, frame(spark, [short])).collect()[0].text == plain_redaction(short)


def test_running_totals_of_any_length(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        own = [(i * 7) % 11 for i in range(n)]
        df = spark.createDataFrame([(own,)], "xs array<int>")
        sums, tops = df.select(pii.running(F.col("xs"), lambda a, x: a + x), pii.running(F.col("xs"), lambda a, x: F.greatest(a, x))).first()
        assert sums == [sum(own[:i]) for i in range(n)] and tops == [max(own[:i], default=0) for i in range(n)]


def plain_redaction(text):
    """Spans left to right; one that begins inside the last mark's text is covered by it."""
    out, at = "", 0
    for start, kind, end in plain_spans(text):
        if start >= at:
            out += text[at:start] + f"[{list(PLAIN)[kind].upper()}]"
        at = max(at, end)
    return None if text is None else out + text[at:]


def test_redaction_keeps_other_columns(spark):
    got = {r.doc_id: r for r in pii.redact(spark, frame(spark, PII)).collect()}
    assert {i: r.text for i, r in got.items()} == {i: plain_redaction(t) for i, t in enumerate(PII)}
    assert got[4].text == "\U0001d4b3 [EMAIL] \U0001d4b3" and got[0].row == "k"


# -- decontamination ------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_hits(docs, items, size=10):
    wins = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(len(w) - min(size, len(w)) + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + min(size, len(w))]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if own := wins.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def test_contamination_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["Alpha", "beta", "GAMMA", "é", "École", "z9", "the", "of", "delta-x", "K"]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(i, text(n)) for i, n in enumerate([12, 12, 10, 9, 3, 2, 1, 25])] + [(8, None), (9, "..."), (10, "")]
    items.append((11, items[0][1].upper()))
    docs = [text(int(n)) for n in rng.integers(0, 60, 80)] + [items[0][1], f"x, {items[1][1]}! {items[1][1]} y", items[7][1] + " " + items[7][1], None, "", ",,,", "--" + items[2][1] + "--", text(4000)]
    got = {r.doc_id: r for r in decontam.contamination(spark, frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for doc, want in plain_hits(list(enumerate(docs)), items).items():
        assert (got[doc].n_words, got[doc].n_hit, got[doc]["items"]) == want
        assert got[doc].n_items == len(want[2])
    long_items = [i for i in items if len(plain_words(i[1])) >= 9]
    kept = {r.doc_id for r in decontam.clean_rows(spark, frame(spark, docs), spark.createDataFrame(long_items, "item_id long, text string")).collect()}
    assert kept == {d for d, w in plain_hits(list(enumerate(docs)), long_items).items() if not w[1]}
    assert decontam.contamination(spark, frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).agg(F.sum("n_hit")).first()[0] == 0
    assert decontam.contamination(spark, frame(spark, docs).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_items_without_an_id_hit_and_are_not_named(spark):
    items = spark.createDataFrame([(None, "one two three four"), (7, "three four five six")], "item_id long, text string")
    got = decontam.contamination(spark, frame(spark, ["x one two three four y", "one two three four five six", "a"]), items).collect()
    assert {r.doc_id: (r.n_hit, r.n_items, r["items"]) for r in got} == {0: (4, 0, []), 1: (6, 1, ["7"]), 2: (0, 0, [])}
    assert [r.doc_id for r in decontam.clean_rows(spark, frame(spark, ["x one two three four y", "a"]), items).collect()] == [1]


def test_short_documents_come_once_beside_long_items(spark):
    docs = [None, "", "word", " ", "two words", "one of three words here"]
    items = spark.createDataFrame([(1, "one of three words"), (2, "a b c d e f g h i j k l")], "item_id long, text string")
    got = decontam.contamination(spark, frame(spark, docs), items).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(docs)))
    assert {r.doc_id: (r.n_words, r.n_hit) for r in got} == {0: (0, 0), 1: (0, 0), 2: (1, 0), 3: (0, 0), 4: (2, 0), 5: (5, 4)}


# -- near-duplicates ------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode())
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    label = list(range(len(fps)))
    moved = True
    while moved:
        moved = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if label[j] < label[i] and bin(fps[i] ^ fps[j]).count("1") <= 2:
                    label[i], moved = label[j], True
    return label


def test_near_duplicates_equal_brute_force(spark, sample):
    long = " ".join(f"w{i}" for i in range(400))
    texts = ODD + sample[:20] + [long, long + " extra", long.replace("w7 ", "q "), long.upper(), "", " \n"]
    fps = [plain_fingerprint(t) for t in texts]
    got = {r.doc_id: r for r in simhash.groups(spark, frame(spark, texts)).collect()}
    assert [got[i].fp % (1 << 64) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == plain_components(fps)
    kept = {r.doc_id for r in simhash.representatives(spark, frame(spark, texts)).collect()}
    assert kept == set(plain_components(fps))


@pytest.mark.parametrize("crowded", [1, 8, 10_000])
def test_segment_tables_lose_no_link(spark, monkeypatch, crowded):
    """Fingerprints that share whole segments, with and without crowded keys, against all pairs."""
    import random

    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for base in list(fps)[:12]:
        for _ in range(12):
            fps.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    half = rng.getrandbits(32)
    fps |= {half << 32 | rng.getrandbits(6) for _ in range(40)} | {rng.getrandbits(5) << 32 | half for _ in range(30)}
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {frozenset((r.a, r.b)) for r in simhash.links(spark, spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    want = {frozenset((signed(x), signed(y))) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= 2}
    assert got <= want
    join = lambda pairs: plain_join([signed(x) for x in fps], pairs)
    assert join(got) == join(want)
    if crowded == 10_000:
        assert got == want


def plain_join(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for pair in pairs:
        a, b = sorted(map(find, pair))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_links_join_chains_and_crowds(spark):
    base = 0x0123456789ABCDEF
    crowd = [base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20) if a < b] + [base]
    chain = [0xFFFF0000FFFF0000 ^ ((1 << k) - 1) for k in range(0, 40, 2)]
    fps = crowd + chain + [0, 1 << 63, 0xFFFFFFFFFFFFFFFF]
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    from parley.llm.components import components

    root = {r.node: r.root for r in components(spark, simhash.links(spark, spark.createDataFrame(signed, "fp long"))).collect()}
    mine = [root.get(s[0], s[0]) for s in signed]
    want = plain_components(fps)
    assert len({(a, b) for a, b in zip(mine, want)}) == len(set(mine)) == len(set(want))


def test_repeated_ids_keep_one_row(spark):
    df = spark.createDataFrame([(1, "same text here now"), (1, "same text here now"), (2, "same text here now"), (None, "other words are here")], "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text) for r in simhash.representatives(spark, df).collect())
    assert kept == [("1", "same text here now"), ("None", "other words are here")]
    assert simhash.groups(spark, df.limit(0)).count() == 0


# -- toxicity -------------------------------------------------------------------


def test_search_is_exact():
    rng = np.random.default_rng(2)
    vocab = [f"t{i}" for i in range(12)]
    vectors = []
    for _ in range(300):
        v = {t: float(rng.random()) for t in rng.choice(vocab, rng.integers(0, 4), replace=False)}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / norm for t, x in v.items()})
    index = toxicity.Index({t: 1.0 for t in vocab}, [i % 2 for i in range(300)], list(range(300)), vectors)
    for q in vectors[:60]:
        near = index.nearest(q, 9)
        sims = sorted(((round(sum(w * v.get(t, 0.0) for t, w in q.items()), 9), -i) for i, v in enumerate(vectors)), reverse=True)
        want = [(s, -i) for s, i in sims if s > 0][:9]
        assert [round(s, 9) for s, _ in near] == [s for s, _ in want]


def test_toxicity_learns_marked_words(spark):
    clean = [f"a quiet note number {i} about gardens and rivers" for i in range(300)]
    toxic = [f"you {w} fool number {i} go away" for i in range(60) for w in ("horrid",)]
    texts = clean + toxic + ODD
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(300 <= i < 360)) for i in range(0, 360, 2)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    index = toxicity.train(spark, df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, index).collect()}
    held = [i for i in range(1, 360, 2)]
    assert all((got[i].toxicity >= 0.5) == (i >= 300) for i in held)
    assert all(0 <= r.toxicity <= 1 for r in got.values()) and got[301].evidence[0].label == 1
    assert all(got[i].toxicity < 0.5 for i in range(360, len(texts)))
    kept = toxicity.keep_civil(spark, df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in range(len(texts)) if not 300 <= i < 360}
    blank = toxicity.train(spark, df, labels.limit(0))
    assert toxicity.score(df, blank).agg(F.max("toxicity")).first()[0] == 0
    assert toxicity.score(df.limit(0), index).count() == 0


def test_held_out_accuracy(spark, data):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("doc_id < 1000")
    index = toxicity.train(spark, docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    out = toxicity.score(docs, index).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    n, right = out.agg(F.count("*"), F.count_if((F.col("toxicity") >= 0.5) == (F.col("toxic") == 1))).first()
    assert n > 40 and right / n > 0.9


# -- language model -------------------------------------------------------------


def test_base_scores_equal_brute_force_and_model_is_better(spark):
    import math
    from collections import Counter

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300").select("doc_id", "text").collect()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, row string")
    split = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "").encode()), None]
    seen = Counter(w for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2 for w in split(t))
    n, v = sum(seen.values()), len(seen)
    got = {r.doc_id: r for r in maxent.scores(spark, df).collect()}
    base = model = 0.0
    for d, t in docs:
        words = split(t)
        assert math.isclose(got[d].base_score, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(words), sum(1 for w in words if seen[w]), n)
        assert got[d].training == (zlib.crc32(str(d).encode()) % 7 != 2) and got[d].score < 0
        if not got[d].training:
            base, model = base + got[d].base_score, model + got[d].score
    assert model > base
    assert maxent.scores(spark, df.limit(0)).count() == 0


def test_small_head_leaves_the_tail_to_the_join(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"common word{i % 50} rare{i} common") for i in range(200)], "doc_id long, text string")
    whole = {r.doc_id: (r.n_known, round(r.base_score, 9)) for r in maxent.scores(spark, df).collect()}
    monkeypatch.setattr(maxent, "HEAD", 10)
    assert {r.doc_id: (r.n_known, round(r.base_score, 9)) for r in maxent.scores(spark, df).collect()} == whole


def test_words_of_one_symbol_are_told_apart_by_the_word_before(spark):
    """Of words that share a symbol, some hundred pairs each keep to themselves; so do the words before them."""
    names = [f"{i:03d}same" for i in range(600)]
    pairs = list(zip(names[:300], names[300:]))
    docs = [(i, " ".join(f"{a} {b}" for a, b in (pairs[(i * 7 + j) % 300] for j in range(300)))) for i in range(120)]
    mates = [(f"{pairs[j][0]} {pairs[j][1]}", f"{pairs[j][0]} {pairs[j + 1][1]}") for j in range(180, 200)]
    docs += [(1000 + 2 * j + k, t) for j, both in enumerate(mates) for k, t in enumerate(both)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in maxent.scores(spark, df, training=F.col("doc_id") < 1000).collect()}
    # 191 words, of equal counts the first by name, have symbols of their own: words on both sides of that stand before others
    assert len({maxent.other(n.encode()) for n in names}) == 1
    assert all(got[1000 + 2 * j] > got[1001 + 2 * j] + 1 for j in range(20))


def test_shares_and_weights_of_pairs_add_up_to_one():
    rng = np.random.default_rng(1)
    count, used = rng.integers(1, 50, 40), rng.random((6, 40)) < 0.3  # 40 words of one symbol, behind six words
    share = (count + 1) / (count.sum() + 40 + 1)
    context, word = np.nonzero(used)
    weight, total = maxent.fit_pairs(context, share[word], rng.integers(0, 200, len(word)))
    for c in range(6):
        own = np.zeros(40)
        own[word[context == c]] = weight[context == c]
        assert abs((share * np.exp(own)).sum() + 1 / (count.sum() + 41) - np.exp(total[c])) < 1e-12
    uses = rng.integers(0, 1 << 60, (4, 1000))
    parts = dict(maxent.packed(uses, uses[3] & 255, 7))
    back = np.concatenate([maxent.unpacked(b) for b in parts.values()], axis=1)
    assert len(parts) == 7 and sorted(map(tuple, back.T)) == sorted(map(tuple, uses.T))


def test_what_is_shuffled_in_bulk_is_packed_small():
    """Sorted numbers go as differences: of uses the words before, of trigram counts the keys, of sums the rows."""
    rng = np.random.default_rng(3)
    n = 200_000
    before, word = (np.minimum(rng.zipf(1.2, n), 200_000) * 7919 % 200_003 for _ in range(2))
    before[::10] = rng.integers(1 << 61, 1 << 62, 20_000)[rng.integers(0, 20_000, n // 10)]
    uses = np.stack([before, word, np.repeat(np.arange(n // 250), 250) * 2 + 1, np.zeros(n, np.int64)])
    parts = dict(maxent.packed(uses, word % 64, 70))
    back = np.concatenate([maxent.unpacked(b) for b in parts.values()], axis=1)
    assert sorted(map(tuple, back.T)) == sorted(map(tuple, uses.T))
    assert sum(map(len, parts.values())) < 5 * n  # unsorted 5.9 bytes each
    keys, counts = np.unique(rng.integers(0, 1 << 25, 1_200_000), return_counts=True)
    blobs = [b for _, b in maxent.split(np.stack([keys, counts]), keys >> 8 & 255, 256)]
    assert sum(map(len, blobs)) < 2 * len(keys)  # rows of (key, n) took 7.6 bytes each
    one = np.array([[5], [1 << 62], [-1], [0]])
    assert (maxent.unpacked(maxent.squeezed(one)) == one).all()


def test_trigram_counts_equal_brute_force(spark):
    from collections import Counter

    texts = [" ".join(f"w{(i * j) % 23}" for j in range(40)) for i in range(60)] + [None, "", "w1"]
    single = [maxent.END, *[f"w{i}".encode() for i in range(12)]]
    own, seen = {w: i for i, w in enumerate(single)}, Counter()
    for t in texts:
        s = [maxent.START, maxent.START, *[own[w] if w in own else maxent.other(w) for w in maxent.tokens(t)]]
        seen.update(a << 17 | b << 8 | c for a, b, c in zip(s, s[1:], s[2:]))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = maxent.count_trigrams(df, single).collect()
    assert {r.key: r.n for r in got} == seen and len(got) == len(seen)
    # observed counts go along once, expected ones each round
    keys, n = np.array(sorted(seen)), np.array([seen[k] for k in sorted(seen)], float)
    both, later = maxent.Model().gradient(keys, n), maxent.Model().gradient(keys, n, observed=False)
    assert both.nbytes == 2 * later.nbytes and (both[0] == later[0]).all()
    assert np.allclose(both.sum((2, 3)), 4 * n.sum())  # four features of each trigram, at both levels


def test_rows_of_many_groups_are_added_up_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"a{(i * j) % 331} b{(i + j) % 247}" for j in range(60))) for i in range(200)], "doc_id long, text string")
    whole = {r.doc_id: (r.base_score, r.score, r.n_known) for r in maxent.scores(spark, df).collect()}
    monkeypatch.setattr(maxent, "GROUP", 300)
    monkeypatch.setattr(maxent, "USES", 50)  # fewer than the rows: a task hands its sums on several times
    monkeypatch.setattr(maxent, "HEAD", 200)
    got = {r.doc_id: (r.base_score, r.score, r.n_known) for r in maxent.scores(spark, df).collect()}
    assert got.keys() == whole.keys()
    assert all(got[d] == pytest.approx(whole[d], rel=1e-9) for d in whole)


def test_pairs_in_many_groups_score_as_in_one(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"a{(i * j) % 331} b{(i + j) % 247}" for j in range(60))) for i in range(200)], "doc_id long, text string")
    whole = {r.doc_id: tuple(round(x, 6) for x in (r.base_score, r.score, r.n_known)) for r in maxent.scores(spark, df).collect()}
    monkeypatch.setattr(maxent, "GROUP", 500)
    monkeypatch.setattr(maxent, "USES", 100)
    assert {r.doc_id: tuple(round(x, 6) for x in (r.base_score, r.score, r.n_known)) for r in maxent.scores(spark, df).collect()} == whole


def test_model_is_a_distribution():
    model = maxent.Model()
    rng = np.random.default_rng(0)
    model.classes = rng.normal(size=model.classes.shape).astype(np.float32)
    model.members = rng.normal(size=model.members.shape).astype(np.float32)
    for context in (0, 5 << 9 | 7, maxent.START << 9 | maxent.START):
        logs = model.log10(context << 8 | np.arange(256))
        assert abs((10.0**logs).sum() - 1) < 1e-5


def test_shuffled_keys_find_the_same(spark, monkeypatch):
    import random

    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(f"b{i}", text(rng.choice([1, 2, 3, 10, 14]))) for i in range(12)]
    docs = [(i, rng.choice(["", None, "w1", text(5), text(40) + " " + items[i % 12][1], items[i % 12][1] + " " + text(30)])) for i in range(60)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    whole = sorted(map(str, decontam.contamination(spark, *frames).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert sorted(map(str, decontam.contamination(spark, *frames).collect())) == whole and len(whole) == 60


def test_patterns_spread_until_nothing_grows(spark):
    """A chain of contexts, each reached only through the instances of the one before."""
    own = lambda left, step, n, seed=False: [(left, f"n{step}-{i}", seed) for i in range(n)]
    rows = own("a", 0, 2000, True) + own("b", 0, 2000) + own("b", 1, 250) + own("c", 1, 250) + own("c", 2, 30) + own("d", 2, 30) + own("e", 3, 30)
    uses = spark.createDataFrame(rows, "left string, value string, seed boolean")
    patterns, instances = pii.bootstrap(spark, uses)
    assert {r.left for r in patterns.collect()} == set("abcd")
    assert {r.value[:2] for r in instances.where("confidence >= 0.9").collect()} == {"n0", "n1", "n2"}
    again, _ = pii.bootstrap(spark, uses)
    assert sorted(map(tuple, patterns.collect())) == sorted(map(tuple, again.collect()))
    assert pii.bootstrap(spark, uses.limit(0))[0].count() == 0


def test_redaction_keeps_odd_column_names(spark):
    df = spark.createDataFrame([(1, "mail a@b.org now", 2)], "doc_id long, text string, `x.y` int")
    got = pii.redact(spark, df).collect()[0]
    assert got["text"] == "mail [EMAIL] now" and got["x.y"] == 2
