"""Operators over pages, messages and vectors, and the pipeline, against plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import ann, chat, htmltext
from parley.llm import queries as llm_queries

# -- pages ----------------------------------------------------------------------

PROSE = "A sentence of the article that is long enough to be prose. "
PAGE = (
    '<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">We use cookies</div>'
    '<div class="wrap"><div class="post-%d main-text"><h1>Title &eacute;</h1><p>First  para <b>bo</b>ld<p>Second <a href=x>link</a>&nbsp;here. %s<ul><li>one<li>two</ul><form><p>Name</p></form>'
    '<div class="comments"><p>Nice post! A very long reader comment that goes on and on.</p></div></div><aside><p>Related</p></aside></div><footer>&copy; site</footer><script>if(a<b){"</p>"}</script></body></html>'
)
TEXT = "Title é First para bold Second link here. %sone two"


def test_extracts_the_article_alone():
    assert htmltext.extract(PAGE % (1, PROSE * 3)) == TEXT % (PROSE * 3)
    assert htmltext.extract("<article><header><p>by x</p><h2>Head</h2></header><p>a &lt; b &amp;c</article>") == "Head a < b &c"
    assert htmltext.extract("<body><article><p>cut of") == "cut of"
    assert htmltext.extract("plain  text\nonly") == "plain text only"
    assert htmltext.extract("<!-- <p>x</p> --><p>a<br>b</p><script>never closed <p>c") == "a b"
    for blank in ("", None, "<nav>menu</nav>", "<html></html>", "<p></p>"):
        assert htmltext.extract(blank) == ""
    assert len(htmltext.extract("<article>" + "<p>word</p>" * 20000 + "</article>")) == 20000 * 5 - 1


def test_hosts_agree_on_a_path(spark):
    rows = [(i, f"https://a.org/{i}", PAGE % (i, PROSE * 3), "x") for i in range(5)] + [(9, "not a url", PAGE % (9, PROSE), "x"), (10, None, None, "x"), (11, "https://b.org/", "<article>b</article>", "x")]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, path string")
    got = htmltext.main_text(spark, pages).collect()
    assert len(got) == 9
    by = {r.page_id: r for r in got}
    assert by[3].text == TEXT % (PROSE * 3) and by[3].path == "html>body>div.wrap>div.main-text.post-"
    assert by[9].text == TEXT % PROSE and by[9].path is None and by[10].text == "" and by[11].text == "b"
    assert htmltext.main_text(spark, pages.limit(0)).count() == 0


def test_a_page_without_its_hosts_path_keeps_its_own():
    assert htmltext.extract("<body><main><p>%s</p></main></body>" % PROSE, "html>body>div.other") == PROSE.strip()


@pytest.mark.parametrize("name", ["content no-sidebar", "post has-share", "social-science", "sidebar content", "notice-of-motion", "entry", "home with-menu"])
def test_a_class_word_alone_drops_no_article(name):
    page = f'<body class="has-sidebar menu"><nav>Home</nav><div class="{name}"><h1>T</h1><p>{PROSE * 3}</p><math><mi>x</mi></math></div><div class="comment-list"><article class="comment-body"><p>{PROSE * 9}</p></article></div></body>'
    assert htmltext.extract(page) == f"T {PROSE * 3}x"


def test_forms_and_marked_boxes_are_weighed():
    assert htmltext.extract(f'<form id="main"><p>{PROSE * 2}</p></form>') == (PROSE * 2).strip()
    assert htmltext.extract(f"<p>{PROSE * 2}</p><form><p>Your name</p></form>") == (PROSE * 2).strip()
    assert htmltext.extract(f'<div class="sidebar"><main><p>{PROSE}</p></main></div>') == PROSE.strip()
    assert htmltext.extract('<div class="comments"><p>first!</p></div>') == ""
    assert htmltext.extract('<article><p title="class=ad" data-id="ad">a<span class="ad">b</span> c <button>d</button></p></article>') == "a c"


@pytest.mark.parametrize("piece", ["<b>", "<div>", "<p>", "<td>", "<a b=\"", "<a ", "<head>", "</x>", "<", "<p><b><h2>", "<a b=\"<a c='", "<li><ul>"])
def test_time_is_in_proportion_to_broken_markup(piece):
    import time

    took = []
    for n in (20_000, 100_000):
        began = time.process_time()
        htmltext.extract(piece * n + "text")
        took.append(time.process_time() - began)
    assert took[1] < 15 * took[0] + 0.5


class PlainReader:
    """Text of the first article by the standard library's parser, without the parts that are none."""

    SKIP = ("nav", "footer", "aside", "form", "script", "style", "button", "title")
    INLINE = ("a", "b", "i", "em", "strong", "span", "code", "sub", "sup")

    def read(self, page):
        from html.parser import HTMLParser

        out, depth, skip = [], [0], [0]

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                kinds = (dict(attrs).get("class") or "").split()
                if skip[0] or tag in PlainReader.SKIP or {"ad", "comments", "related"} & set(kinds):
                    skip[0] += tag not in htmltext.VOID and tag not in ("p", "li")
                elif tag == "article":
                    depth[0] += 1
                if tag not in PlainReader.INLINE:
                    out.append(" ")

            def handle_endtag(self, tag):
                if skip[0]:
                    skip[0] -= tag not in ("p", "li")
                elif tag == "article":
                    depth[0] -= 1
                if tag not in PlainReader.INLINE:
                    out.append(" ")

            def handle_data(self, data):
                if depth[0] > 0 and not skip[0]:
                    out.append(data)

        Reader(convert_charrefs=True).feed(page or "")
        return " ".join("".join(out).split())


def test_equals_a_plain_reader_on_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in htmltext.main_text(spark, pages).collect()}
    plain = PlainReader()
    assert len(got) == len(html) and sum(map(len, got.values())) > 100_000
    assert [i for i in html if "<article" in (html[i] or "") and got[i] != plain.read(html[i])] == []


# -- chats ----------------------------------------------------------------------


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def test_calls_are_linked_ordered_and_checked(spark):
    rows = [
        (1, 0, "user", 'say "hi"'), (1, 1, "assistant", call(("b", "book", {"z": 1, "a": "${a}"}), ("a", "find", '{"q": "x", "n": 2}'))), (1, 2, "tool", result("a", "found")), (1, 3, "tool", result("b", "booked")),
        (1, 4, "assistant", call(("c", "find", {"n": "two"}))), (1, 5, "tool", result("zz", "stray")), (2, 0, "assistant", call(("a", "find", {"q": "other"}))), (2, 1, None, None), (2, 2, "assistant", "{broken"),
        (2, 3, "assistant", call(("x", "f", {"v": "${y}"}), ("y", "f", {"v": "${x}"}))), (2, 4, "assistant", call(("n", "find", [1]))),
    ]
    schemas = spark.createDataFrame([("find", ["q"], {"q": "string", "n": "integer"}), ("book", ["z"], {"z": "number"})], "name string, required array<string>, types map<string,string>")
    messages = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, rank int")
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(spark, messages, schemas).collect()}
    assert len(got) == len(rows)
    assert got[1, 0].json == '{"content":"say \\"hi\\"","role":"user"}'
    assert got[1, 1].json == '{"content":"","role":"assistant","tool_calls":[{"arguments":{"n":2,"q":"x"},"id":"a","name":"find"},{"arguments":{"a":"${a}","z":1},"id":"b","name":"book"}]}'
    assert (got[1, 1].n_calls, got[1, 1].n_linked, got[1, 1].n_invalid) == (2, 2, 0)
    assert got[1, 2].json == '{"content":"found","role":"tool","tool_call_id":"a"}' and got[1, 2].n_linked == 1 and [(got[1, t].place, got[1, t]["rank"]) for t in range(6)] == [(t, 0) for t in range(6)]
    assert (got[1, 4].n_calls, got[1, 4].n_linked, got[1, 4].n_invalid) == (1, 0, 1)
    assert got[1, 5].n_linked == 0 and got[2, 0].n_linked == 0
    assert got[2, 1].json == '{"content":"","role":"unknown"}' and got[2, 2].json == '{"content":"{broken","role":"assistant"}'
    assert got[2, 3].cycle and not got[1, 1].cycle
    assert got[2, 4].n_invalid == 1
    for r in got.values():
        json.loads(r.json)
    assert chat.format_chats(spark, messages.limit(0)).count() == 0


def test_the_query_checks_calls_against_the_tools_that_a_conversation_declares(spark, tmp_path):
    from parley.llm import queries

    def tools(*each):
        return json.dumps({"tools": [{"type": "function", "function": {"name": n, "parameters": {"type": "object", "required": r, "properties": {k: {"type": t} for k, t in p.items()}}}} for n, r, p in each]})

    plain = json.dumps({"tools": [{"name": "g", "parameters": {"required": ["k"]}}, {"name": "h"}, {"parameters": {}}, 7]})
    rows = [
        (1, 0, "system", tools(("f", ["q"], {"q": "string", "n": "integer"}))), (1, 1, "assistant", call(("a", "f", {"q": "x", "n": 2}), ("b", "f", {"n": 2}), ("c", "f", {"q": "x", "n": "two"}))), (1, 2, "tool", result("b", "y")),
        (1, 3, "system", tools(("f", [], {"n": "string"}))), (1, 4, "assistant", call(("d", "f", {"n": "two"}), ("e", "f", {"n": 2}))), (1, 5, "user", plain), (1, 6, "assistant", call(("z", "g", {}))),
        (2, 0, "assistant", call(("a", "f", {"n": "two"}), ("b", "other", [1]))), (2, 1, "system", tools(("f", ["q"], {}))), (None, 0, "system", plain), (None, 1, "assistant", call(("a", "g", {}), ("b", "h", {}), ("c", "g", {"k": None}))),
        (3, 0, "system", '{"tools": 1}'), (3, 1, "system", "{broken"), (3, 2, "assistant", call(("a", "f", {}))),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r for r in queries.op5_chat(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert {k: (r.n_calls, r.n_linked, r.n_invalid) for k, r in got.items() if r.n_calls} == {(1, 1): (3, 1, 2), (1, 4): (2, 0, 1), (1, 6): (1, 0, 0), (2, 0): (2, 0, 1), (None, 1): (3, 0, 1), (3, 2): (1, 0, 0)}
    assert json.loads(got[1, 0].json) == {"content": rows[0][3], "role": "system"}


def test_a_repeated_identifier_links_to_its_nearest_call(spark):
    rows = [(1, i, "assistant" if i % 2 == 0 else "tool", call(("a", "f", {"i": i})) if i % 2 == 0 else result("a", str(i))) for i in range(40)]
    rows += [(1, 40, "tool", result("a", "late")), (2, 0, "tool", result("a", "early")), (2, 0, "assistant", call(("a", "f", {}))), (2, 1, "tool", result("a", "mine"))]
    got = chat.format_chats(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sum(r.n_linked for r in got if r.role == "assistant") == 21
    assert [r.n_linked for r in sorted(got, key=lambda r: (r.conv_id, r.turn)) if r.role == "tool"][:20] == [1] * 20
    assert {r.json: r.n_linked for r in got if r.conv_id == 2 and r.role == "tool"} == {'{"content":"early","role":"tool","tool_call_id":"a"}': 0, '{"content":"mine","role":"tool","tool_call_id":"a"}': 1}


def cite(i, *to):
    return call((i, "f", {"v": " ".join("${%s}" % t for t in to)}))


def test_long_chains_and_cycles_are_told_apart(spark):
    rows = [(1, 16 - i, "assistant", cite(f"c{i}", *[f"c{i - 1}"] * (i > 0))) for i in range(16)] + [(1, 61, "tool", result("c15", "last"))]
    graph = {"a": "", "x": "ay", "y": "x", "between": "y", "p": ["between", "q"], "q": "p", "after": "pa", "self": ["self"]}
    rows += [(2, t, "assistant", cite(i, *to)) for t, (i, to) in enumerate(graph.items())]
    rows += [(3, 2 * i, "assistant", cite(f"c{i}", *[f"c{i - 1}"] * (i > 0))) for i in range(200)] + [(3, 2 * i + 1, "tool", result(f"c{i}", "x")) for i in range(200)]
    rows += [(4, 0, "assistant", call(*[(f"c{i}", "f", {"v": "${c%d}" % (i + 1)}) for i in range(60)])), (5, 0, "assistant", call(*[(i, "f", {"v": ["${%s}" % j for j in to]}) for i, to in graph.items()]))]
    got = chat.format_chats(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    # each of a chain told backwards may stand only from the turn of its first call on
    assert {r.turn: (r.place, r["rank"]) for r in got if r.conv_id == 1} == {16 - i: (16, i) for i in range(16)} | {61: (61, 0)}
    assert not any(r.cycle for r in got if r.conv_id == 1)
    own = {list(graph)[r.turn]: (r.place, r["rank"], r.cycle) for r in got if r.conv_id == 2}
    assert own == {"a": (0, 0, False), "x": (2, 0, True), "y": (2, 0, True), "between": (3, 0, False), "p": (5, 0, True), "q": (5, 0, True), "after": (6, 0, False), "self": (7, 0, True)}
    assert all((r.place, r["rank"], r.cycle) == (r.turn, 0, False) for r in got if r.conv_id == 3)
    inside = {r.conv_id: [c["id"] for c in json.loads(r.json)["tool_calls"]] for r in got if r.conv_id in (4, 5)}
    assert inside[4] == [f"c{i}" for i in reversed(range(60))]
    assert inside[5] == ["a", "self", "x", "y", "between", "p", "q", "after"]
    assert {r.conv_id: r.cycle for r in got if r.conv_id in (4, 5)} == {4: False, 5: True}


def plain_order(keys, after):
    """Place and rank of each node (key: its turn) behind those in ``after``, and the nodes on a cycle."""
    reach = {n: set(after.get(n, ())) for n in keys}
    for _ in keys:
        for n in reach:
            reach[n] |= {x for m in list(reach[n]) for x in reach[m]}
    home = {n: max([m for m in reach[n] if n in reach[m]] + [n]) for n in keys}
    state = {h: (max(keys[n] for n in keys if home[n] == h), 0) for h in home.values()}
    for _ in range(len(keys) + 1):
        for n in keys:
            for m in after.get(n, ()):
                if home[m] != home[n] and (keys[m] > keys[n] or state[home[m]] != (keys[m], 0)):
                    place, rank = state[home[m]]
                    state[home[n]] = max(state[home[n]], (place, rank + 1))
    return {n: state[home[n]] for n in keys}, {n for n in keys if n in reach[n]}


def plain_chat(messages):
    """Linked counts, places, ranks, cycles and call orders of one conversation of (turn, role, calls or result id)."""
    last, first, answer, linked = {}, {}, {}, {}
    for turn, role, what in messages:
        linked[turn] = 0
        if role == "assistant":
            for part, (i, _) in enumerate(what):
                first.setdefault(i, (turn, part))
                last[i] = (turn, part)
        elif what in last:
            linked[turn] = 1
            if last[what] not in answer:
                answer[last[what]] = turn
                linked[last[what][0]] += 1
            else:
                linked[turn] = 0
    after, order, inner = {}, {}, set()
    for turn, role, what in messages:
        if role != "assistant":
            continue
        names = [i for i, _ in what]
        own = {}
        for part, (_, to) in enumerate(what):
            for t in to:
                if t in names:
                    own.setdefault(part, set()).add(names.index(t))
                elif t in first:
                    after.setdefault(turn, set()).add(answer.get(first[t], first[t][0]))
        after.get(turn, set()).discard(turn)
        reach = {n: set(own.get(n, ())) for n in range(len(names))}
        for _ in names:
            for n in reach:
                reach[n] |= {x for m in list(reach[n]) for x in reach[m]}
        home = {n: min([m for m in reach[n] if n in reach[m]] + [n]) for n in reach}
        depth = dict.fromkeys(home.values(), 0)
        for _ in names:
            for n in reach:
                for m in own.get(n, ()):
                    if home[m] != home[n]:
                        depth[home[n]] = max(depth[home[n]], depth[home[m]] + 1)
        order[turn] = [names[n] for n in sorted(reach, key=lambda n: (depth[home[n]], n))]
        if any(n in reach[n] for n in reach):
            inner.add(turn)
    keys = {m[0]: m[0] for m in messages}
    if not any(p > m for m, ps in after.items() for p in ps):
        after = {}
    placed, cyclic = plain_order(keys, after)
    return {t: (linked[t], *placed[t], t in cyclic or t in inner, order.get(t)) for t in keys}


def test_random_conversations_equal_a_plain_linker(spark):
    import random

    rng, rows, want = random.Random(3), [], {}
    for conv in range(40):
        ids, messages = [f"i{j}" for j in range(rng.randint(2, 9))], []
        for turn in range(rng.randint(1, 14)):
            if rng.random() < 0.6:
                what = [(rng.choice(ids), rng.sample(ids, rng.choice([0, 0, 1, 2]))) for _ in range(rng.randint(1, 4))]
                rows.append((conv, turn, "assistant", call(*[(i, "f", {"v": ["${%s}" % t for t in to]}) for i, to in what])))
            else:
                what = rng.choice(ids)
                rows.append((conv, turn, "tool", result(what, "r")))
            messages.append((turn, rows[-1][2], what))
        want.update({(conv, t): v for t, v in plain_chat(messages).items()})
    rng.shuffle(rows)
    got = chat.format_chats(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    calls = lambda r: [c["id"] for c in json.loads(r.json)["tool_calls"]] if r.role == "assistant" else None
    assert {(r.conv_id, r.turn): (r.n_linked, r.place, r["rank"], r.cycle, calls(r)) for r in got} == want


# -- vectors --------------------------------------------------------------------


def brute(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and len(v) == 16 and np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            s, m = x @ v, ids != i
            out[i] = ids[m][np.lexsort((ids[m], -s[m]))[:k]].tolist()
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    x = centers[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    return [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]


def test_recall_and_scores(spark, vectors):
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [1.0] * 3), (2100, []), (2120, [float("inf")] + [0.0] * 15)]
    rows = spark.createDataFrame([(i, v, 1, 0) for i, v in vectors + odd], "vec_id long, embedding array<float>, rank int, list int")
    got: dict = {}
    for r in ann.search(spark, rows, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(vectors + odd, 10, 20)
    assert set(got) == set(want)
    assert all([x[0] for x in sorted(v)] == list(range(1, 11)) for v in got.values())
    assert np.mean([len({x[1] for x in got[q]} & set(want[q])) / 10 for q in want]) >= 0.9
    x = dict(vectors)
    for q, found in got.items():
        assert all(abs(s - float(np.dot(np.array(x[q]), np.array(x[i])))) < 1e-12 for _, i, s in found)


def test_recall_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got: dict = {}
    for r in ann.search(spark, table, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = []
    for i, v in rows:
        if i % 20 == 0:
            s, m = x @ v, ids != i
            found.append(len(got[i] & set(ids[m][np.lexsort((ids[m], -s[m]))[:20]].tolist())) / 20)
    assert np.mean(found) >= 0.9


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x = [[float(a) for a in v] for v in (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)]
    rows = [(i, x[0] if i % 3 == 0 else x[i % 300]) for i in range(3000)] + [(0, x[0])] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(spark, df, F.col("vec_id") % 300 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for i in range(0, 3000, 300):  # 1,040 rows have the best vector
        want = ([0] * 10) if i else [3 * j for j in range(1, 11)]
        assert [v for _, v in sorted(got[i])] == want


def test_few_and_repeated_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (20, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, ann.search(spark, df, F.col("vec_id") % 20 == 0, k=20).collect()))
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 20, 0.5), (0, 4, 2, 0.0), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 1, 0.5), (20, 4, 2, 0.5)]
    assert ann.search(spark, df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(spark, df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_pieces_do_not_change_the_result(spark, vectors, monkeypatch):
    rows = spark.createDataFrame(vectors[:400], "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "EPS0", 50.0)  # no early abandoning, so that nothing depends on where a radius comes from
    whole = sorted(map(tuple, ann.search(spark, rows, F.col("vec_id") % 20 == 0, k=5).collect()))
    monkeypatch.setattr(ann, "PIECE", 7)
    assert sorted(map(tuple, ann.search(spark, rows, F.col("vec_id") % 20 == 0, k=5).collect())) == whole


# -- registered queries and the pipeline ----------------------------------------


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLES))
def test_equals_its_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    df, rel = llm_queries.QUERIES[name](spark, data), con.sql(llm_queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    assert sorted(str([r[c] for c in order]) for r in df.collect()) == sorted(str([dict(zip(rel.columns, r))[c] for c in order]) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(llm_queries.QUERIES) - set(llm_queries.ORACLES)))
def test_queries_cover_their_tables(spark, data, name):
    n = llm_queries.QUERIES[name](spark, data).count()
    table = {"op7_html": "pages"}.get(name, "documents")
    assert n == spark.read.parquet(f"{data}/{table}.parquet").count() if name != "op10_ann" else n == 25 * 20


def test_pipeline_stages_by_brute_force(spark):
    data = "/root/testdata/sf0.01"
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from parley.llm import bpe, store
    from tests.llm.test_text_operators import plain_components, plain_fingerprint, plain_hits, plain_spans

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    held = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "decontaminate", "pii", "bpe"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        held = store.Staged(spark, stage(spark, held, data), name).df
        kept.append({r.doc_id: r for r in held.collect()})
        if name != "bpe":
            assert held.columns == docs.columns
    civil, single, clean, safe, coded = kept
    assert 0.8 * len(rows) < len(civil) < len(rows)
    ids = sorted(civil)
    groups = plain_components([plain_fingerprint(civil[i].text) for i in ids])
    assert set(single) == {ids[g] for g in groups}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    hits = plain_hits([(i, r.text) for i, r in single.items()], items)
    assert set(clean) == {i for i, h in hits.items() if not h[1]}
    assert set(safe) == set(clean) == set(coded)
    for i, r in safe.items():
        assert r.n_chars == len(r.text) and (r.text == clean[i].text) == (not plain_spans(clean[i].text))
    codec = bpe.codec(llm_queries.tokenizer_path("byte_bpe_50k.tiktoken"), bpe.default_pattern())
    assert all(coded[i].n_tokens == len(codec.encode(safe[i].text)) for i in safe)
