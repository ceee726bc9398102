"""Queries over fully recorded conversations, the store, the compiler and text search, with the SQL each must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.engine import Engine
from parley.functions import text as tx
from parley.operators import aggregate, joins, judge, searchindex, similarity
from parley.plans import answer, lower
from parley.plans import binding as bindings
from parley.plans.compiler import Compiler
from parley.queries import _SENT, _STOP, _TF, _VOCAB, _corpus, _vocabulary, query, t
from parley.sources import generator, tables

NOW = "2024-01-31 00:00:00"


def _turn(values: tuple, div: int) -> str:
    listed = ", ".join("null" if v is None else f"'{v}'" for v in values)
    return f"([{listed}])[((o_orderkey // {4 * div}) % {len(values)} + 1)::int]"


FACTS = f"""facts as (select o_orderkey as id, c_mktsegment as app, o_orderpriority as intent_key, o_totalprice as cost_usd, o_orderdate as started_at, {", ".join(f"{_turn(v, d)} as {n}" for n, d, v in bindings.RECORDED)}
from orders left join customer on o_custkey = c_custkey)"""

# -- conditions: a question, and the SQL its condition must equal -----------------

CONDITIONS = {
    "gave_up": ("How many conversations where the user gave up?", "gave_up = 'yes'"),
    "frustrated": ("conversations with frustrated or angry users", "sentiment_end in ('frustrated', 'angry')"),
    "positive": ("conversations with happy users", "sentiment_end = 'positive'"),
    "not_satisfied": ("conversations that were not resolved", "intent_satisfied = 'no'"),
    "satisfied": ("resolved conversations", "intent_satisfied = 'yes'"),
    "went_wrong": ("How many conversations failed?", "failure_mode <> 'none'"),
    "looped": ("conversations that went in circles", "failure_mode = 'tool_loop'"),
    "unverified": ("hallucinated conversations", "failure_mode in ('wrong_answer', 'hallucinated_tool') or outcome = 'hallucination'"),
    "phantom_action": ("conversations that pretended", "failure_mode = 'hallucinated_tool'"),
    "refused": ("conversations the agent refused", "failure_mode = 'refusal'"),
    "timed_out": ("conversations that timed out", "failure_mode = 'timeout'"),
    "context_overflow": ("conversations out of context", "failure_mode = 'context_overflow'"),
    "provider_error": ("conversations with upstream errors", "failure_mode = 'provider_error'"),
    "tool_error": ("conversations where a tool failed", "failure_mode = 'tool_error'"),
    "wrong_answer": ("conversations that were misunderstood", "failure_mode = 'wrong_answer'"),
    "unmet_request": ("conversations out of scope", "outcome = 'unmet request'"),
    "contradiction": ("conversations that contradict themselves", "outcome = 'contradiction'"),
    "incomplete_capture": ("conversations with partial captures", "capture_completeness <> 'complete'"),
    "guardrail_blocked": ("conversations guardrail blocked", "guardrail_status = 'blocked'"),
    "four_turns": ("long conversations", "turn_word::int >= 4"),
    "app_value": ("conversations in building", "app = 'BUILDING'"),
    "model_value": ("conversations with model-b", "model = 'model-b'"),
    "error_value": ("conversations with rate_limit_429", "error_code = 'rate_limit_429'"),
    "two_conditions": ("frustrated users who gave up on model-a", "sentiment_end in ('frustrated', 'angry') and gave_up = 'yes' and model = 'model-a'"),
    "tool_and_condition": ("resolved conversations that used Brand#13", "intent_satisfied = 'yes' and id in (select l_orderkey from lineitem join part on p_partkey = l_partkey where p_brand = 'Brand#13')"),
}


def _condition(name: str, question: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        bound = bindings.facts(spark, d)
        spec = Compiler(bound.named(question), NOW).compile(question)
        return lower.eligible(spec, bound).select(bound.get("id").alias("id"))

    run.__name__ = f"where_{name}"
    query(f"with {FACTS} select id from facts where {CONDITIONS[name][1]}")(run)


for _name, (_question, _) in CONDITIONS.items():
    _condition(_name, _question)


@query(f"with {FACTS} select outcome, model, count(*)::bigint as n, round(sum(cost_usd), 2) as cost from facts group by 1, 2")
def counts_by_two_columns(spark, d):
    bound = bindings.facts(spark, d)
    return aggregate.counts(bound.traces, {"outcome": bound.get("outcome"), "model": bound.get("model")}, {"cost": F.round(F.sum(bound.get("cost_usd")), 2)})


@query("select count(*)::bigint as n from (select o_custkey from orders group by 1 having count(*) > 10)")
def groups_above_a_count(spark, d):
    return aggregate.having(t(spark, d, "orders"), ["o_custkey"], F.count("*") > 10).agg(F.count("*").alias("n"))


@query(f"""with {FACTS} select count(*)::bigint as conversations, round(sum(cost_usd), 4) as cost, count(*) filter (gave_up = 'yes')::bigint as gave_up, count(*) filter (intent_satisfied = 'no')::bigint as unsatisfied,
round(count(*) filter (intent_satisfied = 'no') / count(*), 4) as unsatisfied_share, min(started_at) as first, max(started_at) as last from facts""")
def front_page(spark, d):
    return Engine(spark, bindings.facts(spark, d)).home()


# -- fetches and writes -----------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders where o_orderkey = 1")
def one_conversation(spark, d):
    return Engine(spark, bindings.orders(spark, d)).trace(1).select("o_orderkey", "o_totalprice")


@query("select o_orderkey from orders where o_orderkey in (1, 2, 3, 4, 5, 32)")
def fetched_rows(spark, d):
    return Engine(spark, bindings.orders(spark, d)).trace_rows([1, 2, 3, 4, 5, 32]).select("o_orderkey")


@query("""select l_linenumber, l_linestatus, count(*) over (partition by l_linestatus, l_returnflag)::bigint as repeat_count, row_number() over w::int as place, count(*) over ()::bigint as "of",
lag(l_returnflag) over w as previous, round(100 * l_extendedprice / sum(l_extendedprice) over (), 4) as cost_share from lineitem where l_orderkey = 1
window w as (order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)""")
def conversation_detail(spark, d):
    found = Engine(spark, bindings.orders(spark, d)).trace_detail(1, "l_orderkey", ("l_linenumber",), "l_returnflag", "l_linestatus", "l_extendedprice")
    return found.select("l_linenumber", "l_linestatus", "repeat_count", "place", "of", "previous", "cost_share")


def _store(spark: SparkSession) -> tables.Store:
    return tables.Store(spark, f"{tables.shared_dir(spark)}/parley/store-{uuid.uuid4().hex}")


@query("select n_nationkey, n_name from nation union all select r_regionkey, r_name from region union all select 99::bigint, 'NOWHERE'")
def store_appended(spark, d):
    store = _store(spark)
    store.append("places", t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"))
    store.append("places", t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("n_nationkey"), F.col("r_name").alias("n_name")))
    return store.append("places", spark.createDataFrame([(99, "NOWHERE")], "n_nationkey long, n_name string"))


@query("select n_nationkey, case when n_regionkey = 1 then 'changed' else n_name end as n_name, n_regionkey from nation")
def store_upserted(spark, d):
    store, nation = _store(spark), t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    store.append("places", nation)
    return store.upsert("places", nation.where("n_regionkey = 1").withColumn("n_name", F.lit("changed")), ["n_nationkey"])


@query("select n_nationkey, case when n_regionkey = 1 then 'changed' else n_name end as n_name, n_regionkey from nation union all select n_nationkey + 100, 'changed', null from nation where n_regionkey = 1")
def store_columns_upserted(spark, d):
    """On a known key only the name is updated, and the new row's other values are not taken; rows of new keys are added."""
    store, nation = _store(spark), t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    store.append("places", nation)
    near = nation.where("n_regionkey = 1").select("n_nationkey", F.lit("changed").alias("n_name"), F.lit(None).cast("int").alias("n_regionkey"))
    far = near.withColumn("n_nationkey", (F.col("n_nationkey") + 100).cast(nation.schema["n_nationkey"].dataType))
    return store.upsert("places", near.unionByName(far), ["n_nationkey"], ["n_name"])


@query("select n_nationkey, case when n_nationkey = 3 then 'x' else n_name end as n_name, case when n_regionkey = 2 then n_regionkey + 10 else n_regionkey end::bigint as n_regionkey, 'none' as note from nation")
def store_updated(spark, d):
    """An update by key, a column update from another table, and a migration that adds a column."""
    store, nation = _store(spark), t(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    store.append("places", nation)
    store.update("places", "n_nationkey", 3, n_name="x")
    store.update_column("places", nation.where("n_regionkey = 2").withColumn("n_regionkey", F.col("n_regionkey") + 10), "n_nationkey", "n_regionkey")
    return store.migrate("places", {"note": "none"})


@query("select n_nationkey, n_name from nation where n_nationkey < 5 union all select 77::bigint, 'new' ")
def store_inserted_or_ignored(spark, d):
    store, nation = _store(spark), t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    store.append("places", nation)
    store.clear("places")
    store.insert_missing("places", nation.where("n_nationkey < 5"), ["n_nationkey"])
    return store.insert_missing("places", spark.createDataFrame([(3, "ignored"), (77, "new")], "n_nationkey long, n_name string"), ["n_nationkey"])


@query("select n_nationkey, 'The ' || lower(n_name) || ' desk of ' || n_name || ' {open}' as said from nation")
def filled_slots(spark, d):
    return t(spark, d, "nation").select("n_nationkey", generator.fill(F.lit("The {low} desk of {name} {open}"), {"low": F.lower("n_name"), "name": F.col("n_name")}).alias("said"))


@query("select doc_id, toxic::int as toxic, case when toxic is null then 0 else 1 end::int as known from documents left join (select doc_id, max(toxic) as toxic from labels group by 1) using (doc_id)")
def values_with_conversations(spark, d):
    """Stored values beside their conversations; conversations without one stay."""
    values = t(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return joins.beside(t(spark, d, "documents").select("doc_id"), values, "doc_id").select("doc_id", "toxic", F.col("toxic").isNotNull().cast("int").alias("known"))


# -- text -------------------------------------------------------------------------

_STEM = r"""case when length({w}) <= 3 then {w} when length({w}) > 4 and {w} like '%ies' then left({w}, -3) || 'y' when regexp_matches({w}, '(ss|x|z|ch|sh)es$') then left({w}, -2) when regexp_matches({w}, '[^su]s$') then left({w}, -1)
when length({w}) > 4 and {w} like '%ied' then left({w}, -3) || 'y' when length({w}) > 5 and regexp_matches({w}, '[aeiouy].*ing$') then case when regexp_matches(left({w}, -3), '(bb|dd|gg|mm|nn|pp|rr|tt)$') then left({w}, -4) else left({w}, -3) end
when length({w}) > 4 and regexp_matches({w}, '[aeiouy].*ed$') then case when regexp_matches(left({w}, -2), '(bb|dd|gg|mm|nn|pp|rr|tt)$') then left({w}, -3) else left({w}, -2) end else {w} end""".replace("\n", " ")
_WORDS = f"w as (select doc_id, unnest(list_filter(regexp_extract_all(lower(text), '{tx.TOKEN}'), lambda w: w not in ({_STOP}))) as word from documents)"


@query(f"with {_WORDS}, n as (select word, count(*) as n, {_STEM.format(w='word')} as stem from w group by 1) select stem, arg_min(word, (-n, word)) as word from n group by 1")
def spelled_stems(spark, d):
    return tx.surface_forms(t(spark, d, "documents"), "text")


@query(f"with {_WORDS}, s as (select distinct doc_id, {_STEM.format(w='word')} as token from w) select token, count(*)::bigint as df from s group by 1")
def stem_frequencies(spark, d):
    """Document frequencies of stems, counted inside the rows by the plain stemmer."""
    return tx.counted_frequencies(tx.term_counts(tables.spread(t(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", stems=True, bigrams=False))


_ASKED = "(values ('worthless', 1.0), ('clown', 2.0), ('nosuchword', 1.0))"


@query(f"""with {_TF}, {_VOCAB}, w as (select id, token, (1 + ln(tf)) * idf as w from tf join vocab using (token)), u as (select id, token, w / sqrt(sum(w * w) over (partition by id)) as w from w),
q as (select token, a * idf as q from {_ASKED} as a(token, a) join vocab using (token)), m as (select token, q / (select sqrt(sum(q * q)) from q) as q from q)
select id, round(sum(w * q), 4) as score from u join m using (token) group by 1 having round(sum(w * q), 4) > 0.02""")
def ranked_search(spark, d):
    corpus, asked = _corpus(spark, d), {"worthless": 1.0, "clown": 2.0, "nosuchword": 1.0}
    return similarity.search(corpus.postings(list(asked)), corpus.vocab, asked)


@query(f"""with {_TF}, {_VOCAB}, w as (select id, token, (1 + ln(tf)) * idf as w from tf join vocab using (token)), u as (select id, token, w / sqrt(sum(w * w) over (partition by id)) as w from w),
q as (select token, a * idf as q from {_ASKED} as a(token, a) join vocab using (token)), m as (select token, q / (select sqrt(sum(q * q)) from q) as q from q)
select id, round(sum(w * q), 4) as score from u join m using (token) group by 1 having round(sum(w * q), 4) > 0.02 order by score desc, id limit 25""")
def stored_search(spark, d):
    """The best 25 of ``ranked_search`` from an index in shared storage."""
    counts, vocab = _vocabulary(spark, d)
    folder = f"{tables.shared_dir(spark)}/parley/index-{uuid.uuid4().hex}"
    searchindex.write(folder, tx.weighted_rows(counts, vocab, vocab.count()), vocab)
    return searchindex.StoredIndex(spark, folder).search({"worthless": 1.0, "clown": 2.0, "nosuchword": 1.0}, 25).rows


@query(f"""with {_TF}, {_VOCAB}, w as (select id, token, (1 + ln(tf)) * idf as w from tf join vocab using (token)), u as (select id, token, w / sqrt(sum(w * w) over (partition by id)) as w from w),
s as (select id, round(sum(case token when 'worthless' then 0.8 * w else 0.6 * w end), 6) as s, bool_or(token = 'clown') as g from u where token in ('worthless', 'clown') group by 1)
select doc_id as id, case when coalesce(g, false) then s else 0.0 end as score from documents left join s on id = doc_id""")
def gated_scores(spark, d):
    """Judge scores: overlap over the question's norm, zero without a gate term."""
    asked = {"worthless": 0.8, "clown": 0.6}
    return judge.score(_corpus(spark, d).postings(list(asked)), t(spark, d, "documents").select(F.col("doc_id").alias("id")), asked, ["clown"])


@query(f"""with {_TF}, {_VOCAB}, w as (select id, token, (1 + ln(tf)) * idf as w from tf join vocab using (token)), u as (select id, token, w / sqrt(sum(w * w) over (partition by id)) as w from w),
s as (select id, round(sum(case token when 'worthless' then 0.8 * w else 0.6 * w end), 6) as s, bool_or(token = 'clown') as g from u where token in ('worthless', 'clown') group by 1),
v as (select vec_id as id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as v from embeddings),
c as (select a.id, greatest(list_inner_product(a.v, b.v), 0.0) as c from v a, v b where b.id = 0)
select doc_id as id, round(0.8 * case when coalesce(g, false) then s else 0.0 end + 0.2 * coalesce(c, 0.0), 6) as score from documents left join s on s.id = doc_id left join c on c.id = doc_id""")
def dense_mixed_scores(spark, d):
    """Lexical scores with the dense part; the vectors are given ones, the question's is that of row 0."""
    own = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return judge.with_dense(gated_scores(spark, d), own, own.where("id = 0").first().v)


@query()
def dense_judged_rows(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return judge.judge(docs, "does the user call someone a worthless idiot?", dense=192)[0]


@query("""with s as (select doc_id as id, n_chars / 1000.0 as score from documents), c as (select greatest(0.20 * (select avg(score) from (select score from s order by score desc limit 3)), 0.02, avg(score) + 2 * stddev_pop(score)) as c, stddev_pop(score) as d from s)
select id, score >= c as value, round(least(0.97, 0.5 + 0.47 * least(1.0, 2.6 * abs(score - c) / d)), 6) as confidence from s cross join c""")
def cut_verdicts(spark, d):
    scores = t(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 1000.0).alias("score"))
    return judge.verdicts(scores, *judge.cut(scores)).select("id", "value", "confidence")


@query("""with a as (select doc_id as id, n_chars / 20000.0 as s from documents), b as (select doc_id as id, (doc_id % 7) / 7.0 as s from documents where doc_id % 3 = 0)
select a.id, round(0.4 * a.s + 0.6 * coalesce(b.s, 0), 6) as score from a left join b using (id)""")
def mixed_scores(spark, d):
    docs = t(spark, d, "documents")
    own = docs.select(F.col("doc_id").alias("id"), (F.col("n_chars") / 20000.0).alias("score"))
    return judge.mix(own, docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7 / 7.0).alias("score")))


@query("""with r as (select doc_id as id, source as g, row_number() over (partition by source order by n_chars desc, doc_id) as r, count(*) over (partition by source) as n from documents) select id, g as "group", r::int as rank from r where r <= greatest(3, floor(n * 0.7))""")
def core_rows(spark, d):
    ranked = aggregate.place_in_group(t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group"), "n_chars"), "group", F.desc("n_chars"), F.asc("id"))
    return similarity.core(ranked).select("id", "group", "rank")


@query(r"""with d as (select doc_id as id, source as g, n_chars::double as v, trim(regexp_extract(text, '^[^.?!\n]*[.?!]*', 0), ' ') as q, text from documents),
k as (select * from d where length(q) > 12 and contains(text, q) and not regexp_matches(q, '[0-9@_-]') and not contains(q, chr(10))),
f as (select g, lower(regexp_replace(trim(q, ' '), '\s+', ' ', 'g')) as norm, arg_min({'id': id, 'quote': q, 'v': v}, (-v, id)) as r from k group by 1, 2)
select g as group_key, r.id as id, r.quote as quote, row_number() over (partition by g order by r.v desc, r.id)::int as place from f qualify place <= 3""")
def distinct_quotes(spark, d):
    """Quotes of the answer for texts whose first sentence is plain words."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars", "text")
    first = F.trim(F.regexp_extract("text", r"^[^.?!\n]*[.?!]*", 0))
    plain = docs.where((F.length(first) > 12) & ~first.rlike("[0-9@_-]"))
    return answer.quotes(plain.select("id", F.col("source").alias("group_key"), F.col("n_chars").cast("double").alias("value")), plain, groups=1000)


@query(f"select count(*)::bigint as sentences from ({_SENT}) where trim(s) <> ''")
def sentence_count(spark, d):
    parts = F.filter(F.split("text", r"[.?!;\n]+"), lambda s: F.trim(s) != "")
    return t(spark, d, "documents").agg(F.sum(F.size(parts)).alias("sentences"))
