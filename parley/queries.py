"""Registered queries of the engine's own operators, and the DuckDB SQL each must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import scalar
from parley.functions import text as tx
from parley.operators import aggregate, cluster, joins, judge, similarity, spans, sparse, svd
from parley.operators.corpus import Corpus
from parley.operators.scan import scan
from parley.plans import binding as bindings
from parley.plans import lower
from parley.plans.compiler import Compiler
from parley.sources import tables
from parley.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.read(spark, d, name)


def _ask(spark: SparkSession, d: str, question: str, now: str = "2024-01-31 00:00:00", bind=bindings.orders) -> DataFrame:
    bound = bind(spark, d)
    found = lower.groups(Compiler(bound.named(question, ("app",)), now).compile(question), bound)
    return found.withColumns({"total": F.round("total", 2), "value": F.round("value", 2)})  # sums of doubles depend on their order


ORDERS = "from orders join customer on o_custkey = c_custkey"
FOLD = """select coalesce(h.k, '__other__') as group_key, sum(g.n)::bigint as count, round(sum(g.s), 2) as total, round({value}, 2) as value, round(sum(g.n) / any_value(a.n), 6) as share
from g cross join a left join h on h.k = g.k group by 1"""


def folded(rows: str, value: str, keep: int, rank: str) -> str:
    return f"with r as ({rows}), g as (select k, count(*) as n, sum(v) as s, max(v) as m from r group by k), a as (select sum(n) as n from g), h as (select k from g order by {rank} desc, n desc, k limit {keep}) " + FOLD.format(value=value)


# -- layer 1: recorded columns --------------------------------------------------


@query(folded(f"select c_mktsegment as k, o_totalprice as v {ORDERS}", "sum(g.s)", 12, "s"))
def l1_app_cost(spark, d):
    return _ask(spark, d, "Which app costs the most?")


@query(folded(f"select o_orderpriority as k, coalesce(o_totalprice, 0.0) as v {ORDERS}", "sum(g.s) / sum(g.n)", 12, "s / n"))
def l1_average(spark, d):
    return _ask(spark, d, "average cost by failure mode")


@query(folded(f"select o_orderpriority as k, o_totalprice as v {ORDERS}", "max(g.m)", 12, "m"))
def l1_max(spark, d):
    return _ask(spark, d, "maximum cost by failure mode")


@query(folded(f"select o_orderkey::varchar as k, o_totalprice as v {ORDERS}", "sum(g.s)", 10, "s"))
def l1_which_conversation(spark, d):
    return _ask(spark, d, "Which conversation costs the most?")


def trend(fmt: str) -> str:
    return f"select {fmt} as group_key, count(*)::bigint as count, count(*)::double as total, count(*)::double as value, round(count(*) / (select count(*) from events), 6) as share from events group by 1"


@query(trend("strftime(ts, '%Y-%m-%d')"))
def l1_by_day(spark, d):
    return _ask(spark, d, "conversations per day", bind=bindings.events)


@query(trend("strftime(ts, '%Y-W%W')"))
def l1_by_week(spark, d):
    return _ask(spark, d, "conversations week over week", bind=bindings.events)


@query(trend("strftime(ts, '%H')"))
def l1_by_hour(spark, d):
    return _ask(spark, d, "conversations hourly", bind=bindings.events)


@query(folded(f"select distinct p_brand as k, o_orderkey as id, o_totalprice as v {ORDERS} join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey", "sum(g.s)", 12, "s"))
def l1_tool_bridge(spark, d):
    return _ask(spark, d, "Which tool costs the most?")


@query("""select event_type as group_key, count(*)::bigint as count, round(sum(value), 2) as total, round(sum(value), 2) as value, round(count(*) / (select count(*) from events where ts >= timestamp '2024-01-31 00:00:00' - interval 168 hour), 6) as share
from events where ts >= timestamp '2024-01-31 00:00:00' - interval 168 hour group by 1""")
def l1_time_window(spark, d):
    return _ask(spark, d, "cost by app in the last 7 days", bind=bindings.events)


@query("select count(*)::bigint as denominator, round(sum(o_totalprice), 2) as value_sum, round(avg(o_totalprice), 2) as value_mean from orders")
def l1_totals(spark, d):
    found = aggregate.totals(aggregate.rows_of(t(spark, d, "orders"), F.col("o_orderkey"), None, F.col("o_totalprice")))
    return found.select("denominator", F.round("value_sum", 2).alias("value_sum"), F.round("value_mean", 2).alias("value_mean"))


@query("""select coalesce(o_orderstatus, 'unknown') as group_key, count(*)::bigint as count, round(sum(v), 2) as total, round(avg(v), 2) as value, round(count(*) / (select count(*) from orders), 6) as share
from (select o_orderstatus, case when o_orderpriority = '1-URGENT' then 0.0 else o_totalprice end as v from orders) group by 1""")
def l1_null_counts_as_zero(spark, d):
    rows = t(spark, d, "orders").withColumn("v", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")))
    found = aggregate.by_value(aggregate.grouped(aggregate.rows_of(rows, F.col("o_orderkey"), F.col("o_orderstatus"), F.col("v")), "avg"))
    return found.withColumns({"total": F.round("total", 2), "value": F.round("value", 2)})


@query("""select coalesce(o_orderstatus, 'unknown') as group_key, count(*)::bigint as count, round(coalesce(sum(v), 0), 2) as total, round(avg(v), 2) as value, round(count(*) / (select count(*) from orders where o_totalprice < 400000), 6) as share
from (select o_orderstatus, case when o_orderpriority <> '1-URGENT' then o_totalprice end as v from orders where o_totalprice < 400000) group by 1""")
def l1_average_of_known(spark, d):
    rows = t(spark, d, "orders").withColumn("v", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")))
    kept = aggregate.rows_of(rows, F.col("o_orderkey"), F.col("o_orderstatus"), F.col("v"), F.col("o_totalprice") < 400000, null_as_zero=False)
    return aggregate.grouped(kept, "avg").withColumns({"total": F.coalesce(F.round("total", 2), F.lit(0.0)), "value": F.round("value", 2)})


@query("""select p_partkey from part where p_name ilike '%e\\_%' escape '\\' or p_type ilike '%br%' or p_brand ilike '%br%'""")
def filter_search(spark, d):
    parts = t(spark, d, "part")
    return parts.where(scalar.contains_any([F.col("p_name")], "e_") | scalar.contains_any([F.col("p_type"), F.col("p_brand")], "BR")).select("p_partkey")


@query("select doc_id from documents where lang <> 'en' and source = 'src1' and n_chars >= 1000")
def filter_conjunction(spark, d):
    return t(spark, d, "documents").where((F.col("lang") != "en") & (F.col("source") == "src1") & (F.col("n_chars") >= 1000)).select("doc_id")


@query("""select o_orderkey, o_totalprice from orders where exists (select 1 from lineitem join part on p_partkey = l_partkey where l_orderkey = o_orderkey and p_brand = 'Brand#11')""")
def tool_filter(spark, d):
    bound = bindings.orders(spark, d)
    return joins.having(bound.traces.withColumn("id", F.col("o_orderkey")), bound.bridge, "id", F.col("tool") == "Brand#11").select("o_orderkey", "o_totalprice")


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def pending_rows(spark, d):
    return joins.pending(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id").select("doc_id")


@query("""select c_custkey, count(o_orderkey)::bigint as n from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F' group by 1""")
def left_join_counts(spark, d):
    orders = t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.child_counts(t(spark, d, "customer").select("c_custkey"), orders, "c_custkey", F.col("o_orderstatus") == "F")


@query("""with n as (select doc_id, quality, toxic from labels where toxic = 1), u as (select * from labels where doc_id not in (select doc_id from n) union all select doc_id, 9, toxic from n) select doc_id::bigint as doc_id, quality::int as quality, toxic::int as toxic from u""")
def upsert_values(spark, d):
    old = t(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    return joins.upsert(old, old.where("toxic = 1").withColumn("quality", F.lit(9)), ["doc_id"])


@query("""select doc_id, 0::int as quality from documents where doc_id not in (select doc_id from labels) union all select doc_id, quality::int from labels""")
def insert_missing(spark, d):
    labels = t(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return joins.insert_missing(labels, t(spark, d, "documents").select("doc_id", F.lit(0).alias("quality")), ["doc_id"])


@query("""select case when v is null then 'unknown' else v::varchar end as group_key, count(*)::bigint as n, sum(coalesce(v, 1))::double as total
from (select json_extract(props, '$.k')::bigint as v from events) group by 1""")
def json_value_groups(spark, d):
    rows = t(spark, d, "events").select(F.get_json_object("props", "$.k").alias("v"))
    return rows.groupBy(scalar.aspect_key(F.col("v")).alias("group_key")).agg(F.count("*").alias("n"), F.sum(scalar.aspect_value(F.coalesce("v", F.lit("null")))).alias("total"))


@query("""select r_name, upper(left(r_name, 1)) || lower(substr(r_name, 2)) as label, '$' || printf('%.2f', 12.5) as shown from region""")
def display_text(spark, d):
    return t(spark, d, "region").select("r_name", scalar.humanise(F.col("r_name")).alias("label"), scalar.shown_value(F.lit(12.5), "usd", F.lit(12.5)).alias("shown"))


# -- groups, profiles, pages ----------------------------------------------------


@query("""with r as (select o_orderpriority as k, o_orderstatus as s, c_mktsegment as a, o_totalprice as v from orders join customer on o_custkey = c_custkey),
p as (select k, count(*)::bigint as n, count(*) filter (s = 'F')::bigint as resolved, round(sum(v), 2) as cost, round(avg(v), 2) as mean from r group by k),
m as (select k, s as top_status from (select k, s, row_number() over (partition by k order by count(*) desc, s) as i from r group by k, s) where i = 1),
x as (select k, string_agg(a, ',' order by i) as top_apps from (select k, a, row_number() over (partition by k order by count(*) desc, a) as i from r group by k, a) where i <= 3 group by k)
select k, n, resolved, cost, mean, top_status, top_apps from p join m using (k) join x using (k)""")
def group_profile(spark, d):
    rows = bindings.orders(spark, d).traces.select(F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("s"), F.col("c_mktsegment").alias("a"), F.col("o_totalprice").alias("v"))
    sized = aggregate.profile(rows, "k", {"resolved": F.col("s") == "F"}, {"cost": F.col("v")}, {"mean": F.col("v")})
    mode = aggregate.top_per_group(rows, "k", "s", 1).select("k", F.col("s").alias("top_status"))
    apps = aggregate.top_list(rows, "k", "a", 3, "apps").select("k", F.array_join("apps", ",").alias("top_apps"))
    return sized.join(mode, "k").join(apps, "k").withColumns({"cost": F.round("cost", 2), "mean": F.round("mean", 2)})


def _standout_rows(spark, d):
    rows = t(spark, d, "orders").select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("group_key"), (F.col("o_orderpriority") == "1-URGENT").alias("gave_up"), (F.col("o_orderstatus") == "F").alias("resolved"),
        F.col("o_totalprice").alias("cost"), F.when(F.col("o_custkey") % 40 < 3, 9).otherwise(2).alias("turns"), F.col("o_orderstatus").alias("failure"),
    )
    sized = aggregate.profile(rows, "group_key", {"gave_up": F.col("gave_up"), "resolved": F.col("resolved")}, {"cost": F.col("cost")}, {"turns": F.col("turns")})
    return sized.join(aggregate.top_per_group(rows, "group_key", "failure", 1).select("group_key", F.col("n").alias("top_failure_n")), "group_key")


@query("""with r as (select 'c' || (o_custkey % 40) as g, o_orderpriority = '1-URGENT' as gave_up, o_orderstatus = 'F' as resolved, o_totalprice as cost, case when o_custkey % 40 < 3 then 9 else 2 end as turns, o_orderstatus as f from orders),
p as (select g, count(*) as n, count(*) filter (gave_up) as gu, count(*) filter (resolved) as rs, sum(cost) as cost, avg(turns) as turns from r group by g),
f as (select g, max(n) as fn from (select g, f, count(*) as n from r group by g, f) group by g),
b as (select count(*) as groups, sum(n) as n, sum(gu) / sum(n) as gu, sum(rs) / sum(n) as rs, sum(cost) / sum(n) as cost, sum(turns * n) / sum(n) as turns from p),
e as (select p.*, f.fn, b.n as bn, b.gu as bgu, b.rs as brs, b.cost as bcost, b.turns as bturns from p join f using (g) cross join b where b.groups >= 2 and b.n >= 20 and p.n >= greatest(5.0, b.n * 0.02)),
s as (select g, 'gave_up' as kind, round(gu / n / bgu, 6) as lift, gu as c from e where bgu > 0.02 and gu >= 4 and gu / n >= 1.5 * bgu
 union all select g, 'cost', round(cost / n / bcost, 6), n from e where bcost > 0 and cost / n >= 1.6 * bcost
 union all select g, 'failure', round(fn / n, 6), fn from e where n >= 8 and fn >= 0.7 * n
 union all select g, 'unresolved', round(1 + brs, 6), n from e where n >= 8 and rs = 0 and brs > 0.1
 union all select g, 'turns', round(turns / bturns, 6), n from e where n >= 8 and bturns > 0 and turns >= 1.5 * bturns),
o as (select *, row_number() over (partition by g order by lift desc, kind desc) as i from s)
select kind, g as group_key, lift, c::bigint as count from o where i = 1 order by lift desc, g limit 3""")
def standouts(spark, d):
    return aggregate.standouts(_standout_rows(spark, d))


@query("""select 'outcome' as field, o_orderstatus as key, count(*)::bigint as n from orders group by 2 union all select 'failure_mode', o_orderpriority, count(*)::bigint from orders group by 2 union all select 'app', c_mktsegment, count(*)::bigint from orders join customer on o_custkey = c_custkey group by 2""")
def facets(spark, d):
    from parley.engine import Engine

    return Engine(spark, bindings.orders(spark, d)).facets()


@query("select count(*)::bigint as conversations, round(sum(o_totalprice), 4) as cost, min(o_orderdate) as first, max(o_orderdate) as last from orders")
def home(spark, d):
    from parley.engine import Engine

    return Engine(spark, bindings.orders(spark, d)).home()


@query("select o_orderkey, o_orderdate from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 25 offset 50")
def page(spark, d):
    from parley.engine import Engine

    return Engine(spark, bindings.orders(spark, d)).list_traces(equal={"outcome": "F"}, page=2).select("o_orderkey", "o_orderdate")


@query("select distinct c_mktsegment as v from customer where c_mktsegment is not null and c_mktsegment <> ''")
def catalogue(spark, d):
    return bindings.orders(spark, d).catalogue(("app",)).where("field = 'app'").select(F.col("value").alias("v"))


@query("select l_suppkey, count(distinct l_partkey)::bigint as parts from lineitem group by 1")
def distinct_counts(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))


@query("""with k as (select o_orderstatus = 'F' as p, o_totalprice > 150000 as a from orders), c as (select count(*) filter (p and a) as tp, count(*) filter (p and not a) as fp, count(*) filter (not p and a) as fn, count(*) filter (not p and not a) as tn from k)
select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round(tp / (tp + fp), 6) as "precision", round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c""")
def confusion(spark, d):
    return aggregate.confusion(t(spark, d, "orders"), F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000)


@query("select sum(n)::bigint as rows, count(*)::bigint as clusters, round(sum(b) / sum(n), 6) as purity from (select source, max(n) as b, sum(n) as n from (select source, lang, count(*) as n from documents group by 1, 2) group by 1)")
def purity(spark, d):
    return aggregate.purity(t(spark, d, "documents"), "source", "lang")


@query("""select round(avg(n_chars), 6) as mean, round(stddev_pop(n_chars), 6) as deviation, round(quantile_cont(n_chars::double, 0.5), 6) as median, round((select avg(n_chars) from (select n_chars from documents order by 1 desc limit 3)), 6) as peak from documents""")
def threshold_statistics(spark, d):
    return aggregate.threshold(t(spark, d, "documents"), "n_chars")


@query("""select doc_id, toxic::int as value, quality::double as confidence, i::int as place from (select doc_id, toxic, quality, row_number() over (partition by toxic order by quality desc, doc_id) as i from labels) where i <= 5""")
def verification_sample(spark, d):
    rows = t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("value"), F.col("quality").cast("double").alias("confidence"))
    return judge.sample(rows).withColumnRenamed("id", "doc_id")


# -- spans ----------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_returnflag, count(*) over (partition by l_orderkey, l_returnflag)::bigint as repeat_count from lineitem")
def span_repeats(spark, d):
    return spans.repeats(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey", "l_returnflag")


@query("select l_orderkey, l_linenumber, l_returnflag, lag(l_returnflag) over w as previous, lead(l_returnflag) over w as next from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)")
def span_neighbours(spark, d):
    return spans.neighbours(t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag", "previous", "next")


@query("select l_orderkey, l_linenumber, array_to_string(list(l_returnflag) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows between 2 preceding and 2 following), '') as around from lineitem")
def span_around(spark, d):
    return spans.around(t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_returnflag").select("l_orderkey", "l_linenumber", F.array_join("around", "").alias("around"))


@query("select l_orderkey, l_linenumber, round(100 * l_extendedprice / sum(l_extendedprice) over (partition by l_orderkey), 4) as cost_share from lineitem")
def span_cost_share(spark, d):
    return spans.cost_share(t(spark, d, "lineitem"), "l_orderkey", "l_extendedprice").select("l_orderkey", "l_linenumber", "cost_share")


@query("select l_orderkey, l_returnflag, array_to_string(list(l_linenumber + 1 order by l_linenumber), ',') as positions from lineitem group by 1, 2")
def span_positions(spark, d):
    return spans.positions(t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag").withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query("select l_orderkey, l_linenumber, round(coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding), 0), 4) as running from lineitem")
def span_running(spark, d):
    return spans.running(t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_quantity").select("l_orderkey", "l_linenumber", "running")


@query("""with m as (select *, case when lag(event_type) over w is not distinct from event_type and row_number() over w > 1 then 0 else 1 end as c from events window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(c) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as island from m)
select user_id, island::bigint as island, event_type, count(*)::bigint as n, round(sum(value), 4) as value from i group by 1, 2, 3""")
def span_islands(spark, d):
    return spans.islands(t(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type"], ["value"])


@query("""select conv_id, turn, role, lag(role) over w as before, lead(role, 2) over w as behind, row_number() over w as place,
  (sum(length(text)) over (partition by conv_id order by turn nulls first, role nulls first, text nulls first rows between unbounded preceding and 1 preceding))::bigint as chars_before, (sum(length(text)) over (partition by conv_id))::bigint as chars
from conversations window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first)""")
def turn_scan(spark, d):
    """Each turn with its neighbours, its place and the characters before it, of conversations of any length."""
    turns = t(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.length("text").cast("long").alias("n"))
    out = scan(turns, "conv_id", ["turn", "role", "text"]).shift(before=("role", 1), behind=("role", -2)).place("place").before(chars_before="n").whole(chars="n").done()
    return out.withColumn("place", F.col("place").cast("long")).drop("text", "n")


@query("""select conv_id, count(*)::bigint as spans, count(*) filter (role = 'user')::bigint as turns, arg_max(role, turn) as last_role, arg_min(text, turn) as opening,
arg_max(text, turn) filter (role = 'user') as last_user_text, coalesce(string_agg(text, ' ' order by turn) filter (role = 'user'), '') as user_text from conversations group by 1""")
def trace_shape(spark, d):
    return spans.trace_shape(t(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("""select conv_id, concat_ws(' ', arg_min(text, turn), coalesce(string_agg(text, ' ' order by turn) filter (role in ('user', 'assistant', 'error')), '')) as document,
coalesce(arg_min(text, turn) filter (role = 'user'), '') as user_document, coalesce(string_agg(text, ' ' order by turn) filter (role = 'user'), '') as intent_document, coalesce(string_agg(text, ' ' order by turn) filter (role = 'user'), '') as user_full_document from conversations group by 1""")
def document_variants(spark, d):
    return spans.documents(t(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("""select date_trunc('day', ts) as start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2""")
def tumbling_windows(spark, d):
    return ingest.tumbling(t(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""with m as (select *, case when ts < lag(ts) over w + interval 30 minute then 0 else 1 end as c from events window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(c) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as s from m)
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*)::bigint as n from i group by user_id, s""")
def event_sessions(spark, d):
    return ingest.sessions(t(spark, d, "events")).withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


# -- text -----------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_SENT = "select doc_id, unnest(regexp_split_to_array(text, '[.?!;\\n]+')) as s from documents"
_TOK = f"select doc_id, list_filter(regexp_extract_all(lower(s), '{tx.TOKEN}'), lambda w: w not in ({_STOP})) as w from ({_SENT})"
_GRAMS = f"select doc_id, unnest(w) as token from ({_TOK}) union all select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) from ({_TOK}) where len(w) > 1"
_TF = f"tf as (select doc_id as id, token, count(*) as tf from ({_GRAMS}) group by 1, 2), nd as (select count(*) as n from documents)"
_VOCAB = "vocab as (select token, count(*) as df, ln((1 + any_value(n)) / (1 + count(*))) + 1 as idf from tf cross join nd group by token having count(*) >= case when any_value(n) > 20 then 2 else 1 end and count(*) <= greatest(2.0, any_value(n) * 0.55))"


def _counts(spark, d):
    return tx.term_counts(tables.spread(t(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def _tf(spark, d):
    return tx.term_rows(_counts(spark, d))


def _vocabulary(spark, d):
    counts = tables.held(_counts(spark, d), "counts")
    return counts, tables.held(tx.vocabulary(tx.counted_frequencies(counts), F.lit(counts.count())), "vocabulary")


def _corpus(spark, d, vectors: bool = False):
    return Corpus(tables.spread(t(spark, d, "documents").select("doc_id", "text")), "doc_id", numbers=vectors, many=vectors)


@query(f"with {_TF} select id as doc_id, token, tf::bigint as tf from tf")
def term_frequencies(spark, d):
    return _tf(spark, d).withColumnRenamed("id", "doc_id")


@query(f"with {_TF}, {_VOCAB} select token, df::bigint as df, round(idf, 6) as idf from vocab")
def vocabulary(spark, d):
    docs = t(spark, d, "documents")
    return tx.vocabulary(tx.counted_frequencies(_counts(spark, d)), F.lit(docs.count())).select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"with {_TF}, {_VOCAB}, w as (select id, token, (1 + ln(tf)) * idf as w from tf join vocab using (token)) select id, token, round(w / sqrt(sum(w * w) over (partition by id)), 6) as weight from w")
def tfidf_weights(spark, d):
    return _corpus(spark, d).postings().select("id", "token", F.round("weight", 6).alias("weight"))


@query(f"""with {_TF}, c as (select lang as g, token, sum(tf) as n from tf join documents on doc_id = id group by 1, 2), s as (select *, sum(n) over (partition by g) as gn, sum(n) over (partition by token) as tn, sum(n) over () as a from c)
select g as "group", token, n::bigint as n, round(n / gn * ln(1 + (n / gn) / ((tn - n + 1) / (greatest(a - gn, 1) + 1))) * case when contains(token, '_') then 1.8 else 1.0 end, 8) as weight from s where n >= 2""")
def class_weights(spark, d):
    # counts of a row's terms carry its language, so that only (language, token) is shuffled
    terms = tx.term_rows(tx.term_counts(tables.spread(t(spark, d, "documents").select("lang", "text")), "lang", "text"))
    counted = tables.held(terms.groupBy(F.col("id").alias("group"), "token").agg(F.sum("tf").alias("n")), "counted")
    return tx.class_tfidf(counted).select("group", "token", "n", F.round("weight", 8).alias("weight"))


@query()
def redaction(spark, d):
    out = tx.redact(tables.spread(t(spark, d, "documents").select("doc_id", "text")), "text")
    return out.select("doc_id", "redacted", (F.col("text") != F.col("redacted")).alias("changed"), tx.has_personal_data(F.col("text")).alias("personal"))


@query()
def stems_and_aliases(spark, d):
    docs = t(spark, d, "documents")
    vocab = tx.vocabulary(tx.document_frequencies(docs, tx.tokens(F.col("text"), stems=True, bigrams=False)), F.lit(docs.count()))
    return tx.aliases(tables.held(vocab, "vocabulary"))


# -- similarity, groups, judgments ----------------------------------------------

_UNIT = "u as (select vec_id as id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as v from embeddings)"
_NEAR = f"{_UNIT}, p as (select a.id as l, b.id as r, round(list_inner_product(a.v, b.v), 6) as sim from u a join u b on a.id <> b.id), nn as (select l, r, sim, row_number() over (partition by l order by sim desc, r) as rank from p qualify rank <= 5)"


@query(f'with {_NEAR} select l as "left", r as "right", sim, rank::int as rank from nn')
def nearest_neighbours(spark, d):
    return similarity.knn(t(spark, d, "embeddings"), "vec_id", "embedding", 5)


@query(f'with {_NEAR} select a.l as "left", a.r as "right" from nn a join nn b on a.l = b.r and a.r = b.l where a.l < a.r and a.sim >= 0.30')
def mutual_links(spark, d):
    return similarity.mutual(similarity.knn(t(spark, d, "embeddings"), "vec_id", "embedding", 5), 0.30).select("left", "right")


@query(f"""with recursive {_NEAR}, e as materialized (select a.l, a.r from nn a join nn b on a.l = b.r and a.r = b.l where a.sim >= 0.30), reach(id, node) as (select id, id from u union select reach.id, e.r from reach join e on reach.node = e.l)
select id, min(node)::bigint as component from reach group by 1""")
def linked_components(spark, d):
    vectors = t(spark, d, "embeddings")
    links = similarity.mutual(similarity.knn(vectors, "vec_id", "embedding", 5), 0.30)
    return similarity.components(vectors.select(F.col("vec_id").alias("id")), links)


@query()
def vector_groups(spark, d):
    return cluster.kmeans_cosine(t(spark, d, "embeddings"), "vec_id", "embedding", 10)[0]


@query()
def emergent_groups(spark, d):
    return cluster.graph_clusters(tables.held(_corpus(spark, d).postings(), "postings"), t(spark, d, "documents").select(F.col("doc_id").alias("id")))


@query()
def semantic_search(spark, d):
    corpus, asked = _corpus(spark, d), {"worthless": 1.0, "clown": 1.0}
    return similarity.search(corpus.postings(list(asked)), corpus.vocab, asked)


@query()
def judged_rows(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return judge.judge(docs, "does the user call someone a worthless idiot?")[0]


@query(f"""with {_TF}, {_VOCAB}, w as (select id, token, (1 + ln(tf)) * idf as w from tf join vocab using (token)), u as (select id, token, w / sqrt(sum(w * w) over (partition by id)) as w from w),
p as (select a.id as l, b.id as r, round(sum(a.w * b.w), 6) as sim from u a join u b using (token) where a.id <> b.id group by 1, 2), k as (select l, r, row_number() over (partition by l order by sim desc, r) as rank from p where sim > 0 qualify rank <= 5)
select l as "left", r as "right", rank::int as rank from k""")
def text_neighbours(spark, d):
    rows, _, parts = _corpus(spark, d, vectors=True).vectors()
    return sparse.vector_neighbours(rows, 5, parts=parts).select("left", "right", "rank")


@query(f"""with {_UNIT}, e as (select id, i, v[i] as w from (select id, v, unnest(range(1, 65)) as i from u)), g as (select vec_id as id, label as g from embeddings),
s as (select g, i, sum(w) as w from e join g using (id) group by 1, 2), c as (select g, i, w / sqrt(sum(w * w) over (partition by g)) as c from s),
r as (select id, g, round(sum(e.w * c.c), 6) as sim from e join g using (id) join c using (g, i) group by 1, 2)
select id, g as "group", sim, row_number() over (partition by g order by sim desc, id)::int as rank from r""")
def centroid_ranks(spark, d):
    vectors = similarity.unit(t(spark, d, "embeddings"), "vec_id", "embedding")
    flat = vectors.select("id", F.posexplode("v").alias("i", "weight")).select("id", F.col("i").cast("string").alias("token"), "weight")
    return similarity.centroid_rank(flat, t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group")))


@query("select o_custkey, arg_max(o_orderkey, o_orderkey) as o_orderkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus from orders group by 1")
def latest_rows(spark, d):
    return joins.latest(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("v")), ["o_custkey"], "v").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""select case when quality = 1 then 'yes' else 'no' end as group_key, count(*)::bigint as count, sum(toxic)::double as total, count(*)::double as value, round(count(*) / (select count(*) from labels), 6) as share from labels group by 1""")
def yes_before_no(spark, d):
    rows = t(spark, d, "labels").select(scalar.aspect_key((F.col("quality") == 1).cast("string")).alias("group_key"), F.col("toxic").cast("double").alias("value"))
    return aggregate.yes_first(aggregate.grouped(rows))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders) intersect select c_custkey from customer where c_acctbal > 0 except select o_custkey from orders where o_orderstatus = 'P'")
def set_operations(spark, d):
    customers, orders = t(spark, d, "customer"), t(spark, d, "orders")
    served = joins.members(customers, orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")
    return served.intersect(customers.where("c_acctbal > 0").select("c_custkey")).subtract(orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query(r"""select doc_id, case when length(s) <= 78 then s else regexp_replace(substr(s, 1, 78), '\s+\S*$', '') || '…' end as label
from (select doc_id, regexp_replace(coalesce(list_filter(list_transform(regexp_extract_all(text, '[^.?!\n]*[.?!]+|[^.?!\n]+'), lambda x: trim(x)), lambda x: x <> '')[1], ''), '[.?!]+$', '') as s from documents)""")
def sentence_labels(spark, d):
    return tables.spread(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", tx.first_sentence_label(F.col("text")).alias("label"))


@query(r"""select conv_id, turn, q is not null and q <> '' and contains(text, q) and not regexp_matches(q, '[0-9@_-]') as literal
from (select conv_id, turn, text, list_filter(list_transform(regexp_extract_all(text, '[^.?!\n]*[.?!]+|[^.?!\n]+'), lambda x: trim(x)), lambda x: x <> '')[1] as q from conversations)""")
def literal_quotes(spark, d):
    """Opening sentences; the conversations hold no digits or addresses, so none is personal data."""
    quote = F.get(tx.sentences(F.col("text")), F.lit(0))
    return t(spark, d, "conversations").select("conv_id", "turn", tx.literal_quote(quote, F.col("text")).alias("literal"))


@query("""select o_orderpriority, o_custkey, n::bigint as n, i::int as rank from (select o_orderpriority, o_custkey, count(*) as n, row_number() over (partition by o_orderpriority order by count(*) desc, o_custkey) as i from orders group by 1, 2) where i <= 3""")
def top_per_group(spark, d):
    return aggregate.top_per_group(t(spark, d, "orders"), "o_orderpriority", "o_custkey", 3)


@query("""select o_orderkey, (row_number() over (order by o_totalprice desc, o_orderkey) - 1)::bigint as place from orders""")
def ranked_places(spark, d):
    return cluster.place(t(spark, d, "orders"), F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "place")


@query("""select time_bucket(interval 6 hour, ts) as start, count(*)::bigint as n from events group by 1""")
def bucketed_events(spark, d):
    return ingest.sliding(t(spark, d, "events"), "6 hours", "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""select conv_id, string_agg(text, ' ' order by turn) as said, count(*)::bigint as n from conversations where role = 'assistant' group by 1""")
def scoped_texts(spark, d):
    own = t(spark, d, "conversations").where("role = 'assistant'")
    return spans.trace_shape(own, "conv_id", "turn", "role", "text", user="assistant").select("conv_id", F.col("user_text").alias("said"), F.col("turns").alias("n"))


@query()
def answer_quotes(spark, d):
    from parley.plans import answer

    rows = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group_key"), F.col("n_chars").cast("double").alias("value"))
    return answer.quotes(rows, t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query()
def group_names(spark, d):
    corpus = _corpus(spark, d)
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    assigned = docs.select("id", F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), F.col("lang")), F.lit(0)).cast("int").alias("cluster"))
    return cluster.names(docs.select("id", "text"), assigned, corpus.postings(), tables.held(corpus.vocab, "vocabulary"))


@query()
def dense_projection(spark, d):
    vectors, n_terms, _ = _corpus(spark, d, vectors=True).vectors()
    rows = tables.held(vectors, "vectors")
    return svd.encode(rows, svd.fit(rows, n_terms))


# -- sources --------------------------------------------------------------------


@query("select count(*)::bigint as rows from nation")
def row_count(spark, d):
    return tables.fingerprint(t(spark, d, "nation")).select("rows")


@query("select n_nationkey, n_name, n_regionkey, 'none' as note from nation")
def migrated_columns(spark, d):
    store = tables.Store(spark, f"{tables.shared_dir(spark)}/parley/store-{uuid.uuid4().hex}")
    store.append("places", t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    return store.migrate("places", {"note": "none"})


@query("""with s as (select conv_id as trace_id, turn, case role when 'user' then 'user_message' when 'assistant' then 'assistant_message' else 'tool_call' end as type, text from conversations),
c as (select trace_id, max(n) as n from (select trace_id, text, count(*) as n from s where type = 'tool_call' group by 1, 2) group by 1)
select trace_id, count(*) filter (type = 'user_message')::bigint as turns, count(*) filter (type = 'tool_call')::bigint as tool_calls, round(sum(length(text)) / 1000.0, 6) as cost_usd, sum(length(text))::bigint as tokens_input,
  greatest(sum(length(text)), 400)::bigint as duration_ms, arg_max(type, turn) as last_span_type, arg_min(text, turn) as user_request, case arg_max(type, turn) when 'user_message' then 'user' else 'agent' end as ended_by, coalesce(any_value(c.n), 0)::bigint as repeated_identical_calls
from s left join c using (trace_id) group by 1""")
def derived_traces(spark, d):
    """The trace columns of the ingest contract from turns as spans; turns of neither party count as tool calls."""
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "assistant_message").otherwise("tool_call")
    size = F.char_length("text").cast("long")
    own = t(spark, d, "conversations").select(
        F.col("conv_id").alias("trace_id"), F.col("turn").alias("idx"), kind.alias("type"), F.when(kind == "tool_call", "notice").alias("name"), F.col("text").alias("content_redacted"),
        (size / 1000.0).alias("cost_usd"), size.alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"), size.alias("duration_ms"), F.lit(None).cast("string").alias("error_code"),
    )
    return spans.derived_columns(own).select("trace_id", "turns", "tool_calls", "cost_usd", "tokens_input", "duration_ms", "last_span_type", "user_request", "ended_by", "repeated_identical_calls")


import parley.recorded_queries  # noqa: E402,F401  registers more
