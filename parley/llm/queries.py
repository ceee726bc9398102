"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import ann, bpe, chat, decontam, fim, htmltext, maxent, nbsvm, periods, pii, simhash, tokenfile, toxicity
from parley.llm.store import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(spark, table(spark, sf_dir, "documents"))
    counts = [pii.count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.shown(F.col("base")), 256).alias("base_sha256"), pii.shown(F.col("spans")).alias("spans"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    index = toxicity.train(spark, docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    done = toxicity.score(docs, index)
    return done.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "evidence")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.format_chats(spark, table(spark, sf_dir, "conversations"))
    return done.select("conv_id", "turn", "role", "place", "rank", "json", "n_calls", "n_linked", "n_invalid")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digests(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = htmltext.main_text(spark, table(spark, sf_dir, "pages"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = maxent.scores(spark, table(spark, sf_dir, "documents"))
    return done.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = F.sha2(fim.restored(F.col("output"), F.col("form")), 256)
    return done.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


def with_cycles(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by a hash of the id, with their words from some point on replaced by a cycle of words there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def cycled(ws: Column) -> Column:
        n, g = F.size(ws), F.floor(h / 10)
        a = (g % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        rest = F.flatten(F.array_repeat(F.slice(ws, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(ws, 1, a), F.slice(rest, 1, n - a)), " ")

    looped = F.get(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, cycled(ws))), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(looped, "text")).otherwise(F.col("text")).alias("text"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = periods.runs(with_cycles(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    done = done.withColumn("_best", best)
    return done.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), (-F.col("_best.less")).alias("length"), F.col("_best.period").alias("period"),
        F.floor(-1000 * F.col("_best.less") / F.col("_best.period")).alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = nbsvm.train(spark, docs, table(spark, sf_dir, "labels").where(~nbsvm.held_out(F.col("doc_id"))))
    done = nbsvm.score(docs, model)
    return done.select("doc_id", nbsvm.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_chat": op5_chat,
    "op6_token_files": op6_token_files,
    "op7_html": op7_html,
    "op8_simhash": op8_simhash,
    "op9_maxent": op9_maxent,
    "op10_ann": op10_ann,
    "op11_fim": op11_fim,
    "op12_periods": op12_periods,
    "op13_quality": op13_quality,
}

#: DuckDB SQL of those that SQL can express.
ORACLES: dict[str, str] = {
    "op4_decontaminate": """
with iw as (select item_id::varchar as item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
wins as (select item, least(len(w), 10) as n, array_to_string(list_slice(w, i::int, (i + least(len(w), 10) - 1)::int), ' ') as k from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from iw where len(w) > 0)),
docs as (select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
pos as (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from wins)),
hit as (select distinct p.r, p.i, p.n, s.item from pos p join wins s on s.n = p.n and s.k = array_to_string(list_slice(p.w, p.i::int, (p.i + p.n - 1)::int), ' ')),
covered as (select r, count(distinct c) as n_hit from (select r, unnest(range(i, i + n)) as c from hit) group by r),
items as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (r) left join items using (r)""",
    "op5_chat": """
select conv_id, turn, coalesce(role, 'unknown') as role, turn as place, 0::int as rank,
  '{"content":' || to_json(coalesce(text, ''))::varchar || ',"role":' || to_json(coalesce(role, 'unknown'))::varchar || '}' as json,
  0::bigint as n_calls, 0::bigint as n_linked, 0::bigint as n_invalid
from conversations""",
    "op11_fim": """
with d as (select doc_id, coalesce(text, '') as x, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
r as (select doc_id, x, length(x)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select doc_id, x, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from r),
p as (select *, substring(x, 1, a) as pre, substring(x, a + 1, b - a) as mid, substring(x, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then x when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(x) as restored_sha256 from p""",
}
