"""The engine: ask in words, get an answer whose every number has its rows.

``plan`` compiles and relaxes a question, ``run`` lowers it along its path and
assembles the answer, and the listing functions serve what a reader drills into.
"""

from __future__ import annotations

import math
import re
from http import HTTPStatus

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import scalar
from parley.functions import text as tx
from parley.operators import aggregate, cluster, joins, searchindex, similarity, spans
from parley.operators import judge as judges
from parley.operators.aspects import Aspects, Judge
from parley.plans import answer as answers
from parley.plans import binding as bindings
from parley.plans import lower, registry
from parley.plans.binding import Binding
from parley.plans.compiler import Compiler, QuerySpec, inherit
from parley.sources.tables import Store, held, spread

STATUSES = ("awaiting_confirmation", "queued", "evaluating", "aggregating", "synthesizing", "complete", "paused_budget", "paused_provider", "failed")


class Engine:
    def __init__(self, spark: SparkSession, binding: Binding, store: Store | None = None, now: str = "2024-01-31 00:00:00", judge: Judge | None = None, budget: float | None = None, dims: int = 192, errors: dict[str, tuple[str, str]] | None = None, index: str | None = None):
        """``judge`` judges rows in place of the local one, as long as it has cost less than ``budget``.

        ``dims`` is the number of directions of the dense part of local judgments and of ``encode``; 0 leaves it out.
        ``errors`` (code to title and text) is what a deployment knows of its error codes.
        ``index`` is a folder that ``write_index`` has filled: searches read it, and build nothing.
        """
        self.spark, self.binding, self.store = spark, binding, store
        self.aspects = Aspects(store) if store else None
        self.now, self.judge, self.budget = now, judge, budget
        self._values: DataFrame | None = None
        self._text: tuple[DataFrame, ...] | None = None
        self._alias: DataFrame | None = None
        self.dims, self._index, self.errors = dims, None, errors or {}
        self.stored = searchindex.StoredIndex(spark, index) if index else None

    # -- questions ------------------------------------------------------------

    def plan(self, question: str, parent: QuerySpec | None = None) -> tuple[QuerySpec, list[str]]:
        """The typed query, and the labels of conditions dropped because nothing met them all."""
        if self._values is None:
            self._values = held(bindings.phrased(self.binding.catalogue()), "values")
        spec = Compiler(bindings.named(self._values, question), self.now).compile(question)
        if parent:
            spec = inherit(spec, parent)
        spec.predicates = [p for p in spec.predicates if p.bridge and self.binding.bridge is not None or not p.bridge and self.binding.has(p.build)]
        metric = registry.METRICS[spec.metric]
        if not self.binding.has(metric.build):
            spec.metric, spec.aggregate = "traces", "count"
        if spec.group_by and not registry.DIMENSIONS[spec.group_by].bridge and not self.binding.has(registry.DIMENSIONS[spec.group_by].build):
            spec.group_by = None
        spec, dropped = lower.relax(spec, self.binding)
        spec.broad = spec.path == "layer2_cluster" and not spec.predicates and not spec.focus
        return spec, [p.label for p in dropped]

    def run(self, spec: QuerySpec, dropped: list[str] | None = None) -> answers.Answer:
        if spec.path == "layer2_cluster" and self.binding.text:
            return self._clusters(spec, dropped or [])
        if spec.path == "layer3_aspect" and self.binding.text and self.aspects:
            return self._judged(spec, dropped or [])
        rows = lower.rows(spec, self.binding)
        return self._assemble(spec, lower.groups(spec, self.binding), rows, registry.METRICS[spec.metric].unit, dropped or [])

    def ask(self, question: str, parent: QuerySpec | None = None) -> answers.Answer:
        return self.run(*self.plan(question, parent))

    def estimate(self, spec: QuerySpec, rows_per_second: float = 800.0) -> dict:
        """Rows to judge and seconds it should take."""
        n = lower.eligible(spec, self.binding).count() if spec.path == "layer3_aspect" else 0
        return {"rows": n, "seconds": round(n / rows_per_second, 1)}

    def docs(self, kept: DataFrame | None = None) -> DataFrame:
        rows = self.binding.traces if kept is None else kept
        return rows.select(self.binding.get("id").alias("id"), F.coalesce(F.col(self.binding.text), F.lit("")).alias("text"))

    def semantic(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(docs, vocabulary, postings) of the binding's text, built once."""
        if self._text is None:
            docs = held(spread(self.docs()), "docs")
            counts = held(tx.term_counts(docs, "id", "text", stems=True), "counts")
            self._alias = held(tx.alias_rows(counts), "aliases")
            counts = held(tx.aliased_counts(docs, counts, self._alias), "counts")
            vocab = held(tx.vocabulary(tx.counted_frequencies(counts), F.lit(docs.count())), "vocabulary")
            self._text = docs, vocab, held(tx.weights(counts, vocab, vocab.count()), "postings")
        return self._text

    def index(self) -> judges.Index:
        """What the local judge needs of the binding's text, ids as text; built once, its dense space too."""
        if self._index is None:
            self._index = judges.index(self.docs().withColumn("id", F.col("id").cast("string")), self.dims)
        return self._index

    def encode(self, question: str) -> list[float]:
        """A question in the dense space of the binding's text, at unit length."""
        own = self.index()
        words = tx_words(question, {})
        idf = {r.token: r.idf for r in own.vocab.where(F.col("token").isin(words or [""])).collect()}
        return own.space.query({w: (1 + math.log(words.count(w))) * idf[w] for w in dict.fromkeys(words) if w in idf}) if own.space else []

    def similar_in_meaning(self, question: str, size: int = 25) -> DataFrame:
        """Rows (id, score) of the conversations nearest to a question in the dense space, best first."""
        query = self.encode(question)
        found = similarity.pair_scores(self.index().space.vectors, "id", "v", query) if any(query) else self.index().docs.select("id", F.lit(0.0).alias("score")).limit(0)
        return found.select("id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "id").limit(size)

    def _aliases(self, words: list[str]) -> dict[str, str]:
        """The index's aliases of a question's words."""
        stems = [tx.plain_stem(w) for w in words]
        return {r.token: r.base for r in self._alias.where(F.col("token").isin(stems or [""])).collect()}

    def _clusters(self, spec: QuerySpec, dropped: list[str]) -> answers.Answer:
        docs, vocab, postings = self.semantic()
        ids = lower.eligible(spec, self.binding).select(self.binding.get("id").alias("id"))
        if spec.focus:
            n = ids.count()
            focus = tx.folded(spec.focus, True, self._aliases(spec.focus), {})
            idf = {r.token: r.idf for r in vocab.where(F.col("token").isin(focus)).collect()}  # a question's words
            hits = similarity.search(postings, vocab, dict.fromkeys(cluster.topical(focus, idf), 1.0), floor=0.0)
            narrowed = similarity.focus(held(ids.join(hits, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score")), "focus"), n)
            ids = narrowed.select("id") if narrowed is not None else ids
        own = postings.join(ids, "id", "left_semi")
        found = held(cluster.graph_clusters(held(own, "own"), ids), "clusters")
        named = cluster.names(docs, found, own, vocab)
        rows = found.select("id", F.col("cluster").cast("string").alias("group_key"), F.lit(1.0).alias("value"))
        groups = aggregate.by_value(aggregate.fold_tail(aggregate.grouped(rows), spec.limit))
        labels = {str(r.cluster): (r.label, r.terms) for r in named.where(F.col("cluster") < spec.limit).collect()}
        return self._assemble(spec, groups, rows, "count", dropped, labels)

    def evaluate(self, spec: QuerySpec) -> str:
        """Judges what has no value yet; the id of the question asked of each row."""
        if not (self.binding.text and self.aspects):
            return ""
        aspect = self.aspects.ensure(spec.aspect_question)
        self.aspects.evaluate(aspect, self.docs(), self.judge, self.binding.said, self.budget, self.index)
        return aspect

    def _judged(self, spec: QuerySpec, dropped: list[str]) -> answers.Answer:
        kept = lower.eligible(spec, self.binding)
        aspect = self.evaluate(spec)
        rows = self.aspects.of(aspect).select("id", scalar.aspect_key(F.col("value_json")).alias("group_key"), F.col("confidence").alias("value"))
        return self._assemble(spec, self.aspects.groups(aspect, kept.select(self.binding.get("id").alias("id"))), rows, "count", dropped)

    def _assemble(self, spec: QuerySpec, groups: DataFrame, rows: DataFrame, unit: str, dropped: list[str], labels: dict | None = None) -> answers.Answer:
        work = groups._jdf.queryExecution().simpleString()
        got = [r.asDict() for r in answers.labelled(groups, unit).collect()]  # at most a head and its tail, or one row a period
        for g in got:
            if labels and g["group_key"] in labels:
                g["label"], g["terms"] = labels[g["group_key"]]
                g["subtitle"] = cluster.subtitle(g["terms"])
        denominator = sum(g["count"] for g in got)
        every = self.binding.traces.count()
        said = []
        if self.binding.text and got:
            said = [r.asDict() for r in answers.quotes(rows.withColumn("id", F.col("id").cast("string")), self.docs().withColumn("id", F.col("id").cast("string"))).collect()]
        found = self.profiles(spec)
        standouts, went = [], ""
        if found is not None and got:
            found = held(found, "profiles")
            standouts = [r.asDict() for r in aggregate.standouts(found).collect()]
            lead = found.where(F.col("group_key") == got[0]["group_key"]).first()
            went = answers.outcome(lead.asDict() | {"count": lead.n}, lambda key: key.replace("_", " ")) if lead else ""
        told = " ".join(x for x in (answers.interpretation(spec, got), went) if x)
        return answers.Answer(spec, denominator, max(0, every - denominator), got, standouts, said, answers.headline(spec, got, denominator), told, answers.suggestions(spec, got), dropped, work)

    def profiles(self, spec: QuerySpec) -> DataFrame | None:
        """Profiles of the groups of a grouped recorded-column answer."""
        needed = ("user_gave_up", "intent_satisfied", "cost_usd", "turns", "failure_mode")
        if not spec.group_by or registry.DIMENSIONS[spec.group_by].bridge or not all(self.binding.has(lambda get, f=f: get(f)) for f in needed):
            return None
        g = self.binding.get
        base = lower.eligible(spec, self.binding).select(scalar.group_key(registry.DIMENSIONS[spec.group_by].build(g)).alias("group_key"), *[g(f).alias(f) for f in needed])
        base = held(base, "profile")
        sized = aggregate.profile(base, "group_key", {"gave_up": F.col("user_gave_up"), "resolved": F.col("intent_satisfied") == "yes"}, {"cost": F.col("cost_usd")}, {"turns": F.col("turns")})
        mode = aggregate.top_per_group(base.where("failure_mode <> 'none'"), "group_key", "failure_mode", 1).select("group_key", F.col("failure_mode").alias("top_failure"), F.col("n").alias("top_failure_n"))
        return sized.join(mode, "group_key", "left").withColumn("top_failure_n", F.coalesce("top_failure_n", F.lit(0)))

    # -- conversations --------------------------------------------------------

    def list_traces(self, text: str = "", equal: dict[str, str] | None = None, ids: DataFrame | None = None, page: int = 0, size: int = 25) -> DataFrame:
        """One page, newest first and then by id; a search text is matched in any text column."""
        rows = self.binding.traces.withColumn("_id", self.binding.get("id"))
        for f, v in (equal or {}).items():
            rows = rows.where(self.binding.get(f) == v) if v else rows
        if text:
            rows = rows.where(scalar.contains_any([F.col(c) for c, t in rows.dtypes if t == "string"], text))
        if ids is not None:
            rows = rows.join(ids.select(F.col("id").alias("_id")), "_id", "left_semi")
        order: list[Column] = [F.desc("_at"), F.asc("_id")]
        at = self.binding.get("started_at") if self.binding.has(lambda get: get("started_at")) else F.lit(0)
        return rows.withColumn("_at", at).orderBy(*order).offset(page * size).limit(size).drop("_at", "_id")

    def write_index(self, folder: str) -> None:
        """Stores the binding's text as an index that engines search without building their own."""
        _, vocab, postings = self.semantic()
        searchindex.write(folder, searchindex.rows_of(postings), vocab, self._alias)

    def search(self, question: str, page: int = 0, size: int = 25) -> DataFrame:
        """Rows (id, score) of one page of a semantic ranking."""
        if self.stored:
            spoken = re.findall(tx.TOKEN, question.casefold())
            words = tx_words(question, self.stored.aliases([tx.plain_stem(w) for w in spoken]))
            return self.stored.search({w: float(words.count(w)) for w in words}, (page + 1) * size).rows.offset(page * size)
        _, vocab, postings = self.semantic()
        words = tx_words(question, self._aliases(re.findall(tx.TOKEN, question.casefold())))
        hits = similarity.search(postings, vocab, {w: float(words.count(w)) for w in words}).limit((page + 1) * size)
        return hits.offset(page * size)

    def search_traces(self, question: str, page: int = 0, size: int = 25) -> DataFrame:
        """The conversations of one page of a semantic ranking, with their score, best first."""
        hits = self.search(question, page, size).select(F.col("id").alias("_id"), F.col("score").alias("relevance"))
        rows = self.binding.traces.withColumn("_id", self.binding.get("id"))
        return rows.join(F.broadcast(hits), "_id").orderBy(F.desc("relevance"), "_id").drop("_id")  # a page of rows

    def facets(self, fields: tuple[str, ...] = ("outcome", "failure_mode", "app")) -> DataFrame:
        """Rows (field, key, n) of all facets, from one scan."""
        have = [f for f in fields if self.binding.has(lambda get, f=f: get(f))]
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), scalar.group_key(self.binding.get(f)).alias("key")) for f in have])).alias("p")
        return self.binding.traces.select(pairs).groupBy("p.field", "p.key").agg(F.count("*").alias("n")).orderBy("field", F.desc("n"), "key")

    def home(self) -> DataFrame:
        """One row of totals for the front page."""
        g, has = self.binding.get, self.binding.has
        sums = [F.count("*").alias("conversations")]
        if has(lambda get: get("cost_usd")):
            sums.append(F.round(F.sum(g("cost_usd")), 4).alias("cost"))
        if has(lambda get: get("user_gave_up")):
            sums.append(F.count_if(g("user_gave_up")).alias("gave_up"))
        if has(lambda get: get("intent_satisfied")):
            sums += [F.count_if(g("intent_satisfied") == "no").alias("unsatisfied"), F.round(F.count_if(g("intent_satisfied") == "no") / F.count("*"), 4).alias("unsatisfied_share")]
        if has(lambda get: get("started_at")):
            sums += [F.min(g("started_at")).alias("first"), F.max(g("started_at")).alias("last")]
        return self.binding.traces.agg(*sums)

    def trace(self, id_: object) -> DataFrame:
        return self.binding.traces.where(self.binding.get("id") == F.lit(id_)).limit(1)

    def trace_detail(self, id_: object, trace: str = "trace_id", order: tuple[str, ...] = ("idx",), kind: str = "type", content: str = "content_redacted", cost: str = "cost_usd") -> DataFrame:
        """The spans of one conversation in order, with repeats and explanations; spans of one place go by their other columns."""
        own = self.binding.span_table.where(F.col(trace) == F.lit(id_))
        order = [*order, *[c for c in own.columns if c not in (trace, *order)]]
        return spans.explain(spans.repeats(own, trace, kind, content), trace, order, kind, cost).orderBy(*order)

    def status(self) -> dict:
        """What the engine works on and what is stored: rows, runs by status, judged questions, spent cost."""
        runs = self.store.table("runs").groupBy("status").count() if self.store and self.store.exists("runs") else None
        return {
            "rows": self.binding.traces.count(), "text": self.binding.text is not None, "bridge": self.binding.bridge is not None, "judge": "remote" if self.judge else "local", "budget": self.budget,
            "runs": {r.status: r["count"] for r in runs.collect()} if runs else {}, "aspects": self.aspects.catalogue().count() if self.aspects else 0,
            "values": self.aspects.values().count() if self.aspects else 0, "spent": self.aspects.spent() if self.aspects else 0.0,
        }

    def lookup_error(self, code: str) -> dict:
        """What is known of an error code: the deployment's own words, else its name and what its HTTP status says, if it ends in one."""
        name, number = (m[1], int(m[2])) if (m := re.fullmatch(r"(.*?)_?(\d{3})", code)) else (code, 0)
        status = next((x for x in HTTPStatus if x == number), None)
        said = f"HTTP {number}: {status.phrase}." + (f" {status.description}." if status.description else "") if status else ""
        title, text = self.errors.get(code, (scalar.plain_words(name), said or "Nothing more is on file for this code."))
        return {"code": code, "title": title, "explanation": text, "known": code in self.errors or status is not None}

    # -- read-only tools ------------------------------------------------------

    def describe_dataset(self) -> DataFrame:
        return self.facets()

    def list_shape_fields(self) -> list[dict]:
        fields = [{"key": d.key, "label": d.label, "kind": "dimension"} for d in registry.DIMENSIONS.values() if d.bridge and self.binding.bridge is not None or not d.bridge and self.binding.has(d.build)]
        return fields + [{"key": m.key, "label": m.label, "kind": "metric"} for m in registry.METRICS.values() if self.binding.has(m.build)]

    def list_aspects(self) -> DataFrame:
        return self.aspects.usage()

    def representative_traces(self, limit: int = 5) -> DataFrame:
        """Rows nearest to the centre of all text, 1 to 20 of them."""
        _, _, postings = self.semantic()
        everyone = postings.select("id").distinct().withColumn("group", F.lit(0))
        return similarity.centroid_rank(postings, everyone).where(F.col("rank") <= min(20, max(1, limit)))

    def trace_rows(self, ids: list, limit: int = 50) -> DataFrame:
        return self.binding.traces.where(self.binding.get("id").isin(ids[:limit])).limit(limit)

    def pending(self, aspect_id: str) -> DataFrame:
        return joins.pending(self.docs().withColumn("id", F.col("id").cast("string")), self.aspects.of(aspect_id), "id")


def tx_words(question: str, alias: dict[str, str]) -> list[str]:
    return tx.folded([w for w in re.findall(tx.TOKEN, question.casefold()) if w not in tx.STOP_WORDS], True, alias, {})
