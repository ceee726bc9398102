"""A judgment per row: does a conversation meet a question no column records?

Scores of all rows are stored and cut once, so judging in parts gives what judging
at once does.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions import text as tx
from parley.operators import select, similarity, sparse, svd
from parley.operators.corpus import Corpus
from parley.sources.tables import held, spread

# Words of the question's frame that say nothing about a row.
FRAMING = frozenset("user users customer customers agent assistant bot person people ask asks asked asking want wants wanted need needs mention mentions mentioned talk talks about conversation something anything say says said".split())
NEGATION = re.compile(r"\b(?:not|never|no|without|nothing|cannot)\b")
PARTIES = (("user", re.compile(r"\b(?:user|customer|person|caller)s?\b")), ("assistant", re.compile(r"\b(?:agent|assistant|bot|model)s?\b")))


#: Counted rows of ids or terms up to which they are broadcast.
BROADCAST_IDS = 100_000


@dataclass
class Analysis:
    question: str
    scope: str
    negated: bool
    weights: dict[str, float] = field(default_factory=dict)
    gate: list[str] = field(default_factory=list)


def analyse(question: str, vocab: DataFrame, power: float = 2.4, tolerance: float = 0.6, floor: float = 3.0) -> Analysis:
    """Terms of the question with sharpened weights, and the rare ones a row must hold at least one of."""
    low = question.casefold()
    found = [(m.start(), who) for who, p in PARTIES if (m := p.search(low))]
    words = [tx.plain_stem(w) for w in re.findall(tx.TOKEN, low) if w not in tx.STOP_WORDS and w not in FRAMING and w not in tx.KEPT_WORDS]
    pairs = [f"{a}_{b}" for a, b in zip(words, words[1:])]
    initials = {"".join(w[0] for w in words[i : i + n]): 0.75 for n in (2, 3, 4) for i in range(len(words) - n + 1)}
    asked = {t: 1.0 + math.log(words.count(t) or 1) for t in [*words, *pairs]}
    known = {r.token: r.idf for r in vocab.where(F.col("token").isin([*asked, *initials] or [""])).select("token", "idf").collect()}
    raw = {t: w * known[t] for t, w in asked.items() if t in known}
    if raw:
        top = max(raw.values())
        sharp = {t: (x / top) ** power for t, x in raw.items()}
        norm = math.sqrt(sum(x * x for x in sharp.values()))
        raw = {t: x / norm for t, x in sharp.items()}
    for t, w in initials.items():
        if known.get(t, 0) > 2 and t not in raw:
            raw[t] = w
    single = {t: known[t] for t in raw if "_" not in t}
    bar = max(floor, tolerance * max(single.values(), default=0.0))
    gate = sorted(t for t, idf in single.items() if idf >= bar) or ([max(single, key=lambda t: (single[t], t))] if single else [])
    return Analysis(question, min(found)[1] if found else "all", bool(NEGATION.search(low)), raw, gate)


def _weight(weights: dict[str, float]) -> Column:
    """The query as literals: it has a few dozen terms at most."""
    return F.coalesce(*[F.when(F.col("token") == t, F.lit(w)) for t, w in weights.items()], F.lit(0.0)) if weights else F.lit(0.0)


def score(postings: DataFrame, ids: DataFrame, weights: dict[str, float], gate: list[str]) -> DataFrame:
    """Rows (id, score): overlap with the question over its norm; zero without a gate term."""
    norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
    hit = postings.where(F.col("token").isin(list(weights) or [""])).groupBy("id").agg(F.sum(F.col("weight") * _weight(weights)).alias("s"), F.bool_or(F.col("token").isin(gate or [""])).alias("g"))
    return ids.join(hit, "id", "left").select("id", F.when(F.col("g"), F.round(F.col("s") / norm, 6)).otherwise(F.lit(0.0)).alias("score"))


#: Share of the dense part in a row's score.
DENSE = 0.2


def with_dense(lexical: DataFrame, vectors: DataFrame, query: list[float], share: float = DENSE) -> DataFrame:
    """Rows (id, score): lexical scores and the cosine of each row's dense vector (id, v) to the question's, weighed.

    Cosines below 0 and rows without a vector count as 0, so a row without a gate term may keep a little of its dense part.
    """
    cosine = similarity.pair_scores(vectors, "id", "v", query).select("id", F.greatest(F.col("score"), F.lit(0.0)).alias("d"))
    return lexical.join(cosine, "id", "left").select("id", F.round((1 - share) * F.col("score") + share * F.coalesce("d", F.lit(0.0)), 6).alias("score"))


@dataclass
class Space:
    """What the dense part of judgments needs of a corpus: term numbers, term vectors, and its rows' own vectors (id, v)."""

    ranks: DataFrame
    terms: svd.Space
    vectors: DataFrame

    def numbers(self, tokens) -> dict[str, int]:
        return {r.token: r["rank"] for r in self.ranks.where(F.col("token").isin(list(tokens) or [""])).collect()}  # a question's terms

    def query(self, weights: dict[str, float]) -> list[float]:
        own = self.numbers(weights)
        return self.terms.query({own[t]: w for t, w in weights.items() if t in own}).tolist()

    def nearest_terms(self, weights: dict[str, float], at: float = 0.68, per: int = 3, damp: float = 0.6) -> dict[str, float]:
        """The question's terms and the nearest to each by term vector, damped."""
        own = self.numbers(weights)
        names = {r: t for t, r in own.items()}
        found = self.terms.nearest(sorted(names), per, at).join(self.ranks, "rank").collect() if names else []
        out = dict(weights)
        for r in found:
            out[r.token] = max(out.get(r.token, 0.0), weights[names[r.asked]] * r.sim * damp)
        return out


def dense_space(rows: DataFrame, dims: int = 192) -> Space:
    """The space of a corpus' ``weighted_rows``: its leading singular directions and every row in them."""
    ranks = held(sparse.token_ranks(tx.postings_of(rows)), "ranks")
    own = held(sparse.vectors(tx.postings_of(rows), ranks), "vectors")
    terms = svd.fit(own, ranks.count(), dims)
    return Space(ranks, terms, held(svd.encode(own, terms), "dense"))


def mix(scoped: DataFrame, whole: DataFrame, context: float = 0.6) -> DataFrame:
    """The named party's words and the whole conversation, weighed."""
    other = whole.select("id", F.col("score").alias("w"))
    return scoped.join(other, "id", "left").select("id", F.round((1 - context) * F.col("score") + context * F.coalesce("w", F.lit(0.0)), 6).alias("score"))


def expand(scores: DataFrame, rows: DataFrame, weights: dict[str, float], terms: int = 12, budget: float = 0.35) -> dict[str, float]:
    """Relevance feedback: terms that a quorum of the best rows share, within a share of the question's mass. ``rows`` are ``weighted_rows``."""
    n, best, positive = scores.agg(F.count("*"), F.max("score"), F.count_if(F.col("score") > 0)).first()
    if n < 20 or not positive:
        return weights
    # the best fiftieth, six rows at least, and all that tie with its last: one rule at every size
    some = scores.where("score > 0")
    least = select.percentile(some, "score", max(0.0, 1 - max(6, n // 50) / positive))
    kept = held(some.where(F.col("score") >= max(least, 0.4 * best)).select("id"), "relevant")
    size = kept.count()
    if size < 3:
        return weights
    quorum = max(2, size // 3)
    known = F.broadcast(kept) if size <= BROADCAST_IDS else kept
    shared = tx.postings_of(rows.join(known, "id", "left_semi")).where(~F.col("token").isin(list(weights))).groupBy("token").agg(F.countDistinct("id").alias("docs"), F.round(F.avg("weight"), 9).alias("w")).where(F.col("docs") >= quorum)
    found = shared.orderBy(F.desc("w"), "token").limit(terms).collect()
    mass = sum(r.w for r in found) or 1.0
    scale = budget * sum(weights.values()) / mass
    return weights | {r.token: r.w * scale for r in found}


def cut(scores: DataFrame) -> tuple[float, float]:
    """The score from which a row meets the question, and the spread of scores."""
    top = [r.score for r in scores.orderBy(F.desc("score")).limit(3).collect()]
    mean, spread, n = scores.agg(F.avg("score"), F.stddev_pop("score"), F.count("*")).first()
    if not n or not top or top[0] <= 0:
        return math.inf, 0.0
    at = max(0.20 * sum(top) / len(top), 0.02, mean + 2 * spread)
    if scores.where(F.col("score") >= at).count() > 0.5 * n:
        at = max(at, select.percentile(scores, "score", 0.5))
    return at, spread


def verdicts(scores: DataFrame, at: float, spread: float, negated: bool = False) -> DataFrame:
    """Rows (id, score, value, confidence)."""
    yes = F.col("score") >= F.lit(at)
    far = F.abs(F.col("score") - F.lit(at if math.isfinite(at) else 0.0)) / F.lit(spread or 1.0)
    return scores.select("id", "score", (~yes if negated else yes).alias("value"), F.round(F.least(F.lit(0.97), 0.5 + 0.47 * F.least(F.lit(1.0), 2.6 * far)), 6).alias("confidence"))


_PART = re.compile(r"[^.?!\n]*[.?!]+|[^.?!\n]+")


def plain_evidence(text: str, weights: dict[str, float], words: list[str], asked: re.Pattern | None, known: dict[str, str]) -> str:
    """The sentence of over 12 characters that overlaps most with the question, the first of equals, else the first 200 characters.

    ``words`` are the beginnings that a token must have to be a term of the question, and ``asked`` finds such tokens.
    """
    best, quote = -1.0, None
    low = text.lower()
    have = [w for w in words if w in low]  # most texts, and most sentences, share no word with the question
    for one in _PART.findall(text) if have else ():
        own_low = one.lower()
        if not any(w in own_low for w in have) or not asked.search(own_low):
            continue
        one = one.strip(" ")
        if len(one) <= 12:
            continue
        grams: set[str] = set()
        for clause in tx._SENTENCE.split(one.lower()):
            own = tx.folded([w for w in tx._TOKEN.findall(clause) if w not in _STOPPED], True, {}, known)
            grams.update(own, (f"{a}_{b}" for a, b in zip(own, own[1:])))
        hit = [weights[g] for g in sorted(grams & weights.keys())]
        if hit and round(sum(hit), 9) > best:
            best, quote = round(sum(hit), 9), one
    return text[:200] if quote is None else quote


_STOPPED = frozenset(tx.STOP_WORDS)


def evidence(docs: DataFrame, weights: dict[str, float], text: str = "text") -> DataFrame:
    """Rows (id, quote), one per row of ``docs``: its best sentence."""
    words = sorted({w[:-1] if w.endswith("y") else w for t in weights for w in t.split("_")})  # a stem's y may stand for i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = (re.compile("(?:^|[^a-z0-9])(?:" + "|".join(words) + ")") if words else None), {}
        for batch in batches:
            got = [plain_evidence(t or "", weights, words, asked, known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], names=["id", "quote"])

    return docs.select("id", F.col(text).alias("text")).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, quote string")


@dataclass
class Index:
    """What judging needs of a corpus: its texts, vocabulary and weighted rows, and its dense space if there is one.

    Rows come from written ones or, by ``having``, from a packed corpus.
    """

    docs: DataFrame
    vocab: DataFrame
    n_tokens: int
    rows: DataFrame
    space: Space | None = None
    corpus: Corpus | None = None

    def having(self, terms) -> DataFrame:
        """The weighted rows that hold any of some terms."""
        return self.corpus.rows(list(terms)) if self.corpus else self.rows


def index(docs: DataFrame, dense: int = 0) -> Index:
    """The index of docs (id, text), ids once each; ``dense`` is the number of directions of its dense space, 0 for none."""
    docs = held(spread(docs.select("id", F.coalesce("text", F.lit("")).alias("text"))), "docs")
    corpus = Corpus(docs, stems=True, many=True)
    vocab = held(corpus.vocab, "vocabulary")
    n_tokens = vocab.count()
    rows = corpus.rows()
    return Index(docs, vocab, n_tokens, rows, dense_space(rows, dense) if dense else None, corpus)


def judge(docs: DataFrame | Index, question: str, scoped: Callable[[str], DataFrame | None] | DataFrame | None = None, dense: int = 0) -> tuple[DataFrame, Analysis]:
    """Rows (id, score, value, confidence, quote) for every row of docs (id, text), ids once each, or of their ``index``.

    ``scoped`` (id, text), or a function of the party that the question names, gives that
    party's words; without it the whole text is scored. Texts and question meet on stems.
    With a dense space the question is widened by the terms of the nearest vectors, and
    ``DENSE`` of a score is the cosine in it; without one, by terms that occur in the same rows.
    """
    own_index = docs if isinstance(docs, Index) else index(docs, dense)
    docs, vocab, rows, space = own_index.docs, own_index.vocab, own_index.rows, own_index.space
    asked = analyse(question, vocab)
    ids = docs.select("id")
    party = (scoped(asked.scope) if asked.scope != "all" else None) if callable(scoped) else scoped
    own, own_dense = None, space.vectors if space else None
    if party is not None:
        own = held(tx.weighted_rows(tx.term_counts(spread(party.select("id", "text")), "id", "text", stems=True), vocab, own_index.n_tokens), "party")
        own_dense = held(svd.encode(sparse.vectors(tx.postings_of(own), space.ranks), space.terms), "dense") if space else None
    query = space.query(asked.weights) if space else []

    def run(weights: dict[str, float], gate: list[str]) -> DataFrame:
        whole = score(with_any(own_index.having(weights), weights), ids, weights, gate)
        first = whole if own is None else score(with_any(own, weights), ids, weights, gate)
        first = with_dense(first, own_dense, query) if space else first
        if own is not None:  # the whole conversation is context: its words alone count, by the same share
            first = mix(first, whole.withColumn("score", (1 - DENSE) * F.col("score")) if space else whole)
        return held(first, "scores")

    near = space.nearest_terms(asked.weights) if space else nearest_terms(rows, asked.weights)
    gate = sorted({*asked.gate, *[t for t in near if t not in asked.weights]})
    first = run(near, gate)
    wider = expand(first, rows, near)
    scores = first if wider is near else run(wider, sorted({*gate, *[t for t in wider if t not in near]}))
    at, spread_of = cut(scores)
    return verdicts(scores, at, spread_of, asked.negated).join(evidence(docs, wider), "id"), asked


def sample(values: DataFrame, per: int = 5) -> DataFrame:
    """Rows to verify by hand: the most confident of each verdict, ties by id."""
    place = F.row_number().over(Window.partitionBy("value").orderBy(F.desc("confidence"), "id"))
    return values.withColumn("place", place).where(F.col("place") <= per)


def with_any(rows: DataFrame, terms) -> DataFrame:
    """Postings of the ``weighted_rows`` that hold any of some terms; the other rows are never taken apart."""
    return tx.postings_of(rows.where(F.arrays_overlap("tokens", F.array(*[F.lit(t) for t in terms]).cast("array<string>"))))


def nearest_terms(rows: DataFrame, weights: dict[str, float], at: float = 0.68, per: int = 3, damp: float = 0.6) -> dict[str, float]:
    """The question's terms and those that occur in the same rows (cosine over rows), damped.

    Products come from the ``weighted_rows`` that hold a term of the question. A norm over
    these rows alone is at most the true one, so terms that fail by it fail for good, and
    true norms are computed for the few others only.
    """
    if not weights:
        return weights
    asked = F.array(*[F.lit(t) for t in weights])
    both = F.filter(F.arrays_zip("tokens", "weights"), lambda p: F.array_contains(asked, p["tokens"]))
    hit = rows.where(F.arrays_overlap("tokens", asked)).withColumn("own", both)
    pairs = hit.select(F.explode("own").alias("own"), "tokens", "weights").select("own", F.inline(F.arrays_zip("tokens", "weights")))
    pairs = pairs.select(F.col("own.tokens").alias("asked"), F.col("own.weights").alias("wa"), F.col("tokens").alias("token"), F.col("weights").alias("w"))
    found = pairs.groupBy("asked", "token").agg(F.sum(F.col("wa") * F.col("w")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("part"))
    own = found.where(F.col("asked") == F.col("token")).select("asked", F.sqrt("part").alias("na"))  # rows of a question's term are all here
    near = held(found.where(F.col("asked") != F.col("token")).join(F.broadcast(own), "asked").where(F.col("dot") >= (at - 1e-9) * F.sqrt("part") * F.col("na")), "near")
    terms = near.select("token").distinct()
    n = terms.count()
    norms = tx.postings_of(rows).join(F.broadcast(terms) if n <= BROADCAST_IDS else terms, "token", "left_semi").groupBy("token").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    sims = near.join(norms, "token").select("asked", "token", (F.col("dot") / (F.col("norm") * F.col("na"))).alias("sim")).where(F.col("sim") >= at)
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("sim"), "token"))
    out = dict(weights)
    for r in (sims.withColumn("place", place).where(F.col("place") <= per).collect() if n else []):
        out[r.token] = max(out.get(r.token, 0.0), weights[r.asked] * r.sim * damp)
    return out
