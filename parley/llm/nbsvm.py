"""Quality by naive Bayes support vectors: n-gram indicators scaled by log-count ratios, a hinge-loss fit.

Features of a text are the n-grams of its words (one and two lower-cased words)
and of their shapes (one, two and three), each present or absent. A word's shape
keeps what kinds of characters follow one another (``A`` upper, ``a`` lower case,
``0`` digits, marks as they are, ``+`` behind a repeated kind or mark) and begins with
``=`` where the word repeats the one before. Features are hashed to ``2 ** BITS``
columns, so counts, ratios and weights have one size whatever the corpus.

1. Spark counts, over all labelled rows of both classes, in how many texts each
   column occurs; r is the log of the ratio of the two smoothed shares.
2. A text's vector is r at its columns over the square root of their number. A
   linear hinge-loss model is fitted to at most ``MAX_EXAMPLES`` labelled rows, the
   first by a hash of doc_id, by dual coordinate descent on the driver.
3. Margins become probabilities by a logistic fit on margins out of fold: each of
   ``FOLDS`` parts is scored by a model whose counts and examples leave it out.

Every document is scored on its whole text; doc_id, lang and source are no inputs.

Defined results: null, empty and blank texts have no feature and get the
probability of the bias alone; without labels of both classes every score is the
share of good examples (0.5 without any); rows with a null label or id teach
nothing; conflicting labels of one id count as low quality; each row of a labelled
id is counted, and of several texts with one id the greatest is the example;
repeated rows give a row each; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.store import Staged, fresh, release, small, without

BITS = 18
MAX_EXAMPLES = 4000
FOLDS = 5
#: Labelled ids up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
#: Words of the texts that are hashed together.
WORDS = 200_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_AGAIN = re.compile(r"([^0])\1+")


def shape(word: str) -> str:
    """What kinds of characters a word is made of."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _AGAIN.sub(r"\1+", re.sub("0+", "0", kinds))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) of every feature that is present, by text and then column."""
    split = [_WORD.findall(t or "") for t in texts]
    of = np.repeat(np.arange(len(texts), dtype=np.int64), [len(ws) for ws in split])
    words = pa.array([w for ws in split for w in ws], pa.string()).dictionary_encode()
    known, codes = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = np.array([xxhash.xxh64_intdigest(w.lower().encode()) for w in known], np.uint64)[codes]
    form = np.array([xxhash.xxh64_intdigest(shape(w).encode(), 7) for w in known], np.uint64)[codes]
    same_text = of[1:] == of[:-1]
    again = np.concatenate([[False], (codes[1:] == codes[:-1]) & same_text])
    form = np.where(again, _mixed(form + np.uint64(1)), form)
    two = np.flatnonzero(same_text)
    three = two[:-1][(two[1:] == two[:-1] + 1)]
    grams = [
        (of, word),
        (of[two], _mixed(word[two]) * np.uint64(3) + word[two + 1]),
        (of, form),
        (of[two], _mixed(form[two]) * np.uint64(5) + form[two + 1]),
        (of[three], _mixed(_mixed(form[three]) * np.uint64(7) + form[three + 1]) + form[three + 2]),
    ]
    column = np.concatenate([_mixed(h + np.uint64(i)) >> np.uint64(64 - bits) for i, (_, h) in enumerate(grams)]).astype(np.int64)
    keys = np.unique((np.concatenate([t for t, _ in grams]) << bits) | column)
    return keys >> bits, keys & ((1 << bits) - 1)


def ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The log of the ratio of the classes' smoothed shares, column by column."""
    p, q = good + 1.0, bad + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = 1.0, rounds: int = 30, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model by dual coordinate descent; the bias is a feature of value 1.

    Each step solves one example's dual variable exactly, within 0 and ``cost``. Ends
    when no variable of a round moved its margin by more than ``tolerance``.
    """
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    square = np.array([float(v @ v) + 1.0 for _, v in vectors])
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            at, v = vectors[i]
            g = y[i] * (float(w[at] @ v) + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                bias += step
                moved = max(moved, abs(step) * square[i])
                alpha[i] = new
        if moved <= tolerance:
            break
    return w, bias


def sigmoid_fit(margin: np.ndarray, good: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve of least loss, by Newton steps; targets are smoothed by one example a class."""
    n1 = float(good.sum())
    n0 = len(good) - n1
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.0, math.log((n1 + 1) / (n0 + 1))

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float((np.logaddexp(0, z) - target * z).sum())

    now = loss(a, b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g, h = p - target, p * (1 - p) + 1e-12
        grad = np.array([g @ margin, g.sum()])
        hess = np.array([[h @ (margin * margin) + 1e-9, h @ margin], [h @ margin, h.sum()]])
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and (new := loss(a - size * step[0], b - size * step[1])) > now:
            size /= 2
        if size <= 1e-6 or now - new < 1e-9:
            break
        a, b, now = a - size * step[0], b - size * step[1], new
    return max(a, 0.0), b


@dataclass
class Model:
    """Weights by column, ratios multiplied in; ``rate`` answers where no model could be fitted."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    rate: float | None = 0.5
    bits: int = BITS

    def margins(self, texts: list[str | None]) -> np.ndarray:
        of, column = features(texts, self.bits)
        n = np.bincount(of, minlength=len(texts))
        return np.bincount(of, weights=self.weights[column], minlength=len(texts)) / np.sqrt(np.maximum(n, 1)) + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.rate is not None:
            return np.full(len(texts), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -500, 500)))


def fit(columns: list[np.ndarray], good: np.ndarray, n_good: np.ndarray, n_bad: np.ndarray, bits: int = BITS, folds: int = FOLDS) -> Model:
    """A model of examples (their columns) and the class counts of all labelled rows, which hold the examples once at least."""
    size, y = 1 << bits, np.where(good, 1.0, -1.0)

    def model(use: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
        vectors = [(columns[i], r[columns[i]] / math.sqrt(max(len(columns[i]), 1))) for i in use]
        w, bias = descend(vectors, y[use], size)
        return w * r, bias

    if not len(good) or good.all() or not good.any():
        return Model(rate=float(good.mean()) if len(good) else 0.5, bits=bits)
    part, margin = np.arange(len(good)) % folds, np.zeros(len(good))
    for f in range(folds):
        out = np.flatnonzero(part == f)
        less = [np.bincount(np.concatenate([np.empty(0, np.int64), *[columns[i] for i in out if good[i] == kind]]), minlength=size) for kind in (True, False)]
        w, bias = model(np.flatnonzero(part != f), ratios(np.maximum(n_good - less[0], 0), np.maximum(n_bad - less[1], 0)))
        margin[out] = [w[columns[i]].sum() / math.sqrt(max(len(columns[i]), 1)) + bias for i in out]
    slope, offset = sigmoid_fit(margin, good)
    w, bias = model(np.arange(len(good)), ratios(n_good, n_bad))
    return Model(w, bias, slope, offset, None, bits)


def _grouped(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``WORDS`` words together, a longer text by itself."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to] or "") // 5 <= WORDS):
            held += len(texts[to] or "") // 5
            to += 1
        yield at, to
        at = to


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_examples: int = MAX_EXAMPLES, bits: int = BITS) -> Model:
    """A model of the labelled documents; ``labels`` must hold training rows only."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min((F.col(label) > 0).cast("int")).alias("y"))
    known = Staged(spark, known, "labels")
    n_known = known.df.count()
    chosen = F.broadcast(known.df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            y, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in _grouped(texts):
                of, column = features(texts[a:b], bits)
                for kind in (0, 1):
                    total[kind] += np.bincount(column[y[a:b][of] == kind], minlength=1 << bits)
        some = np.flatnonzero(total.any(0))
        for at in range(0, len(some), 65_536):
            part = some[at : at + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[0, part]), pa.array(total[1, part])], names=["at", "bad", "good"])

    counts = own.join(small(known.df, n_known, BROADCAST_ROWS), "doc_id").select("y", "text").mapInArrow(count, "at int, bad long, good long")
    table = counts.groupBy("at").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()  # 2 ** bits rows at most
    bad, good = np.zeros(1 << bits), np.zeros(1 << bits)
    at = table["at"].to_numpy()
    bad[at], good[at] = table["bad"].to_numpy(), table["good"].to_numpy()

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in _grouped(texts):
                of, column = features(texts[a:b], bits)
                ends = np.searchsorted(of, np.arange(b - a + 1))
                raw = [column[i:j].astype(np.int32).tobytes() for i, j in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(raw, pa.binary())], names=["doc_id", "y", "columns"])

    sample = own.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    rows = sample.mapInArrow(columns, "doc_id long, y int, columns binary").toArrow().sort_by("doc_id")  # max_examples rows at most
    known.drop()
    return fit([np.frombuffer(c, np.int32).astype(np.int64) for c in rows["columns"].to_pylist()], rows["y"].to_numpy() == 1, good, bad, bits)


def score(df: DataFrame, model: Model, text: str = "text", score_name: str = "quality_score") -> DataFrame:
    """``df`` with the probability of good quality; a column of that name gives it up."""
    kept = without(df, score_name)
    own = df.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(text).cast("string").alias(fresh(df, "_text")))
    schema = T.StructType([*kept.schema.fields, T.StructField(score_name, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        learnt = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            got = np.concatenate([np.empty(0), *[learnt.scores(texts[a:b]) for a, b in _grouped(texts)]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got)], names=[*batch.schema.names[:-1], score_name])

    return own.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: CRC-32 of the id's decimal text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
