"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Counts. Every word of every training text is counted (partial counts per task, then
a shuffle by word), which gives the base score and the model's symbols: the most
frequent words, and classes of the other words by a hash of their ending. All
training texts are then read as symbols, and their trigrams counted.

Model. P(symbol | two symbols before) = P(class | context) * P(symbol | class,
context), each a softmax over 16 outcomes. Features of a context are a bias, the
symbol before, the pair before, and the symbol before that (a skip); they are hashed
into rows of two weight tables. Within a symbol of many words, P(word | symbol, word
before) is proportional to the word's smoothed share of the symbol times exp of the
weight of the pair (word before, word). Pairs are of words, whatever their number: every
pair of the training texts whose second word has no symbol of its own has a weight, by
a 64-bit hash. A word of no pair has weight zero, so the sum over a symbol's words is one
more than the pairs' shares times (exp(weight) - 1), and the model is a distribution
over all words.

Training. The trigram table holds the whole corpus in at most 256^3 rows. Each round is
one job: every partition computes its gradient (observed less expected feature counts),
gradients are summed on the cluster in groups of about the square root of their number,
and the driver adds up the groups' sums and takes a step scaled by the expected counts;
those two tables and their gradients have a fixed size. Observed counts never change, so
only the first round hands them on. The weights of pairs grow with the
corpus: those of one word before and one symbol depend on no other, so the uses of a pair,
in training texts and in texts to be scored, are dealt by (word before, symbol) into groups
of about ``GROUP`` uses, and each group takes its own gradient steps and scores its uses.
A task adds up the scores of its groups by row before it hands them on.

What is shuffled in bulk (trigram counts, uses of pairs, sums by row) is sorted by its first
column within its group, and goes as differences of that column, in compressed planes of bytes.

Scoring. Texts are turned into arrays per batch and each distinct trigram of a batch
is scored once. The most frequent ``HEAD`` words have their counts at hand; the other
words leave with their row and the word before, meet their counts in a join by word, and
go on to the groups of pairs.

Defined results: null and empty texts have one token, the end; rows with a null id
are training rows; repeated rows count and are scored each; without training rows
N and V are 0; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parley.llm.store import Staged

#: Words whose counts every task holds (some 40 MB); a fixed bound.
HEAD = 200_000
#: Symbols: single words first (one of them the end), then classes of other words.
SYMBOLS, SINGLE, SIDE = 256, 192, 16
ROWS = 1 << 14
ROUNDS = 8
#: Counts that hold a weight at zero: a feature moves freely once it is seen much more often.
PRIOR = 60.0
#: Distinct words a task gathers before it hands its counts on.
FLUSH = 250_000
#: Uses of pairs in a group, about; bounds a task's memory, as groups grow in number.
GROUP = 500_000
#: Uses of pairs, or sums of rows, that a task gathers before it hands them on.
USES = 500_000
#: Groups of contexts in which trigram counts are added up: of some 65,000 trigrams each at most.
MERGES = 256
#: The end of a text: no word holds a blank.
END = b" "
START = SYMBOLS  # contexts before the first token; has its own feature rows


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8").lower().split(), END]


def other(word: bytes) -> int:
    """The symbol of a word that has none of its own."""
    return SINGLE + zlib.crc32(word[-3:]) % (SYMBOLS - SINGLE)


class Symbols(dict):
    def __missing__(self, word: bytes) -> int:
        s = other(word)
        if len(self) < HEAD:
            self[word] = s
        return s


def rare_id(word: bytes) -> int:
    """The number of a word that is not among the most frequent ones, beyond all of theirs."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") >> 2 | 1 << 61


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two whole numbers."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def squeezed(columns: np.ndarray) -> bytes:
    """Columns of 64-bit values (k, n), ascending in the first, as compressed planes of bytes; of the first its differences."""
    k, n = columns.shape
    columns = np.ascontiguousarray(np.concatenate([np.diff(columns[:1], prepend=0), columns[1:]]))
    planes = np.ascontiguousarray(columns.view(np.uint8).reshape(k, n, 8).transpose(0, 2, 1))
    return n.to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def packed(uses: np.ndarray, symbol: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Uses (before, word, row and training, count and symbol; a row each) by group, as compressed planes of bytes."""
    yield from split(uses, (mix(uses[0], symbol) >> np.uint64(20)).astype(np.int64) % parts, parts)


def split(columns: np.ndarray, group: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    group = group.astype(np.uint16 if parts <= 1 << 16 else np.int64)  # short numbers sort faster
    order = np.argsort(columns[0], kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    columns, group = columns[:, order], group[order]
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges], [*edges, len(group)]) if len(group) else ():
        yield int(group[a]), squeezed(columns[:, a:b])


def unpacked(blob: bytes, k: int = 4) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=8 * k * n, codec="zstd", asbytes=True), np.uint8)
    columns = planes.reshape(k, 8, n).transpose(0, 2, 1).copy().view(np.int64).reshape(k, n)
    columns[0] = np.cumsum(columns[0])
    return columns


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and each one's sums of the values (k, n)."""
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.stack([np.bincount(at, weights=v, minlength=len(keys)) for v in values])


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and the number of each value's run."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def fit_pairs(context: np.ndarray, share: np.ndarray, seen: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Per distinct pair its weight, and per context (0, 1, ...) the log of the sum over its symbol's words.

    ``share``: of the pair's word in its symbol; ``seen``: the pair's count in the training texts.
    """
    weight, n = np.zeros(len(context)), np.bincount(context, weights=seen)
    for r in range(rounds + 1):
        now = share * np.exp(weight)
        total = 1 + np.bincount(context, weights=now - share)
        if r < rounds:
            due = n[context] * now / total[context]
            move = np.clip((seen - due) / (np.maximum(seen, due) + PRIOR), -1.0, 1.0) * (1.0 if r < rounds - 2 else 0.5)
            weight = np.where(seen > 0, weight + move, 0.0)
    return weight, np.log(total)


def pair_scores(uses: np.ndarray, symbol: np.ndarray, count: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of a group's uses: log10 of what their pairs' weights make of their words' shares."""
    training = (uses[2] & 1) * (symbol >= SINGLE)
    context = mix(uses[0], symbol)
    pairs, at = np.unique(mix(context, uses[1]), return_inverse=True)
    first = np.empty(len(pairs), np.int64)
    first[at] = np.arange(len(at))  # one use of each pair
    _, within = np.unique(context[first], return_inverse=True)
    share = (count[first] + 1.0) / 10.0 ** mass[symbol[first]]
    weight, total = fit_pairs(within, share, np.bincount(at, weights=training))
    rows, of = np.unique(uses[2] >> 1, return_inverse=True)
    return rows, np.bincount(of, weights=(weight - total[within])[at] / math.log(10))


def count_words(texts: DataFrame) -> DataFrame:
    """Rows (word binary, n) over a column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return got

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(tokens(text))
                if len(seen) > FLUSH:
                    yield out()
        yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pack(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Trigram keys of concatenated texts that begin at ``starts``; contexts do not cross texts."""
    one = np.empty_like(symbols)
    one[0], one[1:] = START, symbols[:-1]
    one[starts] = START
    two = np.empty_like(symbols)
    two[0], two[1:] = START, one[:-1]
    two[starts] = START
    return two << 17 | one << 8 | symbols


def count_trigrams(texts: DataFrame, single: list[bytes]) -> DataFrame:
    """Rows (key, n): trigrams of symbols over a column of texts; those of one context lie together, by symbol."""
    own = {w: i for i, w in enumerate(single)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = Symbols(own).__getitem__
        held, size = [], 0  # sorted runs of (keys, counts)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[starts], np.add.reduceat(counts[order], starts)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                lists = [tokens(t) for t in batch.column(0).slice(at, 512).to_pylist()]
                sizes = np.array([len(x) for x in lists])
                flat = np.fromiter((symbol(w) for x in lists for w in x), np.int64, int(sizes.sum()))
                new, n = np.unique(_pack(flat, np.cumsum(sizes) - sizes), return_counts=True)
                held.append((new, n))
                size += len(new)
                if size > 2_000_000:
                    keys, counts = merged()
                    held, size = [(keys, counts)], len(keys)
                    if size > 1_000_000:
                        yield blobs(keys, counts)
                        held, size = [], 0
        if held:
            yield blobs(*merged())

    def blobs(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        groups = list(split(np.stack([keys, counts]), (mix(keys >> 8, keys >> 8) >> np.uint64(20)).astype(np.int64) % MERGES, MERGES))
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in groups], pa.int32()), pa.array([b for _, b in groups], pa.binary())], names=["part", "counts"])

    def add_up(part: pa.Table) -> pa.Table:
        keys, n, given = np.empty(0, np.int64), np.empty((1, 0)), part["counts"]
        for a in range(0, len(given), 64):
            got = np.concatenate([unpacked(b.as_py(), 2) for b in given[a : a + 64]], axis=1)
            keys, n = summed(np.concatenate([keys, got[0]]), np.concatenate([n, got[1:]], axis=1))
        return pa.table({"key": keys, "n": n[0].astype(np.int64)})

    return texts.mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(add_up, "key long, n long")


class Model:
    """Weights by hashed feature: of classes, and of a class's members."""

    def __init__(self) -> None:
        self.classes = np.zeros((ROWS, SIDE), np.float32)
        self.members = np.zeros((ROWS, SIDE), np.float32)

    @staticmethod
    def _hash(kind: int, value: np.ndarray) -> np.ndarray:
        x = value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(64 - 14)).astype(np.int64)

    @classmethod
    def features(cls, context: np.ndarray) -> list[np.ndarray]:
        one, two = context & 511, context >> 9
        return [cls._hash(0, one * 0), cls._hash(1, one), cls._hash(2, context), cls._hash(3, two)]

    @classmethod
    def inner(cls, features: list[np.ndarray], context: np.ndarray, klass: np.ndarray) -> list[np.ndarray]:
        one, two = context & 511, context >> 9
        return [cls._hash(4, klass), cls._hash(5, one * SIDE + klass), cls._hash(6, context * SIDE + klass), cls._hash(7, two * SIDE + klass)]

    @staticmethod
    def softmax(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        z = table[rows[0]] + table[rows[1]] + table[rows[2]] + table[rows[3]]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 P(symbol | context) of trigram keys."""
        context, symbol = keys >> 8, keys & 255
        first, at = runs(context)
        of_class = self.softmax(self.classes, self.features(context[first]))
        pair, pat = runs(context * SIDE + symbol // SIDE)
        of_member = self.softmax(self.members, self.inner([], context[pair], symbol[pair] // SIDE))
        return (of_class[at, symbol // SIDE].astype(np.float64) + of_member[pat, symbol % SIDE]) / math.log(10)

    def gradient(self, keys: np.ndarray, n: np.ndarray, observed: bool = True) -> np.ndarray:
        """Expected feature counts of both tables, (1, 2, ROWS, SIDE); with ``observed``, observed ones after them."""
        out = np.zeros((1 + observed, 2, ROWS, SIDE), np.float64)
        context, symbol = keys >> 8, keys & 255

        def add(level: int, group: np.ndarray, target: np.ndarray, rows, table: np.ndarray) -> None:
            first, at = runs(group)
            rows = rows(group[first])
            seen = np.bincount(at * SIDE + target, weights=n, minlength=len(first) * SIDE).reshape(-1, SIDE)
            due = np.exp(self.softmax(table, rows)) * seen.sum(1, keepdims=True)
            for kind, counts in enumerate([due, seen][: len(out)]):
                for side, of_side in enumerate(np.ascontiguousarray(counts.T)):
                    for row in rows:
                        out[kind, level, :, side] += np.bincount(row, weights=of_side, minlength=ROWS)

        add(0, context, symbol // SIDE, self.features, self.classes)
        add(1, context * SIDE + symbol // SIDE, symbol % SIDE, lambda p: self.inner([], p // SIDE, p % SIDE), self.members)
        return out

    def step(self, seen: np.ndarray, due: np.ndarray, rate: float) -> None:
        """A gradient step, each weight's scaled by its expected count and shared by the four active features."""
        move = np.clip((seen - due) / (np.maximum(seen, due) + PRIOR), -1.0, 1.0) * rate
        self.classes += move[0].astype(np.float32)
        self.members += move[1].astype(np.float32)


def train(trigrams: DataFrame, rounds: int = ROUNDS) -> Model:
    """Fits a model to rows (key, n), at most 256^3 of them, over all partitions each round."""
    model = Model()
    groups = max(1, math.isqrt(int(trigrams.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def add_up(part: pa.Table) -> pa.Table:
        total: np.ndarray | float = 0.0
        for one in part["g"]:
            total = total + np.frombuffer(one.as_buffer(), np.float32)
        return pa.table({"g": pa.array([total.tobytes()], pa.binary())})

    seen = np.zeros((2, ROWS, SIDE))
    for r in range(rounds):
        weights, observed = (model.classes, model.members), r == 0

        def run(batches: Iterator[pa.RecordBatch], weights=weights, observed=observed) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own = Model()
            own.classes, own.members = weights
            got = [b for b in batches if b.num_rows]
            if got:
                table = pa.Table.from_batches(got)
                total = own.gradient(table["key"].to_numpy(), table["n"].to_numpy().astype(np.float64), observed)
                group = TaskContext.get().partitionId() % groups
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["k", "g"])

        total = np.zeros((1 + observed, 2, ROWS, SIDE))
        gradients = trigrams.select("key", "n").mapInArrow(run, "k int, g binary").groupBy("k").applyInArrow(add_up, "g binary")
        for one in gradients.toArrow()["g"]:  # 2 MB a group, 4 MB in the first round
            total += np.frombuffer(one.as_buffer(), np.float32).reshape(total.shape)
        if observed:
            seen = total[1]
        model.step(seen, total[0], 1.0 if r < rounds - 2 else 0.5)
    return model


def frequent(vocab: DataFrame) -> list[tuple[bytes, int]]:
    """(word, n) of all words above the least count that leaves at most HEAD of them, most frequent first.

    The border comes from the counts' histogram, so that no task or driver sorts more than is kept.
    """
    kept, least = 0, 0
    sizes = vocab.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("words")).collect()  # at most 100,000 rows
    for r in sorted(sizes, key=lambda r: -r.n):
        if kept + r.words > HEAD:
            break
        kept, least = kept + r.words, r.n
    got = vocab.where(F.col("n") >= least).toArrow() if kept else pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    words = sorted(zip(got["word"].to_pylist(), got["n"].to_pylist()), key=lambda x: (-x[1], x[0]))
    return words


def scores(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", training: Column | None = None) -> DataFrame:
    """Per row: doc_id, training, n_tokens, n_known, train_tokens, base_score, score."""
    training = ~held_out(F.col(doc_id)) if training is None else training
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), training.alias("training"), F.col(text).cast("string").alias("text"))
    seen = own.where("training").select("text")
    vocab = Staged(spark, count_words(seen), "words").df
    n_all, v_all = (int(x or 0) for x in vocab.agg(F.sum("n"), F.count("*")).first())
    head = frequent(vocab)
    single = [END, *[w for w, _ in head[:SINGLE] if w != END]][:SINGLE]
    named = {w: i for i, w in enumerate(single)}

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
        for batch in batches:
            at = np.array([named[w] if w in named else other(w) for w in batch.column(0).to_pylist()], np.int64)
            if len(at):
                n += np.bincount(at, weights=batch.column(1).to_numpy(), minlength=SYMBOLS).astype(np.int64)
                v += np.bincount(at, minlength=SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SYMBOLS), pa.int32()), pa.array(n), pa.array(v)], names=["symbol", "n", "v"])

    mass = np.zeros(SYMBOLS)
    for r in vocab.mapInArrow(shares, "symbol int, n long, v long").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        mass[r.symbol] = math.log10(r.n + r.v + 1)
    mass[: len(single)] = 0.0
    trigrams = Staged(spark, count_trigrams(seen, single), "trigrams")
    model = train(trigrams.df)
    trigrams.drop()
    n_rows, n_trained = own.agg(F.count("*"), F.count_if("training")).first()
    parts = max(1, -(-n_all * n_rows // (max(n_trained, 1) * GROUP)))
    floor = math.log10(n_all + v_all + 1)
    share = spark.sparkContext.broadcast((head, named, mass, model.classes, model.members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, named, mass, classes, members = share.value
        own = Model()
        own.classes, own.members = classes, members
        symbol = np.array([named[w] if w in named else other(w) for w, _ in head] + [0], np.int64)
        count = np.log10(np.array([n for _, n in head] + [0], np.float64) + 1)
        inner = np.where(symbol < len(named), 0.0, count - mass[symbol])
        index = {w: i for i, (w, _) in enumerate(head)}
        uses, n_uses = [], 0

        def hand_on() -> pa.RecordBatch:
            got = np.concatenate(uses, axis=1)
            uses.clear()
            groups = list(packed(got, symbol[got[1]], parts))
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(groups), f.type) for f in fields[:-2]], pa.array([g for g, _ in groups], pa.int32()), pa.array([b for _, b in groups], pa.binary())], schema=pa.schema(fields))

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = [tokens(t) for t in batch.column(3).to_pylist()]
                sizes = np.array([len(x) for x in lists])
                starts = np.cumsum(sizes) - sizes
                flat = [w for x in lists for w in x]
                code = np.array([index.get(w, -1) for w in flat], np.int64)
                rare = np.flatnonzero(code < 0)
                sym, base, part = symbol[code], count[code], inner[code]
                if len(rare):
                    sym[rare] = [named[w] if w in named else other(w) for w in (flat[i] for i in rare)]
                    base[rare] = 0.0
                    part[rare] = -mass[sym[rare]]
                keys, back = np.unique(_pack(sym, starts), return_inverse=True)
                logs = own.log10(keys)[back] + part
                text_of = np.repeat(np.arange(len(lists)), sizes)
                n_rare = np.bincount(text_of[rare], minlength=len(lists))
                ids = code.copy()
                ids[rare] = [rare_id(flat[i]) for i in rare]
                before = np.empty_like(ids)
                before[1:] = ids[:-1]
                before[starts] = -1
                shared = np.flatnonzero((code >= 0) & (sym >= SINGLE))
                mark = batch.column(0).to_numpy() * 2 + batch.column(2).to_numpy(zero_copy_only=False)
                uses.append(np.stack([before[shared], code[shared], mark[text_of[shared]], np.zeros(len(shared), np.int64)]))
                n_uses += len(shared)
                if n_uses > USES:
                    yield hand_on()
                    n_uses = 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), batch.column(2), pa.array(sizes),
                        pa.array(sizes - n_rare), pa.array(np.add.reduceat(base, starts) - floor * sizes), pa.array(np.add.reduceat(logs, starts)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32()), pa.StructArray.from_arrays([pa.array([flat[i] for i in rare], pa.binary()), pa.array(before[rare])], ["word", "before"])),
                        pa.nulls(len(lists), pa.int32()), pa.nulls(len(lists), pa.binary()),
                    ],
                    schema=pa.schema(fields),
                )
        if n_uses:
            yield hand_on()

    struct = pa.struct([("word", pa.binary()), ("before", pa.int64())])
    kinds = f"row long, doc_id {docs.schema[doc_id].dataType.simpleString()}, training boolean, n_tokens long, n_known long, base double, model double, rare array<struct<word: binary, before: long>>, part int, uses binary"
    fields = [pa.field("row", pa.int64()), pa.field("doc_id", to_arrow_type(docs.schema[doc_id].dataType)), pa.field("training", pa.bool_()), pa.field("n_tokens", pa.int64()), pa.field("n_known", pa.int64()), pa.field("base", pa.float64()), pa.field("model", pa.float64()), pa.field("rare", pa.list_(struct)), pa.field("part", pa.int32()), pa.field("uses", pa.binary())]
    staged = Staged(spark, own.mapInArrow(run, kinds), "scored").df
    held = staged.where("part is null")
    tail = held.select("row", "training", F.inline("rare"))
    tail = tail.join(vocab.select("word", "n"), "word", "left") if v_all > len(head) else tail.withColumn("n", F.lit(0).cast("long"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: list = []

        def hand_on() -> pa.RecordBatch:
            got = np.concatenate(uses, axis=1)
            uses.clear()
            groups = list(packed(got, got[3] & 255, parts))
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in groups], pa.int32()), pa.array([b for _, b in groups], pa.binary())], names=["part", "uses"])

        for batch in batches:
            words = batch.column(0).to_pylist()
            sym = np.array([named[w] if w in named else other(w) for w in words], np.int64)
            mark = batch.column(1).to_numpy() * 2 + batch.column(2).to_numpy(zero_copy_only=False)
            uses.append(np.stack([batch.column(3).to_numpy(), np.array([rare_id(w) for w in words], np.int64), mark, batch.column(4).to_numpy() << 8 | sym]))
            if sum(u.shape[1] for u in uses) > USES:
                yield hand_on()
        if uses:
            yield hand_on()

    dealt = staged.where("part is not null").select("part", "uses").unionByName(tail.select("word", "row", "training", "before", F.coalesce("n", F.lit(0)).alias("n")).mapInArrow(deal, "part int, uses binary"))
    known_words = spark.sparkContext.broadcast((np.array([named[w] if w in named else other(w) for w, _ in head] + [0], np.int64), np.array([n for _, n in head] + [0], np.int64)))

    def scored(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a group's uses, and of each: known words, sum of their logs, gain of the pairs."""
        of_head, n_head = known_words.value
        uses = np.concatenate([unpacked(b) for b in blobs], axis=1)
        rare = uses[1] >= 1 << 61
        at = np.where(rare, len(of_head) - 1, uses[1])
        symbol, count = np.where(rare, uses[3] & 255, of_head[at]), np.where(rare, uses[3] >> 8, n_head[at])
        rows, gain = pair_scores(uses, symbol, count, mass)
        here = np.searchsorted(rows, uses[2][rare] >> 1)
        # words that training lacks add log10(1) = 0
        log, known = np.bincount(here, weights=np.log10(count[rare] + 1.0), minlength=len(rows)), np.bincount(here, weights=count[rare] > 0, minlength=len(rows))
        return rows, np.stack([known, log, gain])

    def of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The uses of one group follow each other; sums by row are of all groups of the task, as far as they fit."""
        rows, sums, part, blobs = np.empty(0, np.int64), np.empty((3, 0)), None, []
        done, size = [], 0  # of groups not merged yet

        def merged() -> tuple[np.ndarray, np.ndarray]:
            got = summed(np.concatenate([rows, *[r for r, _ in done]]), np.concatenate([sums, *[v for _, v in done]], axis=1))
            done.clear()
            return got

        def hand_on() -> pa.RecordBatch:
            columns = np.stack([rows, sums[0].astype(np.int64), *sums[1:].view(np.int64)])
            found = list(split(columns, (mix(rows, rows) >> np.uint64(20)).astype(np.int64) % targets, targets))
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["target", "sums"])

        for batch in batches:
            for of, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if of != part and blobs:
                    done.append(scored(blobs))
                    size, blobs = size + len(done[-1][0]), []
                    if size > USES:
                        rows, sums = merged()
                        size = 0
                        if len(rows) > USES:
                            yield hand_on()
                            rows, sums = rows[:0], sums[:, :0]
                part = of
                blobs.append(blob.as_py())
        if blobs:
            done.append(scored(blobs))
            rows, sums = merged()
        if len(rows):
            yield hand_on()

    def by_row(target: pa.Table) -> pa.Table:
        rows, sums, blobs = np.empty(0, np.int64), np.empty((3, 0)), target["sums"]
        for a in range(0, len(blobs), 64):
            got = np.concatenate([unpacked(b.as_py()) for b in blobs[a : a + 64]], axis=1)
            values = np.concatenate([got[1:2].astype(np.float64), got[2:].view(np.float64)])
            rows, sums = summed(np.concatenate([rows, got[0]]), np.concatenate([sums, values], axis=1))
        return pa.table({"row": rows, "known": sums[0].astype(np.int64), "log": sums[1], "gain": sums[2]})

    targets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_group = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(of_groups, "target int, sums binary")
    more = by_group.groupBy("target").applyInArrow(by_row, "row long, known long, log double, gain double")
    held = held.drop("rare", "part", "uses").join(more, "row", "left")
    log, known = F.coalesce("log", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return held.select("doc_id", "training", "n_tokens", (F.col("n_known") + known).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("model") + log + F.coalesce("gain", F.lit(0.0))).alias("score"))
