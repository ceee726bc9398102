"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Largest inner product becomes least distance by one more coordinate,
``sqrt(M^2 - |x|^2)`` with M the largest norm of the table. Vectors are rotated at
random (a fixed seed), so that the first t of D coordinates estimate a distance:
partial * D / t. Inside each probed list the coordinates are scanned in blocks of
columns, for all candidates and queries of the list at once; after each block a
pair is abandoned if its estimate exceeds the query's best radius so far by more
than ``1 + EPS0 / sqrt(t)`` (the hypothesis test of Gao and Long, 2023). While
many pairs are alive a block is one matrix product; once few are, only those
are gathered. What survives all blocks is scored exactly on the original vectors.

Lists, about the square root of the number of vectors and at most ``SAMPLE / 8``,
come from k-means on at most ``SAMPLE`` vectors (beyond 268 million vectors lists
grow longer instead). The number of lists to probe is the least that reaches
``TARGET`` recall on queries held against that sample; every row is indexed. Lists
near one another form regions of about ``PIECE`` vectors, and a query is sent once
to each region where it probes a list. Its ``NEAR`` nearest lists are searched first
and give the radius for the rest. A list longer than a piece is dealt into several,
and so are the queries of a region, by that region's own number of them.

Equal vectors of a piece are searched together: of each only the ids that can be
among the k nearest (ties go to the smaller id) are scored.

Defined results: vectors that are null, zero, empty, of another length than most, or
hold nulls or non-finite numbers take no part; ties go to the smaller id; rows of
one id are candidates each, but never of a query of that id; a repeated query id is
one query, by its least vector; fewer candidates than k give fewer rows; extra
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from parley.llm.store import Staged

#: Vectors that lists are fitted on: at least, and at most.
LEAST_SAMPLE, SAMPLE = 16_384, 131_072
TARGET = 0.95
EPS0 = 2.1
COLUMNS = 16
#: Nearest lists of a query that are searched before the others.
NEAR = 4
#: Vectors, and queries, in a piece of a region at most.
PIECE = 32_768
#: Candidates and queries in one matrix of partial distances.
BLOCK = 2048
#: Share of live pairs up to which pairs are gathered one by one.
SPARSE = 1 / 8
SEED = 7


def usable(v: Column, size: int | None = None) -> Column:
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(whole & ((F.size(v) == size) if size else (F.size(v) > 0)), F.lit(False))


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Space:
    """Rotated coordinates in which least distance is largest inner product."""

    def __init__(self, dim: int, norm: float):
        self.dim, self.top, self.turn = dim, norm * norm, rotation(dim + 1)

    def items(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.top - (x * x).sum(1)))
        return np.hstack([x, rest[:, None]]) @ self.turn

    def scale(self, q: np.ndarray) -> np.ndarray:
        return math.sqrt(self.top) / np.sqrt((q * q).sum(1))

    def queries(self, q: np.ndarray) -> np.ndarray:
        """Queries are scaled to the largest norm, which leaves their order of neighbours."""
        return np.hstack([q * self.scale(q)[:, None], np.zeros((len(q), 1))]) @ self.turn


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each row."""
    step = max(1, 4_000_000 // len(centers))
    return np.concatenate([_squares(x[at : at + step], centers).argmin(1) for at in range(0, len(x), step)] or [np.empty(0, int)])


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centers = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        size = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        centers = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centers


def probes_needed(space: Space, raw: np.ndarray, centers: np.ndarray, k: int) -> int:
    """The least number of lists that gives TARGET recall for queries drawn from the sample."""
    if len(raw) <= k + 1:
        return len(centers)
    picked = np.arange(0, len(raw), max(1, len(raw) // 256))
    own = raw[picked]
    home = nearest(space.items(raw), centers)
    rank = np.argsort(np.argsort(_squares(space.queries(own), centers), axis=1), axis=1)
    scores = own @ raw.T
    scores[np.arange(len(own)), picked] = -np.inf
    best = np.argpartition(-scores, k, axis=1)[:, :k]
    depth = np.sort(rank[np.arange(len(own))[:, None], home[best]], axis=None)
    return min(len(centers), int(depth[min(len(depth) - 1, math.ceil(TARGET * len(depth)))]) + 1)


def regions(sizes: np.ndarray, centers: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """The region of each list, and the pieces of each list's region."""
    groups = kmeans(centers, max(1, min(len(centers), int(sizes.sum() // piece))))
    of, held, at = np.zeros(len(sizes), np.int32), {}, 0
    for i in np.argsort(nearest(centers, groups), kind="stable"):
        if held.get(at, 0) and held[at] + sizes[i] > piece:
            at += 1
        of[i] = at
        held[at] = held.get(at, 0) + int(sizes[i])
    return of, np.array([max(1, -(-held[r] // piece)) for r in of], np.int32)


def survivors(a: np.ndarray, b: np.ndarray, limit: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``a``, row of ``b``) that pass the tests of all column blocks; ``limit``: squared radius of each row of b."""
    dim = a.shape[1]
    edges = np.linspace(0, dim, max(1, round(dim / COLUMNS)) + 1).astype(int)
    part, pairs = np.zeros((len(a), len(b)), np.float32), None
    for at, to in zip(edges[:-1], edges[1:]):
        bound = (limit * (to / dim) * (1 + EPS0 / math.sqrt(to)) ** 2 if to < dim else limit) + slack
        if pairs is None:
            x, y = a[:, at:to], b[:, at:to]
            part -= 2 * (x @ y.T)
            part += (x * x).sum(1)[:, None]
            part += (y * y).sum(1)[None, :]
            alive = part <= bound.astype(np.float32)[None, :]
            if to == dim or np.count_nonzero(alive) <= SPARSE * alive.size:
                pairs, part = np.nonzero(alive), part[alive]
            else:
                part[~alive] = np.inf
        else:
            r, c = pairs
            part = part + ((a[r, at:to] - b[c, at:to]) ** 2).sum(1)
            alive = part <= bound[c]
            pairs, part = (r[alive], c[alive]), part[alive]
    return pairs


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int, known: np.ndarray):
        self.k, self.known = k, known
        self.score, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def kth(self, rows: np.ndarray) -> np.ndarray:
        """The least product that still counts."""
        return np.maximum(self.known[rows], self.score[rows, self.k - 1])

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        met = np.unique(rows)
        rows, score, ids = np.concatenate([rows, np.repeat(met, self.k)]), np.concatenate([score, self.score[met].ravel()]), np.concatenate([ids, self.ids[met].ravel()])
        order = np.lexsort((ids, -score, rows))
        first = np.searchsorted(rows[order], met)
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[met], self.ids[met] = score[take].reshape(-1, self.k), ids[take].reshape(-1, self.k)


def _useful(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k nearest of some query: of equal vectors the k + 1 least ids, each k times at most."""
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    g, i, at = same[order], ids[order], np.arange(len(order))
    head = np.r_[True, g[1:] != g[:-1]]
    new = head | np.r_[True, i[1:] != i[:-1]]
    nth = np.cumsum(new)
    place = nth - np.maximum.accumulate(np.where(head, nth, 0))
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.sort(order[(place <= k) & (copy < k)])


def scan(space: Space, x: np.ndarray, ids: np.ndarray, home: np.ndarray, q: np.ndarray, asks: np.ndarray, lists: pa.ListArray, known: np.ndarray, k: int) -> Best:
    """Searches the vectors ``x`` of some lists for queries ``q``, each in its own ``lists``, within the product ``known``."""
    keep = _useful(x, ids, k)
    keep = keep[np.argsort(home[keep], kind="stable")]
    x, ids, home = x[keep], ids[keep], home[keep]
    names, starts = np.unique(home, return_index=True)
    ends = [*starts[1:], len(home)]
    wants = np.zeros((len(q), len(names)), bool)
    flat, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    there = names[at] == flat
    wants[of[there], at[there]] = True
    items, turned, scale = space.items(x).astype(np.float32), space.queries(q).astype(np.float32), space.scale(q)
    best, slack = Best(len(q), k, known), 1e-5 * space.top
    for j, (start, end) in enumerate(zip(starts, ends)):
        asked = np.flatnonzero(wants[:, j])
        for block in (asked[i : i + BLOCK] for i in range(0, len(asked), BLOCK)):
            for low in range(start, end, BLOCK):
                high = min(end, low + BLOCK)
                cold = block[np.isneginf(best.kth(block))]
                if len(cold):  # no radius yet: the block's own k-th best gives one
                    s = q[cold] @ x[low:high].T
                    s[asks[cold][:, None] == ids[None, low:high]] = -np.inf
                    if high - low > k:
                        least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                        c, r = np.nonzero((s >= (least - slack)[:, None]) & ~np.isneginf(s))
                    else:
                        c, r = np.nonzero(~np.isneginf(s))
                    _score(best, x, q, ids, r + low, cold[c])
                warm = np.setdiff1d(block, cold, assume_unique=True) if len(cold) else block
                if len(warm):
                    radius = 2 * space.top - 2 * best.kth(warm) * scale[warm]
                    r, c = survivors(items[low:high], turned[warm], radius, slack)
                    r, c = r + low, warm[c]
                    other = ids[r] != asks[c]
                    _score(best, x, q, ids, r[other], c[other])
    return best


def _score(best: Best, x: np.ndarray, q: np.ndarray, ids: np.ndarray, r: np.ndarray, c: np.ndarray) -> None:
    """Exact products of pairs, term by term in one order, so that equal vectors score alike."""
    score = np.concatenate([(x[r[i : i + 65_536]] * q[c[i : i + 65_536]]).sum(1) for i in range(0, len(r), 65_536)] or [np.empty(0)])
    best.add(c, score, ids[r])


def _matrix(column, dim: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten(), dtype=np.float64).reshape(-1, dim)


def search(spark: SparkSession, vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest rows found for every row that ``queries`` selects."""
    kind = "array<float>" if vectors.schema[embedding].dataType.elementType == FloatType() else "array<double>"
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    named = named.where(F.col("vec_id").isNotNull())
    sizes = named.where(usable(F.col("v"))).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).alias("norm"))
    most = sizes.orderBy(F.desc("n"), "dim").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, space = most.dim, most.n, Space(most.dim, most.norm)
    good = named.where(usable(F.col("v"), dim))
    wanted = min(SAMPLE, max(LEAST_SAMPLE, 16 * math.isqrt(n)))
    mark = F.xxhash64("vec_id", "v")  # a hash filter first, so that few more rows than wanted are ordered
    drawn = good.where(F.pmod(mark, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * wanted / n)))
    raw = _matrix(drawn.orderBy(mark, "vec_id", "v").limit(wanted).select("v").toArrow()["v"], dim)
    if not len(raw):
        raw = _matrix(good.limit(wanted).select("v").toArrow()["v"], dim)
    lists = max(1, min(math.isqrt(n), len(raw) // 8))
    centers = kmeans(space.items(raw), lists)
    probe = probes_needed(space, raw, centers, k)

    def assign(batches):
        for batch in batches:
            home = nearest(space.items(_matrix(batch.column(1), dim)), centers)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32())], names=["vec_id", "v", "q", "list"])

    staged = Staged(spark, good.mapInArrow(assign, f"vec_id long, v {kind}, q boolean, list int"), "vectors")
    held = staged.df
    counts = np.zeros(lists, np.int64)
    for r in held.groupBy("list").count().collect():  # a row a list
        counts[r.list] = r["count"]
    piece = max(1, min(PIECE, max(1024, -(-n // (2 * spark.sparkContext.defaultParallelism)))))
    region_of, pieces = regions(counts, centers, piece)
    deal = F.broadcast(spark.createDataFrame([(i, int(region_of[i]), int(pieces[i])) for i in range(lists)], "list int, region int, pieces int"))  # a row a list
    asked = held.where("q").groupBy("vec_id").agg(F.min("v").alias("v"))

    def visits(asked: DataFrame, first: bool) -> DataFrame:
        """Rows (query_id, v, best, region, lists): a query's first lists, or its other ones, by region."""

        def run(batches):
            for batch in batches:
                q = _matrix(batch.column(1), dim)
                near = np.argsort(_squares(space.queries(q), centers), axis=1, kind="stable")[:, :probe] if len(q) else np.empty((0, probe), int)
                near = near[:, :NEAR] if first else near[:, NEAR:]
                row, near = np.repeat(np.arange(len(q)), near.shape[1]), near.ravel()
                order = np.lexsort((near, region_of[near], row))
                row, near = row[order], near[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (region_of[near[1:]] != region_of[near[:-1]])]) if len(row) else np.empty(0, int)
                of = pa.array(row[new])
                own = pa.ListArray.from_arrays(pa.array(np.r_[new, len(row)], pa.int32()), pa.array(near, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in range(3)), pa.array(region_of[near[new]], pa.int32()), own], names=["query_id", "v", "best", "region", "lists"])

        return asked.select("vec_id", "v", "best").mapInArrow(run, f"query_id long, v {kind}, best double, region int, lists array<int>")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        asks, known = right["query_id"].to_numpy(), np.nan_to_num(right["best"].to_numpy().astype(np.float64), nan=-np.inf)
        best = scan(space, _matrix(left["v"], dim), left["vec_id"].to_numpy(), left["list"].to_numpy(), _matrix(right["v"], dim), asks, right["lists"].combine_chunks(), known, k)
        got = ~np.isneginf(best.score)
        return pa.table({"query_id": np.repeat(asks, k)[got.ravel()], "vec_id": best.ids[got], "score": best.score[got]})

    def run(some: DataFrame, first: bool) -> DataFrame:
        sent = visits(some, first)
        many = sent.groupBy("region").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("parts"))  # a row a region
        items = held.select("vec_id", "v", "list").join(deal, "list").join(F.broadcast(many), "region")
        items = items.select("vec_id", "v", "list", "region", F.pmod(F.xxhash64("vec_id", "v"), F.col("pieces")).cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        whole = deal.groupBy("region").agg(F.max("pieces").alias("pieces"))
        sent = sent.join(F.broadcast(whole), "region").join(F.broadcast(many), "region")
        sent = sent.select("query_id", "v", "best", "lists", "region", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"))
        keys = ["region", "piece", "part"]
        return items.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(find, "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = Staged(spark, run(asked.withColumn("best", F.lit(None).cast("double")), True), "first").df
    if probe <= NEAR:
        return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    radius = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("best"))
    rest = run(asked.join(radius, "vec_id", "left"), False)
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
