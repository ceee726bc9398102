"""Exact neighbours among sparse vectors, at any size: a join on prefixes that norms bound.

The tokens of a vector are put in one order, the rarest first. Let s(i) be the norm
of a vector from its i-th token on. If the first token that two vectors share is
the i-th of one and the j-th of the other, their product is at most s(i) * s(j). So a
vector that looks for products of ``least`` or more has to offer only the tokens of
its prefix, those with s(i) times the largest norm at ``least`` or above, and two
vectors are a candidate pair only if at some shared token the product of the weights
plus the product of the norms behind it reaches ``least``. Candidates are verified on
whole vectors; nothing is approximate and nothing is capped.

Where the floor is so low that prefixes are hardly shorter than whole vectors, blocks of
whole lists are scanned instead. Otherwise nearest neighbours take two joins. The first looks for products from ``START``
on; the products that it verifies give each vector a bound that its k-th neighbour
reaches at least, and only vectors without k neighbours yet join again, each from its
own bound on.

The lists of frequent tokens are dealt over parts of about ``LIST`` vectors, and the
vectors that look one up go to each part. Equal vectors are one class (a table may
hold a million copies of one text): classes are joined, and each row's neighbours
come from the k + 1 least ids of the classes near its own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.sources.tables import dropped, held, written

#: Products from which the first join looks for neighbours.
START = 0.45
#: Vectors of one part of a token's list.
LIST = 20_000
#: Whole lists are scanned where the lists of prefixes meet in more than one in so many of their pairs; a pair costs the join that much more.
SCAN = 10
#: Postings whose lists are in each task in one pass of a scan.
LISTED = 2_000_000
#: Tokens in more than one in so many vectors of a pass are dense columns, of at most LISTED cells.
DENSE = 12
#: Passes whose results are merged.
MERGED = 12
#: Vectors of one block; the pairs of two blocks are verified together.
BLOCK = 1024
#: Rows of a class from which its neighbours are sent to the tasks instead of its rows to one task.
CROWD = 100_000
#: Ids of copies up to which they are sent to the tasks.
COPIES = 1_000_000
#: Decimals of a similarity: neighbours that agree in them are ordered by id.
DECIMALS = 6


def token_ranks(postings: DataFrame) -> DataFrame:
    """Rows (token, rank): whole numbers from 0, the rarest token first, ties by name."""
    from parley.operators.cluster import place

    df = postings.groupBy("token").agg(F.count("*").alias("n"))
    return place(df, F.asc("n"), F.asc("token"), name="rank").select("token", "rank")


def vectors(postings: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Rows (id, ranks, weights), one per id of (id, token, weight), the rarest token first; tokens of one id are distinct."""
    ranks = held(token_ranks(postings), "ranks") if ranks is None else ranks
    own = postings.where(F.col("weight") != 0).join(ranks, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "weight"))).alias("t"))
    return own.select("id", F.col("t.rank").alias("ranks"), F.col("t.weight").alias("weights"))


def prefixes(rows: DataFrame, reach: float) -> DataFrame:
    """Rows (id, rank, w, rest, least) of the tokens that a vector of (id, ranks, weights, least) has to offer.

    ``reach`` is the largest norm on the other side; ``rest`` is the norm behind the token.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 2048) for whole in batches for at in range(0, whole.num_rows, 2048)):
            ranks, w = batch.column(1).flatten(), batch.column(2).flatten().to_numpy()
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            of = np.repeat(np.arange(batch.num_rows), sizes)
            upto = np.concatenate([[0.0], np.cumsum(w * w)])
            ends = np.cumsum(sizes)
            tail = np.maximum(upto[ends][of] - upto[1:], 0.0)
            least = batch.column(3).to_numpy()[of]
            keep = np.flatnonzero(np.sqrt(tail + w * w) * reach >= least - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[keep])), ranks.take(pa.array(keep)), pa.array(w[keep]), pa.array(np.sqrt(tail[keep]) + 1e-9), pa.array(least[keep])], names=["id", "rank", "w", "rest", "least"])

    return rows.select("id", "ranks", "weights", F.col("least").cast("double")).mapInArrow(run, f"id {kind}, rank long, w double, rest double, least double")


def candidates(ask: DataFrame, offer: DataFrame, n: int, both_ways: bool = False) -> DataFrame:
    """Distinct pairs (left, right) whose product may reach what the left one looks for; ``both_ways``: left < right only.

    ``ask`` and ``offer`` are ``prefixes``; ``offer`` is of ``n`` vectors.
    """
    n_parts = 0
    if n > LIST:
        parts = held(offer.groupBy("rank").agg(F.ceil(F.count("*") / LIST).cast("int").alias("parts")).where("parts > 1"), "lists")
        n_parts = parts.count()  # tokens in more than LIST vectors: at most the table's postings over LIST
        few = F.broadcast(parts) if n_parts <= CROWD else parts

    def dealt(df: DataFrame, part: Column) -> DataFrame:
        if not n_parts:
            return df.withColumn("part", F.lit(0))
        return df.join(few, "rank", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part).drop("parts")

    left = dealt(ask, F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("rank", "part", F.col("id").alias("left"), F.col("w").alias("wl"), F.col("rest").alias("rl"), "least")
    right = dealt(offer, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("rank", "part", F.col("id").alias("right"), F.col("w").alias("wr"), F.col("rest").alias("rr"))
    apart = F.col("left") < F.col("right") if both_ways else F.col("left") != F.col("right")
    may = F.abs(F.col("wl") * F.col("wr")) + F.col("rl") * F.col("rr") >= F.col("least") - 1e-9
    return left.join(right, ["rank", "part"]).where(apart & may).select("left", "right").distinct()


def products(pairs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Rows (left, right, dot): the products of pairs of vectors of ``rows`` (id, ranks, weights), ``n`` of them.

    Vectors are dealt into blocks and a task takes the pairs of two blocks, so a vector is
    sent once to each pair of blocks in which it has a pair, not once a pair.
    """
    kind, blocks = rows.schema["id"].dataType.simpleString(), max(1, -(-n // BLOCK))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    dealt = pairs.select("left", "right", of("left").alias("bl"), of("right").alias("br"))
    needed = dealt.select(F.col("bl").alias("one"), F.col("br").alias("two"), F.explode(F.array("left", "right")).alias("id")).distinct().join(rows.select("id", "ranks", "weights"), "id")

    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        ids, asked = own["id"].combine_chunks(), asked.combine_chunks()
        listed = own["ranks"].combine_chunks()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(listed).to_numpy(zero_copy_only=False))]).astype(np.int64)
        terms = np.unique(listed.flatten().to_numpy(), return_inverse=True)[1]
        weights = own["weights"].combine_chunks().flatten().to_numpy()
        left, right = (pc.index_in(asked[c].combine_chunks(), value_set=ids).to_numpy().astype(np.int64) for c in ("left", "right"))
        order = np.argsort(left, kind="stable")
        starts = np.flatnonzero(np.diff(left[order], prepend=-1))
        dot, dense = np.zeros(len(left)), np.zeros(int(terms.max(initial=-1)) + 1)
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
            x = left[order[a]]
            mine = slice(ends[x], ends[x + 1])
            dense[terms[mine]] = weights[mine]
            for at in range(a, z, 4096):  # a hub's partners, some at a time
                y = right[order[at : min(z, at + 4096)]]
                sizes = ends[y + 1] - ends[y]
                until = np.cumsum(sizes)
                flat = np.arange(until[-1]) + np.repeat(ends[y] - (until - sizes), sizes)
                dot[order[at : at + len(y)]] = np.add.reduceat(dense[terms[flat]] * weights[flat], until - sizes)
            dense[terms[mine]] = 0.0
        return pa.table({"left": asked["left"], "right": asked["right"], "dot": pa.array(dot)})

    return dealt.groupBy("bl", "br").cogroup(needed.groupBy("one", "two")).applyInArrow(run, f"left {kind}, right {kind}, dot double")


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The k rows of each left of the highest sim, ties to the lower right, with their rank."""
    rank = F.row_number().over(Window.partitionBy("left").orderBy(F.desc("sim"), "right"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def reach_of(rows: DataFrame) -> tuple[float, int]:
    """The largest norm of vectors (id, ranks, weights), and their number."""
    square = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x * x)
    reach, n = rows.agg(F.sqrt(F.max(square)), F.count("*")).first()
    return reach or 0.0, n


def similar(rows: DataFrame, floor: float, decimals: int = DECIMALS) -> DataFrame:
    """Rows (left, right, sim), left < right, of all pairs of (id, ranks, weights) of ``floor`` or more; ``floor`` is above 0."""
    (reach, n), slack = reach_of(rows), 0.5 * 10.0**-decimals
    own = held(prefixes(rows.withColumn("least", F.lit(floor - slack)), reach), "prefixes")
    return products(candidates(own, own, n, both_ways=True), rows, n).select("left", "right", F.round("dot", decimals).alias("sim")).where(F.col("sim") >= floor)


def list_pairs(offered: DataFrame) -> float:
    """In how many pairs of vectors the lists of (rank) rows meet."""
    return offered.groupBy("rank").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0))).first()[0]


def dealt(rows: DataFrame) -> list[DataFrame]:
    """Vectors in parts of about ``LISTED`` postings, by a hash of the id."""
    size = rows.agg(F.coalesce(F.sum(F.size("ranks")), F.lit(0))).first()[0]
    n = max(1, -(-size // LISTED))
    return [rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i) for i in range(n)]


def _lists(own: pa.Table) -> tuple:
    """Lists of vectors (id, ranks, weights) by token: ids in order, known tokens, their bounds, places and weights, and dense columns of the most frequent ones."""
    own = own.sort_by("id").combine_chunks()
    listed = own["ranks"].combine_chunks()
    of = np.repeat(np.arange(own.num_rows, dtype=np.int32), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
    ranks = listed.flatten().to_numpy()
    known = np.unique(ranks)
    terms = np.searchsorted(known, ranks).astype(np.int32)
    sizes = np.bincount(terms, minlength=len(known))
    dense = np.argsort(-sizes, kind="stable")[: min(LISTED // max(own.num_rows, 1), int((sizes > own.num_rows / DENSE).sum()))]
    column = np.full(len(known), -1, np.int32)
    column[dense] = np.arange(len(dense))
    weights, at = own["weights"].combine_chunks().flatten().to_numpy(), column[terms]
    table = np.zeros((own.num_rows, len(dense)))
    table[of[at >= 0], at[at >= 0]] = weights[at >= 0]
    rest = np.flatnonzero(at < 0)
    order = rest[np.argsort(terms[rest], kind="stable")]
    first = np.searchsorted(terms[order], np.arange(len(known) + 1)).astype(np.int32)
    return own["id"].combine_chunks(), known, first, of[order], weights[order], column, table


def scan(asking: DataFrame, parts: list[DataFrame], k: int, floor: float, decimals: int) -> DataFrame:
    """Rows (left, right, sim, rank), as ``nearest`` gives them, from whole lists: in each pass all tasks have the lists of some vectors.

    Vectors are never shuffled. A pass has one of ``parts``, of about ``LISTED`` postings, and reads ``asking`` once; only
    the k best of each asking vector are written, and ``MERGED`` passes are merged into one list.
    """
    kind = asking.schema["id"].dataType.simpleString()
    asked = asking.select(*[F.col(c).alias(c) for c in ("id", "ranks", "weights")])

    def one(part: DataFrame) -> tuple[DataFrame, str]:
        shared = part.sparkSession.sparkContext.broadcast(_lists(part.select("id", "ranks", "weights").toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, known, first, docs, weights, column, table = shared.value
            step = max(1, min(128, (1 << 21) // max(len(ids), 1)))
            for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows if len(ids) else 0, step)):
                ends = np.concatenate([[0], np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))])
                mine, w = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1) if len(known) else np.zeros(len(mine), int)
                met = known[at] == mine if len(known) else np.zeros(len(mine), bool)
                of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                own = np.flatnonzero(met & (column[at] >= 0)) if len(known) else np.empty(0, int)
                frequent = np.zeros((batch.num_rows, table.shape[1]))
                frequent[of[own], column[at[own]]] = w[own]
                every = frequent @ table.T
                self_at = pc.index_in(batch.column(0), value_set=ids).fill_null(-1).to_numpy()
                out: list[list[np.ndarray]] = [[], [], []]
                for x in range(batch.num_rows):
                    some = np.flatnonzero(met[ends[x] : ends[x + 1]]) + ends[x]
                    low = first[at[some]]
                    sizes = first[at[some] + 1] - low
                    upto = np.cumsum(sizes)
                    sims = every[x]
                    if len(upto) and upto[-1]:
                        flat = np.arange(upto[-1], dtype=np.int32) + np.repeat((low - (upto - sizes)).astype(np.int32), sizes)
                        sims = sims + np.bincount(docs[flat], weights=weights[flat] * np.repeat(w[some], sizes), minlength=len(ids))
                    if self_at[x] >= 0:
                        sims[self_at[x]] = -1.0
                    good = np.flatnonzero(sims >= max(floor, 0.5 * 10.0**-decimals) - 10.0**-decimals)
                    if len(good) > k:  # what rounds to the k-th best or more
                        good = good[sims[good] >= np.partition(sims[good], len(good) - k)[len(good) - k] - 10.0**-decimals]
                    near = np.round(sims[good], decimals)
                    fit = near >= floor if floor > 0 else near > 0
                    good, near = good[fit], near[fit]
                    first_k = np.argsort(-near, kind="stable")[:k]  # places are in order of id
                    for to, value in zip(out, (np.full(len(first_k), x), good[first_k], near[first_k])):
                        to.append(value)
                left, right, sim = (np.concatenate([np.empty(0, int), *x]) for x in out)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(left.astype(int))), ids.take(pa.array(right.astype(int))), pa.array(sim.astype(float))], names=["left", "right", "sim"])

        out = written(asked.mapInArrow(run, f"left {kind}, right {kind}, sim double"), "pass")
        shared.destroy()
        return out

    seen: list[tuple[DataFrame, str]] = []
    every = lambda: best(functools.reduce(DataFrame.unionByName, [df for df, _ in seen]), k)
    for part in parts:
        seen.append(one(part))
        if len(seen) == MERGED:
            merged = written(every().drop("rank"), "best")
            for df, path in seen:
                dropped(df.sparkSession, path)
            seen = [merged]
    return every()


def nearest(rows: DataFrame, k: int, floor: float, ask: DataFrame | None = None, decimals: int = DECIMALS, start: float = START, parts: list[DataFrame] | None = None) -> DataFrame:
    """Rows (left, right, sim, rank): the k most similar others of each vector, by their rounded product, ties to the lower id.

    ``rows`` has (id, ranks, weights), ids once each; neighbours reach ``floor`` (or are above 0 where it is 0).
    ``ask`` (id) names the vectors that look for neighbours, all by default. Where prefixes
    are hardly shorter than whole vectors, whole lists are scanned instead, by ``parts`` of the rows; the result is the same.
    """
    slack = 0.5 * 10.0**-decimals
    asking = rows if ask is None else rows.join(ask.select("id"), "id", "left_semi")
    if SCAN and floor <= slack:  # every token is offered then
        return scan(asking, parts or dealt(rows), k, floor, decimals)
    reach, n = reach_of(rows)
    every = list_pairs(rows.select(F.explode("ranks").alias("rank")))
    offered = held(prefixes(rows.withColumn("least", F.lit(floor - slack)), reach), "offered")
    if SCAN * list_pairs(offered) > every:
        return scan(asking, parts or dealt(rows), k, floor, decimals)
    enough = F.col("sim") > 0 if floor <= 0 else F.col("sim") >= floor
    start = max(start, floor)
    least = F.lit(start - slack)
    if start > floor:
        offered = held(prefixes(rows.withColumn("least", least), reach), "offered")
    asked = offered if ask is None else prefixes(asking.withColumn("least", least), reach)
    pairs = products(candidates(asked, offered, n, both_ways=ask is None), rows, n).select("left", "right", F.round("dot", decimals).alias("sim")).where("sim > 0")
    seen = held(pairs, "verified")
    if ask is None:
        seen = seen.unionByName(seen.select(F.col("right").alias("left"), F.col("left").alias("right"), "sim"))
    top = best(seen.where(enough), k)
    if floor >= start:
        return top
    top = held(top, "nearest")
    bound = top.groupBy(F.col("left").alias("id")).agg(F.when(F.count("*") == k, F.min("sim")).otherwise(F.lit(max(floor, 0.0))).alias("known"))
    open_ = asking.join(bound, "id", "left").withColumn("least", F.greatest(F.coalesce("known", F.lit(max(floor, 0.0))), F.lit(2 * slack)) - slack).drop("known").where(F.col("least") < start - slack)
    open_ = held(open_, "open")
    lowest = open_.agg(F.min("least")).first()[0]
    if lowest is None:
        return top
    # what the open vectors find from their bounds on holds all that they have found before
    more = candidates(prefixes(open_, reach), prefixes(rows.withColumn("least", F.lit(lowest)), reach), n)
    found = best(products(more, rows, n).select("left", "right", F.round("dot", decimals).alias("sim")).where(enough), k)
    return top.join(open_.select(F.col("id").alias("left")), "left", "left_anti").select("left", "right", "sim", "rank").unionByName(found.select("left", "right", "sim", "rank"))


def classes(rows: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], DataFrame]:
    """(heads, members): what leaves distinct vectors under their least id of some of the rows, and (id, class) of every row.

    Vectors are told apart by 128 bits of hash; only these are written, and the vectors are mapped from ``rows`` anew.
    """
    mark = F.struct(F.xxhash64("ranks", "weights").alias("a"), F.xxhash64(F.lit(1), "weights", "ranks").alias("b"))
    marked = held(rows.select("id", mark.alias("mark")), "marked")
    several = marked.groupBy("mark").agg(F.count("*").alias("n"), F.min("id").alias("class")).where("n > 1")
    several = held(several, "several")
    n = several.count()
    few = F.broadcast(several) if n <= CROWD else several
    owned = held(marked.join(few, "mark", "left").select("id", F.coalesce("class", "id").alias("class")), "members")
    copies = owned.where("id <> class").select("id")
    gone = F.broadcast(copies) if copies.count() <= COPIES else copies
    return lambda some: some.join(gone, "id", "left_anti").select("id", "ranks", "weights"), owned


def neighbours(postings: DataFrame, k: int = 5, floor: float = 0.0) -> DataFrame:
    """Rows (left, right, sim, rank): each row's k most similar others over sparse rows (id, token, weight), exactly.

    Neighbours reach ``floor`` (or are above 0 where it is 0); ties go to the lower id.
    """
    return vector_neighbours(held(vectors(postings), "vectors"), k, floor)


def vector_neighbours(rows: DataFrame, k: int = 5, floor: float = 0.0, parts: list[DataFrame] | None = None) -> DataFrame:
    """``neighbours`` over vectors (id, ranks, weights), which may come in ``parts`` too; they are read some times, and not written where all lists are scanned."""
    distinct, owned = classes(rows)
    heads = distinct(rows)
    near = held(nearest(heads, k, floor, parts=[distinct(part) for part in parts] if parts else None), "near")
    sizes = owned.groupBy("class").agg(F.count("*").alias("n")).where("n > 1")
    place = F.row_number().over(Window.partitionBy("class").orderBy("id"))
    several = owned.join(sizes.select("class"), "class", "left_semi") if not sizes.isEmpty() else None
    if several is None:
        return near
    # the k + 1 least rows of each class, and of them those that a class's own rows may have as neighbours
    firsts = owned.withColumn("place", place).where(F.col("place") <= k + 1).select("class", "id")
    firsts = held(firsts, "firsts")
    own_square = heads.select(F.col("id").alias("class"), F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x * x), DECIMALS).alias("sim"))
    inner = sizes.join(own_square, "class").where(F.col("sim") >= floor).select(F.col("class").alias("left"), F.col("class").alias("right"), "sim")
    around = near.select("left", "right", "sim").unionByName(inner).join(firsts.select(F.col("class").alias("right"), F.col("id").alias("row")), "right")
    lists = best(around.select("left", F.col("row").alias("right"), "sim"), k + 1).select(F.col("left").alias("class"), F.col("right"), "sim")
    lists = held(lists.groupBy("class").agg(F.collect_list(F.struct("right", "sim")).alias("near")), "lists")
    crowds = F.broadcast(owned.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD).select("class"))  # at most the rows over CROWD
    met = owned.join(crowds, "class").join(F.broadcast(lists.join(crowds, "class")), "class").unionByName(owned.join(crowds, "class", "left_anti").join(lists, "class"))
    flat = met.select(F.col("id").alias("left"), F.inline("near")).where("left <> right").select("left", "right", "sim")
    return best(flat, k)
