"""Groups of free text: mutual-neighbour graph, average linkage, cosine k-means, names."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions import text as tx
from parley.operators import similarity, sparse
from parley.operators.similarity import mutual
from parley.sources.tables import held

#: Groups up to which linkage brings their pairs, at most half its square, to the driver.
MAX_LOCAL = 4000


def place(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``df`` with each row's place from 0 in a total order, without gathering rows in one task.

    Rows are range-partitioned and numbered inside their part; the parts' sizes, a row
    each, give the offsets.
    """
    parts = held(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = sorted((r.part, r.n) for r in parts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for number, n in sizes:
        before.append((number, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    own = parts.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return own.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def number(assigned: DataFrame) -> DataFrame:
    """Rows (id, cluster): groups numbered from 0, the largest first, ties by key."""
    sizes = assigned.groupBy("group").agg(F.count("*").alias("n"))
    ranked = place(sizes, F.desc("n"), F.asc("group"), name="cluster").select("group", F.col("cluster").cast("int").alias("cluster"))
    return assigned.join(ranked, "group").select("id", "cluster")


def link(postings: DataFrame, assigned: DataFrame, floor: float = 0.15) -> DataFrame:
    """Average linkage of all groups, single rows too: the most similar pair is merged while it reaches ``floor``.

    A pair's mean similarity is the product of the groups' mean vectors. Merging only ever
    lowers a group's similarity to a third one below the better of its parts', so all pairs
    that are each other's most similar group are merged in one round, and the result is that
    of merging one pair at a time. A round looks only for the nearest groups of new groups and
    of those whose nearest was merged, by ``sparse.nearest``, and groups without one leave the rounds.
    Two groups are left apart. Once few groups are left their rounds run on the driver, with the same result.
    """
    spark, kind = assigned.sparkSession, assigned.schema["group"].dataType.simpleString()
    sizes = held(assigned.groupBy("group").agg(F.count("*").alias("n")), "sizes")
    ranks = held(sparse.token_ranks(postings), "ranks")
    sums = postings.join(assigned, "id").groupBy("group", "token").agg(F.sum("weight").alias("w")).join(sizes, "group").select(F.col("group").alias("id"), "token", (F.col("w") / F.col("n")).alias("weight"))
    groups = held(sparse.vectors(sums, ranks).join(sizes.select(F.col("group").alias("id"), "n"), "id"), "groups")
    n = groups.count()
    others = sizes.count() - n  # groups without a token, which nothing is similar to
    home = held(sizes.select("group", F.col("group").alias("to")), "homes")
    near = held(sparse.nearest(groups, 1, floor, decimals=9), "near") if n > MAX_LOCAL else None
    while n > MAX_LOCAL and n + others > 2:
        groups = held(groups.join(near.select(F.col("left").alias("id")), "id", "left_semi"), "groups")
        others, n = others + n, groups.count()
        others -= n  # a group that nothing is similar enough to stays as it is: merging others never brings one nearer
        if n <= MAX_LOCAL:
            break
        merged = held(mutual(near, 0.0).select(F.col("right").alias("gone"), F.col("left").alias("keep")), "merged")
        if merged.isEmpty():
            return assigned.join(home, "group").select("id", F.col("to").alias("group"))
        moves = held(merged.select(F.col("gone").alias("id"), "keep").unionByName(merged.select(F.col("keep").alias("id"), "keep")), "moves")
        home = held(home.join(merged, F.col("to") == F.col("gone"), "left").select("group", F.coalesce("keep", "to").alias("to")), "homes")
        parts = groups.join(moves, "id").select(F.col("keep").alias("id"), "n", F.inline(F.arrays_zip("ranks", "weights")))
        whole = groups.join(moves, "id").groupBy(F.col("keep").alias("id")).agg(F.sum("n").alias("n"))
        added = parts.groupBy("id", "ranks").agg(F.sum(F.col("weights") * F.col("n")).alias("w")).join(whole, "id")
        new = added.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("ranks", (F.col("w") / F.col("n")).alias("weight")))).alias("t")).select("id", F.col("t.ranks").alias("ranks"), F.col("t.weight").alias("weights"), "n")
        touched = moves.select("id")
        groups = held(groups.join(touched, "id", "left_anti").unionByName(new), "groups")
        kept = near.join(touched.select(F.col("id").alias("left")), "left", "left_anti")
        lost = touched.select(F.col("id").alias("right"))
        ask = held(kept.join(lost, "right", "left_semi").select(F.col("left").alias("id")).unionByName(merged.select(F.col("keep").alias("id"))), "ask")
        near = held(kept.join(lost, "right", "left_anti").unionByName(sparse.nearest(groups, 1, floor, ask, decimals=9)), "near")
        n = groups.count()
    flat = held(groups.select("id", "n", F.inline(F.arrays_zip("ranks", "weights"))), "flat")
    b = flat.select(F.col("id").alias("other"), F.col("n").alias("m"), "ranks", F.col("weights").alias("wb"))
    pairs = flat.join(b, "ranks").where("id < other").groupBy(F.col("id").alias("group"), "other").agg(F.sum(F.col("weights") * F.col("n") * F.col("wb") * F.col("m")).alias("dot"))
    ends = _linked(groups.select(F.col("id").alias("group"), "n").orderBy("group").toArrow(), pairs.toArrow(), floor, others)
    table = spark.createDataFrame(ends, f"to {kind}, end {kind}")
    return assigned.join(home, "group").join(F.broadcast(table), "to", "left").select("id", F.coalesce("end", "to").alias("group"))


def _linked(sizes: pa.Table, pairs: pa.Table, floor: float, others: int = 0) -> list[tuple]:
    """(group, group it ends in) of the rounds that ``link`` describes, over a dense matrix of products; ``others`` are groups beside these."""
    names, n = sizes["group"].combine_chunks(), sizes["n"].to_numpy().astype(float)
    left, right = (pc.index_in(pairs[c], value_set=names).to_numpy() for c in ("group", "other"))
    dot = np.zeros((len(n), len(n)))
    dot[left, right] = dot[right, left] = pairs["dot"].to_numpy()
    home, own = np.arange(len(n)), np.arange(len(n))  # own: the group that each row of the matrix stands for
    while len(n) > 1 and len(n) + others > 2:
        mean = dot / n  # beside the products, the one matrix of a round
        mean /= n[:, None]
        np.round(mean, 9, out=mean)
        np.fill_diagonal(mean, -1)
        best, at = mean.argmax(1), np.arange(len(n))  # the first of equals, so ties follow one order of all pairs
        keep = np.flatnonzero((best[best] == at) & (at < best) & (mean[at, best] >= floor))
        if not len(keep):
            break
        gone = best[keep]
        dot[keep] += dot[gone]
        dot[:, keep] += dot[:, gone]
        n[keep] += n[gone]
        to = np.arange(len(home))
        to[own[gone]] = own[keep]
        home = to[home]
        stay = np.setdiff1d(at, gone)
        dot, n, own = dot[np.ix_(stay, stay)], n[stay], own[stay]
    labels = names.to_pylist()
    return [(g, labels[h]) for g, h in zip(labels, home.tolist())]


def graph_clusters(postings: DataFrame, ids: DataFrame, k: int = 5, link_at: float = 0.45, floor: float = 0.15) -> DataFrame:
    """Rows (id, cluster) of emergent groups: mutual neighbours, their components, then linkage; one rule at every size."""
    near = held(similarity.posting_knn(postings, k, link_at), "near")
    groups = similarity.components(ids, similarity.mutual(near, link_at)).select("id", F.col("component").alias("group"))
    return number(link(postings, held(groups, "groups"), floor))


def kmeans_cosine(vectors: DataFrame, id_col: str, vector: str, k: int, rounds: int = 40) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, cluster, sim) and the centers: spherical k-means over all rows, seeded farthest first."""
    own = held(similarity.unit(vectors, id_col, vector), "unit")
    centers = fit(own, [k], rounds)[k]
    return to_nearest(own, centers), centers


def to_nearest(own: DataFrame, centers: np.ndarray) -> DataFrame:
    """Rows (id, cluster, sim): the nearest center of each row of ``own`` (id, v)."""

    def assign(batches):
        for batch in batches:
            v = np.array(batch.column(1).to_pylist()).reshape(-1, centers.shape[1])
            sims = v @ centers.T
            best = sims.argmax(1) if len(v) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(np.round(sims[np.arange(len(v)), best], 6))], names=["id", "cluster", "sim"])

    return own.mapInArrow(assign, f"id {own.schema['id'].dataType.simpleString()}, cluster int, sim double")


def fold(rows: DataFrame | np.ndarray, part, merge=np.add) -> np.ndarray:
    """``part`` (a block of vectors to a flat array) over all vectors of ``rows`` (column v), merged; empty without rows.

    Each task hands on one array, whatever its rows.
    """
    if isinstance(rows, np.ndarray):
        return part(rows)

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                total = own if total is None else merge(total, own)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(float).tobytes()], pa.binary())], names=["m"])

    parts = [np.frombuffer(r.m) for r in rows.select("v").mapInArrow(run, "m binary").collect()]
    return functools.reduce(merge, parts) if parts else np.empty(0)


def _higher(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The one of two (score, vector) of the higher score, ties by vector."""
    return max(a, b, key=lambda m: (round(m[0], 12), *m[1:]))


def seeds(rows: DataFrame | np.ndarray, k: int) -> np.ndarray:
    """The row nearest to the mean, then row by row the one farthest from those before; at most as many as there are rows."""
    total = fold(rows, lambda x: np.append(x.sum(0), len(x)))
    if not len(total):
        return np.empty((0, 0))
    mean, n = total[:-1] / total[-1], int(total[-1])

    def leading(score):
        def part(x):
            s = np.round(score(x), 12)
            return functools.reduce(_higher, [np.append(s[i], x[i]) for i in np.flatnonzero(s == s.max())])

        return fold(rows, part, _higher)[1:]

    chosen = leading(lambda x: x @ mean)[None]
    while len(chosen) < min(k, n):
        chosen = np.vstack([chosen, leading(lambda x, c=chosen: -(x @ c.T).max(1))])
    return chosen


def fit(rows: DataFrame | np.ndarray, ks: list[int], rounds: int = 40) -> dict[int, np.ndarray]:
    """Centers for each k: all of them in one pass over the rows a round, whose sums alone come to the driver."""
    start = seeds(rows, max(ks))
    centers, left = {k: start[:k].copy() for k in ks}, list(ks) if len(start) else []

    def sums(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        own = np.zeros((len(x), len(c)))
        own[np.arange(len(x)), (x @ c.T).argmax(1)] = 1
        return np.hstack([own.T @ x, own.sum(0)[:, None]]).ravel()

    for _ in range(rounds):
        if not left:
            break
        got = fold(rows, lambda x, at=[centers[k] for k in left]: np.concatenate([sums(x, c) for c in at]))
        for k in list(left):
            old = centers[k]
            size = len(old) * (old.shape[1] + 1)
            own, got = got[:size].reshape(len(old), -1), got[size:]
            new = np.where(own[:, -1:] > 0, own[:, :-1] / np.maximum(own[:, -1:], 1), old)
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-8)
            if np.allclose(new, old):
                left.remove(k)
            else:
                centers[k] = new
    return centers


def best_fit(rows: DataFrame | np.ndarray) -> tuple[int, np.ndarray]:
    """The k from 3 to min(14, sqrt(n / 1.6)) with the best margin between own and next center, less a price per group, and its centers."""
    n = fold(rows, lambda x: np.array([len(x)]))
    n = int(n[0]) if len(n) else 0
    ks = list(range(3, min(14, max(3, round(math.sqrt(n / 1.6)))) + 1))
    centers = fit(rows, ks)

    def margin(x: np.ndarray, c: np.ndarray) -> float:
        sims = np.sort(x @ c.T, axis=1)
        return float((sims[:, -1] - sims[:, -2]).sum()) if len(c) > 1 else -math.inf

    got = fold(rows, lambda x: np.array([margin(x, centers[k]) for k in ks]))
    best = max(zip(ks, got, strict=False), key=lambda m: m[1] / n - 0.006 * m[0], default=(3, 0))[0]
    return best, centers[best]


def choose_k(x: DataFrame | np.ndarray) -> int:
    return best_fit(x)[0]


def merge_close(centers: np.ndarray, at: float = 0.72) -> list[int]:
    """For each center the least center it is merged with, by chains of similarity ``at`` or more."""
    home = list(range(len(centers)))
    for i in range(len(centers)):
        for j in range(i):
            if home[i] != home[j] and centers[i] @ centers[j] >= at:
                low, high = sorted((home[i], home[j]))
                home = [low if h == high else h for h in home]
    return home


def names(docs: DataFrame, assigned: DataFrame, postings: DataFrame, vocab: DataFrame, text: str = "text", terms: int = 6, min_idf: float = 2.2) -> DataFrame:
    """Rows (cluster, n, terms, label): class-weighted terms of the core rows and the medoid's first sentence."""
    ranked = held(similarity.centroid_rank(postings, assigned.select("id", F.col("cluster").alias("group"))), "ranked")
    inner = similarity.core(ranked)
    tf = tx.term_rows(tx.term_counts(docs.join(inner.select("id"), "id", "left_semi"), "id", text))
    counted = tf.join(vocab.where(F.col("idf") >= min_idf).select("token"), "token", "left_semi").join(inner.select("id", "group"), "id").groupBy("group", "token").agg(F.sum("tf").alias("n"))
    weighted = tx.class_tfidf(counted)
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc(F.round("weight", 9)), "token"))
    best = weighted.withColumn("place", place).where(F.col("place") <= terms).groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda x: F.replace(x["token"], F.lit("_"), F.lit(" "))).alias("terms"))
    medoid = docs.join(ranked.where("rank = 1").select("id", "group"), "id").select("group", tx.first_sentence_label(F.col(text)).alias("label"))
    sizes = assigned.groupBy(F.col("cluster").alias("group")).agg(F.count("*").alias("n"))
    return sizes.join(best, "group", "left").join(medoid, "group", "left").select(F.col("group").alias("cluster"), "n", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("label", F.concat(F.lit("Group "), (F.col("group") + 1).cast("string"))).alias("label"))


def distinct_terms(terms: list[str], limit: int = 4) -> list[str]:
    """Terms that add a word: one whose words are all in those before it is left out."""
    seen: set[str] = set()
    out = []
    for term in terms:
        words = set(term.replace("_", " ").split())
        if words - seen:
            out.append(term.replace("_", " "))
            seen |= words
        if len(out) == limit:
            break
    return out


def subtitle(terms: list[str]) -> str:
    """The two leading terms as a phrase."""
    best = distinct_terms(terms, 2)
    return " and ".join(best).capitalize() if best else ""


def subject(terms: list[str], idf: dict[str, float], floor: float = 3.5) -> str | None:
    """The term that holds the rarest word, if that word is rare at all; ties to the first."""
    rare = [(max(idf.get(w, 0.0) for w in t.replace("_", " ").split()), -i, t) for i, t in enumerate(terms)]
    best = max(rare, default=(0.0, 0, None))
    return best[2].replace("_", " ") if best[0] >= floor else None


def topical(words: list[str], idf: dict[str, float], known: int = 8, unseen: int = 8) -> list[str]:
    """A topic's query: its known words, the rarest first, and some the vocabulary lacks."""
    have = sorted({w for w in words if w in idf}, key=lambda w: (-idf[w], w))[:known]
    return have + sorted({w for w in words if w not in idf})[:unseen]
