"""Connected components of an edge table, on the cluster.

Alternates the large-star and small-star steps of Kiveris et al. (2014). Minima
are combined before their shuffle, and each round is a written table. The join that
brings them back is by node: a hub's edges come as one key, streamed and never held,
and it is adaptive execution that splits them where they are many; without it they
pass through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.store import Staged


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum((F.col("u") > F.col("v")).cast("long")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below it are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) of every node with an edge; root is the component's least node.

    ``edges`` has two columns of one orderable type; loops and repeats do no harm.
    """
    a, b = edges.columns
    held = Staged(spark, edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    state = _state(held.df)
    for _ in range(max_rounds if state[0] else 0):
        nxt = Staged(spark, _small_star(_large_star(held.df)), "edges")
        held.drop()
        held, before, state = nxt, state, _state(nxt.df)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = held.df
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
