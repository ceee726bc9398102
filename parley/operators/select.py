"""Exact order statistics of one column, without sorting it: buckets, then the bucket that holds the rank.

A pass counts the values in ``BUCKETS`` even steps between bounds that hold the rank,
with each bucket's least and greatest value. Only the bucket of the rank is looked into
further, until the rank is at one of its ends or all its values are equal; a task hands
on a row a bucket, whatever the number of rows or ties.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def at_ranks(rows: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values at places (from 0) of the rising order; nulls and NaN take no part, places beyond it give the greatest."""
    own = rows.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    low, high, n = own.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not n:
        return [math.nan] * len(ranks)
    found: dict[int, float] = {}
    open_ = {min(max(r, 0), n - 1): (low, high, 0) for r in ranks}  # place -> bounds and the number of values below them
    while open_:
        for place in [p for p, (a, b, _) in open_.items() if a == b]:
            found[place] = open_.pop(place)[0]
        bounds = sorted({(a, b) for a, b, _ in open_.values()})  # apart from one another
        if not bounds:
            break
        which = F.coalesce(*[F.when(F.col("x").between(a, b), F.struct(F.lit(i).alias("i"), F.least(F.floor((F.col("x") / 2 - a / 2) / (b / 2 - a / 2) * BUCKETS), F.lit(BUCKETS - 1)).cast("int").alias("step"))) for i, (a, b) in enumerate(bounds)])
        counted = own.withColumn("at", which).where(F.col("at").isNotNull()).groupBy("at").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        steps = sorted((r["at"].i, r.a, r.b, r.n) for r in counted.collect())  # BUCKETS rows a pair of bounds
        for place, (a, b, below) in list(open_.items()):
            for i, a2, b2, count in steps:
                if i != bounds.index((a, b)):
                    continue
                if place < below + count:
                    if place == below:
                        b2 = a2
                    elif place == below + count - 1:
                        a2 = b2
                    open_[place] = (a2, b2, below)
                    break
                below += count
    return [found[min(max(r, 0), n - 1)] for r in ranks]


def percentile(rows: DataFrame, column: str, share: float) -> float | None:
    """The interpolated percentile, as ``F.percentile`` gives it; None without rows."""
    n = rows.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    place = share * (n - 1)
    low, high = at_ranks(rows, column, [math.floor(place), math.ceil(place)])
    return low + (high - low) * (place - math.floor(place)) if high != low else low


def mean_of_top(rows: DataFrame, column: str, top: int) -> float:
    """The mean of the ``top`` greatest values (of all, if fewer); 0 without rows."""
    n = rows.where(F.col(column).isNotNull()).count()
    top = min(top, n)
    if not top:
        return 0.0
    least = at_ranks(rows, column, [n - top])[0]
    above, many = rows.where(F.col(column) > least).agg(F.coalesce(F.sum(column), F.lit(0.0)), F.count("*")).first()
    return (above + (top - many) * least) / top
