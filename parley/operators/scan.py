"""Ordered scans by key in which a key, however long, is dealt over many tasks.

A window by key sorts a key in one task. Here the keys of more than ``LIMIT`` rows are
sorted into ranges of (key, order) first, and written; a key's rows in one range are a
segment, and every window is by (key, segment). What a segment needs from the others
(sums, counts, the few rows beside its ends) is carried over from one row a segment.
Other keys are one segment each, so their windows are as before.

Null keys are one key. Rows equal in key and order stay in one segment, in any order;
give an order without ties for defined results. Without rows, the result is empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.sources.tables import held

LIMIT = 100_000  # rows of a key beyond which it is scanned in ranges
PARTS = 8192  # ranges at most; beyond LIMIT * PARTS rows of long keys, ranges grow instead
SEGMENT = "_segment"


@dataclass(frozen=True)
class Scan:
    """Rows with a segment each, the key and the order; ``long`` says whether any key has more than one segment."""

    rows: DataFrame
    key: str
    order: tuple[str, ...]
    long: bool

    def _window(self):
        return Window.partitionBy(self.key, SEGMENT).orderBy(*self.order)

    def _carried(self, *aggs, carry: dict) -> DataFrame:
        """One row for each segment of the keys of several segments (two a range at most): ``carry`` over the key's ``aggs``."""
        own = self.rows.where(F.col(SEGMENT) >= 0).groupBy(self.key, SEGMENT).agg(*aggs)
        whole = own.select(self.key, SEGMENT, F.count("*").over(Window.partitionBy(self.key)).alias("_many"), *[c.alias(name) for name, c in carry.items()])
        return whole.where(F.col("_many") > 1).drop("_many").withColumnsRenamed({self.key: "_key", SEGMENT: "_at"})

    def _beside(self, carried: DataFrame) -> DataFrame:
        """At most 2 * PARTS rows are carried, so they are broadcast."""
        return self.rows.join(F.broadcast(carried), F.col(self.key).eqNullSafe(F.col("_key")) & (F.col(SEGMENT) == F.col("_at")), "left").drop("_key", "_at")

    def shift(self, **wanted: tuple[str, int]) -> Scan:
        """Adds columns: ``name=(column, k)`` is the column ``k`` rows before (behind, if negative), null beyond the key's ends."""
        w = self._window()
        plain = {name: F.lag(c, k).over(w) for name, (c, k) in wanted.items()}
        if not self.long:
            return replace(self, rows=self.rows.withColumns(plain))
        width, columns = max(abs(k) for _, k in wanted.values()), sorted({c for c, _ in wanted.values()})
        placed = replace(self, rows=self.rows.withColumns({"_p": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(self.key, SEGMENT))}))
        row = F.struct("_p", *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
        ends = lambda cond: F.array_sort(F.collect_list(F.when(cond, row)))  # noqa: E731  # width rows at most
        segments = Window.partitionBy(self.key).orderBy(SEGMENT)
        carried = placed._carried(
            ends(F.col("_p") > F.col("_n") - width).alias("_last"), ends(F.col("_p") <= width).alias("_first"),
            carry={"_earlier": F.flatten(F.collect_list("_last").over(segments.rowsBetween(-width, -1))), "_later": F.flatten(F.collect_list("_first").over(segments.rowsBetween(1, width)))},
        )  # every segment has a row, so ``width`` segments hold ``width`` rows
        out = {}
        for name, (c, k) in wanted.items():
            i = columns.index(c)
            if k > 0:
                out[name] = F.when(F.col("_p") > k, plain[name]).otherwise(F.try_element_at("_earlier", (F.col("_p") - k - 1).cast("int"))[f"v{i}"])
            elif k < 0:
                out[name] = F.when(F.col("_p") - k <= F.col("_n"), plain[name]).otherwise(F.try_element_at("_later", (F.col("_p") - k - F.col("_n")).cast("int"))[f"v{i}"])
            else:
                out[name] = F.col(c)
        return replace(self, rows=placed._beside(carried).withColumns(out).drop("_p", "_n", "_earlier", "_later"))

    def place(self, name: str) -> Scan:
        """Adds a row's place in its key, from 1."""
        if not self.long:
            return replace(self, rows=self.rows.withColumn(name, F.row_number().over(self._window())))
        return replace(self, rows=self.rows.withColumn("_one", F.lit(1).cast("long"))).before(**{name: "_one"}).then(lambda df: df.withColumn(name, (F.coalesce(name, F.lit(0)) + 1).cast("int")).drop("_one"))

    def before(self, **wanted: str) -> Scan:
        """Adds columns: ``name=column`` sums the column over the rows of the key before each row; null where they hold no value."""
        w = self._window().rowsBetween(Window.unboundedPreceding, -1)
        plain = {name: F.sum(c).over(w) for name, c in wanted.items()}
        if not self.long:
            return replace(self, rows=self.rows.withColumns(plain))
        earlier = Window.partitionBy(self.key).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
        carried = self._carried(*[F.sum(c).alias(f"_sum{i}") for i, c in enumerate(wanted.values())], carry={f"_carry{i}": F.sum(f"_sum{i}").over(earlier) for i in range(len(wanted))})
        both = {name: F.coalesce(plain[name] + F.col(f"_carry{i}"), plain[name], F.col(f"_carry{i}")) for i, name in enumerate(wanted)}
        return replace(self, rows=self._beside(carried).withColumns(both).drop(*[f"_carry{i}" for i in range(len(wanted))]))

    def whole(self, **wanted: str) -> Scan:
        """Adds columns: ``name=column`` sums the column over all rows of the key."""
        plain = {name: F.sum(c).over(Window.partitionBy(self.key, SEGMENT)) for name, c in wanted.items()}
        if not self.long:
            return replace(self, rows=self.rows.withColumns(plain))
        carried = self._carried(*[F.sum(c).alias(f"_sum{i}") for i, c in enumerate(wanted.values())], carry={f"_carry{i}": F.sum(f"_sum{i}").over(Window.partitionBy(self.key)) for i in range(len(wanted))})
        both = {name: F.coalesce(F.col(f"_carry{i}"), plain[name]) for i, name in enumerate(wanted)}
        return replace(self, rows=self._beside(carried).withColumns(both).drop(*[f"_carry{i}" for i in range(len(wanted))]))

    def then(self, step) -> Scan:
        """``step`` applied to the rows; it keeps the key, the order and the segments."""
        return replace(self, rows=step(self.rows))

    def done(self) -> DataFrame:
        return self.rows.drop(SEGMENT)


def scan(rows: DataFrame, key: str, order: list[str], limit: int = LIMIT) -> Scan:
    """Counts the rows of each key, pre-aggregated; only where some key has more than ``limit`` are rows sorted into ranges and written."""
    counted = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit)
    total = counted.agg(F.sum("_rows")).first()[0]
    if not total:
        return Scan(rows.withColumn(SEGMENT, F.lit(-1)), key, tuple(order), False)
    keys = held(counted.select("_key"), "longkeys")
    same = F.col(key).eqNullSafe(F.col("_key"))
    parts = min(max(2, math.ceil(total / limit)), PARTS)
    ranged = rows.join(keys, same, "left_semi").repartitionByRange(parts, key, *order).withColumn(SEGMENT, F.spark_partition_id())
    rest = rows.join(keys, same, "left_anti").withColumn(SEGMENT, F.lit(-1))
    return Scan(rest.unionByName(held(ranged, "ranges")), key, tuple(order), True)
