"""Grouped aggregates, folded tails, profiles and what sets a group apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions import scalar

OTHER = "__other__"


def rows_of(df: DataFrame, row_id: Column, group: Column | None, metric: Column | None, eligible: Column | None = None, null_as_zero: bool = True) -> DataFrame:
    """The engine's row shape: (id, group_key, value), eligible rows only, one row per id and group."""
    kept = df if eligible is None else df.where(F.coalesce(eligible, F.lit(True)))
    return kept.select(row_id.alias("id"), scalar.group_key(group).alias("group_key"), scalar.metric_value(metric, null_as_zero).alias("value"))


def grouped(rows: DataFrame, aggregate: str = "count") -> DataFrame:
    """Rows (group_key, count, total, value, share) from (group_key, value).

    ``aggregate`` is count, sum, avg or max; share is of all counted rows.
    """
    how = {"count": F.count("*").cast("double"), "sum": F.sum("value"), "avg": F.avg("value"), "max": F.max("value")}[aggregate]
    groups = rows.groupBy("group_key").agg(F.count("*").alias("count"), F.sum("value").alias("total"), how.alias("value"))
    everyone = groups.agg(F.sum("count")).scalar()
    return groups.select("group_key", "count", F.round("total", 6).alias("total"), F.round("value", 6).alias("value"), F.round(scalar.share(F.col("count"), everyone), 6).alias("share"))


def totals(rows: DataFrame) -> DataFrame:
    """One row (denominator, value_sum, value_mean)."""
    return rows.agg(F.count("*").alias("denominator"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("value_sum"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("value_mean"))


def by_value(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("value"), F.desc("count"), "group_key")


def by_key(groups: DataFrame) -> DataFrame:
    """Trend order: days, weeks and hours by key."""
    return groups.orderBy("group_key")


def yes_first(groups: DataFrame) -> DataFrame:
    """Order of boolean answers: yes, then no, then unknown, whatever their size; other keys by value."""
    keys = F.col("group_key")
    only = groups.agg(F.bool_and(keys.isin("yes", "no", "unknown")) & F.bool_or(keys == "yes") & F.bool_or(keys == "no")).scalar()
    place = F.when(keys == "yes", 0).when(keys == "no", 1).otherwise(2)
    return groups.orderBy(F.when(only, place).otherwise(0), F.desc("value"), F.desc("count"), "group_key")


def fold_tail(groups: DataFrame, keep: int = 12, aggregate: str = "count") -> DataFrame:
    """The ``keep`` best groups and one group for the rest.

    The head is a bounded top-k; the rest is relabelled by a join with those few keys,
    so no global sort runs. A folded mean is the mean over the folded rows.
    """
    head = groups.orderBy(F.desc("value"), F.desc("count"), "group_key").limit(keep).select("group_key", F.lit(True).alias("head"))
    marked = groups.join(F.broadcast(head), "group_key", "left")
    everyone = groups.agg(F.sum("count")).scalar()
    key = F.when(F.col("head"), F.col("group_key")).otherwise(F.lit(OTHER)).alias("group_key")
    value = {"count": F.sum("count").cast("double"), "sum": F.sum("total"), "avg": F.sum("total") / F.sum("count"), "max": F.max("value")}[aggregate]
    return marked.groupBy(key).agg(F.sum("count").alias("count"), F.round(F.sum("total"), 6).alias("total"), F.round(value, 6).alias("value"), F.round(scalar.share(F.sum("count"), everyone), 6).alias("share"))


def top_per_group(rows: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """Rows (group, item, n, rank): each group's k most frequent items, ties to the item that sorts first.

    Items are counted before they are ranked, so a hot group brings one row per item.
    """
    counted = rows.where(F.col(item).isNotNull()).groupBy(group, item).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), item))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def top_list(rows: DataFrame, group: str, item: str, k: int, name: str) -> DataFrame:
    """Rows (group, name): the k most frequent items as an array, best first."""
    ranked = top_per_group(rows, group, item, k)
    return ranked.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias(name))


def profile(rows: DataFrame, group: str, conditions: dict[str, Column], sums: dict[str, Column], means: dict[str, Column]) -> DataFrame:
    """One pass over all groups: conditional counts, sums and means beside the group's size."""
    aggregates = [F.count("*").alias("n")]
    aggregates += [F.count_if(c).alias(k) for k, c in conditions.items()]
    aggregates += [F.round(F.sum(c), 6).alias(k) for k, c in sums.items()]
    aggregates += [F.round(F.avg(c), 6).alias(k) for k, c in means.items()]
    return rows.groupBy(group).agg(*aggregates)


#: kind -> (lift a group needs, least rows of the group)
STANDOUTS = {"gave_up": (1.5, 1), "cost": (1.6, 1), "turns": (1.5, 8)}


def standouts(profiles: DataFrame, group: str = "group_key", top: int = 3) -> DataFrame:
    """Rows (kind, group_key, lift, count): what sets groups apart from the rest, best one per group, ``top`` in all.

    ``profiles`` has n, gave_up, resolved, cost, turns (means of turns), top_failure_n.
    Needs two groups and twenty rows; a group needs five rows and 2 % of all.
    """
    base = profiles.agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), (F.sum("gave_up") / F.sum("n")).alias("gave_up"), (F.sum("resolved") / F.sum("n")).alias("resolved"),
        (F.sum("cost") / F.sum("n")).alias("cost"), (F.sum(F.col("turns") * F.col("n")) / F.sum("n")).alias("turns"),
    )
    b = {c: base.select(c).scalar() for c in ("groups", "n", "gave_up", "resolved", "cost", "turns")}
    n = F.col("n")
    able = profiles.where((b["groups"] >= 2) & (b["n"] >= 20) & (n >= F.greatest(F.lit(5.0), b["n"] * 0.02)))

    def found(kind: str, when: Column, lift: Column, count: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.round(lift, 6).alias("lift"), count.cast("long").alias("count")))

    rate = F.col("gave_up") / n
    per = F.col("cost") / n
    each = F.array(
        found("gave_up", (b["gave_up"] > 0.02) & (F.col("gave_up") >= 4) & (rate >= 1.5 * b["gave_up"]), rate / b["gave_up"], F.col("gave_up")),
        found("cost", (b["cost"] > 0) & (per >= 1.6 * b["cost"]), per / b["cost"], n),
        found("failure", (n >= 8) & (F.col("top_failure_n") >= 0.7 * n), F.col("top_failure_n") / n, F.col("top_failure_n")),
        found("unresolved", (n >= 8) & (F.col("resolved") == 0) & (b["resolved"] > 0.1), 1 + b["resolved"], n),
        found("turns", (n >= 8) & (b["turns"] > 0) & (F.col("turns") >= 1.5 * b["turns"]), F.col("turns") / b["turns"], n),
    )
    flat = able.select(F.col(group).alias("group_key"), F.explode(each).alias("s")).where(F.col("s").isNotNull()).select("group_key", "s.*")
    best = flat.groupBy("group_key").agg(F.max_by(F.struct("kind", "lift", "count"), F.struct("lift", "kind")).alias("s")).select("s.kind", "group_key", "s.lift", "s.count")
    return best.orderBy(F.desc("lift"), "group_key").limit(top)


def threshold(scores: DataFrame, score: str = "score") -> DataFrame:
    """One row of score statistics: mean, population deviation, exact median, mean of the top three."""
    from parley.operators import select

    s, median = F.col(score), select.percentile(scores, score, 0.5)
    top = scores.orderBy(F.desc(score)).limit(3).agg(F.avg(s)).scalar()
    return scores.agg(F.round(F.avg(s), 6).alias("mean"), F.round(F.stddev_pop(s), 6).alias("deviation"), F.round(F.lit(median).cast("double"), 6).alias("median"), F.round(F.max(F.lit(0.0)) + top, 6).alias("peak"))


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1."""
    counts = rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 6)
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def purity(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """One row: rows, clusters and the share of rows that have their cluster's most common label."""
    counted = rows.groupBy(cluster, label).agg(F.count("*").alias("n"))
    best = counted.groupBy(cluster).agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.agg(F.sum("n").alias("rows"), F.count("*").alias("clusters"), F.round(F.sum("best") / F.sum("n"), 6).alias("purity"))


def counts(df: DataFrame, keys: dict[str, Column], also: dict[str, Column] | None = None) -> DataFrame:
    """Rows (keys..., n, also...): one row for each combination of several columns."""
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in (also or {}).items()])


def having(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """The groups that meet a condition over an aggregate."""
    return df.groupBy(*keys).agg(condition.alias("_met")).where("_met").drop("_met")


def place_in_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """``df`` with each row's ``rank`` from 1 in its group, in a total order.

    Rows are numbered over the whole table in sorted ranges, and a group's first number is
    taken off, so a group of any size is many tasks.
    """
    from parley.operators.cluster import place

    placed = place(df, F.asc(group), *order, name="_place")
    first = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"))
    return placed.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn("rank", (F.col("_place") - F.col("_first") + 1).cast("int")).drop("_place", "_group", "_first")
