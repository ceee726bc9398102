"""A typed query to a DataFrame plan over a binding."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import scalar
from parley.operators import aggregate, joins
from parley.plans import registry
from parley.plans.binding import Binding
from parley.plans.compiler import QuerySpec
from parley.plans.registry import Predicate


def condition(p: Predicate, binding: Binding) -> Column:
    return F.coalesce(p.build(binding.get), F.lit(False))


def eligible(spec: QuerySpec, binding: Binding) -> DataFrame:
    """Rows that meet every condition; a tool's is a semi-join and never fans out."""
    rows = binding.traces
    plain = [condition(p, binding) for p in spec.predicates if not p.bridge]
    if plain:
        rows = rows.where(reduce(lambda a, b: a & b, plain))
    for p in spec.predicates:
        if p.bridge:
            named = rows.withColumn("_id", binding.get("id"))
            match = binding.bridge.where(p.build(F.col)).select(F.col("id").alias("_id"))
            rows = named.join(match, "_id", "left_semi").drop("_id")
    return rows


def rows(spec: QuerySpec, binding: Binding) -> DataFrame:
    """(id, group_key, value), one row per conversation and group."""
    kept = eligible(spec, binding)
    metric = registry.METRICS[spec.metric].build
    value = metric(binding.get) if metric else None
    dimension = registry.DIMENSIONS[spec.group_by] if spec.group_by else None
    if dimension and dimension.bridge:
        base = kept.select(binding.get("id").alias("id"), scalar.metric_value(value).alias("value"))
        return joins.through_bridge(base, binding.bridge, "id", "tool", ["value"]).select("id", scalar.group_key(F.col("tool")).alias("group_key"), "value")
    return aggregate.rows_of(kept, binding.get("id"), dimension.build(binding.get) if dimension else None, value)


def groups(spec: QuerySpec, binding: Binding) -> DataFrame:
    """The answer's groups: aggregated, the tail folded, ordered by value or (trends) by key."""
    found = aggregate.grouped(rows(spec, binding), spec.aggregate)
    if spec.sort == "key":
        return aggregate.by_key(found)
    return aggregate.by_value(aggregate.fold_tail(found, spec.limit, spec.aggregate))


def relax(spec: QuerySpec, binding: Binding) -> tuple[QuerySpec, list[Predicate]]:
    """The query with as few of its last conditions dropped as leave any row, and what was dropped.

    One pass counts the rows of every leading run of conditions; bridge conditions are
    turned into a flag per row first.
    """
    if not spec.predicates:
        return spec, []
    named = binding.traces.withColumn("_id", binding.get("id"))
    flags = []
    for i, p in enumerate(spec.predicates):
        if p.bridge:
            match = binding.bridge.where(p.build(F.col)).select(F.col("id").alias("_id")).distinct().withColumn(f"_m{i}", F.lit(True))
            named = named.join(match, "_id", "left")
            flags.append(F.coalesce(F.col(f"_m{i}"), F.lit(False)))
        else:
            flags.append(condition(p, binding))
    counts = named.agg(*[F.count_if(reduce(lambda a, b: a & b, flags[: n + 1])).alias(f"n{n}") for n in range(len(flags))]).first()
    keep = next((n for n in range(len(flags), 0, -1) if counts[n - 1] > 0), 0)
    if keep == len(flags):
        return spec, []
    return replace(spec, predicates=spec.predicates[:keep]), spec.predicates[keep:]
