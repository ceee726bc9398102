"""Answers: groups with labels, profiles, standouts, quotes and a few sentences."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions import scalar
from parley.functions import text as tx
from parley.operators import aggregate
from parley.plans import registry
from parley.plans.compiler import QuerySpec


@dataclass
class Answer:
    spec: QuerySpec
    denominator: int
    excluded: int
    groups: list[dict]
    standouts: list[dict] = field(default_factory=list)
    evidence: list[dict] = field(default_factory=list)
    headline: str = ""
    interpretation: str = ""
    suggestions: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    work: str = ""

    def __post_init__(self) -> None:
        if self.groups and sum(g["count"] for g in self.groups) != self.denominator:
            raise ValueError("group counts do not add up to the denominator")


def quotes(rows: DataFrame, docs: DataFrame, per: int = 3, groups: int = 6) -> DataFrame:
    """Rows (group_key, id, quote, place): literal quotes of distinct wording, best-valued rows first."""
    said = docs.select("id", F.get(F.filter(tx.sentences(F.col("text")), lambda s: F.length(s) > 12), F.lit(0)).alias("quote"), "text").where(tx.literal_quote(F.col("quote"), F.col("text")))
    top = rows.groupBy("group_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group_key").limit(groups)
    own = rows.join(F.broadcast(top.select("group_key")), "group_key").join(said, "id").withColumn("norm", F.lower(F.regexp_replace(F.trim("quote"), r"\s+", " ")))
    # one row per wording by aggregation, then a short ranking
    first = own.groupBy("group_key", "norm").agg(F.min_by(F.struct("id", "quote", "value"), F.struct(-F.col("value"), "id")).alias("r")).select("group_key", "r.*")
    place = F.row_number().over(Window.partitionBy("group_key").orderBy(F.desc("value"), "id"))
    return first.withColumn("place", place).where(F.col("place") <= per).select("group_key", "id", "quote", "place")


def headline(spec: QuerySpec, groups: list[dict], denominator: int) -> str:
    if not denominator or not groups:
        return "No conversation matches."
    first = groups[0]
    if spec.path == "layer3_aspect":
        yes = next((g for g in groups if g["group_key"] == "yes"), None)
        return f"{yes['count'] if yes else 0} of {denominator} conversations ({100 * (yes['share'] if yes else 0):.0f}%)."
    if not spec.group_by and spec.path == "layer1":
        return f"{spec.describe()}: {first['value_label']} over {denominator} conversations."
    return f"{first['label']} leads with {first['value_label']} ({100 * first['share']:.0f}% of {denominator})."


def interpretation(spec: QuerySpec, groups: list[dict]) -> str:
    real = [g for g in groups if g["group_key"] != aggregate.OTHER]
    if len(real) < 2:
        return "There is a single group, so nothing to compare."
    a, b = real[0], real[1]
    if a["value"] == b["value"]:
        tied = [g["label"] for g in real if g["value"] == a["value"]]
        return f"{', '.join(tied[:-1])} and {tied[-1]} are tied."
    if b["value"] > 0 and a["value"] / b["value"] >= 1.6:
        return f"{a['label']} is {a['value'] / b['value']:.1f} times {b['label']}, the next."
    return f"{a['label']} is ahead of {b['label']}, but not by much."


def outcome(profile: dict, label: Callable[[str], str] = str) -> str:
    """How the conversations of a group went, or nothing where no share stands out.

    ``profile`` has the group's ``count``, ``resolved``, ``gave_up``, ``top_failure`` and ``top_failure_n``.
    """
    n = profile.get("count") or 0
    said = []
    if n and "resolved" in profile:
        share = profile["resolved"] / n
        if share == 0:
            said.append("no one got what they asked for")
        elif share < 0.25 or share > 0.8:
            said.append(f"{'only ' if share < 0.25 else ''}{profile['resolved']:,} of {n:,} were resolved")
    if n and profile.get("top_failure") and profile.get("top_failure_n", 0) >= max(2, n // 5):
        said.append(f"{profile['top_failure_n']:,} met with {label(profile['top_failure'])}")
    if n and profile.get("gave_up", 0) >= 0.3 * n:
        said.append(f"{profile['gave_up']:,} gave up")
    return f"Of these, {' and '.join(said)}." if said else ""


def labelled(groups: DataFrame, unit: str) -> DataFrame:
    largest = groups.agg(F.max(F.abs("value"))).scalar()
    label = F.when(F.col("group_key") == aggregate.OTHER, F.lit("Everything else")).otherwise(scalar.humanise(F.col("group_key")))
    return groups.withColumn("label", label).withColumn("value_label", scalar.shown_value(F.col("value"), unit, largest))


def suggestions(spec: QuerySpec, groups: list[dict]) -> list[str]:
    """Questions to go on with: another recorded column, the leading group, a trend."""
    pinned = {p.field for p in spec.predicates} | {spec.group_by}
    out = [f"Which {registry.DIMENSIONS[k].label.lower()} has the most {registry.METRICS[spec.metric].label.lower()}?" for k in ("app", "failure_mode", "outcome") if k not in pinned][:2]
    if groups and spec.group_by and groups[0]["group_key"] not in (aggregate.OTHER, scalar.UNKNOWN):
        out.append(f"What do people ask about in {groups[0]['label']}?")
    return [*out, f"{registry.METRICS[spec.metric].label} over time"] if spec.sort != "key" else out
