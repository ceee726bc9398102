"""Personal data: four base kinds by pattern, more by bootstrapped contexts; DataFrame functions only.

Base spans. Each kind's matches are found left to right without overlap and then
tested (address parts, Luhn, digit counts); a failing match is dropped without a
retry. Offsets are code points: the text is cut at the matches, and the lengths of
gaps and matches are summed up. The patterns are equivalent to the plain ones but
start only where a match can start and never backtrack, so that long texts stay
linear.

Bootstrapping. Base spans are the seed instances. Candidates are tokens and runs of
blank-separated digit groups, of any length, that hold ``@`` or six or more digits and
overlap no base span. The two words of the text before an instance are its lexical
pattern; a first word with a digit or ``@`` is left out, as it is seldom twice the same,
and a match before is a word of its own. Patterns and instances form a bipartite graph of distinct
edges, which Spark scores in rounds until nothing grows any more (scores only rise): a pattern by the lower Wilson bound of its
instances' mean confidence, an instance by the noisy-or of its accepted patterns.
Candidates outside base spans whose final confidence reaches ``ACCEPT`` become spans
of kind ``id`` in the places where an accepted pattern stands before them. A pattern
needs at least 16 distinct seeds to be accepted, so chance contexts find nothing.

Defined results: null and empty texts have no spans; each row of the table gives a
row, repeated ones too; spans of different kinds may overlap, those of kind ``id``
never overlap base ones; extra columns are not read by ``detect`` and kept by
``redact``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.store import Staged, small

#: Kinds in their order; the last is what bootstrapping adds.
KINDS = ("email", "ip", "card", "phone", "id")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
GROUPS = r"[+(]*+[0-9][0-9().+-]*+(?:\x20\(*+[0-9]{2}[0-9().+-]*+(?![^\s\"',;:!?\]}>]))++"
CANDIDATE = rf"(?<!\S)(?:{GROUPS}|[^\s0-9@]*+[0-9@]\S*+)"
#: Opening marks before an identifier; a bracket around its first digits is its own.
OPENING = r"^(?:[\"'\[{<]|\((?![0-9]+\)))*+"

#: Rounds end when all confidences together grow by no more than this.
SETTLED = 1e-6
#: A pattern counts once its lower bound reaches this; an instance is an identifier from this confidence.
TRUST = 0.8
ACCEPT = 0.9
#: Rows up to which accepted patterns or instances are broadcast.
BROADCAST_ROWS = 500_000


#: Elements of a block of a running total.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """What ``plus`` makes of the whole numbers before each element, from 0; ``values`` is bound by ``let``.

    Blocks are totalled, the totals run through, and each block run through from its own
    total on, so no array grows beyond a block or the number of blocks.
    """
    none = F.array().cast("array<int>")

    def through(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.struct(start.alias("at"), none.alias("out")), lambda acc, x: F.struct(plus(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        before = through(F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), plus)), F.lit(0))
        return F.flatten(F.zip_with(blocks, before, through))

    blocks = F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(BLOCK)), lambda at: F.slice(values, at + 1, F.lit(BLOCK)))
    return F.when(F.size(values) == 0, none).otherwise(let(blocks, joined))


def _pieces(text: Column, pattern: str) -> Column:
    """Gaps and matches in turn, as an array of (0: gap, 1: match or null)."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("0"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("1"))


def _placed(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, left): every match with its code points and the two words before it, as they are.

    Every match before is a word at least, so the two words are in the last two matches and the gaps behind them.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string>>")
    plain = lambda gap: F.regexp_replace(gap, r"(?<![\"'(\[{<])[\"'(\[{<]++$", "")

    def placed(ps: Column) -> Column:
        at = running_lengths(ps)

        def one(p: Column, i: Column) -> Column:
            begin = F.get(p["at"], i) + F.char_length(F.get(p["ps"], i)["0"])
            before = F.concat_ws(" ", F.get(p["ps"], i - 2)["1"], plain(F.get(p["ps"], i - 1)["0"]), F.get(p["ps"], i - 1)["1"], plain(F.get(p["ps"], i)["0"]))
            value = F.get(p["ps"], i)["1"]
            left = F.regexp_extract(before, r"(?<!\S)(?:\S++\s++)?\S++\s*+$", 0)
            return F.struct(begin.alias("start"), (begin + F.char_length(value)).alias("end"), value.alias("value"), left.alias("left"))

        # the last piece is the text behind the last match
        return let(F.struct(ps.alias("ps"), at.alias("at")), lambda p: F.transform(F.sequence(F.lit(0), F.size(p["ps"]) - 2), lambda i: one(p, i)))

    def running_lengths(ps: Column) -> Column:
        return let(F.transform(ps, lambda x: F.char_length(x["0"]) + F.coalesce(F.char_length(x["1"]), F.lit(0))), lambda xs: running(xs, lambda a, x: a + x))

    return let(_pieces(text, pattern), lambda ps: F.when(F.size(ps) < 2, none).otherwise(placed(ps)))


def _ip_ok(value: Column) -> Column:
    def fits(part: Column) -> Column:
        digits = F.ltrim(part, F.lit("0"))
        return (F.length(digits) <= 3) & (F.coalesce(F.expr("0") + F.lpad(digits, 3, "0").try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), fits)


def _card_ok(value: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(value, r"[^0-9]", "")), "")

    def weigh(d: Column, i: Column) -> Column:
        n = F.coalesce(d.try_cast("int"), F.lit(0)) * (1 + i % 2)
        return n - F.when(n > 9, 9).otherwise(0)

    return F.aggregate(F.transform(digits, weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def _phone_ok(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"[^0-9]", "")).between(10, 15)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, value, left) of the four base kinds, by start and then kind (an index of KINDS)."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,left:string>>")

    def of(kind: int, pattern: str, may: Column, ok) -> Column:
        found = F.filter(_placed(text, pattern), lambda m: ok(m["value"]))
        return F.when(may, F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value"), m["left"].alias("left")))).otherwise(none)

    return F.array_sort(
        F.concat(
            of(0, EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
            of(1, IP, text.rlike(IP), _ip_ok),
            of(2, CARD, text.rlike(CARD), _card_ok),
            of(3, PHONE, F.contains(text, F.lit("+")) & text.rlike(PHONE), _phone_ok),
        )
    )


def _word(raw: Column) -> Column:
    return F.lower(F.regexp_replace(raw, r"^\W+|(?<![:=])\W+$", ""))


def _pattern(left: Column) -> Column:
    """The lexical pattern of the words before an instance."""
    two = F.split(F.trim(F.regexp_replace(left, r"\s+", " ")), " ")
    two = F.when(F.get(two, F.lit(0)).rlike("[0-9@]"), F.slice(two, -1, 1)).otherwise(two)
    return F.array_join(F.transform(two, _word), " ")


def candidates(text: Column) -> Column:
    """Array of (start, end, value, left) of tokens and runs of digit groups that may be identifiers, with their patterns."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string>>")

    def shaped(m: Column) -> Column:
        opening = F.regexp_extract(m["value"], OPENING, 0)
        core = F.regexp_extract(F.substring(m["value"], F.char_length(opening) + 1, F.char_length(m["value"])), r"^(.*?)[\"'.,;:!?)\]}>]*$", 1)
        lead = F.char_length(opening)
        return F.struct((m["start"] + lead).alias("start"), (m["start"] + lead + F.char_length(core)).alias("end"), core.alias("value"), _pattern(m["left"]).alias("left"))

    def may(c: Column) -> Column:
        digits = F.length(F.regexp_replace(c["value"], r"[^0-9]", ""))
        return (F.contains(c["value"], F.lit("@")) | (digits >= 6)) & (F.trim(c["left"]) != "")

    return F.when(text.rlike(r"[0-9@]"), F.filter(F.transform(_placed(text, CANDIDATE), shaped), may)).otherwise(none)


def _table(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, base_spans(whole).alias("_found"), candidates(whole).alias("_cand"))
    use = lambda c, left, seed: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), left.alias("left"), F.lit(seed).alias("seed"))
    seeds = F.filter(F.transform("_found", lambda b: use(b, _pattern(b["left"]), True)), lambda c: F.trim(c["left"]) != "")
    base = F.transform("_found", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    kept = [c for c in out.columns if c not in ("_found", "_cand")]
    return out.select(*kept, base.alias("_base"), F.concat(seeds, F.transform("_cand", lambda c: use(c, c["left"], False))).alias("_cand"))


def bootstrap(spark: SparkSession, uses: DataFrame, trust: float = TRUST) -> tuple[DataFrame, DataFrame]:
    """Scores the graph of ``uses`` (left, value, seed). Returns accepted (left, trust) and all (value, confidence)."""
    edges = Staged(spark, uses.groupBy("left", "value").agg(F.max("seed").alias("seed")), "edges").df
    known = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("seed"))
    held = Staged(spark, known.select("value", F.col("seed").alias("confidence")), "instances")
    total = held.df.agg(F.coalesce(F.sum("confidence"), F.lit(0.0))).first()[0]
    while True:
        p, n, z2 = F.avg("confidence"), F.count("*"), 1.96**2
        bound = (p + z2 / (2 * n) - 1.96 * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
        scored = edges.select("left", "value").join(held.df, "value").groupBy("left").agg(bound.alias("trust"))
        patterns = Staged(spark, scored.where(F.col("trust") >= trust), "patterns")
        n_patterns = patterns.df.count()
        if not n_patterns:
            return patterns.df, held.df
        voted = edges.join(small(patterns.df, n_patterns, BROADCAST_ROWS), "left").groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-F.least("trust", F.lit(0.999999)))))).alias("vote"))
        instances = known.join(voted, "value", "left").select("value", F.greatest("seed", F.coalesce("vote", F.lit(0.0))).alias("confidence"))
        new = Staged(spark, instances, "instances")
        held.drop()
        held, before = new, total
        total = held.df.agg(F.sum("confidence")).first()[0]
        if total - before <= SETTLED:
            return patterns.df, held.df
        patterns.drop()


def _free(held: DataFrame) -> DataFrame:
    """Rows (_row, start, end, value, left, seed) of the uses in ``held``, less the candidates that overlap a base span.

    A text's spans and candidates are sorted by start once: one overlaps if the greatest
    end of the spans that begin before its end is behind its start.
    """
    uses = held.select("_row", F.explode("_cand").alias("c")).select("_row", "c.*")
    free = uses.where(~F.col("seed")).select("*", F.col("end").alias("at"), F.lit(None).cast("int").alias("upto"))
    spans = held.select("_row", F.explode("_base").alias("b")).select("_row", F.col("b.start").alias("at"), F.col("b.end").alias("upto"))
    before = F.max("upto").over(Window.partitionBy("_row").orderBy("at", F.col("upto").isNotNull()).rowsBetween(Window.unboundedPreceding, -1))
    ordered = free.unionByName(spans, allowMissingColumns=True).withColumn("before", before)
    kept = ordered.where(F.col("upto").isNull() & (F.coalesce("before", F.lit(0)) <= F.col("start")))
    return uses.where("seed").unionByName(kept.select(*uses.columns))


def _spans(spark: SparkSession, held: DataFrame, keep: list[str]) -> DataFrame:
    """``held`` with all spans: base ones and those bootstrapping adds."""
    uses = Staged(spark, _free(held), "uses").df
    patterns, instances = bootstrap(spark, uses.select("left", "value", "seed"))
    good = instances.where(F.col("confidence") >= ACCEPT).select("value")
    found = uses.where(~F.col("seed")).join(small(patterns.select("left"), patterns.count(), BROADCAST_ROWS), "left", "left_semi").join(good, "value", "left_semi")
    found = found.groupBy("_row").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end")).alias("_new"))
    found = Staged(spark, found, "found").df
    found = small(found, found.count(), BROADCAST_ROWS)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return held.join(found, "_row", "left").select(*keep, "_base", F.array_sort(F.concat("_base", F.coalesce("_new", none))).alias("_all"))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base and spans, each an array of (start, kind, end)."""
    held = Staged(spark, _table(docs, text, [F.col(doc_id).alias("doc_id")]), "pii").df
    return _spans(spark, held, ["doc_id"]).select("doc_id", F.col("_base").alias("base"), F.col("_all").alias("spans"))


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans share the first one's mark.

    The text is cut into stretches of ``BLOCK`` spans and those into pieces, as a cut counts code points from the start.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def block(x: Column) -> Column:
        """A stretch that begins where all spans before it have ended."""
        low = F.get(x["upto"], F.lit(0))
        stop = F.aggregate(x["spans"], low, lambda a, s: F.greatest(a, s["end"]))
        own = F.substring(text, low + 1, stop - low)

        def piece(o: Column, s: Column, at: Column) -> Column:
            return F.when(s["start"] >= at, F.concat(F.substring(o, at - low + 1, s["start"] - at), F.get(names, s["kind"]))).otherwise(F.lit(""))

        return let(own, lambda o: F.array_join(F.zip_with(x["spans"], x["upto"], lambda s, at: piece(o, s, at)), ""))

    def whole(upto: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(BLOCK)), lambda at: F.struct(F.slice(spans, at + 1, F.lit(BLOCK)).alias("spans"), F.slice(upto, at + 1, F.lit(BLOCK)).alias("upto")))
        last = F.greatest(F.element_at(upto, -1), F.element_at(spans, -1)["end"])
        return F.concat(F.array_join(F.transform(blocks, block), ""), F.substring(text, last + 1, F.char_length(text)))

    upto = let(F.transform(spans, lambda s: s["end"]), lambda ends: running(ends, lambda a, x: F.greatest(a, x)))
    return F.when(F.size(spans) == 0, text).otherwise(let(upto, whole))


def redact(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; the other columns as they are."""
    held = Staged(spark, _table(docs, text, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own")]), "pii").df
    done = _spans(spark, held, ["_own"])
    own = F.col("_own")
    return done.select(*[redacted(own[c], F.col("_all")).alias(c) if c == text else own[c].alias(c) for c in docs.columns])
