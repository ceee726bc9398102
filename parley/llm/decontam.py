"""Benchmark decontamination: a prefix-filtered containment join, DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (an item of fewer
words is one window). A document contains a window only if it contains each of
its shingles, hence its rarest one: that is the prefix a containment of 1 needs.

1. The shingles of all windows form a small key table. Documents are cut into
   words once, and each position's shingle is looked up in that table inside one
   code-generated pass; only matching positions leave it, with the few words
   around them.
2. Matches count each shingle over the whole corpus. A window's shingles are
   ordered by that count, rarest first; windows with a shingle that nowhere
   occurs are gone already.
3. Matches of a window's rarest shingle are the candidates. The offset in the
   window and the document's length bound where it may start and end, and the
   words are compared one by one.

Shingles have three words (an item of one or two words: that many). Keys are
hashes, but every hit is verified on words.

Defined results: a null or empty text or item has no words; an item without an id
hits words like any other, but is neither named nor counted among the items; items without words
have no window; repeated rows of either table count as rows of their own (an
item id is named once); items of equal text are all named; texts of any length
are scanned whole; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.store import Staged, ascii_lower, drop_rows, small

#: All ASCII but digits and lower-case letters; the rest makes words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Key rows up to which the benchmark's shingles are broadcast (about 100 MB); beyond, they are shuffled.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """The words of a text, perhaps with an empty string at either end."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def shingle_key(ws: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(ws, at + i) for i in range(size)])


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """Rows (w, length, size, items): each distinct window, its shingle size and the ids of its items."""
    ws = benchmark.select(F.col(item_id).cast("string").alias("item"), F.filter(words(F.col(text)), lambda x: x != "").alias("ws")).where(F.size("ws") > 0)
    length = F.least(F.size("ws"), F.lit(window))
    at = ws.withColumn("length", length).withColumn("start", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("length"))))
    cut = at.select(F.slice("ws", F.col("start") + 1, F.col("length")).alias("w"), "item")
    return cut.groupBy("w").agg(F.collect_set("item").alias("items")).select("w", F.size("w").alias("length"), F.least(F.size("w"), F.lit(SHINGLE)).alias("size"), "items")


def window_shingles(wins: DataFrame) -> DataFrame:
    """Rows (win, key, off) of every shingle of every window; ``win`` identifies the window."""
    out = None
    for size in range(1, SHINGLE + 1):
        part = wins.where(F.col("size") == size)
        part = part.select("w", "win", F.explode(F.sequence(F.lit(0), F.col("length") - size)).alias("off"))
        part = part.select("win", shingle_key(F.col("w"), F.col("off"), size).alias("key"), "off")
        out = part if out is None else out.unionByName(part)
    return out


def matches(spark: SparkSession, docs: DataFrame, keys: DataFrame, n_keys: int, sizes: list[int], doc_id: str, text: str, window: int) -> DataFrame:
    """A row per document (at = -1) and a row per position whose shingle is a key, with the words around it.

    A small key table is broadcast, and one pass over the texts does it all. Beyond the
    bound the documents' words are written once; (row, at, key) alone are shuffled to the
    keys, and the positions that match meet their document's words by its row.
    """
    ws = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("ws"))
    n = F.size("ws")
    blank = (F.get("ws", F.lit(0)) == "").cast("int") + ((n > 1) & (F.get("ws", n - 1) == "")).cast("int")
    ws = ws.select("row", "doc_id", "ws", (n - blank).cast("long").alias("n_words"))
    own = ws.select("row", "doc_id", "n_words", F.lit(None).cast("long").alias("key"), F.lit(-1).alias("at"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("array<string>").alias("around"))
    if not sizes:
        return own
    last, each = n - min(sizes), [shingle_key(F.col("ws"), F.col("at"), size) for size in sizes]
    low = F.greatest(F.col("at") - (window - 1), F.lit(0))
    around = F.slice("ws", low + 1, F.lit(2 * window))
    if n_keys > BROADCAST_ROWS:
        held = Staged(spark, ws, "words").df
        at = held.where(F.size("ws") >= min(sizes)).select("row", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - min(sizes))).alias("at"))
        at = at.select("row", "at", F.explode(F.array(*each)).alias("key")) if len(each) > 1 else at.select("row", "at", each[0].alias("key"))
        met = at.join(keys, "key", "left_semi").join(held, "row").select("row", "doc_id", "n_words", "key", "at", low.alias("low"), around.alias("around"))
        return held.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in ("key", "low", "around") else (F.lit(-1).alias("at") if f.name == "at" else F.col(f.name)) for f in own.schema.fields]).unionByName(met)
    # the documents' own rows pass the join, which shuffles nothing, under a key of their own
    keys = keys.withColumn("own", F.lit(False)).unionByName(spark.createDataFrame([(0, True)], "key long, own boolean"))
    ws = ws.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(last, F.lit(-1)))).alias("at"))
    each = [F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(key) for key in each]
    if len(each) == 1:
        ws = ws.withColumn("key", each[0])
    else:  # several shingle sizes: the row of the document itself once, the positions once per size
        ws = ws.withColumn("key", F.explode(F.when(F.col("at") < 0, F.array(F.lit(0).cast("long"))).otherwise(F.array(*each))))
    found = ws.join(F.broadcast(keys), "key").where((F.col("at") < 0) == F.col("own"))
    there = F.col("at") >= 0
    return found.select("row", "doc_id", "n_words", "key", "at", F.when(there, low).alias("low"), F.when(there, around).alias("around"))


def occurrences(found: DataFrame, wins: DataFrame, shingles: DataFrame) -> DataFrame:
    """Rows (row, start, length, items): every verified occurrence of a window."""
    hits = found.where("at >= 0")
    counts = hits.groupBy("key").agg(F.count("*").alias("n"))
    ranked = shingles.join(counts, "key", "left").select("win", "key", "off", F.coalesce("n", F.lit(0)).alias("n"))
    prefix = ranked.groupBy("win").agg(F.min(F.struct("n", "key", "off")).alias("rarest")).where("rarest.n > 0")
    need = prefix.select("win", "rarest.key", "rarest.off").join(wins, "win").select("key", "off", "w", "length", "items")
    start = F.col("at") - F.col("off")
    bounded = hits.join(need, "key").where((start >= F.col("low")))
    same = F.slice("around", start - F.col("low") + 1, F.col("length")) == F.col("w")
    return bounded.where(same).select("row", start.alias("start"), "length", "items")


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted ids as strings)."""
    wins = Staged(spark, windows(benchmark, item_id, item_text, window).withColumn("win", F.monotonically_increasing_id()), "windows").df
    shingles = Staged(spark, window_shingles(wins), "shingles").df
    sizes = sorted(r[0] for r in wins.select("size").distinct().collect())  # at most three numbers
    keys = shingles.select("key").distinct()
    found = Staged(spark, matches(spark, docs, keys, shingles.count(), sizes, doc_id, text, window), "matches").df
    hits = Staged(spark, occurrences(found, wins, shingles), "hits").df
    order = Window.partitionBy("row").orderBy("start", "length")
    end = F.col("start") + F.col("length")
    seen = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    covered = hits.select("row", "start", "length").distinct().withColumn("new", F.greatest(end - F.greatest("start", F.coalesce(seen, F.lit(0))), F.lit(0)))
    n_hit = covered.groupBy("row").agg(F.sum("new").alias("n_hit"))
    items = hits.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    per_row = found.where("at < 0").select("row", "doc_id", "n_words")
    out = per_row.join(n_hit, "row", "left").join(items, "row", "left")  # items without an id hit words and are not named
    empty = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", empty)).cast("long").alias("n_items"), F.coalesce("items", empty).alias("items"))


def clean_rows(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, all columns kept.

    Rows with the id of a contaminated row go with it; rows with a null id stay
    only if no row with a null id is contaminated.
    """
    bad = contamination(spark, docs, benchmark, doc_id, text).where("n_hit > 0").select("doc_id")
    return drop_rows(docs, doc_id, bad)
