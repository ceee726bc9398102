"""SimHash near-duplicates by multi-index hashing.

Fingerprints: 64 majority bits of the XXH64 values of word shingles. Copies share
one, so all later work is on distinct fingerprints, each with its least doc_id.

Search for distance 2 or less: a fingerprint has two 32-bit segments, and two
fingerprints within two bits differ in at most one bit of one of them. A table keyed
by (segment, value) holds every fingerprint twice; each looks up the Hamming ball of
radius 1 around its own values (a flip only from 0 to 1, as of two values that differ
in a bit one has the 0), and the complete distance of what it meets is verified.

A table key with more than ``CROWDED`` fingerprints is not joined. Every fingerprint
that has or looks up such a key goes a second way instead, by keys that no data can
crowd: the whole fingerprint and its 64 neighbours at one bit. Two fingerprints differ
in at most two bits exactly if they share such a key (the point halfway between
them), and none can hold more than the 65 within one bit of it. Neighbours in a key's
order are linked after their distance is verified; as all members of a key are within
2 of each other, such chains lose no connection. So no link is lost on either way.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; equal fingerprints form one component; repeated rows each give a row;
a component of null doc_ids alone has a null id; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.components import components
from parley.llm.store import Staged, drop_rows, fresh, release, small

SEED = 42
#: Fingerprints of a table key up to which it is joined.
CROWDED = 64
#: Crowded keys up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: Shingles whose bits are counted at a time, to bound memory on very long texts.
BLOCK = 1 << 14


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8").lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone splits
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *(ends[:-1]).tolist()]
    ends = (ends - 1).tolist()
    if len(tokens) < words:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, dtype="<u8")
    for at in range(0, len(values), BLOCK):
        bits = np.unpackbits(values[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """Rows (doc_id, fp): one per row of ``df``; fp is the signed reading of the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bit(b: int) -> Column:
    return F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")


def _value(fp: Column, segment: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if segment else fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _close(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b").distinct()


def halfway_links(fps: DataFrame) -> DataFrame:
    """Rows (a, b): verified links that join up all of ``fps`` within two bits, by keys of at most 65 members."""
    keys = fps.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(_bit(b)) for b in range(64)])).alias("key"))
    before = F.lag("fp").over(Window.partitionBy("key").orderBy("fp"))
    return _close(keys.select(before.alias("a"), F.col("fp").alias("b")).where(F.col("a").isNotNull()))


def links(spark: SparkSession, fps: DataFrame) -> DataFrame:
    """Rows (a, b): verified links that join up all of ``fps`` (column fp, distinct) within two bits."""
    fp = F.col("fp")
    own = [F.struct(F.lit(s).alias("segment"), _value(fp, s).alias("value")) for s in (0, 1)]
    probes = None
    for s in (0, 1):
        v = _value(fp, s)
        ball = F.array(v, *[F.when(v.bitwiseAND(_bit(b)) == 0, v.bitwiseOR(_bit(b))) for b in range(32)])
        one = fps.select(fp.alias("a"), F.explode(ball).alias("value")).where(F.col("value").isNotNull()).select("a", F.lit(s).alias("segment"), "value")
        probes = one if probes is None else probes.unionByName(one)
    table = fps.select("fp", F.explode(F.array(*own)).alias("k")).select("k.*", F.col("fp").alias("b"))
    full = Staged(spark, table.groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("segment", "value"), "crowded").df
    if full.isEmpty():
        return _close(probes.join(table, ["segment", "value"]).where("a <> b"))
    n_full = full.count()
    full = small(full, n_full, BROADCAST_ROWS)
    free = table.join(full, ["segment", "value"], "left_anti")
    met = _close(probes.join(free, ["segment", "value"]).where("a <> b"))
    rest = probes.join(full, ["segment", "value"], "left_semi").select(F.col("a").alias("fp")).distinct()
    return met.unionByName(halfway_links(Staged(spark, rest, "rest").df)).distinct()


def groups(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per row of ``df``; component_id is the least doc_id reachable."""
    docs = Staged(spark, fingerprints(df, doc_id, text, words), "fingerprints").df
    nodes = Staged(spark, docs.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    linked = components(spark, links(spark, nodes.df.select("fp")))
    rooted = nodes.df.join(linked.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    label = rooted.join(least, "root").select("fp", "component_id")
    return docs.join(label, "fp").select("doc_id", "fp", "component_id")


def representatives(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each component the row with the least doc_id.

    Rows with a null doc_id stay only where no document of the component has one;
    of fully equal ids one row stays.
    """
    found = Staged(spark, groups(spark, df, doc_id, text).select("doc_id", "component_id"), "components").df
    left = drop_rows(df, doc_id, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"))
    twice = Staged(spark, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice").df
    if twice.isEmpty():
        return left
    name = fresh(df, "_twice")
    again = left.join(twice.toDF(name), F.col(doc_id).eqNullSafe(F.col(name)), "left_semi").dropDuplicates([doc_id])
    return drop_rows(left, doc_id, twice).unionByName(again)
