"""Where operators keep what outlives a job: tables in the cluster's shared folder.

Lineage is cut with written tables rather than executor-local blocks, so a lost
executor costs a re-read and nothing else.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set only where the session names no shared folder (tests, a laptop).
LOCAL_DEFAULT = "/tmp/checkpoints/parley"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local default if that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(LOCAL_DEFAULT)
        named = LOCAL_DEFAULT
    return named.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/parley/{tag}-{uuid.uuid4().hex}"


_LARGE: dict = {}


def large(key, build):
    """A large structure of a Python worker, built once; only the last one asked for is kept."""
    if key not in _LARGE:
        release()
        _LARGE[key] = build()
    return _LARGE[key]


def release() -> None:
    """Frees a reused worker of what another operator left in it."""
    if _LARGE:
        _LARGE.clear()
        gc.collect()


class Staged:
    """A DataFrame written once to the shared folder and read back."""

    def __init__(self, spark: SparkSession, df: DataFrame, tag: str, partition_by: list[str] | None = None):
        self.spark, self.path = spark, new_path(spark, tag)
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has Spark's default: texts may be long, and workers are many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; dealt over twice the cores where its scan has fewer parts than cores."""
    bound_batches(spark)
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` stay within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; whole-ASCII texts take the fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that would clash with new ones of these names (letter case aside)."""
    new = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` lacks."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def drop_rows(df: DataFrame, key: str, bad: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """``df`` less the rows whose key is in ``bad`` (one column); nulls match nulls.

    ``bad`` is broadcast if its counted rows stay within ``limit``, else joined by key.
    """
    name = fresh(df, "_bad")
    bad = bad.toDF(name).distinct()
    return df.join(small(bad, bad.count(), limit), F.col(key).eqNullSafe(F.col(name)), "left_anti")
