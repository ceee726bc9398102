"""Tables of the engine: scans, writes, upserts, migration, fingerprints, shared intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from parley.operators import joins

LOCAL_DEFAULT = "/tmp/checkpoints/parley"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local default is set only where it is unset and Spark runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        spark.sparkContext.setCheckpointDir(LOCAL_DEFAULT)
        named = LOCAL_DEFAULT
    return named.rstrip("/")


def written(df: DataFrame, tag: str, **options: object) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path for ``dropped``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parley/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def held(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and a lost executor costs a re-read."""
    return written(df, tag)[0]


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes what ``written`` wrote, once nothing that is still to be read comes from it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over twice the cores where its scan has fewer parts than cores (one small file, say); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that changes with any row: count, and an order-free sum of hashes of contents.

    A sum, so that equal rows do not cancel out; each column goes with whether it is
    null, so that nulls keep their place.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    h = F.xxhash64(*[x for c in names for x in (c.isNull(), F.coalesce(c.cast("string"), F.lit("")))])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("content"))


class Store:
    """Named Parquet tables under one folder, with the writes the engine needs.

    Changes are whole-table rewrites to a new version folder and a pointer swap by
    name, so readers of the old version and repeated tasks stay right. Appended rows are a
    folder of their own beside the last version (``MANY`` of them are folded into a new one).
    """

    #: Appended folders from which the next append writes a new version.
    MANY = 64

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[str]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [str(s.getPath().toString()) for s in fs.listStatus(path)]
        return sorted(p for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p + "/_SUCCESS")))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def _current(self, name: str) -> list[str]:
        """The last whole version and what was appended to it since."""
        every = self._versions(name)
        base = max((i for i, p in enumerate(every) if not p.endswith("-more")), default=0)
        return every[base:]

    def table(self, name: str) -> DataFrame:
        parts = self._current(name)
        if not parts:
            raise AnalysisException(f"no table {name} in {self.folder}")
        return self.spark.read.option("mergeSchema", len(parts) > 1).parquet(*parts)

    def _write(self, name: str, df: DataFrame, kind: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}/v{len(self._versions(name)):08d}-{uuid.uuid4().hex[:8]}{kind}")
        return self.table(name)

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        return self._write(name, df, "")

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Adds rows; only they are written. Columns that either side lacks are null."""
        if not self.exists(name):
            return self.replace(name, df)
        if len(self._current(name)) > self.MANY:
            return self.replace(name, self.table(name).unionByName(df, allowMissingColumns=True))
        kinds = dict(self.table(name).dtypes)
        return self._write(name, df.select(*[F.col(f"`{c}`").cast(kinds.get(c, k)).alias(c) for c, k in df.dtypes]), "-more")

    def upsert(self, name: str, df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
        """Rows of known keys replaced, or only their ``columns`` updated, and new rows added."""
        if not self.exists(name):
            return self.replace(name, df)
        old = self.table(name)
        return self.replace(name, joins.upsert(old, df, keys) if columns is None else joins.upsert_columns(old, df, keys, columns))

    def insert_missing(self, name: str, df: DataFrame, keys: list[str]) -> DataFrame:
        return self.replace(name, joins.insert_missing(self.table(name), df, keys) if self.exists(name) else df.dropDuplicates(keys))

    def update(self, name: str, key: str, value, **columns) -> DataFrame:
        df = self.table(name)
        return self.replace(name, df.withColumns({c: F.when(F.col(key) == value, F.lit(v)).otherwise(F.col(c)) for c, v in columns.items()}))

    def update_column(self, name: str, new: DataFrame, key: str, column: str) -> DataFrame:
        df = self.table(name)
        side = new.select(key, F.col(column).alias("_new"))
        return self.replace(name, df.join(side, key, "left").withColumn(column, F.coalesce("_new", column) if column in df.columns else F.col("_new")).drop("_new"))

    def clear(self, *names: str) -> None:
        """Empties tables in the given order (children first)."""
        for name in names:
            if self.exists(name):
                self.replace(name, self.table(name).limit(0))

    def migrate(self, name: str, defaults: dict[str, object]) -> DataFrame:
        """Adds the columns a table lacks, with their defaults."""
        df = self.table(name)
        missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
        return self.replace(name, df.withColumns(missing)) if missing else df

    def current(self, name: str, version: str, labels: list[str]) -> bool:
        """Whether a table is of this version and has its labels filled in."""
        if not (self.exists(name) and self.exists("dataset_provenance")):
            return False
        same = self.table("dataset_provenance").where((F.col("name") == name) & (F.col("version") == version)).limit(1).count()
        return bool(same) and not any(self.table(name).where(F.col(c).isNull()).limit(1).count() for c in labels)
