"""Shared pieces of the corpus operators: written stage tables, words, row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import scratch, ship

#: What separates words in the whitespace word rule: space, tab, LF, VT, FF, CR.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, ``spark.checkpoint.dir`` of the session; see ``runtime.scratch``."""
    return scratch(spark)


#: With this, Spark removes what a query has shuffled when the query ends, on all executors.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stages:
    """Tables written between the jobs of one operator.

    A written table cuts lineage, runs its plan once, survives lost executors
    and gives the planner true sizes. Its shuffle files go once it is written, as nothing
    reads them again. ``drop`` removes those that the returned
    DataFrame no longer reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: list[str] = []

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_tessera_path", None):
                self._delete(path)

    def drop_others(self, *tables: DataFrame) -> None:
        """Remove all tables but these."""
        keep = {getattr(t, "_tessera_path", None) for t in tables}
        for path in [p for p in self.paths if p not in keep]:
            self._delete(path)

    def _delete(self, path: str) -> None:
        if path in self.paths:
            self.paths.remove(path)
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as the cluster runs tasks, for inputs in one small file."""
    spark = df.sparkSession
    ship(spark)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < max(2, cores // 2) else df


def _bitmap(ids: DataFrame, bits: int = 23) -> DataFrame:
    """256 rows of 4 KB at most, whatever the number of ids: which ids may be among them."""
    at = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << bits)) + 1
    return ids.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def maybe_in(rows: DataFrame, ids: DataFrame, bits: int = 23) -> DataFrame:
    """Rows whose node may be among the ids: all that are, and few others, before anything is shuffled.

    A left semi join with the ids would be moved below this one; follow it by an inner join.
    """
    at = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << bits)) + 1
    rows = rows.withColumn("part", F.bitmap_bucket_number(at)).join(F.broadcast(_bitmap(ids, bits)), "part")
    byte = F.conv(F.hex(F.substring("bitmap", (F.bitmap_bit_position(at) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.where(F.getbit(byte, F.pmod(F.bitmap_bit_position(at), F.lit(8)).cast("int")) == 1).drop("part", "bitmap")
