"""Incremental corpus ingest on Structured Streaming: the batch operators kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def token_counts(stream: DataFrame, tokens: Column) -> DataFrame:
    """Running token frequencies of a stream of documents; write in complete or update mode."""
    return stream.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per event-time window and key; events later than ``late`` are no longer waited for."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_records(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """One record per key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def _versions(spark: SparkSession, path: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [d.getPath().getName() for d in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[1:]) for n in names if n.startswith("v"))


def run_available(out: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Take in all that is there, then give the result table. Each batch writes it whole, as Parquet under the checkpoint folder; the driver holds none of it."""
    spark: SparkSession = out.sparkSession
    table = f"{checkpoint}/result"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/v{number}")

    query = out.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    done = _versions(spark, table)
    return spark.read.schema(out.schema).parquet(f"{table}/v{done[-1]}") if done else spark.createDataFrame([], out.schema)


def upsert_best(batch: DataFrame, state_path: str, key: str, size: Column) -> None:
    """For foreachBatch: merge a batch into the table of the records with the greatest size per key (ties: the one that was there)."""
    spark = batch.sparkSession
    new = batch.withColumn("_size", size).withColumn("_new", F.lit(1))
    versions = _versions(spark, state_path)
    both = new
    if versions:
        both = new.unionByName(spark.read.parquet(f"{state_path}/v{versions[-1]}").withColumn("_new", F.lit(0)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c not in (key, "_new")]), F.struct("_size", -F.col("_new"))).alias("r")).select(key, "r.*")
    # a version is complete before the next batch reads it
    best.write.parquet(f"{state_path}/v{(versions[-1] if versions else -1) + 1}")
