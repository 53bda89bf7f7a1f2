"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, Stages


def seats(share: Column) -> Column:
    """Seats of a party whose weight is ``share`` times the divisor: highest quotients share / (2k + 1) above one half, so that a quotient of exactly one half gets none.

    All parties that use one divisor have what highest quotients give them of the seats they have together.
    """
    return F.ceil(share - 0.5)


def numbered(stages: Stages, sources: DataFrame) -> DataFrame:
    """The sources with their ``at``, from 0 by code point, null last: dealt out by range, numbered within their part. The driver holds a row per part."""
    parts = max(1, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    last = F.col("source").isNull()
    placed = stages.keep(sources.repartitionByRange(parts, last, "source").withColumn("part", F.spark_partition_id()), "placed")
    before, seen = [], 0
    for r in sorted(placed.groupBy("part").count().collect()):
        before.append((r["part"], seen))
        seen += r["count"]
    table = sources.sparkSession.createDataFrame(before, "part int, before long")
    order = W.partitionBy("part").orderBy(last, "source")
    return placed.withColumn("row", F.row_number().over(order)).join(F.broadcast(table), "part").select("source", "source_size", (F.col("row") - 1 + F.col("before")).alias("at"))


def water_fill(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """The sources (source, source_size, at) with ``target``: by weight they share ``share`` times all sizes; what is over ``cap`` times a source's size is reshared.

    A source is over if the words per unit of weight are more than ``cap`` times its size by its weight. They grow from round to round and
    follow from sums over the sources, exact fractions, of which the driver holds one row per weight.
    """
    k = len(weights)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    kind = F.pmod("at", F.lit(k)).cast("int")
    most = [-1] * k  # for each weight, the largest size that is over so far

    def over() -> Column:
        return F.col("source_size") <= F.element_at(F.array(*[F.lit(x).cast("long") for x in most]), kind + 1)

    while True:
        left, weight = Fraction(share) * total, Fraction(0)
        for r in sources.where("source_size > 0").groupBy(kind.alias("kind")).agg(F.sum(F.when(over(), F.col("source_size"))).alias("full"), F.sum(F.when(over(), 0).otherwise(1)).alias("open")).collect():
            left -= Fraction(cap) * (r["full"] or 0)
            weight += Fraction(weights[r["kind"]]) * r["open"]
        rate = left / weight if weight else Fraction(0)
        # strictly over: rate * weight > cap * size
        now = [max(m, -int(-rate * Fraction(w) / Fraction(cap) // 1) - 1) if weight else m for m, w in zip(most, weights)]
        changed = [F.sum(F.when((kind == i) & (F.col("source_size") > m) & (F.col("source_size") <= n), 1)) for i, (m, n) in enumerate(zip(most, now))]
        if not any(sources.where("source_size > 0").agg(*[c.alias(f"c{i}") for i, c in enumerate(changed)]).first()):
            break
        most = now
    per_kind = F.element_at(F.array(*[F.lit(float(rate * Fraction(w))) for w in weights]), kind + 1)
    return sources.withColumn("target", F.when(F.col("source_size") == 0, 0.0).when(over(), F.col("source_size") * float(cap)).otherwise(per_kind))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 64,
    blocks_per_source: int = 2048,
    blocks_per_shard: int = 20_000,
    seed: int = 7,
) -> DataFrame:
    """How many words of each document a mix of all sources takes.

    Sizes are word counts (null text: 0). The sources, by code point and null
    last, have ``weights`` in turn and share ``share`` times all words, at most
    ``cap`` times their own. A source's blocks have its size by ``blocks_per_source``, rounded down, but at least one and at most
    ``block_words`` words. Its documents are dealt to shards of about ``blocks_per_shard`` blocks, and each shard gets
    blocks by Sainte-Laguë, its weight being its part of the source's target: the divisor is one
    block for all, so that quotas need no common table. A shard repeats all its documents as often as its
    quota allows and fills the rest with blocks in seeded hash order.

    Returns doc_id, source, copy, size, source_size, target, taken. Repeated rows
    are told apart by ``copy``; null ids and sources are groups as any other; an empty
    table gives an empty result; further columns are ignored. No table of sources or shards
    comes to the driver, and no window spans more than a shard.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "mix")
    rows = (
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    rows = stages.keep(rows, "sizes")
    sources = stages.keep(numbered(stages, rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))), "sources")
    table = water_fill(sources, weights, share, cap)
    table = table.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / blocks_per_source))).cast("int"))
    table = stages.keep(table.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / (F.col("block") * blocks_per_shard)))), "targets").withColumnRenamed("source", "name")

    copy = (
        rows.join(table, F.col("source").eqNullSafe(F.col("name")))
        .select("doc_id", "source", "at", "size", "source_size", "target", "block", "shards", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "copy", F.lit(seed)), F.col("shards")))
    )
    held = copy.groupBy("at", "shard").agg(F.sum("size").alias("n"), F.max("target").alias("target"), F.max("source_size").alias("whole"), F.max("block").alias("block"))
    words = F.least(seats(F.col("target") * (F.col("n") / F.col("whole")) / F.col("block")) * F.col("block"), F.floor(F.col("n") * cap))
    part = held.withColumn("words", F.when(F.col("n") > 0, words).otherwise(0)).select("at", "shard", F.when(F.col("n") > 0, F.floor(F.col("words") / F.col("n"))).otherwise(0).alias("times"), "words", "n")
    part = stages.keep(part.select("at", "shard", "times", (F.col("words") - F.col("times") * F.col("n")).alias("rest")), "quotas")
    blocks = (
        copy.join(part, ["at", "shard"])
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / F.col("block")) - 1, F.lit(0)).cast("int"))))
        .withColumn("words", F.least(F.col("block"), F.col("size") - F.col("k") * F.col("block")))
    )
    # the draw is by hash; a block is taken if most of it lies below the quota
    order = W.partitionBy("at", "shard").orderBy(F.xxhash64("doc_id", "size", "copy", "k", F.lit(seed + 1)), "doc_id", "size", "copy", "k")
    upto = F.sum("words").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        blocks.withColumn("upto", upto)
        .withColumn("got", F.when(2 * F.col("upto") - F.col("words") < 2 * F.col("rest"), F.col("words")).otherwise(0))
        .groupBy("at", "shard", "doc_id", "source", "copy", "size", "source_size", "target", "times")
        .agg(F.sum("got").alias("got"))
        .select("doc_id", "source", "copy", "size", "source_size", "target", (F.col("times") * F.col("size") + F.col("got")).cast("long").alias("taken"))
    )


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
