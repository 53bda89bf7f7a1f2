"""What the two trained operators share: folds, bounded samples, features as binary columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 0 on division by 5; a null id isn't held out, and isn't learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, most: int, text: str | None = None, seed: int = 11) -> DataFrame:
    """At most ``most`` different rows (doc_id, ``label``, ``text``), equally many of each label where it has them, in the order of a seeded hash.

    Repeats of a row count once. With more than ``most`` labels only the most frequent ``most`` are drawn from. A label's share of the hash range follows
    from its count, so that little is sorted; the bound is then kept exactly by numbering.
    """
    spark = rows.sparkSession
    names = ["doc_id", label, *([text] if text else [])]
    found = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(most).collect()
    if not found:
        return rows.select(*names).limit(0)
    each = max(1, most // len(found))
    # as many rows as there are labels, ``most`` at most; twice the share, so that chance leaves few short
    table = spark.createDataFrame([(r[0], min(1.0, 2 * each / r["n"])) for r in found], rows.select(rows[label], F.lit(0.5).alias("part")).schema)
    key = F.xxhash64("doc_id", *([text] if text else []), F.lit(seed))
    drawn = rows.select(*names).withColumn("draw", key).join(F.broadcast(table), label).where(F.pmod("draw", F.lit(1_000_003)) / 1_000_003 < F.col("part"))
    once = drawn.groupBy(label, "doc_id", "draw").agg(F.first(text).alias(text)) if text else drawn.select(label, "doc_id", "draw").distinct()
    order = W.partitionBy(label).orderBy(F.pmod("draw", F.lit(1_000_003)), "draw", "doc_id")
    return once.withColumn("at", F.row_number().over(order)).where(F.col("at") <= each).select(*names)
