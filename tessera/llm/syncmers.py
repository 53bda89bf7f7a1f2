"""Document fingerprints of closed syncmers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Stages

#: A k-mer is K words; it is an anchor if the least of its K - S + 1 inner strings of S words is its first or last.
K, S = 6, 2
#: Scripts without spaces between words; each of their letters counts as a word.
GRAINS = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]|[\\p{L}\\p{M}\\p{N}&&[^\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]]+"


def let(value: Column, fn) -> Column:
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def anchors(text: Column) -> Column:
    """array of struct(hash, at) of every closed syncmer, ``at`` counted in words, in order.

    Whether a k-mer is an anchor depends on its own words alone, so that an edit moves or removes only the anchors
    whose words it touches. A text of fewer than K words, or none of whose k-mers is one, has one anchor, of all its words; one without words
    the hash of its characters; the empty text none.
    """

    def from_words(ws):
        inner = F.transform(F.sequence(F.lit(0), F.size(ws) - S), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1)))

        def from_inner(hs):
            def at(i):
                window = [F.get(hs, i + j) for j in range(K - S + 1)]
                edge = F.least(window[0], window[-1])
                # the k-mer's hash combines inner strings that cover it
                return F.when(edge <= F.least(*window[1:-1]), F.struct(F.xxhash64(window[0], window[2], window[-1]).alias("hash"), i.cast("int").alias("at")))

            return F.filter(F.transform(F.sequence(F.lit(0), F.size(ws) - K), at), lambda x: x.isNotNull())

        all_words = F.array(F.struct(F.xxhash64(ws).alias("hash"), F.lit(0).alias("at")))
        found = F.when(F.size(ws) >= K, let(inner, from_inner))
        return F.when(F.size(ws) > 0, let(found, lambda a: F.when(F.size(a) > 0, a).otherwise(all_words)))

    whole = F.when(text != "", F.array(F.struct(F.xxhash64(text).alias("hash"), F.lit(0).alias("at")))).otherwise(F.array().cast("array<struct<hash:bigint,at:int>>"))
    return F.coalesce(let(F.regexp_extract_all(F.lower(text), F.lit(GRAINS), F.lit(0)), from_words), whole)


def places(anchors_: Column) -> Column:
    """The set of a text's anchors with their places: a hash of each anchor, the next one and the words between; of a lone anchor its own.

    What two texts share of it are anchors that match at the same offset as their neighbours: a shared passage
    keeps its own wherever it stands, a chance match of one anchor has none.
    """
    pair = lambda a, i: F.xxhash64(a[i]["hash"], a[i + 1]["hash"], a[i + 1]["at"] - a[i]["at"])
    return let(anchors_, lambda a: F.when(F.size(a) < 2, F.transform(a, lambda x: x["hash"])).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(a) - 2), lambda i: pair(a, i)))))


def as_string(places_: Column, size: int) -> Column:
    """The ``size`` least hashes of the set, 32 bits of each, which texts that share passages share, and 64 bits of the whole set; of an empty set nothing."""
    least = F.transform(F.slice(F.array_sort(places_), 1, size), lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, 32))), 8, "0"))
    whole = F.lpad(F.lower(F.hex(F.xxhash64(F.array_sort(places_)))), 16, "0")
    return F.when(F.size(places_) == 0, "").otherwise(F.concat(F.array_join(least, ""), whole))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two whole sets; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def matched_offsets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positional matches of (doc_id, anchors) tables: id_a, id_b, offset, n, first, last.

    Anchors that two texts share at a constant offset belong to one shared passage; ``first``
    and ``last`` are its ends in a, in words. Anchors seen more than once in a text are left out of its matches, as their positions are ambiguous.
    """

    def once(t, side):
        x = t.select(F.col("doc_id").alias(f"id_{side}"), F.explode("anchors").alias("x"))
        return x.groupBy(f"id_{side}", F.col("x.hash").alias("hash")).agg(F.min("x.at").alias(f"at_{side}"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")

    return once(a, "a").join(once(b, "b"), "hash").groupBy("id_a", "id_b", (F.col("at_b") - F.col("at_a")).alias("offset")).agg(F.count(F.lit(1)).alias("n"), F.min("at_a").alias("first"), F.max("at_a").alias("last"))


def following(stages: Stages, ids: DataFrame) -> DataFrame:
    """(id, rk, next_id, next_rk) by ascending (id, rk); the first follows the last.

    The keys are dealt out by range and numbered within their part; only the last of each part looks
    into the next one. The driver holds one row per part.
    """
    from pyspark.sql import Window as W

    spark = ids.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = stages.keep(ids.repartitionByRange(parts, "id", "rk").select("id", "rk", F.spark_partition_id().alias("part")), "placed")
    heads = sorted((r["part"], r["f"]["id"], r["f"]["rk"]) for r in placed.groupBy("part").agg(F.min(F.struct("id", "rk")).alias("f")).collect())
    after = [(p, *heads[(i + 1) % len(heads)][1:]) for i, (p, _, _) in enumerate(heads)]
    table = spark.createDataFrame(after, "part int, after_id long, after_rk long")
    order = W.partitionBy("part").orderBy("id", "rk")
    got = placed.withColumn("n", F.lead(F.struct("id", "rk")).over(order)).join(F.broadcast(table), "part")  # a row per part
    return got.select("id", "rk", F.coalesce("n.id", "after_id").alias("next_id"), F.coalesce("n.rk", "after_rk").alias("next_rk"))


def fingerprints(docs: DataFrame, size: int = 64) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and how alike they and the next document's are.

    Likenesses are of the whole sets of a text's closed syncmers with their places; the fingerprint strings hold the ``size`` least of them
    and a hash of all. The edited text
    has its last floor(n_chars / 2) code points replaced by the first as many of the next document, by ascending doc_id and
    then by the text's hash (after the last: the first).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_anchors. Null texts are empty.
    A null doc_id comes first. A repeated row (same doc_id and text) is one document in the order and gives equal rows. A single
    document is its own next one. An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "syncmers")
    nowhere = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(nowhere)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rk", F.xxhash64("text"))
    ids = stages.keep(rows.select("id", "rk").distinct(), "ids")
    if ids.isEmpty():
        return ids.select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_chars"), *[F.lit("").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], F.lit(0.0).alias("near_edited"), F.lit(0.0).alias("near_next"), F.lit(0).alias("n_anchors"))
    order = following(stages, ids)
    # from the next document's side: who comes before it
    lends = stages.keep(order.select(F.col("next_id").alias("id"), F.col("next_rk").alias("rk"), F.col("id").alias("to_id"), F.col("rk").alias("to_rk")), "lends")
    # the texts go to the document before them whole; what is made of them is larger
    loan = rows.join(lends, ["id", "rk"]).groupBy(F.col("to_id").alias("id"), F.col("to_rk").alias("rk")).agg(F.first("text").alias("next"))
    m = F.floor(F.length("text") / 2).cast("int")
    both = rows.join(loan, ["id", "rk"]).select("id", "text", "next", F.concat(F.substring("text", F.lit(1), F.length("text") - m), F.substring("next", F.lit(1), m)).alias("edited"))
    both = both.select("id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), anchors(F.col("text")).alias("a"), anchors(F.col("next")).alias("b"), anchors(F.col("edited")).alias("e"))
    return both.select("id", "n_chars", "edited_sha256", F.size("a").alias("n_anchors"), F.array(*[places(F.col(c)) for c in "abe"]).alias("sets")).select(
        F.when(F.col("id") != nowhere, F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_string(F.col("sets")[0], size).alias("fingerprint"),
        as_string(F.col("sets")[2], size).alias("edited_fingerprint"),
        likeness(F.col("sets")[0], F.col("sets")[2]).alias("near_edited"),
        likeness(F.col("sets")[0], F.col("sets")[1]).alias("near_next"),
        "n_anchors",
    )


def op7_syncmers(spark, sf_dir: str) -> DataFrame:
    from .common import documents, spread

    return fingerprints(spread(documents(spark, sf_dir)))
