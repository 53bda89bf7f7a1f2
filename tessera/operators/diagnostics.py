"""Anchor audit and coverage diagnostics: ordered buckets, simulations, gates and checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .corpus import best_per_key

ANCHOR_BUCKETS = ("junk", "duplicate_collision", "low_confidence", "vocab_miss", "multiword", "both_miss", "glove_miss", "gemma_miss", "survives")
MISS_BUCKETS = ("normalization_recoverable", "in_corpus_below_min_count", "lemma_surface_recoverable", "morpheme_composition_recoverable", "subword_inference_recoverable", "logogram_unmatched", "genuinely_missing")


def _flag(rows: DataFrame, words: DataFrame, key: Column, name: str) -> DataFrame:
    w = words.select(F.col("word").alias("_w")).distinct().withColumn(name, F.lit(True))
    return rows.withColumn("_k", key).join(w, F.col("_k") == F.col("_w"), "left").drop("_k", "_w").withColumn(name, F.coalesce(name, F.lit(False)))


def classify_anchors(anchors: DataFrame, vocabulary: DataFrame, glove: DataFrame, gemma: DataFrame, collisions: DataFrame | None = None, normalize=T.strip, least_confidence: float = 0.3) -> DataFrame:
    """Each anchor with ``bucket``, the first that applies, and its two target flags."""
    rows = anchors.withColumn("_s", normalize(F.col("surface")))
    rows = _flag(rows, vocabulary, F.col("_s"), "in_vocab")
    rows = _flag(rows, glove, F.lower("english"), "in_glove")
    rows = _flag(rows, gemma, F.lower("english"), "in_gemma")
    rows = _flag(rows, collisions.select(F.col("surface").alias("word")), F.col("_s"), "collided") if collisions is not None else rows.withColumn("collided", F.lit(False))
    junk = F.col("english").isNull() | F.trim("english").isin("", *T.JUNK_GLOSSES) | F.col("english").rlike("^\\d+$")
    bucket = (
        F.when(junk, "junk").when(F.col("collided"), "duplicate_collision").when(F.col("confidence") < least_confidence, "low_confidence").when(~F.col("in_vocab"), "vocab_miss")
        .when(F.col("english").rlike("[\\s_\\-]"), "multiword").when(~F.col("in_glove") & ~F.col("in_gemma"), "both_miss").when(~F.col("in_glove"), "glove_miss").when(~F.col("in_gemma"), "gemma_miss").otherwise("survives")
    )
    return rows.withColumn("bucket", bucket).drop("_s", "collided")


def bucket_counts(rows: DataFrame, buckets: tuple[str, ...] = ANCHOR_BUCKETS) -> DataFrame:
    """(bucket, n, pct) for all buckets, also those without rows."""
    every = rows.sparkSession.createDataFrame([(i, b) for i, b in enumerate(buckets)], "ord int, bucket string")
    counted = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    out = every.join(counted, "bucket", "left").join(F.broadcast(total)).select("ord", "bucket", F.coalesce("n", F.lit(0)).alias("n"), "total")
    return out.select("bucket", "n", F.coalesce(F.try_divide(100 * F.col("n"), F.col("total")), F.lit(0.0)).alias("pct"), "ord")


def venn(rows: DataFrame, a: str = "in_glove", b: str = "in_gemma") -> DataFrame:
    """(a, b, n): the two-by-two table of the flags."""
    return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def classify_misses(misses: DataFrame, vocabulary: DataFrame, freq: DataFrame, lemma_surfaces: DataFrame, trained_ngrams: DataFrame, normalize=T.normalize_sumerian, least_count: int = 5, least_overlap: float = 0.5, n_range: tuple[int, int] = (3, 6)) -> DataFrame:
    """Each missing surface with ``bucket``: the first way in which it could be recovered, and what was seen on the way."""
    rows = misses.select("surface").distinct().withColumn("norm", normalize(F.col("surface"))).withColumn("parts", T.morphemes(F.col("surface"), normalize))
    v = vocabulary.select("word").distinct()
    rows = _flag(rows, v, F.col("norm"), "norm_hit")
    f = freq.select(F.col("token").alias("_t"), F.col("n").alias("_n"))
    rows = rows.join(f.withColumnRenamed("_n", "raw_n"), F.col("surface") == F.col("_t"), "left").drop("_t").join(f.withColumnRenamed("_n", "norm_n"), F.col("norm") == F.col("_t"), "left").drop("_t")
    rows = rows.withColumn("corpus_n", F.greatest(F.coalesce("raw_n", F.lit(0)), F.coalesce("norm_n", F.lit(0)))).drop("raw_n", "norm_n")
    lemma = lemma_surfaces.join(v, F.col("surface") == F.col("word"), "left_semi").select(F.col("cf").alias("word"))
    rows = _flag(rows, lemma, F.col("norm"), "lemma_hit")
    parts = rows.select("surface", F.explode("parts").alias("part")).join(v.withColumn("known", F.lit(True)), F.col("part") == F.col("word"), "left")
    rows = rows.join(parts.groupBy("surface").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("morphemes_hit")), "surface", "left")
    grams = rows.select("surface", F.explode(T.char_ngrams(F.col("norm"), *n_range)).alias("gram")).join(trained_ngrams.select("gram").distinct().withColumn("known", F.lit(True)), "gram", "left")
    rows = rows.join(grams.groupBy("surface").agg((F.count("known") / F.count(F.lit(1))).alias("overlap")), "surface", "left")
    bucket = (
        F.when(F.col("norm_hit"), MISS_BUCKETS[0]).when((F.col("corpus_n") >= 1) & (F.col("corpus_n") < least_count), MISS_BUCKETS[1]).when(F.col("lemma_hit"), MISS_BUCKETS[2]).when(F.coalesce("morphemes_hit", F.lit(False)), MISS_BUCKETS[3])
        .when(F.coalesce("overlap", F.lit(0.0)) >= least_overlap, MISS_BUCKETS[4]).when(F.col("surface").rlike("^[A-Z0-9.]*[A-Z][A-Z0-9.]*$"), MISS_BUCKETS[5]).otherwise(MISS_BUCKETS[6])
    )
    return rows.withColumn("bucket", bucket)


def threshold_sweep(misses: DataFrame, thresholds: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(threshold, n): how many misses a lower minimum count would let in, all in one pass."""
    counts = misses.agg(*[F.count_if((F.col("corpus_n") >= t) & ~F.col("norm_hit")).alias(str(t)) for t in thresholds])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"`{t}`").alias("n")) for t in thresholds])).alias("x")).select("x.*")


def normalization_hits(misses: DataFrame) -> DataFrame:
    return misses.agg(F.count_if("norm_hit").alias("n"))


def lemma_expansion(anchors: DataFrame, lemma_surfaces: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """resolvable anchors and distinct surfaces that citation forms lead to."""
    reach = lemma_surfaces.join(vocabulary.select(F.col("word").alias("surface")).distinct(), "surface", "left_semi")
    got = anchors.select(F.col("surface").alias("cf")).join(reach, "cf")
    return got.agg(F.count_distinct("cf").alias("resolvable"), F.count_distinct("surface").alias("surfaces"))


def composed_vectors(misses: DataFrame, space: DataFrame) -> DataFrame:
    """(surface, mean): the mean vector of the morphemes, for surfaces all of whose morphemes have one."""
    from .nearest import mean_vector

    parts = misses.where("morphemes_hit").select("surface", F.explode("parts").alias("word"))
    return mean_vector(parts.join(space.select("word", "vec"), "word"), ["surface"], "vec")


def overlap_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(a))


def coverage(tokens: DataFrame, vocabulary: DataFrame, by: str) -> DataFrame:
    """(by, n_tokens, n_known, share) of (by, token) rows."""
    v = vocabulary.select(F.col("word").alias("token")).distinct().withColumn("known", F.lit(True))
    out = tokens.join(v, "token", "left").groupBy(by).agg(F.count(F.lit(1)).alias("n_tokens"), F.count("known").alias("n_known"))
    return out.withColumn("share", F.col("n_known") / F.col("n_tokens"))


def examples(rows: DataFrame, bucket: str, order: list[str], n: int = 5, seed: int = 42) -> DataFrame:
    """A seeded sample of a bucket's rows, in order."""
    total = rows.where(F.col("bucket") == bucket).count()
    drawn = sorted(np.random.default_rng(seed).choice(total, min(n, total), replace=False).tolist()) if total else []
    from pyspark.sql import Window as W

    numbered = rows.where(F.col("bucket") == bucket).withColumn("_i", F.row_number().over(W.partitionBy("bucket").orderBy(*order)) - 1)
    return numbered.where(F.col("_i").isin(drawn)).drop("_i")


def recoverability(counts: DataFrame, high: tuple[str, ...] = MISS_BUCKETS[:2], medium: tuple[str, ...] = MISS_BUCKETS[2:5]) -> DataFrame:
    """Shares of high, medium and low recoverability among all misses."""
    level = F.when(F.col("bucket").isin(*high), "high").when(F.col("bucket").isin(*medium), "medium").otherwise("low")
    return counts.groupBy(level.alias("level")).agg(F.sum("pct").alias("pct"))


def degenerate_share(top: DataFrame, concept: str, word: str, rnk: str = "rnk") -> DataFrame:
    """(concept, share) of the five best words with at most two letters; a concept without words isn't listed."""
    return top.where(F.col(rnk) <= 5).groupBy(concept).agg(F.avg((F.length(word) <= 2).cast("double")).alias("share"))


def preflight(concepts: DataFrame, english: DataFrame, top: DataFrame, passages: DataFrame) -> DataFrame:
    """Per concept: passed, reasons, warnings and passage count (lines)."""
    rows = _flag(concepts, english, F.lower("concept"), "known")
    rows = rows.join(degenerate_share(top, "concept", "word"), "concept", "left").join(passages.groupBy("concept").agg(F.count(F.lit(1)).alias("n_passages")), "concept", "left")
    share, n = F.coalesce("share", F.lit(1.0)), F.coalesce("n_passages", F.lit(0))
    reasons = F.array_compact(F.array(F.when(~F.col("known"), "concept has no vector"), F.when(n == 0, "no passages")))
    warnings = F.array_compact(F.array(F.when(share > 0.5, "most neighbours are fragments")))
    return rows.select("concept", (F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"), warnings.alias("warnings"), n.alias("n_passages"))


def unsupported_claims(text: DataFrame, figures: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Numbers in [-1, 1] that a text states and no figure is near: both sides meet in cells as wide as the tolerance."""
    cell = lambda x: F.floor(x / tolerance)
    claims = text.select(F.explode(T.numeric_claims(F.col("text"))).alias("claim")).distinct()
    near = claims.select("claim", F.explode(F.array(cell(F.col("claim")) - 1, cell(F.col("claim")), cell(F.col("claim")) + 1)).alias("cell"))
    f = figures.select(F.col("value"), cell(F.col("value")).alias("cell"))
    good = near.join(f, "cell").where(F.abs(F.col("claim") - F.col("value")) <= tolerance).select("claim").distinct()
    return claims.join(good, "claim", "left_anti")


def first_duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    return best_per_key(rows, [key], [F.col(order)])


def file_hashes(spark, path: str) -> DataFrame:
    """(path, sha256) of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
