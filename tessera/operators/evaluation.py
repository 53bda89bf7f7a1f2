"""The evaluation suite: strata, CSLS accuracy by regime, samples, artifacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from ..runtime import written
from .graph import sample_without_replacement
from .nearest import csls_topk

CANDIDATES = 50_000


def load_candidates(space: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """The first n rows by index; the predicate reaches the scan."""
    return space.where(F.col("row_idx") < n)


def stratify(test: DataFrame, seen: DataFrame, gold: str = "gold") -> DataFrame:
    """interpolation where training or validation has the gold word, else zero_shot."""
    s = seen.select(gold).distinct().withColumn("_seen", F.lit(True))
    return test.join(s, gold, "left").withColumn("stratum", F.when(F.col("_seen"), "interpolation").otherwise("zero_shot")).drop("_seen")


def synonyms(words: DataFrame, synsets: DataFrame | None) -> DataFrame:
    """(word, synonym): the words of all synsets (synset, word) that a word is in, and itself; just itself without synsets."""
    own = words.select("word", F.lower("word").alias("synonym"))
    if synsets is None:
        return own
    s = synsets.select("synset", F.lower(F.replace("word", F.lit("_"), F.lit(" "))).alias("w"))
    return own.unionByName(words.join(s, words["word"] == s["w"]).select("word", "synset").join(s, "synset").select("word", F.col("w").alias("synonym"))).distinct()


def score_regime(queries: DataFrame, candidates: DataFrame, pool: DataFrame, syn: DataFrame | None = None, ks: tuple[int, ...] = (1, 5, 10), by: tuple[str, ...] = ()) -> DataFrame:
    """One row per group: n, oov, and exact and synonym accuracy in percent at each k; zeros if nothing can be evaluated.

    ``queries`` is (q_id, gold, vec, ...), ``candidates`` (row_idx, word, vec), ``pool`` (q_id, vec).
    """
    known = candidates.select(F.col("word").alias("gold")).distinct().withColumn("_in", F.lit(True))
    rows = written(queries.join(known, "gold", "left").withColumn("_in", F.coalesce("_in", F.lit(False))), "regime")
    base = rows.groupBy(*by).agg(F.count_if("_in").alias("n"), F.count_if(~F.col("_in")).alias("oov"))
    c = candidates.select(F.col("row_idx").alias("vec_id"), F.col("vec").alias("embedding"))
    top = csls_topk(rows.where("_in").select(F.col("q_id").alias("vec_id"), F.col("vec").alias("embedding")), c, pool.select(F.col("q_id").alias("vec_id"), F.col("vec").alias("embedding")), top=max(ks))
    named = top.join(candidates.select(F.col("row_idx").alias("c"), "word"), "c").join(rows.where("_in").select(F.col("q_id").alias("q"), "gold", *by), "q")
    exact = F.min(F.when(F.col("word") == F.col("gold"), F.col("rnk"))).alias("exact")
    if syn is None:
        named = named.withColumn("same", F.lower("word") == F.lower("gold"))
    else:
        s = syn.select(F.col("word").alias("gold"), F.col("synonym").alias("word"), F.lit(True).alias("same"))
        named = named.withColumn("word", F.lower("word")).join(s, ["gold", "word"], "left")
        exact = F.min(F.when(F.col("word") == F.lower("gold"), F.col("rnk"))).alias("exact")
    hits = named.groupBy("q", *by).agg(exact, F.min(F.when(F.col("same"), F.col("rnk"))).alias("syn"))
    rate = lambda col, k: (100 * F.avg(F.coalesce(F.col(col) <= k, F.lit(False)).cast("double"))).alias(f"{col}_top{k}")
    scored = hits.groupBy(*by).agg(*[rate(c, k) for c in ("exact", "syn") for k in ks])
    names = [f"{c}_top{k}" for c in ("exact", "syn") for k in ks]
    out = base.join(scored, list(by), "left") if by else base.join(scored)
    return out.select(*by, "n", "oov", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in names])


def val_topk(predictions: DataFrame, candidates: DataFrame, k: int) -> float:
    """Exact CSLS accuracy at k, the predictions themselves being the pool."""
    return score_regime(predictions, candidates, predictions, ks=(k,)).first()[f"exact_top{k}"]


def score_suite(train: DataFrame, val: DataFrame, test: DataFrame, candidates: DataFrame, syn: DataFrame | None = None, sample: int = 1000, seed: int = 42) -> DataFrame:
    """Dictionary (a sample of train), interpolation, zero_shot and combined; the pool is all of their queries."""
    drawn = written(sample_without_replacement(train, sample, "ord", seed), "drawn")
    test = stratify(test, train.select("gold").unionByName(val.select("gold")))
    pool = drawn.select("q_id", "vec").unionByName(val.select("q_id", "vec")).unionByName(test.select("q_id", "vec"))
    regimes = [("dictionary", drawn), ("interpolation", test.where("stratum = 'interpolation'")), ("zero_shot", test.where("stratum = 'zero_shot'")), ("combined", test)]
    out = None
    for name, rows in regimes:
        got = score_regime(rows, candidates, pool, syn).withColumn("regime", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def save_bundle(predictions: DataFrame, config: dict, path: str) -> None:
    """Predictions (split, q_id, surface, gold, stratum, vec) by split, and the configuration as one JSON row."""
    predictions.write.mode("overwrite").partitionBy("split").parquet(f"{path}/predictions")
    predictions.sparkSession.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").coalesce(1).write.mode("overwrite").json(f"{path}/config")


def load_bundle(spark, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/predictions"), json.loads(spark.read.schema("config string").json(f"{path}/config").first()["config"])
