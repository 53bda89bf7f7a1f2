"""Ranks, correlations, permutation tests and document studies."""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import vectors as V
from ..runtime import written


def _ranked(df: DataFrame, col: str, by: list[str], n: str | None = None) -> tuple[DataFrame, list[str]]:
    """(_k0.., _v, _rank, _total) for each value of ``col`` in each group, and the names of the group's columns: its average rank from 1 and the group's rows.

    Values are counted (``n``: a column of how many rows a row stands for), dealt out by group and range and numbered part by part, so that a group may be larger than a task.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [f"_k{i}" for i in range(len(by))]
    counted = df.groupBy(*[F.col(k).alias(name) for k, name in zip(by, names)], F.col(col).alias("_v")).agg((F.sum(n) if n else F.count(F.lit(1))).alias("_n"))
    counted = written(counted.repartitionByRange(parts, *names, "_v").withColumn("_part", F.spark_partition_id()), "ranks")
    # a row for each group of a part
    group = W.partitionBy(*names)
    sizes = counted.groupBy(*names, "_part").agg(F.sum("_n").alias("_in"))
    before = F.coalesce(F.sum("_in").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*names, "_part", before.alias("_before"), F.sum("_in").over(group).alias("_total"))
    upto = F.sum("_n").over(W.partitionBy(*names, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    x, y = counted.withColumn("_upto", upto).alias("x"), sizes.alias("y")
    met = x.join(y, reduce(Column.__and__, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in [*names, "_part"]]))
    return met.select(*[f"x.{c}" for c in names], "_v", (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias("_rank"), "_total"), names


def _with_rank(df: DataFrame, col: str, by: list[str], out: str, rank: Column, n: str | None = None) -> DataFrame:
    ranked, names = _ranked(df, col, by, n)
    ranked = ranked.select(*names, "_v", rank.alias(out))
    on = [F.col(k).eqNullSafe(F.col(name)) for k, name in zip([*by, col], [*names, "_v"])]
    return df.join(ranked, reduce(Column.__and__, on)).drop(*names, "_v")


def average_rank(df: DataFrame, col: str, by: list[str], out: str) -> DataFrame:
    """Ranks from 1 among the rows of a group, ties sharing their mean."""
    return _with_rank(df, col, by, out, F.col("_rank"))


def spearman_by(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, rho): null where either side is constant. Equal rows are counted first; ranks are taken from their mean, so that large groups lose no digits."""
    rows = written(df.groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_rows")), "pairs")
    centred = F.col("_rank") - (F.col("_total") + 1) / 2
    ranked = _with_rank(_with_rank(rows, "_x", by, "_rx", centred, "_rows"), "_y", by, "_ry", centred, "_rows")
    total = lambda a, b: F.sum(F.col("_rows") * F.col(a) * F.col(b))
    sums = ranked.groupBy(*by).agg(total("_rx", "_ry").alias("xy"), total("_rx", "_rx").alias("xx"), total("_ry", "_ry").alias("yy"))
    spread = F.sqrt("xx") * F.sqrt("yy")
    return sums.select(*by, F.when(spread > 0, F.col("xy") / F.when(spread > 0, spread)).alias("rho"))


def ranks(x) -> np.ndarray:
    x = np.asarray(x, float)
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    return (last - (count - 1) / 2)[inverse]


def spearman(x, y) -> float:
    """Correlation of average ranks; NaN if a side is constant."""
    a, b = ranks(x), ranks(y)
    if len(a) < 2 or a.std() == 0 or b.std() == 0:
        return math.nan
    return float(np.corrcoef(a, b)[0, 1])


def midrank_percentile(null: DataFrame, col: str, observed: float) -> DataFrame:
    """Share of the null below the observed value, ties by half, in percent."""
    return null.agg((100 * (F.count_if(F.col(col) < observed) + 0.5 * F.count_if(F.col(col) == observed)) / F.count(F.lit(1))).alias("percentile"))


def rank_in_pool(scores: DataFrame, query: str, score: str, target: str) -> DataFrame:
    """(query, rnk): 1 + the number of candidates that score strictly higher than the target row (where ``target`` holds)."""
    aim = scores.where(F.col(target)).select(query, F.col(score).alias("_t"))
    return scores.join(aim, query).groupBy(query).agg((1 + F.count_if(F.col(score) > F.col("_t"))).alias("rnk"))


def mean_reciprocal_rank(rows: DataFrame, rnk: str = "rnk") -> DataFrame:
    return rows.agg(F.round(F.avg(1 / F.col(rnk)), 4).alias("mrr"))


def upper_triangle(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(len(m), 1)]


def theme_similarities(centroids: DataFrame, theme: str = "theme", vec: str = "mean") -> DataFrame:
    """(i, j, sim) for each pair of a study's themes, i < j: a handful, set against each other as one list per theme."""
    t = centroids.select(F.col(theme).alias("t"), V.doubles(F.col(vec)).alias("v"))
    return t.alias("a").join(t.alias("b"), F.col("a.t") < F.col("b.t")).select(F.col("a.t").alias("i"), F.col("b.t").alias("j"), V.cosine(F.col("a.v"), F.col("b.v")).alias("sim"))


def rsa_permutation(a: np.ndarray, b: np.ndarray, most: int = 1000, rng: np.random.Generator | None = None) -> dict:
    """Spearman of the upper triangles, and how often a relabelling of b does as well: every one if there are at most ``most``, else seeded draws."""
    k = len(a)
    rho = spearman(upper_triangle(a), upper_triangle(b))
    if math.factorial(k) <= most:
        perms = [np.array(p) for p in itertools.permutations(range(k))]
    else:
        rng = rng or np.random.default_rng(42)
        perms = [rng.permutation(k) for _ in range(most)]
    at_least = sum(spearman(upper_triangle(a), upper_triangle(b[np.ix_(p, p)])) >= rho - 1e-12 for p in perms)
    return {"rho": round(rho, 4), "n_perms": len(perms), "p": round(at_least / len(perms), 4)}


def verdict(percentile: float) -> str:
    return "supports" if percentile >= 90 else "fails" if percentile <= 75 else "inconclusive"


def bootstrap_null(pool: np.ndarray, size: int, statistic, draws: int = 1000, rng: np.random.Generator | None = None) -> np.ndarray:
    """The statistic of ``draws`` seeded samples without replacement; samples for which it is NaN are left out."""
    rng = rng or np.random.default_rng(42)
    out = np.array([statistic(pool[rng.choice(len(pool), size, replace=False)]) for _ in range(draws)])
    return out[~np.isnan(out)]


def rank_deltas(df: DataFrame, x: str, y: str, keys: list[str], n: int = 5) -> DataFrame:
    """The n rows whose rank differs most between two columns."""
    r = average_rank(average_rank(df, x, [], "rank_x"), y, [], "rank_y").withColumn("delta", F.col("rank_y") - F.col("rank_x"))
    return r.orderBy(F.abs("delta").desc(), *keys).limit(n)


def slot_pairs(slots: list[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(slots, 2))


def shared_ladder(members: DataFrame, slot_a: str, slot_b: str, themes: list[str]) -> list[str]:
    """Themes, in their order, that have members in both slots."""
    have = {r["theme"] for r in members.where(F.col("slot").isin(slot_a, slot_b)).groupBy("theme").agg(F.count_distinct("slot").alias("n")).where("n = 2").collect()}
    return [t for t in themes if t in have]


def gradient_means(pairs: DataFrame, family: str = "family", rho: str = "rho") -> DataFrame:
    return pairs.groupBy(family).agg(F.avg(rho).alias("mean_rho"))


def roster(docs: DataFrame, pinned: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Documents that the pinned list (doc_id, theme, ord) names; KeyError if one is missing."""
    docs = docs if excluded is None else docs.join(excluded, "doc_id", "left_anti")
    if missing := [r["doc_id"] for r in pinned.join(docs, "doc_id", "left_anti").limit(20).collect()]:
        raise KeyError(f"pinned documents are missing: {missing}")
    return docs.join(pinned, "doc_id")


def fingerprint_baselines(prints: DataFrame) -> DataFrame:
    """Mean and greatest Spearman of concept fingerprints (slot, theme, concept, value), of matched themes across slots, mismatched ones, and within slots."""
    x, y = prints.alias("x"), prints.alias("y")
    pairs = x.join(y, F.col("x.concept") == F.col("y.concept")).where(F.struct("x.slot", "x.theme") < F.struct("y.slot", "y.theme"))
    kind = F.when(F.col("x.slot") == F.col("y.slot"), "within_slot").when(F.col("x.theme") == F.col("y.theme"), "matched").otherwise("mismatched")
    pairs = pairs.select(kind.alias("kind"), F.concat_ws("|", "x.slot", "x.theme", "y.slot", "y.theme").alias("pair"), F.col("x.value").alias("a"), F.col("y.value").alias("b"))
    return spearman_by(pairs, "a", "b", ["kind", "pair"]).groupBy("kind").agg(F.avg("rho").alias("mean_rho"), F.max("rho").alias("max_rho"), F.count("rho").alias("n"))
