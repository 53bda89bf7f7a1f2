"""Six lenses on a pair of embedding spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, vectors as V
from ..runtime import few
from .corpus import best_per_key
from .nearest import block_topk, kth_distance, neighbour_table, similar_pairs, similarity_histogram


def english_displacement(anchors: DataFrame, source: DataFrame, target: DataFrame, top: int = 50, keep: Column | None = None) -> DataFrame:
    """Lens 1: anchors whose vector is least like that of their English word (of equal lower-cased words the last), then by surface."""
    t = best_per_key(target.select(F.lower("word").alias("english"), F.col("vec").alias("t"), "row_idx"), ["english"], [F.col("row_idx").desc()]).drop("row_idx")
    rows = anchors.withColumn("english", F.lower("english")).join(source.select(F.col("word").alias("surface"), F.col("vec").alias("s")), "surface").join(t, "english")
    rows = rows.where(keep) if keep is not None else rows
    return rows.withColumn("sim", V.cosine(V.doubles(F.col("s")), V.doubles(F.col("t")))).drop("s", "t").orderBy("sim", "surface").limit(top)


def lens1_filter(min_surface: int = 2, min_confidence: float = 0.5) -> Column:
    e = F.col("english")
    return (F.length(e) > 2) & ~e.isin(*T.JUNK_GLOSSES) & ~e.rlike("^\\d+$") & (F.length("surface") >= min_surface) & (F.col("confidence") >= min_confidence)


def no_counterpart(source: DataFrame, target: DataFrame, anchors: DataFrame, freq: DataFrame, top: int = 50) -> DataFrame:
    """Lens 2: words that aren't anchors, by frequency times distance to the nearest target."""
    rest = source.join(anchors.select(F.col("surface").alias("word")).distinct(), "word", "left_anti")
    nn = block_topk(rest.select(F.col("row_idx").alias("vec_id"), F.col("vec").alias("embedding")), target.select(F.col("row_idx").alias("vec_id"), F.col("vec").alias("embedding")), 1)
    rows = nn.join(rest.select(F.col("row_idx").alias("q"), "word"), "q").join(freq.select(F.col("token").alias("word"), "n"), "word", "left")
    return rows.select("word", F.coalesce("n", F.lit(0)).alias("n"), F.col("score").alias("sim"), (F.coalesce("n", F.lit(0)) * (1 - F.col("score"))).alias("value")).orderBy(F.desc("value"), "word").limit(top)


def isolation(nn: DataFrame, k: int = 10, top: int = 50) -> DataFrame:
    """Lens 3: rows farthest from their k-th neighbour, ties by row, with their five nearest."""
    # in one aggregation, so that the neighbour table is worked out once
    five = F.array_sort(F.collect_list(F.when(F.col("rnk") <= 5, F.struct("rnk", "c"))))
    rows = nn.groupBy(F.col("q").alias("vec")).agg(F.max(F.when(F.col("rnk") == k, 1 - F.col("score"))).alias("dist"), F.transform(five, lambda x: x["c"]).alias("nearest"))
    return rows.where("dist IS NOT NULL").orderBy(F.desc("dist"), "vec").limit(top)


def isolation_histogram(nn: DataFrame, k: int = 10) -> DataFrame:
    return similarity_histogram(kth_distance(nn, k), "dist", 0.0, 2.0, 20)


def divergence(nn_a: DataFrame, nn_b: DataFrame, top: int | None = 50) -> DataFrame:
    """Lens 4: Jaccard distance of a row's neighbour sets in two spaces."""
    a = nn_a.groupBy("q").agg(F.collect_set("c").alias("a"))
    b = nn_b.groupBy("q").agg(F.collect_set("c").alias("b"))
    rows = a.join(b, "q").select(F.col("q").alias("vec"), V.jaccard_distance(F.col("a"), F.col("b")).alias("dist")).orderBy(F.desc("dist"), "vec")
    return rows if top is None else rows.limit(top)


def doppelgangers(space: DataFrame, least: float = 0.95, top: int = 50) -> DataFrame:
    """Lens 5: the most similar pairs from ``least`` on."""
    return similar_pairs(space, least, top=top).orderBy(F.desc("sim"), "a", "b").limit(top)


def doppelganger_histogram(pairs: DataFrame) -> DataFrame:
    return similarity_histogram(pairs, "sim", 0.85, 1.0, 15)


def bridges(space: DataFrame, centroids: DataFrame, top: int | None = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Lens 6: rows between clusters, by nearest over second-nearest centroid distance (1 if the second is 0). ``centroids`` is (cluster, mean), a few dozen."""
    c = centroids.select(F.col("cluster"), V.doubles(F.col("mean")).alias("m"))
    rows = space.select(F.col(id_col).alias("vec"), V.unit(V.doubles(F.col(vec_col))).alias("v")).join(few(c, "centroids"))
    dist = F.sqrt(F.aggregate(F.zip_with("v", "m", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = rows.groupBy("vec").agg(F.slice(F.array_sort(F.collect_list(F.struct(dist.alias("d"), F.col("cluster").alias("k")))), 1, 2).alias("near"))
    first, second = F.col("near")[0], F.get("near", F.lit(1))
    value = F.when(second["d"] <= 0, 1.0).otherwise(first["d"] / F.when(second["d"] > 0, second["d"]))
    out = near.select("vec", first["k"].alias("cluster"), second["k"].alias("second"), value.alias("value")).orderBy(F.desc("value"), "vec")
    return out if top is None else out.limit(top)


def kmeans_centroids(space: DataFrame, k: int = 40, seed: int = 42, restarts: int = 10, vec_col: str = "embedding") -> DataFrame:
    """(cluster, mean) of the best of several seeded k-means runs on unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = space.select(array_to_vector(V.unit(V.doubles(F.col(vec_col)))).alias("features")).cache()
    try:
        models = [KMeans(k=k, seed=seed + i).fit(rows) for i in range(restarts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        rows.unpersist()
    return space.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(best.clusterCenters())], "cluster int, mean array<double>")


def run_atlas(source: DataFrame, target: DataFrame, other: DataFrame | None, anchors: DataFrame, freq: DataFrame, k: int = 10, clusters: int = 40) -> dict[str, DataFrame]:
    """All lenses; the neighbour table is made once and read by lenses 3 and 4. Lens 4 needs a second space."""
    from ..runtime import written

    as_vectors = lambda s: s.select(F.col("row_idx").alias("vec_id"), F.col("vec").alias("embedding"))
    nn = written(neighbour_table(as_vectors(source), k), "nn")
    out = {
        "lens1": english_displacement(anchors, source, target),
        "lens1_filtered": english_displacement(anchors, source, target, keep=lens1_filter()),
        "lens2": no_counterpart(source, target, anchors, freq),
        "lens3": isolation(nn, k),
        "lens3_histogram": isolation_histogram(nn, k),
        "lens5": doppelgangers(as_vectors(source)),
        "lens6": bridges(as_vectors(source), kmeans_centroids(as_vectors(source), clusters)),
    }
    if other is not None:
        out["lens4"] = divergence(nn, neighbour_table(as_vectors(other), k))
    return out
