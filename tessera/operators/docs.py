"""Document vectors: SIF weights, centroids, leave-one-out classification, parallels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import vectors as V
from ..runtime import few, ship, written
from .nearest import above_limit, mean_vector
from .study import mean_reciprocal_rank


def sif_weights(freq: DataFrame, a: float = 1e-3) -> DataFrame:
    """(token, n, w): a / (a + share). The total is one row, joined in rather than a window over all tokens."""
    return freq.join(F.broadcast(freq.agg(F.sum("n").alias("total")))).select("token", "n", (a / (a + F.col("n") / F.col("total"))).alias("w"))


#: Rows of document and token that a task adds up.
BLOCK_ROWS = 400_000


def doc_centroids(docs: DataFrame, tokens: Column, space: DataFrame, weights: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """(doc, mean): weighted mean vector of a document's known token occurrences; documents without any are left out.

    Occurrences are counted first. Documents are then dealt to blocks, each of which gets a token's vector once, however many of its documents have
    the token, and adds up its documents by itself.
    """
    spark = docs.sparkSession
    ship(spark)
    t = docs.select(doc, F.explode(tokens).alias("token")).groupBy(doc, "token").agg(F.count(F.lit(1)).alias("n")).where("token IS NOT NULL")
    if weights is not None:
        t = t.join(weights.select("token", "w"), "token", "left")
    t = t.select(F.col(doc).alias("doc"), "token", (F.col("n") * (F.coalesce("w", F.lit(1.0)) if weights is not None else F.lit(1.0))).alias("weight"))
    t = written(t, "occurrences")
    rows = t.count()
    blocks = max(-(-rows // BLOCK_ROWS), min(spark.sparkContext.defaultParallelism, -(-rows // 10_000)), 1)
    t = t.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int"))
    words = space.where("vec IS NOT NULL AND size(vec) > 0").select("word", "vec")
    held = t.select(F.col("block").alias("slot"), F.col("token").alias("word")).distinct().join(words, "word")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.schema.field("doc").type
        if not len(left) or not len(right):
            return pa.table({"doc": pa.array([], kind), "mean": pa.array([], pa.list_(pa.float64()))})
        vec = right["vec"].combine_chunks()
        width = pc.unique(pc.list_value_length(vec)).to_pylist()
        if len(width) > 1:
            raise ValueError(f"vectors of different lengths: {width[:5]}")
        m = pc.fill_null(vec.flatten(), 0).to_numpy(zero_copy_only=False).reshape(len(right), -1)
        known = right["word"].combine_chunks().dictionary_encode()
        which, n = known.indices.to_numpy(), len(known.dictionary)
        at = pc.index_in(left["token"], known.dictionary).combine_chunks()
        left, at = left.filter(at.is_valid()), at.drop_null().to_numpy()
        docs = left["doc"].combine_chunks().dictionary_encode(null_encoding="encode")
        doc, size, w = docs.indices.to_numpy(), len(docs.dictionary), left["weight"].to_numpy()
        # a word that the space has several times counts as often
        total = np.bincount(doc, w * np.bincount(which, minlength=n)[at], size)
        mean = np.empty((size, m.shape[1]))
        for k in range(m.shape[1]):
            mean[:, k] = np.bincount(doc, w * np.bincount(which, m[:, k], n)[at], size) / total
        return pa.table({"doc": docs.dictionary, "mean": pa.FixedSizeListArray.from_arrays(pa.array(mean.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))})

    schema = StructType([StructField("doc", t.schema["doc"].dataType), StructField("mean", ArrayType(DoubleType()))])
    return t.groupBy("block").cogroup(held.groupBy("slot")).applyInArrow(add, schema).withColumnRenamed("doc", doc)


def loo_nearest_centroid(df: DataFrame, label: str, vec: str, doc: str) -> DataFrame:
    """(doc, label, predicted): each row's nearest class mean by cosine, its own class without it; rows alone in their class are left out.

    Ties go to the lower label. Class sums are as many as there are classes.
    """
    rows = df.select(F.col(doc).alias("doc"), F.col(label).alias("label"), V.doubles(F.col(vec)).alias("v"))
    long = rows.select("label", F.posexplode("v").alias("dim", "x")).groupBy("label", "dim").agg(F.sum("x").alias("s"))
    sums = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda z: z["s"]).alias("s"))
    classes = sums.join(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").select(F.col("label").alias("cls"), "s", "n")
    scored = rows.join(few(classes, "classes"))
    own = F.col("label") == F.col("cls")
    mean = F.when(own, V.minus(F.col("s"), F.col("v"))).otherwise(F.col("s"))
    scored = scored.where(~(own & (F.col("n") == 1))).withColumn("sim", V.cosine(F.col("v"), mean))
    single = classes.where("n = 1").select(F.col("cls").alias("label"))
    best = scored.join(F.broadcast(single), "label", "left_anti").groupBy("doc", "label").agg(F.max(F.struct(F.coalesce(F.round("sim", 12), F.lit(-2.0)).alias("sim"), (-F.col("cls")).alias("neg"))).alias("best"))
    return best.select("doc", "label", (-F.col("best.neg")).alias("predicted"))


def accuracy(rows: DataFrame, hit: Column) -> DataFrame:
    return rows.agg((100 * F.avg(hit.cast("double"))).alias("accuracy"))


def majority_share(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).count().agg((100 * F.max("count") / F.sum("count")).alias("majority"))


def profile_without_self(members: DataFrame, doc: str, group: str, vec: str) -> DataFrame:
    """(doc, group, profile): the mean of the group's other members; rows alone in their group are left out."""
    m = members.select(F.col(doc).alias("doc"), F.col(group).alias("grp"), F.posexplode(V.doubles(F.col(vec))).alias("dim", "x"))
    sums = m.groupBy("grp", "dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    out = m.join(sums, ["grp", "dim"]).where("n > 1").withColumn("p", (F.col("s") - F.col("x")) / (F.col("n") - 1))
    return out.groupBy("doc", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "p"))), lambda z: z["p"]).alias("profile"))


def parallels(centroids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, rnk, pool): where the right document of each known pair stands among all right-hand ones by cosine to the left one.

    ``centroids`` is (side, doc_id, mean); ``pairs`` is (pair, left_id, right_id). Vectors that are null or zero are in the pool and rank nowhere.
    """
    right = centroids.where("side = 'right'").select("doc_id", "mean")
    left = pairs.join(centroids.where("side = 'left'"), F.col("left_id") == F.col("doc_id")).select("pair", "right_id", F.col("mean").alias("lv"))
    aims = left.join(right.withColumnRenamed("mean", "rv"), F.col("right_id") == F.col("doc_id"))
    lv, rv = V.doubles(F.col("lv")), V.doubles(F.col("rv"))
    aims = aims.select("pair", F.when((V.norm(lv) > 0) & (V.norm(rv) > 0), V.dot(V.unit(lv), V.unit(rv))).alias("t"))
    # a pair that is listed several times is measured against each of its targets
    aims = written(left.select("pair", F.col("lv").alias("mean")).join(aims, "pair").withColumn("doc_id", F.monotonically_increasing_id()), "aims")
    pool = right.where("mean IS NOT NULL").select(F.monotonically_increasing_id().alias("doc_id"), "mean")
    above = above_limit(aims.where("t IS NOT NULL"), pool, "t", "doc_id", "mean")
    ranked = aims.join(above.withColumnRenamed("q", "doc_id"), "doc_id", "left").join(F.broadcast(right.agg(F.count(F.lit(1)).alias("all"))))
    return ranked.groupBy("pair").agg((1 + F.sum(F.coalesce("n", F.lit(0)))).alias("rnk"), F.sum("all").alias("pool"))


def parallels_mrr(ranked: DataFrame) -> DataFrame:
    return mean_reciprocal_rank(ranked)


def compositions(lines: DataFrame, genre: Column, tokens: Column) -> DataFrame:
    """(comp, genre, tokens): the tokens of a composition's lines in order."""
    rows = lines.select(F.substring_index("line_id", ".", 1).alias("comp"), "ord", genre.alias("genre"), tokens.alias("t"))
    return rows.groupBy("comp", "genre").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"])).alias("tokens"))


def fingerprints(docs: DataFrame, concepts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, concept, value): cosine of each document with each of a short list of concepts, to four places."""
    c = concepts.select("concept", F.col("vec").alias("cv"))
    return docs.join(few(c, "concepts")).select(doc, "concept", F.round(V.cosine(V.doubles(F.col("mean")), V.doubles(F.col("cv"))), 4).alias("value"))


def axis_projection(space: DataFrame, low: list[str], high: list[str]) -> DataFrame:
    """(word, value): each unit vector on the axis from one pole's mean to the other's."""
    poles = space.select("word", V.unit(V.doubles(F.col("vec"))).alias("u")).withColumn("pole", F.when(F.col("word").isin(low), "low").when(F.col("word").isin(high), "high"))
    means = mean_vector(poles.where("pole IS NOT NULL"), ["pole"], "u").select("pole", V.unit(F.col("mean")).alias("m"))
    axis = means.agg(F.max(F.when(F.col("pole") == "low", F.col("m"))).alias("lo"), F.max(F.when(F.col("pole") == "high", F.col("m"))).alias("hi")).select(V.minus(F.col("hi"), F.col("lo")).alias("axis"))
    return poles.join(F.broadcast(axis)).select("word", V.dot(F.col("u"), F.col("axis")).alias("value"))


def cluster_members(df: DataFrame, cluster: str, order: str, word: str, n: int = 5) -> DataFrame:
    """Each cluster's first n members."""
    w = W.partitionBy(cluster).orderBy(order)
    return df.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= n).groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("rnk", word))), lambda x: x[word]).alias("members"))
