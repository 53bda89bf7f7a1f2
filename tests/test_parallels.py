"""Ranks of known parallels against brute force, with more pairs than fit a broadcast."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import docs as DOC


def test_parallels_of_many_pairs_with_equal_zero_and_null_vectors(spark):
    rng = np.random.default_rng(0)
    right = np.round(rng.normal(size=(40, 3)), 1)
    right[20:30] = right[:10]  # equal ones don't outrank each other
    right[30] = 0
    rows = [("right", i, v.tolist()) for i, v in enumerate(right)] + [("right", 40, None)]
    left = rng.normal(size=(4, 3))
    left[3] = 0
    rows += [("left", i, v.tolist()) for i, v in enumerate(left)]
    centroids = spark.createDataFrame(rows, "side string, doc_id long, mean array<double>")
    pairs = spark.range(10_100).select(F.col("id").alias("pair"), (F.col("id") % 4).alias("left_id"), (F.col("id") % 42).alias("right_id"))
    size = np.linalg.norm(right, axis=1)
    cos = left @ right.T / np.where(size > 0, size, 1)
    want = {}
    for p in range(10_100):
        a, b = p % 4, p % 42
        if b < 41:  # others have no target
            ranked = a < 3 and b < 40 and size[b] > 0
            want[p] = 1 + int(((cos[a] > cos[a, b] + 1e-12) & (size > 0)).sum()) if ranked else 1
    got = DOC.parallels(centroids, pairs).collect()
    assert {r["pair"]: r["rnk"] for r in got} == want and {r["pool"] for r in got} == {41}


def test_documents_may_have_names(spark):
    rows = [("right", "a", [1.0, 0.0]), ("right", "b", [0.0, 1.0]), ("right", None, [1.0, 0.1]), ("left", "x", [1.0, 0.2])]
    centroids = spark.createDataFrame(rows, "side string, doc_id string, mean array<double>")
    pairs = spark.createDataFrame([("p", "x", "a")], "pair string, left_id string, right_id string")
    assert [tuple(r) for r in DOC.parallels(centroids, pairs).collect()] == [("p", 2, 3)]
