"""Ranks within groups and document centroids, for groups and tables larger than a task."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import docs as DOC, study as S


def test_ranks_in_a_group_are_numbered_part_by_part(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(rng.integers(0, 9)), float(rng.normal())) for g in ("a", "b", None) for _ in range(400)]
    rows += [("c", 1.0, float(i)) for i in range(5)] + [("d", float("nan"), 1.0), ("d", 2.0, 0.0), ("d", None, -1.0), ("d", -0.0, -0.5), ("d", 0.0, -0.5)]
    df = spark.createDataFrame(rows, "flag string, x double, y double").repartition(3)
    ranked = S.average_rank(df, "x", ["flag"], "r")
    assert "windowspecdefinition(flag" not in ranked._jdf.queryExecution().analyzed().toString()
    got = ranked.collect()
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        mine = [r for r in got if r["flag"] == g]
        assert [r["r"] for r in mine] == S.ranks([r["x"] for r in mine]).tolist()
    assert sorted(r["r"] for r in got if r["flag"] == "d") == [1.0, 2.5, 2.5, 4.0, 5.0]
    rho = {r["flag"]: r["rho"] for r in S.spearman_by(df, "x", "y", ["flag"]).collect()}
    assert rho["c"] is None and math.isclose(rho["d"], 1.0)
    for g in ("a", "b", None):
        mine = [(x, y) for k, x, y in rows if k == g]
        assert math.isclose(rho[g], S.spearman(*zip(*mine)), abs_tol=1e-12)


def test_centroids_of_blocks_of_documents(spark, monkeypatch):
    monkeypatch.setattr(DOC, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(1)
    vecs = [(f"w{i % 50}", rng.normal(size=3).tolist()) for i in range(60)] + [("w1", None), (None, [9.0, 9.0, 9.0])]  # ten words twice
    docs = [(i if i else None, [f"w{j}" for j in rng.integers(0, 70, size=i % 7)] + [None]) for i in range(150)]
    weights = [(f"w{i}", 1 / (1 + i)) for i in range(0, 70, 2)]
    space = spark.createDataFrame(vecs, "word string, vec array<float>")
    held = {w: [np.array(v, np.float32).astype(float) for x, v in vecs if x == w and v] for w in {f"w{i}" for i in range(50)}}
    d = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    for table in (None, spark.createDataFrame(weights, "token string, w double")):
        w = dict(weights) if table is not None else {}
        want = {}
        for doc, tokens in docs:
            terms = [(w.get(t, 1.0), v) for t in tokens for v in held.get(t, [])]
            if terms:
                want[doc] = sum(k * v for k, v in terms) / sum(k for k, _ in terms)
        out = DOC.doc_centroids(d, F.col("tokens"), space, table)
        # no row per dimension
        assert "explode(vec" not in out._jdf.queryExecution().analyzed().toString()
        got = {r["doc_id"]: r["mean"] for r in out.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
