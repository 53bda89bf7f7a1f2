import numpy as np
from pyspark.sql import functions as F

from tessera.operators import report
from tessera.plans import pipelines as P
from tessera.slots import SLOTS


def test_corpus_to_alignment(spark):
    texts = spark.createDataFrame([("P1", ["lugal e2#", "[mu] {d}en"], 0), ("P1", ["lugal"], 1), (None, ["$ lost"], 2), (None, ["ud-ba"], 3)], "p_number string, lines array<string>, ord int")
    got = {r["ord"]: r["tokens"] for r in P.clean_corpus(texts, SLOTS["sumerian"]).collect()}
    assert got == {0: ["lugal", "e2", "mu", "d", "en"], 3: ["udba", "ud", "ba"]}

    rng = np.random.default_rng(0)
    n, w = 120, rng.normal(size=(8, 8))
    x = rng.normal(size=(n, 8))
    lemmas = spark.createDataFrame([(f"s{i}x", f"s{i}x", f"word{i}", "N") for i in range(n) for _ in range(6)], "form string, cf string, gw string, pos string")
    anchors = P.build_anchors(lemmas, SLOTS["sumerian"]).withColumn("ord", F.xxhash64("surface"))
    assert anchors.count() == n and anchors.first()["confidence"] == 0.56
    space = lambda m, f: spark.createDataFrame([(i, f(i), [float(v) for v in m[i]]) for i in range(n)], "row_idx long, word string, vec array<double>")
    source, target = space(x, lambda i: f"s{i}x"), space(x @ w, lambda i: f"word{i}")
    got = P.align(anchors, source, target, SLOTS["sumerian"], alphas=(1e-4, 1e4))
    assert got["alpha"] == 1e-4
    suite = {r["regime"]: r for r in got["suite"].collect()}
    assert suite["combined"]["exact_top1"] > 95 and suite["combined"]["oov"] == 0

    out = P.audit(anchors, source.where("row_idx % 2 = 0"), target, target, SLOTS["sumerian"])
    counts = {r["bucket"]: r["n"] for r in out["buckets"].collect()}
    assert counts["vocab_miss"] == n // 2 and counts["survives"] == n // 2 and sum(counts.values()) == n
    docs = spark.createDataFrame([(1, ["s1x", "s1x"])], "doc_id int, tokens array<string>")
    diag = P.coverage_diagnostic(anchors, out["rows"], source.where("row_idx % 2 = 0"), docs, lemmas, SLOTS["sumerian"])
    assert sum(r["n"] for r in diag["buckets"].collect()) == n // 2
    assert "| bucket |" in report.markdown_table(out["buckets"].orderBy("ord"), ["bucket", "n"])
    assert '"vocab_size": 120' in report.metadata({"a": source}, {})


def test_genres(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, "ab"[i % 2], [f"{'ab'[i % 2]}{rng.integers(5)}" for _ in range(6)]) for i in range(40)], "doc_id int, genre string, tokens array<string>")
    words = [f"{g}{i}" for g in "ab" for i in range(5)]
    space = spark.createDataFrame([(i, w, [float(w[0] == "a"), float(w[0] == "b"), 0.1 * rng.normal()]) for i, w in enumerate(words)], "row_idx int, word string, vec array<double>")
    r = P.genre_study(docs, {"toy": space}).first()
    assert r["accuracy"] == 100 and r["majority"] == 50 and r["n"] == 40


def test_every_slot_normalises(spark):
    df = spark.createDataFrame([("Ab-ba",)], "t string")
    got = {k: df.select(s.normalize(F.col("t")).alias("x")).first()["x"] for k, s in SLOTS.items()}
    assert got["sumerian"] == "abba" and got["sanskrit"] == "ab-ba" and set(got) == {"sumerian", "akkadian", "hittite", "greek", "egyptian", "sanskrit"}
