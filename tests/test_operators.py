import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import anchors as A, atlas, corpus as C, diagnostics as D, docs as DOC, evaluation as E, graph as G, linear as L, lookup, models, nearest as N, study as S
from tessera.streaming import ingest


def space(spark, m, word="w"):
    return spark.createDataFrame([(i, f"{word}{i}", [float(x) for x in v]) for i, v in enumerate(m)], "row_idx long, word string, vec array<double>")


def as_vectors(s):
    return s.select(F.col("row_idx").alias("vec_id"), F.col("vec").alias("embedding"))


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_csls_agrees_with_brute_force(spark):
    rng = np.random.default_rng(0)
    q, c, pool = unit(rng.normal(size=(7, 16))), unit(rng.normal(size=(40, 16))), unit(rng.normal(size=(25, 16)))
    r = np.sort(pool @ c.T, 0)[::-1][:10].mean(0)
    want = np.argsort(-(2 * q @ c.T - r), 1)[:, :3]
    got = N.csls_topk(as_vectors(space(spark, q)), as_vectors(space(spark, c)), as_vectors(space(spark, pool)), top=3).orderBy("q", "rnk").collect()
    assert [x["c"] for x in got] == want.ravel().tolist()


def test_topk_in_slices_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    s = as_vectors(space(spark, rng.normal(size=(60, 8))))
    rows = lambda: [(r["q"], r["c"], round(r["score"], 12), r["rnk"]) for r in N.neighbour_table(s, 5).orderBy("q", "rnk").collect()]
    whole = rows()
    monkeypatch.setattr(N, "SIDE_BYTES", 8 * 8 * 13)
    assert rows() == whole


def test_ridge_whitening_pca_procrustes(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(300, 6)), rng.normal(size=(6, 4))
    y = x @ w + 0.5
    rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>").repartition(3)
    g = L.gram(rows)
    assert np.allclose(g.xx, x.T @ x) and np.allclose(g.yy, y.T @ y)
    xc, yc = x - x.mean(0), y - y.mean(0)
    for alpha, (coef, b) in L.ridge_path(g, (1e-4, 1.0)).items():
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(6), xc.T @ yc)
        assert np.allclose(coef.T, want) and np.allclose(b, y.mean(0) - x.mean(0) @ want)
    mean, t = L.whitening(g)
    z = (x - mean) @ t
    assert np.allclose(np.cov(z.T), np.eye(6), atol=1e-8)
    m, comp, var = L.pca(g, 2)
    assert np.allclose(comp @ comp.T, np.eye(2)) and var[0] >= var[1]
    o = L.semi_orthogonal(g)
    assert np.allclose(o.T @ o, np.eye(4), atol=1e-8)
    out = L.project(rows, "x", w, 0.5).select("projected", "y").collect()
    assert np.allclose([r["projected"] for r in out], [r["y"] for r in out])


def test_select_alpha_takes_the_lowest_on_the_plateau():
    assert L.select_alpha({1e-4: 50.0, 1.0: 50.9, 10.0: 51.0, 100.0: 40.0}, 100) == 1e-4
    assert L.select_alpha({1e-4: 10.0, 1.0: 51.0}, 100) == 1.0
    assert L.select_variant({"stable": 0.5, "full": 0.5}) == "full"


def test_split_does_not_leak(spark):
    rows, k = [], 0
    for g in range(120):
        for _ in range((1, 1, 1, 2, 2, 3, 5, 8)[g % 8]):
            rows.append((k, f"s{k}", f"e{k % 17}", [f"l{g}"]))
            k += 1
    a = spark.createDataFrame(rows, "ord long, surface string, english string, lemmas array<string>")
    out = G.group_split(G.anchor_groups(a, near_surfaces=False))
    got = out.collect()
    assert len(got) == len(rows)
    part = {}
    for r in got:
        assert part.setdefault(r["lemmas"][0], r["part"]) == r["part"]
    share = {p: sum(r["part"] == p for r in got) / len(got) for p in ("train", "val", "test")}
    assert abs(share["test"] - 0.2) < 0.05 and abs(share["val"] - 0.16) < 0.05
    assert sorted(map(str, out.collect())) == sorted(map(str, got))
    with pytest.raises(ValueError):
        G.anchor_groups(a, fallback="other")


def test_near_surfaces_join_groups(spark):
    a = spark.createDataFrame([(0, "kattan", "down", []), (1, "katta", "down", []), (2, "abc", "x", []), (3, "abd", "y", [])], "ord long, surface string, english string, lemmas array<string>")
    got = {r["surface"]: r["grp"] for r in G.anchor_groups(a).collect()}
    assert got["kattan"] == got["katta"] and got["abc"] != got["abd"]


def test_near_surface_pairs_are_all_pairs_within_one_edit(spark):
    import random

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(60)})

    def one(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    df = spark.createDataFrame([("g", w) for w in words], "english string, surface string")
    got = {(r["a"], r["b"]) for r in G.near_surface_pairs(df).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one(a, b)}


def test_dedupe_keeps_null_keys_and_first_of_ties(spark):
    df = spark.createDataFrame([("P1", ["a"], 0), ("P1", ["a", "b"], 1), ("P1", ["c", "d"], 2), (None, ["x"], 3), ("", ["y"], 4)], "p_number string, lines array<string>, ord int")
    out = C.deduplicate_records(df)
    assert sorted(r["ord"] for r in out.collect()) == [1, 3, 4]
    assert C.dedup_stats(df, out).first().asDict() == {"total_input": 5, "with_key": 3, "without_key": 2, "unique_output": 3, "duplicates_removed": 2}


def test_merge_and_gate(spark):
    a = spark.createDataFrame([("s", "x", 0.5, 3)], "surface string, english string, confidence double, frequency long")
    b = spark.createDataFrame([("s", "y", 0.5, 9), ("t", "z", 0.6, 1)], a.schema)
    assert [(r["surface"], r["english"]) for r in A.merge_anchors([a, b]).collect()] == [("t", "z"), ("s", "x")]
    j = spark.createDataFrame([(i < 3,) for i in range(10)], "hit boolean")
    with pytest.raises(A.GateError):
        A.hit_rate_gate(A.hit_rate(j))
    assert A.hit_rate_gate(A.hit_rate(j), 0.3)["hits"] == 3


def test_bridges(spark):
    pairs = spark.createDataFrame([(0, "lugal", "szarrum"), (1, "lugal", "szarrum"), (2, "e2", "bitum")], "ord int, sumerian_cf string, surface string")
    near = spark.createDataFrame([("lugal", "king", 0.8), ("e2", "house", 0.4)], "word string, english string, cosine double")
    got = A.bridge_anchors(pairs, near).collect()
    assert [(r["surface"], r["english"], r["confidence"]) for r in got] == [("szarrum", "king", 0.8)]
    counts = spark.createDataFrame([("sumerogram", "LUGAL", 9), ("akkadogram", "ŠAR", 7), ("sumerogram", "X", 2)], "kind string, sign string, n long")
    v = spark.createDataFrame([("lugal",), ("szar",)], "word string")
    assert {(r["sign"], r["word"]) for r in A.heterogram_bridge(counts, v).collect()} == {("LUGAL", "lugal"), ("ŠAR", "szar")}


def test_study(spark):
    m = np.eye(5) + np.arange(25).reshape(5, 5) / 50
    m = (m + m.T) / 2
    got = S.rsa_permutation(m, m)
    assert got["rho"] == 1 and got["n_perms"] == 120 and got["p"] <= 2 / 120 + 1e-4
    assert np.isnan(S.spearman([1, 1, 1], [1, 2, 3]))
    null = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4)], "x double")
    assert [S.midrank_percentile(null, "x", o).first()[0] for o in (0.5, 0.0, 0.25, 0.2)] == [100, 0, 50, 37.5]
    assert S.mean_reciprocal_rank(spark.createDataFrame([(1,), (2,), (4,)], "rnk int")).first()[0] == round((1 + 0.5 + 0.25) / 3, 4)
    assert [S.verdict(x) for x in (95, 80, 10)] == ["supports", "inconclusive", "fails"]


def test_loo_on_separable_classes(spark):
    rng = np.random.default_rng(5)
    m = np.concatenate([rng.normal(size=(10, 4)) * 0.1 + [1, 0, 0, 0], rng.normal(size=(10, 4)) * 0.1 + [0, 1, 0, 0], [[0, 0, 1, 0]]])
    df = spark.createDataFrame([(i, int(i >= 10) + int(i == 20), v.tolist()) for i, v in enumerate(m)], "doc long, label int, vec array<double>")
    got = DOC.loo_nearest_centroid(df, "label", "vec", "doc").collect()
    assert len(got) == 20 and all(r["label"] == r["predicted"] for r in got)


def test_lenses(spark):
    m = np.array([[1, 0.01], [1, 0.02], [1, 0.03], [1, 0.04], [-1, 0]])
    nn = N.neighbour_table(as_vectors(space(spark, m)), 3)
    top = atlas.isolation(nn, 1).first()
    assert top["vec"] == 4 and top["dist"] > 1
    twins = as_vectors(space(spark, [[1, 0], [1, 0], [0.9, np.sqrt(1 - 0.81)]]))
    assert atlas.doppelgangers(twins).count() == 1 and N.similar_pairs(twins, 0.85).count() == 3
    assert {r["dist"] for r in atlas.divergence(nn, nn, None).collect()} == {0.0}
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster int, mean array<double>")
    mid = atlas.bridges(as_vectors(space(spark, [[1, 0.05], [0.05, 1], [1, 1]])), c).first()
    assert mid["vec"] == 2 and abs(mid["value"] - 1) < 1e-9


def test_lookup(spark):
    rng = np.random.default_rng(6)
    e = unit(rng.normal(size=(5, 8)))
    k = lookup.Lookup({"gemma": space(spark, e[:3] + 1e-4, "sum_"), "glove": space(spark, e[:3], "sum_")}, {"gemma": space(spark, e, "Word_"), "glove": space(spark, e, "word_")})
    word, sim = k.find("word_0", 1)[0]
    assert word == "sum_0" and sim > 0.99
    assert k.find("missing") == [] and k.find_blend({"missing": 1.0}) == [] and k.find_analogy("word_0", "missing", "word_1") == []
    assert k.find_analogy("word_0", "word_0", "word_1", 1)[0][0] == "sum_1"
    assert set(k.find_both("word_2", 1)) == {"gemma", "glove"}
    assert "sum_0" not in [w for w, _ in k.neighbours("sum_0", 5)]
    assert k.reverse_query(["nope"]) == {"nope": {"error": "unknown seed"}}
    with pytest.raises(ValueError):
        k.find("word_0", space="other")
    with pytest.raises(KeyError):
        lookup.find_displacement(k, "sum_0", "nope")


def test_suite(spark):
    rng = np.random.default_rng(7)
    c = unit(rng.normal(size=(30, 6)))
    cand = space(spark, c)
    q = spark.createDataFrame([(i, i, f"w{i}", [float(x) for x in c[i]]) for i in range(12)] + [(12, 12, "oov", [1.0] * 6)], "q_id long, ord long, gold string, vec array<double>")
    r = E.score_regime(q, cand, q).first()
    assert (r["n"], r["oov"], r["exact_top1"]) == (12, 1, 100.0)
    none = E.score_regime(q.where("q_id = 12"), cand, q).first()
    assert (none["n"], none["oov"], none["exact_top1"]) == (0, 1, 0.0)
    suite = {r["regime"]: r for r in E.score_suite(q.where("q_id < 4"), q.where("q_id BETWEEN 4 AND 6"), q.where("q_id > 6"), cand).collect()}
    assert set(suite) == {"dictionary", "interpolation", "zero_shot", "combined"} and suite["combined"]["oov"] == 1


def test_bundle(spark, tmp_path):
    q = spark.createDataFrame([("test", 1, [1.0])], "split string, q_id long, vec array<double>")
    E.save_bundle(q, {"seed": 42}, str(tmp_path / "b"))
    back, config = E.load_bundle(spark, str(tmp_path / "b"))
    assert back.count() == 1 and config == {"seed": 42}


def test_miss_buckets(spark):
    w = lambda *x: spark.createDataFrame([(v,) for v in x], "word string")
    misses = spark.createDataFrame([("Šeš",), ("rare",), ("cf",), ("a-b",), ("longword",), ("LUGAL",), ("zzz",)], "surface string")
    vocabulary = w("szesz", "formsurface", "a", "b")
    freq = spark.createDataFrame([("rare", 3)], "token string, n long")
    lemmas = spark.createDataFrame([("cf", "formsurface")], "cf string, surface string")
    grams = spark.createDataFrame([(g,) for g in ("<lo", "lon", "ong", "ngw", "gwo", "wor", "ord", "rd>", "<lon", "long", "ongw", "ngwo", "gwor", "word", "ord>", "<long", "longw")], "gram string")
    got = {r["surface"]: r["bucket"] for r in D.classify_misses(misses, vocabulary, freq, lemmas, grams).collect()}
    assert got == {"Šeš": D.MISS_BUCKETS[0], "rare": D.MISS_BUCKETS[1], "cf": D.MISS_BUCKETS[2], "a-b": D.MISS_BUCKETS[3], "longword": D.MISS_BUCKETS[4], "LUGAL": D.MISS_BUCKETS[5], "zzz": D.MISS_BUCKETS[6]}


def test_claims(spark):
    text = spark.createDataFrame([("cos 0.8838 and 0.5000 and -0.0877",)], "text string")
    figures = spark.createDataFrame([(0.8839,), (-0.0877,)], "value double")
    assert [r["claim"] for r in D.unsupported_claims(text, figures).collect()] == [0.5]


def test_subword_vectors(spark):
    s = space(spark, [[1, 0], [0, 1]]).withColumn("word", F.when(F.col("row_idx") == 0, "lugal").otherwise("mu"))
    got = models.subword_vectors(spark.createDataFrame([("lugale",)], "word string"), models.ngram_vectors(s)).first()
    assert got["vec"][0] > 0.99


def test_stream_upsert(spark, tmp_path):
    path = str(tmp_path / "state")
    a = spark.createDataFrame([("k", ["a"]), ("m", ["x"])], "key string, lines array<string>")
    ingest.upsert_best(a, path, "key", F.size("lines"))
    ingest.upsert_best(spark.createDataFrame([("k", ["a", "b"]), ("m", ["y"])], a.schema), path, "key", F.size("lines"))
    assert {r["key"]: r["lines"] for r in spark.read.parquet(f"{path}/v1").collect()} == {"k": ["a", "b"], "m": ["x"]}


def test_windowed_stream(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = ingest.windowed_counts(e, "ts", "event_type")
    assert out.agg(F.sum("n")).first()[0] == e.count()
