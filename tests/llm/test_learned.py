"""Language and quality: held-out accuracy, the machine's identity, and the rule on inputs."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid, quality
from tessera.llm.learn import bounded_sample

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.98 and 0 <= r[1] <= r[2] <= 1


def test_language_edge_cases(spark):
    rows = [(i, f"the words of this language are these {i}", "en") for i in range(40)] + [(100 + i, f"les mots de cette langue sont ceux-ci {i}", "fr") for i in range(40)] + [(900, None, "en"), (901, "", "fr"), (902, "123 !!", None), (None, "the words of this", None), (1, "the words", "en")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[None]["lang_pred"] == "en"
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    # the label of a row to be predicted is no input
    swapped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "xx").otherwise(F.col("lang")))
    assert sorted(map(str, langid.identify(swapped).collect())) == sorted(map(str, got))


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 12, 40):
        c = langid.codewords(k)
        d = (c.shape[1] - c @ c.T) / 2 + np.eye(k) * 99
        assert d.min() >= (1 if k == 2 else 2)


def test_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(300, quality.WORDS + quality.STATS))).astype(np.float32)
    x[:, : quality.WORDS] /= np.linalg.norm(x[:, : quality.WORDS], axis=1, keepdims=True)
    m = quality.Machine(x, (x[:, -1] > x[:, -2]).astype(np.float32), epochs=2)
    z = m.scaled(x[:5])
    for row, got in zip(z.astype(float), m.raw(z)):
        g = np.outer(row, row) * (m.v.astype(float) @ m.v.T.astype(float))
        assert abs(m.w0[0] + row @ m.w + (g.sum() - np.trace(g)) / 2 - got) < 1e-3


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.95 and 0 <= r[1] <= r[2] <= 1
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(i, "good prose reads on and on." if i % 2 else "BAD!! BAD!!", 7) for i in range(60)] + [(900, None, 7), (901, "", 7), (None, "x", 7), (3, "good prose", 7)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 64 and all(r["score"] is not None and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[900]["score"] == by[901]["score"]
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_samples_are_bounded(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 100 == 0).cast("int").alias("y"))
    hot = spark.range(15_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit(1).alias("y"))
    got = bounded_sample(rows.unionByName(hot), "y", 400).collect()
    n = {y: len({r["doc_id"] for r in got if r["y"] == y}) for y in (0, 1)}
    assert n[0] == 200 and 1 <= n[1] <= 200 and len(got) == sum(n.values())
    many = rows.select("doc_id", F.col("doc_id").alias("y"))
    assert bounded_sample(many, "y", 50).count() <= 50


def test_every_language_is_that_of_the_nearest_codeword(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    names, (code, w, weight) = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.op6_langid(spark, d).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        x = langid.features(r["text"])
        if x is None:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        bits = [float(x @ w[:-1, b] + w[-1, b]) for b in range(code.shape[1])]
        loss = {n: sum(np.log1p(np.exp(-f * c)) * v for f, c, v in zip(bits, word, weight)) for n, word in zip(names, code)}
        assert loss[got[r["doc_id"]]["lang_pred"]] <= min(loss.values()) + 1e-4


def test_every_quality_score_is_that_of_all_pairs(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.op8_quality(spark, d).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        z = m.scaled(quality.features(r["text"])[None])[0].astype(float)
        at = np.flatnonzero(z)
        g = (m.v[at].astype(float) @ m.v[at].T.astype(float)) * np.outer(z[at], z[at])
        raw = m.w0[0] + z @ m.w + np.triu(g, 1).sum()
        assert abs(1 / (1 + np.exp(-raw)) - got[r["doc_id"]]["score"]) < 1e-3
        assert got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.3)
