import hashlib
import re

import xxhash
from tessera.llm import syncmers as S


def h(*parts):
    """Spark's xxhash64 of strings: each hash is the seed of the next."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64(p.encode(), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def h_longs(*xs, last=8):
    """The same of numbers; the last one may have fewer bytes."""
    seed = 42
    for i, x in enumerate(xs):
        n = last if i == len(xs) - 1 else 8
        seed = xxhash.xxh64((x % (1 << 8 * n)).to_bytes(n, "little"), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def brute(text):
    ws = re.findall(r"[^\W_]+", text.lower())
    out = []
    if len(ws) >= S.K:
        inner = [h(ws[i], ws[i + 1]) for i in range(len(ws) - 1)]
        for i in range(len(ws) - S.K + 1):
            w = inner[i : i + S.K - S.S + 1]
            if min(w) in (w[0], w[-1]):
                out.append((h_longs(w[0], w[2], w[-1]), i))
    if not out:
        return {h(*ws)} if ws else {h(text)} if text else set()
    return {h_longs(a, b, j - i, last=4) for (a, i), (b, j) in zip(out, out[1:])} if len(out) > 1 else {out[0][0]}


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def hexed(xs, size=64):
    return "".join(f"{x % (1 << 64) >> 32:08x}" for x in sorted(xs)[:size]) + (f"{h_longs(*sorted(xs)) % (1 << 64):016x}" if xs else "")


def test_agrees_with_brute_force(spark):
    docs = [(i, " ".join(f"wörd{(i * 7 + j * j) % 90}" for j in range(n))) for i, n in enumerate((0, 1, 3, 5, 6, 7, 40, 200, 500, 41, 41))] + [(50, None), (51, "..."), (52, "漢字仮名交じり文を書く人")]
    docs[8] = (8, docs[7][1])
    df = spark.createDataFrame([(*d, 2) for d in docs], "doc_id long, text string, fingerprint int").repartition(3)
    got = {r["doc_id"]: r for r in S.fingerprints(df).collect()}
    order = sorted((i, t or "") for i, t in docs)
    for at, (i, t) in enumerate(order):
        nxt = order[(at + 1) % len(order)][1]
        m = len(t) // 2
        edited = t[: len(t) - m] + nxt[:m]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if i == 52:
            assert len(r["fingerprint"]) >= 8
            continue
        assert r["fingerprint"] == hexed(brute(t))
        if "漢" not in nxt:
            assert r["edited_fingerprint"] == hexed(brute(edited))
            assert abs(r["near_edited"] - like(brute(t), brute(edited))) < 1e-12 and abs(r["near_next"] - like(brute(t), brute(nxt))) < 1e-12
    assert got[7]["fingerprint"] == got[8]["fingerprint"] and got[7]["near_next"] == 1.0
    assert got[7]["near_edited"] > 0.9


def test_different_short_texts_are_unlike(spark):
    import random

    rng = random.Random(4)
    docs = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(50)}" for _ in range(rng.randint(1, 9)))) for i in range(120)]
    got = S.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    text = dict(docs)
    assert all(r["fingerprint"] for r in got) and len({r["fingerprint"] for r in got}) == len(set(text.values()))
    assert all(r["near_next"] < 1 for r in got if text[r["doc_id"]] != text[(r["doc_id"] + 1) % 120])


def test_all_anchors_of_long_texts_count(spark):
    # 30,000 words each that share one passage of 60
    shared = " ".join(f"s{i}" for i in range(60))
    a, b = (" ".join(f"{c}{i * i % 9973}x{i}" for i in range(15_000)) for c in "pq")
    docs = [(1, f"{a} {shared} {a}"), (2, f"{b} {shared} {b}"), (3, "x")]
    got = {r["doc_id"]: r for r in S.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = like(brute(docs[0][1]), brute(docs[1][1]))
    assert 0 < want < 0.01 and abs(got[1]["near_next"] - want) < 1e-12 and got[1]["n_anchors"] > 10_000


def test_no_python_in_the_plan(spark):
    df = S.fingerprints(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"))
    assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "x y z")], "doc_id long, text string")
    got = S.fingerprints(df).collect()
    assert len(got) == 3 and len({tuple(r) for r in got if r["doc_id"] == 1}) == 1
    assert S.fingerprints(df.limit(1)).count() == 1 and S.fingerprints(df.limit(0)).count() == 0


def test_positions(spark):
    from pyspark.sql import functions as F

    a = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (2, "x y z " + a + " more")], "doc_id long, text string").withColumn("anchors", S.anchors(F.col("text")))
    best = S.matched_offsets(df.where("doc_id = 1"), df.where("doc_id = 2")).orderBy(F.desc("n")).first()
    assert best["offset"] == 3 and best["n"] > 10
