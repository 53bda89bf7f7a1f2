import random

import numpy as np
from tessera.llm import minhash as M


def sets(text, width):
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(M.A_TO_Z)) if w]
    k = min(width, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()


def brute(docs, width):
    s = {i: sets(t, width) for i, t in docs}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s[i]), find(i)) for i in s}


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('AB')}w{i}é" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 5, 12, 60, 400)))] for _ in range(12)]
    out = []
    for i in range(n):
        ws = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, len(ws) // 12))):
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        out.append((i * 3, rng.choice((" ", "\n", "\t ")).join(ws)))
    return out + [(10_001, ""), (10_002, None), (10_003, " \n"), (10_004, "")]


def test_agrees_with_brute_force(spark):
    for seed, width in ((1, 2), (2, 5)):
        docs = corpus(seed)
        df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, cls int").repartition(3)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(df, width).collect()}
        assert got == brute(docs, width)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = []
    for i in range(300):
        ws = list(base)
        for _ in range(7):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(ws)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(df, 2).collect()}
    assert got == brute(docs, 2)


def test_small_blocks_find_the_same(spark, monkeypatch):
    docs = corpus(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = M.linked_in_blocks
    monkeypatch.setattr(M, "linked_in_blocks", lambda *a: whole(*a, most=200))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(df, 2).collect()}
    assert got == brute(docs, 2)


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (4, "z"), (None, "q r s"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in M.near_duplicates(df, 2).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (4, 1, 4, True), (None, 2, None, True), (None, 0, None, True)], key=str)
    assert M.near_duplicates(df.limit(0), 2).count() == 0


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        common, own = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
        a, b = np.unique(np.concatenate((common, own[:100]))), np.unique(np.concatenate((common, own[100:])))
        sa, sb = M.signature(a), M.signature(b)
        errors.append((sa == sb).mean() - 0.8)
        assert (M.bands(sa) == M.bands(sb)).any()
    assert abs(np.mean(errors)) < 0.01


def test_thousands_of_tiny_near_copies(spark):
    """More nodes than a task compares at once; each is linked with the first one only, so no two others make a short cut."""
    base = [f"w{i}" for i in range(20)]
    docs = [(0, " ".join(base))] + [(i, " ".join(base[: i % 19 + 1] + [f"x{i}"] + base[i % 19 + 2 :])) for i in range(1, 4500)]
    got = M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), width=2).collect()
    assert len(got) == len(docs)

    def shingles(t):
        ws = t.split()
        return set(zip(ws, ws[1:]))

    sets = [shingles(t) for _, t in docs]
    for r in got:
        s = sets[r["doc_id"]]
        if 100 * len(s & sets[0]) >= 80 * len(s | sets[0]):
            assert r["component_id"] == 0
