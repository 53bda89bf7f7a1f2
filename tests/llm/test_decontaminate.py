import random

import numpy as np
from tessera.llm import decontaminate as D


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = [rng.randrange(5) for _ in range(rng.randint(1, 70))], [rng.randrange(6) for _ in range(rng.randint(0, 90))]
        assert D.common_length(a, np.array(b, np.uint16)) == plain(a, b)


def test_single_pass_svd_finds_the_space():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 60))
    omega = np.linalg.qr(rng.normal(size=(60, 12)))[0]
    v = D.right_space(a.T @ (a @ omega), omega, 8)
    want = np.linalg.svd(a)[2][:5].T
    assert np.allclose(np.linalg.norm(want.T @ v[:, :5], axis=1), 1, atol=1e-3)


def corpus():
    rng = random.Random(3)
    common = ["the", "of", "and", "in", "to"]
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(4, 9))) for _ in range(4000)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [(i, prose(rng.randint(12, 70))) for i in range(40)]
    docs, leaks = [], set()
    for i in range(300):
        ws = prose(rng.choice((5, 40, 300, 1500)))
        if i % 5 == 0:
            k = rng.randrange(40)
            item = list(items[k][1])
            if i % 10 == 0:  # a paraphrase: a quarter of the words replaced, the answer kept
                for at in rng.sample(range(len(item) - 8), (len(item) - 8) // 4) if len(item) > 12 else []:
                    item[at] = rng.choice(vocabulary)
            at = rng.randint(0, len(ws))
            ws[at:at] = item
            leaks.add((i, k))
        docs.append((i, " ".join(ws).upper() if i % 15 == 0 else " ".join(ws) + "."))
    return docs, [(i, " ".join(ws)) for i, ws in items], leaks


def test_leaks_and_paraphrases_are_found(spark):
    docs, items, leaks = corpus()
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, lcs string").repartition(4)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    for block in (256, 17):
        got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(d, b, block_items=block).collect()}
        assert got == leaks
    clean = D.decontaminate(d, b)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in leaks} and clean.columns == d.columns


def test_edge_cases(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "alpha beta gamma delta epsilon zeta eta theta"), (3, "alpha beta gamma delta epsilon zeta eta theta"), (3, "alpha beta gamma delta epsilon zeta eta theta")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "Alpha beta gamma delta epsilon zeta eta theta."), (8, None), (9, "!!"), (None, "other words than those above here")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in D.find_leaks(d, b).collect())
    assert got == [(0, 7), (3, 7), (3, 7)]
    assert D.find_leaks(d.limit(0), b).count() == 0 and D.find_leaks(d, b.limit(0)).count() == 0


def long_corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(4, 9))) for _ in range(6000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, prose(n)) for k, n in enumerate((300, 400, 600, 800, 1000) * 4)] + [(100 + k, prose(rng.randint(12, 70))) for k in range(20)]
    docs, leaks = [(1000 + i, prose(900)) for i in range(40)], set()
    for i, (k, item) in enumerate(items[:20]):
        for form in (0, 1):
            copy = list(item)
            if form:  # three in ten words replaced, the answer kept
                for at in rng.sample(range(len(copy) - 8), 3 * len(copy) // 10):
                    copy[at] = rng.choice(vocabulary)
            before = rng.randrange(200)
            docs.append((2 * i + form, prose(before) + copy + prose(150)))
            leaks.add((2 * i + form, k))
    return [(i, " ".join(ws)) for i, ws in docs], [(i, " ".join(ws)) for i, ws in items], leaks


def test_long_items_are_found(spark):
    # a passage of 48 words holds less than least_cover of most of these
    docs, items, leaks = long_corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(d, b).collect()} == leaks


def test_pieces_cover_long_items():
    rng = np.random.default_rng(2)
    table = rng.normal(size=(50, 3)).astype(np.float32)
    for n in (1, 48, 72, 73, 200, 311):
        item = rng.integers(0, 50, n).tolist()
        got = D.pieces(item, table)
        starts = sorted({*range(0, n - 48, 12), n - 48}) if n > 72 else []
        want = [table[item].sum(axis=0)] + [table[item[s : s + 48]].sum(axis=0) for s in starts]
        assert np.allclose(got, want, atol=1e-3)


def test_a_stretch_with_the_answer_counts_beside_a_nearer_one_without(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(4, 9))) for _ in range(4000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, prose(40)) for k in range(20)]
    docs, item = [(100 + i, prose(300)) for i in range(40)], items[3][1]
    without = item[:30] + prose(10)  # lcs 0.75, no answer
    answered = [w if at % 5 < 3 or at >= 32 else rng.choice(vocabulary) for at, w in enumerate(item)]  # lcs about 0.7, the answer whole
    docs += [(1, prose(60) + without + prose(200)), (2, prose(60) + answered + prose(200)), (3, prose(60) + without + prose(150) + answered + prose(100)), (4, prose(60) + answered + prose(150) + without + prose(100))]
    d = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in D.find_leaks(d, b).collect()}
    assert set(got) == {(2, 3), (3, 3), (4, 3)}
    assert all(0.5 <= r["lcs"] < 0.75 and r["answer"] == 1 for r in got.values())
