import random
import re

from tessera.llm import licenses as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = (text or "").translate(str.maketrans(S.UPPER, S.LOWER))
    ws = WORD.findall(low)
    base = []
    for label, phrase in S.PHRASES.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    best, met = 0.0, set()
    for label, t in S.TEMPLATES:
        width, t = S.window_of(t), set(t.split())
        for k in range(0, max(1, len(ws)), width // 2):
            block = set(ws[k : k + width])
            if ws and len(block & t) >= S.THRESHOLD * len(t) - 1e-9:
                best, met = max(best, len(block & t) / len(t)), met | {label}
            if k + width >= len(ws):
                break
    labels = {x for _, x in base}
    at = [i for i, _ in base]
    return (len(ws), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | met)), 1.0 if base else best)


def test_agrees_with_brute_force(spark):
    rng = random.Random(2)
    pieces = [t for _, t in S.TEMPLATES] + list(S.PHRASES.values()) + ["the", "é license", "mit", "License MIT license", "word " * 70, "general public", "public license", "\n", "\n"]
    rows = []
    for i in range(150):
        ws = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 4))).split(" ")
        ws = [w for w in ws if rng.random() > 0.08]
        rows.append((i, " ".join(w.title() if rng.random() < 0.2 else w for w in ws)))
    rows += [(1000, None), (1001, ""), (1002, "MIT License mit license"), (1003, "mit\nlicense"), (None, "apache license"), (5, "x"), (5, "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    got = S.scan(df)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in got.collect()), key=str) == sorted(((i, *brute(t)[:-1], round(brute(t)[-1], 9)) for i, t in rows), key=str)
    assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))
    assert S.scan(df.limit(0)).count() == 0


def test_wrapped_notices(spark):
    import textwrap

    filler = " ".join(f"word{i}" for i in range(300))
    rows = [(i, f"{filler}\n\n/*\n * " + "\n * ".join(textwrap.wrap(t.capitalize(), 72)) + f"\n */\n{filler}") for i, (_, t) in enumerate(S.TEMPLATES)]
    got = {r["doc_id"]: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(S.TEMPLATES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0


def test_very_long_text(spark):
    filler = "plain words here that go on and on and on " * 20_000
    df = spark.createDataFrame([(1, filler + S.TEMPLATES[2][1] + " " + filler), (2, filler)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["labels"]) for r in S.scan(df).collect()}
    assert got == {1: (400_000 + len(S.TEMPLATES[2][1].split()), "mit"), 2: (200_000, "")}
