"""Language identification with error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .learn import bounded_sample, held_out

DIM = 2048


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Small letter of each code point, or a space for what isn't a letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def features(text: str | None) -> np.ndarray | None:
    """Root frequencies of 1- to 3-grams of letters, hashed; None for texts without a letter."""
    if not text:
        return None
    c = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not (c != 32).any():
        return None
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (c[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
    grams = np.concatenate((one, two, three)) >> np.uint32(21)
    out = np.sqrt(np.bincount(grams, minlength=DIM).astype(np.float32))
    return out / np.linalg.norm(out)


def codewords(k: int, seed: int = 3) -> np.ndarray:
    """k rows of +1 and -1: the exhaustive code for up to 6 languages, else the random one of best separation."""
    if k < 2:
        return np.ones((k, 1), np.float32)
    if k <= 6:
        cols = [[1] + [1 if x >> i & 1 else -1 for i in range(k - 1)] for x in range(2 ** (k - 1) - 1)]
        return np.array(cols, np.float32).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    apart = lambda m: ((bits - m @ m.T) / 2 + np.eye(k) * bits).min()
    return max((rng.choice([-1.0, 1.0], (k, bits)).astype(np.float32) for _ in range(200)), key=apart)


def train(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 300, rate: float = 20.0, decay: float = 1e-5):
    """(codewords, weights DIM+1 x bits, weight of each bit) by full-batch gradient descent on the logistic loss."""
    code = codewords(k)
    want = code[y]
    xb = np.concatenate((x, np.ones((len(x), 1), np.float32)), 1)
    share = np.bincount(y, minlength=k).astype(np.float32)
    row = (1 / share[y])[:, None] / k  # languages count alike
    w, step = np.zeros((DIM + 1, code.shape[1]), np.float32), np.zeros((DIM + 1, code.shape[1]), np.float32)
    for _ in range(rounds):
        g = xb.T @ (-want / (1 + np.exp(np.clip(want * (xb @ w), -30, 30))) * row) + decay * w
        step = 0.9 * step - rate * g
        w += step
    hit = ((np.sign(xb @ w) == want) * row).sum(0)
    return code, w, np.log(np.clip(hit, 0.55, 0.995) / (1 - np.clip(hit, 0.55, 0.995))).astype(np.float32)


def decode(model, x: np.ndarray):
    """(class, score, ambiguous): the least loss summed over the bits, each with its weight."""
    code, w, weight = model
    f = x @ w[:-1] + w[-1]
    loss = (np.logaddexp(0, -f[:, None, :] * code[None]) * weight).sum(2) / weight.sum()
    p = np.exp(-(loss - loss.min(1, keepdims=True)) * code.shape[1])
    p /= p.sum(1, keepdims=True)
    top = np.sort(p, 1)[:, ::-1]
    return loss.argmin(1), top[:, 0], (top[:, 1] > 0.5 * top[:, 0]) if p.shape[1] > 1 else np.zeros(len(x), bool)


def fit(rows: DataFrame, most_rows: int = 6000):
    """(languages, model) fitted on the driver to at most ``most_rows`` rows (doc_id, text, lang) that have a lang and aren't held out, drawn by hash and alike for all languages; no model without any."""
    import pyarrow as pa

    known = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike("\\p{L}"))

    def as_features(batches):
        for batch in batches:
            got = [features(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array([None if v is None else v.tobytes() for v in got], pa.binary()), "lang": batch.column(1)})

    sample = bounded_sample(known, "lang", most_rows, "text").select("text", "lang").mapInArrow(as_features, "x binary, lang string").where("x IS NOT NULL").toArrow()
    names = sorted(set(sample.column("lang").to_pylist()))
    if not names:
        return names, None
    number = {n: i for i, n in enumerate(names)}
    found = sorted(zip(sample.column("lang").to_pylist(), sample.column("x").to_pylist()))
    x = np.frombuffer(b"".join(v for _, v in found), np.float32).reshape(-1, DIM)
    return names, train(x, np.array([number[n] for n, _ in found]), len(names))


def identify(docs: DataFrame, most_rows: int = 6000) -> DataFrame:
    """The language of every whole text.

    The classifiers are those of ``fit``. Returns doc_id, held_out,
    lang_pred, score, ambiguous. ``und`` with score 0 stands for texts that are null or have no
    letter, and for all texts where nothing could be learned. Rows don't depend on each other: repeated rows give equal rows, an
    empty table an empty result; further columns are ignored.
    """
    import pyarrow as pa

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    names, model = fit(rows, most_rows)

    def predict(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            got = [features(x) if model else None for x in texts]
            at = [i for i, v in enumerate(got) if v is not None]
            lang, score, doubt = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            if at:
                for i, c, p, d in zip(at, *decode(model, np.stack([got[i] for i in at]))):
                    lang[i], score[i], doubt[i] = names[c], float(p), bool(d)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "ambiguous": pa.array(doubt, pa.bool_())})

    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op6_langid(spark, sf_dir: str) -> DataFrame:
    from .common import documents, spread

    return identify(spread(documents(spark, sf_dir)))
