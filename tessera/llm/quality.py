"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .learn import bounded_sample, held_out

WORDS, EDGES = 1024, (-1.5, -0.5, 0.5, 1.5)
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def structure(text: str) -> list[float]:
    """Shares and logarithms that tell prose from lists, shouting, noise and repetition; last the text's length (metadata)."""
    n = max(1, len(text))
    words = TOKEN.findall(text)
    m = max(1, len(words))
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, text))
    spaces = n - sum(map(len, words)) if text else 0
    return [
        letters / n,
        sum(map(str.isupper, text)) / max(1, letters),
        sum(map(str.isdigit, text)) / n,
        (n - letters - spaces) / n if text else 0.0,
        len(seen) / m,
        max(seen.values(), default=0) / m,
        len(pairs) / m,
        max(pairs.values(), default=0) / m,
        sum(w.endswith((".", "!", "?")) for w in words) / m,
        sum(not any(map(str.isalpha, w)) for w in words) / m,
        letters / m,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        np.log1p(m),
        np.log1p(len(text)),
    ]


STATS = len(structure(""))


def features(text: str | None) -> np.ndarray:
    """Hashed words by root frequency, unit length, then the raw statistics. Null is the empty text."""
    text = text or ""
    out = np.zeros(WORDS + STATS, np.float32)
    for w, c in Counter(TOKEN.findall(text)).items():
        out[crc32(w.lower().encode("utf-8", "replace")) % WORDS] += c
    out[:WORDS] = np.sqrt(out[:WORDS])
    if norm := np.linalg.norm(out[:WORDS]):
        out[:WORDS] /= norm
    out[WORDS:] = structure(text)
    return out


class Machine:
    """w0 + w x + sum over factors of ((V x)^2 - V^2 x^2) / 2: all pairs in linear time."""

    def __init__(self, x: np.ndarray, y: np.ndarray, factors: int = 8, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 5):
        self.mean, self.dev = x[:, WORDS:].mean(0), x[:, WORDS:].std(0) + 1e-6
        x = self.scaled(x)
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = np.zeros(1, np.float32), np.zeros(x.shape[1], np.float32), rng.normal(0, 0.02, (x.shape[1], factors)).astype(np.float32)
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w0, self.w, self.v)]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                b = x[order[at : at + 256]]
                e = (1 / (1 + np.exp(-self.raw(b))) - y[order[at : at + 256]]) / len(b)
                grads = (e.sum(keepdims=True), b.T @ e + decay * self.w, b.T @ (e[:, None] * (b @ self.v)) - (b**2).T @ e[:, None] * self.v + decay * self.v)
                step += 1
                for p, g, (m, s) in zip((self.w0, self.w, self.v), grads, moments):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Statistics in standard deviations, with the steps they pass, so that ranges count and not only slopes."""
        z = np.clip((x[:, WORDS:] - self.mean) / self.dev, -4, 4)
        return np.concatenate((x[:, :WORDS], z / 4, *[(z > e).astype(np.float32) / 4 for e in EDGES]), 1).astype(np.float32)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.w0 + x @ self.w + 0.5 * ((x @ self.v) ** 2 - x**2 @ self.v**2).sum(1), -30, 30)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(self.scaled(x)).astype(np.float64)))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000) -> Machine | None:
    """A machine fitted on the driver to at most ``most_rows`` labelled rows that aren't held out; None without any.

    Rows with a null id or label are passed over, as are repeats of an id in the labels.
    """
    import pyarrow as pa

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    ids = [tuple(r) for r in bounded_sample(known.groupBy("doc_id").agg(F.min("quality").alias("quality")), "quality", most_rows).select("doc_id", "quality").collect()]
    if not ids:
        return None
    drawn = docs.sparkSession.createDataFrame(ids, "doc_id long, quality int")

    def as_features(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "quality": batch.column(1), "x": pa.array([features(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())})

    # most_rows rows at most, whatever the input's size; repeats of a document's row count once
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
    got = rows.mapInArrow(as_features, "doc_id long, quality int, x binary").toArrow().to_pylist()
    if not got:
        return None
    got.sort(key=lambda r: r["doc_id"])
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(len(got), -1)
    return Machine(x, np.array([r["quality"] for r in got], np.float32))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 6000) -> DataFrame:
    """doc_id, held_out, score (likelihood of label 1) and predicted (score >= threshold) of every whole text.

    Only the text is an input. Null and empty texts get the score of the empty text; where nothing
    could be learned every score is 0.5. Rows don't depend on each other: repeated rows give
    equal rows, an empty table an empty result; further columns are ignored.
    """
    import pyarrow as pa

    machine = fit(docs, labels, most_rows)

    def predict(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            score = machine.score(np.stack([features(t) for t in texts])) if machine and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= threshold).astype(np.int32), pa.int32())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 6000) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns, in one pass over the texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    machine = fit(docs, labels, most_rows)
    if machine is None:
        return docs
    at = docs.columns.index("text")

    def good(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if texts:
                yield batch.filter(pc.greater_equal(pa.array(machine.score(np.stack([features(t) for t in texts]))), threshold))

    return docs.mapInArrow(good, docs.schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    from .common import documents, spread

    return classify(spread(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"))
