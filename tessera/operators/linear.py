"""Linear maps between embedding spaces from distributed Gram sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import ship

ALPHAS = tuple(10.0**e for e in range(-4, 6))


@dataclass(frozen=True)
class Gram:
    """Sums over rows: count, x, y, x'x, x'y, y'y. Sums of parts add up."""

    n: int
    sx: np.ndarray
    sy: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Gram:
        return cls(len(x), x.sum(0), y.sum(0), x.T @ x, x.T @ y, y.T @ y)

    def centred(self):
        mx, my = self.sx / self.n, self.sy / self.n
        return mx, my, self.xx - self.n * np.outer(mx, mx), self.xy - self.n * np.outer(mx, my)


def gram(rows: DataFrame, x: str = "x", y: str = "y", fan_in: int = 16) -> Gram:
    """Each task sums its rows in blocks; the parts are added up in levels of ``fan_in``."""
    ship(rows.sparkSession)

    def part(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                a, b = np.stack(pdf["x"]).astype(np.float64), np.stack(pdf["y"]).astype(np.float64)
                v = np.concatenate([[len(a), a.shape[1], b.shape[1]], a.sum(0), b.sum(0), (a.T @ a).ravel(), (a.T @ b).ravel(), (b.T @ b).ravel()])
                if total is None:
                    total = v
                else:
                    total[0] += v[0]
                    total[3:] += v[3:]
        if total is not None:
            yield pd.DataFrame({"v": [total]})

    def add(batches):
        total = None
        for pdf in batches:
            for v in pdf["v"]:
                v = np.array(v)
                if total is None:
                    total = v
                else:
                    total[0] += v[0]
                    total[3:] += v[3:]
        if total is not None:
            yield pd.DataFrame({"v": [total]})

    parts = rows.select(F.col(x).alias("x"), F.col(y).alias("y")).mapInPandas(part, "v array<double>")
    n = parts.rdd.getNumPartitions()
    while n > fan_in:
        n = -(-n // fan_in)
        parts = parts.repartition(n).mapInPandas(add, "v array<double>")
    vs = [np.array(r["v"]) for r in parts.collect()]
    if not vs:
        raise ValueError("no rows")
    v = vs[0]
    for w in vs[1:]:
        v[0] += w[0]
        v[3:] += w[3:]
    d, t = int(v[1]), int(v[2])
    cuts = np.cumsum([3, d, t, d * d, d * t, t * t])
    sx, sy, xx, xy, yy = (v[a:b] for a, b in zip(cuts, cuts[1:]))
    return Gram(int(v[0]), sx, sy, xx.reshape(d, d), xy.reshape(d, t), yy.reshape(t, t))


def ridge(g: Gram, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(coef t x d, intercept t); the intercept isn't penalised."""
    return ridge_path(g, (alpha,))[alpha]


def ridge_path(g: Gram, alphas=ALPHAS) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """All alphas from one eigendecomposition."""
    mx, my, cxx, cxy = g.centred()
    lam, q = np.linalg.eigh(cxx)
    rotated = q.T @ cxy
    out = {}
    for a in alphas:
        w = q @ (rotated / (np.maximum(lam, 0) + a)[:, None])
        out[a] = (w.T, my - mx @ w)
    return out


def select_alpha(scores: dict[float, float], n_val: int) -> float:
    """The lowest alpha whose score lies within one validation item of the best."""
    best = max(scores.values())
    return min(a for a, s in scores.items() if s >= best - 100 / n_val - 1e-9)


def whitening(g: Gram, eps: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(mean, symmetric transform) of x: covariance by n - 1, eigenvalues of at least ``eps``."""
    mx, _, cxx, _ = g.centred()
    lam, q = np.linalg.eigh(cxx / (g.n - 1))
    return mx, (q / np.sqrt(np.maximum(lam, eps))) @ q.T


def pca(g: Gram, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components k x d, variances), signs so that each component's largest entry is positive."""
    mx, _, cxx, _ = g.centred()
    lam, q = np.linalg.eigh(cxx / (g.n - 1))
    order = np.argsort(-lam)[:k]
    comp = q[:, order].T
    comp *= np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(1)])[:, None]
    return mx, comp, lam[order]


def semi_orthogonal(g: Gram) -> np.ndarray:
    """The map W = U V' of the singular value decomposition of x'y."""
    u, _, vt = np.linalg.svd(g.xy, full_matrices=False)
    return u @ vt


def procrustes_scaled(g: Gram) -> tuple[np.ndarray, float]:
    """Orthogonal map and scale between centred clouds."""
    _, _, cxx, cxy = g.centred()
    u, s, vt = np.linalg.svd(cxy, full_matrices=False)
    return u @ vt, float(s.sum() / np.trace(cxx))


def select_variant(scores: dict[str, float]) -> str:
    """The better of full and stable; full in a tie."""
    return max(scores, key=lambda k: (scores[k], k == "full"))


def project(df: DataFrame, vec_col: str, matrix: np.ndarray, offset: np.ndarray | float = 0.0, out: str = "projected", half: bool = False) -> DataFrame:
    """The table with vec @ matrix + offset in ``out``, rounded to half precision with ``half``. The matrix goes to all tasks; its size is that of the spaces, not of the table."""
    ship(df.sparkSession)
    names = df.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{out}` array<double>"])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf[vec_col]).astype(np.float64) @ matrix + offset
                v = v.astype(np.float16).astype(np.float64) if half else v
                yield pdf[names].assign(**{out: list(v)})

    return df.mapInPandas(run, schema)


def pca_lift(df: DataFrame, vec_col: str, mean: np.ndarray, components: np.ndarray, out: str = "lifted") -> DataFrame:
    """Reduced vectors rounded to half precision, lifted back and rounded again."""
    half = df.withColumn(vec_col, F.col(vec_col))
    reduced = project(half, vec_col, np.eye(components.shape[0]), 0.0, "_half", half=True)
    return project(reduced, "_half", components, mean, out, half=True).drop("_half")


def isometry_rho(x: np.ndarray, w: np.ndarray, most: int = 1000, seed: int = 42) -> float:
    """Spearman correlation of pairwise cosines before and after a map, over at most ``most`` rows."""
    from .study import spearman

    if len(x) > most:
        x = x[np.random.RandomState(seed).choice(len(x), most, replace=False)]
    y = x @ w
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    i, j = np.triu_indices(len(x), 1)
    return spearman((unit(x) @ unit(x).T)[i, j], (unit(y) @ unit(y).T)[i, j])


def fit_procrustes(train: DataFrame, val: DataFrame, stable_train: DataFrame | None = None) -> dict:
    """Fit on train (and on its stable part), choose by mean cosine on val, refit on train and val together."""
    from .nearest import V  # the same cosine as the rest

    def mean_cosine(w: np.ndarray) -> float:
        return project(val, "x", w, 0.0, "xw").agg(F.avg(V.cosine(F.col("xw"), V.doubles(F.col("y"))))).first()[0]

    variants = {"full": train} | ({"stable": stable_train} if stable_train is not None else {})
    scores = {k: mean_cosine(semi_orthogonal(gram(v))) for k, v in variants.items()}
    chosen = select_variant(scores)
    return {"variant": chosen, "val_cosine": scores, "W": semi_orthogonal(gram(variants[chosen].select("x", "y").unionByName(val.select("x", "y"))))}
