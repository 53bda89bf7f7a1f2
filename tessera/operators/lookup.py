"""Lookup API: nearest source words of an English word, an analogy or a blend."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as V


class Lookup:
    """Spaces by name, each (row_idx, word, vec), and the English words (row_idx, word, vec) of each.

    Queries are a vector from a few rows and one scan of the source space that keeps the k best; ties go to the higher row.
    """

    def __init__(self, spaces: dict[str, DataFrame], english: dict[str, DataFrame]):
        for name, s in {**spaces, **english}.items():
            if not {"row_idx", "word", "vec"} <= set(s.columns):
                raise ValueError(f"space {name} needs row_idx, word and vec")
        self.spaces, self.english = spaces, english

    def _space(self, space: str) -> None:
        if space not in self.spaces:
            raise ValueError(f"unknown space {space!r}, not one of {sorted(self.spaces)}")

    def vectors(self, words: list[str], space: str) -> dict[str, list[float]]:
        """Unit vectors of English words, by lower-cased word; of equal words the first row."""
        wanted = {w.lower() for w in words}
        rows = self.english[space].where(F.lower("word").isin(*wanted)).select("row_idx", F.lower("word").alias("w"), V.unit(V.doubles(F.col("vec"))).alias("u")).orderBy(F.desc("row_idx")).collect()
        return {r["w"]: list(r["u"]) for r in rows}

    def top(self, vector: list[float], k: int, space: str) -> DataFrame:
        q = F.array(*[F.lit(float(x)) for x in vector])
        rows = self.spaces[space].select("row_idx", "word", V.dot(V.unit(V.doubles(F.col("vec"))), q).alias("sim"))
        return rows.orderBy(F.desc("sim"), F.desc("row_idx")).limit(k)

    def _words(self, vector: list[float] | None, k: int, space: str) -> list[tuple[str, float]]:
        if vector is None:
            return []
        n = sum(x * x for x in vector) ** 0.5
        return [(r["word"], r["sim"]) for r in self.top([x / n for x in vector], k, space).collect()] if n > 0 else []

    def find(self, word: str, top_k: int = 10, space: str = "gemma") -> list[tuple[str, float]]:
        self._space(space)
        return self._words(self.vectors([word], space).get(word.lower()), top_k, space)

    def find_both(self, word: str, top_k: int = 10) -> dict[str, list[tuple[str, float]]]:
        return {s: self.find(word, top_k, s) for s in self.spaces}

    def find_analogy(self, a: str, b: str, c: str, top_k: int = 10, space: str = "gemma") -> list[tuple[str, float]]:
        """a is to b as c is to the result; nothing if a word is unknown or the sum is zero."""
        self._space(space)
        v = self.vectors([a, b, c], space)
        x, y, z = (v.get(w.lower()) for w in (a, b, c))
        return self._words([p - q + r for p, q, r in zip(z, x, y)] if x and y and z else None, top_k, space)

    def find_blend(self, weights: dict[str, float], top_k: int = 10, space: str = "gemma") -> list[tuple[str, float]]:
        """The weighted sum of the known words."""
        self._space(space)
        v = self.vectors(list(weights), space)
        known = [(w, v[k.lower()]) for k, w in weights.items() if k.lower() in v]
        return self._words([sum(w * x[i] for w, x in known) for i in range(len(known[0][1]))] if known else None, top_k, space)

    def neighbours(self, word: str, k: int = 10, space: str = "gemma") -> list[tuple[str, float]]:
        """Words of the same language nearest to one of them, itself left out."""
        self._space(space)
        own = self.spaces[space].where(F.col("word") == word).select(V.unit(V.doubles(F.col("vec"))).alias("u")).first()
        if own is None or not any(own["u"]):
            return []
        rows = self.top(list(own["u"]), k + 1, space).where(F.col("word") != word).limit(k).collect()
        return [(r["word"], r["sim"]) for r in rows]

    def reverse_query(self, seeds: list[str], space: str = "gemma", k_source: int = 10, k_english: int = 5) -> dict[str, dict]:
        """Each seed's source words, and for each of those the nearest English ones; an error note for unknown seeds."""
        self._space(space)
        out: dict[str, dict] = {}
        back = Lookup({space: self.english[space]}, {space: self.spaces[space]})
        for seed in seeds:
            near = self.find(seed, k_source, space)
            if not near:
                out[seed] = {"error": "unknown seed"}
                continue
            v = back.vectors([w for w, _ in near], space)
            out[seed] = {"source": near, "english": {w: back._words(v.get(w.lower()), k_english, space) for w, _ in near}}
        return out


def find_displacement(lookup: Lookup, word: str, seed: str, space: str = "gemma") -> dict[str, float]:
    """Cosine of a source word's projected vector with an English seed's, and 1 minus it; KeyError for unknown words."""
    row = lookup.spaces[space].where(F.col("word") == word).select(V.unit(V.doubles(F.col("vec"))).alias("u")).first()
    v = lookup.vectors([seed], space).get(seed.lower())
    if row is None or v is None:
        raise KeyError(word if row is None else seed)
    c = sum(x * y for x, y in zip(row["u"], v))
    return {"cosine": c, "displacement": 1 - c}
