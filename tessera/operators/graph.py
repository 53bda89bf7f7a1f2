"""Connected groups and splits that don't leak between parts."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, functions as F

from ..functions.text import edit_distance_within_one
from ..runtime import written


#: Up to so many directed edges, some megabytes, a round runs in one task, which needs no exchange.
ONE_TASK = 400_000


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component): the least node each node reaches; a node whose only edges are to itself is its own.

    Each round hangs a node's greater neighbours, then all of them, on the least of its neighbourhood, until the edges are stars around
    the least nodes. What a hub gathers is reduced before it is shuffled, and its edges move to lesser nodes with each round, so that the rounds
    grow with the logarithm of the nodes.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    now = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    alone = now.where("a = b").select(F.col("a").alias("node"))
    now = now.where("a <> b")
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFFFF)))).first())
        if mark == seen:
            break
        seen = mark
        gather = (lambda df: df.coalesce(1)) if mark[0] <= ONE_TASK else (lambda df: df)
        both = gather(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = gather(written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = written(gather(small).where("a <> b").distinct(), "small")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    return found.unionByName(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


def near_surface_pairs(anchors: DataFrame) -> DataFrame:
    """(english, a, b): surfaces of one gloss within one edit of each other.

    Two strings within one edit share their first or second half, so that they meet under one of those and
    not as all pairs of a gloss.
    """
    s = anchors.select("english", "surface").distinct()
    n = F.length("surface")
    keys = F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.greatest(n - 1, F.lit(0)), n + 1),
                lambda m: F.array(F.concat(F.lit("<"), m, F.lit(":"), F.substring("surface", F.lit(1), F.floor(m / 2).cast("int"))), F.concat(F.lit(">"), m, F.lit(":"), F.right("surface", (m - F.floor(m / 2)).cast("int") - 1))),
            )
        )
    )
    k = s.select("english", "surface", F.explode(keys).alias("k"))
    x, y = k.alias("x"), k.alias("y")
    pairs = x.join(y, (F.col("x.english") == F.col("y.english")) & (F.col("x.k") == F.col("y.k"))).where("x.surface < y.surface")
    return pairs.select("x.english", F.col("x.surface").alias("a"), F.col("y.surface").alias("b")).where(edit_distance_within_one(F.col("a"), F.col("b"))).distinct()


def anchor_groups(anchors: DataFrame, fallback: str = "gloss", near_surfaces: bool = True) -> DataFrame:
    """Anchors (ord, surface, english, lemmas) with ``grp``: what shares a surface, a lemma or, without lemmas, a gloss (or case-folded surface)."""
    if fallback not in ("gloss", "surface_casefold"):
        raise ValueError(f"unknown fallback {fallback!r}")
    surface = F.concat(F.lit("surface:"), "surface")
    has = F.coalesce(F.size("lemmas"), F.lit(0)) > 0
    other = F.concat(F.lit("gloss:"), "english") if fallback == "gloss" else F.concat(F.lit("surface_cf:"), F.lower("surface"))
    to = F.when(has, F.transform("lemmas", lambda x: F.concat(F.lit("lemma:"), x))).otherwise(F.array(other))
    edges = anchors.select(surface.alias("src"), F.explode(to).alias("dst"))
    if near_surfaces:
        edges = edges.unionByName(near_surface_pairs(anchors).select(F.concat(F.lit("surface:"), "a").alias("src"), F.concat(F.lit("surface:"), "b").alias("dst")))
    comp = connected_components(edges)
    return anchors.withColumn("node", surface).join(comp, "node").drop("node").withColumnRenamed("component", "grp")


def group_split(grouped: DataFrame, seed: int = 42, parts: tuple[tuple[str, float], ...] = (("train", 0.64), ("val", 0.16), ("test", 0.20))) -> DataFrame:
    """The rows with ``part``; a group is never divided.

    Groups in order of their first row are shuffled by the seed, sorted by size and given one by one to the part that lacks most. The driver
    holds the groups' sizes, not their rows.
    """
    sizes = [(r["grp"], r["n"]) for r in grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).orderBy("first").collect()]
    random.Random(seed).shuffle(sizes)
    sizes.sort(key=lambda x: -x[1])
    total = sum(n for _, n in sizes)
    have = dict.fromkeys((p for p, _ in parts), 0)
    given = []
    for g, n in sizes:
        part = max(parts, key=lambda p: p[1] * total - have[p[0]])[0]
        have[part] += n
        given.append((g, part))
    table = grouped.sparkSession.createDataFrame(given, "grp string, part string")
    return grouped.join(table, "grp")


def sample_without_replacement(df: DataFrame, n: int, order: str, seed: int = 42) -> DataFrame:
    """The same n rows for a seed, drawn by number on the driver."""
    import numpy as np

    total = df.count()
    drawn = sorted(np.random.RandomState(seed).choice(total, min(n, total), replace=False).tolist()) if total else []
    ids = df.sparkSession.createDataFrame([(int(i),) for i in drawn], "drawn long")
    return df.join(ids, df[order] == ids["drawn"], "left_semi")
