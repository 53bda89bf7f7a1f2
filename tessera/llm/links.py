"""Connected groups of nodes that share buckets, without all pairs of a bucket.

DataFrame operations only. Each round compares the members of a bucket with one leader, and
members that are connected already are not compared again; what is then left of a bucket, pairs across
groups, is compared in full, large buckets in parts. So the groups are exactly those
of all linked pairs that share a bucket, while a large group of copies costs a few
comparisons per member.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .common import Stages


#: Edges that one task takes.
ONE_TASK = 200_000


def _digest(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFFFF)))).first())


def components(stages: Stages, edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): comp is the group's smallest node.

    Alternating large and small stars: each step joins every node to the least of its neighbours;
    a hub's neighbours are reduced before they are shuffled. Up to ONE_TASK edges, some megabytes, the steps
    run in one task, which needs no exchange; more are dealt to all.
    """
    now = stages.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = _digest(now)
    while True:
        now = now.coalesce(1) if seen[0] <= ONE_TASK else now
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.coalesce(1) if seen[0] <= ONE_TASK else both
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stages.keep(large.where("a <> b").distinct(), "large")
        one = large.coalesce(1) if seen[0] <= ONE_TASK else large
        low = one.groupBy("a").agg(F.min("b").alias("m"))
        small = one.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b")))
        small = small.coalesce(1) if seen[0] <= ONE_TASK else small
        new = stages.keep(small.where("a <> b").distinct(), "small")
        stages.drop(now, large)
        now, last, seen = new, seen, _digest(new)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


#: Rows of a bucket that one task takes; a larger bucket is dealt to several.
PART = 2048
#: Parts that a bucket of fewer rows is dealt to where each pair is work: ten tasks, at four copies of a row.
FINER = 4


def parted(buckets: DataFrame, several: DataFrame, finer: bool = False) -> DataFrame:
    """(bucket, node, part, parts) of the buckets in ``several`` (bucket, n): each is dealt to parts of about PART rows.

    With ``finer``, where each pair is work, buckets are dealt to a third of sqrt(n) parts up to FINER, if these are more. As ``part_pairs`` copies a row once for
    each part, no bucket gets more parts than it takes for a task of its own in every shuffle partition: the copies of a row don't grow with the bucket then, its parts do.
    """
    parts = F.ceil(F.col("n") / PART)
    if finer:
        enough = math.ceil(math.sqrt(2 * int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        parts = F.least(F.greatest(parts, F.least(F.floor(F.sqrt("n") / 3), F.lit(FINER))), F.lit(enough))
    rows = buckets.join(several.select("bucket", parts.cast("int").alias("parts")), "bucket")
    return rows.select("bucket", "node", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int").alias("part"), "parts")


def shared(stages: Stages, buckets: DataFrame) -> DataFrame:
    """The rows of buckets that hold at least two different nodes, ``parted``; rows (bucket, node) are distinct."""
    several = buckets.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    return stages.keep(parted(buckets, several), "shared")


def every_part(rows: DataFrame) -> DataFrame:
    """Rows of buckets, once for each part: to be joined by (bucket, part)."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def part_pairs(rows: DataFrame) -> DataFrame:
    """Each row once for every part of its bucket, its own one included: x and y are the lesser and the greater of the two parts, first if its own is x."""
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other")).withColumn("first", F.col("part") == F.col("x")).drop("part", "other", "parts")


def all_pairs(rows: DataFrame, linked) -> DataFrame:
    """Links (a, b) among the rows of each bucket that are of different comp: part by part, where ``linked`` (sides x and y) is tested in the join itself."""
    # by number, so that few bytes that are much work don't land in few tasks
    met = part_pairs(rows).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "x", "y")
    a, b = met.alias("a"), met.alias("b")
    on = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    once = F.when(F.col("a.x") == F.col("a.y"), F.col("a.node") < F.col("b.node")).otherwise(F.col("a.first") & ~F.col("b.first"))
    return a.join(b, on & once & (F.col("a.comp") != F.col("b.comp")) & linked("a", "b")).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


#: Members of a large bucket that all others are compared with in a wide round, on average.
WIDE = 16


def wide_pairs(rows: DataFrame, sizes: DataFrame, k: int, linked) -> DataFrame:
    """Pairs (a, b) of different comp in buckets of over 4 * WIDE rows, where one is among some WIDE drawn from its bucket; ``linked`` (sides x and y) is tested in the join itself.

    The draw is by node, so that it is mostly the same in all buckets that a pair shares.
    """
    large = sizes.where(F.col("n") > 4 * WIDE).select("bucket", "n")
    rows = rows.join(large, "bucket")
    drawn = every_part(rows.where(F.pmod(F.xxhash64("node", F.lit(k), F.lit(7)), F.col("n")) < WIDE))
    a, b = rows.alias("a"), drawn.alias("b")
    on = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.part") == F.col("b.part"))
    return a.join(b, on & (F.col("a.comp") != F.col("b.comp")) & linked("a", "b")).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))


def link(
    stages: Stages,
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    rest: Callable[[DataFrame], DataFrame],
    rounds: int = 6,
    leaders: int = 1,
    wide: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None,
) -> DataFrame | None:
    """(node, comp) of all nodes that a link joins to another; None if there is none.

    Each round compares every node of a bucket with up to ``leaders`` of its members, those that it shares most buckets with.
    ``members`` is as ``shared`` gives it; ``verify`` gets pairs (a, b), a < b, and gives those that are links.
    Where many pairs are left, ``wide`` (rows, sizes, k) names more of them, in rounds of their own for as long as these connect a quarter of what is left.
    What the rounds leave, rows (bucket, node, part, parts, comp), goes to ``rest``, which gives edges (a, b) that connect all that is linked there.
    """
    tested = links = comp = last = None

    def labelled() -> DataFrame:
        if comp is None:
            return members.withColumn("comp", F.col("node"))
        return members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def test(pairs: DataFrame) -> bool:
        nonlocal tested, links, comp
        pairs = pairs.distinct() if tested is None else pairs.distinct().join(tested, ["a", "b"], "left_anti")
        new = stages.keep(pairs, "pairs")
        tested = new if tested is None else tested.unionByName(new)
        good = stages.keep(verify(new).select("a", "b"), "links")
        if good.isEmpty():
            return False
        links = good if links is None else links.unionByName(good)
        comp = stages.keep(components(stages, links), "groups")
        return True

    rows = sizes = None

    def left() -> tuple[int | None, int]:
        nonlocal rows, sizes
        before, rows = rows, labelled()
        several = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("parts").alias("parts")).where("lo <> hi").select("bucket", "parts")
        rows = stages.keep(rows.join(every_part(several), ["bucket", "part"], "left_semi"), "open")
        if before is not None:
            stages.drop(before)
        sizes = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"))
        return sizes.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("n2")) / 2)).first()

    for k in range(rounds + 1):
        total, pairs = left()
        if not total:
            return comp
        if pairs <= 2 * total or k == rounds or last is not None and pairs > last / 2:
            break  # few are left, or leaders don't connect what is
        last = pairs
        draws = [F.min(F.struct(F.xxhash64("node", F.lit(k), F.lit(j)).alias("draw"), "node", "comp")).alias(f"l{j}") for j in range(leaders)]
        leader = rows.groupBy("bucket").agg(F.max("parts").alias("parts"), *draws).select("bucket", "parts", F.explode(F.array_distinct(F.array(*[F.struct(f"l{j}.node", f"l{j}.comp") for j in range(leaders)]))).alias("of"))
        leader = every_part(leader.select("bucket", "parts", F.col("of.node").alias("to"), F.col("of.comp").alias("other")))
        with_leader = rows.join(leader, ["bucket", "part"]).where("comp <> other")
        counted = with_leader.groupBy("node", "to").agg(F.count(F.lit(1)).alias("n"))
        best = counted.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "to")), asc=False), 1, leaders).alias("best")).select("node", F.explode("best").alias("best"))
        if not test(best.select(F.least("node", "best.to").alias("a"), F.greatest("node", "best.to").alias("b"))) and k:
            break
    k, last = 0, None
    while wide and pairs > 4 * total and (last is None or pairs <= 0.75 * last):
        last = pairs
        if not test(wide(rows, sizes, k)):
            break
        k, (total, pairs) = k + 1, left()
        if not total:
            return comp
    more = stages.keep(rest(rows).select("a", "b"), "rest")
    if comp is None and more.isEmpty():
        return None
    links = more if links is None else links.unionByName(more)
    return stages.keep(components(stages, links), "groups")
