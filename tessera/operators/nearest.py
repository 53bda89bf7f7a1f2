"""Nearest-neighbour operators over embedding tables (id, vec)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import FloatType

from ..functions import vectors as V
from ..runtime import ship

#: Bytes of vectors, as they are stored, that a task holds of each side, of a packed row of them, and of the products that are made at once.
SIDE_BYTES, BLOCK_BYTES, TILE_BYTES = 16 << 20, 1 << 20, 4 << 20
#: Query parts for each core, so that tasks of unequal length even out.
PARTS = 4
#: A block product and the sum in order differ by less; what is as near to a limit is summed in order.
NEAR = 1e-9
_KINDS = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products row by row, summed in order as SQL does, so that they are the same however rows are put into blocks."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out += x * y
    return out


def _dots_at(m: np.ndarray, i: np.ndarray, n: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``_dots`` of rows i of m and j of n, TILE_BYTES at a time."""
    step = max(1, TILE_BYTES // (8 * max(1, m.shape[1])))
    return np.concatenate([_dots(m[i[k : k + step]], n[j[k : k + step]]) for k in range(0, max(1, len(i)), step)])


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(_dots(m, m))[:, None]
    return m / np.where(n > 0, n, 1)


def _packed(df: DataFrame, id_col: str, vec_col: str, less: str | None = None) -> DataFrame:
    """The table as rows of many vectors each: ids, vectors and a number for each (``less``, or 0) as bytes."""

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, v, less = b.columns
            lengths = pc.min_max(pc.list_value_length(v)).as_py()
            if ids.null_count or v.null_count or lengths["min"] != lengths["max"]:
                raise ValueError("ids or vectors are null, or vectors differ in length")
            m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            ids, less = ids.to_numpy(), less.to_numpy(zero_copy_only=False)
            per = max(1, BLOCK_BYTES // max(1, m[0].nbytes))
            for i in range(0, len(m), per):
                yield pa.record_batch({"ids": [ids[i : i + per].tobytes()], "m": [m[i : i + per].tobytes()], "less": [less[i : i + per].tobytes()]})

    less = F.col(less).cast("double") if less else F.lit(0.0)
    stored = F.col(vec_col) if _width(df, vec_col) == 4 else V.doubles(F.col(vec_col))
    return df.select(F.col(id_col).cast("long").alias("id"), stored.alias("v"), less.alias("less")).mapInArrow(pack, "ids binary, m binary, less binary")


def _width(df: DataFrame, vec_col: str) -> int:
    """Bytes of a stored number: floats stay as they are until they are multiplied."""
    return 4 if isinstance(df.schema[vec_col].dataType.elementType, FloatType) else 8


def _blocks(packed: pa.Table, width: int, unit: bool):
    """(ids, vectors, numbers) of about BLOCK_BYTES each."""

    def made(rows):
        ids, less = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in ((0, np.int64), (2, np.float64)))
        m = np.frombuffer(b"".join(r[1] for r in rows), np.dtype(f"f{width}")).reshape(len(ids), -1).astype(np.float64)
        return ids, _unit_rows(m) if unit else m, less

    held, size = [], 0
    for row in zip(*(packed[k] for k in ("ids", "m", "less"))):
        held.append([x.as_buffer() for x in row])
        size += held[-1][1].size
        if 2 * size > BLOCK_BYTES:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def _met(queries: DataFrame, candidates: DataFrame, seeing, schema: str, id_col: str, vec_col: str, unit: bool, less: str | None = None, query_less: str | None = None) -> tuple[DataFrame, int]:
    """What ``seeing`` (query ids, vectors, numbers) says of all parts of the queries and all slices of the candidates, and the number of slices.

    It is made for a few queries at a time; its ``see`` gets each block of candidates (ids, vectors, numbers), its ``rows`` gives columns of the ``schema``.
    Both sides are packed and dealt out on executors, SIDE_BYTES of a side at most to a task, so that no vector passes through the driver; products
    are made TILE_BYTES at a time, so that a task's memory doesn't grow with the tables.
    """
    spark = queries.sparkSession
    ship(spark)
    wide, narrow = _width(queries, vec_col), _width(candidates, vec_col)
    size = lambda t, w: t.agg(F.coalesce(F.sum(F.lit(w) * F.size(vec_col).cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    (q_bytes, q_rows), (c_bytes, _) = size(queries, wide), size(candidates, narrow)
    slices = max(1, -(-c_bytes // SIDE_BYTES))
    parts = max(-(-q_bytes // SIDE_BYTES), min(PARTS * spark.sparkContext.defaultParallelism, -(-q_rows // 256)), 1)
    kinds = {name: _KINDS[kind] for name, kind in (x.split() for x in schema.split(", "))}

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        seen = []
        if len(q) and len(c):
            for ids, m, numbers in _blocks(q, wide, unit):
                step = max(1, TILE_BYTES // (8 * max(1, BLOCK_BYTES // max(1, narrow * m.shape[1]))))
                seen += [seeing(ids[i : i + step], m[i : i + step], numbers[i : i + step]) for i in range(0, len(ids), step)]
            for block in _blocks(c, narrow, unit):
                for x in seen:
                    x.see(*block)
        rows = [x.rows() for x in seen]
        return pa.table({k: pa.chunked_array([pa.array(r[i], t) for r in rows], t) for i, (k, t) in enumerate(kinds.items())})

    # few rows of a query block each, so that they are dealt evenly
    spread = queries.repartition(parts, id_col) if parts > 1 else queries
    q = _packed(spread, id_col, vec_col, query_less).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    c = _packed(candidates, id_col, vec_col, less).withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return q.groupBy("slice", "part").cogroup(c.groupBy("slice", "part")).applyInArrow(run, schema), slices


class _Best:
    """The ``k`` best candidates so far of some queries, by score to 12 places, then id: rounding makes equal what differs in the last bits only, so that ties go by id."""

    def __init__(self, k: int, exclude_self: bool, scale: float, ids: np.ndarray, m: np.ndarray):
        self.k, self.exclude_self, self.scale, self.ids, self.m = k, exclude_self, scale, ids, m
        #: Of each query the k-th best score, rounded, or a bound of it, and the id there.
        self.worst, self.last = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)
        self.held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64))]

    def see(self, others: np.ndarray, n: np.ndarray, less: np.ndarray) -> None:
        s = self.m @ n.T
        if self.scale != 1:
            s *= self.scale
        if less.any():
            s -= less
        if len(others) >= self.k and np.isneginf(self.worst).any():
            t = np.where(np.isfinite(s), s, -np.inf)
            if self.exclude_self:
                t[self.ids[:, None] == others] = -np.inf
            self.worst = np.maximum(self.worst, np.partition(t, len(others) - self.k, axis=1)[:, len(others) - self.k] - NEAR)
        at = np.flatnonzero(s >= (self.worst - NEAR)[:, None])
        i, j = at // len(others), at % len(others)
        score = self.scale * _dots_at(self.m, i, n, j) - less[j]
        r, c = np.round(score, 12), others[j]
        good = np.isfinite(r) & ((r > self.worst[i]) | ((r == self.worst[i]) & (c < self.last[i])))
        if self.exclude_self:
            good &= self.ids[i] != c
        self.held.append((i[good], score[good], r[good], c[good]))
        if sum(len(x[0]) for x in self.held) > 4 * self.k * len(self.ids):
            self.merge()

    def merge(self) -> np.ndarray:
        """Leaves the best; their ranks from 0."""
        i, score, r, c = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((c, -r, i))
        i, score, r, c = i[order], score[order], r[order], c[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, score, r, c, rank = (x[rank < self.k] for x in (i, score, r, c, rank))
        full = rank == self.k - 1
        self.worst[i[full]], self.last[i[full]] = r[full], c[full]
        self.held = [(i, score, r, c)]
        return rank

    def rows(self):
        rank = self.merge()
        i, score, _, c = self.held[0]
        return self.ids[i], c, score, (rank + 1).astype(np.int32)


def block_topk(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", exclude_self: bool = False, penalty: str | None = None, scale: float = 1.0, unit: bool = True) -> DataFrame:
    """(q, c, score, rnk): each query's k best candidates by ``scale`` * cosine - penalty (a column of the candidates); ties go to the lower id.

    Parts of the queries are multiplied with slices of the candidates; where there are several slices
    their bests are merged.
    """
    seeing = lambda ids, m, _: _Best(k, exclude_self, scale, ids, m)
    out, slices = _met(queries, candidates, seeing, "q long, c long, score double, rnk int", id_col, vec_col, unit, penalty)
    if slices == 1:
        return out
    order = W.partitionBy("q").orderBy(F.round("score", 12).desc(), "c")
    return out.drop("rnk").withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)


def neighbour_table(df: DataFrame, k: int = 10, **kw) -> DataFrame:
    """The k nearest others of every vector, from which several lenses and lookups read."""
    return block_topk(df, df, k, exclude_self=True, **kw)


def csls_penalty(pool: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(c, r): the mean cosine of each candidate's k nearest in the pool of queries."""
    return block_topk(candidates, pool, k, id_col, vec_col).groupBy(F.col("q").alias("c")).agg(F.avg("score").alias("r"))


def csls_topk(queries: DataFrame, candidates: DataFrame, pool: DataFrame, k: int = 10, top: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(q, c, score, rnk) by 2 cos(q, c) - r(c); the query's own term can't change its ranking and is left out."""
    r = csls_penalty(pool, candidates, k, id_col, vec_col)
    weighed = candidates.select(id_col, vec_col).join(r.withColumnRenamed("c", id_col), id_col, "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    return block_topk(queries, weighed, top, id_col, vec_col, penalty="r", scale=2.0)


def pairwise(df: DataFrame, ids: list[int], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(i, j, dist) for a given list of ids, each row scanned once against that list; KeyError for ids that the table lacks."""
    few = df.where(F.col(id_col).isin(ids)).select(F.col(id_col).alias("i"), V.unit(V.doubles(F.col(vec_col))).alias("u"))
    held = {r["i"]: list(r["u"]) for r in few.collect()}
    if missing := [i for i in ids if i not in held]:
        raise KeyError(f"unknown ids {missing}")
    table = few.sparkSession.createDataFrame([(i, held[i]) for i in sorted(set(ids))], "j long, w array<double>")
    return few.join(F.broadcast(table)).select("i", "j", (1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(F.col("u"), F.col("w"))))).alias("dist"))


class _Pairs:
    """Pairs of a query and a candidate of higher id of cosine ``least`` or more; with ``top`` as many at most, the most similar ones, then those of lower ids."""

    def __init__(self, least: float, top: int | None, ids: np.ndarray, m: np.ndarray):
        self.least, self.top, self.ids, self.m = least, top, ids, m
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def see(self, others: np.ndarray, n: np.ndarray, less: np.ndarray) -> None:
        s = self.m @ n.T
        at = np.flatnonzero(s >= self.least - NEAR)
        i, j = at // len(others), at % len(others)
        up = self.ids[i] < others[j]
        i, j = i[up], j[up]
        sim = _dots_at(self.m, i, n, j)
        good = sim >= self.least
        self.held.append((self.ids[i[good]], others[j[good]], sim[good]))
        if self.top and sum(len(x[0]) for x in self.held) > 4 * self.top:
            self.rows()

    def rows(self):
        a, b, sim = (np.concatenate(x) for x in zip(*self.held))
        if self.top and len(a) > self.top:
            order = np.lexsort((b, a, -sim))[: self.top]
            a, b, sim = a[order], b[order], sim[order]
            self.least = max(self.least, sim[-1])
        self.held = [(a, b, sim)]
        return a, b, sim


def similar_pairs(df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", top: int | None = None) -> DataFrame:
    """(a, b, sim), a < b, for every pair of cosine ``least`` or more: parts against slices, only hits leave a task.

    With ``top`` these are at least the ``top`` most similar ones, ties by a and b, and not all others.
    """
    seeing = lambda ids, m, _: _Pairs(least, top, ids, m)
    return _met(df, df, seeing, "a long, b long, sim double", id_col, vec_col, True)[0]


class _Above:
    """For each query the number of candidates, zero vectors aside, whose cosine is over its limit."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, limit: np.ndarray):
        self.ids, self.m, self.limit, self.n = ids, m, limit, np.zeros(len(ids), np.int64)

    def see(self, others: np.ndarray, n: np.ndarray, less: np.ndarray) -> None:
        n = n[n.any(axis=1)]
        s = self.m @ n.T
        s -= self.limit[:, None]
        self.n += (s > NEAR).sum(axis=1)
        at = np.flatnonzero(np.abs(s, out=s) <= NEAR)
        i, j = at // max(1, len(n)), at % max(1, len(n))
        over = _dots_at(self.m, i, n, j) > self.limit[i]
        self.n += np.bincount(i[over], minlength=len(self.ids))

    def rows(self):
        return self.ids, self.n


def above_limit(queries: DataFrame, candidates: DataFrame, limit: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(q, n): how many candidates have a cosine with a query of more than its ``limit`` (a column of the queries); ids of queries are distinct."""
    counted = _met(queries, candidates, _Above, "q long, n long", id_col, vec_col, True, query_less=limit)[0]
    return counted.groupBy("q").agg(F.sum("n").alias("n"))


def kth_distance(nn: DataFrame, k: int) -> DataFrame:
    """(vec, dist): cosine distance of the k-th nearest other, from a neighbour table of at least k."""
    return nn.where(F.col("rnk") == k).select(F.col("q").alias("vec"), (1 - F.col("score")).alias("dist"))


def mean_vector(df: DataFrame, by: list[str], vec_col: str, weight: str | None = None) -> DataFrame:
    """Element-wise (weighted) mean per group: sums per dimension, reduced before the shuffle."""
    w = F.col(weight) if weight else F.lit(1.0)
    long = df.select(*by, w.alias("w"), F.posexplode(V.doubles(F.col(vec_col))).alias("dim", "x"))
    sums = long.groupBy(*by, "dim").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))


def similarity_histogram(values: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) for all bins; the last one is closed, values outside are left out."""
    at = F.when(F.col(col) == high, bins - 1).otherwise(F.floor((F.col(col) - low) / (high - low) * bins)).cast("int")
    counted = values.where(F.col(col).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
