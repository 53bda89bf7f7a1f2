"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the words of the benchmark; a randomised SVD of all passages, with the
benchmark's own stacked on them, gives the latent space; passages near an item there are
candidates, and the longest common subsequence of words, with the item's answer, decides.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import Stages

WORD = re.compile(r"[^\W_]+")
CHUNK = 24  # a passage is two chunks, and each chunk but the ends is in two passages
OTHER = 0xFFFF  # number of every word that no item of the block has
LONG = 3 * CHUNK  # items of more words are also sought by pieces as long as a passage
CELLS = 1 << 22  # cosines that a task holds at once


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def tree_sum(parts: DataFrame, dtype, fan_in: int = 16) -> np.ndarray | None:
    """Sum of equally long arrays in the binary column ``v``, by levels of ``fan_in`` down to one, which the driver gets; None without rows."""
    import pyarrow as pa

    def add(batches):
        total = None
        for batch in batches:
            for x in batch.column(0):
                x = np.frombuffer(x.as_buffer(), dtype)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan_in)
        parts = parts.repartition(n).mapInArrow(add, "v binary")
    rows = parts.toArrow().column(0).to_pylist()
    return sum(np.frombuffer(x, dtype) for x in rows[1:]) + np.frombuffer(rows[0], dtype) if rows else None


def common_length(item: list[int], region: np.ndarray) -> int:
    """Length of the longest common subsequence, one machine-independent bit per word of the item."""
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in region.tolist():
        if m := at.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Block:
    """Up to ``most`` items, their words numbered."""

    def __init__(self, items: list[tuple[int, str]]):
        tokens = [(i, words(t)) for i, t in items]
        self.items = [(i, ws) for i, ws in tokens if ws]
        vocabulary = sorted({w for _, ws in self.items for w in ws})
        if len(vocabulary) >= OTHER:
            raise ValueError("a block's items have too many different words; use smaller blocks")
        self.number = {w: n for n, w in enumerate(vocabulary)}
        self.coded = [(i, [self.number[w] for w in ws]) for i, ws in self.items]
        self.size = len(vocabulary)

    def weigh(self, df: np.ndarray, chunks: int, most_df: float = 0.05, least: int = 5) -> np.ndarray:
        """IDF of a word by its occurrences per chunk. Words with over ``most_df`` of them count for nothing, but for items that would keep under ``least`` different ones."""
        idf = np.log1p(chunks / np.maximum(df, 1)).astype(np.float32)
        common = df > most_df * chunks
        keep = np.zeros(self.size, bool)
        for _, ws in self.coded:
            if len({w for w in ws if not common[w]}) < least:
                keep[ws] = True
        return np.where(common & ~keep, 0, idf).astype(np.float32)

    def vectors(self, idf: np.ndarray, unit: bool = True) -> np.ndarray:
        out = np.zeros((len(self.coded), self.size), np.float32)
        for row, (_, ws) in zip(out, self.coded):
            np.add.at(row, ws, idf[ws])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9) if unit else out


def chunked(ids: np.ndarray, idf: np.ndarray, table: np.ndarray):
    """(positions that count, their chunk, chunk sums of rows of the weighted table, sum of squared weights per chunk)."""
    n = max(1, -(-len(ids) // CHUNK))
    pos = np.flatnonzero(ids != OTHER)
    pos = pos[idf[ids[pos]] > 0]
    chunk = pos // CHUNK
    sums = np.zeros((n, table.shape[1]), np.float32)
    squares = np.zeros(n, np.float32)
    if len(pos):
        starts = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
        w = idf[ids[pos]]
        sums[chunk[starts]] = np.add.reduceat(table[ids[pos]], starts)
        squares[chunk[starts]] = np.add.reduceat(w * w, starts)
    return pos, chunk, sums, squares


def pieces(item: list[int], table: np.ndarray) -> np.ndarray:
    """Sums of rows of the weighted table over the whole item and, if it is LONG, over pieces of a passage's length that cover it, half a chunk apart."""
    rows = table[item]
    if len(item) <= LONG:
        return rows.sum(axis=0, keepdims=True)
    total = np.concatenate((np.zeros((1, rows.shape[1]), np.float64), np.cumsum(rows, axis=0, dtype=np.float64)))
    starts = np.append(np.arange(0, len(item) - 2 * CHUNK, CHUNK // 2), len(item) - 2 * CHUNK)
    return np.concatenate((total[-1:], total[starts + 2 * CHUNK] - total[starts])).astype(np.float32)


def passages(x: np.ndarray) -> np.ndarray:
    """Sums of neighbouring chunks; a single chunk is a passage by itself."""
    return x if len(x) == 1 else x[:-1] + x[1:]


def right_space(z: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of A from Z = A^T A Omega, by the single-pass Nystrom form."""
    z, omega = z.astype(np.float64), omega.astype(np.float64)
    nu = 1e-7 * np.linalg.norm(z)
    z = z + nu * omega
    core = omega.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-10 * values.max()
    u, s, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return u[:, : min(rank, int((s > 1e-6 * s[0]).sum()))].astype(np.float32)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    block_items: int = 256,
    rank: int = 112,
    oversample: int = 16,
    least_cosine: float = 0.4,
    least_cover: float = 0.2,
    verbatim: float = 0.8,
    paraphrase: float = 0.5,
    answer_words: int = 8,
    seed: int = 13,
) -> DataFrame:
    """(doc_id, item_id, lcs, answer, cosine): which texts hold a benchmark item, whole or paraphrased.

    lcs is the longest common subsequence of the item's words with a stretch of the text 1.25 times as long (at
    least 8 words longer), as a share of the item, or that of its words without the common ones if it is less; answer
    the same of its last ``answer_words`` such words, where the answer stands. Nearer passages are tried first, until one is ``verbatim``. A passage is a candidate for an item if their latent cosine is ``least_cosine`` or more and the passage holds
    ``least_cover`` of the item's latent weight, so that one shared word doesn't make one; for an item of over LONG words, of which a
    passage can hold but a part, also if both hold for one of its pieces. From lcs >= ``verbatim`` it is a leak, from ``paraphrase`` on if the answer is there by half or more; of an item's stretches
    that are, the one with the highest lcs is given. Every passage of every
    text is compared with all items, in blocks of ``block_items``. Items without words match nothing; null and empty texts have none.
    Rows don't depend on each other but for the statistics: a repeated row gives its matches again; empty tables give an
    empty result; further columns are ignored. The driver holds a block's items and one matrix of its words by rank.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    stages = Stages(spark, "leaks")
    schema = "doc_id long, item_id long, lcs double, answer double, cosine double"
    out = spark.createDataFrame([], schema)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def leak(lcs: float, answer: float) -> bool:
        return lcs >= verbatim or lcs >= paraphrase and answer >= 0.5

    def of_block(block: Block) -> DataFrame | None:
        number, size = block.number, block.size

        def code(batches):
            df, chunks = np.zeros(size + 1, np.float64), 0
            for batch in batches:
                coded = []
                for text in batch.column(1).to_pylist():
                    ws = words(text)
                    ids = np.fromiter(map(number.get, ws, repeat(OTHER)), np.uint16, len(ws))
                    df[:size] += np.bincount(ids, minlength=OTHER + 1)[:size]
                    chunks += -(-len(ws) // CHUNK)
                    coded.append(ids.tobytes())
                n = len(coded)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "ids": pa.array(coded, pa.binary()), "v": pa.nulls(n, pa.binary())})
            df[size] = chunks
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(1, pa.int64()), "ids": pa.nulls(1, pa.binary()), "v": pa.array([df.tobytes()], pa.binary())})

        coded = stages.keep(source.mapInArrow(code, "doc_id long, ids binary, v binary"), "coded")
        df = tree_sum(coded.where("v IS NOT NULL").select("v"), np.float64)
        if df is None or df[size] == 0:
            return None
        texts = coded.where("ids IS NOT NULL").select("doc_id", "ids")
        idf = block.weigh(df[:size], df[size])
        width = min(size, rank + oversample)
        # drawn alike wherever it is drawn again
        omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0].astype(np.float32)

        weighted = omega * idf[:, None]

        def sketch(batches):
            z, held, rows = np.zeros((size, width), np.float32), [], 0

            def flush():
                nonlocal held, rows
                if held:
                    idx = np.concatenate([h[0] for h in held])
                    g = np.concatenate([h[1] for h in held])
                    order = np.argsort(idx, kind="stable")
                    idx = idx[order]
                    starts = np.flatnonzero(np.concatenate(([True], idx[1:] != idx[:-1])))
                    z[idx[starts]] += np.add.reduceat(g[order], starts) * idf[idx[starts]][:, None]
                    held, rows = [], 0

            for batch in batches:
                for x in batch.column(1):
                    ids = np.frombuffer(x.as_buffer(), np.uint16)
                    pos, chunk, sums, squares = chunked(ids, idf, weighted)
                    if len(pos):
                        y = passages(sums) / np.maximum(passages(squares), 1e-9)[:, None]
                        g = np.zeros_like(sums)
                        g[: len(y)] += y
                        g[len(sums) - len(y) :] += y if len(sums) > 1 else 0
                        for at in range(0, len(pos), 16384):
                            held.append((ids[pos[at : at + 16384]], g[chunk[at : at + 16384]]))
                            rows += len(held[-1][0])
                            if rows >= 16384:
                                flush()
            flush()
            yield pa.RecordBatch.from_pydict({"v": pa.array([z.tobytes()], pa.binary())})

        z = tree_sum(texts.mapInArrow(sketch, "v binary"), np.float32).reshape(size, width)
        own = block.vectors(idf)
        # the items weigh as much as all passages together, so that the space tells them apart
        weight = 2 * df[size] / max(1, len(own))
        space = right_space(z + weight * (own.T @ (own @ omega)), omega, rank)
        items, projected = block.coded, space * idf[:, None]
        parts = [pieces(ws, projected) for _, ws in items]
        query, item_of = np.concatenate(parts), np.repeat(np.arange(len(items)), [len(p) for p in parts])
        lengths = np.maximum(np.linalg.norm(query, axis=1), 1e-9)
        query /= lengths[:, None]
        # words that count in vectors; common ones alone make no leak
        counts = np.concatenate((idf > 0, np.zeros(OTHER + 1 - size, bool)))
        content = [[w for w in ws if idf[w] > 0] for _, ws in items]
        answers = [ws[-answer_words:] for ws in content]

        def search(batches):
            member = np.zeros((len(items), OTHER + 1), bool)  # which words each item has
            for k, (_, item) in enumerate(items):
                member[k, item] = True
            for batch in batches:
                found = []
                for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = np.frombuffer(x.as_buffer(), np.uint16)
                    p = passages(chunked(ids, idf, projected)[2])
                    norm = np.linalg.norm(p, axis=1)
                    rows = np.flatnonzero(norm > 1e-6)
                    if not len(rows):
                        continue
                    near = []
                    several = max(1, CELLS // len(query))
                    for first in range(0, len(rows), several):
                        some = rows[first : first + several]
                        along = p[some] @ query.T
                        cos = along / norm[some][:, None]
                        r, q = np.nonzero((cos >= least_cosine) & (along >= least_cover * lengths))
                        near.append((r + first, item_of[q], cos[r, q]))
                    r, k, cos = map(np.concatenate, zip(*near))
                    order = np.argsort(-cos, kind="stable")
                    best: dict[int, tuple] = {}  # only stretches that are leaks
                    tried = set()
                    for r, k, cosine in zip(r[order].tolist(), k[order].tolist(), cos[order].tolist()):
                        if best.get(k, (0,))[0] >= verbatim or (r, k) in tried:
                            continue
                        tried.add((r, k))
                        item = items[k][1]
                        length = max(len(item) + 8, len(item) * 5 // 4)
                        begin = int(rows[r]) * CHUNK
                        low, high = max(0, begin - length), min(len(ids), begin + 2 * CHUNK + length)
                        part = ids[low:high]
                        shared = member[k, part]
                        if shared.sum() < paraphrase * len(item):
                            continue
                        step = max(1, len(item) // 4)
                        for at in range(0, max(1, len(part) - length + step), step):
                            stretch = part[at : at + length]
                            if shared[at : at + length].sum() < max(paraphrase * len(item), best.get(k, (0,))[0] * len(item)):
                                continue
                            telling = stretch[counts[stretch]]
                            lcs = min(common_length(item, stretch) / len(item), common_length(content[k], telling) / len(content[k]))
                            if lcs >= paraphrase and lcs > best.get(k, (0,))[0]:
                                answer = common_length(answers[k], telling) / len(answers[k])
                                if leak(lcs, answer):
                                    best[k] = (lcs, answer, cosine)
                    found += [(doc_id, items[k][0], *b) for k, b in best.items()]
                cols = list(zip(*found)) if found else [[]] * 5
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("doc_id", "item_id", "lcs", "answer", "cosine"), cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))})

        return texts.mapInArrow(search, schema)

    waiting: list[tuple[int, str]] = []
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        waiting.append((r["item_id"], r["text"]))
        if len(waiting) == block_items:
            got, waiting = of_block(Block(waiting)), []
            out = out if got is None else out.unionByName(got)
    if waiting and (got := of_block(Block(waiting))) is not None:
        out = out.unionByName(got)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents without those that hold a benchmark item; all columns stay. Rows go by (doc_id, text), so that repeats go together."""
    keyed = find_leaks(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), benchmark, **kw).select(F.col("doc_id").alias("rk")).distinct()
    keyed = Stages(docs.sparkSession, "leaked").keep(keyed, "rows")
    d = docs.alias("d")
    return d.join(keyed.alias("k"), F.xxhash64("d.doc_id", "d.text") == F.col("k.rk"), "left_anti")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    from .common import documents, spread

    return find_leaks(spread(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
