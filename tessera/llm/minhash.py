"""Near-duplicate documents by circulant MinHash."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import links
from .common import Stages, maybe_in

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: 48 bands of 6 rows: a pair at the threshold 0.8 is missed with a probability of 5e-7, one of
#: similarity 0.3 compared with one of 0.03.
BANDS, ROWS = 48, 6


class _Numbers(dict):
    """64-bit number of each word, remembered while there is room."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return n


_numbers = _Numbers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit numbers of the distinct word shingles; with fewer words than ``width`` the whole sequence is one; none without words."""
    words = WORDS.findall((text or "").translate(A_TO_Z))
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_numbers.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out + h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out)


def signature(s: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """``count`` coordinates from two permutations of the 32-bit numbers.

    The first scatters the shingles once; coordinate k is the least image under the second
    after a circular shift by k.
    """
    first = (mixed(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    shift = np.arange(count, dtype=np.uint32)[:, None]
    for at in range(0, len(first), 256):
        x = first[None, at : at + 256] + shift  # wraps around: the shift is circular
        x *= np.uint32(0x9E3779B1)
        y = x >> np.uint32(15)
        x ^= y
        x *= np.uint32(0x85EBCA77)
        np.right_shift(x, np.uint32(13), out=y)
        x ^= y
        x *= np.uint32(0xC2B2AE3D)
        np.minimum(out, x.min(1), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, its number mixed in."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key + rows[:, i]) * np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def set_id(s: np.ndarray) -> int | None:
    """A 63-bit number of the whole set; None if it is empty."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1 if len(s) else None


def _pairs_at_least(percent: int):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            a, b, keep = batch.column(2), batch.column(3), []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate((x, y))
                both.sort()
                n = int((both[1:] == both[:-1]).sum())
                if 100 * n >= percent * (len(x) + len(y) - n):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in (batch.column(0), batch.column(1))], ["a", "b"])

    return run


def linked_in_blocks(rows: DataFrame, sets: DataFrame, groups: DataFrame, percent: int, most: int = 1 << 20, nodes_at_once: int = links.PART, blocks_at_once: int = 32) -> DataFrame:
    """Edges that connect all linked nodes of the rows (bucket, node, comp).

    A group of nodes that share buckets, directly or through others (groups: node, comp), is dealt to blocks of about ``most`` shingles or
    ``nodes_at_once`` nodes at most, of which every two meet in one task. Of a group of over ``blocks_at_once`` blocks, which has mostly nodes that share no
    bucket, each bucket is dealt so; links between nodes that share a bucket are found either way. A task counts all intersections by multiplying incidence matrices and gives one edge
    per node that is linked to another, whatever the number of links.
    """
    import pyarrow as pa

    blocks = F.greatest(F.ceil(F.sum("n") / most), F.ceil(F.count(F.lit(1)) / nodes_at_once)).cast("int")
    size = sets.select(F.col("cls").alias("node"), (F.length("words") / 8).alias("n"))
    around = groups.withColumnRenamed("comp", "grp")
    of_group = around.join(size, "node").groupBy("grp").agg(blocks.alias("blocks"))
    whole = rows.select("node", "comp").distinct().join(around.join(of_group.where(F.col("blocks") <= blocks_at_once), "grp"), "node")
    beyond = around.join(of_group.where(F.col("blocks") > blocks_at_once), "grp").select("node")
    large = rows.join(beyond, "node").select(F.xxhash64("bucket", F.lit(2)).alias("grp"), "node", "comp")
    of_bucket = large.join(size, "node").groupBy("grp").agg(blocks.alias("blocks"))
    nodes = whole.select("grp", "node", "comp", "blocks").unionByName(large.join(of_bucket, "grp"))
    nodes = nodes.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    met = nodes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("grp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "comp")
    met = met.join(sets.withColumnRenamed("cls", "node"), "node")
    met = met.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y")

    def edges_of(group: list[dict]) -> list[tuple[int, int]]:
        if len({r["comp"] for r in group}) < 2:
            return []
        size = np.array([len(r["words"]) // 8 for r in group], np.int64)
        tokens = np.frombuffer(b"".join(r["words"] for r in group), np.uint64)
        doc = np.repeat(np.arange(len(group)), size)
        _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
        number = np.cumsum(count > 1) - 1  # a shingle of one set only meets nothing
        keep = count[column] > 1
        doc, column = doc[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        doc, column = doc[order], column[order]
        both = np.zeros((len(group), len(group)), np.float32)
        width = max(64, min(4096, (16 << 20) // (4 * len(group))))
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            low, high = np.searchsorted(column, (at, at + width))
            m = np.zeros((len(group), width), np.float32)
            m[doc[low:high], column[low:high] - at] = 1
            both += m @ m.T
        # whole numbers below 2^24 are exact here, and so is the comparison in float64, row by row
        link = np.stack([100.0 * row >= percent * (n + size - row.astype(np.float64)) for row, n in zip(both, size)])
        del both
        np.fill_diagonal(link, True)
        comp = np.array([r["comp"] for r in group])
        # labels spread over links and over what was connected before
        label = np.unique(comp, return_inverse=True)[1]
        while True:
            new = np.array([label[row].min() for row in link])
            least = np.full(label.max() + 1, len(group))
            np.minimum.at(least, label, new)
            if (least[label] == label).all():
                break
            label = least[label]
        first: dict[int, int] = {}
        return [(int(r["node"]), first[k]) for r, k in zip(group, label) if first.setdefault(k, int(r["node"])) != r["node"]]

    def run(batches):
        held, key = [], None

        def out(group):
            e = edges_of(group)
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in e], pa.int64()), "b": pa.array([y for _, y in e], pa.int64())})

        for batch in batches:
            for r in batch.to_pylist():
                if (now := (r["grp"], r["x"], r["y"])) != key:
                    if held:
                        yield out(held)
                    held, key = [], now
                held.append(r)
        if held:
            yield out(held)

    return met.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Documents with equal sets form one class at once; of each class one set is banded and compared, so
    that copies cost no comparisons. Links are confirmed on full sets (64-bit numbers of the shingles).
    Returns doc_id, n_shingles, component_id (least doc_id of the group), kept (doc_id is component_id).
    Texts that are null or have no words have no shingles and are linked with nothing. Repeated rows
    share their group and its flag; a null doc_id can be linked but is never a component_id, unless the group has no other:
    then component_id is null and kept true. An empty table gives an empty result; further columns are ignored.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    stages = Stages(spark, "minhash")
    nowhere = -(2**63)  # stands for a null id in joins
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(nowhere)).alias("id"), "text")

    def signed(batches):
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            keys = [bands(signature(s)).tobytes() if len(s) else b"" for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(k) // 8 for k in keys)]), pa.int32()), pa.array(np.frombuffer(b"".join(keys), np.int64)))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n": pa.array([len(s) for s in sets], pa.int64()), "cls": pa.array([set_id(s) for s in sets], pa.int64()), "bands": lists})

    rows = stages.keep(docs.mapInArrow(signed, "id long, n long, cls long, bands array<long>"), "signed")
    # the least id that isn't null stands for its class
    real = F.when(F.col("id") != nowhere, F.col("id"))
    classes = stages.keep(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min(real).alias("least"), F.min("id").alias("any_id"), F.first("bands").alias("bands")), "classes")
    members = links.shared(stages, classes.select(F.explode("bands").alias("bucket"), F.col("cls").alias("node")))

    # full sets, of what shares a bucket only
    wanted = stages.keep(members.select("node").distinct().join(classes, F.col("node") == F.col("cls")).select(F.coalesce("least", F.lit(nowhere)).alias("id"), "cls"), "wanted")

    def full(batches):
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"cls": pa.array([set_id(s) for s in sets], pa.int64()), "words": pa.array([s.tobytes() for s in sets], pa.binary())})

    ids = wanted.select("id").distinct().withColumnRenamed("id", "node")
    texts = maybe_in(docs.withColumnRenamed("id", "node"), ids).join(ids, "node").select("text").mapInArrow(full, "cls long, words binary")
    sets = stages.keep(texts.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        x = pairs.join(sets.select(F.col("cls").alias("a"), F.col("words").alias("wa")), "a")
        x = x.join(sets.select(F.col("cls").alias("b"), F.col("words").alias("wb")), "b")
        return x.select("a", "b", "wa", "wb").mapInArrow(_pairs_at_least(percent), "a long, b long")

    def rest(rows: DataFrame) -> DataFrame:
        # nodes that share buckets directly or through others
        of = rows.groupBy("bucket").agg(F.min("node").alias("b"))
        groups = stages.keep(links.components(stages, rows.join(of, "bucket").select(F.col("node").alias("a"), "b")), "around")
        return linked_in_blocks(rows, sets, groups, percent)

    comp = links.link(stages, members, verify, rest, rounds=1)
    if comp is None:
        root = classes.select("cls", F.col("least").alias("component_id"))
    else:
        of = classes.select("cls", "least").join(comp, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("comp", "cls").alias("comp"))
        root = of.select("cls", "comp").join(of.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("cls", "component_id")
    stages.drop(sets)
    doc_id = F.when(F.col("id") != nowhere, F.col("id"))
    out = rows.select("id", "n", "cls").join(root, "cls", "left").withColumn("component_id", F.when(F.col("cls").isNull(), doc_id).otherwise(F.col("component_id")))
    return out.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", doc_id.eqNullSafe(F.col("component_id")).alias("kept"))


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    from .common import documents, spread

    return near_duplicates(spread(documents(spark, sf_dir)), width=2)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh
  FROM w WHERE len(ws) > 0
), n AS (
  SELECT doc_id, len(sh) AS n FROM s
), e AS MATERIALIZED (
  SELECT doc_id, unnest(sh) AS g FROM s
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared_n FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared_n >= 80 * (x.n + y.n - shared_n)
), both_ways AS MATERIALIZED (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT doc_id AS node, doc_id AS to_ FROM documents
  UNION
  SELECT node, b FROM reach JOIN both_ways ON to_ = a
), c AS (
  SELECT node, min(to_) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON d.doc_id = node
"""
