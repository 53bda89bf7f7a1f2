"""Block products of neighbour queries: memory that doesn't grow with the tables, and the same results however rows are put into blocks."""

import tracemalloc

import numpy as np

from tessera.operators import atlas, nearest as N
from test_operators import as_vectors, space, unit


def test_memory_of_block_products_is_that_of_a_block():
    rng = np.random.default_rng(0)
    q = unit(rng.normal(size=(200, 16)))

    def peak(blocks):
        tracemalloc.start()
        seen = [N._Best(10, True, 1.0, np.arange(200), q), N._Pairs(0.5, 20, np.arange(200), q)]
        for b in range(blocks):
            for x in seen:
                x.see(np.arange(500) + 500 * b, unit(rng.normal(size=(500, 16))), np.zeros(500))
        sizes = [len(x.rows()[0]) for x in seen]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sizes == [2000, 20]
        return most

    assert peak(80) < 1.5 * peak(4)


def test_ties_across_blocks_go_to_the_lower_id(spark, monkeypatch):
    # many equal vectors: a plain sort by rounded score, then id, whatever the blocks
    rng = np.random.default_rng(1)
    m = np.round(rng.normal(size=(90, 4)), 1)[np.arange(270) % 90]
    s = (unit(m) @ unit(m).T).round(12)
    np.fill_diagonal(s, -9)
    want = [(i, int(j), k + 1) for i in range(270) for k, j in enumerate(np.lexsort((np.arange(270), -s[i]))[:7])]
    rows = as_vectors(space(spark, m)).repartition(5)
    monkeypatch.setattr(N, "BLOCK_BYTES", 8 * 4 * 11)
    monkeypatch.setattr(N, "TILE_BYTES", 8 * 77)
    got = N.neighbour_table(rows, 7).orderBy("q", "rnk").collect()
    assert [(r["q"], r["c"], r["rnk"]) for r in got] == want
    monkeypatch.setattr(N, "SIDE_BYTES", 8 * 4 * 40)
    again = N.neighbour_table(rows, 7).orderBy("q", "rnk").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in got]  # to the last bit


def test_doppelgangers_send_as_many_pairs_as_are_asked_for(spark):
    m = np.ones((300, 4)) + np.random.default_rng(2).normal(size=(300, 4)) / 10
    rows = as_vectors(space(spark, m))
    s = unit(m) @ unit(m).T
    i, j = np.triu_indices(300, 1)
    order = np.lexsort((j, i, -s[i, j]))[:5]
    assert [(r["a"], r["b"]) for r in atlas.doppelgangers(rows, 0.3, top=5).collect()] == list(zip(i[order].tolist(), j[order].tolist()))
    assert N.similar_pairs(rows, 0.3, top=5).count() < 2000 < N.similar_pairs(rows, 0.3).count()


def test_isolation_works_the_neighbours_out_once(spark):
    m = np.random.default_rng(3).normal(size=(40, 4))
    lens = atlas.isolation(N.neighbour_table(as_vectors(space(spark, m)), 10), 10, top=6)
    assert lens._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsIn") == 1
    s = unit(m) @ unit(m).T
    np.fill_diagonal(s, -9)
    dist = 1 - np.sort(s, 1)[:, -10]
    got = lens.collect()
    assert [r["vec"] for r in got] == np.argsort(-dist)[:6].tolist() and np.allclose([r["dist"] for r in got], np.sort(dist)[::-1][:6])
    assert [r["nearest"] for r in got] == [np.argsort(-s[r["vec"]])[:5].tolist() for r in got]
