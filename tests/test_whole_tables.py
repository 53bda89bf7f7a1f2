"""Queries without SQL that once read a part of their table, against all of it."""

import duckdb
import numpy as np

from tessera.operators import study as S
from tessera.plans import catalog


def test_rsa_permutation_compares_all_labels(spark, sf_dir):
    rows = duckdb.sql(f"SELECT label, embedding FROM '{sf_dir}/embeddings.parquet'").fetchall()

    def sims(cut):
        # a label's mean is that of its vectors as they are
        m = [np.mean([np.array(v, float)[cut] for label, v in rows if label == k], axis=0) for k in sorted({label for label, _ in rows})]
        v = np.stack([x / np.linalg.norm(x) for x in m])
        return v @ v.T

    want = S.rsa_permutation(sims(slice(0, 32)), sims(slice(32, 64)))
    got = catalog.QUERIES["rsa_permutation"](spark, sf_dir).first()
    assert len({label for label, _ in rows}) == 10
    assert got["n_perms"] == want["n_perms"] == 1000
    assert abs(got["rho"] - want["rho"]) < 2e-4 and abs(got["p"] - want["p"]) < 2e-3


def test_word2vec_neighbors_has_the_words_of_all_english_documents(spark, sf_dir):
    words = duckdb.sql(f"SELECT count(*) FROM (SELECT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM '{sf_dir}/documents.parquet' WHERE lang = 'en') GROUP BY w HAVING count(*) >= 10)").fetchall()[0][0]
    got = catalog.QUERIES["word2vec_neighbors"](spark, sf_dir)
    assert got.select("q").distinct().count() == words > 0
