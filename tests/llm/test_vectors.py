"""Nearest neighbours and linked vectors against brute force."""

import numpy as np
import pytest
from helpers import smallest_reachable

from docfields.llm import blocks, polytope


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, x array<float>, label int")


AWKWARD = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [float("inf")] * 16), (904, [None] + [1.0] * 15), (905, [])]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 16)).astype(np.float32)
    x[20:60] = x[20] + rng.normal(scale=0.15, size=(40, 16))  # a crowd
    x[70:75] = x[70]  # copies
    x[80] = x[70] * 3
    return {i * 3: v.tolist() for i, v in enumerate(x)}


def nearest(vectors, queries, k):
    out = []
    for q in queries:
        best = sorted(((sum(float(a) * float(b) for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q), key=lambda s: (-s[0], s[1]))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(best[:k])]
    return out


@pytest.mark.parametrize("tiles", [(2048, 16384), (5, 11)])
def test_search_is_exact(spark, vectors, tiles):
    rows = table(spark, [*vectors.items(), *AWKWARD, (999, [1.0, 2.0])])
    queries = rows.filter("vec_id % 20 = 0")
    got = [tuple(r) for r in blocks.search(queries, rows, 20, *tiles).collect()]
    want = nearest(vectors, [i for i in vectors if i % 20 == 0], 20)
    assert sorted(r[:3] for r in got) == sorted(r[:3] for r in want)
    assert sorted(r[3] for r in got) == pytest.approx(sorted(r[3] for r in want), abs=1e-12)


@pytest.mark.parametrize("tiles", [(2048, 16384), (2, 2)])
def test_repeated_queries_are_one(spark, tiles):
    """Two rows of one vec_id, equal or not, are one query and two candidates, whatever the size of the tiles."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.5, 0.1])]
    got = sorted(tuple(r) for r in blocks.search(table(spark, [r for r in rows if r[0] in (0, 2)]), table(spark, rows), 3, *tiles).collect())
    assert got == [(0, 1, 2, 2.0), (0, 2, 2, 2.0), (0, 3, 1, 1.0), (2, 1, 1, 5.0), (2, 2, 0, 2.0), (2, 3, 0, 1.0)]


def test_search_with_few_candidates_and_none(spark):
    rows = table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])])
    got = sorted(tuple(r)[:3] for r in blocks.search(rows.filter("vec_id = 0"), rows, 20).collect())
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert blocks.search(rows.limit(0), rows, 20).count() == 0
    assert blocks.search(rows, rows.limit(0), 20).count() == 0


@pytest.mark.parametrize("block", [2048, 9])
def test_links_match_brute_force(spark, vectors, block):
    x = np.array(list(vectors.values()), float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    ids = list(vectors)
    links = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near)) if i < j]
    heads = smallest_reachable(ids, links)
    rows = table(spark, [*vectors.items(), *AWKWARD, *list(vectors.items())[:5]])
    got = {r.vec_id: (r.n_links, r.component_id) for r in polytope.link(rows, block=block).collect()}
    assert got == {i: (int(near[n].sum()) - 1, heads[i]) for n, i in enumerate(ids)}


def test_query_gives_every_row(spark, vectors, tmp_path):
    rows = table(spark, [(None, [1.0] * 16), (1, None), (2, [1.0] * 16), (4, [2.0] * 16)]).withColumnRenamed("x", "embedding")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in polytope.op4_embedding_near_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(None, 0, None, True), (1, 0, 1, True), (2, 1, 2, True), (4, 1, 2, False)], key=repr)
    assert polytope.link(table(spark, [])).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(polytope.hadamard(x), axis=1), 8 * np.linalg.norm(x, axis=1))


def test_chance_to_meet():
    """Pairs at cosine 0.95 meet in some table."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * z
    t = polytope.tables_for(3)
    (oa, pa), (ob, pb) = polytope.buckets(a, t, 3), polytope.buckets(b, t, 3)
    assert polytope._meet(oa, pa, ob, pb).any(1).mean() >= 0.999
