"""Near pairs of vectors of few dimensions: all found, and filters for a vector stay few."""

import numpy as np
import pytest

from folioscope.llm import embedding_dedup


def brute(vectors, threshold=0.9):
    x = np.array(vectors)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        least = np.minimum(root, np.where(near, root[None, :], len(x)).min(axis=1))
        least = least[least]
        if (least == root).all():
            return near.sum(axis=1), root
        root = least


@pytest.mark.parametrize(("dim", "n"), [(1, 40), (2, 300), (3, 1500), (4, 600), (6, 500), (8, 500)])
def test_few_dimensions(spark, dim, n):
    r = np.random.default_rng(dim)
    vectors = r.normal(size=(n, dim)).tolist()
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.links(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()}
    count, root = brute(vectors)
    found = np.array([got[i][0] for i in range(n)])
    assert (found <= count).all() and found.sum() >= 0.99 * count.sum()
    if (found == count).all():
        assert [got[i][1] for i in range(n)] == root.tolist()


@pytest.mark.parametrize("dim", [1, 2, 3, 4, 5, 8, 12])
@pytest.mark.parametrize("n", [1000, 10**6, 10**8])
def test_filters_of_a_vector_stay_few(dim, n):
    x = np.random.default_rng(1).normal(size=(300, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = embedding_dedup.Code(dim, n, 0)
    assert np.bincount(code.decode(x)[0], minlength=300).mean() < 60
    assert embedding_dedup.codes_needed(dim, n, 0.9) <= 40


@pytest.mark.parametrize(("dim", "n", "most"), [(64, 10**6, 55), (64, 10**8, 110), (768, 10**8, 110), (1536, 10**8, 110)])
def test_rows_of_a_vector_are_bounded(dim, n, most):
    """Filters of all codes together, and filters that hold some hundred unrelated vectors."""
    x = embedding_dedup.pairs_at(dim, 0.9, 200, 7)[0]
    code = embedding_dedup.Code(dim, n, 0)
    of_one_code = len(code.decode(x)[0]) / len(x)
    assert embedding_dedup.codes_needed(dim, n, 0.9) * of_one_code < most
    assert n * of_one_code / code.words < 300


@pytest.mark.parametrize("slab", [3, 4096])
def test_shared_filters_are_counted_once(spark, monkeypatch, slab):
    """Groups of near vectors above and below the size from which matrices are used; each link counts once."""
    monkeypatch.setattr(embedding_dedup, "SLAB", slab)
    r = np.random.default_rng(11)
    base = r.normal(size=(14, 24))
    sizes = [40, 25, *[4] * 12]
    vectors = np.concatenate([b + 0.05 * r.normal(size=(k, 24)) for b, k in zip(base, sizes, strict=True)]).tolist()
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.links(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()}
    count, root = brute(vectors)
    assert [got[i] for i in range(len(vectors))] == list(zip(count.tolist(), root.tolist(), strict=True))
