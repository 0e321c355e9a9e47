"""Near-duplicate embeddings and exact top-k against brute force."""

import collections
import heapq

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larderflow.llm import near_vectors, topk, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def planted(n=400, dims=16, seed=0):
    """Random vectors in clusters, near copies of some at several distances, exact copies in a large group."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    x = centres[r.integers(6, size=n)] + 0.7 * r.normal(size=(n, dims))
    near = [v / np.linalg.norm(v) + s * r.normal(size=dims) / dims**0.5 for v in x[:120] for s in (0.05, 0.2, 0.3)]
    return np.concatenate([x, near, np.repeat(x[:1], 60, axis=0)]).astype(np.float32)


def frame(spark, x, extra=()):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as data", "'x' as node", "cast(null as int) as cell", "3 as rank", "4 as query")


ODD = [(None, [1.0] * 16, 0), (9000, None, None), (9001, [0.0] * 16, 0), (9002, [float("nan")] * 16, 0), (9003, [1.0, None] + [0.0] * 14, 0), (9004, [1.0] * 15, 0), (9005, [], 0), (9006, [1e30] + [float("inf")] * 15, 0)]


def brute_groups(x, t):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= t
    label = np.arange(len(x))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    n = np.bincount(label, minlength=len(x))
    links = near[:, np.unique(x, axis=0, return_index=True)[1]].sum(1) - 1
    return {(i, int(g), int(n[g]), int(links[i])) for i, g in enumerate(label) if n[g] > 1}, near


@pytest.mark.parametrize("recall", [0.99, 1.0])
def test_near_groups(spark, recall):
    x = planted()
    df = frame(spark, x, ODD + [(5, x[5].tolist(), 1), (5, x[5].tolist(), 1)])
    got = {tuple(r) for r in near_vectors.groups(df, recall=recall, per_cell=4).collect()}
    want, near = brute_groups(x, near_vectors.THRESHOLD)
    if recall == 1:
        assert got == want
    root = {i: g for i, g, *_ in got}
    every = sum(links for *_, links in want)
    assert 0.9 * every <= sum(links for *_, links in got) <= every
    i, j = np.nonzero(np.triu(near, 1))
    found = [root.get(a, -1) == root.get(b, -2) for a, b in zip(i.tolist(), j.tolist())]
    assert len(found) > 300 and np.mean(found) >= 0.9
    # nothing is grouped that isn't connected
    true = {i: g for i, g, *_ in want}
    assert all(true.get(i) == true.get(g) for i, g in root.items())


def test_near_groups_of_little(spark):
    assert near_vectors.groups(frame(spark, np.zeros((0, 4), np.float32))).collect() == []
    assert near_vectors.groups(frame(spark, np.zeros((3, 4), np.float32))).collect() == []
    assert len(near_vectors.groups(frame(spark, np.ones((3, 4), np.float32))).collect()) == 3


@given(st.lists(st.floats(0, 9), min_size=1, max_size=6), st.lists(st.floats(0, 9), min_size=1, max_size=6), st.floats(0, 12))
@settings(max_examples=100, deadline=None)
def test_traversal_is_in_order_and_whole(a, b, limit):
    a, b = np.array(sorted(a)), np.array(sorted(b))
    cells = near_vectors.traverse(a, b, limit)
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums)
    assert set(cells) == {(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] + b[j] <= limit}


def brute_topk(x, k):
    u = x.astype(np.float64)
    s = np.round(u @ u.T, topk.DIGITS)
    return {(i, r + 1, j) for i in range(len(x)) for r, (_, j) in enumerate(heapq.nsmallest(k, ((-s[i, j], j) for j in range(len(x)) if j != i)))}


@pytest.mark.parametrize("block", [64, 1000])
def test_topk_is_exact(spark, block):
    x = planted(200)
    x[50] = 0  # a query that scores all alike
    odd = [r for r in ODD if r[0] != 9001]
    df = frame(spark, x, odd + [(7, x[7].tolist(), 0)])
    got = topk.search(df, k=5, block=block, every=1).collect()
    assert {(r["vec_id"], r["rank"], r["neighbour_id"]) for r in got} == brute_topk(x, 5)
    some = topk.search(df, k=5, block=block, every=50).collect()
    assert {(r["vec_id"], r["rank"], r["neighbour_id"]) for r in some} == {t for t in brute_topk(x, 5) if t[0] % 50 == 0} and len(some) == 5 * len({t[0] for t in brute_topk(x, 5) if t[0] % 50 == 0})
    assert max(collections.Counter((r["vec_id"], r["rank"]) for r in got).values()) == 1


def test_topk_of_little(spark):
    assert topk.search(frame(spark, np.zeros((0, 4), np.float32))).collect() == []
    x = np.eye(3, dtype=np.float32)
    assert {(r["vec_id"], r["rank"], r["neighbour_id"]) for r in topk.search(frame(spark, x), every=1).collect()} == brute_topk(x, 2)


def test_threshold_stops_early_where_it_can():
    """Vectors with one strong dimension: the bound falls under the kth score before the lists are read to the end."""
    r = np.random.default_rng(1)
    x = (r.normal(size=(4000, 4)) * [1, 0.01, 0.01, 0.01]).astype(np.float32)
    q = np.array([[1, 0.01, -0.01, 0]], dtype=np.float32)
    row, col, score, seen = topk.threshold_search(q, topk.Lists(np.arange(len(x)), x), 5, np.full(1, -np.inf))
    top = set(np.argsort(-(x.astype(np.float64) @ q[0].astype(np.float64)))[:5].tolist())
    assert top <= set(col.tolist()) and seen[0] < 0.5


def test_codebook_centres_are_means(spark):
    x = np.array([[0, 0], [0, 2], [10, 0], [10, 2]], dtype=np.float32)
    v = vectors.rows(frame(spark, x), "vec_id", "embedding", 2, False)
    c = vectors.codebook(v, 2, slice(0, 2), 2, 8)
    assert len(c) == 2
    own = vectors.nearest(x, c)
    for k in set(own.tolist()):
        assert np.allclose(c[k], x[own == k].mean(0))
