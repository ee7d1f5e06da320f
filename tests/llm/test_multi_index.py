"""Embedding links against brute force, on planted pairs in a grid of many cells."""

import numpy as np
import pyarrow as pa

from changewright.llm import multi_index
from changewright.llm.multi_index import COSINE, near_vectors

#: Small cells, so that the grids of these tables have many.
PER_CELL = 16


def unit(x):
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def partners(rng, x, low=0.935, high=0.99):
    """A vector at a cosine of ``low`` to ``high`` from each row, in a random direction."""
    u = rng.normal(size=x.shape)
    u = unit(u - (u * x).sum(axis=1, keepdims=True) * x)
    c = rng.uniform(low, high, (len(x), 1))
    return c * x + np.sqrt(1 - c * c) * u


def found(spark, x, label=None):
    x = x.astype(np.float32)
    label = np.zeros(len(x), np.int32) if label is None else label
    table = pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(label, pa.int32())})
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(spark.createDataFrame(table).repartition(4), per_cell=PER_CELL).collect()}


def components(near):
    """Least member of every vector's component, by passing labels on."""
    root = np.arange(len(near))
    while True:
        low = np.array([root[n].min(initial=r) for n, r in zip(near, root, strict=True)])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def found_and_true(spark, x):
    """Links of every vector as found and by brute force."""
    x = x.astype(np.float32)
    assert round((len(x) / PER_CELL) ** 0.5) > 10  # codewords a half
    table = pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(np.zeros(len(x), np.int32))})
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame(table).repartition(4), per_cell=PER_CELL).select("vec_id", "n_links").collect()}
    y = unit(x.astype(float))
    near = np.concatenate([(y[i : i + 500] @ y.T >= COSINE).sum(axis=1) for i in range(0, len(y), 500)]) - 1
    return np.array([got[i] for i in range(len(x))]), near


def test_rare_pairs_are_found(spark, monkeypatch):
    """Few rows have a partner, so the measured sample (small here) sees none of them."""
    monkeypatch.setattr(multi_index, "QUERIES", 8)
    rng = np.random.default_rng(0)
    x = unit(rng.normal(size=(8_000, 64)))
    x[:20] = partners(rng, x[20:40])
    got, true = found_and_true(spark, x)
    assert true.sum() == 40 and (got <= true).all() and got.sum() >= 0.9 * true.sum()


def test_components_of_sparse_and_dense_groups(spark):
    """Pairs, a chain in which only neighbours link, a dense group of one label and its twin of another."""
    rng = np.random.default_rng(1)
    x = unit(rng.normal(size=(4_000, 32)))
    x[:200] = partners(rng, x[200:400])
    turn = np.arccos(0.95)
    for i in range(40):  # neighbours at 0.95, next but one at 0.805
        x[400 + i] = np.cos(turn * i) * np.eye(32)[0] + np.sin(turn * i) * np.eye(32)[1]
    x[500:900] = unit(x[500] + rng.normal(size=(400, 32)) * 0.02)
    x[900:1300] = x[500:900]
    label = np.zeros(len(x), np.int32)
    label[900:1300] = 1
    y = unit(x.astype(np.float32).astype(float))
    same = label[:, None] == label[None]
    linked = (y @ y.T >= COSINE) & same & ~np.eye(len(x), dtype=bool)
    near = [np.flatnonzero(r) for r in linked]
    got = found(spark, x, label)
    n = np.array([got[i][0] for i in range(len(x))])
    true = linked.sum(axis=1)
    assert (n <= true).all() and n.sum() >= 0.9 * true.sum()
    assert (n[:400] > 0).mean() >= 0.9
    root = components(near)
    assert np.mean([got[i][1] == root[i] for i in range(len(x))]) > 0.99
    assert all(got[i][2] == (got[i][1] == i) for i in range(len(x)))
    assert {got[i][1] for i in range(500, 900)} == {500} and {got[i][1] for i in range(900, 1300)} == {900}
    if (n == true).all():
        assert all(got[i][1] == root[i] for i in range(len(x)))
