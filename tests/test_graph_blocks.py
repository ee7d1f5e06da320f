"""Large plans are folded block by block first, so that only what crosses a border goes through rounds of joins."""

import random

import pyarrow as pa
import pytest
from test_graph import SCHEMA, chain, kahn, on_cycle, plan

from changewright.operators import graph as G
from changewright.operators import plan_walk as W


@pytest.fixture
def pointers(monkeypatch):
    """Rows of every table of pointers that is followed by doubling."""
    counts, real = [], G._jump
    monkeypatch.setattr(G, "_jump", lambda rows, *a: counts.append(rows.count()) or real(rows, *a))
    return counts


def test_rounds_of_a_chain_take_one_row_a_border(spark, monkeypatch, pointers):
    n = 4000
    monkeypatch.setattr(G, "BLOCK", 500, raising=False)
    df = spark.createDataFrame(chain(n), SCHEMA).cache()
    assert {r.pos: r.level for r in G.deploy_levels(df, local=100).collect()} == {i: i for i in range(n)}
    assert max(pointers, default=0) <= 40


@pytest.mark.parametrize("length", [40, 1200])
def test_ladders_take_few_rounds(spark, monkeypatch, pointers, length):
    n = 1200
    monkeypatch.setattr(G, "BLOCK", 500, raising=False)
    rows = [("t", "p", i, f"c{i}", f"c{i}", [f"c{j}" for j in (i + 1, i + 2) if j < n and j // length == i // length]) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    order, level = kahn(rows)
    if length == 40:
        placed = {r.pos: r.seq for r in G.deploy_order(df, local=100).collect()}
        assert sorted(placed, key=placed.get) == order
    assert {r.pos: r.level for r in G.deploy_levels(df, local=100).collect()} == dict(enumerate(level))
    assert len(pointers) <= 6


def test_a_chain_behind_a_ring_is_folded_away(spark, monkeypatch, pointers):
    monkeypatch.setattr(G, "BLOCK", 500, raising=False)
    df = spark.createDataFrame(chain(4000, ring=100), SCHEMA).cache()
    assert {r.name for r in G.cycles(df, local=10).collect()} == {f"c{i}" for i in range(100)}
    assert max(pointers, default=0) <= 200


@pytest.mark.parametrize("block", [1, 9])
def test_blocks_against_plain_walks(spark, monkeypatch, block):
    monkeypatch.setattr(G, "BLOCK", block)
    rows = plan(3, True) + [("t", "q", *r[2:]) for r in plan(5, True)]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    placed = {(r.project, r.pos): r.seq for r in G.deploy_order(df, local=12).collect()}
    levels = {(r.project, r.pos): r.level for r in G.deploy_levels(df, local=0).collect()}
    for project in ("p3", "q"):
        own = [r for r in rows if r[1] == project]
        order, level = kahn(own)
        assert sorted(range(len(own)), key=lambda i: placed[project, own[i][2]]) == order
        assert [levels[project, r[2]] for r in own] == level


def test_cycles_over_block_borders(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 5)
    rng = random.Random(4)
    rows = [("t", "r", i, f"c{i}", f"c{i}", [f"c{rng.randrange(30)}" for _ in range(rng.randrange(3))]) for i in range(30)]
    got = {r.name for r in G.cycles(spark.createDataFrame(rows, SCHEMA), local=0).collect()}
    assert got == on_cycle(rows)


def fold(edges, combine=max):
    table = pa.table({"k": pa.array([e[0] for e in edges]), **{c: pa.array([e[i] for e in edges], pa.int64()) for i, c in enumerate(("src", "dst", "w"), 1)}})
    out = pa.Table.from_batches(W.fold_block(table.to_batches(2), ["k"], combine))
    return sorted(zip(*out.to_pydict().values(), strict=True), key=repr)


def test_fold_of_one_block():
    add = lambda a, b: a + b
    # 5 lies between ends and is no end: a start; 1 and 9 may have requirements elsewhere
    assert fold([("a", 1, 3, 1), ("a", 3, 4, 1), ("a", 5, 6, 1), ("a", 6, 7, 1), ("a", 9, 8, 1)], add) == sorted(
        [("a", 3, 1, 1, 1), ("a", 4, 1, 2, 1), ("a", 6, None, 1, 1), ("a", 7, None, 2, 1), ("a", 8, 9, 1, 1)], key=repr)
    # two ways from outside reach 4 and 5; another plan of the same positions is apart
    assert fold([("a", 1, 4, 1), ("a", 2, 4, 5), ("a", 4, 5, 2), ("b", 4, 5, 7)]) == sorted(
        [("a", 4, 1, 1, 2), ("a", 4, 2, 5, 2), ("a", 5, 1, 2, 2), ("a", 5, 2, 5, 2), ("b", 5, 4, 7, 1)], key=repr)
    # more ways than are carried on: 9 is a meeting place, 10 hangs on it
    assert fold([("a", v, 9, v) for v in range(1, 7)] + [("a", 9, 10, 2)]) == sorted([("a", 9, v, v, 6) for v in range(1, 7)] + [("a", 10, 9, 2, 1)], key=repr)
    # a ring is cut open at one node, and what is behind hangs on that; a requirement without position is a start
    assert fold([("a", 2, 3, 1), ("a", 3, 2, 1), ("a", 3, 4, 1), ("a", None, 6, 1)]) == sorted(
        [("a", 2, 2, 1, 1), ("a", 3, 2, 1, 1), ("a", 4, 2, 1, 1), ("a", 6, None, 1, 1)], key=repr)
    assert list(W.fold_block([], ["k"], max)) == []
