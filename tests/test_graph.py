"""Deploy order, levels and cycles against plain Python on random plans."""

import heapq
import random

import pytest

from changewright.operators import graph as G

SCHEMA = "target string, project string, pos long, change_id string, name string, requires array<string>"


def plan(seed, forward, size=25):
    """Random acyclic plan: requirements point along a hidden order, so some point forward in the plan."""
    rng = random.Random(seed)
    hidden = list(range(size))
    rng.shuffle(hidden)
    rank = {n: i for i, n in enumerate(hidden)} if forward else {n: n for n in range(size)}
    rows = []
    for n in range(size):
        below = [m for m in range(size) if rank[m] < rank[n]]
        deps = [f"c{m}" + rng.choice(["", "@v1"]) for m in rng.sample(below, min(len(below), rng.randrange(3)))]
        rows.append(("t", f"p{seed}", (n + 1) * 3, f"p{seed}-{n}", f"c{n}", deps + (["gone"] if n % 9 == 0 else [])))
    rows.append(("t", f"p{seed}", size * 3 + 5, f"p{seed}-again", "c1", ["c1@v1"]))
    return rows


def kahn(rows):
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(r[4], i)
    waiting, needs = [[] for _ in rows], [0] * len(rows)
    for i, r in enumerate(rows):
        for dep in r[5]:
            j = first.get(dep.split("@")[0])
            if j is not None:
                waiting[j].append(i)
                needs[i] += 1
    free = [i for i, n in enumerate(needs) if n == 0]
    heapq.heapify(free)
    out, level = [], [0] * len(rows)
    while free:
        i = heapq.heappop(free)
        out.append(i)
        for j in waiting[i]:
            level[j] = max(level[j], level[i] + 1)
            needs[j] -= 1
            if needs[j] == 0:
                heapq.heappush(free, j)
    return out, level


@pytest.mark.parametrize("local", [1 << 17, 12])
def test_order_and_levels(spark, local):
    plans = {f"p{s}": plan(s, forward=s % 4 > 0) for s in range(12 if local > 99 else 5)}
    df = spark.createDataFrame([r for p in plans.values() for r in p], SCHEMA).cache()
    placed = {r.change_id: r.seq for r in G.deploy_order(df, local=local).collect()}
    levels = {r.change_id: r.level for r in G.deploy_levels(df, local=local).collect()}
    moved = 0
    for rows in plans.values():
        order, level = kahn(rows)
        assert sorted(range(len(rows)), key=lambda i: placed[rows[i][3]]) == order
        assert [levels[r[3]] for r in rows] == level
        moved += order != sorted(order)
    assert moved >= (8 if local > 99 else 3)


def on_cycle(rows):
    first = {}
    for r in rows:
        first.setdefault(r[4], r)
    edges = {n: {d.split("@")[0] for d in r[5]} & set(first) for n, r in first.items()}

    def reaches(a, b):
        seen, todo = set(), list(edges[a])
        while todo:
            n = todo.pop()
            if n == b:
                return True
            if n not in seen:
                seen.add(n)
                todo += edges[n]
        return False

    return {n for n in first if reaches(n, n)}


@pytest.mark.parametrize("local", [1 << 17, 0])
def test_cycles(spark, local):
    bridge = [("a", ["b"]), ("b", ["a"]), ("m", ["a"]), ("x", ["m", "y"]), ("y", ["z"]), ("z", ["x"]), ("end", ["x"]), ("self", ["self"]), ("ok", [])]
    rows = [("t", "bridge", i, f"b{i}", n, d) for i, (n, d) in enumerate(bridge)]
    for seed in range(3):
        rng = random.Random(seed)
        rows += [("t", f"r{seed}", i, f"r{seed}-{i}", f"c{i}", [f"c{rng.randrange(18)}" for _ in range(rng.randrange(3))]) for i in range(18)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.project, r.name) for r in G.cycles(df, local=local).collect()}
    want = {(p, n) for p in {r[1] for r in rows} for n in on_cycle([r for r in rows if r[1] == p])}
    assert got == want and ("bridge", "m") not in got and ("bridge", "self") in got


@pytest.mark.parametrize("local", [1 << 17, 0])
def test_cycle_is_an_error(spark, local):
    df = spark.createDataFrame([("t", "p", 1, "1", "a", ["b"]), ("t", "p", 2, "2", "b", ["a"])], SCHEMA)
    with pytest.raises(G.CycleError):
        G.deploy_order(df, local=local)
    with pytest.raises(G.CycleError):
        G.deploy_levels(df, local=local)


def chain(n, ring=0):
    """A straight chain of n changes; with ``ring``, the first ``ring`` of them form a cycle."""
    rows = [("t", "p", i, f"c{i}", f"c{i}", [f"c{i - 1}"] if i else []) for i in range(n)]
    if ring:
        rows[0] = (*rows[0][:5], [f"c{ring - 1}"])
    return rows


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    real = G._jump
    writes = []
    monkeypatch.setattr(G, "cut", lambda df, cut=G.cut: writes.append(1) or cut(df))
    monkeypatch.setattr(G, "_jump", lambda *a: rounds.append(1) or real(*a))
    df = spark.createDataFrame(chain(n), SCHEMA).cache()
    got = {r.pos: r.level for r in G.deploy_levels(df, local=100).collect()}
    assert got == {i: i for i in range(n)}
    assert len(writes) < 40 and len(rounds) <= 2
    assert {r.pos: r.level for r in G.deploy_levels(df).collect()} == got


def test_a_long_chain_behind_a_ring(spark):
    df = spark.createDataFrame(chain(300, ring=100), SCHEMA).cache()
    want = {f"c{i}" for i in range(100)}
    assert {r.name for r in G.cycles(df, local=10).collect()} == want
    assert {r.name for r in G.cycles(df).collect()} == want


@pytest.mark.parametrize("local", [1 << 17, 40])
def test_ladder_of_forward_requirements(spark, local):
    n, block = (60, 6) if local < 99 else (3000, 50)
    rows = [("t", "p", i, f"c{i}", f"c{i}", [f"c{j}" for j in (i + 1, i + 2) if j < n and j // block == i // block]) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    order, level = kahn(rows)
    placed = {r.pos: r.seq for r in G.deploy_order(df, local=local).collect()}
    assert sorted(placed, key=placed.get) == order
    assert {r.pos: r.level for r in G.deploy_levels(df, local=local).collect()} == dict(enumerate(level))


def test_order_walk_in_arrays_equals_walk_by_names():
    """The compact walk against the one over dictionaries: cycles, repeated edges, gaps; and it takes a plan of a million rows."""
    import time

    import pyarrow as pa

    from changewright.operators import plan_walk as W

    def table(nodes, edges):
        rows = [(v, None) for v in nodes] + edges
        return pa.table({"k": pa.array(["a"] * len(rows)), "pos": pa.array([r[0] for r in rows], pa.int64()), "src": pa.array([r[1] for r in rows], pa.int64())})

    rng = random.Random(5)
    for size in (1, 2, 5, 30, 30, 200):
        nodes = rng.sample(range(-50, 1000), size)
        edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.randrange(size))]
        got, want = (sorted(zip(*f(table(nodes, edges), ["k"]).to_pydict().values())) for f in (W.order_and_level, W._by_names))
        assert got == want
    assert G.ORDERED >= 1 << 22
    n = 400_000
    begin = time.perf_counter()
    out = W.order_and_level(table(range(n), [(v, v // 2) for v in range(1, n)]), ["k"])
    assert out.num_rows == n and time.perf_counter() - begin < 30
