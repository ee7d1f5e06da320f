"""Slice-based order steps against plain window functions, with slices of three rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from changewright.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for key, size in (("hot", 60), ("b", 4), ("c", 1)):
        for pos in sorted(rng.sample(range(200), size)):
            data.append((key, pos, rng.choice([None, None, pos * 10])))
    return spark.createDataFrame(data, "k string, pos long, v long").cache()


def same(got, want):
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def by_pos():
    return Window.partitionBy("k").orderBy("pos")


def sliced(rows, kind):
    return O.slice_by_position(rows, "pos", 3) if kind == "position" else O.slice_by_sort(rows, ["k"], [F.col("pos")])


@pytest.mark.parametrize("kind", ["position", "sort"])
def test_number(rows, kind):
    got = O.unsliced(O.number(sliced(rows, kind), ["k"], "n")).select("k", "pos", "n")
    same(got, rows.select("k", "pos", F.row_number().over(by_pos()).alias("n")))


@pytest.mark.parametrize("kind", ["position", "sort"])
@pytest.mark.parametrize("step", [-1, 1])
def test_neighbour(rows, kind, step):
    got = O.neighbour(sliced(rows, kind), ["k"], F.col("v"), "n", step).select("k", "pos", "n")
    shift = F.lag if step < 0 else F.lead
    same(got, rows.select("k", "pos", shift("v").over(by_pos()).alias("n")))


@pytest.mark.parametrize("kind", ["position", "sort"])
def test_fills(rows, kind):
    down = O.fill_down(sliced(rows, kind), ["k"], F.col("v"), "n").select("k", "pos", "n")
    same(down, rows.select("k", "pos", F.last("v", True).over(by_pos().rowsBetween(Window.unboundedPreceding, 0)).alias("n")))
    up = O.fill_up(sliced(rows, kind), ["k"], F.col("v"), "n").select("k", "pos", "n")
    same(up, rows.select("k", "pos", F.first("v", True).over(by_pos().rowsBetween(0, Window.unboundedFollowing)).alias("n")))


def test_number_by_with_and_without_keys(rows):
    got = O.number_by(rows, ["k"], [F.col("pos").desc()], "n").select("k", "pos", "n")
    same(got, rows.select("k", "pos", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("pos"))).alias("n")))
    total = O.number_by(rows, [], [F.col("pos"), F.col("k")], "n").select("n")
    assert sorted(r.n for r in total.collect()) == list(range(1, rows.count() + 1))


def test_asof_matches_brute_force(spark):
    rng = random.Random(3)
    left = [(rng.choice("ab"), rng.randrange(100), i) for i in range(80)]
    right = [(k, t, t * 7) for k in "ab" for t in rng.sample(range(10, 90), 12)]
    l = spark.createDataFrame(left, "k string, at long, id long")
    r = spark.createDataFrame(right, "k string, ts long, v long")
    got = {x.id: x.found for x in O.asof(l, r, ["k"], "at", "ts", F.col("v"), "found").collect()}
    for k, at, i in left:
        before = [(t, v) for kk, t, v in right if kk == k and t <= at]
        assert got[i] == (max(before)[1] if before else None)


@pytest.mark.parametrize("n", [3_000, 30_000])
def test_rows_of_a_slice_are_bounded_at_any_size(spark, n):
    df = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 7919 % n).alias("v"))
    sliced = O.slice_by_sort(df, ["k"], [F.col("v")], width=500)
    sizes = [r["count"] for r in sliced.groupBy(O.SLICE).count().collect()]
    assert sum(sizes) == n and max(sizes) <= 1000 and len(sizes) >= n // 1000


def test_running_max(spark):
    values = [3, None, 1, 7, 7, None, 2, 9, 4]
    df = spark.createDataFrame([(k, i, v) for k in "ab" for i, v in enumerate(values)], "k string, pos long, v long")
    for own in (True, False):
        got = O.running_max(O.slice_by_position(df, "pos", 2), ["k"], F.col("v"), "m", own=own).orderBy("k", "pos").collect()
        want = [max((v for v in values[: i + own] if v is not None), default=None) for i in range(len(values))]
        assert [r["m"] for r in got] == want * 2
