"""Feistel shards: permutation, inverse, counts, and rows that are hard to number."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from changewright.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, slot string, row_no string, _row string"


def documents(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, *"xxxx") for i, t in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 24, 25, 100, 997, 5000])
def test_permutation_and_its_inverse(spark, n):
    walks = S.longest_walk(spark, n)
    there = S.permuted(F.col("id"), n, walks)
    got = spark.range(n).select("id", there.alias("p"), S.permuted(there, n, walks, back=True).alias("q")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))
    assert all(r["id"] == r["q"] for r in got)
    if n > 900:
        assert sum(r["id"] == r["p"] for r in got) < 20


def plain(x, n, seed):
    a, b = S.sides(n)
    while True:
        x, y = divmod(x, b)
        for i, k in enumerate(S.round_keys(seed)):
            z = (y + k) % S.PRIME
            x, y = y, (x + (z * z % S.PRIME) * S.FACTOR % S.PRIME) % (a, b)[i % 2]
        x = x * b + y
        if x < n:
            return x


ROWS = [(None, None)] * 40 + [(None, "a")] * 30 + [(1, ""), (1, None), (1, "é\U0001f642"), (2, "x" * 100_000), (2, "x")] + [(7, "same")] * 50


def test_places(spark):
    docs = documents(spark, ROWS)
    got = S.shard_digests(docs, 7).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, "" if r[1] is None else __import__("hashlib").md5(r[1].encode()).hexdigest()))
    by = {r["row_no"]: r for r in got}
    assert sorted(by) == list(range(len(ROWS)))
    for no, (i, t) in enumerate(order):
        p = plain(no, len(ROWS), S.SEED)
        raw = (t or "").encode()
        r = by[no]
        assert (r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) == (i, len(raw) + 8, zlib.crc32(raw), p % 7, p // 7)
    again = S.shard_digests(documents(spark, ROWS[::-1], 9), 7).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_counts_and_slots(spark):
    for rows, shards in ((ROWS, 24), (ROWS, 1), (ROWS[:5], 24), ([], 24)):
        got = S.shard_documents(documents(spark, rows), shards).collect()
        n = Counter(r["shard"] for r in got)
        assert sum(n.values()) == len(rows)
        sizes = [n[k] for k in range(shards)]
        assert max(sizes) - min(sizes) <= 1
        assert {(r["shard"], r["slot"]) for r in got} == {(k, i) for k in range(shards) for i in range(n[k])}
        assert Counter((r["_row"]["doc_id"], r["_row"]["text"]) for r in got) == Counter(rows)


def test_row_of_a_slot(spark):
    docs = documents(spark, ROWS)
    n = len(ROWS)
    back = S.row_number_at(F.col("shard"), F.col("slot"), n, S.longest_walk(spark, n), 7)
    assert S.shard_digests(docs, 7).where(back != F.col("row_no")).count() == 0


def test_written_shards(spark, tmp_path):
    docs = documents(spark, ROWS)
    S.write_shards(docs, str(tmp_path / "s"), 5, rows_per_file=10)
    got = spark.read.parquet(str(tmp_path / "s"))
    want = S.shard_documents(docs, 5).select("shard", "slot", F.to_json("_row").alias("j"))
    assert Counter(map(tuple, got.select("shard", "slot", F.to_json("_row").alias("j")).collect())) == Counter(map(tuple, want.collect()))
    S.write_shards(documents(spark, []), str(tmp_path / "none"))
