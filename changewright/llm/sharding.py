"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get a global number in an order that does not depend on partitions.  A keyed Feistel network over a grid of
about sqrt(n) by sqrt(n) permutes the numbers; a value outside 0..n-1 walks on until it is inside.  A row's place p
gives its shard (p mod shards) and its slot (p div shards): a reproducible shuffle whose counts differ by one at most,
and ``row_number_at`` tells the row of any shard and slot.  Only DataFrame functions are used.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changewright.operators import ordered

SHARDS, SEED = 24, 20_240_607
#: Arithmetic of the round function: squares modulo a Mersenne prime, so that every product fits into 63 bits.
PRIME, FACTOR, ROUNDS = 2**31 - 1, 48_271, 8


def round_keys(seed: int) -> list[int]:
    keys, x = [], seed % PRIME
    for _ in range(ROUNDS):
        x = (x * FACTOR + 11) % PRIME
        keys.append(x)
    return keys


def sides(n: int) -> tuple[int, int]:
    """Sides of the least grid of whole rows for n numbers; it has fewer than ``sides(n)[0]`` places too many."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _mixed(x: Column, key: Column) -> Column:
    y = (x + key) % PRIME
    return (y * y % PRIME) * FACTOR % PRIME


def _rounds(n: int, seed: int, back: bool) -> Column:
    a, b = sides(n)
    keys = [F.struct(F.lit(k).cast("long").alias("k"), F.lit((a, b)[i % 2]).cast("long").alias("m")) for i, k in enumerate(round_keys(seed))]
    return F.array(*(reversed(keys) if back else keys))


def scramble(at: Column, n: int, seed: int = SEED, back: bool = False) -> Column:
    """One pass of the network over 0..a*b-1; ``back`` undoes it."""
    b = sides(n)[1]
    at = at.cast("long")
    start = F.struct(F.call_function("div", at, F.lit(b).cast("long")).alias("x"), (at % b).alias("y"))
    if back:
        step = lambda s, r: F.struct(F.pmod(s["y"] - _mixed(s["x"], r["k"]), r["m"]).alias("x"), s["x"].alias("y"))
    else:
        step = lambda s, r: F.struct(s["y"].alias("x"), ((s["x"] + _mixed(s["y"], r["k"])) % r["m"]).alias("y"))
    return F.aggregate(_rounds(n, seed, back), start, step, lambda s: s["x"] * b + s["y"])


def longest_walk(spark: SparkSession, n: int, seed: int = SEED) -> int:
    """Passes that the longest walk takes.

    Only the places outside 0..n-1 that follow on one inside prolong a walk, and there are fewer than sqrt(n) + 1
    places outside: a small table, whatever n is.
    """
    a, b = sides(n)
    left = spark.range(n, a * b).where(scramble(F.col("id"), n, seed, back=True) < n)
    walks = 1
    while not left.isEmpty():
        walks += 1
        left = left.select(scramble(F.col("id"), n, seed).alias("id")).where(F.col("id") >= n)
    return walks


def permuted(at: Column, n: int, walks: int, seed: int = SEED, back: bool = False) -> Column:
    """Place of number ``at`` in the shuffle of 0..n-1; with ``back``, the number at a place.  ``walks``: see ``longest_walk``."""
    more = F.array_repeat(F.lit(0), walks - 1)
    return F.aggregate(more, scramble(at, n, seed, back), lambda p, _: F.when(p < n, p).otherwise(scramble(p, n, seed, back)))


def row_number_at(shard: Column, slot: Column, n: int, walks: int, shards: int = SHARDS, seed: int = SEED) -> Column:
    """Global row number (from 0) of a shard's slot, without any table."""
    return permuted(slot.cast("long") * shards + shard, n, walks, seed, back=True)


def row_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Order of rows: id (null first), digest of the text, all other columns, and the place in the input.

    The last one only parts rows that are equal in every column, so which of them gets which number changes nothing;
    it lets a large group of copies be dealt over many slices of the sort.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    others = F.to_json(F.struct(*rest)) if rest else F.lit("")
    return [F.col(id_col).alias("_o_id"), F.md5(F.col(text_col)).alias("_o_md5"), F.md5(others).alias("_o_rest"), F.monotonically_increasing_id().alias("_o_place")]


def numbered_shards(rows: DataFrame, order: list[str], n: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``row_no`` (from 0, by the columns ``order``), ``shard`` and ``slot``; ``n`` is their count."""
    numbered = ordered.number_by(rows, [], [F.col(c) for c in order], "_o_no")
    place = permuted(F.col("row_no"), n, longest_walk(rows.sparkSession, n, seed), seed)
    placed = numbered.withColumn("row_no", F.col("_o_no") - 1).withColumn("_o_at", place)
    parts = {"shard": (F.col("_o_at") % shards).cast("int"), "slot": F.call_function("div", F.col("_o_at"), F.lit(shards).cast("long"))}
    return placed.withColumns(parts).drop("_o_at", "_o_no", *order)


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``_row`` (the whole row), row_no, shard, slot.

    Shards differ by one row at most and slots have no gaps.  Null ids come first, null and empty texts are rows like
    others, repeated rows get places of their own, an empty table gives none.  Whole rows move once.  Groups of equal
    texts do not stay together: counts could not differ by one with a group that holds a third of all rows.
    """
    order = row_order(docs, id_col, text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *order)
    return numbered_shards(rows, ["_o_id", "_o_md5", "_o_rest", "_o_place"], docs.count(), shards, seed)


def shard_digests(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot as in ``shard_documents`` with doc_id, size (UTF-8 bytes + 8) and text_crc32 in place of the row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), *row_order(docs, id_col, text_col))
    return numbered_shards(rows, ["_o_id", "_o_md5", "_o_rest", "_o_place"], docs.count(), shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 1 << 20) -> None:
    """Shards as folders ``shard=k`` of Parquet files, each file a run of consecutive slots in order (column ``slot``)."""
    placed = shard_documents(docs, shards, seed, id_col, text_col).withColumn("part", F.call_function("div", F.col("slot"), F.lit(rows_per_file)))
    files = max(1, shards * -(-docs.count() // (shards * rows_per_file)))
    dealt = placed.repartition(files, "shard", "part").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard", "part").mode("overwrite").parquet(path)
