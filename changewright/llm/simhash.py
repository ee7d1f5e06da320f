"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are compared inside buckets of equal bits: of ``BLOCKS`` slices of the 64 bits, at most ``radius`` can
hold a differing bit, so any two near fingerprints agree on all bits of some choice of ``BLOCKS - radius`` slices.
That is exact, not a guess.  In a bucket the bits of all members are held vertically, one plane per bit, and all
members at a given distance in the sorted bucket are compared at once, 64 lanes a machine word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changewright.llm.common import KEY, cut, keyed, unpack, with_row
from changewright.llm.components import connected_components, forest

SHINGLE, RADIUS, BLOCKS = 3, 3, 6
SEED = 42
#: Lanes compared in one go, and most members of one bucket in one task; larger buckets are cut into pairs of parts.
LANES = 4096
_STEP = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 majority bits over the XXH64 of all word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    hashed = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashed), _STEP):
        bits = np.unpackbits(hashed[at : at + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashed), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(keys, doc_id, text) -> (keys, doc_id, fp long): the fingerprint as a signed number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*KEY, "doc_id")), pa.array(fps)], names=[*KEY, "doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*KEY, "doc_id", "text").mapInArrow(run, f"_id long, _t long, _s long, doc_id {kind}, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: plane b has bit b of every fingerprint, lane by lane, padded to whole words."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    width = -(-bits.shape[1] // 64) * 64
    padded = np.zeros((64, width), dtype=np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _near(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose fingerprints differ in at most ``radius`` bits.

    ``radius`` is below 4: counters are two bit vectors (``ones``, ``twos``) and ``over``, which stays set once a
    lane has counted 4 or more.  Difference planes enter three at a time through a carry-save adder.
    """
    p, q = _planes(left), _planes(right)
    ones = np.zeros(p.shape[1], dtype=np.uint64)
    twos = ones.copy()
    over = np.packbits(np.arange(p.shape[1] * 64) >= len(left), bitorder="little").view("<u8")  # no lane there
    for at in range(0, 63, 3):
        a, b, c = p[at] ^ q[at], p[at + 1] ^ q[at + 1], p[at + 2] ^ q[at + 2]
        x = a ^ b
        total, carry = x ^ c, (a & b) | (x & c)
        up = ones & total
        ones ^= total
        y = twos ^ carry
        over |= (twos & carry) | (y & up)
        twos = y ^ up
        if at % 12 == 9 and not (~over).any():
            return np.zeros(len(left), dtype=bool)
    last = p[63] ^ q[63]
    up = ones & last
    ones ^= last
    over |= twos & up
    twos ^= up
    bad = over
    if radius < 3:
        bad = bad | ((twos & ones) if radius == 2 else twos if radius == 1 else twos | ones)
    return np.unpackbits(bad.view(np.uint8), bitorder="little")[: len(left)] == 0


def bucket_links(bucket: np.ndarray, fps: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets of a block sorted by bucket, as (lane, least lane of its component).

    Members ``shift`` places apart are compared for shift 1, 2, ... until no bucket is that long.  ``side`` 1 and 2
    mark two parts of a large bucket that only meet each other here.
    """
    size = len(fps)
    found_a, found_b, shift = [np.empty(0, int)], [np.empty(0, int)], 1
    lanes = np.flatnonzero(bucket[:-1] == bucket[1:])
    while len(lanes):
        for at in range(0, len(lanes), LANES):
            i = lanes[at : at + LANES]
            i = i[(side[i] == 0) | (side[i] != side[i + shift])]
            if len(i):
                hit = i[_near(fps[i], fps[i + shift], radius)]
                found_a.append(hit)
                found_b.append(hit + shift)
        shift += 1
        lanes = lanes[lanes + shift < size]
        lanes = lanes[bucket[lanes] == bucket[lanes + shift]]
    return forest(np.concatenate(found_a), np.concatenate(found_b), size)


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, pi, pj) -> links; only the last, unfinished bucket is held back."""
    names = ("bucket", "pi", "pj", "fp", "side")
    held = {n: np.empty(0, np.int64) for n in names}

    def done(stop: int, new: np.ndarray) -> pa.RecordBatch:
        fp = held["fp"][:stop]
        a, b = bucket_links(np.cumsum(new[:stop]), fp.view(np.uint64), held["side"][:stop], radius)
        for n in names:
            held[n] = held[n][stop:]
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    def starts() -> np.ndarray:
        new = np.ones(len(held["fp"]), dtype=bool)
        new[1:] = (held["bucket"][1:] != held["bucket"][:-1]) | (held["pi"][1:] != held["pi"][:-1]) | (held["pj"][1:] != held["pj"][:-1])
        return new

    for batch in batches:
        for n in names:
            held[n] = np.concatenate([held[n], batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)])
        if len(held["fp"]) >= _STEP:
            new = starts()
            if stop := int(np.flatnonzero(new)[-1]):
                yield done(stop, new)
    if len(held["fp"]):
        yield done(len(held["fp"]), starts())


def _buckets(blocks: int, radius: int) -> list[tuple[int, int]]:
    """A bit mask for each choice of ``blocks - radius`` slices, with its number."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    return [(n, sum(((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in keep)) for n, keep in enumerate(combinations(range(blocks), blocks - radius))]


def near_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (a, b) that span every component of fingerprints within ``radius``."""
    if not 0 <= radius <= 3 < blocks:
        raise ValueError("radius is 0 to 3, blocks at least 4")
    signed = [(n, m - (1 << 64) if m >> 63 else m) for n, m in _buckets(blocks, radius)]
    keys = F.array(*[F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(m))) for n, m in signed])
    rows = fps.select("fp", F.explode(keys).alias("bucket"))
    large = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > LANES)
    dealt = rows.join(large.select("bucket", F.ceil(F.col("n") / LANES).cast("int").alias("parts")), "bucket", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: F.struct(
        F.least(own, t).alias("pi"), F.greatest(own, t).alias("pj"), F.when(own == t, 0).when(own < t, 1).otherwise(2).alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("pi"), F.lit(0).alias("pj"), F.lit(0).alias("side")))
    met = dealt.select("fp", "bucket", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(pairs)).alias("p")).select("bucket", "p.pi", "p.pj", "fp", "p.side")
    order = ["bucket", "pi", "pj"]
    return met.repartition(*order).sortWithinPartitions(*order).mapInArrow(lambda x: _links(x, radius), "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: keys, doc_id, fp (long), component_id (least id reachable by links).

    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any other.  Null ids
    belong to components but never name one, unless all its ids are null: then component_id is null.
    """
    prints = cut(fingerprints(keyed(docs, id_col, text_col), shingle))
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = cut(connected_components(near_links(each.select("fp"), radius)))
    member = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = member.select("fp", "root").join(named, "root").select("fp", "root", "component_id")
    return prints.join(by_fp, "fp").select(*KEY, "doc_id", "fp", "root", "component_id")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the least id (null last), then text hash; of repeated rows one."""
    found = simhash_components(docs, shingle, radius, id_col, text_col)
    best = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("n"), *KEY)).alias("w")).select(*[f"w.{k}" for k in KEY])
    kept = with_row(docs, id_col, text_col).join(best, KEY)
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(0)))
    return unpack(kept.withColumn("_n", first).where("_n = 1"), docs.columns)
