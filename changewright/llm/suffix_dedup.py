"""Suffix dedup by distributed prefix doubling: bytes under any repeated string of ``length`` bytes go.

Positions carry ranks: names of the bytes that start there.  Names double (4, 8, ... bytes), a pair of names at a
growing offset naming the longer string; Spark sorts and counts the names, and positions whose name is unique are
dropped before the next doubling.  Three measures keep this in proportion to the text:

* The first global round looks at *anchors* only.  Of the names of ``length / 4`` bytes inside a window of ``length``
  bytes the least is its anchor, so equal windows have equal anchors at equal places, and a window whose anchor's
  name is unique is unique.  An anchor serves a run of consecutive windows; there is one in about 75 bytes.
* In the next round a run is one item: if the same run (name and place of its anchor, all its windows) occurs twice,
  all its windows are repeated.
* Only runs that share their anchor's name but differ as a whole, at the borders of repeated passages, are taken
  window by window, and of equal runs one stands for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changewright.llm.common import KEY, cut, drop_table, keyed

LENGTH = 200
#: Bytes named in one go; longer texts are read in overlapping steps.
STEP = 1 << 18
_BYTES = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of two names side by side."""
    return (left ^ (left >> np.uint64(29))) * _A + (right ^ (right >> np.uint64(32))) * _B


def names(text: np.ndarray, size: int) -> np.ndarray:
    """Names of all strings of ``size`` bytes, by doubling; the last pair may overlap."""
    if len(text) < size:
        return np.empty(0, np.uint64)
    h, have = _BYTES[text], 1
    while have < size:
        by = min(have, size - have)
        h = _pair(h[: len(h) - by], h[by:])
        have += by
    return h


def double(h: np.ndarray, have: int, size: int) -> np.ndarray:
    """Names of ``size`` bytes from names of ``have`` bytes."""
    while have < size:
        by = min(have, size - have)
        h = _pair(h[: len(h) - by], h[by:]) if len(h) > by else np.empty(0, np.uint64)
        have += by
    return h


def _anchors(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every ``width`` names, the first of equal ones."""
    low, at, have = h, np.arange(len(h), dtype=np.int32), 1
    while have < width:
        by = min(have, width - have)
        right = low[by:] < low[:-by]
        at = np.where(right, at[by:], at[:-by])
        low = np.where(right, low[by:], low[:-by])
        have += by
    return at


def runs(text: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows in a buffer of documents that start at ``edges`` (and end at the next): document, a, u, lo, hi.

    ``a`` names the anchor, ``u`` the whole run; ``lo`` and ``hi`` are its first and last window in the buffer.
    """
    short = max(1, length // 4)
    h = names(text, short)
    whole = double(h, short, length)
    if not len(whole):
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    owner = _anchors(h, length - short + 1)[: len(whole)]
    start = np.arange(len(whole))
    doc = np.searchsorted(edges, start, side="right") - 1
    inside = start + length <= edges[doc + 1]
    new = np.ones(len(whole), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(whole)) - 1
    lo, hi = lo[inside[lo]], hi[inside[lo]]
    at = owner[lo].astype(np.int64)
    u = _pair(_pair(whole[lo], whole[hi]), ((hi - lo).astype(np.uint64) << np.uint64(32)) | (at - lo).astype(np.uint64))
    return doc[lo], h[at], u, lo, hi


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about STEP bytes: text, edges, and for each piece its document and the offset in it.

    Pieces of a long document overlap, so that every window lies whole in exactly one.
    """
    held, owner, base, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), STEP):
            part = t[at : at + STEP + length - 1]
            if len(part) < length:
                continue
            held.append(part)
            owner.append(i)
            base.append(at)
            size += len(part)
            if size >= STEP:
                yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), np.array(owner), np.array(base)
                held, owner, base, size = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), np.array(owner), np.array(base)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def document_runs(docs: DataFrame, length: int) -> DataFrame:
    """(keys, text) -> one row per run: keys, a, u, lo, hi."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, edges, owner, base in _pieces(_bytes(b.column("text")), length):
                d, a, u, lo, hi = runs(text, edges, length)
                rows, back = pa.array(owner[d]), base[d] - edges[d]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).take(rows) for k in KEY), pa.array(a.view(np.int64)), pa.array(u.view(np.int64)), pa.array((lo + back).astype(np.int64)), pa.array((hi + back).astype(np.int64))],
                    names=[*KEY, "a", "u", "lo", "hi"])

    return docs.select(*KEY, "text").mapInArrow(run, "_id long, _t long, _s long, a long, u long, lo long, hi long")


def _regions(docs: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """The bytes under one run of each kind: a, u, bytes."""
    wanted = kinds.groupBy(*KEY).agg(F.collect_set(F.struct("a", "u", "lo", "hi")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, u, out = [], [], []
            for text, own in zip(_bytes(b.column("text")), b.column("runs").to_pylist(), strict=True):
                for r in own:
                    a.append(r["a"])
                    u.append(r["u"])
                    out.append(text[r["lo"] : r["hi"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(u, pa.int64()), pa.array(out, pa.binary())], names=["a", "u", "bytes"])

    one = docs.join(wanted, KEY).select("text", "runs").mapInArrow(run, "a long, u long, bytes binary")
    return one.dropDuplicates(["a", "u"])  # repeated rows have one key


def _windows(regions: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """All regions of a batch in one buffer: names of the short strings; and of each region its start, the place of
    its anchor and its number of windows."""
    size = np.array([len(x) for x in regions], dtype=np.int64)
    start, short = np.cumsum(size) - size, max(1, length // 4)
    h = names(np.frombuffer(b"".join(regions), np.uint8), short)
    # every window of a region holds the anchor, so the first window shows it
    first = h[start[:, None] + np.arange(length - short + 1)].argmin(axis=1) if len(h) else start
    return h, start, start + first, size - length + 1


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item its number, ``count`` times, and 0, 1, ... beside it."""
    item = np.repeat(np.arange(len(count)), count)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)


def _classes(regions: DataFrame, length: int) -> DataFrame:
    """Next doubling: windows whose anchor is ``short * j`` or a little more bytes in share a core; its name is ``core``."""
    short = max(1, length // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, start, anchor, n = _windows(b.column("bytes").to_pylist(), length)
            least, most = (anchor - start - n + 1) // short, (anchor - start) // short
            i, more = _spread(most - least + 1)
            j = least[i] + more
            core = double(h, short, length - short)[anchor[i] - j * short]
            i = pa.array(i)
            yield pa.RecordBatch.from_arrays([b.column("a").take(i), b.column("u").take(i), pa.array(j.astype(np.int32)), pa.array(core.view(np.int64))], names=["a", "u", "j", "core"])

    return regions.mapInArrow(run, "a long, u long, j int, core long")


def _whole(regions: DataFrame, length: int) -> DataFrame:
    """Last doubling: names of the windows in the classes ``js`` of each region: a, u, at (window in the run), name."""
    short = max(1, length // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, start, anchor, n = _windows(b.column("bytes").to_pylist(), length)
            i, at = _spread(n)
            js = b.column("js")
            alive = np.repeat(np.arange(len(n)), np.array(js.value_lengths())) * length + np.array(js.flatten())
            live = np.isin(i * length + (anchor[i] - start[i] - at) // short, alive)
            i, at = i[live], at[live]
            name = double(h, short, length)[start[i] + at]
            i = pa.array(i)
            yield pa.RecordBatch.from_arrays([b.column("a").take(i), b.column("u").take(i), pa.array(at.astype(np.int32)), pa.array(name.view(np.int64))], names=["a", "u", "at", "name"])

    return regions.mapInArrow(run, "a long, u long, at int, name long")


def _more_than_one(rows: DataFrame, by: list[str]) -> DataFrame:
    """Keys that several rows have, as a written table: a join with it can be split where a key has very many rows."""
    return cut(rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by))


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(keys, text) -> keys, ranges: sorted starts (lo, hi) of all windows of ``length`` bytes that start elsewhere too."""
    found = cut(document_runs(docs, length))
    shared = cut(found.join(_more_than_one(found, ["a"]), "a"))
    drop_table(found)
    kinds = cut(shared.groupBy("a", "u").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "lo", "hi")).alias("r")))
    mixed = kinds.join(_more_than_one(kinds, ["a"]), "a").select("a", "u", "r.*")
    regions = cut(_regions(docs, cut(mixed), length))
    classes = cut(_classes(regions, length))
    alive = classes.join(_more_than_one(classes, ["a", "j", "core"]), ["a", "j", "core"]).groupBy("a", "u").agg(F.collect_set("j").alias("js"))
    left = cut(regions.join(alive, ["a", "u"]))
    drop_table(regions)
    drop_table(classes)
    whole = _whole(left, length)
    met = whole.join(_more_than_one(whole, ["a", "name"]), ["a", "name"]).select("a", "u", "at")
    single = kinds.where("n = 1").select("a", "u", "r.*")
    some = met.join(single, ["a", "u"]).groupBy(*KEY, "lo").agg(F.collect_set("at").alias("at"))
    some = cut(some.select(*KEY, "lo", "at"))
    drop_table(left)
    some_rows = some.select(*KEY, F.explode("at").alias("at"), "lo").select(*KEY, (F.col("lo") + F.col("at")).alias("lo")).select(*KEY, "lo", F.col("lo").alias("hi"))
    every = shared.join(kinds.where("n > 1").select("a", "u"), ["a", "u"]).select(*KEY, "lo", "hi")
    out = cut(every.unionByName(some_rows).groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("ranges")))
    for t in (shared, kinds, some):
        drop_table(t)
    return out


def _merged(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Byte spans (start, end) under sorted window ranges."""
    out: list[list[int]] = []
    for r in ranges:
        lo, end = r["lo"], r["hi"] + length
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return [(a, b) for a, b in out]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (start and end of removed bytes), kept (binary).

    Every byte under a string of ``length`` bytes that also starts anywhere else goes, judged on the input; overlaps
    count and documents are not joined up.  Null and empty texts have no bytes, texts shorter than ``length`` keep
    all.  Repeated rows are copies of each other, so all of them lose their bytes.
    """
    base = keyed(docs, id_col, text_col)
    ranges = repeated_windows(base, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, spans, kept = [], [], []
            for text, own in zip(_bytes(b.column("text")), b.column("ranges").to_pylist(), strict=True):
                gone = _merged(own or [], length)
                at = [0, *(x for s in gone for x in s), len(text)]
                size.append(len(text))
                spans.append([{"start": s, "end": e} for s, e in gone])
                kept.append(b"".join(text[x:y] for x, y in zip(at[::2], at[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.join(ranges, KEY, "left").select("doc_id", "text", "ranges").mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
