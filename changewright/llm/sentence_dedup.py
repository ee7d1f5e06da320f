"""Substring dedup by sliding sentence spans: runs of consecutive sentences are hashed and joined over the whole table.

A run starts at every sentence and takes in sentences until it has ``SIZE`` of them and ``WORDS`` words, so a run of
short stock phrases is not yet a passage and a passage cut at both ends still holds runs.  Sentences of more than
``LONG`` words are cut at inner punctuation first.  Texts are split once; their run names are a table of arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changewright.llm.common import KEY, cut, drop_table, keyed

SIZE, WORDS, LONG = 2, 20, 12
#: A sentence ends at . ! or ? with white space behind it, at a line break, or at the end; the white space belongs to it.
SENTENCE = r"(?s).+?(?:[.!?][ \t\r\n]+|\n[ \t\r\n]*|\Z)"
#: A long one also ends at , ; or : with white space behind it.
CLAUSE = r"(?s).+?(?:[.!?,;:][ \t\r\n]+|\n[ \t\r\n]*|\Z)"
SPACE = " \t\r\n"
_sentences, _clauses, _words = re.compile(SENTENCE).findall, re.compile(CLAUSE).findall, re.compile(r"[^ \t\r\n]+").findall
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def units_of(text: str, long: int = LONG) -> tuple[list[str], list[int]]:
    """Sentences with their trailing white space, long ones in parts, and the words of each; joined they are the text."""
    units, words = [], []
    for s in _sentences(text):
        n = len(_words(s))
        if n > long:
            parts = _clauses(s)
            units += parts
            words += [len(_words(x)) for x in parts] if len(parts) > 1 else [n]
        else:
            units.append(s)
            words.append(n)
    return units, words


def _run_names(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the runs starts..ends over units of 16 digest bytes: 64 and 32 bits, by sums of powers of odd numbers."""
    digest = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    out = []
    with np.errstate(over="ignore"):
        for column, base in ((0, _P), (1, _Q)):
            step, back = (np.full(len(digest) + 1, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
            step[0] = back[0] = 1
            step, back = np.multiply.accumulate(step), np.multiply.accumulate(back)
            sums = np.append(np.uint64(0), np.cumsum(digest[:, column] * step[:-1], dtype=np.uint64))
            out.append((sums[ends] - sums[starts]) * back[starts])
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def text_runs(docs: DataFrame, size: int = SIZE, words: int = WORDS, long: int = LONG) -> DataFrame:
    """Key and runs of every text that has one: starts, numbers of units, names (``h``, ``g``), as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = {c: [] for c in (*KEY, "pos", "n", "h", "g")}
            for *key, text in zip(*(b.column(c).to_pylist() for c in (*KEY, "text")), strict=True):
                units, count = units_of(text, long) if text else ([], [])
                if len(units) < size or sum(count) < words:
                    continue
                total = np.append(0, np.cumsum(count))
                start = np.arange(len(units))
                end = np.maximum(np.searchsorted(total, total[:-1] + words), start + size)
                start, end = start[end <= len(units)], end[end <= len(units)]
                if not len(start):
                    continue
                raw = b"".join(xxhash.xxh3_128_digest(u.rstrip(SPACE).encode()) for u in units)
                h, g = _run_names(raw, start, end)
                for c, x in zip(made, (*key, start.astype(np.int32), (end - start).astype(np.int32), h, g), strict=True):
                    made[c].append(x)
            offsets = pa.array(np.cumsum([0, *map(len, made["pos"])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(made[c]) if made[c] else np.empty(0, t), pa.from_numpy_dtype(t))) for c, t in (("pos", np.int32), ("n", np.int32), ("h", np.int64), ("g", np.int32))]
            yield pa.RecordBatch.from_arrays([*(pa.array(made[c], pa.int64()) for c in KEY), *lists], names=list(made))

    return docs.select(*KEY, "text").distinct().mapInArrow(run, "_id long, _t long, _s long, pos array<int>, n array<int>, h array<long>, g array<int>")


def repeated_spans(docs: DataFrame, size: int = SIZE, words: int = WORDS, long: int = LONG) -> DataFrame:
    """Key and ``spans`` (start, end): the runs that have an earlier occurrence.

    Earlier is a smaller (id, text hashes, position); a null id comes before all others.  Names are counted first, with
    map-side combine; only runs of repeated names meet again, joined with written tables, so a run that a third of all
    documents hold is split over many tasks.
    """
    runs = cut(text_runs(docs, size, words, long))
    names = runs.select(F.explode(F.arrays_zip("h", "g")).alias("r")).select("r.h", "r.g")
    repeated = cut(names.groupBy("h", "g").agg(F.count("*").alias("times")).where("times > 1").select("h", "g"))
    placed = runs.select(*KEY, F.explode(F.arrays_zip("pos", "n", "h", "g")).alias("r")).select(*KEY, "r.*")
    hits = cut(placed.join(repeated, ["h", "g"]))
    drop_table(runs)
    drop_table(repeated)
    start = F.struct(*KEY, "pos")
    first = cut(hits.groupBy("h", "g").agg(F.min(start).alias("first")))
    later = hits.join(first, ["h", "g"]).where(start != F.col("first"))
    return later.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("end")))).alias("spans"))


def sentence_dedup(docs: DataFrame, size: int = SIZE, words: int = WORDS, long: int = LONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_sentences, n_removed, kept (the text without removed sentences).

    A sentence goes if any run over it (``size`` sentences and ``words`` words at least, and no longer than that takes)
    has an earlier occurrence (order: id, null first, then position), compared without trailing white space.  Null
    text: 0 sentences, kept null; empty text: 0 sentences, kept empty; texts with fewer sentences or words keep all.
    Repeated rows (same id and text) share the result; texts of any length are split as a whole.
    """
    base = keyed(docs, id_col, text_col)
    rows = base.join(repeated_spans(base, size, words, long), KEY, "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                units = units_of(text, long)[0] if text else []
                out = np.zeros(len(units) + 1, np.int64)
                for s in spans or ():
                    out[s["start"]] += 1
                    out[s["end"]] -= 1
                covered = np.cumsum(out)[:-1] > 0
                n.append(len(units))
                gone.append(int(covered.sum()))
                kept.append("".join(u for u, c in zip(units, covered.tolist(), strict=True) if not c) if spans else text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_sentences", "n_removed", "kept"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_sentences long, n_removed long, kept string")
