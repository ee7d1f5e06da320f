"""Cross-tokenizer alignment over distinct texts.

Documents are shuffled by their full text, so each distinct text is tokenised and aligned once; its pair counts weigh
as many times as the text occurs.  A text is cut where neither tokenizer can join across (a space between two
non-spaces), and each distinct piece of a batch is worked out once.  A batch of texts is one row that names pairs by
their place in the batch's own list; corpus-wide counts come back to a batch by one join on the pair, and the measures
to the documents by one join on the text.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from changewright.llm.common import cut

#: Characters of text in a batch (one text at least); pieces that a task remembers between batches, and learns at once.
BATCH, KNOWN, LEARN = 1 << 22, 300_000, 1 << 14
_CUT = re.compile(r"(?<=\S) (?=\S)").split
_BATCHES = "batch long, t1 array<long>, t2 array<long>, times array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, " \
    "units array<int>, n_units array<int>, pairs array<int>, n_pairs array<int>, a array<int>, b array<int>, n array<long>"
_MEASURES = "t1 long, t2 long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and the pieces that this task has met."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letter = byte_letters()
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(letter[c] for c in t) if t and all(c in letter for c in t) else b"" for t in map(self.a.id_to_token, range(size))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the vocabulary reaches over a space: texts cannot be cut there")
        #: Every id as text with each sign that may follow it.
        self.ids = max(size, len(pieces))
        self.names = [f"{i}{sign}" for sign in ",|;\n" for i in range(self.ids)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        #: Number of each piece; per number its counts, groups as text, and links (flat).  Negative n_a: bytes differ.
        self.known: dict[str, int] = {}
        self.counts, self.groups = array("q"), []
        self.links, self.link_start = array("q"), array("q", [0])

    def learn(self, new: list[str]) -> None:
        expected = [f" {u}".encode() for u in new]
        ids_a = [e.ids for e in self.a.encode_batch_fast([f" {u}" for u in new], add_special_tokens=False)]
        ids_b = self.b.encode(new, num_threads=1)
        unit = len(new)
        good = [True] * unit
        if not (self._whole(ids_a, self.a_bytes, expected) and self._whole(ids_b, self.b_bytes, expected)):
            a_of, b_of = self.a_bytes.__getitem__, self.b_bytes.__getitem__
            good = [b"".join(map(a_of, x)) == e == b"".join(map(b_of, y)) for x, y, e in zip(ids_a, ids_b, expected, strict=True)]
            ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, good, strict=True)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, unit) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        end_unit = np.cumsum([len(e) if ok else 0 for e, ok in zip(expected, good, strict=True)])
        # every stretch between two neighbouring ends lies in one token of each side: a link
        ends, shared = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        linked = flat_a[np.searchsorted(end_a, ends)] << 32 | flat_b[np.searchsorted(end_b, ends)]
        n_links = np.diff(np.append(0, np.searchsorted(ends, end_unit, "right")))
        n_groups = np.diff(np.append(0, np.searchsorted(shared, end_unit, "right")))
        text = self._text(flat_a, flat_b, end_a, end_b, shared, end_unit)
        at = len(self.known)
        self.known.update(zip(new, range(at, at + unit), strict=True))
        self.counts.frombytes(np.stack([np.where(good, n_a, -1), n_b, n_groups, n_links], axis=1).astype(np.int64).tobytes())
        self.groups += [x if ok else "" for x, ok in zip(self._spread(text, good), good, strict=True)]
        self.links.frombytes(linked.astype(np.int64).tobytes())
        self.link_start.frombytes((self.link_start[-1] + np.cumsum(n_links)).astype(np.int64).tobytes())

    @staticmethod
    def _whole(ids: list[list[int]], of: list[bytes], expected: list[bytes]) -> bool:
        """Whether the tokens of every piece give its bytes back: all at once, and the sizes one by one."""
        parts = [*map(of.__getitem__, chain.from_iterable(ids))]
        if b"".join(parts) != b"".join(expected):
            return False
        ends = np.append(0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))[np.cumsum([*map(len, ids)])]
        return bool((ends == np.cumsum([*map(len, expected)])).all())

    @staticmethod
    def _spread(text: list[str], good: list[bool]) -> Iterator[str]:
        own = iter(text)
        return (next(own) if ok else "" for ok in good)

    def _text(self, flat_a, flat_b, end_a, end_b, shared, end_unit) -> list[str]:
        """Groups of each good piece as text: its tokens by group, side and place, each with the sign that follows."""
        if not len(shared):
            return []
        group = np.concatenate([np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)])
        side = np.repeat([0, 1], [len(flat_a), len(flat_b)])
        end = np.concatenate([end_a, end_b])
        order = np.lexsort((end, side, group))
        last = shared[group] == end
        sign = np.where(last, np.where(side == 0, 1, np.where(np.isin(end, end_unit), 3, 2)), 0)[order]
        ids = np.concatenate([flat_a, flat_b])[order]
        return "".join(map(self.names.__getitem__, (sign * self.ids + ids).tolist())).split("\n")[:-1]

    def batch(self, number: int, keys: list[tuple[int, int, int]], texts: list[str]) -> dict:
        """One row for the texts: measures that need no counts, pieces of each text, pairs of each piece."""
        if len(self.known) > KNOWN:
            self.forget()
        cuts = [_CUT(t) for t in texts]
        new = list(dict.fromkeys(u for c in cuts for u in c if u not in self.known))
        for i in range(0, len(new), LEARN):
            self.learn(new[i : i + LEARN])
        n = np.fromiter(map(len, cuts), np.int64, len(cuts))
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cuts)), np.int64, int(n.sum()))
        start = np.cumsum(n) - n
        counts = np.frombuffer(self.counts, np.int64).reshape(-1, 4)[numbers]
        bad = np.add.reduceat(counts[:, 0] < 0, start) > 0
        totals = np.where(bad[:, None], 0, np.add.reduceat(counts, start, axis=0))
        digest = ["" if x else hashlib.sha256(";".join(map(self.groups.__getitem__, numbers[s : s + k].tolist())).encode()).hexdigest() for x, s, k in zip(bad, start, n, strict=True)]
        numbers, n = numbers[np.repeat(~bad, n)], np.where(bad, 0, n)
        met, place = np.unique(numbers, return_inverse=True)
        starts = np.frombuffer(self.link_start, np.int64)
        size = starts[met + 1] - starts[met]
        links = np.frombuffer(self.links, np.int64)[np.repeat(starts[met] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        pair, pair_at = np.unique(links, return_inverse=True)
        times = np.array([k[2] for k in keys], np.int64)
        uses = np.zeros(len(met), np.int64)
        np.add.at(uses, place, np.repeat(times, n))
        weight = np.zeros(len(pair), np.int64)
        np.add.at(weight, pair_at, np.repeat(uses, size))
        out = {"batch": number, "t1": [k[0] for k in keys], "t2": [k[1] for k in keys], "times": times}
        out |= dict(zip(("n_a", "n_b", "n_groups", "n_links"), totals.T, strict=True))
        return out | {"groups_sha256": digest, "units": place, "n_units": n, "pairs": pair_at, "n_pairs": size, "a": pair >> 32, "b": pair & 0xFFFFFFFF, "n": weight}


_ALIGNERS: dict[int, Aligner] = {}


def aligned_batches(docs: DataFrame, a_file: str, b_file: str, text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """One row per batch of distinct texts (``_BATCHES``), written to the shared folder.

    Null and empty texts are left out.  The vocabulary files are read by the driver and broadcast: their size does not
    depend on the data.
    """
    files = []
    for path in (a_file, b_file):
        with open(path, "rb") as f:
            files.append(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(files)
    distinct = docs.where(F.length(text_col) > 0).groupBy(F.col(text_col).alias("text")).agg(F.count("*").alias("times"))
    keyed = distinct.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "times", "text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = hash((shared.value[0], shared.value[1]))
        if name not in _ALIGNERS:
            _ALIGNERS.clear()
            _ALIGNERS[name] = Aligner(*shared.value)
        aligner, held, keys, size = _ALIGNERS[name], [], [], 0
        number = TaskContext.get().partitionId() << 33
        kind = pa.schema([(c, t) for c, t in _arrow_types()])

        def flush():
            row = aligner.batch(number, keys, held)
            columns = [pa.array([row["batch"]], pa.int64())]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(row[c])], pa.int32()), pa.array(row[c], t.value_type)) for c, t in _arrow_types()[1:]]
            return pa.RecordBatch.from_arrays(columns, schema=kind)

        for b in rows:
            for t1, t2, times, text in zip(*(b.column(c).to_pylist() for c in ("t1", "t2", "times", "text")), strict=True):
                keys.append((t1, t2, times))
                held.append(text)
                size += len(text)
                if size >= batch:
                    yield flush()
                    number, held, keys, size = number + 1, [], [], 0
        if held:
            yield flush()

    return cut(keyed.mapInArrow(run, _BATCHES))


def _arrow_types() -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return [(c, kinds[t]) for c, t in (x.split(" ") for x in _BATCHES.split(", "))]


def pair_counts(batches: DataFrame) -> DataFrame:
    """(a, b, count): links corpus-wide that hold token id ``a`` of the first and ``b`` of the second tokenizer."""
    pairs = batches.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.a", "p.b", "p.n")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))


def text_measures(batches: DataFrame) -> DataFrame:
    """One row per distinct text (``_MEASURES``), named by the two hashes of the text.

    A pair's count goes to the batches that hold it, at most one row per batch; a batch has its counts back as one list
    no longer than its links.
    """
    counts = cut(pair_counts(batches))
    best = counts.groupBy("b").agg(F.max("count").alias("best"))  # one row per token id of the vocabulary
    marked = counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("best")).alias("top"))
    wanted = batches.select("batch", F.posexplode(F.arrays_zip("a", "b")).alias("i", "p")).select("batch", "i", "p.a", "p.b")
    given = wanted.join(marked, ["a", "b"]).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("i", "count", "top"))).alias("g"))
    given = given.select("batch", F.col("g.count").alias("count"), F.col("g.top").alias("top"))
    rows = batches.drop("times", "a", "b", "n").join(given, "batch", "left")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                col = lambda c: part.column(c)[i].values  # noqa: B023, E731
                of = lambda c: col(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                out = {c: col(c) for c in ("t1", "t2", "n_a", "n_b", "n_groups", "n_links")}
                if part.column("count")[i].is_valid:
                    count, top = of("count"), of("top").astype(np.int64)
                else:
                    count = top = np.zeros(0, np.int64)
                total = lambda x, at, n: np.diff(np.append(0, np.cumsum(x[at]))[np.append(0, np.cumsum(n))])
                for name, x in (("n_best", top), ("count_sum", count)):
                    out[name] = pa.array(total(total(x, of("pairs"), of("n_pairs")), of("units"), of("n_units")), pa.int64())
                yield pa.RecordBatch.from_pydict(out | {"groups_sha256": col("groups_sha256")})

    return rows.mapInArrow(run, _MEASURES)


def align_documents(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_file``: byte-level BPE as JSON, which gets a space and the text; ``b_file``: SentencePiece model, which adds the
    space.  Null and empty texts, and texts that one of the tokenizers does not give back byte by byte, have zeros and
    an empty digest.  Repeated rows share the result.  A text that a third of all documents have is one row of the work
    and its join back is one that adaptive execution splits.
    """
    measures = text_measures(aligned_batches(docs, a_file, b_file, text_col, batch))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2"))
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return rows.join(measures, ["t1", "t2"], "left").select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
