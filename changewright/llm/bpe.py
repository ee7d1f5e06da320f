"""Byte-level BPE by recursive DuckDB queries inside each Spark task.

Distinct pieces of a partition become token-position rows.  A recursive query joins neighbours with the merge table,
contracts each piece's leftmost pair of least rank, and stops when no pair is left.  Decoding joins token rows with
the vocabulary and aggregates the bytes in order.  Spark deals out the documents; a task keeps bounded state.

Pieces of more than ``SHORT`` bytes (no white space, such as encoded data) are contracted by ``contract_long``: a
recursive query writes all rows of a piece once per round, which neither time nor memory of a task allows there.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces of at most SHORT bytes go through the bulk query, CHUNK bytes at a time.
SHORT, CHUNK = 64, 1 << 19
#: Characters of text encoded, and tokens decoded, in one go; entries a task remembers between slices.
SLICE, TOKENS, KNOWN = 1 << 21, 1 << 19, 700_000
#: White space that a cut before a space would tear apart: two spaces, or a space between other white space or the end.
_TORN = re.compile(r" (?: |(?<=\s )(?:\s|\Z))")
_NONE = np.int64(1) << 40
#: Chunks that are one piece by any version of the character tables.
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch

#: A row knows its token, the place and token of its right neighbour (-1 at the end).  Every round writes the rows of
#: unfinished pieces only; the rows of a piece's last round are its tokens.
_BULK = """
WITH RECURSIVE t(w, p, n, id, nid, step) AS (
  SELECT w, p, n, id, nid, 0 FROM pieces
  UNION ALL
  SELECT t.w, t.p, CASE WHEN t.p = pos THEN qn ELSE n END, CASE WHEN t.p = pos THEN m ELSE id END,
    CASE WHEN t.p = pos THEN qnid WHEN n = pos THEN m ELSE nid END, step + 1
  FROM t JOIN (
    SELECT best.w, k & 65535 AS pos, k >> 16 AS m, q.p AS gone, q.n AS qn, q.nid AS qnid
    FROM (
      SELECT t.w, min((CAST(m AS BIGINT) << 16) | p) AS k, arg_min(n, (CAST(m AS BIGINT) << 16) | p) AS nx
      FROM t JOIN merges ON t.id = merges.l AND t.nid = merges.r GROUP BY t.w) best
    JOIN t q ON q.w = best.w AND q.p = best.nx) x ON t.w = x.w
  WHERE t.p <> gone)
SELECT t.w, t.p, t.id FROM t JOIN (SELECT w, max(step) AS top FROM t GROUP BY w) last ON t.w = last.w AND t.step = last.top
"""
_DECODE = "SELECT d, string_agg(bytes, '' ORDER BY p) AS bytes FROM tokens JOIN vocab USING (id) GROUP BY d ORDER BY d"


def _few(raw: bytes) -> int:
    """One or two bytes as a number."""
    return raw[0] if len(raw) == 1 else 256 + raw[0] * 256 + raw[1]


class Codec:
    """A rank file in DuckDB tables, and what this task has met so far."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        r = self.ranks
        merges = [(r[t[:i]], r[t[i:]], m) for t, m in r.items() for i in range(1, len(t)) if t[:i] in r and t[i:] in r]
        #: For long pieces: merges by pair, tokens that a lower merge may follow, last and first bytes of every token,
        #: and the lowest rank of a token that holds given bytes on both sides of a place.
        self.pairs = np.array(sorted((a << 32 | b, m) for a, b, m in merges) or [(-1, 0)], np.int64)
        self.early = np.array(sorted({x for a, b, m in merges for x in (a, b) if m < x}), np.int64)
        self.heads, self.tails, self.lengths = (np.zeros(1 + max(r.values()), np.int64) for _ in range(3))
        for t, m in r.items():
            self.heads[m], self.tails[m], self.lengths[m] = _few(t[:2]), _few(t[-2:]), len(t)
        across: dict[int, int] = {}
        for t, m in sorted(r.items(), key=lambda x: x[1]):
            for i in range(1, len(t)):
                for left in {t[i - 1 : i], t[max(i - 2, 0) : i]}:
                    for right in {t[i : i + 1], t[i : i + 2]}:
                        across.setdefault(_few(left) << 20 | _few(right), m)
        self.across = np.array(sorted(across.items()) or [(-1, 0)], np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        left, right, merged = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True)) if merges else [pa.array([], pa.int32())] * 3
        self._table("merges", l=left, r=right, m=merged)
        self._table("vocab", id=pa.array(list(r.values()), pa.int32()), bytes=pa.array([t.decode("latin-1") for t in r]))
        self._forget()

    def _forget(self) -> None:
        #: Token ids of all sequences met, one behind the other; a sequence is a number.
        self.flat, self.start, self.size = array("i"), array("q"), array("q")
        #: Sequences by piece, and by chunk of a text.
        self.pieces: dict[str, int] = {}
        self.known: dict[str | tuple, int] = {}

    def _pieces_of(self, chunk: str | tuple) -> list[str]:
        if isinstance(chunk, str):
            return [f" {chunk}"] if _WORD(chunk) else self.find(f" {chunk}")
        return [chunk[0]] if len(chunk) == 1 else self.find(chunk[0])

    def _add(self, tokens: np.ndarray, size: np.ndarray) -> range:
        """New sequences of these sizes; their numbers."""
        base = len(self.start)
        self.start.frombytes((len(self.flat) + np.cumsum(size) - size).astype(np.int64).tobytes())
        self.size.frombytes(size.astype(np.int64).tobytes())
        self.flat.frombytes(tokens.astype(np.int32).tobytes())
        return range(base, len(self.start))

    def _gather(self, sequences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of sequences, one behind the other, and the size of each."""
        start, size, flat = (np.array(x) for x in (self.start, self.size, self.flat))
        n = size[sequences]
        return flat[np.repeat(start[sequences] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def contract_long(self, pieces: list[str]) -> None:
        """Tokens of long pieces, many merges a round, equal to one merge at a time.

        A pair merges at once if every token that could ever reach over one of its two outer borders has a higher rank:
        nothing can then change the pair before its turn.  (Such a token holds both tokens at the border, so their last
        and first two bytes bound its rank.)  Between borders that no token reaches over, all places of the lowest pair
        merge too, from the left; only the first one if a still lower pair could follow.  Work and memory follow the
        piece's length.
        """
        raw = [x.encode() for x in pieces]
        ids = self.byte[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int64)
        word = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
        place = np.arange(len(ids))
        done: list[tuple[np.ndarray, ...]] = []

        def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(table[:, 0], keys), len(table) - 1)
            return np.where(table[at, 0] == keys, table[at, 1], _NONE)

        while len(ids):
            following = np.append(ids[1:], 0)
            apart = np.append((word[:-1] != word[1:]) | (place[:-1] + self.lengths[ids[:-1]] != place[1:]), True)
            border = np.where(apart, _NONE, find(self.across, self.tails[ids] << 20 | self.heads[following]))
            edge = border == _NONE  # no token reaches over it, now or later: what lies between two such borders is on its own
            rank = np.where(edge, _NONE, find(self.pairs, ids << 32 | following))
            starts = np.flatnonzero(np.append(True, edge[:-1]))
            size = np.diff(np.append(starts, len(ids)))
            low = np.minimum.reduceat(rank, starts)
            least = np.repeat(low, size)
            safe = (rank < np.append(_NONE, border[:-1])) & (rank < np.append(border[1:], _NONE)) & (rank < _NONE)
            hit = (rank == least) & (rank < _NONE)
            at = np.arange(len(ids))
            run = at - np.maximum.accumulate(np.where(hit, -1, at))  # place in a row of overlapping pairs, from 1
            hit &= run % 2 == 1
            first = np.minimum.reduceat(np.where(hit, at, len(ids)), starts)
            hit &= ~np.repeat(np.isin(low, self.early), size) | (at == np.repeat(first, size))
            take = hit | safe
            merged, keep = np.where(take, rank, ids), ~np.append(False, take[:-1])
            ended = keep & (least == _NONE)
            done.append((place[ended], merged[ended], word[ended]))
            keep &= ~ended
            ids, word, place = merged[keep], word[keep], place[keep]
        places, tokens, words = (np.concatenate(x) for x in zip(*done, strict=True))
        made = self._add(tokens[np.argsort(places)], np.bincount(words, minlength=len(raw)))
        self.pieces.update(zip(pieces, made, strict=True))

    def _run(self, pieces: list[str]) -> None:
        raw = [x.encode() for x in pieces]
        size = np.array([len(x) for x in raw])
        w, end = np.repeat(np.arange(len(raw), dtype=np.int32), size), np.cumsum(size)
        p = (np.arange(len(w)) - np.repeat(end - size, size)).astype(np.int32)
        ids = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        n, nid = p + 1, np.append(ids[1:], np.int32(-1))
        n[end - 1] = nid[end - 1] = -1
        self.db.register("pieces", pa.table({"w": w, "p": p, "n": n, "id": ids, "nid": nid}))
        out = self.db.execute(_BULK).fetchnumpy()
        self.db.unregister("pieces")
        order = np.lexsort((out["p"], out["w"]))
        made = self._add(out["id"][order], np.bincount(out["w"], minlength=len(raw)))
        self.pieces.update(zip(pieces, made, strict=True))

    def _learn(self, pieces: set[str]) -> None:
        """Token ids of pieces not met before; a piece that is a token by itself is that token."""
        whole, short, long = {}, [], []
        for x in pieces:
            raw = x.encode()
            if raw in self.ranks:
                whole[x] = self.ranks[raw]
            else:
                (short if len(raw) <= SHORT else long).append(x)
        self.pieces.update(zip(whole, self._add(np.array([*whole.values()], np.int32), np.ones(len(whole))), strict=True))
        for contract, some in ((self._run, short), (self.contract_long, long)):
            ends = np.cumsum([len(x) for x in some]) // CHUNK
            for k in np.unique(ends):
                lo, hi = np.searchsorted(ends, [k, k + 1])
                contract(some[lo:hi])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one behind the other, and the number of tokens of each.

        A piece never reaches over a space that follows a non-space, so texts are cut there and each distinct chunk
        is matched once.  Texts with other runs of white space are matched whole.
        """
        if len(self.start) > KNOWN:
            self._forget()
        flat, count = [], []
        for t in texts:
            if _TORN.search(t):
                own = [(x,) for x in self.find(t)]
            else:
                own = t.split(" ")
                own[0] = (own[0], 0)
            flat += own
            count.append(len(own))
        new = set(flat) - self.known.keys()
        # a matched piece is (piece,), the first chunk of a text (chunk, 0), a chunk after a space is a plain string
        chunks = {c: self._pieces_of(c) for c in new}
        self._learn(set(chain.from_iterable(chunks.values())) - self.pieces.keys())
        get = self.pieces.__getitem__
        self.known.update((c, get(p[0])) for c, p in chunks.items() if len(p) == 1)
        some = {c: p for c, p in chunks.items() if len(p) != 1}
        tokens, n = self._gather(np.array([*map(get, chain.from_iterable(some.values()))], np.int64))
        edge = np.cumsum([0, *map(len, some.values())])
        self.known.update(zip(some, self._add(tokens, np.diff(np.append(0, np.cumsum(n))[edge])), strict=True))
        met = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        tokens, n = self._gather(met)
        return tokens, np.diff(np.append(0, np.cumsum(n))[np.cumsum([0, *count])])

    def decode(self, tokens: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The bytes of every text, by ordered aggregation over at most ``TOKENS`` rows at a time."""
        out: list[list[str]] = [[] for _ in size]
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
        for at in range(0, len(tokens), TOKENS):
            part = slice(at, at + TOKENS)
            self.db.register("tokens", pa.table({"d": owner[part], "p": np.arange(len(owner[part]), dtype=np.int32), "id": tokens[part]}))
            got = self.db.execute(_DECODE).fetchnumpy()
            self.db.unregister("tokens")
            for d, text in zip(got["d"].tolist(), got["bytes"].tolist(), strict=True):
                out[d].append(text)
        return ["".join(x).encode("latin-1") for x in out]


_CODECS: dict[tuple[int, str], Codec] = {}


def _slices(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, tokens (array of int), decoded (binary, read back from the tokens).

    Every match of ``pattern`` is encoded by itself and no string is special.  Null and empty texts have no tokens.
    ``rank_file`` is read by the driver and broadcast: a vocabulary, whose size does not depend on the data.  Nothing
    is shuffled.  A task remembers at most about ``KNOWN`` pieces beyond one slice of text.
    """
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = (hash(shared.value), pattern)
        if name not in _CODECS:
            _CODECS.clear()
            _CODECS[name] = Codec(shared.value, pattern)
        codec = _CODECS[name]
        for b in batches:
            texts, at = [x or "" for x in b.column("text").to_pylist()], 0
            for part in _slices(texts):
                tokens, size = codec.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(tokens))
                arrays = [b.column("doc_id").slice(at, len(part)), lists, pa.array(codec.decode(tokens, size), pa.binary())]
                at += len(part)
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "tokens", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, tokens array<int>, decoded binary")
