"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut in halves, each with its own codebook; pairs of codewords form a grid of cells.  Every vector is
filed under its own cell and sent to the nearest cells in the order of the multi-sequence traversal.  How many cells
that takes is measured on a bounded query sample, all queries weighing the same: the traversal goes on until the
target share of their true neighbours is reached, and of made neighbours at the threshold itself, which do not depend
on how many pairs the table has.  Vectors that meet in a cell are compared exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changewright.llm.common import cut, drop_table
from changewright.llm.components import connected_components, forest

COSINE, RECALL = 0.93, 0.999
#: Rows the codebooks are fitted on and rows the traversal is measured with (least hashes), rows of a label wanted per
#: cell (a vector is sent to every cell it visits, so few full cells cost less than many small ones), most codewords a half.
FIT, QUERIES, PER_CELL, MOST_WORDS = 8192, 512, 128, 1024
#: Neighbours made for each measured row.
MADE = 32
#: Most rows of a side compared at once; fuller cells are cut into parts and every pair of parts is one group.
BLOCK = 2048


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Codewords of the rows ``x``; starts from evenly spaced rows, keeps an empty word where it was."""
    words = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(x, words).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words)
    return words


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ words.T + (words * words).sum(axis=1)[None]


class Grid:
    """Codebooks of both halves, for vectors of one length, and some of the rows they were fitted on."""

    def __init__(self, left: np.ndarray, right: np.ndarray, fitted: np.ndarray):
        self.left, self.right, self.fitted = left, right, fitted
        self.k = len(left)

    def traverse(self, unit: np.ndarray, visits: int) -> np.ndarray:
        """The first ``visits`` cells of the multi-sequence traversal of every row, nearest first.

        A pair of the r-th left and s-th right word has (r + 1) * (s + 1) - 1 nearer pairs at least, so only pairs
        with (r + 1) * (s + 1) <= visits can be among them.
        """
        half = self.left.shape[1]
        a, b = _distances(unit[:, :half], self.left), _distances(unit[:, half:], self.right)
        top = min(self.k, visits)
        i, j = np.argsort(a, axis=1, kind="stable")[:, :top], np.argsort(b, axis=1, kind="stable")[:, :top]
        r, s = np.nonzero(np.outer(np.arange(1, top + 1), np.arange(1, top + 1)) <= visits)
        total = np.take_along_axis(a, i, 1)[:, r] + np.take_along_axis(b, j, 1)[:, s]
        first = np.argsort(total, axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(i[:, r], first, 1) * self.k + np.take_along_axis(j[:, s], first, 1)

    def order(self, unit: np.ndarray) -> np.ndarray:
        """Place of every cell in the traversal of each row."""
        half = self.left.shape[1]
        total = _distances(unit[:, :half], self.left)[:, :, None] + _distances(unit[:, half:], self.right)[:, None, :]
        at = np.argsort(total.reshape(len(unit), -1), axis=1, kind="stable")
        place = np.empty_like(at)
        np.put_along_axis(place, at, np.arange(at.shape[1])[None], 1)
        return place

    def places(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Place (from 1) of one cell in the traversal of each row, counted without the whole order."""
        half = self.left.shape[1]
        a, b = _distances(unit[:, :half], self.left), _distances(unit[:, half:], self.right)
        at = np.arange(len(unit))
        total = a[at, cells // self.k] + b[at, cells % self.k]
        b.sort(axis=1)
        nearer = [np.searchsorted(b[i], total[i] - a[i]).sum() for i in at]
        return np.minimum(np.array(nearer, dtype=np.int64) + 1, self.k * self.k)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _groups(dims: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def visits_at_threshold(grid: Grid, unit: np.ndarray, cosine: float, recall: float) -> int:
    """Cells to visit so that ``recall`` of the vectors at just ``cosine`` from the rows are met, in any direction.

    ``MADE`` such vectors are drawn for each row.  A pair meets if either visits the other's cell.
    """
    rng = np.random.default_rng(0)
    found = []
    for at in range(0, len(unit), 16):
        q = np.repeat(unit[at : at + 16], MADE, axis=0)
        u = rng.normal(size=q.shape)
        u -= (u * q).sum(axis=1, keepdims=True) * q
        made = cosine * q + (1 - cosine * cosine) ** 0.5 * u / np.maximum(np.sqrt((u * u).sum(axis=1, keepdims=True)), 1e-12)
        here, there = grid.traverse(q, 1)[:, 0], grid.traverse(made, 1)[:, 0]
        found.append(np.minimum(grid.places(q, there), grid.places(made, here)))
    places = np.sort(np.concatenate(found))
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)])


def rows_met(classes: DataFrame) -> float:
    """Rows that share a label with a row, on average over the rows: what a grid has to divide."""
    by_label = classes.groupBy("label").agg(F.count("*").cast("double").alias("n"))
    return by_label.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0


def build_grids(classes: DataFrame, n: float, per_cell: int = PER_CELL) -> dict[int, Grid]:
    """A grid for every vector length in a bounded sample, ``n`` rows to divide; other lengths are given one cell."""
    words = int(min(MOST_WORDS, max(1, round((n / per_cell) ** 0.5))))
    rows = classes.orderBy(F.xxhash64("cid")).limit(FIT).select("vec").toArrow().column("vec").to_pylist()
    out = {}
    for d in sorted({len(x) for x in rows}):
        x = _unit(np.array([x for x in rows if len(x) == d], dtype=np.float64))
        k = min(words, len(x))
        out[d] = Grid(_kmeans(x[:, : d // 2], k), _kmeans(x[:, d // 2 :], k), x[:: -(-len(x) // QUERIES)])
    return out


def measure_visits(classes: DataFrame, grids: dict[int, Grid], cosine: float, recall: float) -> int:
    """Cells to visit so that ``recall`` of the neighbours of the query sample are met, made ones and true ones.

    The sample is a stated query set of fixed size, compared with all vectors in blocks; only counts by
    (query, cell) leave a task.  Each query with neighbours weighs the same, so a dense group does not outweigh rows
    with a single partner.  Made neighbours set the floor where true ones are rare: see ``visits_at_threshold``.
    """
    asked = classes.orderBy(F.xxhash64(F.lit(7), "cid")).limit(QUERIES).select("cid", "label", "vec").toArrow().to_pylist()
    by_dim = {d: [q for q in asked if len(q["vec"]) == d] for d in grids}
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast((grids, by_dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids, by_dim = shared.value
        for b in batches:
            for d, at in _groups(np.array(b.column("vec").value_lengths())):
                if not by_dim.get(d):
                    continue
                part = b.take(pa.array(at))
                x, cid, label = _unit(_matrix(part.column("vec"), d)), np.array(part.column("cid")), np.array(part.column("label"))
                q = _unit(np.array([r["vec"] for r in by_dim[d]], dtype=np.float64))
                near = (q @ x.T >= cosine) & (np.array([r["label"] for r in by_dim[d]])[:, None] == label[None]) & (np.array([r["cid"] for r in by_dim[d]])[:, None] != cid[None])
                i, j = np.nonzero(near)
                cell = grids[d].traverse(x[j], 1)[:, 0] if len(j) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(cell.astype(np.int32))], names=["d", "q", "cell"])

    met = classes.select("cid", "label", "vec").mapInArrow(run, "d int, q int, cell int").groupBy("d", "q", "cell").count().collect()
    floor = 1
    for d, grid in grids.items():
        q = _unit(np.array([r["vec"] for r in by_dim[d]], dtype=np.float64)) if by_dim[d] else grid.fitted
        floor = max(floor, visits_at_threshold(grid, q, cosine, recall))
    places = []
    for d, grid in grids.items():
        own = [r for r in met if r["d"] == d]
        if own:
            q = _unit(np.array([r["vec"] for r in by_dim[d]], dtype=np.float64))
            asked_rows = sorted({r["q"] for r in own})
            order = {}
            for at in range(0, len(asked_rows), 16):
                some = asked_rows[at : at + 16]
                order |= dict(zip(some, grid.order(q[some]), strict=True))
            total = Counter()
            for r in own:
                total[r["q"]] += r["count"]
            places += [(int(order[r["q"]][r["cell"]]) + 1, r["count"] / total[r["q"]]) for r in own]
    places.sort()
    need, seen = recall * sum(n for _, n in places), 0.0
    for place, n in places:
        seen += n
        if seen >= need:
            return max(floor, place)
    return max(floor, places[-1][0]) if places else floor


def file_and_probe(classes: DataFrame, grids: dict[int, Grid], visits: int) -> DataFrame:
    """Adds ``cells``: the cells visited, the own one first."""
    shared = classes.sparkSession.sparkContext.broadcast((grids, visits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids, visits = shared.value
        for b in batches:
            cells: list = [[0]] * b.num_rows
            for d, at in _groups(np.array(b.column("vec").value_lengths())):
                if d in grids:
                    for i, row in zip(at, grids[d].traverse(_unit(_matrix(b.column("vec").take(pa.array(at)), d)), visits).tolist(), strict=True):
                        cells[i] = row
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cid", "label", "m", "vec")), pa.array(cells, pa.list_(pa.int32()))], names=["cid", "label", "m", "vec", "cells"])

    return classes.select("cid", "label", "m", "vec").mapInArrow(run, "cid long, label int, m long, vec array<float>, cells array<int>")


def _compare(group: pa.Table, cosine: float) -> Iterator[pa.RecordBatch]:
    """One cell, or one pair of its parts: filed rows (side 0) against visitors (side 1).

    A pair whose both rows visit each other's cell meets twice and is counted where the visitor has the lesser cid.
    """
    side = np.array(group.column("side"))
    base, seek = group.filter(pa.array(side == 0)), group.filter(pa.array(side == 1))
    if not base.num_rows or not seek.num_rows:
        return
    d = int(np.array(base.column("dim"))[0])
    x, y = (_matrix(t.column("vec").combine_chunks(), d) for t in (base, seek))
    s = (x @ y.T) / (np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None])
    i, j = np.nonzero(s >= cosine)
    a, b = np.array(base.column("cid")), np.array(seek.column("cid"))
    home, place = np.unique(np.array(seek.column("home")), return_inverse=True)
    cells = base.column("cells").combine_chunks()
    visited = cells.flatten().to_numpy(zero_copy_only=False).reshape(base.num_rows, -1)
    mutual = np.stack([(visited == h).any(axis=1) for h in home], axis=1)
    keep = (a[i] != b[j]) & (~mutual[i, place[j]] | (b[j] < a[i]))
    i, j = i[keep], j[keep]
    if not len(i):
        return
    ids, lane = np.unique(np.concatenate([a, b]), return_inverse=True)
    la, lb = lane[: len(a)][i], lane[len(a) :][j]
    n = np.bincount(la, weights=np.array(seek.column("m"))[j], minlength=len(ids)) + np.bincount(lb, weights=np.array(base.column("m"))[i], minlength=len(ids))
    root = np.arange(len(ids))
    linked, low = forest(la, lb, len(ids))
    root[linked] = low
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(n[some].astype(np.int64))], names=["cid", "root", "n"])


def _meet(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Sorted rows group by group; at most one unfinished group is held."""
    held: list[pa.RecordBatch] = []
    last = None
    keys = ("label", "dim", "cell", "s", "t")
    for b in batches:
        cols = np.stack([np.array(b.column(c)) for c in keys])
        edges = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            key = tuple(cols[:, lo].tolist())
            if held and key != last:
                yield from _compare(pa.Table.from_batches(held), cosine)
                held = []
            last = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield from _compare(pa.Table.from_batches(held), cosine)


def near_pairs(filed: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """Filed classes -> (cid, root, n): links of each class counted in rows, and edges that span its component."""
    sent = filed.select("cid", "label", "m", "vec", "cells", F.size("vec").alias("dim"), F.get("cells", F.lit(0)).alias("home"), F.posexplode("cells").alias("p", "cell"))
    cell = ["label", "dim", "cell"]
    base, seek = sent.where("p = 0"), sent
    parts = sent.groupBy(*cell).agg(F.count(F.when(F.col("p") == 0, 1)).alias("nb"), F.count("*").alias("ns")).where("nb > 0")
    parts = parts.select(*cell, F.ceil(F.col("nb") / block).cast("int").alias("pb"), F.ceil(F.col("ns") / block).cast("int").alias("ps"))
    # written, so that its size is known: broadcast if Spark finds it small, else a join that may split a full cell.
    # Visitors of a cell where nothing is filed meet nobody and end at this join
    parts = cut(parts)
    own = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    columns = [*cell, "s", "t", "side", "cid", "m", "vec", "cells", "home"]
    b = base.join(parts, cell).withColumn("s", own("pb")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("ps") - 1))).withColumn("side", F.lit(0))
    q = seek.join(parts, cell).withColumn("t", own("ps")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("pb") - 1))).withColumn("side", F.lit(1))
    q = q.withColumn("cells", F.array().cast("array<int>"))
    group = [*cell, "s", "t"]
    rows = b.select(*columns).unionByName(q.select(*columns)).repartition(*group).sortWithinPartitions(*group)
    return rows.mapInArrow(lambda x: _meet(x, cosine), "cid long, root long, n long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", per_cell: int = PER_CELL) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Equal vectors of one label are one class with a count, so copies are never paired.  Vectors that are null, zero
    or not finite, or whose label is null, link with nothing; vectors of different lengths do not link either.
    Repeated rows count as vectors of their own.  A null id takes part but names no component unless it is alone.
    """
    x = F.col("vec")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vec_col).cast("array<float>").alias("vec"))
    bad = x.isNull() | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists(x, lambda v: v != 0)
    fine = F.coalesce(~bad & F.col("label").isNotNull(), F.lit(False))
    named = rows.select("vec_id", "label", fine.alias("fine"), F.when(fine, F.xxhash64("label", "vec")).alias("h"), F.when(fine, F.xxhash64("vec", "label")).alias("g"), "vec")
    folded = named.where("fine").groupBy("h", "g").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("m"), F.min("vec_id").alias("least"))
    classes = cut(folded.withColumn("cid", F.monotonically_increasing_id()))
    grids = build_grids(classes, rows_met(classes), per_cell)
    visits = measure_visits(classes, grids, cosine, recall)
    filed = cut(file_and_probe(classes, grids, visits))
    met = cut(near_pairs(filed, cosine))
    links = met.groupBy("cid").agg(F.sum("n").alias("n"))
    roots = cut(connected_components(met.select("cid", "root"), "cid", "root"))
    member = classes.select("cid", "h", "g", "m", "least").join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(links, "cid", "left")
    member = member.withColumn("root", F.coalesce("root", "cid"))
    first = member.groupBy("root").agg(F.min("least").alias("component"))
    by_class = cut(member.join(first, "root").select("h", "g", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n"), "component"))
    for t in (filed, met, roots, classes):
        drop_table(t)
    alone = named.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = named.where("fine").select("vec_id", "h", "g").join(by_class, ["h", "g"]).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
