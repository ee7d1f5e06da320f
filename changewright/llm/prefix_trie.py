"""Conversation prefix trie by splitter paths.

A conversation is a path of turn digests.  Paths are range-partitioned; a prefix whose conversations may lie in two
shards is a prefix of the first path of the later one.  Those first paths are the *skeleton*: a bounded table that is
broadcast.  Each sorted shard finishes all other nodes alone; of skeleton nodes it gives partial aggregates, which one
reduction combines.  Paths are cut into bands of ``BAND`` turns, so no row grows with a conversation: a band is a trie
of its own below the node where it starts, and totals cross bands by pointer doubling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changewright.llm.common import cut, drop_table
from changewright.operators import ordered

#: Turns of a band; bytes of paths that a shard holds; bands of one conversation whose order one task works out.
BAND, SHARD_BYTES, SLICE = 32, 1 << 24, 1 << 12
ROOT = ["band", "r1", "r2"]
NODE = [*ROOT, "at", "prefix"]
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, d, md5, bytes): the turns of every conversation from 1, ordered by turn (null first), then by digest.

    Null role or text is empty.  Rows without a conversation id belong to none and go.  Repeated rows are turns of
    their own.  One conversation may hold any share of the rows: numbering runs in slices of a range sort.
    """
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said)).alias("md5"),
        F.octet_length(said).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("place"))
    return ordered.number_by(rows, ["conv"], [F.col("turn"), F.col("md5"), F.col("place")], "d").select("conv", "d", "md5", "bytes")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """(conv, d, md5, bytes, total): conversations that begin with turns of the first of their family.

    Conversation c takes the first h turns of conversation c - c % family, then its own after the first h, where
    h = crc32(c) % (most + 1).  Every conversation also has a row d = 0, without a digest.
    """
    lengths = turns.groupBy("conv").agg(F.count("*").alias("len"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).cast("long")
    info = lengths.select("conv", "len", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    heads = lengths.select(F.col("conv").alias("base"), F.least("len", F.lit(most)).alias("have"))
    nb = F.least("h", F.coalesce("have", F.lit(0).cast("long")))
    info = info.join(heads, "base", "left").select("conv", "base", "h", nb.alias("nb"), (nb + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("total"))
    info = cut(info)  # a plain table, so that the join with a long conversation can be split
    head = turns.where(F.col("d") <= most).withColumnRenamed("conv", "base").join(info, "base").where("d <= h").select("conv", "d", "md5", "bytes", "total")
    tail = turns.join(info, "conv").where("d > h").select("conv", (F.col("nb") + F.col("d") - F.col("h")).alias("d"), "md5", "bytes", "total")
    top = info.select("conv", F.lit(0).cast("long").alias("d"), F.lit(None).cast("string").alias("md5"), F.lit(0).cast("long").alias("bytes"), "total")
    return head.unionByName(tail).unionByName(top)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def _next_root(path: str) -> list[Column]:
    """Name of the band that starts below ``path``: two XOR sums over the bands above, by number and content."""
    return [F.col("r1").bitwiseXOR(F.xxhash64("band", path)), F.col("r2").bitwiseXOR(F.xxhash64(F.lit(1), "band", path))]


def _bands(turns: DataFrame, width: int) -> DataFrame:
    """(conv, band, path, bytes, more, r1, r2): at most ``width`` turns a row; ``more``: the conversation goes on below."""
    band = _div(F.greatest(F.col("d") - 1, F.lit(0)), width)
    listed = F.array_sort(F.collect_list(F.when(F.col("d") > 0, F.struct("d", "md5", "bytes"))))
    grouped = turns.groupBy("conv", band.alias("band")).agg(listed.alias("t"), F.first("total").alias("total"))
    rows = cut(grouped.select(
        "conv", "band", F.unhex(F.array_join("t.md5", "")).alias("path"), F.col("t.bytes").alias("bytes"),
        (F.col("total") > (F.col("band") + 1) * width).alias("more"), (F.col("total") > width).alias("long")))
    zero = F.lit(0).cast("long")
    short = rows.where("not long").withColumns({"r1": zero, "r2": zero})
    named = rows.where("long").withColumns({"slice": _div(F.col("band"), SLICE), "x1": F.xxhash64("band", "path"), "x2": F.xxhash64(F.lit(1), "band", "path")})
    inside = Window.partitionBy("conv", "slice").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = named.groupBy("conv", "slice").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    carried = sums.select("conv", "slice", *[F.coalesce(F.bit_xor(x).over(across), zero).alias(c) for x, c in (("x1", "c1"), ("x2", "c2"))])
    local = named.withColumns({f"r{i}": F.coalesce(F.bit_xor(f"x{i}").over(inside), zero) for i in (1, 2)}).join(carried, ["conv", "slice"])
    deep = local.withColumns({f"r{i}": F.col(f"r{i}").bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)})
    return short.unionByName(deep.select(*short.columns)).drop("long")


def _finish(batch: pa.Table, following: dict[int, tuple], first: int, width: int) -> pa.Table:
    """Nodes of one shard.  ``following``: of each shard but the last, root and path where the next one starts."""
    shard = batch.column("shard")[0].as_py()
    rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("band", "r1", "r2", "path", "conv", "bytes", "more")), strict=True), key=lambda r: r[:5])
    m, conv, more = len(rows), np.array([r[4] for r in rows], np.int64), np.array([r[6] for r in rows])
    ln = np.array([len(r[3]) // 16 for r in rows])
    top = int(ln.max())
    paths = rows + [(*following[shard], 0, [], False)] if shard in following else rows
    words = np.zeros((len(paths), top, 2), np.uint64)
    size = np.minimum([len(r[3]) // 16 for r in paths], top)
    words[np.arange(top) < size[:, None]] = np.frombuffer(b"".join(r[3][: 16 * k] for r, k in zip(paths, size, strict=True)), np.uint64).reshape(-1, 2)
    # common[i]: turns that path i shares with the one before it; -1 where they hang on different roots
    alike = (words[1:] == words[:-1]).all(axis=2) & (np.arange(top) < np.minimum(size[1:], size[:-1])[:, None])
    same = np.array([a[:3] == b[:3] for a, b in zip(paths[1:], paths[:-1], strict=True)], bool)
    common = np.append(-1, np.where(same, np.logical_and.accumulate(alike, axis=1).sum(axis=1), -1)).astype(int)
    spine = np.full(m, -1)  # a row's nodes down to this depth are of the skeleton
    if shard != first:
        spine = np.minimum.accumulate(np.append(ln[0], common[1:m]))
    if shard in following:
        spine = np.maximum(spine, np.minimum.accumulate(common[m:0:-1])[::-1])
    common = common[:m]
    weight = np.zeros((m, top + 1), np.int64)
    weight[:, 1:][np.arange(top) < ln[:, None]] = np.concatenate([np.array(r[5], np.int64) for r in rows])
    made: list[dict] = []
    below = None
    for j in range(top, -1, -1):
        edge = np.flatnonzero(common < j)
        end, lo = np.append(edge[1:], m), edge
        live = ln[lo] >= j
        n, least = end - lo, np.minimum.reduceat(conv, edge)
        stop = (ln == j) & ~more
        goes = np.add.reduceat((ln == j) & more, edge) > 0
        lo, end, n, least, goes = lo[live], end[live], n[live], least[live], goes[live]
        skeleton = spine[lo] >= j
        own = (n - 1) * weight[lo, j]
        children, leaves, saved = (np.zeros(len(lo), np.int64) for _ in range(3))
        if below is not None:
            a, b = np.searchsorted(below["lo"], lo), np.searchsorted(below["lo"], end)
            done = ~below["skeleton"]
            total = lambda x: np.append(0, np.cumsum(np.where(done, x, 0)))
            children, leaves, saved = (total(x)[b] - total(x)[a] for x in (1, below["leaves"], below["saved"]))
            parent = np.searchsorted(lo, below["lo"], "right") - 1
            below["parent"], below["parent_skeleton"] = least[parent], skeleton[parent]
        leaves = leaves + np.where(skeleton | goes | (children > 0), 0, 1)
        saved = saved + np.where(skeleton, 0, own)
        ended = np.append(0, np.cumsum(stop))
        names = conv[stop].astype(str).tolist()
        ids = [",".join(names[x:y]) for x, y in zip(ended[lo].tolist(), ended[end].tolist(), strict=True)]
        below = {
            "lo": lo, "at": np.full(len(lo), j), "skeleton": skeleton, "conv": least, "n_convs": n, "bytes": weight[lo, j], "n_children": children, "leaves": leaves,
            "saved": saved, "goes": goes, "ends": [x if s or not x else hashlib.sha256(x.encode()).hexdigest() for x, s in zip(ids, skeleton.tolist(), strict=True)],
        }
        made.append(below)
    made[-1]["parent"], made[-1]["parent_skeleton"] = made[-1]["conv"], np.zeros(len(made[-1]["lo"]), bool)
    of = np.concatenate([x["lo"] for x in made]).tolist()
    at = np.concatenate([x["at"] for x in made]).tolist()
    whole = lambda c: pa.array(np.concatenate([x[c] for x in made]))
    out = {"shard": pa.array(np.full(len(of), shard), pa.int32())}
    out |= {c: pa.array([rows[i][k] for i in of], pa.int64()) for k, c in enumerate(ROOT)}
    out |= {"at": pa.array(at, pa.int64()), "prefix": pa.array([rows[i][3][: 16 * j] for i, j in zip(of, at, strict=True)], pa.binary())}
    out |= {c: whole(c) for c in ("skeleton", "conv", "n_convs", "bytes", "n_children", "leaves", "saved", "goes", "parent", "parent_skeleton")}
    return pa.table(out | {"ends": pa.array([e for x in made for e in x["ends"]], pa.string())})


_MADE = "shard int, band long, r1 long, r2 long, at long, prefix binary, skeleton boolean, conv long, n_convs long, bytes long, n_children long, leaves long, saved long, goes boolean, parent long, parent_skeleton boolean, ends string"


def _digests(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, which come in order; memory is that of one batch, whatever a node's size."""
    key, state = None, None

    def row(key, state):
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, state.hexdigest()), (pa.int64(),) * 4 + (pa.binary(), pa.string()), strict=True)], names=[*NODE, "ends"])

    for b in chunks:
        for *node, text in zip(*(b.column(c).to_pylist() for c in [*NODE, "ends"]), strict=True):
            if node != key:
                if key is not None:
                    yield row(key, state)
                key, state = node, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if key is not None:
        yield row(key, state)


def _cut_prefix(at: Column) -> Column:
    return F.substring(F.col("prefix"), F.lit(1), (at * 16).cast("int"))


def _upwards(nodes: DataFrame, *sums: str) -> DataFrame:
    """Sums of ``sums`` over a band's nodes at or below each node."""
    spread = nodes.select(*NODE, *sums, F.explode(F.sequence(F.lit(0).cast("long"), F.col("at"))).alias("up"))
    return spread.groupBy(*ROOT, F.col("up").alias("at"), _cut_prefix(F.col("up")).alias("prefix")).agg(*[F.sum(c).alias(c) for c in sums])


def _skeleton(made: DataFrame) -> DataFrame:
    """Skeleton nodes of all bands, their partial aggregates combined.  At most (shards - 1) x (band width + 1) rows."""
    parts = made.where("skeleton").groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.sum("n_convs").alias("n_convs"), F.max("bytes").alias("bytes"), F.sum("n_children").alias("n_children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.bool_or("goes").alias("goes"))
    parts = cut(parts)
    up = parts.where("at > 0").select(*ROOT, (F.col("at") - 1).alias("at"), _cut_prefix(F.col("at") - 1).alias("prefix"))
    parts = parts.join(up.groupBy(*NODE).agg(F.count("*").alias("inner")), NODE, "left")
    children = F.col("n_children") + F.coalesce("inner", F.lit(0))
    own = parts.select(
        *NODE, "conv", "n_convs", "bytes", children.alias("n_children"), "goes",
        (F.col("leaves") + F.when((children == 0) & ~F.col("goes"), 1).otherwise(0)).alias("leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    totals = own.drop("leaves", "saved").join(_upwards(own, "leaves", "saved"), NODE)
    chunks = made.where("skeleton and ends <> ''").select(*NODE, "shard", "ends").repartition(*NODE).sortWithinPartitions(*NODE, "shard")
    ends = chunks.select(*NODE, "ends").mapInArrow(_digests, "band long, r1 long, r2 long, at long, prefix binary, ends string")
    return cut(totals.join(ends, NODE, "left"))


def _deep_totals(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(band, r1, r2, leaves, saved) with everything below added, by pointer doubling: a round per bit of the depth.

    ``links``: (band, r1, r2) of a band and (u1, u2) of the one above, which is of number ``band`` - 1.
    """
    now = roots.join(links.where("band > 1"), ROOT, "left").select(*ROOT, "leaves", "saved", F.when(F.col("u1").isNotNull(), F.struct((F.col("band") - 1).alias("band"), F.col("u1").alias("r1"), F.col("u2").alias("r2"))).alias("to"))
    now = cut(now)
    while not now.where("to is not null").isEmpty():
        given = now.where("to is not null").groupBy("to").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).select("to.*", "l", "s")
        further = now.select(F.struct(*ROOT).alias("to"), F.col("to").alias("next"))
        moved = now.join(further, "to", "left").join(given, ROOT, "left")
        after = cut(moved.select(*ROOT, (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), F.col("next").alias("to")))
        drop_table(now)
        now = after
    return now.drop("to")


def prefix_trie(turns: DataFrame, width: int = BAND, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Nodes of the trie over (conv, d, md5, bytes, total) as ``rebuilt`` gives them; one row per node:

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  An empty
    table has no node; conversations without turns are members of the root alone.  Equal conversations, a third of all
    perhaps, are dealt over many shards.  The digest of a node's ids is one chain by definition: its chunks, one per
    shard, stream through one task in constant memory.
    """
    rows = _bands(turns, width)
    count, size, last = rows.agg(F.count("*"), F.sum(F.length("path") + 8 * F.size("bytes") + 64), F.max("band")).first()
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // shard_bytes))
    placed = cut(rows.repartitionByRange(n, *ROOT, "path", "conv").withColumn("shard", F.spark_partition_id()))
    starts = sorted((r["shard"], (r["s"]["band"], r["s"]["r1"], r["s"]["r2"], bytes(r["s"]["path"]))) for r in placed.groupBy("shard").agg(F.min(F.struct(*ROOT, "path")).alias("s")).collect())
    following = {a: b for (a, _), (_, b) in zip(starts, starts[1:], strict=False)}  # at most n paths of one band
    first = starts[0][0] if starts else 0
    shared = rows.sparkSession.sparkContext.broadcast(following)
    made = cut(placed.groupBy("shard").applyInArrow(lambda t: _finish(t, shared.value, first, width), _MADE))
    skeleton = _skeleton(made)
    above = F.broadcast(skeleton.select(*ROOT, (F.col("at") + 1).alias("at"), F.col("prefix").alias("up"), F.col("conv").alias("above")))
    sha = F.when(F.coalesce("ends", F.lit("")) == "", EMPTY).otherwise(F.col("ends")).alias("ends")
    columns = [*NODE, "conv", "n_convs", "n_children", "leaves", "saved", "goes"]
    local = made.where("not skeleton").withColumn("up", F.when(F.col("parent_skeleton"), _cut_prefix(F.col("at") - 1)))
    local = local.join(above, [*ROOT, "at", "up"], "left").select(*columns, F.coalesce("above", "parent").alias("parent"), sha)
    shared_nodes = skeleton.withColumn("up", _cut_prefix(F.col("at") - 1)).join(above, [*ROOT, "at", "up"], "left").select(*columns, F.col("above").alias("parent"), sha)
    nodes = local.unionByName(shared_nodes)
    if last:
        nodes = _joined_bands(cut(nodes), width)
    depth = F.col("band") * width + F.col("at")
    return nodes.select(
        F.col("conv").alias("conv_id"), depth.alias("depth"), F.when(depth > 0, F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def _joined_bands(nodes: DataFrame, width: int) -> DataFrame:
    """Bands below others joined to the nodes they hang on, whose totals grow by theirs."""
    roots = nodes.where("band > 0 and at = 0").select(*ROOT, "leaves", "saved", "n_children")
    bottoms = nodes.where(F.col("goes")).select(*NODE, F.col("conv").alias("above"), (F.col("band") + 1).alias("next"), *[c.alias(f"n{i}") for i, c in enumerate(_next_root("prefix"), 1)])
    links = bottoms.select(F.col("next").alias("band"), F.col("n1").alias("r1"), F.col("n2").alias("r2"), F.col("r1").alias("u1"), F.col("r2").alias("u2"), "above")
    deep = _deep_totals(roots.drop("n_children"), links.drop("above")).join(roots.select(*ROOT, F.col("n_children").alias("inner")), ROOT)
    deep = deep.select(F.col("band").alias("next"), F.col("r1").alias("n1"), F.col("r2").alias("n2"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"), "inner")
    grown = cut(bottoms.join(deep, ["next", "n1", "n2"]).select(*NODE, "more_leaves", "more_saved", "inner"))
    gained = _upwards(grown, "more_leaves", "more_saved")
    zero = F.lit(0).cast("long")
    own = nodes.where("at > 0 or band = 0").join(gained, NODE, "left").join(grown.select(*NODE, "inner"), NODE, "left")
    top = links.select("band", "r1", "r2", F.lit(1).cast("long").alias("at"), "above")
    return own.join(top, [*ROOT, "at"], "left").select(
        *NODE, "conv", "n_convs", (F.col("n_children") + F.coalesce("inner", zero)).alias("n_children"), (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"),
        (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"), F.coalesce("above", "parent").alias("parent"), "ends")


def conversation_trie(conversations: DataFrame, width: int = BAND, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations."""
    return prefix_trie(rebuilt(turn_rows(conversations)), width, shard_bytes)
