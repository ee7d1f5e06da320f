"""Dependency graphs: levels, exact deploy order, cycles.

A node is a change, known by its plan position.  An edge goes from a required
change (``src``) to the change that needs it (``dst``).

A project whose changes and requirements number at most ``ORDERED`` rows (for
cycles, whose walk needs more memory a row, ``LOCAL``) is walked in one task
(``plan_walk``); its size is counted, not guessed.  Larger projects are worked on as edge tables: blocks of neighbouring
positions are folded in a task each, then blocks of what crossed their borders.  Where requirements reach too far for that to
shrink the table, whatever hangs on a single change is folded onto it by pointer doubling, so straight runs and trees of any
depth take rounds by the logarithm of their length, and only places where several paths meet take a round each.  Every round is a table in the shared checkpoint
folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewright.functions.names import base_name
from changewright.functions.values import is_non_transactional
from changewright.operators import history, ordered, plan_walk
from changewright.operators.history import KEYS
from changewright.session import cut, drop_table

#: Changes and requirements of a group that one task searches for cycles, in dictionaries of some 400 bytes a row.
LOCAL = 1 << 17
#: Those of a group that one task puts in order, in arrays of about 100 bytes a row.
ORDERED = 1 << 22
#: Requirements of neighbouring changes that one task folds, in lists of some 500 bytes a row.
BLOCK = 1 << 18
#: How the weights of a path are folded, as columns and inside a task.
COMBINE = {"sum": (operator.add, operator.add), "max": (F.greatest, max)}


class CycleError(ValueError):
    """The requirements of some changes form a cycle."""


def requirement_edges(changes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges inside the plan; a name means its first change, unknown names are skipped."""
    wants = changes.select(*keys, F.col("pos").alias("dst"), F.explode("requires").alias("_dep"))
    wants = wants.select(*keys, "dst", base_name(F.col("_dep")).alias("name"))
    firsts = history.first_of_name(changes, keys).select(*keys, "name", F.col("pos").alias("src"))
    return wants.join(firsts, [*keys, "name"]).select(*keys, "src", "dst").distinct()


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _jump(pointers: DataFrame, keys: Sequence[str], combine: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Follow (node, up, w) until ``up`` is no node of the table; ``combine`` folds the weights on the way.

    Every round doubles the way of each pointer.  Returns the pointers at their ends and those that have none: once as
    many move as in the round before, all of them are on a cycle of pointers or lead into one.
    """
    now, before = cut(pointers), None
    while True:
        ahead = now.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("w").alias("_w"), F.lit(True).alias("_more"))
        more = F.col("_more").isNotNull()
        moved = now.drop("moved").join(ahead, [*keys, "up"], "left").select(
            *keys, "node", F.when(more, F.col("_up")).otherwise(F.col("up")).alias("up"), F.when(more, combine(F.col("_w"), F.col("w"))).otherwise(F.col("w")).alias("w"), more.alias("moved"))
        after = cut(moved)
        drop_table(now)
        count = after.where("moved").count()
        if count == 0 or count == before:
            return after.where("not moved").drop("moved"), after.where("moved").drop("moved")
        now, before = after, count


def fold_paths(edges: DataFrame, keys: Sequence[str], how: str) -> tuple[DataFrame, DataFrame]:
    """(node, w): the largest weight over all paths from a node without requirements; and (node): those on or behind a cycle.

    ``edges`` has ``src``, ``dst`` and ``w``; ``how`` (of ``COMBINE``) folds the weights of a path.  Nodes without requirements
    are not listed.  Every block of neighbouring positions is folded in one task (``plan_walk.fold_block``): a node then hangs
    on starts, on a few nodes of other blocks or on meeting places of its own.  Only what others hang on is folded further,
    in blocks again while that halves the rows, else in rounds of joins; all further nodes look up what they hang on.
    """
    step, walk = COMBINE[how]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema if f.name in keys]
    rows = edges.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("src", "dst", "w")])
    placed = rows.where("dst is not null")
    count = placed.count()
    blocks = placed.repartitionByRange(max(1, -(-count // BLOCK)), *keys, "dst")
    held = cut(blocks.mapInArrow(lambda batches: plan_walk.fold_block(batches, keys, walk), ", ".join([*kinds, "node long, up long, w long, n long"])))
    hung = held.where("up is not null")
    above = cut(hung.select(*keys, F.col("up").alias("node")).distinct())
    left = cut(held.join(above, [*keys, "node"], "left_semi").select(*keys, F.col("up").alias("src"), F.col("node").alias("dst"), "w"))
    many = left.count()
    ended = left.select(*keys, F.col("dst").alias("node"), "w")
    if many:
        ended = fold_paths(left, keys, how)[0] if 2 * many <= count else _fold_rounds(left, keys, step)
    starts = above.join(left.select(*keys, F.col("dst").alias("node")).distinct(), [*keys, "node"], "left_anti")
    known = cut(ended.select(*keys, F.col("node").alias("up"), F.col("w").alias("_w")).unionByName(starts.select(*keys, F.col("node").alias("up"), F.lit(None).cast("long").alias("_w"))))
    total = F.when(F.col("_w").isNull(), F.col("w")).otherwise(step(F.col("_w"), F.col("w")))
    found = held.where("up is null").select(*keys, "node", "w", "n").unionByName(hung.join(known, [*keys, "up"]).select(*keys, "node", total.alias("w"), "n"))
    several = found.where("n > 1").groupBy(*keys, "node", "n").agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("_known"))
    resolved = [found.where("n = 1").select(*keys, "node", "w"), several.where("_known = n").select(*keys, "node", "w")]
    lost = hung.join(known, [*keys, "up"], "left_anti").select(*keys, "node").distinct()
    return _union(resolved), rows.where("dst is null").select(*keys, F.col("dst").alias("node")).distinct().unionByName(lost)


def _fold_rounds(edges: DataFrame, keys: Sequence[str], combine: Callable[[Column, Column], Column]) -> DataFrame:
    """(node, w) of the nodes of ``edges`` that are not on or behind a cycle; a row without ``src`` comes from a start.

    A round takes every node with a single requirement, follows it up to the next node with several (or to the start), and
    hangs the edges that leave it there; several edges between two nodes become their largest.
    """
    def merged(rows: DataFrame) -> DataFrame:
        return cut(rows.groupBy(*keys, "up", "dst").agg(F.max("w").alias("w")))

    waiting = edges.select(*keys, F.col("dst").alias("src"), F.lit(True).alias("_waits")).distinct()
    now = merged(edges.join(waiting, [*keys, "src"], "left").select(*keys, F.when(F.col("_waits"), F.col("src")).alias("up"), "dst", "w"))
    ends: list[DataFrame] = []
    while True:
        counted = cut(now.groupBy(*keys, "dst").agg(F.count(F.lit(1)).alias("n"), F.max("up").alias("up"), F.max("w").alias("w")))
        single = counted.where("n = 1").select(*keys, F.col("dst").alias("node"), "up", "w")
        if single.isEmpty():
            break
        ended, _ = _jump(single, keys, combine)
        ends.append(ended)
        several = now.join(counted.where("n > 1").select(*keys, "dst"), [*keys, "dst"], "left_semi")
        above = ended.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("w").alias("_w"), F.lit(True).alias("_more"))
        more = F.col("_more").isNotNull()
        hung = several.join(above, [*keys, "up"], "left").select(
            *keys, F.when(more, F.col("_up")).otherwise(F.col("up")).alias("up"), "dst", F.when(more, combine(F.col("_w"), F.col("w"))).otherwise(F.col("w")).alias("w"))
        after = merged(hung)
        drop_table(counted)
        drop_table(now)
        now = after
    if not ends:
        return now.where("false").select(*keys, F.col("dst").alias("node"), "w")
    done, _ = _jump(_union(ends), keys, combine)
    return done.where("up is null").select(*keys, "node", "w")


def _split(nodes: DataFrame, edges: DataFrame, group: Sequence[str], local: int) -> tuple[DataFrame, DataFrame]:
    """(rows of bounded groups, names of the others); a row without ``src`` is a node."""
    rows = nodes.select(*group, "pos", F.lit(None).cast("long").alias("src")).unionByName(edges.select(*group, F.col("dst").cast("long").alias("pos"), F.col("src").cast("long").alias("src")))
    sizes = cut(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")))
    return rows.join(sizes.where(F.col("_n") <= local).select(*group), list(group), "left_semi"), sizes.where(F.col("_n") > local).select(*group)


def _walk(rows: DataFrame, group: Sequence[str], walk: Callable, *columns: str) -> DataFrame:
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in group] + [f"{c} long" for c in columns]
    return rows.groupBy(*group).applyInArrow(lambda t: walk(t, group), ", ".join(kinds))


def deploy_levels(changes: DataFrame, keys: Sequence[str] = KEYS, local: int = ORDERED) -> DataFrame:
    """Longest-path depth of each change; ordering by (level, pos) is a valid order."""
    edges = cut(requirement_edges(changes, keys))
    small, large = _split(changes.select(*keys, F.col("pos").cast("long").alias("pos")), edges, keys, local)
    walked = cut(_walk(small, keys, plan_walk.order_and_level, "pos", "rank", "level"))
    depth = walked.select(*keys, "pos", "level")
    cyclic = not walked.where("rank < 0").isEmpty()
    if not large.isEmpty():
        own = edges.join(large, list(keys), "left_semi")
        folded, stuck = fold_paths(own.withColumn("w", F.lit(1)), keys, "sum")
        cyclic = cyclic or not stuck.isEmpty()
        depth = depth.unionByName(folded.select(*keys, F.col("node").alias("pos"), F.col("w").alias("level")))
    if cyclic:
        raise CycleError("requirements form a cycle; see cycles()")
    base = changes.select(*keys, "change_id", "name", "pos")
    return base.join(depth, [*keys, "pos"], "left").withColumn("level", F.coalesce("level", F.lit(0).cast("long")))


def _propagate_max(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest ancestor of each node, only for nodes where it exceeds the node itself.

    Semi-naive: a round pushes only the labels that the last round raised.
    """
    raised = edges.where("src > dst").groupBy(*keys, F.col("dst").alias("node")).agg(F.max("src").alias("label"))
    raised = cut(raised.withColumn("fresh", F.lit(True)))
    while not raised.where("fresh").isEmpty():
        news = raised.where("fresh").select(*keys, F.col("node").alias("src"), "label")
        pushed = edges.join(news, [*keys, "src"]).where("label > dst")
        pushed = pushed.groupBy(*keys, F.col("dst").alias("node")).agg(F.max("label").alias("pushed"))
        both = raised.drop("fresh").join(pushed, [*keys, "node"], "full")
        grew = F.col("pushed").isNotNull() & (F.col("label").isNull() | (F.col("pushed") > F.col("label")))
        raised = cut(both.select(*keys, "node", F.greatest("label", "pushed").alias("label"), grew.alias("fresh")))
    return raised.drop("fresh")


def deploy_order(changes: DataFrame, keys: Sequence[str] = KEYS, local: int = ORDERED) -> DataFrame:
    """Topological order that always takes the smallest free plan position.

    A group of at most ``local`` rows is walked with a heap in one task.  A larger group is split: a change can only be
    deployed once its largest ancestor M is, and all changes with a smaller M come first, so M is the first sort key;
    changes that share M are the change at M, which goes first, and changes waiting for it, a group of its own.  The
    sort key of a change is therefore the path of its M values, ending in its rank or its own position.
    """
    edges = cut(requirement_edges(changes, keys).withColumn("path", F.array().cast("array<long>")))
    work = changes.select(*keys, F.col("pos").cast("long").alias("pos"), F.array().cast("array<long>").alias("path"))
    group = [*keys, "path"]
    settled: list[DataFrame] = []
    while True:
        small, large = _split(work, edges, group, local)
        walked = cut(_walk(small, group, plan_walk.order_and_level, "pos", "rank", "level"))
        if not walked.where("rank < 0").isEmpty():
            raise CycleError("requirements form a cycle; see cycles()")
        settled.append(walked.select(*keys, "pos", F.concat("path", F.array("rank")).alias("path")))
        if large.isEmpty():
            break
        work, edges = (cut(x.join(large, group, "left_semi")) for x in (work, edges))
        folded, stuck = fold_paths(edges.withColumn("w", F.col("src")), keys, "max")
        if not stuck.isEmpty():
            raise CycleError("requirements form a cycle; see cycles()")
        raised = cut(folded.where("w > node").select(*keys, F.col("node").alias("pos"), F.col("w").alias("label")))
        own = work.join(raised, [*keys, "pos"], "left_anti")
        settled.append(own.select(*keys, "pos", F.concat("path", F.array("pos")).alias("path")))
        work = cut(work.join(raised, [*keys, "pos"]).select(*keys, "pos", F.concat("path", F.array("label")).alias("path")))
        ends = [work.select(*keys, F.col("pos").alias(e), F.col("path").alias(f"_{e}")) for e in ("src", "dst")]
        edges = edges.drop("path").join(ends[0], [*keys, "src"]).join(ends[1], [*keys, "dst"]).where("_src = _dst")
        edges = cut(edges.select(*keys, "src", "dst", F.col("_src").alias("path")))
    placed = ordered.number_by(_union(settled), keys, [F.col("path")], "seq").drop("path")
    return changes.join(placed, [*keys, "pos"])


def deploy_preview(
    changes: DataFrame,
    script_texts: DataFrame,
    to: str | None = None,
    keys: Sequence[str] = KEYS,
    strict: bool = True,
) -> DataFrame:
    """Dry run: order of the plan (up to ``to``) with the no-transaction mark of each script.

    Deployed state is not looked at.  ``script_texts`` has the keys,
    ``change_id`` and ``sql``.
    """
    part = history.up_to_target(changes, to, keys, strict) if to is not None else changes
    marks = script_texts.select(*keys, "change_id", is_non_transactional(F.col("sql")).alias("no_transaction"))
    rows = deploy_order(part, keys).select(*keys, "seq", "change_id", "name")
    return rows.join(marks, [*keys, "change_id"], "left").withColumn("no_transaction", F.coalesce("no_transaction", F.lit(False)))


def cycles(changes: DataFrame, keys: Sequence[str] = KEYS, local: int = LOCAL) -> DataFrame:
    """Names that lie on a requirement cycle, a self-requirement included.

    Bounded projects are walked in a task.  In larger ones, what is not on or between cycles is folded away from both
    ends.  Straight runs of what is left become one edge each by pointer doubling (a run that only leads to itself is a
    cycle); then strongly connected parts are taken off one colour at a time: the largest ancestor colours a node, and
    the nodes of that colour that also reach it back form its part.  A run is on a cycle if both its ends are in one
    part.  Only labels move; reachable pairs are never listed.
    """
    firsts = cut(history.first_of_name(changes, keys).select(*keys, "name", F.col("pos").cast("long").alias("pos")))
    edges = requirement_edges(changes, keys).join(firsts.select(*keys, F.col("pos").alias("dst")), [*keys, "dst"], "left_semi")
    edges = cut(edges.select(*keys, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))
    small, large = _split(firsts, edges, keys, local)
    found = _walk(small, keys, plan_walk.nodes_on_cycles, "pos")
    if not large.isEmpty():
        found = found.unionByName(_large_cycles(edges.join(large, list(keys), "left_semi"), keys))
    return firsts.join(found.distinct(), [*keys, "pos"], "left_semi").select(*keys, "name")


def _large_cycles(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(pos) of the nodes on cycles, by edge tables."""
    edges = _trim(edges, keys)
    loops = edges.where("src = dst").select(*keys, F.col("src").alias("node")).distinct()
    found = [cut(loops.select(*keys, F.col("node").alias("pos")))]
    edges = _trim(edges.where("src <> dst"), keys)
    ins = edges.groupBy(*keys, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"), F.max("src").alias("before"))
    outs = edges.groupBy(*keys, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.max("dst").alias("after"))
    straight = cut(ins.join(outs, [*keys, "node"]).where("i = 1 and o = 1").select(*keys, "node", "before", "after"))
    zero, keep = F.lit(0).cast("long"), lambda a, b: a
    heads, rings = _jump(straight.select(*keys, "node", F.col("before").alias("up"), zero.alias("w")), keys, keep)
    tails, _ = _jump(straight.select(*keys, "node", F.col("after").alias("up"), zero.alias("w")), keys, keep)
    found.append(rings.select(*keys, F.col("node").alias("pos")))
    runs = cut(heads.select(*keys, "node", F.col("up").alias("src")).join(tails.select(*keys, "node", F.col("up").alias("dst")), [*keys, "node"]))
    inside = [straight.select(*keys, F.col("node").alias(e)) for e in ("src", "dst")]
    others = edges.join(inside[0], [*keys, "src"], "left_anti").join(inside[1], [*keys, "dst"], "left_anti")
    core = cut(others.select(*keys, "src", "dst").unionByName(runs.select(*keys, "src", "dst")).distinct())
    own = core.where("src = dst").select(*keys, F.col("src").alias("node")).distinct()
    found.append(own.select(*keys, F.col("node").alias("pos")))
    parts: list[DataFrame] = []
    left = _trim(core.where("src <> dst"), keys)
    while not left.isEmpty():
        part = _coloured_parts(left, keys)
        sizes = part.groupBy(*keys, "colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts.append(cut(part.join(sizes, [*keys, "colour"], "left_semi").select(*keys, "node", "colour")))
        for end in ("src", "dst"):
            left = left.join(part.select(*keys, F.col("node").alias(end)), [*keys, end], "left_anti")
        left = _trim(left.select(*keys, "src", "dst"), keys)
    closed = F.col("src") == F.col("dst")
    if parts:
        coloured = _union(parts)
        found.append(coloured.select(*keys, F.col("node").alias("pos")))
        for e in ("src", "dst"):
            runs = runs.join(coloured.select(*keys, F.col("node").alias(e), F.col("colour").alias(f"_{e}")), [*keys, e], "left")
        closed = closed | F.coalesce(F.col("_src") == F.col("_dst"), F.lit(False))
    return _union([*found, runs.where(closed).select(*keys, F.col("node").alias("pos"))])


def _trim(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges whose source is on or behind a cycle and whose end is on or before one."""
    for _ in range(2):
        blocked = fold_paths(edges.withColumn("w", F.lit(0)), keys, "max")[1].withColumnRenamed("node", "src")
        left = edges.join(blocked, [*keys, "src"], "left_semi")
        edges = cut(left.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges


def _coloured_parts(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(node, colour) of every part that holds the largest ancestor of its nodes."""
    ends = [edges.select(*keys, F.col(e).alias("node")) for e in ("src", "dst")]
    nodes = _union(ends).distinct()
    colour = F.coalesce("label", "node")
    coloured = cut(nodes.join(_propagate_max(edges, keys), [*keys, "node"], "left").select(*keys, "node", colour.alias("colour")))
    back = edges
    for end in ("src", "dst"):
        back = back.join(coloured.select(*keys, F.col("node").alias(end), F.col("colour").alias(f"_{end}")), [*keys, end])
    back = cut(back.where("_src = _dst").select(*keys, "src", "dst"))
    reached = cut(coloured.where("node = colour").select(*keys, "node", "colour"))
    parts = [reached]
    seen = reached
    while not reached.isEmpty():
        step = back.join(reached.select(*keys, F.col("node").alias("dst"), "colour"), [*keys, "dst"])
        step = step.select(*keys, F.col("src").alias("node"), "colour").distinct()
        reached = cut(step.join(seen, [*keys, "node"], "left_anti").select(*keys, "node", "colour"))
        parts.append(reached)
        seen = _union(parts)
    return seen
