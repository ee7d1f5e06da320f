"""Walks inside a task: over one bounded dependency graph (``graph`` says which are), and along sorted changes in a stream."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: How many nodes another one may hang on in ``fold_block`` before it is a meeting place of its own.
WAYS = 4


def _adjacency(table: pa.Table) -> tuple[list[int], dict[int, list[int]], dict[int, int]]:
    """Nodes, followers of each node and the number of requirements of each.  Rows without ``src`` are nodes, others edges."""
    nodes, after = [], {}
    for pos, src in zip(table.column("pos").to_pylist(), table.column("src").to_pylist(), strict=True):
        if src is None:
            nodes.append(pos)
        else:
            after.setdefault(src, []).append(pos)
    needs = dict.fromkeys(nodes, 0)
    for followers in after.values():
        for v in followers:
            needs[v] += 1
    return nodes, after, needs


def _result(table: pa.Table, group: Sequence[str], **columns: list[int]) -> pa.Table:
    n = len(next(iter(columns.values())))
    same = {g: pa.array([table.column(g)[0].as_py()] * n, table.schema.field(g).type) for g in group}
    return pa.table(same | {c: pa.array(x, pa.int64()) for c, x in columns.items()})


def order_and_level(table: pa.Table, group: Sequence[str]) -> pa.Table:
    """Smallest free position first: (pos, rank, level); nodes that never get free, on or behind a cycle, have rank -1.

    Positions become their ranks and edges one array sorted by source, so a row costs bytes, not objects.  Positions that
    repeat or that no node has go the way of ``_by_names``.
    """
    pos, src = table.column("pos").combine_chunks(), table.column("src").combine_chunks()
    edge = np.asarray(src.is_valid())
    pos, src = (np.asarray(x.fill_null(0)).astype(np.int64, copy=False) for x in (pos, src))
    nodes, ends, starts = np.sort(pos[~edge]), pos[edge], src[edge]
    del pos, src, edge
    n = len(nodes)
    if table.column("pos").null_count or n == 0 or np.any(nodes[1:] == nodes[:-1]):
        return _by_names(table, group)
    to, of = np.searchsorted(nodes, ends), np.searchsorted(nodes, starts)
    if np.any(nodes[np.minimum(to, n - 1)] != ends) or np.any(nodes[np.minimum(of, n - 1)] != starts):
        return _by_names(table, group)
    del ends, starts
    first = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int64)
    followers = to[np.argsort(of, kind="stable")].astype(np.int64)
    needs = np.bincount(to, minlength=n).astype(np.int64)
    del to, of
    level, order = np.zeros(n, np.int64), np.empty(n, np.int64)
    free = np.flatnonzero(needs == 0).tolist()  # ascending, so it is a heap
    first_, followers_, needs_, level_, order_ = (memoryview(x) for x in (first, followers, needs, level, order))
    done = 0
    while free:
        u = heapq.heappop(free)
        order_[done] = u
        done += 1
        near = level_[u] + 1
        for v in followers_[first_[u] : first_[u + 1]]:
            if level_[v] < near:
                level_[v] = near
            needs_[v] -= 1
            if not needs_[v]:
                heapq.heappush(free, v)
    order[done:] = np.flatnonzero(needs > 0)
    rank = np.where(np.arange(n) < done, np.arange(n), -1)
    return _result(table, group, pos=nodes[order], rank=rank, level=level[order])


def _by_names(table: pa.Table, group: Sequence[str]) -> pa.Table:
    nodes, after, needs = _adjacency(table)
    free = [v for v in nodes if not needs[v]]
    heapq.heapify(free)
    order, level = [], dict.fromkeys(nodes, 0)
    while free:
        u = heapq.heappop(free)
        order.append(u)
        for v in after.get(u, ()):
            level[v] = max(level[v], level[u] + 1)
            needs[v] -= 1
            if not needs[v]:
                heapq.heappush(free, v)
    left = sorted(v for v in nodes if needs[v])
    rank = [*range(len(order)), *[-1] * len(left)]
    return _result(table, group, pos=order + left, rank=rank, level=[level[v] for v in order + left])


def nodes_on_cycles(table: pa.Table, group: Sequence[str]) -> pa.Table:
    """(pos) of nodes in a strongly connected part of two or more, or that require themselves: one depth-first walk."""
    nodes, after, _ = _adjacency(table)
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    open_path: list[int] = []
    on_path: set[int] = set()
    found = []
    for root in nodes:
        if root in number:
            continue
        stack = [(root, iter(after.get(root, ())))]
        number[root] = low[root] = len(number)
        open_path.append(root)
        on_path.add(root)
        while stack:
            u, rest = stack[-1]
            v = next(rest, None)
            if v is None:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[u])
                if low[u] == number[u]:
                    part = [open_path.pop()]
                    while part[-1] != u:
                        part.append(open_path.pop())
                    on_path.difference_update(part)
                    if len(part) > 1 or u in after.get(u, ()):
                        found += part
            elif v not in number:
                number[v] = low[v] = len(number)
                open_path.append(v)
                on_path.add(v)
                stack.append((v, iter(after.get(v, ()))))
            elif v in on_path:
                low[u] = min(low[u], number[v])
    return _result(table, group, pos=found)


def fold_block(batches: Iterable[pa.RecordBatch], keys: Sequence[str], combine: Callable[[int, int], int]) -> Iterator[pa.RecordBatch]:
    """Edges (keys, src, dst, w) with all that end in one range of (keys, dst) -> (keys, node, up, w, n): what each node hangs on.

    ``up`` is null for a node without requirements, else a node outside the range or one inside where paths from more than
    ``WAYS`` such ``up`` meet or a cycle is cut open; ``w`` is the largest over the paths from there.  A node has ``n`` rows.
    """
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    size = table.num_rows
    group = np.zeros(size, np.int64)
    for k in keys:
        cell = table.column(k).combine_chunks().dictionary_encode()
        group = np.unique(group * len(cell.dictionary) + np.asarray(cell.indices), return_inverse=True)[1]
    unknown = np.asarray(table.column("src").is_null())  # a requirement without position: as if from a start
    src = pc.coalesce(table.column("src"), table.column("dst")).combine_chunks()
    dst, src, w = (np.asarray(x) for x in (table.column("dst").combine_chunks(), src, table.column("w").combine_chunks()))
    group, at = np.concatenate((group, group)), np.concatenate((dst, src))
    order = np.lexsort((at, group))
    new = np.concatenate(([True], (np.diff(group[order]) != 0) | (np.diff(at[order]) != 0)))
    ids = np.empty(2 * size, np.int64)
    ids[order] = np.cumsum(new) - 1
    to, of, sample = ids[:size], ids[size:], order[new]
    n = len(sample)
    inside = np.zeros(n, bool)
    inside[to] = True
    # numbers follow (keys, position), so what lies between two ends of a plan and is no end itself requires nothing
    of_group, ends = group[sample], np.flatnonzero(inside)
    low, high = np.full(of_group.max() + 1, n), np.full(of_group.max() + 1, -1)
    np.minimum.at(low, of_group[ends], ends)
    np.maximum.at(high, of_group[ends], ends)
    free = ~inside & (np.arange(n) > low[of_group]) & (np.arange(n) < high[of_group])
    hangs: list[tuple] = [((-1 if f else i, None),) for i, f in enumerate(free.tolist())] + [((-1, None),)]
    needs = np.bincount(to[inside[of] & ~unknown], minlength=n)
    of[unknown] = n
    by_end, by_start = np.argsort(to, kind="stable"), np.argsort(of, kind="stable")
    begins, leaves = (np.concatenate(([0], np.cumsum(np.bincount(x, minlength=n + 1)))).tolist() for x in (to, of))
    before, length, after = of[by_end].tolist(), w[by_end].tolist(), to[by_start].tolist()
    todo = np.flatnonzero(inside & (needs == 0)).tolist()
    unsettled, needs = iter(np.flatnonzero(inside & (needs > 0)).tolist()), needs.tolist()
    nodes, ups, weights, counts, opened, seen = [], [], [], [], [], [False] * n

    def merged(v: int, of_one: Callable[[int], tuple]) -> dict[int, int]:
        found: dict[int, int] = {}
        for e in range(begins[v], begins[v + 1]):
            for o, far in of_one(before[e]):
                x = length[e] if far is None else combine(far, length[e])
                if o not in found or found[o] < x:
                    found[o] = x
        return found

    def hangs_on(v: int) -> dict[int, int]:
        found = merged(v, hangs.__getitem__)
        return found if len(found) <= WAYS else merged(v, lambda u: hangs[u] if len(hangs[u]) == 1 else ((u, None),))

    def add(v: int, found: dict[int, int]) -> None:
        for o, x in found.items():
            nodes.append(v)
            ups.append(o)
            weights.append(x)
            counts.append(len(found))

    while True:
        if todo:
            v = todo.pop()
            found = hangs_on(v)
            add(v, found)
            if len(found) <= WAYS:
                hangs[v] = tuple(found.items())
        else:
            v = next((x for x in unsettled if not seen[x]), None)
            if v is None:
                break
            opened.append(v)
        seen[v] = True
        for e in range(leaves[v], leaves[v + 1]):
            x = after[e]
            needs[x] -= 1
            if not needs[x] and not seen[x]:
                todo.append(x)
    for v in opened:
        add(v, hangs_on(v))
    nodes, ups = np.array(nodes), np.array(ups)
    same = pa.array(sample[nodes] % size)
    at = at[sample]
    columns = [table.column(k).combine_chunks().take(same) for k in keys]
    columns += [pa.array(at[nodes]), pa.array(at[ups], mask=ups < 0), pa.array(weights, pa.int64()), pa.array(counts, pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=[*keys, "node", "up", "w", "n"])


def chained(batches: Iterable[pa.RecordBatch], keys: Sequence[str], chunk: int) -> Iterator[pa.RecordBatch]:
    """Sorted changes with ``_before`` and ``_after`` -> ``change_id`` and ``parent``; a plan may go on in the next batch."""
    plan, last = None, None
    for batch in batches:
        for at in range(0, batch.num_rows, chunk):
            part = batch.slice(at, chunk)
            names = zip(*[part.column(k).to_pylist() for k in keys], strict=True)
            texts = zip(part.column("_before").to_pylist(), part.column("_after").to_pylist(), strict=True)
            made, parents = [], []
            for own, (before, after) in zip(names, texts, strict=True):
                if own != plan:
                    plan, last = own, None
                parents.append(last)
                if before is None or after is None:
                    last = None
                else:
                    content = (before + after if last is None else f"{before}\nparent {last}{after}").encode()
                    last = hashlib.sha1(b"change %d\0%b" % (len(content), content)).hexdigest()
                made.append(last)
            kept = [n for n in part.schema.names if n not in ("_before", "_after")]
            columns = [part.column(n) for n in kept] + [pa.array(x, pa.string()) for x in (made, parents)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "change_id", "parent"])
