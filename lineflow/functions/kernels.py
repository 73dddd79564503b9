"""Traversals of one graph, as Arrow UDFs.

A graph is one row and at most a few hundred nodes, so these run in place, without a
shuffle. They only follow edges; every rule about labels, budgets, rewards and outcomes is a
Column expression over their output. Edges arrive as parallel arrays ``u``, ``v`` already in
the order in which a traversal must try them.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

BACKTRACK = -1
INTS = pa.list_(pa.int32())
EDGES = pa.list_(pa.struct([("u", pa.int32()), ("v", pa.int32())]))
CHAIN = pa.struct([("edges", EDGES), ("origins", INTS)])
SHAPE = pa.struct([("depth", INTS), ("in_loop", pa.list_(pa.bool_())), ("back_edges", EDGES)])
WALK = pa.struct([("nodes", INTS), ("slots", INTS)])


def cells(column: pa.Array) -> list:
    """``to_pylist``, for lists of numbers by way of one flat list."""
    kind = column.type
    if not pa.types.is_list(kind) or pa.types.is_nested(kind.value_type) or column.flatten().null_count:
        return column.to_pylist()
    flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
    out, at = [], 0
    for size in column.value_lengths().to_pylist():
        out.append(None if size is None else flat[at : at + size])
        at += size or 0
    return out


def arrayed(rows: list, kind: pa.DataType) -> pa.Array:
    """``pa.array(rows, kind)``, where structs come as dicts or, inside a list, as tuples."""
    missing = pa.array([row is None for row in rows], pa.bool_())
    if pa.types.is_struct(kind):
        fields = [arrayed([None if row is None else row[f.name] for row in rows], f.type) for f in kind]
        return pa.StructArray.from_arrays(fields, fields=list(kind), mask=missing)
    if not pa.types.is_list(kind):
        return pa.array(rows, kind)
    ends = np.cumsum([0] + [0 if row is None else len(row) for row in rows], dtype=np.int64)
    flat = list(chain.from_iterable(row for row in rows if row is not None))
    inner = kind.value_type
    if pa.types.is_struct(inner):
        parts = zip(*flat) if flat else [()] * inner.num_fields
        values = pa.StructArray.from_arrays(
            [pa.array(part, f.type) for part, f in zip(parts, inner, strict=True)], fields=list(inner)
        )
    else:
        values = pa.array(flat, inner)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind, mask=missing)


def row_kernel(arrow: pa.DataType) -> Callable:
    """Turn a function of one row's Python values into an Arrow UDF; NULL input, NULL out."""

    def decorate(fn):
        def batch(*columns: pa.Array) -> pa.Array:
            rows = zip(*(cells(column) for column in columns))
            return arrayed([None if any(cell is None for cell in row) else fn(*row) for row in rows], arrow)

        batch.__name__, batch.__doc__ = fn.__name__, fn.__doc__
        # Declared non-deterministic only so that the optimizer keeps the call in a projection
        # of its own: inlined into a lambda over its result, a Python function cannot run.
        return F.arrow_udf(batch, from_arrow_type(arrow)).asNondeterministic()

    return decorate


def targets(n: int, u: list[int], v: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(u, v):
        out[a].append(b)
    return out


def hops(out: list[list[int]], starts: list[int]) -> list[int]:
    """Fewest edges from any start to each node, -1 where none leads."""
    depth = [-1] * len(out)
    wave, level = set(starts), 0
    while wave:
        for node in wave:
            depth[node] = level
        wave = {b for a in wave for b in out[a] if depth[b] < 0}
        level += 1
    return depth


def on_cycles(out: list[list[int]]) -> list[bool]:
    """Nodes that lie on a cycle: alone with an edge to themselves, or one of several that reach
    each other, by Tarjan's components."""
    size = len(out)
    found, low, count = [-1] * size, [0] * size, 0
    stack: list[int] = []
    done, on = [False] * size, [False] * size
    for root in range(size):
        if found[root] >= 0:
            continue
        found[root] = low[root] = count
        count += 1
        stack.append(root)
        todo = [(root, iter(out[root]))]
        while todo:
            node, rest = todo[-1]
            for b in rest:
                if found[b] < 0:
                    found[b] = low[b] = count
                    count += 1
                    stack.append(b)
                    todo.append((b, iter(out[b])))
                    break
                if not done[b] and found[b] < low[node]:
                    low[node] = found[b]
                if b == node:
                    on[node] = True
            else:
                todo.pop()
                if todo and low[node] < low[todo[-1][0]]:
                    low[todo[-1][0]] = low[node]
                if low[node] == found[node]:
                    several = stack[-1] != node
                    while True:
                        member = stack.pop()
                        done[member] = True
                        on[member] = on[member] or several
                        if member == node:
                            break
    return on


def closing_edges(out: list[list[int]], entry: int) -> list[tuple[int, int]]:
    """Edges into a node still open in a depth-first search from ``entry``."""
    found, opened, closed = [], set(), set()
    todo = [(entry, iter(out[entry]))]
    opened.add(entry)
    while todo:
        node, rest = todo[-1]
        following = next(rest, None)
        if following is None:
            todo.pop()
            opened.discard(node)
            closed.add(node)
        elif following in opened:
            found.append((node, following))
        elif following not in closed:
            opened.add(following)
            todo.append((following, iter(out[following])))
    return sorted(found)


@row_kernel(SHAPE)
def flow_shape(n: int, u: list[int], v: list[int], entry: int) -> dict:
    """Depths, cycle membership and back edges, all over ascending-id successors."""
    out = [sorted(row) for row in targets(n, u, v)]
    return {"depth": hops(out, [entry]), "in_loop": on_cycles(out), "back_edges": closing_edges(out, entry)}


@row_kernel(INTS)
def undirected_hops(n: int, u: list[int], v: list[int], starts: list[int]) -> list[int]:
    """Hops to the nearest start along edges in either direction, -1 if disconnected."""
    return hops(targets(n, u + v, v + u), starts)


@row_kernel(EDGES)
def routed_edges(ids: list[int], groups: list[int], src: list[int], dst: list[int]) -> list[tuple]:
    """Contract a flow graph: distinct edges between groups, passing through the members of
    group -1 and dropping edges inside a group."""
    group = dict(zip(ids, groups))
    after: dict[int, list[int]] = {}
    for a, b in zip(src, dst):
        after.setdefault(a, []).append(b)
    edges = set()
    for node, home in group.items():
        if home < 0:
            continue
        passed, todo = {node}, deque(after.get(node, ()))
        while todo:
            step = todo.popleft()
            if step in passed:
                continue
            passed.add(step)
            there = group.get(step, -1)
            if there < 0:
                todo.extend(after.get(step, ()))
            elif there != home:
                edges.add((home, there))
    return sorted(edges)


@row_kernel(CHAIN)
def dispatch_chains(n: int, u: list[int], v: list[int], k: int) -> dict:
    """Spread the successors of nodes with more than ``k`` of them over chains of new nodes.

    The successor of rank r hangs off chain element r // (k - 1), the last element taking one
    more; ``origins`` names the node each new node (ids from ``n``) continues.
    """
    edges, origins = [], []
    for node, row in enumerate(targets(n, u, v)):
        links = -(-(len(row) - k) // (k - 1)) if len(row) > k else 0
        chain = [node, *range(n + len(origins), n + len(origins) + links)]
        origins += [node] * links
        edges += [(chain[min(r // (k - 1), links)], b) for r, b in enumerate(row)]
        edges += zip(chain, chain[1:])
    return {"edges": sorted(edges), "origins": origins}


@row_kernel(INTS)
def breadth_first(n: int, u: list[int], v: list[int], entry: int) -> list[int]:
    out, order, met = targets(n, u, v), [entry], {entry}
    for node in order:  # grows while it is read
        fresh = [b for b in out[node] if b not in met]
        met.update(fresh)
        order.extend(fresh)
    return order


@row_kernel(INTS)
def best_first(
    n: int, u: list[int], v: list[int], entry: int, line: list[int], score: list[float]
) -> list[int]:
    """Highest score on the frontier next; ties to the earlier line, then the smaller id."""
    out, order, met = targets(n, u, v), [], {entry}
    frontier = [(0.0, line[entry], entry)]
    while frontier:
        node = heapq.heappop(frontier)[2]
        order.append(node)
        for b in out[node]:
            if b not in met:
                met.add(b)
                heapq.heappush(frontier, (-score[b], line[b], b))
    return order


@row_kernel(WALK)
def depth_first_walk(n: int, u: list[int], v: list[int], entry: int, backtrack: bool) -> dict:
    """Edge-by-edge walk to the first unvisited successor, else back, until nothing is left.

    ``nodes`` starts with ``entry``; ``slots[i]`` is the move that led to ``nodes[i + 1]``.
    """
    out = targets(n, u, v)
    nodes, slots, path, met = [entry], [], [entry], {entry}
    tried = [0] * n  # successors before this slot are known to be visited
    while path:
        node = path[-1]
        while tried[node] < len(out[node]) and out[node][tried[node]] in met:
            tried[node] += 1
        if tried[node] < len(out[node]):
            slots.append(tried[node])
            path.append(out[node][tried[node]])
            met.add(path[-1])
            nodes.append(path[-1])
        elif backtrack and len(path) > 1:
            path.pop()
            slots.append(BACKTRACK)
            nodes.append(path[-1])
        else:
            break
    return {"nodes": nodes, "slots": slots}


@row_kernel(WALK)
def random_walk(n: int, u: list[int], v: list[int], entry: int, backtrack: bool, draws: list[int]) -> dict:
    """A choice for every draw, a number of 32 random bits, among the successors and, off the
    entry path, going back."""
    out = targets(n, u, v)
    nodes, slots, path = [entry], [], [entry]
    for draw in draws:
        options = len(out[path[-1]])
        back = backtrack and len(path) > 1
        if not options + back:
            break
        slot = draw * (options + back) >> 32
        if slot == options:
            path.pop()
            slots.append(BACKTRACK)
        else:
            path.append(out[path[-1]][slot])
            slots.append(slot)
        nodes.append(path[-1])
    return {"nodes": nodes, "slots": slots}
