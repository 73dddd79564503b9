"""Column helpers over one nested graph row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineflow.functions.kernels import flow_shape
from lineflow.schema import EDGE_DDL, KIND_PRIORITY, NODE_DDL, TERMINAL_KINDS



def resolve_kind(constructs: Column) -> Column:
    """The construct kind that wins a line; an unknown kind is an error."""
    known = F.array(*[F.lit(kind) for kind in KIND_PRIORITY])
    winner = F.get(F.filter(known, lambda kind: F.array_contains(constructs, kind)), F.lit(0))
    strange = F.array_sort(F.array_except(constructs, known))
    problem = F.concat(F.lit("unknown node kinds: "), F.array_join(strange, ", "))
    return F.when(
        F.exists(constructs, lambda kind: ~kind.isin(*KIND_PRIORITY)),
        F.raise_error(problem).cast("string"),
    ).otherwise(F.coalesce(winner, F.lit("OTHER")))


def settled(value: Column) -> Column:
    """``value``, computed once per row.

    The optimizer may inline a column into a lambda that mentions it, which would recompute
    it for every element; a non-deterministic guard keeps it in a projection of its own.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def is_statement(kind: Column) -> Column:
    return ~kind.isin(*TERMINAL_KINDS)


def successor_slots(nodes: Column, edges: Column) -> Column:
    """Edges as ``(u, line, v)`` in slot order: by source, then target line, then target id."""
    return F.array_sort(
        F.transform(
            edges,
            lambda e: F.struct(
                e["u"].alias("u"), F.get(nodes, e["v"])["line"].alias("line"), e["v"].alias("v")
            ),
        )
    )


def successors(nodes: Column, edges: Column, node: Column) -> Column:
    mine = F.filter(successor_slots(nodes, edges), lambda s: s["u"] == node)
    return F.transform(mine, lambda s: s["v"])


def predecessors(nodes: Column, edges: Column, node: Column) -> Column:
    flipped = F.transform(edges, lambda e: F.struct(e["v"].alias("u"), e["u"].alias("v")))
    return successors(nodes, flipped, node)


def is_back_edge(back_edges: Column, u: Column, v: Column) -> Column:
    return F.exists(back_edges, lambda e: (e["u"] == u) & (e["v"] == v))


def max_out_degree(edges: Column) -> Column:
    """Longest run of equal sources once the edges are sorted."""
    start = F.struct(F.lit(-1).alias("u"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state, u):
        run = F.when(state["u"] == u, state["run"] + 1).otherwise(F.lit(1))
        return F.struct(
            u.alias("u"), run.alias("run"), F.greatest(state["best"], run).alias("best")
        )

    return F.aggregate(F.array_sort(edges["u"]), start, step, lambda s: s["best"])


def shape_of(num_nodes: Column, edges: Column, entry: Column) -> Column:
    return flow_shape(num_nodes.cast("int"), edges["u"], edges["v"], entry)


def nodes_with_shape(nodes: Column, shape: Column) -> Column:
    """``nodes`` with depth and cycle membership taken from ``shape``."""
    return F.transform(
        nodes,
        lambda n: n.withField("depth", F.get(shape["depth"], n["id"])).withField(
            "in_loop", F.get(shape["in_loop"], n["id"])
        ),
    )


def distance_to_label(depths: Column, labels: Column) -> Column:
    """Smallest non-negative depth among the labels, -1 if none is reachable."""
    reached = F.filter(F.transform(labels, lambda v: F.get(depths, v)), lambda d: d >= 0)
    return F.coalesce(F.array_min(reached), F.lit(-1)).cast("int")


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def node_struct(**fields: Column) -> Column:
    order = ("id", "line", "kind", "code", "depth", "in_loop", "calls", "ops")
    return F.struct(*[fields[name].alias(name) for name in order]).cast(NODE_DDL)


def edge_struct(u: Column, v: Column) -> Column:
    return F.struct(u.cast("int").alias("u"), v.cast("int").alias("v")).cast(EDGE_DDL)
