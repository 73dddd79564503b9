"""Checks and statistics over graph records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineflow.functions import graph
from lineflow.functions.kernels import undirected_hops
from lineflow.operators.features import with_degrees
from lineflow.schema import NODE_KINDS

# --- Fixed values -----------------------------------------------------------------------
PERCENTILES = (5, 25, 50, 75, 95, 99, 100)
# ----------------------------------------------------------------------------------------


# --- validation --------------------------------------------------------------------------


def with_violations(graphs: DataFrame) -> DataFrame:
    """Add ``violations``: the names of every structural rule the record breaks."""
    n = F.size("nodes")
    nodes, edges, back = F.col("nodes"), F.col("edges"), F.col("back_edges")

    def inside(i):
        return (i >= 0) & (i < n)

    def kind_at(i):
        return F.get(nodes, F.when(inside(i), i))["kind"]

    in_range = F.forall(edges, lambda e: inside(e["u"]) & inside(e["v"]))
    labels_ok = F.forall("vuln_nodes", inside)
    # Depths need sound edges; a record with broken ones is reported for those first.
    sound = in_range & inside(F.col("entry"))
    rows = graphs.withColumn(
        "_depth", graph.shape_of(n, F.when(sound, edges), F.col("entry"))["depth"]
    )
    reached = F.exists("vuln_nodes", lambda v: F.get(F.col("_depth"), F.when(inside(v), v)) >= 0)
    matrices = F.map_values("features")
    rules = {
        "too_few_nodes": n < 3,
        "ids_not_dense": F.exists(F.transform(nodes, lambda x, i: x["id"] != i), lambda bad: bad),
        "unknown_kind": F.exists(nodes, lambda x: ~x["kind"].isin(*NODE_KINDS)),
        "entry_not_unique": F.size(F.filter(nodes, lambda x: x["kind"] == "ENTRY")) != 1,
        "exit_not_unique": F.size(F.filter(nodes, lambda x: x["kind"] == "EXIT")) != 1,
        "entry_mismatch": F.coalesce(kind_at(F.col("entry")) != "ENTRY", F.lit(True)),
        "exit_mismatch": F.coalesce(kind_at(F.col("exit")) != "EXIT", F.lit(True)),
        "edge_out_of_range": ~in_range,
        "self_loop": F.exists(edges, lambda e: e["u"] == e["v"]),
        "duplicate_edge": F.size(F.array_distinct(edges)) != F.size(edges),
        "stray_back_edge": F.size(F.array_except(back, edges)) > 0,
        "no_label": F.size("vuln_nodes") == 0,
        "duplicate_label": F.size(F.array_distinct("vuln_nodes")) != F.size("vuln_nodes"),
        "label_out_of_range": ~labels_ok,
        "label_on_terminal": F.exists("vuln_nodes", lambda v: F.coalesce(~graph.is_statement(kind_at(v)), F.lit(False))),
        "label_unreachable": (F.size("vuln_nodes") > 0) & F.coalesce(~reached, F.lit(False)),
        "feature_rows": F.exists(matrices, lambda m: F.size(m) != n),
        "ragged_features": F.exists(
            matrices, lambda m: F.size(F.array_distinct(F.transform(m, lambda r: F.size(r)))) > 1
        ),
    }
    broken = F.array(*[F.when(rule, name) for name, rule in rules.items()])
    return rows.withColumn("violations", F.filter(broken, lambda x: x.isNotNull())).drop("_depth")


def validated(graphs: DataFrame) -> DataFrame:
    """The same records; reading one that breaks a rule fails the job."""
    rows = with_violations(graphs)
    problem = F.concat("sample_id", F.lit(": "), F.array_join("violations", ", "))
    sound = F.when(F.size("violations") == 0, F.col("sample_id")).otherwise(
        F.raise_error(problem).cast("string")
    )
    return rows.withColumn("sample_id", sound).drop("violations")


# --- per-graph facts ---------------------------------------------------------------------


def with_depths(graphs: DataFrame) -> DataFrame:
    return graphs.withColumn(
        "depths", graph.shape_of(F.size("nodes"), F.col("edges"), F.col("entry"))["depth"]
    )


def graph_metadata(graphs: DataFrame) -> DataFrame:
    """``graph_id, project, cwe, num_nodes, num_vuln, dist_to_vuln``."""
    return with_depths(graphs).select(
        F.col("sample_id").alias("graph_id"), "project", "cwe",
        F.size("nodes").alias("num_nodes"), F.size("vuln_nodes").alias("num_vuln"),
        graph.distance_to_label(F.col("depths"), F.col("vuln_nodes")).alias("dist_to_vuln"),
    )


def distance_to_vulnerable(graphs: DataFrame) -> DataFrame:
    """Add ``distance``: undirected hops from every node to the nearest label; nodes cut off
    from all labels get the number of nodes."""
    hops = undirected_hops(F.size("nodes"), F.col("edges.u"), F.col("edges.v"), F.col("vuln_nodes"))
    return graphs.withColumn("_hops", hops).withColumn(
        "distance", F.transform("_hops", lambda d: F.when(d < 0, F.size("nodes")).otherwise(d))
    ).drop("_hops")


def vertices(graphs: DataFrame) -> DataFrame:
    """One row per node, keyed for graph libraries."""
    return graphs.select("sample_id", F.inline("nodes"))


def edge_list(graphs: DataFrame) -> DataFrame:
    """One row per edge with its slot number and whether it closes a loop."""
    slots = graph.successor_slots(F.col("nodes"), F.col("edges"))
    rows = graphs.withColumn("_slots", graph.settled(slots))
    ranked = F.transform(
        "_slots",
        lambda s, i: F.struct(
            s["u"].alias("u"), s["v"].alias("v"),
            (i - (F.array_position(F.col("_slots.u"), s["u"]).cast("int") - 1)).cast("int").alias("slot"),
            graph.is_back_edge(F.col("back_edges"), s["u"], s["v"]).alias("back"),
        ),
    )
    return rows.select("sample_id", F.inline(ranked))


# --- corpus statistics -------------------------------------------------------------------


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``measure, mean, p5 .. p100`` of several columns from one pass.

    The exact percentiles keep one counter per distinct value; node counts and shares of at
    most a few hundred nodes have few of those.
    """
    levels = [q / 100 for q in PERCENTILES]
    row = df.agg(
        *[F.struct(F.avg(c).alias("mean"), F.percentile(c, F.lit(levels)).alias("q")).alias(c) for c in columns]
    )
    long = F.array(
        *[
            F.struct(
                F.lit(c).alias("measure"), F.col(f"{c}.mean").alias("mean"),
                *[F.get(F.col(f"{c}.q"), F.lit(i)).cast("double").alias(f"p{q}") for i, q in enumerate(PERCENTILES)],
            )
            for c in columns
        ]
    )
    return row.select(F.inline(long))


def out_degree_table(graphs: DataFrame) -> DataFrame:
    """Per out-degree: nodes with it, share of nodes and of graphs that fit within it."""
    rows = with_degrees(graphs).select(F.col("degrees.outgoing").alias("out"))
    # Histogram within the row first: a graph adds one row per distinct degree.
    kinds = F.transform(
        F.array_distinct("out"),
        lambda d: F.struct(
            d.alias("out_degree"), F.size(F.filter("out", lambda x: x == d)).alias("nodes"),
            (d == F.array_max("out")).cast("int").alias("widest"),
        ),
    )
    counts = rows.select(F.inline(kinds)).groupBy("out_degree").agg(
        F.sum("nodes").alias("nodes"), F.sum("widest").alias("widest")
    )
    # One row per degree remains, a few hundred at most.
    top = counts.agg(F.max("out_degree").alias("top"))
    every = top.select(F.explode(F.sequence(F.lit(0), "top")).alias("out_degree"))
    filled = every.join(counts, "out_degree", "left").na.fill(0, ["nodes", "widest"])
    upto = Window.orderBy("out_degree").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    return filled.select(
        "out_degree", "nodes",
        (F.sum("nodes").over(upto) / F.sum("nodes").over(whole)).alias("nodes_covered"),
        (F.sum("widest").over(upto) / F.sum("widest").over(whole)).alias("graphs_covered"),
    )


def smallest_k(table: DataFrame, node_coverage: float = 0.99) -> DataFrame:
    """The fewest successor slots that fit ``node_coverage`` of all nodes, at least one."""
    fits = table.filter(F.col("nodes_covered") >= node_coverage)
    return fits.agg(F.greatest(F.min("out_degree"), F.lit(1)).alias("smallest_k"))


def graph_measures(graphs: DataFrame) -> DataFrame:
    """Size and label columns per graph, for :func:`distribution`."""
    facts = graph_metadata(graphs)
    return facts.select(
        F.col("num_nodes").alias("nodes"), F.col("num_vuln").alias("vulnerable_nodes"),
        (F.col("num_vuln") / F.col("num_nodes")).alias("vulnerable_node_fraction"),
        F.when(F.col("dist_to_vuln") >= 0, F.col("dist_to_vuln")).alias("distance_entry_to_vulnerable"),
    )


def graph_counts(graphs: DataFrame) -> DataFrame:
    """Graphs by CWE and nodes by kind: ``measure, value, n``."""
    per_kind = F.transform(
        F.array_distinct(F.col("nodes.kind")),
        lambda k: F.struct(
            F.lit("kind").alias("measure"), k.alias("value"),
            F.size(F.filter("nodes", lambda x: x["kind"] == k)).cast("bigint").alias("n"),
        ),
    )
    both = F.concat(
        per_kind,
        F.array(F.struct(F.lit("cwe").alias("measure"), F.col("cwe").alias("value"), F.lit(1).cast("bigint").alias("n"))),
    )
    return graphs.select(F.inline(both)).groupBy("measure", "value").agg(F.sum("n").alias("n"))


def graph_statistics(graphs: DataFrame) -> dict:
    """The whole report as a dict; every table collected has a bounded number of rows."""
    measures = graph_measures(graphs)
    head = measures.agg(
        F.count("*").alias("graphs"),
        F.avg((F.col("vulnerable_nodes") == 1).cast("double")).alias("single"),
    ).first()
    if not head["graphs"]:
        raise ValueError("no graphs to describe")
    degree = out_degree_table(graphs)
    counts = graph_counts(graphs).collect()
    report = {r["measure"]: {k: v for k, v in r.asDict().items() if k != "measure"}
              for r in distribution(measures, measures.columns).collect()}
    return {
        "graphs": head["graphs"],
        **report,
        "single_vulnerable_node_share": head["single"],
        "out_degree": [r.asDict() for r in degree.orderBy("out_degree").collect()],
        "smallest_k_for_99_percent_of_nodes": smallest_k(degree).first()[0],
        "kinds": {r["value"]: r["n"] for r in counts if r["measure"] == "kind"},
        "by_cwe": {r["value"]: r["n"] for r in counts if r["measure"] == "cwe"},
    }


def wide_graphs(graphs: DataFrame, k: int, max_steps_cap: int = 200, per_node: float = 4.0) -> DataFrame:
    """Graphs wider than ``k`` slots, and graphs whose step budget hits the cap."""
    return graphs.agg(
        F.count(F.lit(1)).alias("graphs"),
        F.count_if(graph.max_out_degree(F.col("edges")) > k).alias("graphs_wider_than_k"),
        F.count_if(F.ceil(F.size("nodes") * F.lit(per_node)) >= max_steps_cap).alias("graphs_at_step_cap"),
    )


# --- sampling ----------------------------------------------------------------------------


def sample_graphs(graphs: DataFrame, n: int, seed: int = 0, max_nodes: int | None = None) -> DataFrame:
    """``n`` graphs drawn uniformly without replacement, alike on every run."""
    pool = graphs if max_nodes is None else graphs.filter(F.size("nodes") <= max_nodes)
    at = F.md5(F.concat_ws(":", F.lit(str(seed)), "sample_id").cast("binary"))
    return pool.orderBy(at, "sample_id").limit(n)


def describe(graphs: DataFrame) -> Column:
    """One line per node, as text."""
    return F.array_join(
        F.transform(
            "nodes",
            lambda x: F.format_string("%3d  line %3d  %-7s %s", x["id"], x["line"], x["kind"], x["code"]),
        ),
        "\n",
    )
