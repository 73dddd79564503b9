"""Graph rewrites: dispatch chains, label shuffles, node renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.functions import graph
from lineflow.functions.kernels import dispatch_chains
from lineflow.schema import GRAPH_COLUMNS


def limit_out_degree(graphs: DataFrame, k: int) -> DataFrame:
    """Give nodes with more than ``k`` successors a chain of dispatch nodes.

    Narrow graphs pass unchanged and never reach Python; rewritten ones lose stored features
    and get new depths, cycles and back edges.
    """
    if k < 2:
        raise ValueError("k must be at least 2 to chain dispatch nodes")
    wide = graph.max_out_degree(F.col("edges")) > k
    rows = graphs.withColumn(
        "_slots",
        graph.settled(F.when(wide, graph.successor_slots(F.col("nodes"), F.col("edges")))),
    ).withColumn(
        "_chain", dispatch_chains(F.size("nodes"), F.col("_slots.u"), F.col("_slots.v"), F.lit(k))
    )
    copies = F.transform(
        F.col("_chain.origins"),
        lambda origin, i: F.get(F.col("nodes"), origin).withField("id", (F.size("nodes") + i).cast("int")),
    )
    rows = rows.withColumn("_nodes", graph.settled(F.concat(F.col("nodes"), copies))).withColumn(
        "_shape", graph.shape_of(F.size("_nodes"), F.col("_chain.edges"), F.col("entry"))
    )
    chained = F.col("_chain").isNotNull()
    rewritten = {
        "nodes": graph.settled(
            F.coalesce(graph.nodes_with_shape(F.col("_nodes"), F.col("_shape")), F.col("nodes"))
        ),
        "edges": F.coalesce(F.col("_chain.edges"), F.col("edges")),
        "back_edges": F.coalesce(F.col("_shape.back_edges"), F.col("back_edges")),
        "features": F.when(chained, F.create_map().cast("map<string,array<array<double>>>"))
        .otherwise(F.col("features")),
    }
    return rows.withColumns(rewritten).select(*graphs.columns)


def draw(seed: int | Column, sample_id: Column, item: Column) -> Column:
    """A value that orders items at random, alike on every run and every executor."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), sample_id, item.cast("string")).cast("binary"))


def shuffle_labels(graphs: DataFrame, seed: int = 0) -> DataFrame:
    """Replace the labels by as many random reachable statements."""
    candidates = F.filter(
        F.col("nodes"), lambda n: graph.is_statement(n["kind"]) & (F.get(F.col("_depth"), n["id"]) >= 0)
    )
    drawn = F.array_sort(
        F.transform(
            candidates, lambda n: F.struct(draw(seed, F.col("sample_id"), n["id"]).alias("at"), n["id"].alias("id"))
        )
    )
    rows = graphs.withColumn(
        "_depth", graph.shape_of(F.size("nodes"), F.col("edges"), F.col("entry"))["depth"]
    )
    chosen = F.slice(drawn["id"], F.lit(1), F.size("vuln_nodes"))
    return rows.withColumn("vuln_nodes", F.array_sort(chosen)).drop("_depth")


def permute_node_ids(graphs: DataFrame, seed: int = 0) -> DataFrame:
    """Renumber the nodes at random; lines, edges, labels and features move along."""
    drawn = F.array_sort(
        F.transform(
            F.col("nodes"), lambda n: F.struct(draw(seed, F.col("sample_id"), n["id"]).alias("at"), n["id"].alias("id"))
        )
    )
    # _old[j] is the old id at new id j; array_position turns old into new.
    rows = graphs.withColumn("_old", graph.settled(drawn["id"]))

    def new(old):
        return (F.array_position("_old", old) - 1).cast("int")

    def moved(edges):
        return F.array_sort(F.transform(edges, lambda e: graph.edge_struct(new(e["u"]), new(e["v"]))))

    return rows.select(
        *[
            {
                "nodes": F.transform(
                    F.col("_old"), lambda old, i: F.get(F.col("nodes"), old).withField("id", i.cast("int"))
                ),
                "edges": moved(F.col("edges")),
                "back_edges": moved(F.col("back_edges")),
                "entry": new(F.col("entry")),
                "exit": new(F.col("exit")),
                "vuln_nodes": F.array_sort(F.transform("vuln_nodes", new)),
                "features": F.transform_values(
                    "features", lambda _, rows: F.transform(F.col("_old"), lambda old: F.get(rows, old))
                ),
            }.get(name, F.col(name)).alias(name)
            for name in GRAPH_COLUMNS
        ]
    )
