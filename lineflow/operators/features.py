"""Node features and suspicion scores, one array per graph row."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.functions import graph
from lineflow.functions.kernels import INTS, row_kernel
from lineflow.functions.lexical import DEFAULT_WEIGHTS, LEXICAL_NAMES, Lexicon, lexical_flags
from lineflow.schema import NODE_KINDS

# --- Fixed values -----------------------------------------------------------------------
DEGREE_CLIP = 4
EMBED_KEY = "embed"
EMBED_DIM = 32
TIER_S_NAMES = tuple(f"kind_{kind.lower()}" for kind in NODE_KINDS) + (
    "in_degree", "out_degree", "depth", "in_loop", "loop_header", "rel_line",
)
TIER_L_NAMES = TIER_S_NAMES + LEXICAL_NAMES
TIER_E_NAMES = TIER_L_NAMES + tuple(f"embed_{i}" for i in range(EMBED_DIM))
# ----------------------------------------------------------------------------------------

_TIERS = {"S": TIER_S_NAMES, "L": TIER_L_NAMES, "E": TIER_E_NAMES}


def feature_names(tier: str) -> tuple[str, ...]:
    if tier not in _TIERS:
        raise ValueError(f"unknown feature tier {tier!r}; available: {sorted(_TIERS)}")
    return _TIERS[tier]


def feature_dim(tier: str) -> int:
    return len(feature_names(tier))


@row_kernel(pa.struct([("outgoing", INTS), ("incoming", INTS)]))
def degrees(n: int, u: list[int], v: list[int]) -> dict:
    return {"outgoing": np.bincount(u, minlength=n), "incoming": np.bincount(v, minlength=n)}


def with_degrees(graphs: DataFrame) -> DataFrame:
    """Add ``degrees``: per-node out- and in-degrees, by node id."""
    return graphs.withColumn("degrees", degrees(F.size("nodes"), F.col("edges.u"), F.col("edges.v")))


def with_lexical(graphs: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Add ``lexical``: one struct of flags per node."""

    def flags(node):
        values = lexical_flags(node["code"], node["calls"], node["ops"], lexicon)
        return F.struct(*[values[name].alias(name) for name in LEXICAL_NAMES])

    return graphs.withColumn("lexical", graph.settled(F.transform("nodes", flags)))


def featurize(graphs: DataFrame, tier: str = "L", lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Add ``x``: one array of ``feature_dim(tier)`` floats in [0, 1] per node."""
    feature_names(tier)
    rows = with_degrees(graphs)
    rows = with_lexical(rows, lexicon) if tier != "S" else rows
    rows = rows.withColumn(
        "_scale",
        graph.settled(
            F.struct(
                F.greatest(F.lit(1), F.array_max(F.col("nodes.depth"))).alias("depth"),
                F.greatest(F.lit(1), F.size("source_lines"), F.array_max(F.col("nodes.line"))).alias("lines"),
            )
        ),
    )
    if tier == "E":
        stored = F.element_at("features", EMBED_KEY)
        whole = (F.size(stored) == F.size("nodes")) & F.forall(stored, lambda r: F.size(r) == EMBED_DIM)
        problem = F.concat("sample_id", F.lit(": no statement embeddings of the expected shape"))
        rows = rows.withColumn(
            "_embedded",
            graph.settled(
                F.when(F.coalesce(whole, F.lit(False)), stored).otherwise(
                    F.raise_error(problem).cast("array<array<double>>")
                )
            ),
        )

    def row(node):
        def clipped(side):
            return F.least(F.get(F.col(f"degrees.{side}"), node["id"]), F.lit(DEGREE_CLIP)) / DEGREE_CLIP

        structural = [(node["kind"] == kind).cast("double") for kind in NODE_KINDS] + [
            clipped("incoming"),
            clipped("outgoing"),
            F.greatest(node["depth"], F.lit(0)) / F.col("_scale.depth"),
            node["in_loop"].cast("double"),
            F.array_contains(F.col("back_edges.v"), node["id"]).cast("double"),
            F.least(F.greatest(node["line"], F.lit(0)) / F.col("_scale.lines"), F.lit(1.0)),
        ]
        if tier != "S":
            flags = F.get(F.col("lexical"), node["id"])
            structural += [flags[name] for name in LEXICAL_NAMES]
        values = F.array(*structural)
        if tier == "E":
            values = F.concat(values, F.get(F.col("_embedded"), node["id"]))
        return values.cast("array<float>")

    spare = {"_scale", "_embedded", "degrees", "lexical"} - set(graphs.columns)
    return rows.withColumn("x", F.transform("nodes", row)).drop(*spare)


def weighted_score(flags: Column | dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum of flags, scaled so that a node with every flag set scores 1."""
    unknown = sorted(set(weights).difference(LEXICAL_NAMES))
    if unknown:
        raise ValueError(f"unknown lexical features: {', '.join(unknown)}")
    total = sum(weights.values())
    if not weights or min(weights.values()) < 0 or total <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    terms = [flags[name] * weight for name, weight in weights.items()]
    return reduce(lambda a, b: a + b, terms) / total


def with_heuristic_score(
    graphs: DataFrame, weights: dict[str, float] | None = None, lexicon: Lexicon = Lexicon(),
    name: str = "score",
) -> DataFrame:
    """Add the heuristic suspicion of every node as an array of doubles."""
    weights = DEFAULT_WEIGHTS if weights is None else weights
    scores = F.transform(
        "nodes",
        lambda n: weighted_score(lexical_flags(n["code"], n["calls"], n["ops"], lexicon), weights),
    )
    return graphs.withColumn(name, graph.settled(scores))
