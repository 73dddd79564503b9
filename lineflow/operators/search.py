"""Search methods over graphs: visiting orders and walks, scored into episodes.

A method only says where it goes: an *order* of nodes, or a *walk* of moves and backtracks.
Where it stops, what that costs and how it ends follows from the position of the first
declarable node at which the declare rule fires, so scoring is array arithmetic on the row.
Nothing here shuffles: one graph is one row, and seeds are exploded next to it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineflow.config import EnvConfig, RewardConfig
from lineflow.functions import graph, kernels
from lineflow.operators.metrics import exact_mean
from lineflow.operators.rewrite import draw
from lineflow.schema import EPISODE_COLUMNS


class TestSplitError(RuntimeError):
    """The test split is evaluated once, on purpose, or not at all."""

    __test__ = False


@dataclass(frozen=True)
class Method:
    """How a search method moves. ``path`` builds an array of nodes (an order) or a struct of
    ``nodes`` and ``slots`` (a walk) from the prepared columns of a graph row."""

    name: str
    path: Callable[[EnvConfig], Column]
    walks: bool = False
    stochastic: bool = False


def _flow() -> tuple[Column, ...]:
    return F.size("nodes"), F.col("slots.u"), F.col("slots.v"), F.col("entry")


def _by(key: Callable[[Column], Column]) -> Column:
    keyed = F.transform("nodes", lambda n: F.struct(key(n).alias("at"), n["id"].alias("id")))
    return F.array_sort(keyed)["id"]


def _draws() -> Column:
    """32 random bits for every step of the budget: a hash of seed, graph and step, so that a
    draw depends on no other one and can be made anew anywhere."""
    steps = F.sequence(F.lit(0), F.col("max_steps") - 1)
    bits = F.transform(steps, lambda t: F.substring(draw(F.col("seed"), F.col("sample_id"), t), 1, 8))
    return F.transform(bits, lambda x: F.conv(x, 16, 10).cast("long"))


METHODS: dict[str, Method] = {
    m.name: m
    for m in (
        Method(
            "dfs",
            lambda env: kernels.depth_first_walk(*_flow(), F.lit(env.allow_backtrack)),
            walks=True,
        ),
        Method("bfs", lambda env: kernels.breadth_first(*_flow())),
        Method("line_order", lambda env: _by(lambda n: n["line"])),
        Method(
            "heuristic_first",
            lambda env: kernels.best_first(*_flow(), F.col("nodes.line"), F.col("score")),
        ),
        Method(
            "random_walk",
            lambda env: kernels.random_walk(*_flow(), F.lit(env.allow_backtrack), _draws()),
            walks=True, stochastic=True,
        ),
        Method(
            "random_order",
            lambda env: _by(
                lambda n: draw(F.col("seed"), F.col("sample_id"), n["id"])
            ),
            stochastic=True,
        ),
    )
}


def method(name: str) -> Method:
    if name not in METHODS:
        raise ValueError(f"unknown baseline {name!r}; available: {sorted(METHODS)}")
    return METHODS[name]


def step_budget(num_nodes: Column, env: EnvConfig) -> Column:
    wanted = F.ceil(num_nodes * F.lit(env.max_steps_per_node)).cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(env.max_steps_cap), wanted))


def prepared(graphs: DataFrame, env: EnvConfig) -> DataFrame:
    """Add what every method reads: slot-ordered edges, budget, labels by node, metadata."""
    wide = graph.max_out_degree(F.col("edges")) > env.k
    problem = F.concat("sample_id", F.lit(f": out-degree exceeds k={env.k}"))
    slots = graph.successor_slots(F.col("nodes"), F.col("edges"))
    rows = graphs.withColumn(
        "slots", graph.settled(F.when(wide, F.raise_error(problem).cast("array<struct<u:int,line:int,v:int>>")).otherwise(slots))
    )
    depths = graph.shape_of(F.size("nodes"), F.col("edges"), F.col("entry"))["depth"]
    return rows.withColumn("_depths", depths).withColumns(
        {
            "max_steps": step_budget(F.size("nodes"), env),
            "dist_to_vuln": graph.distance_to_label(F.col("_depths"), F.col("vuln_nodes")),
            "labelled": graph.settled(
                F.transform("nodes", lambda n: F.array_contains("vuln_nodes", n["id"]))
            ),
            "statement": graph.settled(F.transform("nodes", lambda n: graph.is_statement(n["kind"]))),
        }
    ).drop("_depths")


def _first(flags: Column) -> Column:
    """0-based position of the first TRUE, NULL if there is none."""
    at = F.array_position(flags, F.lit(True)).cast("int")
    return F.when(at > 0, at - 1)


def score_orders(rows: DataFrame, reward: RewardConfig) -> DataFrame:
    """Outcome of visiting ``path`` (an order) under the declare rule ``fires``.

    The first node is free and each further one costs a step. The node reached with the last
    step of the budget is inspected, but neither hit nor declared.
    """
    budget = F.col("max_steps")
    rows = rows.withColumn("_open", graph.settled(F.slice("path", F.lit(1), budget)))
    rows = rows.withColumns(
        {
            "_declared_at": _first(
                F.transform("_open", lambda n: F.get(F.col("fires"), n) & F.get(F.col("statement"), n))
            ),
            "_hit": _first(F.transform("_open", lambda n: F.get(F.col("labelled"), n))),
            "_over": F.size("path") > budget,
        }
    )
    at = F.col("_declared_at")
    moves = F.coalesce(at, F.when(F.col("_over"), budget).otherwise(F.size("path") - 1))
    node = F.get(F.col("path"), at)
    success = F.coalesce(F.get(F.col("labelled"), node), F.lit(False))
    final = (
        F.when(at.isNull(), F.lit(reward.timeout))
        .when(success, F.lit(reward.correct)).otherwise(F.lit(reward.wrong))
    )
    reason = (
        F.when(at.isNotNull(), F.when(success, "correct").otherwise("wrong_declare"))
        .when(F.col("_over"), "timeout").otherwise("exhausted")
    )
    return rows.withColumns(
        {
            "success": success,
            "declared_node": node,
            "first_declared_node": node,
            "nodes_inspected": moves + 1,
            "actions_taken": F.when(at.isNull(), moves).otherwise(moves + 1),
            "cumulative_reward": moves * F.lit(reward.step) + final,
            "first_hit_step": F.when(at.isNull() | (F.col("_hit") <= at), F.col("_hit")),
            "end_reason": reason,
            "visit_order": F.slice("path", F.lit(1), moves + 1),
        }
    ).drop("_open", "_declared_at", "_hit", "_over")


def score_walks(rows: DataFrame, reward: RewardConfig, env: EnvConfig) -> DataFrame:
    """Outcome of following ``path`` (a walk) under the declare rule ``fires``.

    A node is declared when the walk first stands on it and the rule fires, while declarations
    last; the j-th declaration at path position q is action q + j. A correct one ends the
    episode, and so does the last wrong one, unless the budget ran out before.
    """
    limit, budget = env.max_declares, F.col("max_steps")
    nodes = F.col("path.nodes")
    # Per position: node, first visit?, moved onto a visited node?
    rows = rows.withColumn("_nodes", graph.settled(nodes)).withColumn(
        "_at",
        graph.settled(
            F.transform(
                "_nodes",
                lambda n, i: F.struct(
                    n.alias("node"), (F.array_position("_nodes", n) == i + 1).alias("fresh"),
                    (F.coalesce(F.get(F.col("path.slots"), i - 1), F.lit(0)) != kernels.BACKTRACK).alias("moved"),
                ),
            )
        ),
    )
    firing = F.transform(
        "_at",
        lambda s, q: F.when(
            s["fresh"] & F.get(F.col("fires"), s["node"]) & F.get(F.col("statement"), s["node"]),
            F.struct(q.cast("int").alias("q"), F.get(F.col("labelled"), s["node"]).alias("right"), s["node"].alias("node")),
        ),
    )
    asked = F.slice(F.filter(firing, lambda d: d.isNotNull()), 1, limit)
    rows = rows.withColumn("_asked", graph.settled(asked))
    # Declarations up to the first right one that the budget still allows.
    allowed = F.filter(F.col("_asked"), lambda d, j: d["q"] + j < budget)
    rows = rows.withColumn("_allowed", graph.settled(allowed)).withColumn(
        "_right", _first(F.col("_allowed.right"))
    )
    right = F.col("_right")
    made = F.when(right.isNotNull(), F.slice("_allowed", F.lit(1), right + 1)).otherwise(F.col("_allowed"))
    rows = rows.withColumn("_made", graph.settled(made))
    spent = right.isNull() & (F.size("_made") == limit)
    declared = right.isNotNull() | spent
    all_moves = F.size("_at") - 1
    last = F.element_at("_made", -1)["q"]
    over = ~declared & (all_moves + F.size("_made") >= budget)
    moves = (
        F.when(declared, last).when(over, budget - F.size("_made")).otherwise(all_moves)
    ).cast("int")
    rows = rows.withColumn("_moves", moves).withColumn("_over", over).withColumn("_spent", spent)
    done = F.slice("_at", F.lit(2), F.greatest(F.col("_moves"), F.lit(0)))
    revisits = F.size(F.filter(done, lambda s: s["moved"] & ~s["fresh"]))
    wrong = F.size(F.filter(F.col("_made"), lambda d: ~d["right"]))
    ended = F.when(right.isNotNull(), F.lit(reward.correct)).when(F.col("_spent"), F.lit(0.0)).otherwise(F.lit(reward.timeout))
    seen = F.slice("_nodes", F.lit(1), F.col("_moves") + 1)
    hit = _first(F.transform(seen, lambda n: F.get(F.col("labelled"), n)))
    rows = rows.withColumn("_hit", hit)
    if env.allow_backtrack:
        stuck = F.lit(False)
    else:  # no successor left and nothing to declare: the walk cannot act at all
        here = F.get(F.col("_nodes"), F.col("_moves"))
        leaves = F.exists(F.col("slots"), lambda s: s["u"] == here)
        can_declare = F.get(F.col("statement"), here) & ~F.array_contains(F.col("_made.node"), here)
        stuck = ~leaves & ~can_declare
    reason = (
        F.when(right.isNotNull(), "correct").when(F.col("_spent"), "wrong_declare")
        .when(F.col("_over"), "timeout").when(stuck, "dead_end").otherwise("exhausted")
    )
    return rows.withColumns(
        {
            "success": right.isNotNull(),
            "declared_node": F.get(F.col("_made.node"), F.size("_made") - 1),
            "first_declared_node": F.get(F.col("_made.node"), F.lit(0)),
            "nodes_inspected": F.size(F.array_distinct(seen)),
            "actions_taken": F.col("_moves") + F.size("_made"),
            "cumulative_reward": F.col("_moves") * F.lit(reward.step) + revisits * F.lit(reward.revisit)
            + wrong * F.lit(reward.wrong) + ended,
            "first_hit_step": F.col("_hit")
            + F.size(F.filter(F.col("_made"), lambda d: d["q"] < F.col("_hit"))),
            "end_reason": reason,
            "visit_order": F.array_distinct(seen),
            "declarations": F.col("_made"),
        }
    ).drop("_nodes", "_at", "_asked", "_allowed", "_right", "_made", "_moves", "_over", "_spent", "_hit")


def narrowed(rows: DataFrame) -> DataFrame:
    """Prepared rows without the text of their nodes and what else no search reads."""
    kept = ("sample_id", "project", "cwe", "entry", "vuln_nodes", "slots", "max_steps", "dist_to_vuln",
            "labelled", "statement", "score")
    places = F.transform("nodes", lambda n: F.struct(n["id"].alias("id"), n["line"].alias("line")))
    return rows.select(*[c for c in kept if c in rows.columns], places.alias("nodes"))


def to_episodes(scored: DataFrame, split: str) -> DataFrame:
    """The fact table: one row per method, seed and graph."""
    first = F.col("first_declared_node")
    return scored.withColumns(
        {
            "graph_id": F.col("sample_id"),
            "split": F.lit(split),
            "num_nodes": F.size("nodes"),
            "num_vuln": F.size("vuln_nodes"),
            "first_declare_correct": F.coalesce(F.get(F.col("labelled"), first), F.lit(False)),
        }
    ).select(*EPISODE_COLUMNS)


def run_evaluation(
    graphs: DataFrame,
    methods: Sequence[str],
    env: EnvConfig | None = None,
    reward: RewardConfig | None = None,
    seeds: Sequence[int] = (0,),
    split: str = "val",
    allow_test: bool = False,
    score: str | None = None,
    scorer: str = "heuristic",
    threshold: float | dict[str, float] | None = None,
    episodes: bool = True,
) -> DataFrame:
    """One row per method, seed and graph.

    Without a threshold a method declares exactly on labels; with one, at the first node whose
    ``score`` (a column of per-node values in ``graphs``) reaches it, under the name
    ``method+scorer``. Seeds multiply rows only for stochastic methods, each of which draws
    from a stream of its own per (seed, graph).
    """
    if split == "test" and not allow_test:
        raise TestSplitError("refusing to evaluate the test split; pass allow_test=True")
    env = env or EnvConfig()
    rows = prepared(graphs, env)
    if score and score != "score":
        rows = rows.withColumn("score", F.col(score))
    return run_prepared(rows, methods, (threshold,), env, reward, seeds, split, scorer, episodes)


def run_prepared(
    rows: DataFrame,
    methods: Sequence[str],
    thresholds: Sequence[float | dict[str, float] | None],
    env: EnvConfig | None = None,
    reward: RewardConfig | None = None,
    seeds: Sequence[int] = (0,),
    split: str = "val",
    scorer: str = "heuristic",
    episodes: bool = True,
) -> DataFrame:
    """``run_evaluation`` over prepared rows, under several declare rules at once: where a method
    goes depends on no rule, so its path is found once and scored under each."""
    env, reward = env or EnvConfig(), reward or RewardConfig()
    out = None
    for name in methods:
        how, rules = method(name), []
        for threshold in thresholds:
            if threshold is None:
                fires, label = F.col("labelled"), name
            else:
                limit = threshold[name] if isinstance(threshold, dict) else threshold
                fires, label = F.transform("score", lambda s: s >= F.lit(limit)), f"{name}+{scorer}"
            rules.append(F.struct(F.lit(label).alias("method"), fires.alias("fires")))
        paths = _seeded(rows, how, seeds).withColumn("path", graph.settled(how.path(env)))
        ruled = paths.select("*", F.inline(F.array(*rules)))
        scored = score_walks(ruled, reward, env) if how.walks else score_orders(ruled, reward)
        part = to_episodes(scored, split) if episodes else scored
        out = part if out is None else out.unionByName(part)
    return out


def _seeded(rows: DataFrame, how: Method, seeds: Sequence[int]) -> DataFrame:
    used = list(seeds) if how.stochastic else list(seeds)[:1]
    return rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in used])))


def threshold_curve(
    graphs: DataFrame, name: str, thresholds: Sequence[float], env: EnvConfig | None = None,
    reward: RewardConfig | None = None, seeds: Sequence[int] = (0,), scorer: str = "heuristic",
) -> DataFrame:
    """Quality of one method at each threshold: the path is computed once per graph and seed,
    then scored against every threshold on the same row."""
    env, reward = env or EnvConfig(), reward or RewardConfig()
    how = method(name)
    rows = _seeded(prepared(graphs, env), how, seeds)
    rows = rows.withColumn("path", graph.settled(how.path(env)))
    rows = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    rows = rows.withColumn("fires", graph.settled(F.transform("score", lambda s: s >= F.col("threshold"))))
    scored = score_walks(rows, reward, env) if how.walks else score_orders(rows, reward)
    return scored.groupBy("threshold").agg(
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg(F.col("declared_node").isNotNull().cast("double")).alias("declared_rate"),
        F.avg("nodes_inspected").alias("nodes_inspected"),
        exact_mean("cumulative_reward").alias("cumulative_reward"),
    ).select(F.lit(name).alias("method"), F.lit(scorer).alias("scorer"), "*")


#: What is counted of an ended episode; the reward is a sum of these, each times its price.
COUNTS = ("episodes", "successes", "declared", "inspected", "moves", "revisits", "wrong", "timeouts")


def _endings(rows: DataFrame, how: Method, grid: Sequence[float]) -> DataFrame:
    """(low, high, counts): for every stretch of the sorted ``grid`` how the episode along
    ``path`` ends at its thresholds. The first node that reaches a threshold is where the highest
    score so far passes it, so the path's records cut the grid into stretches."""
    budget, size = F.col("max_steps"), F.size("_nodes")
    rows = rows.withColumn("_nodes", graph.settled(F.col("path.nodes") if how.walks else F.col("path")))
    rows = rows.withColumn("_seen", graph.settled(F.transform(
        F.slice("_nodes", F.lit(1), budget),
        lambda n: F.when(F.get(F.col("statement"), n), F.get(F.col("score"), n)),
    )))
    record = "struct<best:double,met:array<struct<p:int,low:int,high:int>>>"
    steps = F.array(*[F.lit(float(t)) for t in grid])

    def reached(score: Column) -> Column:
        return F.size(F.filter(steps, lambda t: t <= score))

    begin = F.struct(F.lit(float("-inf")).alias("best"), F.array().cast("array<struct<p:int,low:int,high:int>>").alias("met")).cast(record)
    numbered = F.transform("_seen", lambda s, p: F.struct(s.alias("s"), p.cast("int").alias("p")))
    folded = F.aggregate(numbered, begin, lambda acc, x: F.when(
        x["s"] > acc["best"],
        F.struct(x["s"].alias("best"), F.concat(acc["met"], F.array(F.struct(
            x["p"].alias("p"), reached(acc["best"]).alias("low"), reached(x["s"]).alias("high")
        ))).alias("met")).cast(record),
    ).otherwise(acc))
    rows = rows.withColumn("_met", graph.settled(F.filter(folded["met"], lambda m: m["low"] < m["high"])))
    done = F.coalesce(F.array_max(F.transform("_met", lambda m: m["high"])), F.lit(0))
    last = F.least(budget, size - 1) if how.walks else F.when(size > budget, budget).otherwise(size - 1)
    rows = rows.withColumn("_rest", F.struct(last.cast("int").alias("p"), done.cast("int").alias("low"), F.lit(len(grid)).alias("high")))

    def counted(m: Column, declares: bool) -> Column:
        node = F.get(F.col("_nodes"), m["p"])
        right = F.coalesce(F.get(F.col("labelled"), node), F.lit(False)) & F.lit(declares)
        inspected, revisits = m["p"] + 1, F.lit(0)
        if how.walks:
            seen = F.slice("_nodes", F.lit(1), m["p"] + 1)
            inspected = F.size(F.array_distinct(seen))
            # Steps that did not go back and yet led to no new node.
            forward = F.size(F.filter(F.slice("path.slots", F.lit(1), m["p"]), lambda s: s != kernels.BACKTRACK))
            revisits = forward - (inspected - 1)
        values = (F.lit(1), right, F.lit(declares), inspected, m["p"], revisits, ~right & F.lit(declares), F.lit(not declares))
        return F.struct(m["low"].alias("low"), m["high"].alias("high"), *[
            v.cast("long").alias(c) for c, v in zip(COUNTS, values, strict=True)
        ])

    stretches = F.concat(F.transform("_met", lambda m: counted(m, True)), F.transform(F.array("_rest"), lambda m: counted(m, False)))
    return rows.select("seed", F.explode(stretches).alias("e")).select("seed", "e.*").filter("low < high")


def threshold_table(
    graphs: DataFrame, names: Sequence[str], thresholds: Sequence[float], env: EnvConfig | None = None,
    reward: RewardConfig | None = None, seeds: Sequence[int] = (0,), scorer: str = "heuristic",
) -> DataFrame:
    """``threshold_curve`` of many methods at once, over all seeds, without scoring an episode
    per threshold: stretches of equal outcome are counted where they begin and taken away where
    they end, in whole numbers, and one running sum over the grid gives every row."""
    env, reward = env or EnvConfig(), reward or RewardConfig()
    if env.max_declares != 1:
        raise ValueError("a threshold table is for searches that declare once")
    grid = sorted({float(t) for t in thresholds})
    rows, ends = prepared(graphs, env), None
    for name in names:
        how = method(name)
        part = _seeded(rows, how, seeds).withColumn("path", graph.settled(how.path(env)))
        part = _endings(part, how, grid).withColumn("method", F.lit(name))
        ends = part if ends is None else ends.unionByName(part)
    signed = F.array(*[
        F.struct(F.col(at).cast("int").alias("at"), *[(F.col(c) * sign).alias(c) for c in COUNTS])
        for at, sign in (("low", 1), ("high", -1))
    ])
    # Every method has a row at every threshold.
    blank = graphs.sparkSession.range(len(grid)).select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("method"), F.col("id").cast("int").alias("at"),
        *[F.lit(0).cast("long").alias(c) for c in COUNTS],
    )
    sums = ends.select("method", F.inline(signed)).unionByName(blank).groupBy("method", "at").agg(*[F.sum(c).alias(c) for c in COUNTS])
    # As many rows a method as the grid has steps.
    upto = Window.partitionBy("method").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    totals = sums.select("method", "at", *[F.sum(c).over(upto).alias(c) for c in COUNTS]).filter(F.col("at") < len(grid))
    prices = {
        "moves": reward.step, "revisits": reward.revisit, "successes": reward.correct, "wrong": reward.wrong, "timeouts": reward.timeout,
    }
    # Decimals: a mean that lies half way between two roundings is not moved off it.
    earned = sum((F.col(c) * F.lit(price).cast("decimal(10,6)") for c, price in prices.items()), F.lit(0).cast("decimal(10,6)"))
    count = F.col("episodes").cast("decimal(11,0)")
    return totals.select(
        "method", F.lit(scorer).alias("scorer"), F.element_at(F.array(*[F.lit(t) for t in grid]), F.col("at") + 1).alias("threshold"),
        "episodes", (F.col("successes") / F.col("episodes")).alias("success_rate"), (F.col("declared") / F.col("episodes")).alias("declared_rate"),
        (F.col("inspected") / F.col("episodes")).alias("nodes_inspected"),
        (earned.cast("decimal(20,6)") / count).cast("double").alias("cumulative_reward"),
    )


def best_thresholds(table: DataFrame) -> DataFrame:
    """The best row of every method of a threshold table."""
    rank = F.struct("success_rate", -F.col("nodes_inspected"), -F.col("threshold"))
    rest = [c for c in table.columns if c != "method"]
    return table.groupBy("method").agg(F.max_by(F.struct(*rest), rank).alias("b")).select("method", "b.*")


def best_threshold(curve: DataFrame) -> DataFrame:
    """The best row of a curve: success, then fewer nodes, then the smaller threshold."""
    return curve.orderBy(F.desc("success_rate"), "nodes_inspected", "threshold").limit(1)
