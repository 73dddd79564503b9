"""Line-level graphs from parser exports, labels from flaw lines, and the build cascade.

One function and its parsed method are one row, so after the join everything is narrow: line
merging, kinds, node text, coverage and label alignment are array expressions, and only
following edges goes through an Arrow kernel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.config import BuildConfig
from lineflow.functions import graph, text
from lineflow.functions.kernels import routed_edges
from lineflow.operators.rewrite import limit_out_degree

# --- Fixed values -----------------------------------------------------------------------
OPERATOR_PREFIX = "<operator>."
CONTROL_KINDS = {
    "IF": "BRANCH", "WHILE": "LOOP", "FOR": "LOOP", "DO": "LOOP", "SWITCH": "SWITCH",
    "BREAK": "JUMP", "CONTINUE": "JUMP", "GOTO": "JUMP",
}
STEP_OPERATORS = ("preIncrement", "postIncrement", "preDecrement", "postDecrement")
BUILD_STAGES = (
    "filtered_functions", "parsed_by_joern", "cfg_built", "cfg_usable", "labels_aligned",
    "size_within_bounds",
)
# Drop reasons and the number of stages a row dropped for that reason still survives.
REASON_LEVEL = {
    "not_parsed": 1, "no_statements": 2, "low_coverage": 3, "exit_unreachable": 3,
    "text_mismatch": 4, "no_flaw_on_node": 4, "flaw_unreachable": 4,
    "too_few_nodes": 5, "too_many_nodes": 5, "invalid_record": 5,
}
# ----------------------------------------------------------------------------------------


def sample_and_extension(methods: DataFrame) -> DataFrame:
    """Add ``sample_id`` and ``extension``, the stem and suffix of ``file``."""
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    suffix = F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    return methods.withColumn("extension", suffix).withColumn(
        "sample_id", F.expr("left(regexp_extract(file, '([^/]+)$', 1), length(regexp_extract(file, '([^/]+)$', 1)) - length(extension))")
    )


def select_methods(methods: DataFrame) -> DataFrame:
    """One method per sample: the first function of each parse, then the larger parse, with
    the C parse preferred when both are equally large."""
    cells = [c for c in methods.columns]
    rows = sample_and_extension(methods)
    order = F.struct(F.col("line"), -F.size("nodes"))

    def best(extension):
        here = F.col("extension") == extension
        return F.min_by(F.when(here, F.struct(*cells)), F.when(here, order))

    picked = rows.groupBy("sample_id").agg(best(".c").alias("c"), best(".cpp").alias("cpp"))
    larger = F.size("cpp.nodes") > F.size("c.nodes")
    use_cpp = F.col("cpp").isNotNull() & (F.col("c").isNull() | larger)
    return picked.select(
        "sample_id", F.when(use_cpp, F.col("cpp")).otherwise(F.col("c")).alias("method")
    ).filter(F.col("method").isNotNull())


def picked_method(methods: Column) -> Column:
    """The method ``select_methods`` takes, from an array of all parsed methods of one sample."""

    def best(extension):
        here = F.filter(methods, lambda m: m["file"].endswith(extension))
        # The place settles which of several equal ones comes first without comparing their nodes.
        ranked = F.transform(here, lambda m, i: F.struct(m["line"].alias("line"), (-F.size(m["nodes"])).alias("size"), i.alias("i")))
        return F.get(here, F.array_min(ranked)["i"])

    c, cpp = best(".c"), best(".cpp")
    larger = F.size(cpp["nodes"]) > F.size(c["nodes"])
    return F.when(cpp.isNotNull() & (c.isNull() | larger), cpp).otherwise(c)


def is_assignment(name: Column) -> Column:
    steps = [OPERATOR_PREFIX + step for step in STEP_OPERATORS]
    return name.startswith(OPERATOR_PREFIX + "assignment") | name.isin(*steps)


def _spans(method: Column) -> Column:
    """Multi-line statements and control headers, widest first."""
    both = F.concat(
        F.transform(method["stmts"], lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))),
        F.transform(method["controls"], lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last"))),
    )
    wide = F.filter(both, lambda s: (s["last"] > s["first"]) & (s["first"] > 0))
    ranked = F.transform(
        wide,
        lambda s, i: F.struct(
            (s["first"] - s["last"]).alias("width"), i.alias("i"), s["first"].alias("first"), s["last"].alias("last")
        ),
    )
    return F.array_sort(ranked)


def _first_line(line: Column, spans: Column) -> Column:
    """The line that stands for ``line``: the start of the narrowest span around it."""
    return F.aggregate(
        spans, line, lambda acc, s: F.when(line.between(s["first"], s["last"]), s["first"]).otherwise(acc)
    )


def _construct_kind(control: Column) -> Column:
    pairs = [F.lit(x) for item in CONTROL_KINDS.items() for x in item]
    return F.element_at(F.create_map(*pairs), control)


def line_graphs(parsed: DataFrame) -> DataFrame:
    """Contract each parsed method to one node per source line.

    ``parsed`` has ``method`` and ``func_before``. Adds ``source_lines``, ``nodes``, ``edges``,
    ``back_edges``, ``coverage`` and ``spans``/``lines`` for line lookup; rows without usable
    statements (or without a method) get NULL ``nodes``.
    """
    method = F.col("method")

    def only(label):
        found = F.filter(method["nodes"], lambda n: n["label"] == label)
        return F.get(found, F.size(found) - 1)["id"]

    source = F.regexp_replace("func_before", "\n+$", "")
    settled = graph.settled
    base = (
        parsed.withColumn("source_lines", settled(text.lines_of(source)))
        .withColumn("spans", settled(_spans(method)))
        .withColumn("_entry_id", only("METHOD"))
        .withColumn("_exit_id", only("METHOD_RETURN"))
    )
    positioned = F.filter(
        method["nodes"], lambda n: ~n["label"].isin("METHOD", "METHOD_RETURN") & (n["line"] >= 1)
    )
    base = base.withColumn(
        "_placed",
        settled(
            F.transform(
                positioned,
                lambda n: F.struct(
                    n["id"].alias("id"), _first_line(n["line"], F.col("spans")).alias("line"),
                    n["label"].alias("label"), n["name"].alias("name"),
                ),
            )
        ),
    )
    usable = (
        F.col("_entry_id").isNotNull() & F.col("_exit_id").isNotNull() & (F.size("_placed") > 0)
    )
    base = base.withColumn(
        "lines", settled(F.when(usable, F.array_sort(F.array_distinct(F.col("_placed.line")))))
    )
    lines, spans = F.col("lines"), F.col("spans")

    # Flow: group 0 is ENTRY, groups 1.. are the lines, the last group is EXIT.
    leaving = F.filter(method["edges"], lambda e: e["src"] != F.col("_exit_id"))
    groups = F.concat(
        F.array(F.lit(0), F.size(lines) + 1),
        F.transform(F.col("_placed"), lambda p: F.array_position(lines, p["line"]).cast("int")),
    )
    ids = F.concat(F.array("_entry_id", "_exit_id"), F.col("_placed.id"))
    base = base.withColumn(
        "edges",
        routed_edges(
            F.when(lines.isNotNull(), ids), groups, leaving["src"], leaving["dst"]
        ),
    ).withColumn("_shape", graph.shape_of(F.size(lines) + 2, F.col("edges"), F.lit(0)))

    # What each line carries.
    anchors = F.concat(
        F.filter(
            F.transform(
                method["controls"],
                lambda c: F.struct(
                    _first_line(F.when(c["first"] > 0, c["first"]).otherwise(c["line"]), spans).alias("line"),
                    _construct_kind(c["type"]).alias("kind"),
                ),
            ),
            lambda a: a["kind"].isNotNull(),
        ),
        F.transform(
            F.filter(method["stmts"], lambda s: s["label"] == "LOCAL"),
            lambda s: F.struct(_first_line(s["first"], spans).alias("line"), F.lit("DECL").alias("kind")),
        ),
    )
    covered = F.array_distinct(
        F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"])))
    )
    firsts = F.transform(covered, lambda x: F.struct(x.alias("line"), _first_line(x, spans).alias("first")))
    base = base.withColumn("_anchors", settled(anchors)).withColumn("_covered", settled(firsts))
    # Each step is a transform of its own: a lambda would re-evaluate a repeated expression.
    own = F.transform(
        lines,
        lambda line: F.struct(
            line.alias("line"), F.filter(F.col("_placed"), lambda p: p["line"] == line).alias("placed")
        ),
    )
    named = F.transform(
        own,
        lambda s: F.struct(
            s["line"].alias("line"),
            F.exists(s["placed"], lambda p: p["label"] == "RETURN").alias("returns"),
            F.array_distinct(
                F.transform(F.filter(s["placed"], lambda p: p["label"] == "CALL"), lambda p: p["name"])
            ).alias("names"),
        ),
    )
    split = F.transform(
        named,
        lambda s: F.struct(
            s["line"].alias("line"), s["returns"].alias("returns"),
            F.filter(s["names"], lambda x: ~x.startswith(OPERATOR_PREFIX)).alias("calls"),
            F.filter(s["names"], lambda x: x.startswith(OPERATOR_PREFIX)).alias("ops"),
        ),
    )

    def carried(s):
        none = graph.empty("string")
        constructs = F.concat(
            F.array(F.lit("OTHER")),
            F.when(s["returns"], F.array(F.lit("RETURN"))).otherwise(none),
            F.when(F.exists(s["ops"], is_assignment), F.array(F.lit("ASSIGN"))).otherwise(none),
            F.when(F.size(s["calls"]) > 0, F.array(F.lit("CALL"))).otherwise(none),
            F.transform(F.filter(F.col("_anchors"), lambda a: a["line"] == s["line"]), lambda a: a["kind"]),
        )
        merged = F.filter(F.col("_covered"), lambda c: c["first"] == s["line"])
        return F.struct(
            s["line"].alias("line"), s["calls"].alias("calls"), s["ops"].alias("ops"),
            constructs.alias("constructs"),
            F.greatest(s["line"], F.coalesce(F.array_max(merged["line"]), s["line"])).alias("last"),
        )

    def line_node(s, i):
        parts = F.transform(
            F.sequence(s["line"], s["last"]),
            lambda n: text.strip(F.coalesce(F.get(F.col("source_lines"), n - 1), F.lit(""))),
        )
        node_id = (i + 1).cast("int")
        return graph.node_struct(
            id=node_id, line=s["line"], kind=graph.resolve_kind(s["constructs"]),
            code=F.array_join(F.filter(parts, lambda p: p != ""), " "),
            depth=F.get(F.col("_shape.depth"), node_id),
            in_loop=F.get(F.col("_shape.in_loop"), node_id), calls=s["calls"], ops=s["ops"],
        )

    def terminal(node_id, line, kind, depth):
        return graph.node_struct(
            id=node_id, line=line, kind=F.lit(kind), code=F.lit(""), depth=depth,
            in_loop=F.lit(False), calls=graph.empty("string"), ops=graph.empty("string"),
        )

    exit_id = F.size(lines) + 1
    last_line = F.when(method["line_end"] > 0, method["line_end"]).otherwise(F.size("source_lines"))
    nodes = F.concat(
        F.array(terminal(F.lit(0), F.greatest(method["line"], F.lit(1)), "ENTRY", F.lit(0))),
        F.transform(F.transform(split, carried), line_node),
        F.array(terminal(exit_id, last_line, "EXIT", F.get(F.col("_shape.depth"), exit_id))),
    )

    # Coverage: code lines with a node, in a merged statement, in the header, or declaring.
    opens = F.array_min(
        F.filter(
            F.transform(F.col("source_lines"), lambda x, i: F.when(F.contains(x, F.lit("{")), i + 1)),
            lambda n: n >= F.greatest(method["line"], F.lit(1)),
        )
    )
    header_end = F.coalesce(opens, F.size("source_lines"))
    start = F.greatest(method["line"], F.lit(1))
    locals_ = F.transform(F.filter(method["stmts"], lambda s: s["label"] == "LOCAL"), lambda s: s["first"])
    merged = F.transform(
        F.filter(F.col("_covered"), lambda c: F.array_contains(lines, c["first"])), lambda c: c["line"]
    )
    accounted = F.concat(lines, merged, locals_)
    code = F.filter(
        F.transform(
            text.code_line_mask(F.col("func_before")),
            lambda carries, i: F.when(
                carries
                & ~text.strip(F.coalesce(F.get(F.col("source_lines"), i), F.lit(""))).startswith("#"),
                i + 1,
            ),
        ),
        lambda n: n.isNotNull(),
    )
    base = base.withColumns(
        {
            "nodes": settled(F.when(lines.isNotNull(), nodes)),
            "_accounted": settled(accounted), "_code": settled(code),
        }
    )
    below = F.filter(F.col("_code"), lambda n: ~n.between(start, header_end))
    missed = F.array_except(below, F.coalesce("_accounted", graph.empty("int")))
    return base.withColumns(
        {
            "back_edges": F.col("_shape.back_edges"),
            "coverage": (F.size("_code") - F.size(missed)) / F.greatest(F.size("_code"), F.lit(1)),
        }
    ).drop("_entry_id", "_exit_id", "_placed", "_shape", "_anchors", "_covered", "_accounted", "_code")


def rejection_reason(min_coverage: float) -> Column:
    """Why a line graph is unusable, or NULL."""
    exit_depth = F.element_at("nodes", -1)["depth"]
    return F.when(F.col("coverage") < min_coverage, "low_coverage").when(
        exit_depth < 0, "exit_unreachable"
    )


def node_of_line(line: Column) -> Column:
    """Id of the node covering a source line, NULL if none does."""
    at = F.array_position("lines", _first_line(line, F.col("spans")))
    return F.when(at > 0, at.cast("int"))


def align_flaw_lines(graphs: DataFrame, verify: bool = True) -> DataFrame:
    """Add ``vuln_nodes``, ``mapped``, ``unmapped`` and ``align_reason``.

    With ``verify`` a flaw line's text must match the source at its index and be part of the
    code of the node it falls on, blanks aside.
    """
    zipped = F.arrays_zip("flaw_line_indices", "flaw_lines") if verify else F.transform(
        "flaw_line_indices",
        lambda i: F.struct(i.alias("flaw_line_indices"), F.lit("").alias("flaw_lines")),
    )

    def placed(flaw):
        line = flaw["flaw_line_indices"] + 1
        node = node_of_line(line)
        wanted = flaw["flaw_lines"]
        expected = text.squash(wanted)
        if not verify:
            return F.struct(node.alias("node"), F.lit(False).alias("bad"))
        here = F.when(line > 0, F.get(F.col("source_lines"), line - 1))
        code = F.get(F.col("nodes"), node)["code"]
        # Equal texts, and parts of a text, stay so without their blanks.
        moved = here.isNull() | ((here != wanted) & (text.squash(here) != expected))
        inside = F.contains(code, wanted) | F.contains(text.squash(code), expected)
        return F.struct(node.alias("node"), (moved | (node.isNotNull() & ~inside)).alias("bad"))

    uneven = F.size("flaw_lines") != F.size("flaw_line_indices") if verify else F.lit(False)
    rows = graphs.withColumn("_flaws", graph.settled(F.transform(zipped, placed)))
    on_node = F.filter(F.col("_flaws.node"), lambda n: n.isNotNull())
    rows = rows.withColumns(
        {
            "vuln_nodes": graph.settled(F.array_sort(F.array_distinct(on_node))),
            "mapped": F.size(on_node),
            "unmapped": F.size("_flaws") - F.size(on_node),
        }
    )
    hidden = F.forall("vuln_nodes", lambda n: F.get(F.col("nodes"), n)["depth"] < 0)
    reason = (
        F.when(uneven | F.exists(F.col("_flaws.bad"), lambda b: b), "text_mismatch")
        .when(F.size("vuln_nodes") == 0, "no_flaw_on_node")
        .when(hidden, "flaw_unreachable")
    )
    return rows.withColumn("align_reason", reason).drop("_flaws")


def build_candidates(
    filtered: DataFrame, methods: DataFrame, config: BuildConfig | None = None
) -> DataFrame:
    """Every filtered function with its line graph and ``reason``, NULL if it is usable."""
    return candidates_of(filtered.join(select_methods(methods), "sample_id", "left"), config)


def candidates_of(parsed: DataFrame, config: BuildConfig | None = None) -> DataFrame:
    """``build_candidates`` of functions that have their ``method`` next to them."""
    config = config or BuildConfig()
    rows = align_flaw_lines(line_graphs(parsed))
    size = F.size("nodes")
    reason = F.coalesce(
        F.when(F.col("method").isNull(), "not_parsed"),
        F.when(F.col("nodes").isNull(), "no_statements"),
        rejection_reason(config.min_coverage),
        F.col("align_reason"),
        F.when(size < config.min_nodes, "too_few_nodes"),
        F.when(size > config.max_nodes, "too_many_nodes"),
    )
    return rows.withColumn("reason", reason)


def build_graphs(
    filtered: DataFrame, methods: DataFrame, config: BuildConfig | None = None
) -> DataFrame:
    """Usable functions as graph records, wide nodes rewritten as dispatch chains."""
    return graphs_of(filtered.join(select_methods(methods), "sample_id", "left"), config)


def graphs_of(parsed: DataFrame, config: BuildConfig | None = None) -> DataFrame:
    """``build_graphs`` of functions that have their ``method`` next to them."""
    config = config or BuildConfig()
    kept = candidates_of(parsed, config).filter("reason IS NULL")
    records = kept.select(
        "sample_id", "project", "commit_id", "cwe", "source_lines", "nodes", "edges",
        "back_edges", F.lit(0).alias("entry"), (F.size("nodes") - 1).alias("exit"),
        "vuln_nodes", F.create_map().cast("map<string,array<array<double>>>").alias("features"),
    )
    return limit_out_degree(records, config.max_out_degree)


def build_attrition(candidates: DataFrame) -> DataFrame:
    """Functions surviving each build stage, in stage order."""
    level = F.lit(len(BUILD_STAGES))
    for reason, reached in REASON_LEVEL.items():
        level = F.when(F.col("reason") == reason, reached).otherwise(level)
    counts = candidates.select(level.alias("level")).agg(
        *[F.count_if(F.col("level") > i).alias(f"s{i}") for i in range(len(BUILD_STAGES))]
    )
    steps = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("step"), F.col(f"s{i}").alias("rows"))
            for i, name in enumerate(BUILD_STAGES)
        ]
    )
    return counts.select(F.inline(steps))


def build_reasons(candidates: DataFrame, config: BuildConfig | None = None) -> DataFrame:
    """Drops by reason, plus ``rewritten_wide_nodes``: kept graphs that needed a chain."""
    widest = (config or BuildConfig()).max_out_degree
    wide = F.col("reason").isNull() & (graph.max_out_degree(F.col("edges")) > widest)
    label = F.when(wide, "rewritten_wide_nodes").otherwise(F.col("reason"))
    return (
        candidates.select(label.alias("reason")).filter("reason IS NOT NULL")
        .groupBy("reason").agg(F.count("*").alias("functions"))
    )
