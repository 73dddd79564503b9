"""Line diffs as joins: which lines of two versions of a text correspond.

Lines of both versions fall into groups of equal text, so a line that occurs once in either
version pairs up by grouping alone. The pairs that keep their order in both versions, as many as
possible, are *anchors*. They cut the versions into gaps, and in a gap the n-th occurrence of a
line pairs with its n-th occurrence on the other side, counted from the gap's start and from its
end. Of all pairs the longest run that rises on both sides is kept; whatever it leaves out was
removed or added.

Lines are dealt by text once; grouping, counting within gaps and folding reuse that partitioning.
There are at most two pairs a line, so a line that is repeated without end costs no square. The
longest rising run is a fold over one text's pairs, in array functions. Unlike matchers that take
the longest common block first, the result never depends on where a block happens to start.

Defined results: versions that are NULL have no result. A text without a line end is one line, an
empty one an empty line. Ids must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineflow.functions import text
from lineflow.functions.graph import settled
from lineflow.session import written

#: Derived line numbers are broadcast if there are at most so many rows and numbers.
BROADCAST_NUMBERS = 2_000_000


def _longest(rows: DataFrame, pairs: str, out: str) -> DataFrame:
    """Replace the column ``pairs``, an array of ``(i, j)``, by ``out``: of its longest runs that
    rise on both sides the one that patience sorting finds. A pair goes onto the first pile whose
    top has no smaller ``j``, and remembers the top of the pile before."""
    none = F.array().cast("array<int>")
    # Pairs of one i come with falling j, so that a run takes at most one of them.
    turned = F.array_sort(F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), (-p["j"]).alias("j"))))
    rows = rows.withColumn("_sorted", settled(F.transform(turned, lambda p: F.struct(p["i"].alias("i"), (-p["j"]).alias("j")))))
    rows = rows.withColumn("_js", settled(F.col("_sorted.j")))
    js, places = F.col("_js"), F.sequence(F.lit(0), F.size("_js") - 1)

    def put(piles: Column, t: Column) -> Column:
        tops = piles["tops"]
        here = F.size(F.filter(tops, lambda k: F.get(js, k) < F.get(js, t)))
        later = F.slice(tops, here + 2, F.greatest(F.size(tops) - here - 1, F.lit(0)))
        return F.struct(
            F.concat(F.slice(tops, F.lit(1), here), F.array(t), later).alias("tops"),
            F.concat(piles["back"], F.array(F.coalesce(F.get(tops, here - 1), F.lit(-1)))).alias("back"),
        )

    # Most edits move nothing: then every pair is kept and nothing is folded.
    moved = F.exists(places, lambda t: (t > 0) & (F.get(js, t - 1) >= F.get(js, t)))
    piles = F.aggregate(places, F.struct(none.alias("tops"), none.alias("back")), put)
    rows = rows.withColumn("_piles", settled(F.when(moved, piles)))
    back, tops = F.col("_piles.back"), F.col("_piles.tops")
    walked = F.aggregate(tops, none, lambda run, _: F.concat(run, F.array(
        F.when(F.size(run) == 0, F.element_at(tops, -1)).otherwise(F.get(back, F.element_at(run, -1)))
    )))
    kept = F.transform(F.reverse(walked), lambda t: F.get(F.col("_sorted"), t))
    chosen = F.when(F.col("_piles").isNull(), F.col("_sorted")).otherwise(kept)
    return rows.withColumn(out, settled(chosen)).drop("_sorted", "_js", "_piles", pairs)


def matches(versions: DataFrame, id: str, before: Column, after: Column) -> DataFrame:
    """(id, matched): for every row with both versions, the pairs ``(i, j)`` of corresponding
    lines, 0-based, in order."""
    both = versions.select(F.col(id).alias("id"), before.alias("b"), after.alias("a")).filter("id IS NOT NULL AND b IS NOT NULL AND a IS NOT NULL")
    sides = both.select("id", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), text.lines_of(F.col("b")).alias("lines")),
        F.struct(F.lit(1).alias("side"), text.lines_of(F.col("a")).alias("lines")),
    )).alias("s"))
    lines = sides.select("id", F.col("s.side").alias("side"), F.posexplode("s.lines").alias("i", "x")).select(
        "id", "side", "i", F.xxhash64("x").alias("h"), F.length("x").alias("size")
    )
    # One row a line, all lines of a text together: every step below keeps this partitioning.
    lines = lines.repartition("id")
    same = ["id", "h", "size"]

    def on(side: int) -> Column:
        return F.when(F.col("side") == side, F.col("i"))

    single = lines.groupBy(*same).agg(
        F.count(on(0)).alias("n0"), F.count(on(1)).alias("n1"), F.min(on(0)).alias("i"), F.min(on(1)).alias("j")
    ).filter("n0 = 1 AND n1 = 1")
    anchors = _longest(single.groupBy("id").agg(F.collect_list(F.struct("i", "j")).alias("pairs")), "pairs", "anchors")
    placed = lines.join(anchors, "id", "left")
    is_anchor = F.coalesce(
        F.when(F.col("side") == 0, F.array_contains("anchors.i", F.col("i"))).otherwise(F.array_contains("anchors.j", F.col("i"))),
        F.lit(False),
    )
    before_it = Window.partitionBy("id", "side").orderBy("i")
    gaps = placed.select("id", "side", "i", "h", "size", is_anchor.alias("anchor")).withColumn(
        "gap", F.count_if("anchor").over(before_it)
    )
    here = ["id", "side", "gap", "anchor", "h", "size"]
    first = F.row_number().over(Window.partitionBy(*here).orderBy("i"))
    numbered = gaps.withColumn("n", first).withColumn("from_end", F.count(F.lit(1)).over(Window.partitionBy(*here)) - F.col("n") + 1)
    keys = numbered.withColumn("k", F.explode(F.array(
        F.struct(F.lit(0).alias("way"), F.col("n").cast("long").alias("n")),
        F.struct(F.lit(1).alias("way"), F.col("from_end").alias("n")),
    )))
    met = keys.groupBy("id", "gap", "anchor", "h", "size", "k").agg(F.max(on(0)).alias("i"), F.max(on(1)).alias("j")).filter(
        "i IS NOT NULL AND j IS NOT NULL"
    )
    pairs = met.groupBy("id").agg(F.collect_set(F.struct("i", "j")).alias("pairs"))
    return _longest(pairs, "pairs", "matched").withColumnRenamed("id", id)


def changed_lines(versions: DataFrame, id: str, before: Column, after: Column) -> DataFrame:
    """(id, changed): the lines of ``before``, 0-based, that the new version dropped or changed."""
    count = versions.filter(F.col(id).isNotNull() & before.isNotNull() & after.isNotNull()).select(
        F.col(id), text.num_lines(before).cast("int").alias("n")
    )
    found = count.join(matches(versions, id, before, after), id, "left")
    kept = F.coalesce(F.col("matched.i"), F.array().cast("array<int>"))
    return found.select(id, F.array_except(F.sequence(F.lit(0), F.col("n") - 1), kept).alias("changed"))


def small_enough(changed: DataFrame) -> DataFrame:
    """``changed``, written once, with a broadcast hint if it holds few rows and numbers."""
    changed = written(changed)
    held = changed.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("changed")), F.lit(0))).first()[0]
    return F.broadcast(changed) if held <= BROADCAST_NUMBERS else changed


def fix_rows(versions: DataFrame, id: str, before: Column, after: Column, context: int = 2) -> DataFrame:
    """(id, at, kind, line, text): a fix as rows to show, in order. ``removed`` lines come before
    the ``added`` ones that replace them; up to ``context`` unchanged lines stand around a change,
    and a ``gap`` between changes that are further apart. ``line`` counts old lines from 1.
    Line ends at the end do not count; where either version is empty nothing is shown."""
    bare = [F.regexp_replace(c, r"\n+\z", "") for c in (before, after)]
    both = versions.select(F.col(id).alias("id"), bare[0].alias("b"), bare[1].alias("a")).filter(
        before.isNotNull() & after.isNotNull() & (before != "") & (after != "")
    )
    known = matches(both, "id", F.col("b"), F.col("a"))
    rows = both.join(known, "id", "left").select(
        "id", settled(text.lines_of(F.col("b"))).alias("old"), settled(text.lines_of(F.col("a"))).alias("new"),
        F.coalesce("matched", F.array().cast("array<struct<i:int,j:int>>")).alias("matched"),
    )
    # The stretches between matched lines, with the matched line that ends each.
    ends = F.concat("matched", F.array(F.struct(F.size("old").alias("i"), F.size("new").alias("j"))))
    starts = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"))), F.col("matched"))
    rows = rows.withColumn("stretches", settled(F.arrays_zip(starts.alias("s"), ends.alias("e"))))

    def shown(kind: str, line: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), line.cast("int").alias("line"), value.alias("text"))

    def between(low: Column, high: Column) -> Column:
        return F.when(high - low > 1, F.sequence(low + 1, high - 1)).otherwise(F.array().cast("array<int>"))

    script = F.flatten(F.transform("stretches", lambda g: F.concat(
        F.transform(between(g["s"]["i"], g["e"]["i"]), lambda i: shown("removed", i + 1, F.get(F.col("old"), i))),
        F.transform(between(g["s"]["j"], g["e"]["j"]), lambda j: shown("added", F.lit(None), F.get(F.col("new"), j))),
        F.when(g["e"]["i"] < F.size("old"), F.array(shown("context", g["e"]["i"] + 1, F.get(F.col("old"), g["e"]["i"])))).otherwise(
            F.array().cast("array<struct<kind:string,line:int,text:string>>")
        ),
    )))
    lines = rows.select("id", F.posexplode(script).alias("p", "row"))
    in_order = Window.partitionBy("id").orderBy("p")
    change = F.when(F.col("row.kind") != "context", F.col("p"))
    last = F.max(change).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    coming = F.min(change).over(in_order.rowsBetween(0, Window.unboundedFollowing))
    near = F.coalesce(F.col("p") - last <= context, F.lit(False)) | F.coalesce(coming - F.col("p") <= context, F.lit(False))
    marked = lines.withColumns({"near": near, "last": last})
    hidden = ~F.coalesce(F.lag("near").over(in_order), F.lit(True))
    earlier = F.max(F.when(F.col("near"), F.col("p"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.array(shown("gap", F.lit(None), F.lit("")))
    out = marked.withColumn("gap_before", hidden & earlier.isNotNull()).filter("near").select(
        "id", "p", F.posexplode(F.concat(F.when(F.col("gap_before"), gap).otherwise(F.slice(gap, 1, 0)), F.array("row"))).alias("o", "row")
    )
    at = F.row_number().over(Window.partitionBy("id").orderBy("p", "o")) - 1
    return out.select(F.col("id").alias(id), at.cast("int").alias("at"), "row.*")
