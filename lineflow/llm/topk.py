"""Exact top-k inner products over vectors in order of length.

Vectors are rotated by the right singular vectors of the whole table, which turns most of any
inner product into its first coordinates. Candidates are sorted by length, longest first, and
packed into blocks. For a query and a block, the longest candidate bounds every score by
Cauchy-Schwarz; within a block, the partial sum over the first coordinates plus the product of
the residual lengths bounds each one. What the bounds cannot exclude is scored exactly, in
integers. The first block, with the longest candidates, is scored first and gives every query
the k-th score that the other blocks have to reach.

The queries are a stated set of rows and meet all other rows in blocks. Candidate blocks lie in
strips of a few; a task holds one strip while every query block passes by, one at a time, so query
blocks move once a strip and candidate blocks once. Numbers of strips are broadcast, vectors are
not. A strip reports k rows a query at most.

Defined results: NULL vectors, vectors that hold NULL or a component that is not finite, and
rows without an id take no part. Vectors of unequal length count as padded with zeros. Rows
that repeat an id are candidates of their own, though never of a query with that id. Ties go
to the smaller id. Without queries or candidates the result is empty. Components are scaled and
floored to integers of any size, scores are exact, and a result that does not fit a long is an
error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineflow.session import written

SCALE = 256.0
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
#: Candidate blocks that a task holds at a time; a power of two, as numbers of blocks start at multiples of one.
STRIP_BLOCKS = 4
#: Share of the squared lengths that the first coordinates have to cover, on average.
COVERED = 0.7
#: Bounds are compared with this much room for rounding, relative to the lengths.
ROOM = 1e-9
#: Doubles hold every whole number up to here.
WHOLE = 2.0**53
#: Stands for every score that a long does not hold, with its sign.
LONGEST = 2**63 - 1


def integers(embedding: Column, scale: float = SCALE) -> Column:
    """Components as floor(scale * x), NULL if the vector takes no part."""
    usable = F.forall(
        embedding,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )

    def floored(x: Column) -> Column:
        # Doubles from 2**53 on are whole numbers, and a long may be too short for them.
        return F.when(F.abs(x) < WHOLE, F.floor(x).cast("double")).otherwise(x)

    return F.when(usable, F.transform(embedding, lambda x: floored(x.cast("double") * scale)))


def _gram(dims: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch["v"], dims)
            total += x.T @ x
        yield pd.DataFrame({"at": np.arange(dims * dims), "v": total.reshape(-1)})

    return run


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _pack(dims: int, size: int):
    """Blocks of ``size`` rows, in the order in which they come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows = np.zeros(0, dtype=np.int64), np.zeros((0, dims))

        def block(n: int) -> pd.DataFrame:
            part = rows[:n].astype("<f8")
            return pd.DataFrame({
                "ids": [ids[:n].astype("<i8").tobytes()], "rows": [part.tobytes()],
                "longest": [float(np.sqrt((rows[:n] ** 2).sum(1).max()))],
            })

        for batch in batches:
            ids = np.concatenate((ids, batch["id"].to_numpy(dtype=np.int64)))
            rows = np.concatenate((rows, _matrix(batch["v"], dims)))
            while len(ids) >= size:
                yield block(size)
                ids, rows = ids[size:], rows[size:]
        if len(ids):
            yield block(len(ids))

    return run


def exact_scores(rows: np.ndarray, query: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered ``rows`` and ``query``: longs, or Python integers if one
    may be longer. ``sizes`` bounds each one's sum of absolute products (Cauchy-Schwarz)."""
    if not len(rows) or sizes.max() < WHOLE:
        return (rows @ query).astype(np.int64)
    # A zero of one side may meet a component of the other that no long holds.
    short = (sizes < 2.0**62) & (np.abs(rows).max(1) < 2.0**62) & (np.abs(query).max() < 2.0**62)
    out = np.zeros(len(rows), dtype=np.int64 if short.all() else object)
    out[short] = rows[short].astype(np.int64) @ query.astype(np.int64) if short.any() else 0
    whole = [int(x) for x in query]
    for i in np.flatnonzero(~short):
        out[i] = sum(int(x) * y for x, y in zip(rows[i], whole, strict=True))
    return out


def best_first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best scores, ties to the smaller id."""
    if scores.dtype != object:
        return np.lexsort((ids, -scores))[:k]
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)


def best_of_block(
    queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray,
    rows: np.ndarray, ids: np.ndarray, rotation: np.ndarray, first: int, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of every query's best k rows that reach its floor."""
    lengths = np.sqrt((rows**2).sum(1))
    query_lengths = np.sqrt((queries**2).sum(1))
    turned, query_turned = rows @ rotation, queries @ rotation
    rest = np.sqrt((turned[:, first:] ** 2).sum(1))
    query_rest = np.sqrt((query_turned[:, first:] ** 2).sum(1))
    room = ROOM * lengths.max() * query_lengths + 1e-6
    alive = np.flatnonzero(query_lengths * lengths.max() + room >= floors)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(alive), 128):
        q = alive[at : at + 128]
        bound = query_turned[q, :first] @ turned[:, :first].T + np.outer(query_rest[q], rest)
        for i, query in enumerate(q):
            keep = np.flatnonzero(bound[i] + room[query] >= floors[query])
            keep = keep[ids[keep] != query_ids[query]]
            if not len(keep):
                continue
            # Candidates with the highest bounds give a floor that excludes most others.
            if len(keep) > 4 * k:
                top = keep[np.argpartition(-bound[i, keep], k)[: 2 * k]]
                known = np.sort(rows[top] @ queries[query])
                keep = keep[bound[i, keep] + room[query] >= known[-k]]
            scores = exact_scores(rows[keep], queries[query], query_lengths[query] * lengths[keep] * (1 + ROOM))
            order = best_first(scores, ids[keep], k)
            order = order[scores[order].astype(float) >= floors[query]]
            reached = [min(max(score, -LONGEST), LONGEST) for score in scores[order].tolist()]
            out.append((np.full(len(order), query), ids[keep[order]], np.array(reached, dtype=np.int64)))
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def top_k(
    vectors: DataFrame, is_query: Column, id: str = "vec_id", embedding: str = "embedding",
    k: int = 5, scale: float = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores among all other rows."""
    rows = vectors.select(
        F.col(id).cast("long").alias("id"), integers(F.col(embedding), scale).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    ).filter("id IS NOT NULL AND v IS NOT NULL")
    rows = written(rows)
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    empty = "query_id long, rank int, vec_id long, score long"
    if dims is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dims = max(dims, 1)  # vectors without components count as zero
    gram = np.zeros(dims * dims)
    for at, v in rows.mapInPandas(_gram(dims), "at int, v double").groupBy("at").agg(F.sum("v")).collect():
        gram[at] = v
    values, rotation = np.linalg.eigh(gram.reshape(dims, dims))
    values, rotation = np.maximum(values[::-1], 0), np.ascontiguousarray(rotation[:, ::-1])
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    first = int(min(dims, np.searchsorted(share, COVERED) + 1))

    layout = "ids binary, rows binary, longest double"
    length = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    blocks = written(
        rows.withColumn("length", length)
        .repartitionByRange(F.col("length").desc(), "id")
        .sortWithinPartitions(F.col("length").desc(), "id")
        .mapInPandas(_pack(dims, block_rows), layout)
        .withColumn("block", F.monotonically_increasing_id())
    )
    queries = written(
        rows.filter("is_query").repartitionByRange("id").sortWithinPartitions("id")
        .mapInPandas(_pack(dims, query_rows), layout)
        .withColumn("group", F.monotonically_increasing_id())
    )
    longest = blocks.agg(F.max_by("block", F.struct("longest", -F.col("block")))).first()[0]

    def best_of_strip(row, strip: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        """The best k rows of the strip for every query of a block."""
        q, q_ids = np.frombuffer(row.rows, "<f8").reshape(-1, dims), np.frombuffer(row.ids, "<i8")
        floors = np.full(len(q), -np.inf) if row.floors is None else np.frombuffer(row.floors, "<f8")
        found = [best_of_block(q, q_ids, floors, x, ids, rotation, first, k) for ids, x in strip]
        query, vec, score = (np.concatenate(part) for part in zip(*found, strict=True))
        order = np.lexsort((vec, -score, query))
        # Places within the query.
        at = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[at < k]
        return pd.DataFrame({
            "group": row.number, "query": query[order], "query_id": q_ids[query[order]], "vec_id": vec[order],
            "score": score[order],
        })

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, strip = None, []
        for batch in batches:
            for row in batch.itertuples():
                if row.cell != cell:
                    cell, strip = row.cell, []
                if row.asks:
                    yield best_of_strip(row, strip)
                else:
                    strip.append((np.frombuffer(row.ids, "<i8"), np.frombuffer(row.rows, "<f8").reshape(-1, dims)))

    def against(blocks: DataFrame, asked: DataFrame) -> DataFrame:
        """Every query block with the candidate blocks of its cell, which come before it."""
        met = blocks.select(
            "cell", F.lit(False).alias("asks"), F.col("block").alias("number"), "ids", "rows",
            F.lit(None).cast("binary").alias("floors"),
        ).unionByName(
            asked.select("cell", F.lit(True).alias("asks"), F.col("group").alias("number"), "ids", "rows", "floors")
        )
        return met.repartition("cell").sortWithinPartitions("cell", "asks", "number").mapInPandas(
            compare, "group long, query int, query_id long, vec_id long, score long"
        )

    # One block meets all queries, so every query block is a cell of its own.
    first_block = blocks.filter(F.col("block") == longest).crossJoin(
        F.broadcast(queries.select(F.col("group").alias("cell")))
    )
    unknown = queries.withColumns({"cell": F.col("group"), "floors": F.lit(None).cast("binary")})
    start = written(against(first_block, unknown))

    kth = start.groupBy("group", "query").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("floor")
    ).filter(F.col("n") >= k)
    by_group = kth.groupBy("group").agg(F.collect_list(F.struct("query", "floor")).alias("known"))

    @F.pandas_udf("binary")
    def floor_table(ids: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for q_ids, pairs in zip(ids, known, strict=True):
            table = np.full(len(q_ids) // 8, -np.inf)
            for pair in pairs if pairs is not None else ():
                table[pair["query"]] = pair["floor"]
            out.append(table.astype("<f8").tobytes())
        return pd.Series(out, dtype=object)

    informed = queries.join(by_group, "group", "left").select(
        "group", "ids", "rows", floor_table("ids", "known").alias("floors")
    )
    others = blocks.filter(F.col("block") != longest).withColumn("cell", F.col("block") - F.col("block") % STRIP_BLOCKS)
    strips = F.broadcast(others.select("cell").distinct())
    rest = against(others, informed.crossJoin(strips))
    order = Window.partitionBy("group", "query").orderBy(F.col("score").desc(), "vec_id")
    problem = F.concat(F.lit("a score of query "), F.col("query_id"), F.lit(" does not fit a long"))
    fitting = F.when(F.col("score").between(1 - LONGEST, LONGEST - 1), F.col("score")).otherwise(
        F.raise_error(problem).cast("long")
    )
    return (
        start.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", fitting.alias("score"))
    )
