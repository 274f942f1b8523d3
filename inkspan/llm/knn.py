"""Exact top-k inner products by a Voronoi join.

Vectors are quantised to floor(256 * x).  Each is put into the cell of its nearest
pivot.  One small aggregate holds a summary of each cell: its rows, the range of its
members' lengths along the pivot (a) and the largest part across it (r).  For a query q,
with d its product with the pivot's direction and p its part across it, every score in
the cell is at most max(a_low * d, a_high * d) + p * r.

1. Each query is solved against its own cell (and, where that has under FIRST rows, the
   cells of the highest bounds), which gives its threshold: the k-th score found there.
2. A query goes on only to the other cells whose bound reaches its threshold; their
   scores below it never leave the task.  A last ranking merges the two.

Cells are cut into blocks of BLOCK rows (small cells share one), and the queries that
reach a block into parts of QUERIES, so a very common vector fills several blocks and no
task holds more than one block and one part.  Blocks only pack rows into tasks: a query
carries the list of its cells in a block, and is multiplied with their rows alone.  Which
query reaches which block and cells is a table of ids; the driver sees one summary row per
cell.

Pivots come from a bounded sample, the rows of lowest hash of vec_id: the square root
of the number of rows, PIVOTS at most.  They steer only the pruning; results are exact
for any pivots.

Defined results: vectors that are null, or hold null or non-finite components, and
rows without vec_id take no part; shorter vectors count as padded with zeros; a
candidate with the query's own vec_id is its own row; of rows that share a vec_id
the largest vector counts, once; scores beyond 64 bits saturate; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table

PIVOTS = 4096
BLOCK = 4096
QUERIES = 2048
FIRST = 256
_EXACT = float(1 << 53)


def quantised(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * 256))


def _matrix(column, dims: int) -> np.ndarray:
    rows = list(column)
    if rows and all(len(v) == dims for v in rows):
        return np.stack(rows).astype(np.float64)
    out = np.zeros((len(rows), dims))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: float64 where sums stay below 2^53, else Python integers, saturated."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < _EXACT:
        return (q @ x.T).astype(np.int64)
    big = np.array([[int(v) for v in r] for r in q], object).dot(np.array([[int(v) for v in r] for r in x], object).T)
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _solve(k: int, dims: int):
    """The k best of a block's asked cells for each query of a part, as far as they reach the query's threshold."""

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["cell", "vec_id"])
        ids, x, out = right["vec_id"].to_numpy(), _matrix(right["v"], dims), []
        held, begin = np.unique(right["cell"].to_numpy(), return_index=True)
        spans = dict(zip(held.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(ids)], strict=True), strict=True))
        for at in range(0, len(left) if len(right) else 0, 256):
            part = left.iloc[at : at + 256]
            q, met = _matrix(part["v"], dims), np.zeros((len(part), len(ids)), bool)
            s = np.full(met.shape, -(1 << 63), np.int64)
            sizes = [len(c) for c in part["cells"]]
            who, cells = np.repeat(np.arange(len(part)), sizes), np.concatenate([np.asarray(c, np.int64) for c in part["cells"]])
            order = np.argsort(cells, kind="stable")
            asked, first = np.unique(cells[order], return_index=True)
            for cell, rows in zip(asked.tolist(), np.split(who[order], first[1:]), strict=True):
                if cell in spans:
                    lo, hi = spans[cell]
                    s[rows, lo:hi], met[rows, lo:hi] = _scores(q[rows], x[lo:hi]), True
            cut_at = np.partition(s, -min(k + 1, s.shape[1]), axis=1)[:, -min(k + 1, s.shape[1])]
            for i, (own, least) in enumerate(zip(part["vec_id"].tolist(), part["least"].tolist(), strict=True)):
                near = np.nonzero(met[i] & (s[i] >= (cut_at[i] if least is None or np.isnan(least) else max(cut_at[i], int(least)))))[0]
                near = near[ids[near] != own]
                near = near[np.lexsort((ids[near], ~s[i][near]))]
                if len(near):
                    out.append(pd.DataFrame({"query_id": own, "vec_id": ids[near[:k]], "score": s[i][near[:k]]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return solve


class Cells:
    """Directions of the pivots and summaries of their cells; blocks that the cells lie in."""

    def __init__(self, pivots: np.ndarray, rows: list, block: int) -> None:
        length = np.linalg.norm(pivots, axis=1, keepdims=True)
        self.pivots, self.directions = pivots, pivots / np.where(length > 0, length, 1)
        self.of = np.array([r["cell"] for r in rows], np.int64)
        self.rows = np.array([r["rows"] for r in rows], np.int64)
        self.low, self.high, self.across = (np.array([r[c] for r in rows], float) for c in ("low", "high", "across"))
        # neighbouring cells share blocks: they are taken in the order of the coarse pivot they are nearest to
        coarse = (pivots[self.of] @ pivots[: max(1, int(len(pivots) ** 0.5))].T).argmax(1) if len(rows) else np.zeros(0)
        self.first, self.parts, base, fill = np.zeros(len(rows), np.int32), np.ones(len(rows), np.int32), 0, 0
        for i in np.lexsort((self.of, coarse)).tolist():
            n = rows[i]["rows"]
            if fill and fill + n <= block:
                self.first[i], fill = base - 1, fill + n
                continue
            self.first[i], self.parts[i] = base, -(-n // block)
            base, fill = base + int(self.parts[i]), n if n <= block else block
        self.n_blocks = base

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest score that each cell can hold for each query."""
        d = q @ self.directions[self.of].T
        across = np.sqrt(np.maximum((q**2).sum(1)[:, None] - d**2, 0))
        size = np.linalg.norm(q, axis=1)[:, None] * (np.maximum(np.abs(self.low), np.abs(self.high)) + self.across)
        return np.maximum(self.low * d, self.high * d) + across * self.across + 1e-9 * size + 1e-6

    def by_block(self, cells: np.ndarray) -> tuple[list[int], list[list[int]]]:
        """The blocks of these cells, and which of them each holds."""
        parts = self.parts[cells]
        block = np.repeat(self.first[cells] - np.cumsum(parts) + parts, parts) + np.arange(parts.sum())
        order = np.argsort(block, kind="stable")
        blocks, at = np.unique(block[order], return_index=True)
        held = np.repeat(self.of[cells], parts)[order]
        return blocks.tolist(), [c.tolist() for c in np.split(held, at[1:])] if len(blocks) else []

    def blocks_of(self, cells: np.ndarray) -> list[int]:
        return sorted({int(b) for i in cells for b in range(self.first[i], self.first[i] + self.parts[i])})


def place(pivots: np.ndarray):
    """Adds to each vector its cell and its parts along and across the pivot."""
    length = np.linalg.norm(pivots, axis=1, keepdims=True)
    directions = pivots / np.where(length > 0, length, 1)

    def run(batches):
        for b in batches:
            m = _matrix(b["v"], pivots.shape[1])
            cell = ((pivots**2).sum(1)[None] - 2 * m @ pivots.T).argmin(1)
            along = (m * directions[cell]).sum(1)
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "asks": b["asks"], "cell": cell.astype(np.int32), "along": along, "across": np.sqrt(np.maximum((m**2).sum(1) - along**2, 0))})

    return run


def reach(cells: Cells, first: bool):
    """For each query (vec_id, v, cell, least) the cells it meets first, or the others that its threshold leaves, by block."""

    def run(batches):
        at = {int(c): i for i, c in enumerate(cells.of)}
        for whole in batches:
            for begin in range(0, len(whole), 256):
                b, found = whole.iloc[begin : begin + 256], []
                bound = cells.bounds(_matrix(b["v"], cells.pivots.shape[1]))
                for own, near, least in zip(b["cell"], bound, b["least"].astype(float).fillna(-np.inf), strict=True):
                    order = np.argsort(-np.where(np.arange(len(near)) == at[int(own)], np.inf, near), kind="stable")
                    start = order[: 1 + np.searchsorted(np.cumsum(cells.rows[order]), FIRST)]
                    found.append(cells.by_block(start if first else np.setdiff1d(np.nonzero(near >= least)[0], start)))
                yield pd.DataFrame({"vec_id": b["vec_id"], "least": b["least"], "blocks": [x for x, _ in found], "cells": [x for _, x in found]})

    return run


def _joined(asked: DataFrame, queries: DataFrame, data: DataFrame, k: int, dims: int) -> DataFrame:
    """asked: vec_id, least, blocks and the cells of each; queries: vec_id, v; data: vec_id, v, cell, block."""
    asked = cut(asked.select("vec_id", "least", F.explode(F.arrays_zip("blocks", "cells")).alias("x")).select("vec_id", "least", F.col("x.blocks").alias("block"), F.col("x.cells").alias("cells")))
    parts = cut(asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")))
    left = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).join(queries, "vec_id").select("vec_id", "v", "least", "cells", "block", "part")
    right = data.join(parts, "block").select("vec_id", "v", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(_solve(k, dims), "query_id long, vec_id long, score long")


def _placed(embeddings: DataFrame, is_query: Column, n_pivots: int | None, block: int) -> tuple[DataFrame, Cells] | None:
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fit).select(F.col("vec_id").cast("long"), quantised(F.col("embedding")).alias("v"), is_query.alias("asks"))
    vectors = cut(vectors.groupBy("vec_id").agg(F.max("v").alias("v"), F.max("asks").alias("asks")))
    facts = vectors.agg(F.max(F.size("v")).alias("dims"), F.count("*").alias("n")).first()
    if facts["dims"] is None:
        return None
    n_pivots = n_pivots or min(PIVOTS, max(16, round(facts["n"] ** 0.5)))
    sample = [r["v"] for r in vectors.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()]
    pivots = np.unique(_matrix(sample, max(facts["dims"], 1)), axis=0)
    placed = cut(vectors.mapInPandas(place(pivots), "vec_id long, v array<long>, asks boolean, cell int, along double, across double"))
    # at most n_pivots rows
    rows = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("across")).collect()
    return placed, Cells(pivots, sorted(rows, key=lambda r: r["cell"]), block)


def knn_join(embeddings: DataFrame, is_query: Column, k: int = 5, n_pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query row."""
    spark = embeddings.sparkSession
    found = _placed(embeddings, is_query, n_pivots, BLOCK)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed, cells = found
    dims = cells.pivots.shape[1]
    # at most n_pivots rows
    where = spark.createDataFrame([(int(c), int(f), int(n)) for c, f, n in zip(cells.of, cells.first, cells.parts, strict=True)], "cell int, first int, parts int")
    data = placed.join(F.broadcast(where), "cell").select("vec_id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("block"))
    queries = placed.where("asks").select("vec_id", "v", "cell")
    asked, vectors = "vec_id long, least long, blocks array<int>, cells array<array<int>>", queries.select("vec_id", "v")
    near = cut(_joined(queries.withColumn("least", F.lit(None).cast("long")).mapInPandas(reach(cells, True), asked), vectors, data, k, dims))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    near = cut(ranked(near))
    least = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    far = _joined(queries.join(least, "vec_id", "left").select("vec_id", "v", "cell", "least").mapInPandas(reach(cells, False), asked), vectors, data, k, dims)
    return ranked(near.drop("rank").unionByName(far)).select("query_id", "rank", "vec_id", "score")


def op4_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP4_SQL = """
WITH v AS (SELECT vec_id, max(list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, x.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * x.e[i])) AS bigint) AS score
      FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS integer) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
