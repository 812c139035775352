"""Exact top-k inner products by pivot-table elimination.

Vectors become whole numbers. For pivots p, the table of all distances |v - p| is computed once;
by the triangle inequality |q - v| >= max over p of | |q - p| - |v - p| |, so an inner product is at
most (|q|^2 + |v|^2 - bound^2) / 2. Candidates are evaluated in the order of that limit, in rounds,
until no limit reaches the k-th best score found: what is left can't enter the result, ties included.
A first k-th best comes from a bounded sample of candidates, so most fall at once.

Queries go round in blocks of ``QUERY_BLOCK``, which bounds what is broadcast; every block meets all
candidates, which stay where they are. A task keeps k rows per query of the block.

Rows whose id or vector is null, or whose vector holds null or non-finite components or has another
length than the queries', take no part. Repeated rows are candidates one by one; a query id that
repeats is asked once, with its first vector in sort order, and no row of that id answers it.
Ties go to the smaller id. Columns of other names are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import map_arrow, materialise

K = 20
SCALE = 64
#: Every so many ids are queries.
EVERY = 20
#: Pivots, and about how many rows, chosen by hash, the first thresholds and the pivots come from.
PIVOTS = 24
SAMPLE = 4096
QUERY_BLOCK = 20_000
#: Rows and queries that are compared at once in a task.
ROWS_AT_ONCE, QUERIES_AT_ONCE = 4096, 512
#: Candidates per query that a round evaluates.
ROUND = 64


def whole(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, the floored multiples, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where("vec_id is not null and embedding is not null").where(finite).select("vec_id", F.transform("embedding", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of that width as rows, and which rows they were."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False).astype("float64")
    if (lengths == width).all():
        start = column.offsets[0].as_py()
        return values[start : start + width * len(column)].reshape(-1, width), np.arange(len(column))
    rows = np.flatnonzero(lengths == width)
    starts = column.offsets.to_numpy()[rows]
    return values[starts[:, None] + np.arange(width)] if len(rows) else np.empty((0, width)), rows


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Far-apart pivots: each the sample's farthest vector from those before."""
    if not len(sample):
        return sample
    chosen = [int(((sample - sample.mean(0)) ** 2).sum(1).argmax())]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table of the vectors: exact squares, then roots."""
    squares = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def limits(q2: np.ndarray, q_table: np.ndarray, v2: np.ndarray, v_table: np.ndarray) -> np.ndarray:
    """The most that each inner product can be, a little above for the roots' rounding.

    A distance is wrong in proportion to the pivot's own norm too, which may be far above the vectors'.
    """
    gap = np.zeros((len(q2), len(v2)))
    for p in range(q_table.shape[1]):
        own = np.abs(q_table[:, p, None] - v_table[None, :, p])
        own -= 1e-10 * q_table[:, p, None]
        np.maximum(gap, own, out=gap)
    total = q2[:, None] + v2[None, :]
    gap = np.maximum(gap - 1e-5 * (1 + np.sqrt(total)), 0)
    return (total - gap * gap) / 2 + 1e-5 * total + 1


class Best:
    """Per query the k best (score, id) so far, and the least score that can still enter."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.floor, self.k = ids, floor.astype("float64"), k
        self.query = np.empty(0, "int64")
        self.other = np.empty(0, "int64")
        self.score = np.empty(0, "int64")

    def add(self, query: np.ndarray, other: np.ndarray, score: np.ndarray) -> None:
        """Merge rows (query numbers) and keep k of each query."""
        if not len(query):
            return
        query, other, score = (np.concatenate(x) for x in ((self.query, query), (self.other, other), (self.score, score)))
        order = np.lexsort((other, -score, query))
        query, other, score = query[order], other[order], score[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        kept = rank < self.k
        last = rank == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        self.query, self.other, self.score = query[kept], other[kept], score[kept]


def evaluate(best: Best, at: int, queries: np.ndarray, q_table: np.ndarray, ids: np.ndarray, vectors: np.ndarray, v_table: np.ndarray) -> None:
    """One block of queries, numbered from ``at``, against one block of candidates."""
    limit = limits((queries**2).sum(1), q_table, (vectors**2).sum(1), v_table)
    own = best.ids[at : at + len(queries), None] == ids[None, :]
    limit[own] = np.nan  # neither its own candidate nor, later, twice one
    while True:
        open_ = limit >= best.floor[at : at + len(queries), None]
        counts = open_.sum(1)
        if not counts.any():
            return
        rows = np.flatnonzero(counts)
        if counts[rows].mean() > len(ids) / 8 or counts.max() <= ROUND:  # few fall, or few are left: all at once
            q, c = np.nonzero(open_)
            score = (queries[rows] @ vectors.T)[np.searchsorted(rows, q), c] if len(q) > 4 * len(ids) else np.einsum("ij,ij->i", queries[q], vectors[c])
            limit[open_] = np.nan
        else:  # the highest limits first
            top = np.argpartition(-limit[rows], ROUND - 1, axis=1)[:, :ROUND]  # NaN sorts last
            q, c = np.repeat(rows, ROUND), top.ravel()
            use = open_[q, c]
            q, c = q[use], c[use]
            score = np.einsum("ij,ij->i", queries[q], vectors[c])
            limit[q, c] = np.nan
        enter = score >= best.floor[q + at]
        best.add(q[enter] + at, ids[c[enter]], score[enter].astype("int64"))


def search(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query, both with columns vec_id and v."""
    spark = candidates.sparkSession
    asked = materialise(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    every = max(1, candidates.count() // SAMPLE)
    sample = candidates.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(every)) == 0).limit(4 * SAMPLE).collect()  # about SAMPLE rows
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    number = F.pmod(F.xxhash64(F.col("vec_id"), F.lit(7)), F.lit(blocks))
    found = [block_search(candidates, asked.where(number == b) if blocks > 1 else asked, sample, k) for b in range(blocks)]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if blocks > 1:
        found = [materialise(x) for x in found]
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def block_search(candidates: DataFrame, asked: DataFrame, sample: list, k: int) -> DataFrame:
    rows = asked.orderBy("vec_id").collect()  # about QUERY_BLOCK rows
    schema = "query_id long, vec_id long, score long"
    if not rows or not sample:
        return candidates.sparkSession.createDataFrame([], schema)
    width = len(rows[0]["v"])
    rows = [r for r in rows if len(r["v"]) == width]
    ids, vectors = np.array([r["vec_id"] for r in rows], "int64"), np.array([r["v"] for r in rows], "float64").reshape(len(rows), width)
    first = [r for r in sample if len(r["v"]) == width]
    seen_ids, seen = np.array([r["vec_id"] for r in first], "int64"), np.array([r["v"] for r in first], "float64").reshape(len(first), width)
    pivots = choose_pivots(seen, PIVOTS)
    table = distances(vectors, pivots)
    floor = np.full(len(ids), -np.inf)
    for at in range(0, len(ids), QUERIES_AT_ONCE):  # the k-th best of the sample is a first threshold
        scores = vectors[at : at + QUERIES_AT_ONCE] @ seen.T
        scores[ids[at : at + QUERIES_AT_ONCE, None] == seen_ids[None, :]] = -np.inf
        if scores.shape[1] >= k:
            floor[at : at + QUERIES_AT_ONCE] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    shared = candidates.sparkSession.sparkContext.broadcast((ids, vectors, table, pivots, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, table, pivots, floor = shared.value
        best = Best(ids, floor.copy(), k)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                block, used = matrix(part.column(1), vectors.shape[1])
                own, block_table = part.column(0).to_numpy()[used], distances(block, pivots)
                for at in range(0, len(ids), QUERIES_AT_ONCE):
                    evaluate(best, at, vectors[at : at + QUERIES_AT_ONCE], table[at : at + QUERIES_AT_ONCE], own, block, block_table)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.other), pa.array(best.score)], names=["query_id", "vec_id", "score"])

    return map_arrow(candidates, run, schema)


def every(ids: Column, n: int = EVERY) -> Column:
    return ids % n == 0


def top(embeddings: DataFrame, k: int = K) -> DataFrame:
    vectors = whole(embeddings)
    return search(vectors, vectors.where(every(F.col("vec_id"))), k)
