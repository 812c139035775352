"""Best-fit packing of tokenised documents into sequences.

Documents become pieces of at most the capacity. Packing works on range-sorted runs: a length
between 1 and the capacity and how many pieces have it, and likewise gaps. Each superstep sweeps
the sorted lengths, longest first, matches every run to its successor, the smallest gap that holds
it, resolves conflicts by rank (a run's first ranks win a gap run's first sequences), updates the
gaps and repeats. There are no more runs than lengths, whatever the corpus, so the sweep needs
constant memory; counting lengths, ranking pieces and placing them are distributed.

Null and empty texts are documents of the end token only. Repeated rows are packed one by one; pieces of
equal length stand in a fixed order by their ids and numbers, so ties don't matter. Texts without white
space are encoded as one unit. Columns of other names are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import by_text, hash_order, ids_and_texts, map_arrow, materialise, prefix_digits, running_total
from lodestar.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. The first piece takes what is over after full ones."""

    def work(ids: list, texts: list) -> dict:
        encode = encoder(vocabulary)
        out: dict[str, list] = {k: [] for k in PIECES.names}
        end = np.array([END_ID], "<u4").tobytes()
        for doc, text in zip(ids, texts):
            tokens = encode(text) + end
            n = len(tokens) // 4
            stop, start, k = (n - 1) % capacity + 1, 0, 0
            while start < n:
                out["doc_id"].append(doc)
                out["piece"].append(k)
                out["start"].append(start)
                out["length"].append(stop - start)
                out["ids_crc32"].append(zlib.crc32(tokens[4 * start : 4 * stop]))
                start, stop, k = stop, stop + capacity, k + 1
        return out

    spark_schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_arrow(ids_and_texts(documents), by_text(work, PIECES), spark_schema)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Match runs to gaps: (length, first rank, count, first sequence, offset) for every match.

    ``counts``: pieces by length. Gap runs hold (first sequence, count) of equal gaps.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            gap = next((g for g in sorted(gaps) if g >= length), None)
            if gap is None:  # what no gap holds opens sequences, as many pieces in each as fit
                each = capacity // length
                opened = -(-left // each)
                gap, runs = capacity, [(sequences, opened)]
                sequences += opened
            else:
                runs = gaps.pop(gap)
            while runs and left:
                first, n = runs.pop()
                won = min(n, left)
                plan.append((length, rank, won, first, capacity - gap))
                rank, left = rank + won, left - won
                if gap > length:
                    gaps.setdefault(gap - length, []).append((first, won))
                if won < n:
                    runs.append((first + won, n - won))
            if runs:
                gaps.setdefault(gap, []).extend(runs)
    return plan


def pack(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    spark = documents.sparkSession
    made = materialise(pieces(documents, vocabulary, capacity))
    return place(made, capacity, spark)


def place(made: DataFrame, capacity: int, spark) -> DataFrame:
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = np.array(sweep(counts, capacity) or np.empty((0, 5)), dtype="int64")
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = spark.sparkContext.broadcast(plan)
    ordered = made.withColumn("__order", hash_order(F.concat_ws(":", "doc_id", "piece"))).withColumn("__bucket", F.substring("__order", 1, prefix_digits(sum(counts.values())))).withColumn("__one", F.lit(1))
    ranked = running_total(ordered, ["length"], "__bucket", ["__order", "doc_id", "piece", "ids_crc32"], "__one", "rank").drop("__order", "__bucket", "__one")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        key = runs[:, 0] * (1 << 44) + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            row = runs[np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1] if len(length) else runs[:0]
            keep = [batch.column(batch.schema.get_field_index(k)) for k in PIECES.names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=[*PIECES.names, "sequence_id", "offset"])

    return map_arrow(ranked.select(*PIECES.names, F.col("rank").cast("long").alias("rank")), assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
