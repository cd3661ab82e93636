"""Vectors packed as bytes, and scoring of queries against candidates in cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def finite(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (array of doubles) of the rows with a key whose vector is not null and holds finite numbers only."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)


def dimensions(rows: DataFrame) -> int:
    """Length of the longest v; shorter vectors count as filled up with zeros."""
    return rows.agg(F.max(F.size("v"))).first()[0] or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    if len(column) and (np.diff(ends) == width).all():
        return flat[ends[0] : ends[-1]].reshape(len(column), width)
    out = np.zeros((len(column), width))
    for i in range(len(column)):
        row = flat[ends[i] : ends[i + 1]]
        out[i, : len(row)] = row
    return out


def packed(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def unpacked(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


Scorer = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def score_cells(candidates: DataFrame, queries: DataFrame, scorer: Scorer, kind: str, parts: int = 256) -> DataFrame:
    """(query_id, vec_id, score) that scorer finds in each cell; kind: type of score.

    candidates and queries have (cell, id, v) with v packed; queries also least, a bound
    their scorer may use. The candidates of a cell are held by one task, so the
    caller keeps them few; queries stream by in parts.
    scorer(ids, vectors, query_ids, query_vectors, least) gives query ids, ids, scores.
    """
    rows = candidates.select("cell", F.lit(0).alias("asks"), "id", "v", F.lit(0.0).alias("least")).union(
        queries.select("cell", F.lit(1), "id", "v", "least")
    )
    rows = rows.repartition("cell").sortWithinPartitions("cell", "asks")
    number = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, held, asked, block = None, [], [], [], None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, asked
            if asked and ids:
                block = (np.array(ids, np.int64), unpacked(held)) if block is None else block
                found = scorer(*block, np.array([a[0] for a in asked], np.int64), unpacked([a[1] for a in asked]), np.array([a[2] for a in asked]))
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], number)], ["query_id", "vec_id", "score"])
            asked = []

        for batch in batches:
            for c, asks, i, v, least in zip(*(x.to_pylist() for x in batch.columns)):
                if c != cell:
                    yield from flush()
                    cell, ids, held, block = c, [], [], None
                if asks:
                    asked.append((i, v, least))
                    if len(asked) >= parts:
                        yield from flush()
                else:
                    ids.append(i)
                    held.append(v)
        yield from flush()

    return rows.mapInArrow(run, f"query_id long, vec_id long, score {kind}")


def best(scores: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query's row but its own, ties to smaller ids; -inf is no score."""
    out: list[tuple[np.ndarray, ...]] = []
    for q, row in zip(query_ids, scores):
        open_ = np.flatnonzero((ids != q) & (row > -np.inf)) if row.dtype.kind == "f" else np.flatnonzero(ids != q)
        if len(open_) > 4 * k:
            # what ties with the k-th best stays until the ids decide
            least = np.partition(row[open_], len(open_) - k)[len(open_) - k]
            open_ = open_[row[open_] >= least]
        took = open_[np.lexsort((ids[open_], -row[open_]))[:k]]
        out.append((np.full(len(took), q), ids[took], row[took]))
    return tuple(np.concatenate(x) if out else np.empty(0) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def ranked(found: DataFrame, k: int, once: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, ties to smaller ids; once: a pair found twice counts once."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.dropDuplicates(["query_id", "vec_id"]) if once else found
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
