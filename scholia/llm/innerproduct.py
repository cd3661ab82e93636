"""Exact search for the largest inner products of whole-number vectors.

Vectors are processed by descending length in blocks. A rotation from the singular
vectors of all rows moves most of the length into the first coordinates, so a
partial sum over those plus the Cauchy-Schwarz bound of the rest (length of one
rest times length of the other) excludes candidates, a quarter of the coordinates
at a time; the open ones are scored exactly in whole numbers. A first pass over the longest block gives every query a score that its
k-th best reaches at least; blocks whose longest vector cannot reach it are not sent to.

Defined results: vectors that are null or hold null or non-finite components take
no part; shorter vectors count as filled up with zeros; a query is compared with every
row of another id, repeated rows counting each, as in the SQL; ties go to the smaller id; fewer candidates than k give all;
scores beyond 64 bits stay at the largest or smallest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm import vectors as V
from scholia.session import cut_lineage

#: Rows of a block, as a power of two.
BLOCK_BITS = 11
EXACT = 2.0**53
LONG = (-(2**63), 2**63 - 1)


def moments(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the outer products of all rows; the driver gets width^2 sums, however many rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = V.matrix(batch.column(0), width)
            top = max(1.0, np.abs(x).max(initial=0.0))
            total += (x / top).T @ (x / top)  # directions count, so any scale does
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "s"])

    out = np.zeros(width * width)
    for cell, s in rows.select("v").mapInArrow(add, "cell long, s double").groupBy("cell").agg(F.sum("s")).collect():
        out[cell] = s
    return out.reshape(width, width)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, pair by pair, exact in 64 bits and held within them."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    big = [sum(int(x) * int(y) for x, y in zip(r, s)) for r, s in zip(a, b)]
    return np.array([min(max(x, LONG[0]), LONG[1]) for x in big], np.int64)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products of floor(scale * x) for each query."""
    rows, asked = V.finite(vectors, key, vector), V.finite(queries, key, vector)
    width = V.dimensions(rows)
    if not width:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    values, turned = np.linalg.eigh(moments(rows, width))
    turned = turned[:, np.argsort(-values)]
    step = max(1, width // 4)
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(V.matrix(batch.column(1), width) * scale)
            x = np.nan_to_num(x)  # products beyond the range of doubles stay at its ends
            yield pa.RecordBatch.from_arrays([batch.column(0), V.packed(x), pa.array(np.sqrt((x * x).sum(axis=1)))], ["id", "v", "norm"])

    def packed(df: DataFrame) -> DataFrame:
        return df.mapInArrow(pack, "id long, v binary, norm double")

    # blocks by descending length; the number in a range partition gives the block
    sorted_ = packed(rows).repartitionByRange(partitions, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    blocks = cut_lineage(sorted_.withColumn("cell", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)))
    asked = cut_lineage(packed(asked))
    # a row for each range partition: its first block, last block and greatest length
    ranges = blocks.groupBy(F.shiftright("cell", 33 - BLOCK_BITS).alias("p")).agg(F.min("cell").alias("a"), F.max("cell").alias("b"), F.max("norm").alias("top")).orderBy("p").collect()
    if not ranges:
        return blocks.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score")).limit(0)

    def scorer(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, least: np.ndarray) -> tuple:
        xr, qr = x @ turned, q @ turned
        size = np.outer(np.sqrt((q**2).sum(axis=1)), np.sqrt((x**2).sum(axis=1)))
        # what rounding may take from a bound
        slack = 1e-9 * (1 + size)
        partial, open_ = np.zeros(size.shape), ids[None, :] != query_ids[:, None]
        for start in range(0, width, step):
            to = min(width, start + step)
            partial += qr[:, start:to] @ xr[:, start:to].T
            rest = np.outer(np.sqrt((qr[:, to:] ** 2).sum(axis=1)), np.sqrt((xr[:, to:] ** 2).sum(axis=1)))
            open_ &= partial + rest + slack >= least[:, None]
            if not open_.any():
                break
        i, j = np.nonzero(open_)
        out = []
        for a in range(0, len(i), 65536):
            out.append(exact_scores(q[i[a : a + 65536]], x[j[a : a + 65536]]))
        scores = np.concatenate(out) if out else np.empty(0, np.int64)
        # the k best of each query within the block
        order = np.lexsort((ids[j], ~scores, i))
        i, j, scores = i[order], j[order], scores[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        took = place < k
        return query_ids[i[took]], ids[j[took]], scores[took]

    # first pass: the longest block is copied to as many cells as there are partitions, a query goes to one of them
    first = ranges[0]["a"]
    longest = blocks.where(F.col("cell") == first).select("id", "v").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))))
    none = asked.select(F.pmod(F.xxhash64("id"), F.lit(partitions)).cast("int").alias("cell"), "id", "v", F.lit(float("-inf")).alias("least"))
    reached = V.ranked(V.score_cells(longest, none, scorer, "long"), k, once=False).where(F.col("rank") == k).groupBy("query_id").agg(F.max("score").alias("least"))
    bounded = asked.join(reached, asked.id == reached.query_id, "left").withColumn("least", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))))
    spans = F.array(*[F.struct(F.lit(r["a"]).alias("a"), F.lit(r["b"]).alias("b"), F.lit(float(r["top"])).alias("top")) for r in ranges])
    fits = F.filter(spans, lambda s: s["top"] * F.col("norm") * (1 + 1e-9) + 1e-6 >= F.col("least"))
    sent = bounded.select("id", "v", "least", F.explode(F.flatten(F.transform(fits, lambda s: F.sequence(s["a"], s["b"])))).alias("cell"))
    return V.ranked(V.score_cells(blocks, sent, scorer, "long"), k, once=False)
