"""Hard negatives by a vertical scan of whole-number vectors (branch and bound on columns).

Rows lie in blocks, held column by column. An anchor reads the columns in the order
of its own components by magnitude: those that bring most of what columns can add at once, by one
product for many anchors, as bounds refuse few rows before, then a few at a time. A partial score and the least
and greatest that the columns still unread can add (from the block's minima and
maxima) enclose every row's score, and a bitmap keeps the rows that can still matter:

* for positives, rows of the anchor's label whose upper bound reaches the k-th best
  lower bound;
* for negatives, rows of other labels whose enclosure meets the score window of some
  positive, and within a window those that reach the k-th best lower bound of the rows
  surely inside it.

What is left when all columns are read is exact. Each block gives its k best of an
anchor, Spark ranks them. Anchors are a stated set, sent to every block; a task holds
one block and a part of the anchors.

Defined results: rows with a null key or label, a null vector or null or non-finite
components take no part; shorter vectors count as filled up with zeros; a row of
the anchor's own key is not its positive; an anchor key that occurs repeatedly asks
once, by the smallest label, then vector; as positives and negatives repeated rows
count each; ties go to the smaller key; fewer rows than asked for give all; scores
beyond 64 bits stay at the largest or smallest 64-bit number; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm import vectors as V
from scholia.llm.innerproduct import EXACT, exact_scores
from scholia.session import cut_lineage

#: Rows of a block, and anchors handled at once against it.
BLOCK, PART = 4096, 256
#: Columns read between two looks at the bounds; the first look is when the enclosures are this many times narrower than unread.
STEP, NARROWER = 8, 8

Found = tuple[np.ndarray, np.ndarray]
#: An anchor's order of columns, what those from each place on add at least and at most, the columns read, and all rows' scores by them.
Begun = tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]


class Block:
    """Rows of one block, column by column, with the least and greatest value of each column."""

    def __init__(self, ids: list[int], labels: list[int], packed: list[bytes]):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        self.columns = np.ascontiguousarray(V.unpacked(packed).T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)
        self.most = np.abs(self.columns).max(initial=0.0)

    def begun(self, anchors: np.ndarray) -> list[Begun | None]:
        """The scan of each anchor up to its first look; None where sums of doubles would not be whole numbers."""
        width = anchors.shape[1]
        whole = np.abs(anchors).max(axis=1, initial=0.0) * self.most * width < EXACT
        anchors = np.where(whole[:, None], anchors, 0.0)
        order = np.argsort(-np.abs(anchors), axis=1, kind="stable")
        ends = np.take_along_axis(np.stack([anchors * self.low, anchors * self.high]), order[None], axis=2)
        rest_low, rest_high = (np.cumsum(np.pad(e, ((0, 0), (0, 1)))[:, ::-1], axis=1)[:, ::-1] for e in (ends.min(axis=0), ends.max(axis=0)))
        wide = rest_high - rest_low
        looks = np.array([*range(STEP, width, STEP), width])
        first = looks[(wide[:, looks] * NARROWER <= wide[:, :1]).argmax(axis=1)]
        read = np.zeros_like(anchors)
        np.put_along_axis(read, order, np.where(np.arange(width) < first[:, None], np.take_along_axis(anchors, order, axis=1), 0.0), axis=1)
        partial = read @ self.columns
        return [found if w else None for w, *found in zip(whole, order, rest_low, rest_high, first.tolist(), partial)]

    def scan(self, anchor: np.ndarray, alive: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], begun: Begun | None = None) -> Found:
        """Row numbers and whole-number scores of the rows that keep(lower bounds, upper bounds) leaves to the end."""
        begun = begun or self.begun(anchor[None])[0]
        if begun is None:
            # every row is scored in integers
            return alive, exact_scores(np.broadcast_to(anchor, (len(alive), len(anchor))), self.columns[:, alive].T)
        order, rest_low, rest_high, to, partial = begun
        partial = partial[alive]
        while len(alive):
            open_ = keep(partial + rest_low[to], partial + rest_high[to])
            if not open_.all():
                alive, partial = alive[open_], partial[open_]
            if to == len(order):
                break
            read = order[to : to + STEP]
            partial += anchor[read] @ self.columns[read].take(alive, axis=1)
            to += len(read)
        return alive, partial.astype(np.int64)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the k highest scores, ties to smaller ids."""
        return np.lexsort((self.ids[rows], -scores))[:k]

    def positives(self, key: int, label: int, anchor: np.ndarray, k: int, begun: Begun | None = None) -> Found:
        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return high >= kth(low, k)

        rows, scores = self.scan(anchor, np.flatnonzero((self.labels == label) & (self.ids != key)), keep, begun)
        took = self.best(rows, scores, k)
        return rows[took], scores[took]

    def negatives(self, label: int, anchor: np.ndarray, windows: np.ndarray, k: int, begun: Begun | None = None) -> Found:
        """Rows that are among the k best of at least one window (least and greatest score)."""

        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            # all enclosures are equally wide, so in the order of the lower bounds each window's rows stand together
            ordered, width = np.sort(low), high[0] - low[0]
            places = np.searchsorted(ordered, windows[:, 1] - width, "right") - k
            reach = np.where(places >= 0, ordered[np.maximum(places, 0)], -np.inf)
            open_ = np.zeros(len(low), bool)
            for least, most in joined(np.maximum(windows[:, 0], reach), windows[:, 1]):
                open_ |= (high >= least) & (low <= most)
            return open_

        rows, scores = self.scan(anchor, np.flatnonzero(self.labels != label) if len(windows) else np.empty(0, np.int64), keep, begun)
        order = self.best(rows, scores, len(rows))
        rows, scores, took = rows[order], scores[order], np.zeros(len(rows), bool)
        for least, most in windows:
            took[np.flatnonzero((scores >= least) & (scores <= most))[:k]] = True
        return rows[took], scores[took]


def joined(least: np.ndarray, most: np.ndarray) -> list[list[float]]:
    """The ranges from least to most, those that meet as one."""
    out: list[list[float]] = []
    for low, high in sorted(zip(least.tolist(), most.tolist())):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value; below everything where there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def blocks_of(rows: DataFrame, asked: DataFrame, cells: int, find: Callable[[Block, tuple, np.ndarray, Begun | None], Found]) -> DataFrame:
    """(query_id, vec_id, score) of what find gives for each asked row in each block, by the row and its vector.

    rows and asked have cell, id, label and v; asked also scores (array of longs).
    """
    both = rows.select("cell", F.lit(0).alias("asks"), "id", "label", "v", F.lit(None).cast("array<long>").alias("scores")).union(
        asked.select("cell", F.lit(1), "id", "label", "v", "scores")
    )
    # a number of its own: by their bytes few tasks would get all blocks, which are small beside the work on them
    both = both.repartition(max(1, cells), "cell").sortWithinPartitions("cell", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block, asked = None, [], None, []

        def given() -> Iterator[pa.RecordBatch]:
            nonlocal block, held
            if asked and (held or block):
                if block is None:
                    block, held = Block(*map(list, zip(*held))), []
                anchors = V.unpacked([a[2] for a in asked])
                out = [(a[0], *find(block, a, *x)) for a, *x in zip(asked, anchors, block.begun(anchors))]
                keys = np.repeat(np.array([o[0] for o in out], np.int64), [len(o[1]) for o in out])
                parts = [block.ids[np.concatenate([o[1] for o in out])], np.concatenate([o[2] for o in out])]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, *parts)], ["query_id", "vec_id", "score"])
            asked.clear()

        for batch in batches:
            for c, asks, key, label, v, scores in zip(*(x.to_pylist() for x in batch.columns)):
                if c != cell:
                    yield from given()
                    cell, held, block = c, [], None
                if asks:
                    asked.append((key, label, v, scores))
                    if len(asked) >= PART:
                        yield from given()
                else:
                    held.append((key, label, v))
        yield from given()

    return both.mapInArrow(run, "query_id long, vec_id long, score long")


def sound(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label and v (array of doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & whole)


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """Hard negatives of each positive of each anchor.

    anchors: condition on the key, written on a column named ``id``. A negative is a row
    of another label with low % to high % of the positive's score. Columns: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = sound(vectors, key, vector, label)
    known = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width, cells = known["width"] or 0, -(-known["n"] // BLOCK)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.nan_to_num(np.floor(V.matrix(batch.column(2), width) * scale))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), V.packed(x)], ["id", "label", "v"])

    def packed(df: DataFrame) -> DataFrame:
        return df.select("id", "label", "v").mapInArrow(pack, "id long, label long, v binary")

    # rows of one key spread over the blocks as any others do; the kept table fixes their places
    kept = cut_lineage(packed(rows).withColumn("cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, cells))).cast("int")))
    first = rows.where(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.*")
    asked = cut_lineage(packed(first))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(max(0, cells - 1)))).alias("cell")

    near = blocks_of(kept, asked.select("id", "label", "v", F.lit(None).cast("array<long>").alias("scores"), everywhere), cells, lambda block, a, anchor, begun: block.positives(a[0], a[1], anchor, positives, begun))
    best = cut_lineage(V.ranked(near, positives, once=False).select(F.col("query_id").alias("anchor_id"), F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = best.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))  # as many as positives at most
    sent = asked.join(scores, asked["id"] == scores["anchor_id"]).select("id", "label", "v", "scores", everywhere)

    def far(block: Block, a: tuple, anchor: np.ndarray, begun: Begun | None) -> Found:
        windows = [(-(-low * s // 100), high * s // 100) for s in a[3]]
        return block.negatives(a[1], anchor, np.array([w for w in windows if w[0] <= w[1]], np.float64).reshape(-1, 2), negatives, begun)

    found = blocks_of(kept, sent, cells, far).select(F.col("query_id").alias("anchor_id"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    wide = lambda c: F.col(c).cast("decimal(22,0)")
    within = (low * wide("positive_score") <= 100 * wide("negative_score")) & (100 * wide("negative_score") <= high * wide("positive_score"))
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = best.join(found, "anchor_id").where(within).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
