"""Token-overlap search: top-n items per query, and all pairs over a threshold.

Both are exact.  Copies are collapsed first (one row per distinct token set),
and shared tokens are counted in cells of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.cells import BLOCK, CELLS, Block, Kept, blocks_of, highest, in_cells
from scholia.functions.chunked import first_n
from scholia.session import cut_lineage


def set_key(tokens: Column) -> Column:
    """Short key of a token set, the same for every order of its tokens.

    It is never NULL, so a join on it adds no filter that would compute the
    tokens a second time below the join.
    """
    return F.coalesce(F.md5(F.array_join(F.sort_array(tokens), "\u0001")), F.lit(""))


def top_overlap(queries: DataFrame, items: DataFrame, n: int, small: int = BLOCK) -> DataFrame:
    """The n items sharing most tokens with each query token set.

    ``queries(q)`` and ``items(item, tokens)`` hold arrays of distinct tokens;
    the result is ``(q, item, overlap, rank)`` ordered by overlap, then item,
    where ``q`` is the :func:`set_key` of the query.

    Of items with equal token sets only the n smallest can be returned. The others
    meet the distinct queries in cells of about ``small`` items, each of which
    gives n items a query at most, and the best of those are the best of all. One block
    comes first: what the n-th item shares there is the least that counts in the others, where
    each query then looks at the few items that hold one of its rare tokens.
    """
    # the distinct queries are small next to their source and are used many times
    wanted = queries.select(set_key(F.col("q")).alias("id"), "q").groupBy("id").agg(F.any_value("q").alias("q"))
    wanted = cut_lineage(wanted.filter(F.size("q") > 0))
    sets = items.filter(F.size("tokens") > 0).select("item", "tokens", set_key(F.col("tokens")).alias("_set"))
    items = cut_lineage(first_n(sets, ["_set"], ["item"], n).drop("_set"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("t")).first()
    blocks = blocks_of(size["n"], size["t"], small)
    keys, sets = ("id", "item"), ("q", "tokens")

    def most(cell: Block, _: pa.Table) -> Kept:
        for i, shared in cell.each():
            found = highest(shared, n)
            yield i, found, shared[found]

    if blocks == 1:
        met = in_cells(wanted, items, keys, sets, most, small)
    else:
        early = F.pmod(F.xxhash64("item", F.lit(1)), F.lit(blocks)) == 0
        first = cut_lineage(in_cells(wanted, items.filter(early), keys, sets, most, small))
        least = first.groupBy("id").agg(F.when(F.count("*") >= n, F.min("shared")).otherwise(0).alias("least"))
        asked = wanted.join(least, "id", "left").select("id", "q", F.coalesce("least", F.lit(0)).alias("least"))
        rest = in_cells(
            cut_lineage(asked), items.filter(~early), keys, sets,
            lambda cell, lefts: cell.top(n, lefts["least"].to_numpy()), small, cells=CELLS,
        )
        met = first.unionByName(rest)
    w = Window.partitionBy("id").orderBy(F.desc("shared"), "item")
    best = met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    # a join with heavy keys reads it twice
    return cut_lineage(best.select(F.col("id").alias("q"), "item", F.col("shared").alias("overlap"), "rank"))


def similar_sets(left: DataFrame, right: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """All pairs of distinct token sets with Jaccard similarity >= threshold.

    ``left(l)`` and ``right(r)`` hold arrays of distinct tokens; the result is
    ``(l, r, similarity)`` of their :func:`set_key` values.  Sets of a size that no
    left set can reach the threshold with are left out; the others meet in cells.
    """
    left = cut_lineage(_distinct_sets(left, "l"))
    size = left.agg(F.min(F.size("l_tokens")).alias("least"), F.max(F.size("l_tokens")).alias("most")).first()
    least, most = (size["least"] or 0) * threshold - 1e-9, (size["most"] or 0) / threshold + 1e-9
    right = cut_lineage(_distinct_sets(right, "r").filter(F.size("r_tokens").between(least, most)))

    def alike(cell: Block, _: pa.Table) -> Kept:
        for i, shared in cell.each():
            own = int(cell.left_sizes[i])
            found = np.flatnonzero(shared >= max(1.0, own * threshold - 1e-9))
            common = shared[found].astype(np.float64)
            found = found[common / (own + cell.right_sizes[found] - common) >= threshold]
            yield i, found, shared[found]

    pairs = in_cells(left, right, ("l", "r"), ("l_tokens", "r_tokens"), alike, block)
    sizes = lambda df, side: df.select(side, F.size(f"{side}_tokens").alias(f"_{side}"))
    shared = F.col("shared").cast("double")
    pairs = pairs.join(sizes(left, "l"), "l").join(sizes(right, "r"), "r")
    return pairs.select("l", "r", (shared / (F.col("_l") + F.col("_r") - shared)).alias("similarity"))


def _distinct_sets(df: DataFrame, side: str) -> DataFrame:
    keyed = df.select(set_key(F.col(side)).alias("_id"), side).filter(F.size(side) > 0)
    return keyed.groupBy("_id").agg(F.any_value(side).alias(f"{side}_tokens")).withColumnRenamed("_id", side)
