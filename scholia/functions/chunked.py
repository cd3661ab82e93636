"""Splitting hot groups so that no task ever holds a whole one.

A single key may own a large share of all rows.  The helpers here give exact
results while bounding what one task sees:

* ``chunked_join`` cuts the rows of a key on both sides into chunks and joins
  the grid of chunks, so a hot key becomes many equal cells;
* ``running_sum`` and ``running_last`` scan an ordered group bucket by bucket
  and carry the state of the earlier buckets in, so that an ordered group of
  any length is spread over many tasks;
* ``heavy_join`` joins rows with a table of one or few rows per key, such as an
  aggregate, and keeps the rows of heavy keys where they are;
* ``first_n`` keeps the n smallest rows per key, which Spark limits within each
  map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.session import cut_lineage

CHUNK = 4096
#: Hot keys of a join that are broadcast, three numbers each.
MOST_HOT = 100_000
#: Keys that ``heavy_join`` may treat as heavy, and keys its sketch tracks.
MOST_HEAVY, TRACKED = 1000, 10_000


def first_n(df: DataFrame, keys: list, order: list, n: int) -> DataFrame:
    """The first n rows of every key; the limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def _counts(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def chunked_join(
    left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str,
    left_payload: DataFrame | None = None, right_payload: DataFrame | None = None, chunk: int = CHUNK,
) -> DataFrame:
    """Inner equi-join on ``key`` whose hot keys are cut into chunk x chunk cells.

    ``left(key, left_id)`` and ``right(key, right_id)`` are narrow; wide columns
    come as payloads by id.  Only keys with more than ``chunk`` rows on a side
    are looked up, so that no other row moves for it; there is at most one such
    key for ``chunk`` rows.  Up to ``MOST_HOT`` of them are broadcast.  Beyond,
    both sides of the look-up are plain exchanges, which are split at run time.
    """
    counts = _counts(left, key, "_lc").join(_counts(right, key, "_rc"), key)
    hot = cut_lineage(
        counts.filter((F.col("_lc") > chunk) | (F.col("_rc") > chunk)).select(
            key, F.ceil(F.col("_lc") / chunk).alias("_lc"), F.ceil(F.col("_rc") / chunk).alias("_rc")
        )
    )
    few = hot.limit(MOST_HOT + 1).count() <= MOST_HOT
    one = F.lit(1).cast("long")
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n), one) - 1))
    pick = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(F.col(n), one))
    cut = lambda df: df.join(F.broadcast(hot) if few else hot, key, "left")
    lhs = cut(left).select(key, left_id, pick(left_id, "_lc").alias("_l"), copies("_rc").alias("_r"))
    rhs = cut(right).select(key, right_id, pick(right_id, "_rc").alias("_r"), copies("_lc").alias("_l"))
    if left_payload is not None:
        lhs = lhs.join(left_payload, left_id)
    if right_payload is not None:
        rhs = rhs.join(right_payload, right_id)
    return lhs.join(rhs, [key, "_l", "_r"]).drop("_l", "_r")


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k).cast("string") for k in keys])


def heavy_keys(df: DataFrame, keys: list[str], chunk: int = CHUNK) -> list[int]:
    """Hashes of keys with more than ``chunk`` rows, of the ``MOST_HEAVY`` most frequent keys.

    Found by a mergeable sketch, so each map task sends one small row.  A key
    that is left out holds less than one row in ``MOST_HEAVY``, give or take the
    sketch's error of one in ``TRACKED``, or no more than a chunk.
    """
    sketch = F.expr(f"approx_top_k(_h, {MOST_HEAVY}, {TRACKED})")
    found = df.select(_hash(keys).alias("_h")).agg(sketch.alias("top")).select(F.filter("top", lambda t: t["count"] > chunk).item).first()[0]
    return list(found or [])


def heavy_join(
    rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", chunk: int = CHUNK
) -> DataFrame:
    """``rows`` joined with ``few``, which has a bounded number of rows per key.

    An adaptive plan cannot split a hot key where ``few`` is an aggregate or a
    window result.  Here the rows of heavy keys are not shuffled at all: the part
    of ``few`` for them, at most ``MOST_HEAVY`` keys, is sent to them.  ``how`` is
    inner, left, left_semi or left_anti.  Runs one job over the keys of ``rows``.
    """
    heavy = heavy_keys(rows, keys, chunk)
    if not heavy:
        return rows.join(few, keys, how)
    hot = _hash(keys).isin(heavy)
    kept = rows.filter(hot).join(F.broadcast(few.filter(hot)), keys, how)
    return kept.unionByName(rows.filter(~hot).join(few.filter(~hot), keys, how))


def _carry(rows: DataFrame, keys: list[str], state: str, combine) -> DataFrame:
    """Adds ``_carry``, the combined ``state`` of all earlier buckets of the key.

    ``state`` is constant within a bucket, so the buckets are found without
    another shuffle of the rows.
    """
    earlier = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    buckets = rows.select(*keys, "_bucket", state).distinct()
    carried = buckets.select(*keys, "_bucket", combine(state).over(earlier).alias("_carry"))
    return rows.join(carried, [*keys, "_bucket"])


def running_sum(
    df: DataFrame, keys: list[str], order: list, value: Column, bucket: Column, name: str
) -> DataFrame:
    """Running sum of ``value`` per key in ``order``, carried across buckets.

    ``bucket`` must not decrease along ``order``.  Only one row per bucket goes
    through the window over the whole key.
    """
    inside = Window.partitionBy(*keys, "_bucket")
    so_far = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_value", value).withColumn("_bucket", bucket)
    rows = rows.withColumn("_local", F.sum("_value").over(so_far))
    rows = rows.withColumn("_total", F.sum("_value").over(inside))
    out = _carry(rows, keys, "_total", F.sum)
    out = out.withColumn(name, F.col("_local") + F.coalesce("_carry", F.lit(0)))
    return out.drop("_value", "_bucket", "_local", "_total", "_carry")


def running_last(
    df: DataFrame, keys: list[str], order: str, value: Column, bucket: Column, name: str
) -> DataFrame:
    """Latest non-null ``value`` up to each row, carried across buckets."""
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    latest = lambda c: F.last(c, ignorenulls=True)
    rows = df.withColumn("_value", value).withColumn("_bucket", bucket)
    rows = rows.withColumn("_local", latest("_value").over(so_far))
    rows = rows.withColumn("_end", latest("_value").over(whole))
    out = _carry(rows, keys, "_end", latest)
    out = out.withColumn(name, F.coalesce("_local", "_carry"))
    return out.drop("_value", "_bucket", "_local", "_end", "_carry")


def number_rows(df: DataFrame, order: list, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive numbers from 1 in a global order, optionally per key.

    The rows are range-sorted once and kept; every range is numbered on its own
    and the counts of the earlier ranges are added.  Only one row per range and
    key goes through a window.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    )
    groups = list(keys) or ["_all"]
    if not keys:
        ranged = ranged.withColumn("_all", F.lit(0))
    return running_sum(ranged, groups, order, F.lit(1), F.col("_part"), name).drop("_part", "_all")
