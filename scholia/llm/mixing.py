"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised. The
exponent is found by bisection: the least that keeps the number of passes over
any source within a limit, or the one whose weights have a wanted entropy. The
weights are realised as passes over blocks of rows. Every pass is a permutation
of a source's blocks and of the rows in a block; the last, partial pass takes blocks in
its order up to the token budget, the block on the edge row by row. With the
default budget every row is used once at least: the largest source has one pass.

Sources are a bounded list (their totals are the driver's only data; more than
``MOST_SOURCES`` raise an error). A source of any size is cut into ``BLOCKS`` blocks, so no
task holds a whole source.

Defined results: a null source is a source of its own; null and empty texts have no
tokens and go with the whole passes; rows of equal order keep the order of their
key; an empty table stays empty; columns of the input stay as they are, clashing
ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.columns import set_aside
from scholia.session import cut_lineage

BLOCKS = 512
MOST_SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    """Runs between blanks, as tokens; 0 for null and empty texts."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "[ \n\t\r\f\x0b]")
    return F.size(F.array_remove(parts, "")).cast("long")


def weights_at(shares: list[float], exponent: float) -> list[float]:
    """Normalised powers of the shares; a source without tokens has no weight."""
    top = max(shares)
    raised = [(s / top) ** exponent if s > 0 else 0.0 for s in shares]
    total = sum(raised)
    return [x / total for x in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def find_exponent(shares: list[float], most_passes: float | None = None, target_entropy: float | None = None, steps: int = 60) -> float:
    """Exponent from 0 (equal weights) to 1 (natural shares), by bisection.

    target_entropy: the exponent whose weights have it, or the nearer end.
    most_passes: the least exponent that needs no more passes over any source
    when the budget gives the largest source one pass. With both, the larger exponent.
    """

    def least(fits) -> float:
        low, high = 0.0, 1.0
        if fits(0.0):
            return 0.0
        for _ in range(steps):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) else (middle, high)
        return high

    held = [s for s in shares if s > 0]
    if not held:
        return 1.0
    ends = []
    if most_passes is not None:
        top, small = max(held), min(held)
        ends.append(least(lambda e: (small / top) ** (e - 1) <= most_passes))
    if target_entropy is not None:
        ends.append(least(lambda e: entropy(weights_at(held, e)) <= target_entropy))
    return max(ends, default=1.0)


def mix_sources(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", most_passes: float | None = 2.0,
    target_entropy: float | None = None, budget: int | None = None, seed: int = 7,
) -> DataFrame:
    """docs as they are drawn: a row for each use, with tokens, mix_weight, mix_pass (from 0) and mix_order (from 0 to 1 within a pass)."""
    docs, at, renamed = set_aside(docs, ["tokens", "mix_weight", "mix_pass", "mix_order"])
    kept, key, source, text = docs.columns, at[key], at[source], at[text]
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    # rows of a block: by key and text, so that a hot key is no hot block
    rows = docs.select(*kept, word_count(text).alias("tokens"), named.alias("_s"), F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), F.lit(BLOCKS)).alias("_b"))
    # the map tasks add up each block: sources x BLOCKS small rows
    blocks = cut_lineage(rows.groupBy("_s", "_b").agg(F.sum("tokens").alias("n"), F.count("*").alias("rows")))
    totals = [(r["_s"], r["n"]) for r in blocks.groupBy("_s").agg(F.sum("n").alias("n")).orderBy("_s").limit(MOST_SOURCES + 1).collect()]
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    total = sum(n for _, n in totals)
    if not total:
        return renamed(docs.select(*kept, F.lit(0).cast("long").alias("tokens"), F.lit(0.0).alias("mix_weight"), F.lit(0).alias("mix_pass"), F.lit(0.0).alias("mix_order")))
    shares = [n / total for _, n in totals]
    weights = weights_at(shares, find_exponent(shares, most_passes, target_entropy))
    whole = budget if budget is not None else max(n / w for (_, n), w in zip(totals, weights) if w)
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(s, w, *((int(p), int(round((p - int(p)) * n))) if n else (1, 0))) for (s, n), w in zip(totals, weights) for p in [round(whole * w / n, 9) if n else 1.0]],
        "_s string, mix_weight double, _full int, _rest long",
    )

    # the partial pass: blocks in its order as long as they fit, the next one in part
    def order(*of: str) -> Column:
        return F.xxhash64(F.lit(seed), *of)

    turn = blocks.join(F.broadcast(plan), "_s").withColumn("_o", order("_s", "_b", "_full"))
    before = F.sum("n").over(Window.partitionBy("_s").orderBy("_o", "_b").rowsBetween(Window.unboundedPreceding, -1))
    turn = turn.withColumn("_left", F.col("_rest") - F.coalesce(before, F.lit(0)))
    share = F.when(F.col("_left") >= F.col("n"), F.lit("all")).when(F.col("_left") > 0, F.lit("part")).otherwise(F.lit("none"))
    turn = turn.select("_s", "_b", "mix_weight", "_full", "_left", F.when(F.col("_rest") > 0, share).otherwise(F.lit("none")).alias("_take"))
    # at most MOST_SOURCES x BLOCKS rows; broadcast below a million, joined by shuffle beyond
    small = len(totals) * BLOCKS <= 1_000_000
    drawn = rows.join(F.broadcast(turn) if small else turn, ["_s", "_b"])
    drawn = drawn.withColumn("_r", F.xxhash64(F.lit(seed), F.col(key), F.col(text)))
    # blocks on the edge, one of each source: rows in order while tokens are left
    edge = drawn.where("_take = 'part'")
    run = F.sum("tokens").over(Window.partitionBy("_s").orderBy("_r", key, text).rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("_in", run <= F.col("_left"))
    drawn = drawn.where("_take <> 'part'").withColumn("_in", F.col("_take") == "all").unionByName(edge)
    passes = F.sequence(F.lit(0), F.col("_full") - F.when(F.col("_in"), F.lit(0)).otherwise(F.lit(1)))
    used = F.when(F.col("_full") - F.when(F.col("_in"), F.lit(0)).otherwise(F.lit(1)) >= 0, passes).otherwise(F.array().cast("array<int>"))
    out = drawn.withColumn("mix_pass", F.explode(used))
    # place in the pass: the block's turn, then the row's turn within the block
    spread = lambda c: (F.pmod(c, F.lit(1 << 24)) / (1 << 24))
    place = spread(order("_s", "_b", "mix_pass")) + spread(F.xxhash64(F.lit(seed), F.col(key), F.col("mix_pass"))) / (1 << 24)
    return renamed(out.withColumn("mix_order", place))
