"""Sets against sets in cells: results, and what is moved for them."""

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scholia.functions.cells import Block, highest
from scholia.operators import linkage
from scholia.operators.candidates import similar_sets, top_overlap


def shuffled(spark, run):
    """MB that a job writes for shuffles."""
    status = spark.sparkContext._jsc.sc().statusStore()
    before = status.executorSummary("driver").totalShuffleWrite()
    out = run()
    time.sleep(1)
    return out, (status.executorSummary("driver").totalShuffleWrite() - before) / 1e6


def test_long_sets_are_not_copied_to_each_of_their_tokens(spark):
    # 300 items of 300 tokens, 0.6 MB of tokens as text; with a copy for each token it is more than 50 MB
    rng = random.Random(5)
    items = [(f"d{i:03d}", [f"w{x}" for x in rng.sample(range(1600), 300)]) for i in range(300)]
    queries = [([f"w{x}" for x in rng.sample(range(1600), 8)],) for _ in range(400)]

    def run():
        found = top_overlap(
            spark.createDataFrame(queries, "q array<string>"),
            spark.createDataFrame(items, "item string, tokens array<string>"), 3,
        )
        return found.count()

    rows, mb = shuffled(spark, run)
    assert rows == 1200
    assert mb < 6


def test_author_pairs_compare_names_once(spark, monkeypatch):
    # 300 x 300 rows of 3 x 3 names: 90,000 pairs, nine of them compared
    entries = spark.range(300).select(F.col("id").alias("e"), F.lit(1).alias("y"), F.concat(F.lit("Meyer "), (F.col("id") % 3).cast("string")).alias("json_author"))
    works = spark.range(300).select(F.col("id").alias("w"), F.lit(1).alias("y"), F.concat(F.lit("meyer"), (F.col("id") % 3).cast("string")).alias("first_author"))
    compared = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def same(a, b):
        compared.add(1)
        return a.replace(" ", "").lower() == b

    monkeypatch.setattr(linkage, "authors_match", same)
    found = linkage.author_pairs(entries, works, ["y"])
    assert found.groupBy().agg(F.count("*"), F.count_if(F.col("same_author")), F.count_if((F.col("e") % 3 == F.col("w") % 3) == F.col("same_author"))).first()[:] == (90_000, 30_000, 90_000)
    assert compared.value == 9


def test_similar_sets_do_not_move_sets_that_are_too_long(spark):
    # the long sets share a rare token each with a short one, and can not be half alike
    rng = random.Random(6)
    left = [([f"w{x}" for x in rng.sample(range(1600), 8)],) for _ in range(400)]
    right = [([f"w{x}" for x in rng.sample(range(1600), 300)],) for _ in range(300)] + left[:50]

    def run():
        found = similar_sets(spark.createDataFrame(left, "l array<string>"), spark.createDataFrame(right, "r array<string>"), 0.5)
        return found.where("similarity = 1").count(), found.count()

    # as on tables too large to be broadcast
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (same, rows), mb = shuffled(spark, run)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert same == 50 and rows >= 50
    assert mb < 6


def test_search_looks_at_few_items_for_a_query():
    # half the items hold each frequent word; what shares five of six tokens has a rare one, which 20 items hold
    rng = random.Random(8)
    common, size = [f"c{x}" for x in range(8)], 20_000
    items = [sorted(rng.sample(common, 4)) + [f"r{i % 1000}", f"s{i % 1000}"] for i in range(size)]
    queries = [items[i] for i in range(0, size, 200)]
    cell = Block(*(pa.chunked_array([pa.array(x, pa.list_(pa.string()))]) for x in (queries, items)))
    got = {i: (found.tolist(), shared.tolist()) for i, found, shared in cell.top(3, np.full(len(queries), 5))}
    for i, shared in cell.each():
        want = [x for x in highest(shared, 3).tolist() if shared[x] >= 5]
        assert got[i] == (want, shared[want].tolist())
    assert cell.looked <= 100 * len(queries)
