"""Scalable forms against brute force, with chunks small enough to be cut."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from scholia.functions.chunked import chunked_join, first_n, heavy_join, heavy_keys, number_rows, running_last, running_sum
from scholia.operators.candidates import set_key, similar_sets, top_overlap
from scholia.operators.ordered import rate_audit
from scholia.operators.tasks import merge_state


def _sets(rng, n, vocabulary, hot=0.6):
    """Token sets with hot tokens and many copies."""
    out = []
    for _ in range(n):
        if out and rng.random() < 0.3:
            out.append(list(rng.choice(out)))
            continue
        tokens = {f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(0, 7))}
        tokens |= {t for t in ("the", "of") if rng.random() < hot}
        out.append(sorted(tokens))
    return out


def test_top_overlap_is_exact(spark):
    rng = random.Random(1)
    for n, vocabulary in ((1, 8), (3, 25)):
        queries, items = _sets(rng, 40, vocabulary), _sets(rng, 120, vocabulary)
        named = [(f"d{i:03d}", s) for i, s in enumerate(items)]
        found = top_overlap(
            spark.createDataFrame([(q,) for q in queries], "q array<string>"),
            spark.createDataFrame(named, "item string, tokens array<string>"),
            n, small=2,
        )
        keys = spark.createDataFrame([(q,) for q in queries], "s array<string>").select("s", set_key(F.col("s")).alias("q"))
        got = defaultdict(list)
        for r in found.join(keys.distinct(), "q").orderBy("rank").collect():
            got[tuple(r["s"])].append((r["item"], r["overlap"]))
        for q in queries:
            scored = [(d, len(set(q) & set(s))) for d, s in named]
            want = sorted((x for x in scored if x[1]), key=lambda x: (-x[1], x[0]))[:n]
            assert got[tuple(q)] == want


def test_similar_sets_is_exact(spark):
    rng = random.Random(2)
    left, right = _sets(rng, 60, 10), _sets(rng, 60, 10)
    for threshold in (0.5, 0.34, 1.0):
        found = similar_sets(
            spark.createDataFrame([(s,) for s in left], "l array<string>"),
            spark.createDataFrame([(s,) for s in right], "r array<string>"), threshold,
        )
        names = spark.createDataFrame([(s,) for s in left + right], "s array<string>").distinct().select("s", set_key(F.col("s")).alias("k"))
        text = {r["k"]: tuple(r["s"]) for r in names.collect()}
        got = {(text[r["l"]], text[r["r"]]) for r in found.collect()}
        want = {
            (tuple(a), tuple(b)) for a in left for b in right
            if a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= threshold
        }
        assert got == want


def test_chunked_join_equals_join(spark):
    rng = random.Random(3)
    left = spark.createDataFrame([(rng.choice("aaab"), i) for i in range(60)], "k string, l int")
    right = spark.createDataFrame([(rng.choice("aabc"), i) for i in range(60)], "k string, r int")
    got = Counter(tuple(r) for r in chunked_join(left, right, "k", "l", "r", chunk=4).select("k", "l", "r").collect())
    assert got == Counter(tuple(r) for r in left.join(right, "k").select("k", "l", "r").collect())


def test_heavy_join_keeps_hot_rows_in_their_tasks(spark):
    # one key on 75 % of the rows, another on 10 %, NULL keys, keys of unlike integer types
    n, hot = 40_000, F.col("id") % 20
    key = F.when(hot < 15, 7).when(hot < 17, 9).when(hot < 18, None).otherwise(F.col("id")).cast("int")
    rows = spark.range(0, n, 1, 8).select("id", key.alias("k"))
    assert len(heavy_keys(rows, ["k"], 500)) == 3 and heavy_keys(rows.limit(0), ["k"], 500) == []
    few = rows.groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        for how in ("inner", "left", "left_semi", "left_anti"):
            got = heavy_join(rows, few, ["k"], how, 500)
            want = rows.join(few, "k", how)
            assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
        joined = heavy_join(rows, few, ["k"], "inner", 500)
        most = joined.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        assert most <= 2 * n / 8
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_scans_carry_over_buckets(spark):
    rng = random.Random(4)
    rows = [(k, p, rng.choice([None, f"v{p}"]), rng.randrange(-2, 3)) for k in "ab" for p in range(0, 200, 3)]
    df = spark.createDataFrame(rows, "k string, p int, v string, x int")
    bucket = F.floor(F.col("p") / 10)
    sums = {(r.k, r.p): r.s for r in running_sum(df, ["k"], ["p"], F.col("x"), bucket, "s").collect()}
    lasts = {(r.k, r.p): r.m for r in running_last(df, ["k"], "p", F.col("v"), bucket, "m").collect()}
    total, last = defaultdict(int), {}
    for k, p, v, x in rows:
        total[k] += x
        last[k] = v or last.get(k)
        assert (sums[k, p], lasts[k, p]) == (total[k], last[k])


def test_numbers_are_consecutive(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), rng.randrange(1000), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    got = [(r.n, r.a, r.b) for r in number_rows(df, [F.desc("a"), F.asc("b")], "n").orderBy("n").collect()]
    assert got == [(i, a, b) for i, (_, a, b) in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])), 1)]
    keyed = number_rows(df, ["a", "b"], "n", keys=("k",)).collect()
    for key in "xyz":
        mine = sorted((r.a, r.b, r.n) for r in keyed if r.k == key)
        assert [n for *_, n in mine] == list(range(1, len(mine) + 1))


def test_first_n(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    assert sorted(tuple(r) for r in first_n(df, ["k"], ["id"], 2).collect()) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]


def test_rate_window_bounds(spark):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:00:10"), ("u", "2024-01-01 00:00:09.999999"), ("w", "2024-01-01 00:00:05")]
    df = spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp_ntz").alias("ts"))
    got = sorted((r.k, str(r.ts), r.in_window, r.over_limit) for r in rate_audit(df, "k", "ts", 2, 10, ranges=3).collect())
    assert [(k, n, o) for k, _, n, o in got] == [("u", 2, False), ("u", 2, False), ("u", 3, True), ("u", 2, False), ("w", 1, False)]


def test_rates_of_one_key_within_a_second_are_spread(spark):
    rng = random.Random(9)
    at = [rng.randrange(1_000_000) for _ in range(3000)]
    df = spark.createDataFrame([("u", x) for x in at], "k string, x long").select("k", F.timestamp_micros("x").alias("ts"), "x")
    want = {x: sum(x - 1000000 < y <= x for y in at) for x in set(at)}
    got = rate_audit(df, "k", "ts", 2, 1, ranges=6).collect()
    assert len(got) == 3000 and all(r.in_window == want[r.x] for r in got)


def test_merging_twice_is_merging_once(spark):
    schema = "model_alias string, task_id string, status string, ts int"
    old = spark.createDataFrame([("m", "a", "failed", 1), ("m", "b", "success", 5)], schema)
    new = spark.createDataFrame([("m", "a", "success", 1), ("m", "b", "failed", 4), ("m", "c", "failed", 2)], schema)
    once = merge_state(old, new)
    twice = merge_state(once, new)
    want = {("m", "a", "success", 1), ("m", "b", "success", 5), ("m", "c", "failed", 2)}
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} == want
