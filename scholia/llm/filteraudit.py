"""How filters of texts interact: every order of a set of filters, audited from one mask per document.

A document has a mask of the filters it fails. What a filter removes at its place in an
order depends on that mask alone, so masks are counted per part, and all orders are
read off the counts.

The filter for repeated texts needs the smallest id of every text in the whole table.
Texts are dealt by ranges of prefixes, as long as needed to tell neighbours of a sample
apart, and each range inserts its texts into a compressed trie whose terminals hold
the smallest id. Texts arrive sorted, so branches the trie has left are
complete and are let go: a task holds one path, however many texts it gets. Before
that, each Arrow batch keeps one row of each text it holds and flags the others, so
a text that fills a third of the table arrives once per batch.

Defined results: a null text is the empty text, a null part the empty string; a row
without id is never a copy and makes none; rows of one id and text are no copies of each
other; rows count each; of repeated labels of an id any that is set counts; an empty
table has no parts and gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows looked at to place the ranges, for each range, and the most bytes of their prefixes; ranges for each shuffle partition.
SAMPLED, PREFIX, RANGES = 4, 1024, 2
#: Rows handled at once, and bytes of text above which they are divided.
ROWS, BYTES = 4096, 16 << 20

Check = Callable[[bytes, int, list[bytes], int], bool]

_CAPITALS = bytes(range(65, 91))
_NOT_CAPITALS = bytes(set(range(256)) - set(_CAPITALS))
_NOT_MARKS = bytes(set(range(256)) - set(b"#$%&*|"))

#: Filters by letter: whether a text fails, from its bytes, code points, words and number of distinct words.
CHECKS: dict[str, Check] = {
    "A": lambda text, size, words, distinct: len(words) < 200,
    "B": lambda text, size, words, distinct: 100 * distinct < 50 * len(words),
    "C": lambda text, size, words, distinct: 100 * len(text.translate(None, _NOT_CAPITALS)) > 3 * size,
    "D": lambda text, size, words, distinct: bool(text.translate(None, _NOT_MARKS)),
}


def shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, step = 0, 16
    while a[low : low + step] == b[low : low + step]:
        low, step = low + step, 2 * step
    high = min(n, low + step)
    # a and b agree before low and differ before high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Trie:
    """Compressed trie of sorted texts: the open path from the root to the text inserted last.

    A node is its label's end on the path and the smallest id of the text that ends there, if one does.
    """

    def __init__(self) -> None:
        self.text, self.ends, self.least = b"", [0], [None]

    def insert(self, text: bytes, key: int) -> int:
        """Inserts a text not smaller than the last; the smallest id at its terminal."""
        common = shared(self.text, text)
        # branches beyond the common part are complete
        while self.ends[-1] > common:
            self.ends.pop()
            self.least.pop()
        if common < len(self.text) and self.ends[-1] < common:
            self.ends.append(common)  # a label is cut in two where the texts part
            self.least.append(None)
        if len(text) > self.ends[-1]:
            self.ends.append(len(text))
            self.least.append(None)
        self.text = text
        if self.least[-1] is None or key < self.least[-1]:
            self.least[-1] = key
        return self.least[-1]


def borders(docs: DataFrame, key: str, text: str, ranges: int) -> list[bytes]:
    """Least prefixes of the ranges after the first, each as short as tells it from the text before it in a sample.

    The driver gets at most about SAMPLED prefixes of PREFIX bytes for each range. They decide on balance only.
    """
    rows = docs.count()
    share = min(1.0, SAMPLED * ranges / max(1, rows))
    prefix = F.substring(F.coalesce(F.col(text), F.lit("")).cast("binary"), 1, PREFIX).alias("p")
    # each distinct id and prefix has the same chance, however often it occurs
    picked = docs.select(F.col(key).cast("long").alias("id"), prefix).where(F.pmod(F.xxhash64("id", "p"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = sorted(picked.select("p").distinct().toArrow()["p"].to_pylist())
    cuts = [found[i * len(found) // ranges] for i in range(1, ranges)] if found else []
    before = {b: a for a, b in zip(found, found[1:])}
    return sorted({b[: shared(before[b], b) + 1] for b in cuts if b in before})


def masks(docs: DataFrame, checks: dict[str, Check] = CHECKS, copies: str = "E", key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """id, part, mask and n: the filters a document fails, one bit each in the order of their letters."""
    letters = sorted([*checks, copies])
    bits = {c: 1 << i for i, c in enumerate(letters)}
    copy = bits[copies]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lows = borders(docs, key, text, RANGES * partitions)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in divided(batches):
            sizes = pc.utf8_length(batch.column(2)).to_pylist()
            ids, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            least: dict[bytes, int] = {}
            for i, t in zip(ids, texts):
                if i is not None and i <= least.get(t, i):
                    least[t] = i
            failed: dict[bytes, int] = {}
            counts: dict[tuple, int] = {}
            for i, p, t, size in zip(ids, parts, texts, sizes):
                if (mask := failed.get(t)) is None:
                    words = t.split()
                    distinct = len(set(words))
                    mask = failed[t] = sum(bits[c] for c, check in checks.items() if check(t, size, words, distinct))
                if i is not None and i != least[t]:
                    row = (i, p, mask | copy, None)
                else:
                    row = (i, p, mask, None if i is None else t)
                counts[row] = counts.get(row, 0) + 1
            ranged = [bisect_right(lows, r[3]) if r[3] is not None else None for r in counts]
            rows = list(zip(*counts)) or [[]] * 4
            made = [pa.array(x, k) for x, k in zip((*rows, counts.values(), ranged), (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(made, ["id", "part", "mask", "text", "n", "span"])

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at, (i, t) in enumerate(zip(ids, batch.column(4).to_pylist())):
                if t is not None and i > trie.insert(t, i):
                    found[at] |= copy
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32()), batch.column(3)], ["id", "part", "mask", "n"])

    plain = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    judged = plain.mapInArrow(judge, "id long, part string, mask int, text binary, n long, span int")
    # rows already decided travel without their text and spread by id beside the ranges
    beside = -1 - F.pmod(F.xxhash64("id"), F.lit(RANGES * partitions)).cast("int")
    dealt = judged.repartition(F.coalesce(F.col("span"), beside)).sortWithinPartitions("text", "id")
    return dealt.select("id", "part", "mask", "n", "text").mapInArrow(flag, "id long, part string, mask int, n long")


def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of few rows and few bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        start, held = 0, 0
        for at, size in enumerate(pc.binary_length(batch.column(2)).to_pylist()):
            if at > start and (held + size > BYTES or at - start >= ROWS):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def audit(
    docs: DataFrame, labels: DataFrame, checks: dict[str, Check] = CHECKS, copies: str = "E", key: str = "doc_id", text: str = "text", part: str = "lang",
) -> DataFrame:
    """One row per part, order of the filters and step of the order, with what its filter does there.

    kept, removed, redundant (fails, but was removed before), unique_fails (fails this
    filter only), good_lost and toxic_lost (removed here with that label), shapley
    (removed by the filter, summed over all orders).
    """
    letters = "".join(sorted([*checks, copies]))
    if any(len(c) != 1 for c in checks) or len(set(letters)) != len(checks) + 1:
        raise ValueError("filters need distinct names of one letter")
    # ids without rows of their own (null or repeated) come together before they meet the labels
    failed = masks(docs, checks, copies, key, text, part).groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    judged = labels.select(F.col(key).cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id IS NOT NULL")
    judged = judged.groupBy("id").agg(*[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    marked = failed.join(judged, "id", "left")
    counted = marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c) for c in ("good", "toxic")])
    # at most one cell a mask: 2 to the number of filters
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.explode(F.array(*[F.lit("".join(o)) for o in permutations(letters)])).alias("filter_order")
    steps = cells.select("part", "cells", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    place = lambda c: F.instr(F.lit(letters), c) - 1
    bit = lambda c: F.expr(f"shiftleft(1, instr('{letters}', {c}) - 1)")
    before = F.aggregate(F.expr("filter(split(substring(filter_order, 1, step - 1), ''), x -> x <> '')"), F.lit(0), lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1), place(c))))
    steps = steps.withColumn("bit", bit("substring(filter_order, step, 1)")).withColumn("before", before)

    def total(of: str, when: Callable) -> Column:
        return F.aggregate(F.filter("cells", when), F.lit(0).cast("long"), lambda acc, c: acc + c[of])

    fails = lambda c: c["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda c: c["mask"].bitwiseAND(F.col("before")) != 0
    orders_n = math.factorial(len(letters))
    # a document that fails j filters is removed by each of them in one of j orders
    shapley = F.aggregate(F.filter("cells", fails), F.lit(0).cast("long"), lambda acc, c: acc + c["n"] * (F.lit(orders_n) / F.bit_count(c["mask"])).cast("long"))
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda c: ~fails(c) & ~gone(c)).alias("kept"),
        total("n", lambda c: fails(c) & ~gone(c)).alias("removed"),
        total("n", lambda c: fails(c) & gone(c)).alias("redundant"),
        total("n", lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total("good", lambda c: fails(c) & ~gone(c)).alias("good_lost"),
        total("toxic", lambda c: fails(c) & ~gone(c)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )
