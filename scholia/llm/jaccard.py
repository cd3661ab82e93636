"""Similarity join of texts on word shingles with parity sketches.

The shingles of a text (distinct runs of five words) are dealt by hash to the parts of a
sketch; a part holds the XOR of its shingles' hashes. A shingle that only one
of two texts has can change one part at most, so the number of parts that differ
is a lower bound of the symmetric difference. For texts of a size band that
difference is at most ``T`` where the Jaccard similarity reaches the threshold, so of
``T + 1 + s`` parts at least ``1 + s`` agree. Texts that agree in a part meet in
a join on (band, part, value). Empty parts say nothing and are left out, unless
a text has more than ``s`` of them: then it also brings its empty parts. A
second sketch of single bits, whose Hamming distance is the same kind of bound,
drops most false candidates; the rest are verified on the whole sets.

Texts of equal sets are one class. In each bucket every class is first compared
with the smallest (never all pairs), which joins large groups. Buckets that then
hold several components are looked at again: members outside the largest
component are sent to all chunks of the bucket and compared there on bit
sketches; a task holds the chunk's own rows while those sent stream by. Where so many
would be sent that more rows arise than keys of the bucket's sets, the bucket is divided: linked
sets also agree in a part of another sketch, with new hashes, so unlike texts that share
one shingle no longer meet. At first each sends on only its few nearest partners, which joins what is
left of large groups; a last round sends on every pair of different components
that the bound leaves open. A bucket that sent nothing on is not looked at again: components only
grow together, so it never has an open pair later. Near copies share many buckets: of buckets with the same sets one
is kept, and in the last round a pair whose sets have a bucket in common among their first
few is sent on from the smallest such bucket only. No link is lost and no group is multiplied out.

Shingles and sets are told apart by 64-bit hashes.

Defined results: null texts and texts without words have the empty set, 0
shingles and are linked with nothing; repeated rows are returned each; rows with a
null key are returned with their count and no component; an empty table gives an
empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.components import components
from scholia.llm.hashed import few, tidied
from scholia.llm.scratch import Scratch
from scholia.session import cut_lineage

WIDTH = 5
#: A link: HUNDRED * intersection >= PERCENT * union.
PERCENT = 80
#: Size bands grow by this factor, which is above 100 / PERCENT.
BAND = 1.5
#: Partners that a member of a bucket sends on in each round before the last, and the number of such rounds.
NEAREST, ROUNDS = 2, 2
#: Smallest buckets of a set that its rows carry.
FIRST = 8
#: Rows of a bucket in one chunk of the second round.
CHUNK = 1024
#: Texts handled at once in a task.
SLICE = 1024
#: Rows sent to a cell that are compared at once, and how often a bucket is divided again.
PROBES, DIVISIONS = 1024, 4
#: Home rows of a cell up to which its pairs are looked at one by one.
SMALL = 64
#: Bits of a bucket's number. Buckets that fall together only bring pairs that are then refused.
BUCKET_BITS = 48
#: Largest broadcast list of texts to verify, in rows of two numbers; a longer one is joined by shuffle.
BROADCAST_ROWS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text; A-Z count as a-z."""
    if not text:
        return np.empty(0, np.uint64)
    # only ASCII bytes are lowered or split; others are parts of words. bytes.split cuts at the same six characters
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(words, object), categorize=False)
    w = min(width, len(h))
    rolled = np.full(len(h) - w + 1, w, np.uint64)
    for i in range(w):
        rolled = rolled * _MIX + h[i : len(h) - w + 1 + i]
    rolled = mix(rolled)
    rolled.sort()
    return rolled[np.concatenate(([True], rolled[1:] != rolled[:-1]))]


def band_of(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(BAND) + 1e-9))


def parts_of(band: int, percent: int) -> tuple[int, int]:
    """Most differing shingles between texts of the band and up to the threshold's larger sizes, and the number of parts."""
    top = int(np.ceil(BAND ** (band + 1)))
    # |A ^ B| <= (1 - t) * union and union <= smaller / t
    most = (100 - percent) * top // percent
    # a text of the band has few more empty parts than an eighth; with a sixteenth a fifth of the texts brought theirs, which all met
    return most, most + 2 + most // 8


@lru_cache(maxsize=32)
def part_labels(band: int, parts: int) -> np.ndarray:
    """A number for each part of a band's sketch."""
    return mix(np.arange(parts, dtype=np.uint64) + np.uint64((band + 1) << 32))


def keys_of(marks: np.ndarray, percent: int) -> list[np.ndarray]:
    """Join keys of a set, for its own band and, where a smaller partner may be there, the band below."""
    n, out = len(marks), []
    band = band_of(n)
    lower = n * percent <= 100 * np.ceil(BAND**band)
    for at in {band, band - 1} if lower and band else {band}:
        most, parts = parts_of(at, percent)
        place = (mix(marks + np.uint64(at + 1)) % np.uint64(parts)).astype(np.int64)
        value, full = np.zeros(parts, np.uint64), np.zeros(parts, bool)
        np.bitwise_xor.at(value, place, marks)
        full[place] = True
        if np.count_nonzero(full) > most:
            out.append(mix(value[full] * _MIX + part_labels(at, parts)[full]))
        else:
            out.append(mix(value * _MIX + part_labels(at, parts)))
    return out


def digest(marks: np.ndarray) -> int:
    """64-bit name of a set."""
    return int(np.bitwise_xor.reduce(mix(marks * _MIX))) if len(marks) else 0


def bit_sketch(marks: np.ndarray) -> bytes:
    """Parity of the hashes that fall on each bit; two to four bits a hash, a power of two."""
    bits = 1 << max(6, int(len(marks)).bit_length() + 1)
    return np.packbits(np.bincount((marks % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance; the longer sketch is folded to the shorter one's bits."""
    x, y = (np.unpackbits(np.frombuffer(s, np.uint8)) for s in (a, b))
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int((x ^ y).sum())


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def sets_of(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc, n, set name and bit sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, SLICE):
            marks = [shingles(t, width) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(m) for m in marks], pa.int64()), signed(np.array([digest(m) for m in marks], np.uint64)), pa.array(map(bit_sketch, marks), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "name", "bits"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(lambda batches: tidied(run(batches)), "doc long, n long, name long, bits binary")


def meetings(docs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """Rows (bucket, name, hub) of sets that share a bucket with another set; hub is the bucket's smallest name,
    or the smallest within SLICE rows: a task sends one row of a bucket and slice, so that a hot bucket stays small."""

    mask = np.uint64((1 << BUCKET_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in few(batches, SLICE):
            names, keys = [], []
            for t in batch.column(0).to_pylist():
                marks = shingles(t, width)
                if len(marks) and (name := digest(marks)) not in seen:
                    seen.add(name)
                    found = np.concatenate(keys_of(marks, percent)) & mask
                    keys.append(found)
                    names.append(np.full(len(found), name, np.uint64))
            if len(seen) > 200_000:
                seen.clear()
            if not keys:
                continue
            key, name = np.concatenate(keys), np.concatenate(names).view(np.int64)
            order = np.lexsort((name, key))
            key, name = key[order], name[order]
            # of equal keys of one set one counts
            once = np.concatenate(([True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])))
            key, name = key[once], name[once]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            of = np.repeat(first, np.diff(np.append(first, len(key))))
            alone = of == np.arange(len(key))
            # the rows of a batch that have their hub need not meet again: they go to any task
            deal = np.where(alone, key.view(np.int64), (mix(key + np.arange(len(key), dtype=np.uint64)) & mask).view(np.int64))
            # a lone row is dealt by its bucket, which then needs no second copy
            bucket = pa.array(key.view(np.int64), mask=alone)
            hub = pa.array(name[of], pa.int64(), mask=alone)
            yield pa.RecordBatch.from_arrays([bucket, hub, pa.array(name), pa.array(deal)], ["bucket", "hub", "name", "deal"])

    # the columns that are mostly null stand together, which makes the shuffled rows pack well
    rows = docs.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(lambda batches: tidied(run(batches)), "bucket long, hub long, name long, deal long")
    least = F.min(F.when(F.col("hub").isNull(), F.col("name"))).over(Window.partitionBy("deal"))
    met = rows.withColumn("_least", least)
    return met.select(F.coalesce("bucket", "deal").alias("bucket"), "name", F.coalesce("hub", "_least").alias("hub")).where("name <> hub")


def crowded(met: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, name) of the buckets of three sets or more; two that are alone in a bucket are one star, which is compared as such."""
    ends = met.select("bucket", F.least("name", "hub").alias("a"), F.greatest("name", "hub").alias("b"))
    spread = ends.groupBy("bucket").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "ab" for f in (F.min, F.max)])
    many = spread.where("min_a <> max_a OR min_b <> max_b").select("bucket")
    # written first: a hot bucket is split in a join of two plain sides
    rows = met.join(scratch.keep(many, "many"), "bucket", "left_semi")
    members = rows.select("bucket", "name").union(rows.select("bucket", F.col("hub").alias("name"))).distinct()
    found = scratch.keep(members, "found")
    kept = scratch.keep(found.join(scratch.keep(unlike_buckets(found), "unlike"), "bucket", "left_semi"), "members")
    scratch.drop("many", "found", "unlike")
    return kept


def unlike_buckets(members: DataFrame) -> DataFrame:
    """Of the buckets that hold the same sets, told by two sums of 64-bit hashes, the smallest."""
    held = members.groupBy("bucket").agg(F.count("*").alias("k"), *[F.bit_xor(F.xxhash64("name", F.lit(i))).alias(f"x{i}") for i in (0, 1)])
    return held.groupBy("k", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket")


def with_first(members: DataFrame, one: DataFrame) -> DataFrame:
    """name, n, bits of the sets in members, and their FIRST smallest buckets as packed numbers."""
    buckets = F.slice(F.array_sort(F.collect_list("bucket")), 1, FIRST)
    packed = F.aggregate(buckets, F.lit(b""), lambda made, bucket: F.concat(made, F.unhex(F.lpad(F.hex(bucket), 16, "0"))))
    return members.groupBy("name").agg(packed.alias("first")).join(one.select("name", "n", "bits"), "name")


def is_smallest(p: tuple, h: tuple) -> bool:
    """Whether no smaller bucket than that of two rows of a cell is among the first ones of both; true where they are not known or have none in common."""
    x, y = p[7:], h[7:]
    if not x or not y or x[0] is None or y[0] is None:
        return True
    common = set(struct.unpack(f">{len(x[0]) // 8}q", x[0])).intersection(struct.unpack(f">{len(y[0]) // 8}q", y[0]))
    return not common or min(common) == p[0]


def near_sketches(pairs: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sizes and bit sketches allow a link; one: a row (name, n, bits, ..) for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())
            near = [sketch_distance(x, y) <= (100 - percent) * (n + m) // (100 + percent) for n, m, x, y in sizes]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    sides = [one.select(F.col("name").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab"]
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    met = pairs.join(sides[1], "b").join(sides[0], "a").where(fits)
    return met.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, docs: DataFrame, one: DataFrame, text: str, key: str, width: int, percent: int) -> DataFrame:
    """The (a, b) that reach the threshold on their whole sets; one: a row (name, doc, ..) for each set."""
    pairs = cut_lineage(pairs)
    asked = pairs.select(F.col("a").alias("name")).union(pairs.select(F.col("b").alias("name"))).distinct().join(one, "name")
    asked = cut_lineage(asked.select(F.col("doc").alias("_doc"), "name"))
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches, SLICE):
            names, packed = [], []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marks = shingles(t, width)
                # repeated rows of a key have texts of their own: only the one of that name counts
                if len(marks) and digest(marks) == name % 2**64:
                    names.append(name)
                    packed.append(marks.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary())], ["name", "marks"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    texts = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text")).join(asked, "_doc")
    # dealt by name once: the joins of both sides find the sets where they are
    sets = texts.select("name", "_text").mapInArrow(lambda batches: tidied(pack(batches)), "name long, marks binary").dropDuplicates(["name"])
    joined = pairs.join(sets.select(F.col("name").alias("b"), F.col("marks").alias("y")), "b").join(
        sets.select(F.col("name").alias("a"), F.col("marks").alias("x")), "a"
    )
    return joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def open_pairs(
    members: DataFrame, labels: DataFrame, one: DataFrame, held: DataFrame, percent: int, nearest: int | None, scratch: Scratch, docs: DataFrame, text: str, key: str, width: int
) -> tuple[DataFrame, DataFrame | None]:
    """(a, b) of different components that share a bucket and whose sketches allow a link; of each member the nearest, or all.
    And, but for the last round, the buckets that may have open pairs: those that sent one on, and divided ones."""
    named = members.join(labels.select(F.col("node").alias("name"), "label"), "name", "left").withColumn("label", F.coalesce("label", "name"))
    found = live = None
    for division in range(DIVISIONS + 1):
        counts = named.groupBy("bucket", "label").agg(F.count("*").alias("k"))
        main = counts.groupBy("bucket").agg(
            F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("rows"), (F.sum("k") - F.max("k")).alias("probes"), F.count("*").alias("labels")
        ).where("labels > 1")
        rows = named.join(scratch.keep(main, f"main{division}"), "bucket").join(held, "name")
        if division or nearest is not None:
            # sets that share a bucket may share no part of it; rounds that send on few pairs have no use for them
            rows = rows.withColumn("first", F.lit(None).cast("binary"))
        rows = scratch.keep(rows, f"rows{division}")
        wide = wide_buckets(rows) if division < DIVISIONS else None
        cells = cell_rows(rows if wide is None else rows.join(wide, "bucket", "left_anti"))
        if division or nearest is None:
            pairs = cut_lineage(cells.mapInArrow(lambda batches: compared(batches, percent, nearest), "a long, b long").distinct())
        else:
            told = cut_lineage(cells.mapInArrow(lambda batches: compared(batches, percent, nearest, told=True), "a long, b long, bucket long"))
            pairs, live = told.select("a", "b").distinct(), told.select("bucket")
            live = (live if wide is None else live.union(wide)).distinct()
        found = pairs if found is None else found.union(pairs)
        if wide is None:
            break
        parted = divided(rows.join(wide, "bucket", "left_semi").select("bucket", "name", "label"), division + 1, docs, one, text, key, width, percent)
        named = scratch.keep(parted, f"divided{division}")
    scratch.drop(*(f"{kind}{d}" for d in range(division + 1) for kind in ("main", "rows")), *(f"divided{d}" for d in range(division)))
    return cut_lineage(found.distinct()) if division else found, live


def still_open(members: DataFrame, live: DataFrame, round_: int, scratch: Scratch) -> DataFrame:
    """The members of the live buckets."""
    # written first: a hot bucket is split in a join of two plain sides
    kept = scratch.keep(members.join(scratch.keep(live, "live"), "bucket", "left_semi"), f"open{round_}")
    scratch.drop("live", f"open{round_ - 1}" if round_ else "members")
    return kept


def wide_buckets(rows: DataFrame) -> DataFrame | None:
    """The buckets whose rows sent to chunks are more than the keys of their sets, about n / 2 + 6 each; None if there are none."""
    least = rows.where(F.col("probes") > 6 * CHUNK).groupBy("bucket").agg(F.first("probes").alias("probes"), F.max("n").alias("n"))
    wide = cut_lineage(least.where(F.col("probes") > CHUNK * (F.col("n") / 2 + 6)).select("bucket"))
    return None if wide.isEmpty() else wide


def divided(rows: DataFrame, division: int, docs: DataFrame, one: DataFrame, text: str, key: str, width: int, percent: int) -> DataFrame:
    """(bucket, name, label) of rows in buckets of another sketch within their own; linked sets share one again."""
    asked = rows.select("name").distinct().join(one.select("name", F.col("doc").alias("_doc")), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, keys = [], []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marks = shingles(t, width)
                # repeated rows of a key have texts of their own
                if len(marks) and digest(marks) == name % 2**64:
                    # a bijection of the hashes: differences stay, parts and values are others
                    keys.append(np.unique(np.concatenate(keys_of(mix(marks + np.uint64(division) * _MIX), percent))))
                    names.append(np.full(len(keys[-1]), name, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), signed(np.concatenate(keys))], ["name", "key"])

    texts = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text")).join(asked, "_doc")
    keys = texts.select("name", "_text").mapInArrow(lambda batches: tidied(run(batches)), "name long, key long").distinct()
    return rows.join(keys, "name").select(F.xxhash64("bucket", "key").alias("bucket"), "name", "label")


def cell_rows(rows: DataFrame) -> DataFrame:
    """The rows by cell, a chunk of a bucket: first its own, then those outside the bucket's largest component, which go to all chunks."""
    chunks = F.ceil(F.col("rows") / CHUNK).cast("long")
    home = rows.withColumn("chunk", F.pmod(F.xxhash64("name"), chunks)).withColumn("probe", F.lit(False))
    probes = rows.where("label <> main").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).withColumn("probe", F.lit(True))
    cells = home.unionByName(probes).select("bucket", "chunk", "probe", "name", "label", "n", "bits", "first")
    return cells.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "probe")


def compared(batches: Iterator[pa.RecordBatch], percent: int, nearest: int | None, told: bool = False) -> Iterator[pa.RecordBatch]:
    """The open pairs of sorted cells, with their bucket if told; the own rows of one cell and PROBES others are held."""
    cell, homes, probes = None, [], []

    def pairs() -> list[tuple]:
        made = cell_pairs(homes + probes, percent, nearest)
        return [(a, b, cell[0]) for a, b in made] if told else made

    for batch in few(batches, PROBES):
        found: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != cell:
                found += pairs()
                cell, homes, probes = row[:2], [], []
            elif len(probes) >= PROBES:
                found += pairs()
                probes = []
            (probes if row[2] else homes).append(row)
            if len(found) >= 65536:
                yield pairs_batch(found, told)
                found = []
        yield pairs_batch(found, told)
    yield pairs_batch(pairs(), told)


def pairs_batch(found: list[tuple], told: bool = False) -> pa.RecordBatch:
    names = ["a", "b", "bucket"] if told else ["a", "b"]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(len(names))], names)


def cell_pairs(rows: list[tuple], percent: int, nearest: int | None = None) -> list[tuple[int, int]]:
    """Pairs of a probe and a home row of one cell that sizes and sketches leave open."""
    probes, homes = ([r for r in rows if r[2] == kind] for kind in (True, False))
    if not probes or not homes:
        return []
    if len(homes) <= SMALL:
        return small_cell_pairs(probes, homes, percent, nearest)
    least = min(len(r[6]) for r in rows)

    def bits(side: list[tuple]) -> np.ndarray:
        out = []
        for r in side:
            x = np.frombuffer(r[6], np.uint8)
            while len(x) > least:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            out.append(x)
        return np.stack(out).view(np.uint64)

    x, y = bits(probes), bits(homes)
    n, label = (np.array([r[i] for r in homes]) for i in (5, 4))
    out = []
    for i, p in enumerate(probes):
        far = np.bitwise_count(y ^ x[i]).sum(axis=1)
        near = (label != p[4]) & (far * (100 + percent) <= (100 - percent) * (n + p[5])) & (np.minimum(n, p[5]) * 100 >= np.maximum(n, p[5]) * percent)
        took = np.flatnonzero(near)
        if nearest is not None and len(took) > nearest:
            took = took[np.argsort(far[took], kind="stable")[:nearest]]
        if nearest is None:
            took = [j for j in took if is_smallest(p, homes[j])]
        out += [(min(p[3], homes[j][3]), max(p[3], homes[j][3])) for j in took]
    return out


def small_cell_pairs(probes: list[tuple], homes: list[tuple], percent: int, nearest: int | None) -> list[tuple[int, int]]:
    """The same for few home rows: labels and sizes refuse most pairs before a sketch is read."""
    out = []
    for p in probes:
        near = []
        for h in homes:
            less, more = (p[5], h[5]) if p[5] < h[5] else (h[5], p[5])
            if p[4] != h[4] and less * 100 >= more * percent:
                far = folded_distance(p[6], h[6])
                if far * (100 + percent) <= (100 - percent) * (less + more) and (nearest is not None or is_smallest(p, h)):
                    near.append((far, h[3]))
        if nearest is not None and len(near) > nearest:
            near = sorted(near, key=lambda x: x[0])[:nearest]
        out += [(min(p[3], name), max(p[3], name)) for _, name in near]
    return out


def folded_distance(a: bytes, b: bytes) -> int:
    """As sketch_distance, on whole numbers."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    y, bits = int.from_bytes(long), 8 * len(long)
    while bits > 8 * len(short):
        bits //= 2
        y = (y >> bits) ^ (y & ((1 << bits) - 1))
    return (int.from_bytes(short) ^ y).bit_count()


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """key (long), n_shingles and component_id, the smallest key that links lead to, of every row of docs."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(sets_of(docs, key, text, width), "sets")
    keyed = rows.where("n > 0 AND doc IS NOT NULL")
    one = scratch.keep(keyed.groupBy("name").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bits").alias("bits")), "one")
    rows = scratch.keep(rows.select("doc", "n", "name"), "named")
    scratch.drop("sets")
    met = scratch.keep(meetings(docs.where(F.col(key).isNotNull()), text, width, percent), "met")
    members = crowded(met, scratch)
    held = scratch.keep(with_first(members, one), "held")
    stars = met.select(F.least("name", "hub").alias("a"), F.greatest("name", "hub").alias("b")).distinct()
    links = cut_lineage(linked(near_sketches(stars, one, percent), docs, one, text, key, width, percent))
    scratch.drop("met")
    labels = cut_lineage(components(links))
    last = "members"
    for round_, nearest in enumerate([*[NEAREST] * ROUNDS, None]):
        found, live = open_pairs(members, labels, one, held, percent, nearest, scratch, docs, text, key, width)
        if found.isEmpty():
            break
        more = cut_lineage(linked(found, docs, one, text, key, width, percent))
        if not more.isEmpty():
            # a link joins two labels: only the labels' own graph is new
            old = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b")
            labels = cut_lineage(components(old.union(more)))
        if live is not None:
            members, last = still_open(members, live, round_, scratch), f"open{round_}"
    smallest = one.select("name", "doc").join(labels.select(F.col("node").alias("name"), "label"), "name", "left").withColumn("label", F.coalesce("label", "name"))
    smallest = smallest.join(smallest.groupBy("label").agg(F.min("doc").alias("component_id")), "label").select("name", "component_id")
    named = rows.join(cut_lineage(smallest), "name", "left")
    scratch.drop("one", last, "held")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    return named.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), own).alias("component_id"))
