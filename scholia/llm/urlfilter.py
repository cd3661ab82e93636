"""URL rules looked up through a blocked Bloom filter and an exact hash join.

A rule is a host and a path prefix with a verdict; it fits its host and all subdomains.
The canonical forms a url could be listed under (its last labels with its first
path characters, in the shapes that rules have) are looked up in a Bloom filter whose
bits for one key lie in one block of eight 32-bit words. Only possible hits go on to the
hash join with the list, which removes false positives. Of several rules the longest wins.

Every distinct host and path beginning is looked up once, so a hot host costs one
lookup. The filter is broadcast where its size, known from the number of rules, is
within ``MOST_BLOCKS``, and joined by block beyond. DataFrame functions only.

Defined results: a null url or one without ``://`` has an empty host and path, which no rule
fits; ties of length go to the smaller rule text; the smallest verdict counts of
a rule listed twice; urls that no rule fits get the default; repeated rows are
judged each; an empty list judges all by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.columns import set_aside
from scholia.session import cut_lineage

WORDS = 8
#: Keys for a block of 256 bits: 16 bits a key, about one false hit in a thousand.
KEYS_A_BLOCK = 16
#: Blocks of a filter that is broadcast: 72 bytes each.
MOST_BLOCKS = 200_000
#: Rules of a list that the exact join broadcasts.
MOST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: str) -> Column:
    rest = F.coalesce(after_scheme(F.col(url)), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str) -> Column:
    rest = F.coalesce(after_scheme(F.col(url)), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def masks(key: Column) -> list[Column]:
    """One bit of each word of a block."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1), F.pmod(F.shiftright(h, 7 * i), F.lit(32)).cast("int")) for i in range(WORDS)]


def build_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filled blocks: block and w0 .. w7."""
    bits = keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(masks(F.col(key)))])
    return bits.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def pass_filter(rows: DataFrame, key: str, built: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key may be in the filter."""
    place = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    built = built.toDF("_block", *[f"_w{i}" for i in range(WORDS)])
    if blocks <= MOST_BLOCKS:
        built = F.broadcast(built)
    met = place.join(built, "_block")
    for i, m in enumerate(masks(F.col(key))):
        met = met.where(F.col(f"_w{i}").bitwiseAND(m) != 0)
    return met.select(*rows.columns)


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict; rules: host, path, verdict."""
    urls, at, named = set_aside(urls, ["host", "path", "rule", "verdict"])
    kept, url = urls.columns, at[url]
    listed = rules.where(F.col("host").isNotNull() & (F.col("host") != "")).select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    listed = listed.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("rule", F.concat("host", "path"))
    listed = cut_lineage(listed)
    n = listed.count()
    rows = urls.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))
    if not n:
        return named(rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default)))
    # shapes of the rules: labels of the host, characters of the path; a few, whatever the list
    shapes = listed.select(F.size(F.split("host", "[.]")).alias("k"), F.length("path").alias("n")).distinct().collect()
    longest = max(s["n"] for s in shapes)
    blocks = max(1, -(-n // KEYS_A_BLOCK))
    keys = rows.select("host", F.substring("path", 1, longest).alias("start")).where("host <> ''").distinct()
    labels = F.size(F.split("host", "[.]"))
    forms = [
        F.when((labels >= s["k"]) & (F.length("start") >= s["n"]), F.concat(F.substring_index("host", ".", -s["k"]), F.substring("start", 1, s["n"])))
        for s in shapes
    ]
    asked = keys.select("host", "start", F.explode(F.array_compact(F.array(*forms))).alias("rule"))
    possible = pass_filter(asked, "rule", build_filter(listed, "rule", blocks), blocks)
    hits = possible.join(F.broadcast(listed.select("rule", "verdict")) if n <= MOST_RULES else listed.select("rule", "verdict").hint("shuffle_hash"), "rule")
    # the longest rule; of equal lengths the smallest text
    found = hits.groupBy("host", "start").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("best"))
    # written, so that both sides of the last join are plain exchanges and a hot host is split at run time
    found = cut_lineage(found.select(F.col("host").alias("_h"), "start", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("_v")))
    out = rows.join(found, (rows.host == found._h) & (F.substring("path", 1, longest) == found.start), "left")
    return named(out.select(*[rows[c] for c in kept], rows.host, rows.path, "rule", F.coalesce("_v", F.lit(default)).alias("verdict")))
