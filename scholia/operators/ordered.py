"""Operators on ordered rows: captions, numbering, order-preserving distinct, rates.

All of them scan bucket by bucket, so a document or key of any length is spread
over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.chunked import running_last, running_sum
from scholia.functions.text import strip
from scholia.session import cut_lineage

SPAN = 10_000

_IMAGE = r"!\[[^\]]*?\]\(images/[^)]+\)"
_CENTERED = r"(?i:<center>\s*(?:Figure|Fig\.?|Scheme)\s+\d+[^<]*?</center>)"
# a caption ends where an image begins on its line
_LINE = r"(?:^|\n)\s*Figure\s+\d+\.(?:(?!!\[[^\]\n]*\]\(images/)[^\n]){0,500}"


def caption_markers(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, pos, kind, value)``: images and captions in reading order."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"{_IMAGE}|{_CENTERED}|{_LINE}"), F.lit(0))
    rows = df.select(key, F.posexplode(found).alias("pos", "_m"))
    m = F.col("_m")
    inner = strip(F.regexp_replace(m, r"</?center>", ""))
    centered = F.regexp_replace(inner, r"^(?i:Fig\.?\s|Scheme\s)", "Figure ")
    return rows.select(
        key, "pos",
        F.when(m.startswith("!["), "image").otherwise("caption").alias("kind"),
        F.when(m.startswith("!["), F.regexp_extract(m, r"\((images/[^)]+)\)", 1)).otherwise(centered).alias("value"),
    )


def pair_captions(markers: DataFrame, key: str, span: int = SPAN) -> DataFrame:
    """Every image with the first caption after it and before the next image."""
    image = F.when(F.col("kind") == "image", F.col("value"))
    bucket = F.floor(F.col("pos") / span)
    rows = running_last(markers, [key], "pos", image, bucket, "image")
    rows = rows.filter(F.col("image").isNotNull())
    caption = F.col("kind") == "caption"
    return rows.groupBy(key, "image").agg(
        F.min_by(F.when(caption, F.col("value")), F.when(caption, F.col("pos"))).alias("caption"),
        F.min("pos").alias("first_pos"),
    )


def renumber(df: DataFrame, keys: list[str], pos: str, name: str, start: int = 1, span: int = SPAN) -> DataFrame:
    """Consecutive numbers per key in input order."""
    bucket = F.floor(F.col(pos) / span)
    rows = running_sum(df, keys, [pos], F.lit(1), bucket, name)
    return rows.withColumn(name, F.col(name) + (start - 1))


def ordered_distinct(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Distinct trimmed non-empty values with the position of the first."""
    rows = df.withColumn(value, strip(F.col(value))).filter(F.col(value) != "")
    return rows.groupBy(*keys, value).agg(F.min(pos).alias(pos))


def rate_audit(
    events: DataFrame, key: str, ts: str, limit: int, seconds: int, ranges: int | None = None
) -> DataFrame:
    """Adds the events of the key in ``(ts - seconds, ts]`` and whether they exceed ``limit``.

    Every event counts +1 from its time on and -1 from ``seconds`` later on; the
    running sum of these steps at an event is the number of events in its
    window.  Steps at the same time are summed before the scan, which runs over
    ranges of (key, time) of about equal row counts: a key with all events is
    spread over all of them, however its times lie.
    """
    width = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)).cast("decimal(18,6)"))
    counts = events.groupBy(key, ts).agg(F.count("*").alias("_n"))
    arrive = F.struct(F.col(ts).alias("_at"), F.col("_n").alias("_step"))
    leave = F.struct((F.col(ts) + width).alias("_at"), (-F.col("_n")).alias("_step"))
    steps = counts.select(key, F.explode(F.array(arrive, leave)).alias("s")).select(key, "s.*")
    steps = steps.groupBy(key, "_at").agg(F.sum("_step").alias("_step"))
    place = [key, "_at"] if ranges is None else [ranges, key, "_at"]
    ranged = cut_lineage(steps.repartitionByRange(*place).withColumn("_range", F.spark_partition_id()))
    scanned = running_sum(ranged, [key], ["_at"], F.col("_step"), F.col("_range"), "in_window")
    windows = scanned.select(key, F.col("_at").alias(ts), "in_window")
    return events.join(windows, [key, ts], "left").withColumn("over_limit", F.col("in_window") > limit)


def with_index(df: DataFrame, keys: list[str], array: Column, pos: str, value: str) -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias(pos, value))
