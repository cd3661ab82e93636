"""Putting recognised pages and chapters back together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import strip

PART = 1000


def assemble_pages(pages: DataFrame, part: int = PART, totals: DataFrame | None = None) -> DataFrame:
    """Page texts in page order, with an error block for lost and failed pages.

    ``pages(doc_id, page_idx, content, success)``.  A document comes as parts
    of ``part`` pages, so that no task has to hold a document of any length;
    the parts in order, written one after the other, are the document.
    ``totals(doc_id, total)`` names the pages of the source file; without it the
    last page that arrived counts as the last.  A page without content is lost.
    """
    size = F.lit(part)
    pages = pages.withColumn("success", F.when(F.col("content").isNotNull(), F.col("success")))
    extent = _extent(pages, totals)
    parts = extent.select(
        "doc_id", "total", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / size))).alias("part_no")
    )
    last = F.least((F.col("part_no") + 1) * size, F.col("total")) - 1
    expected = parts.select(
        "doc_id", "part_no",
        F.explode(F.sequence((F.col("part_no") * size).cast("int"), last.cast("int"))).alias("page_idx"),
    )
    rows = expected.join(pages, ["doc_id", "page_idx"], "left")
    failed = F.concat(
        F.lit("\n\n> [Error on Page "), F.col("page_idx").cast("string"), F.lit(": "),
        F.when(F.col("success").isNull(), "Missing").otherwise(F.col("content")), F.lit("]\n\n"),
    )
    text = F.when(F.col("success"), F.concat("content", F.lit("\n\n"))).otherwise(failed)
    ordered = F.array_sort(F.collect_list(F.struct("page_idx", text.alias("text"))))
    return (
        rows.groupBy("doc_id", "part_no")
        .agg(F.array_join(F.transform(ordered, lambda p: p.text), "").alias("text"), F.count("*").alias("pages"))
        .withColumn("part_no", F.col("part_no").cast("int"))
    )


def assemble_chapters(chapters: DataFrame, part: int = PART) -> DataFrame:
    """Non-blank chapters joined by a rule line, in parts of ``part`` chapters.

    ``chapters(doc_id, pos, text)``.  Every part but the first starts with the
    rule, so parts can be written one after the other.
    """
    kept = chapters.filter(strip(F.col("text")) != "").withColumn("part_no", F.floor(F.col("pos") / part).cast("int"))
    first = kept.groupBy("doc_id").agg(F.min("pos").alias("_first"))
    rows = kept.join(first, "doc_id")
    rule = F.when(F.col("pos") == F.col("_first"), "").otherwise("\n\n---\n\n")
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.concat(rule, "text").alias("text"))))
    return rows.groupBy("doc_id", "part_no").agg(
        F.array_join(F.transform(ordered, lambda p: p.text), "").alias("text")
    )


def page_completeness(pages: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Valid and expected pages per document; a page with layout tags is not valid.

    ``totals(doc_id, total)`` as in :func:`assemble_pages`.
    """
    valid = F.col("success") & ~F.contains("content", F.lit("<|ref|>"))
    received = pages.groupBy("doc_id").agg(F.count_if(valid).alias("received"))
    rows = _extent(pages, totals).join(received, "doc_id", "left")
    rows = rows.select("doc_id", F.coalesce("received", F.lit(0).cast("long")).alias("received"), F.col("total").cast("long").alias("total"))
    return rows.withColumn("done", F.col("received") == F.col("total"))


def _extent(pages: DataFrame, totals: DataFrame | None) -> DataFrame:
    if totals is not None:
        return totals.select("doc_id", F.col("total").cast("int").alias("total"))
    return pages.groupBy("doc_id").agg((F.max("page_idx") + 1).alias("total"))
