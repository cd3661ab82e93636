"""Checks of a claimed identity against several independent sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.chunked import chunked_join
from scholia.functions.text import title_similarity
from scholia.vocab import TITLE_SIMILARITY


def dual_channel(similarity: Column, second: Column, canonical_known: Column) -> Column:
    """Struct ``status, verified`` from title similarity and a second opinion.

    ``second`` is NULL when the second opinion is unavailable.
    """
    close = similarity >= TITLE_SIMILARITY
    denied = F.coalesce(~second, F.lit(False))
    rejected = canonical_known & ~close & denied
    return F.struct(
        F.when(rejected, "no_confidence").otherwise("matched").alias("status"),
        (canonical_known & close & ~denied).alias("verified"),
    )


def best_secondary_similarity(docs: DataFrame, extractions: DataFrame) -> DataFrame:
    """Per DOI the best similarity of the title with any extracted title.

    ``docs(doi, title)`` and ``extractions(doi, title)``; equal titles of a DOI
    are compared once, and a DOI with very many titles is compared in cells.
    """
    left = docs.select("doi", "title").distinct()
    right = (
        extractions.filter(F.coalesce("title", F.lit("")) != "")
        .select("doi", F.col("title").alias("other"))
        .distinct()
    )
    similarity = title_similarity(F.col("title"), F.col("other"))
    return (
        chunked_join(left, right, "doi", "title", "other")
        .groupBy("doi", "title")
        .agg(F.max(similarity).alias("secondary_sim"))
    )


def three_way_verify(
    docs: DataFrame, works: DataFrame, bib: DataFrame | None = None, secondary: DataFrame | None = None
) -> DataFrame:
    """Compares the title found in a document with what its DOI stands for.

    ``docs(folder, doi, title)``; ``bib(doi, title)`` holds lower-cased DOIs;
    ``secondary(doi, title)`` holds extracted titles.
    """
    known = works.select(
        "doi", F.col("title").alias("canonical_title"), F.col("first_author").alias("canonical_author")
    )
    rows = docs.join(known, "doi", "left")
    if bib is not None:
        entry = bib.select(F.col("doi").alias("_key"), F.col("title").alias("_bib_title"))
        rows = rows.join(entry, F.lower(rows.doi) == F.col("_key"), "left").drop("_key")
    else:
        rows = rows.withColumn("_bib_title", F.lit(None).cast("string"))
    if secondary is not None:
        best = best_secondary_similarity(docs, secondary).withColumnRenamed("title", "_t")
        rows = rows.join(
            best.withColumnRenamed("doi", "_d"),
            (F.col("doi") == F.col("_d")) & (F.col("title").eqNullSafe(F.col("_t"))),
            "left",
        ).drop("_t", "_d")
    else:
        rows = rows.withColumn("secondary_sim", F.lit(None).cast("double"))
    ok = F.coalesce(F.col("canonical_title"), F.lit("")) != ""
    sim = title_similarity(F.col("title"), F.col("canonical_title"))
    bib_sim = F.when(
        F.coalesce(F.col("_bib_title"), F.lit("")) != "",
        title_similarity(F.col("title"), F.col("_bib_title")),
    )
    rows = rows.withColumn("_sim", sim).withColumn("_bib_sim", bib_sim)
    agreed = (
        (F.col("_sim") >= TITLE_SIMILARITY)
        & (F.col("_bib_sim").isNull() | (F.col("_bib_sim") >= TITLE_SIMILARITY))
        & (F.col("secondary_sim").isNull() | (F.col("secondary_sim") >= TITLE_SIMILARITY))
    )
    status = F.when(~ok, "cannot_verify").when(agreed, "verified").otherwise("mismatch")
    return rows.select(
        "folder",
        F.col("doi").alias("expected_doi"),
        "title",
        F.when(ok, F.col("canonical_title")).alias("canonical_title"),
        F.when(ok, F.col("canonical_author")).alias("first_author"),
        F.when(ok, F.round("_sim", 3)).otherwise(0.0).alias("title_sim"),
        F.when(ok, F.round("_bib_sim", 3)).alias("bib_sim"),
        F.when(ok, F.round("secondary_sim", 3)).alias("secondary_sim"),
        status.alias("status"),
    )
