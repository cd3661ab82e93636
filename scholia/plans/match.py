"""The flagship plan: from document titles to verified DOIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import title_similarity
from scholia.operators.linkage import pick_best, title_candidates
from scholia.operators.verify import dual_channel
from scholia.session import cut_lineage


def match_status(docs: DataFrame, works: DataFrame, key: str) -> DataFrame:
    """One row per document with ``no_title, not_found, no_confidence, matched``.

    ``docs`` has ``title`` and the nullable BOOLEAN ``second_ok`` of a second
    title check.  The chosen work is the canonical record of its DOI, so its
    title is compared without another look-up.
    """
    # titles are often worked out from whole texts: once is enough
    docs = cut_lineage(docs.select(key, "title", "second_ok"))
    has_title = F.coalesce(F.col("title"), F.lit("")) != ""
    titled = docs.filter(has_title)
    best = pick_best(title_candidates(titled, works, key, "title"), works, key).select(
        key, F.col("doi").alias("_doi"), F.col("title").alias("_canonical"),
        F.col("first_author").alias("_author"), F.col("year").alias("_year"),
    )
    rows = docs.join(best, key, "left")
    known = F.coalesce(F.col("_canonical"), F.lit("")) != ""
    sim = title_similarity(F.col("title"), F.col("_canonical"))
    rows = rows.withColumn("_sim", sim).withColumn(
        "_decision", dual_channel(F.col("_sim"), F.when(known, F.col("second_ok")), known)
    )
    found = has_title & F.col("_doi").isNotNull()
    matched = found & (F.col("_decision.status") == "matched")
    rejected = found & ~matched
    return rows.select(
        key,
        F.when(has_title, F.col("title")).alias("title"),
        F.when(~has_title, "no_title").when(~found, "not_found").otherwise(F.col("_decision.status")).alias("status"),
        F.when(matched, F.col("_doi")).alias("doi"),
        F.when(matched, F.col("_author")).alias("author"),
        F.when(matched, F.col("_year")).alias("year"),
        F.when(matched, F.col("_decision.verified")).alias("verified"),
        F.when(matched, F.col("_canonical")).alias("canonical_title"),
        F.when(found, F.round("_sim", 3)).alias("title_sim"),
        F.when(matched & known, F.col("second_ok")).alias("second_ok"),
        F.when(rejected, F.col("_doi")).alias("nearest_doi"),
        F.when(rejected, F.col("_canonical")).alias("nearest_title"),
    )
