"""Identity matching: direct look-up, clues, text title, manual override."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.operators import linkage
from scholia.operators.identifiers import filename_clues
from scholia.session import cut_lineage

KEY = "pdf_name"


def direct_stage(entries: DataFrame, works: DataFrame, key: str) -> DataFrame:
    """Title look-up; entries with an author are verified, others accepted."""
    titled = entries.filter(F.col("entry_class") != "C")
    found = linkage.title_candidates(titled, works, key, "json_title")
    expected = found.join(entries.select(key, "json_author"), key)
    best = linkage.pick_best(expected, works, key, F.col("json_author"))
    verified = linkage.verify_author(titled.filter(F.col("entry_class") == "A"), best, works, key)
    accepted = linkage.lookup_unverified(titled.filter(F.col("entry_class") == "B"), best, key)
    return verified.unionByName(accepted).select(
        key, "cr_doi", "cr_author", F.col("json_title").alias("final_title"), "match", "note",
        F.lit("registry").alias("source"),
    )


def text_stage(entries: DataFrame, works: DataFrame, key: str, title: str) -> DataFrame:
    """Look-up by the title read from the text of the document."""
    titled = entries.filter(F.coalesce(F.col(title), F.lit("")) != "")
    best = linkage.pick_best(linkage.title_candidates(titled, works, key, title), works, key)
    rows = entries.select(key, title).join(
        best.select(key, F.col("doi").alias("cr_doi"), F.col("first_author").alias("cr_author")), key, "left"
    )
    hit = F.col("cr_doi").isNotNull()
    note = (
        F.when(hit, F.concat(F.lit("text: found "), F.col("cr_doi")))
        .when(F.coalesce(F.col(title), F.lit("")) == "", "text: no_title")
        .otherwise("text: not_found")
    )
    return rows.select(
        key, "cr_doi", "cr_author", F.col(title).alias("final_title"), hit.alias("match"),
        note.alias("note"), F.lit("text").alias("source"),
    )


def identify(
    entries: DataFrame, works: DataFrame, key: str, text_title: str, manual: DataFrame | None = None
) -> DataFrame:
    """All stages in order, each on what the earlier ones left over.

    ``entries`` has ``pdf_name, json_title, json_author`` and the title read
    from the text.  One row per entry comes back.
    """
    kind = linkage.entry_class(F.col("json_title"), F.col("json_author"))
    entries = entries.withColumn("entry_class", kind)
    # every stage is kept, so that a later one does not repeat it
    direct = cut_lineage(direct_stage(entries, works, key))
    left = linkage.unmatched(entries, direct, key)
    clue = cut_lineage(linkage.clue_stage(filename_clues(left.select(key, KEY), KEY), works, key))
    rest = linkage.unmatched(left, direct.unionByName(clue, allowMissingColumns=True), key)
    text = text_stage(rest, works, key, text_title)
    results = linkage.cascade([direct, clue, text], key)
    if manual is not None:
        results = linkage.apply_manual(results, manual, key)
    return entries.select(key, KEY, "entry_class").join(results, key)
