"""Queries on file names, DOIs, titles and author names."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions.names import authors_match, compose
from scholia.operators import linkage as link
from scholia.functions.text import title_similarity
from scholia.operators import identifiers as ids
from scholia.operators.linkage import confidence_band, entry_class
from scholia.queries import duck, query


@query("q_identifier_classes", "f_entries", r"""
SELECT CASE WHEN regexp_matches(pdf_name, '^10[._][0-9]{4,}') THEN 'doi'
            WHEN starts_with(pdf_name, '1-s2.0-') AND ends_with(lower(pdf_name), '.pdf') THEN 'publisher'
            ELSE 'other' END AS name_class, count(*) AS files
FROM f_entries GROUP BY 1""")
def identifier_classes(t):
    return ids.identifier_counts(t("f_entries"), "pdf_name")


@query("q_identifier_details", "f_entries", r"""
WITH p AS (SELECT pdf_name, regexp_extract(pdf_name, '^1-s2\.0-(S[0-9]+)', 1) AS pii FROM f_entries),
d AS (SELECT *, regexp_extract(pii, '^S([0-9]{8})([0-9]{2})([0-9]{5,6})', 1) AS issn,
        regexp_extract(pii, '^S([0-9]{8})([0-9]{2})([0-9]{5,6})', 2) AS yy,
        regexp_extract(pii, '^S([0-9]{8})([0-9]{2})([0-9]{5,6})', 3) AS seq FROM p)
SELECT pdf_name, pii, issn, CASE WHEN issn <> '' THEN '20' || yy ELSE '' END AS pub_year, seq,
  regexp_matches(pdf_name, '^10[._][0-9]{4,}') AS is_doi_pdf,
  starts_with(pdf_name, '1-s2.0-') AND ends_with(lower(pdf_name), '.pdf') AS is_publisher_pii,
  CASE WHEN pii = '' THEN pdf_name || ': not a publisher item name'
       WHEN issn = '' THEN 'PII: ' || pii || ' (malformed)'
       ELSE 'PII: ' || pii || ' | ISSN: ' || issn || ' | year: 20' || yy || ' | item: ' || seq || ' | DOI by title look-up' END AS description
FROM d""")
def identifier_details(t):
    return ids.classify_identifiers(t("f_entries").select("pdf_name"), "pdf_name").drop("name_class")


@query("q_doi_roundtrip", "f_works", r"""
WITH d AS (SELECT CASE WHEN doc_id % 4 = 0 THEN replace(doi, '.', '_') ELSE doi END AS doi FROM f_works)
SELECT doi, replace(doi, '/', '_') AS file_name, regexp_replace(replace(doi, '/', '_'), '_', '/') AS restored
FROM d WHERE regexp_replace(replace(doi, '/', '_'), '_', '/') <> doi""")
def doi_roundtrip(t):
    odd = F.when(F.col("doc_id") % 4 == 0, F.replace("doi", F.lit("."), F.lit("_"))).otherwise(F.col("doi"))
    return ids.doi_round_trip(t("f_works").select(odd.alias("doi")), "doi")


@query("q_safe_titles", "f_doc_titles", r"""
SELECT doc_id, substring(regexp_replace(title, '[\\/:*?"<>|]', '_', 'g'), 1, 200) AS file_name FROM f_doc_titles""")
def safe_titles(t):
    return t("f_doc_titles").select("doc_id", ids.safe_title(F.col("title")).alias("file_name"))


@query("q_fold_supplements", "f_works", r"""
WITH d AS (SELECT doi FROM f_works UNION ALL SELECT doi || '.s001' FROM f_works WHERE doc_id % 17 = 0)
SELECT regexp_replace(doi, '\.s[0-9]{3,}$', '') AS base_doi, count(*) AS "rows",
       count(*) FILTER (WHERE regexp_matches(doi, '\.s[0-9]{3,}$')) AS supplements FROM d GROUP BY 1""")
def fold_supplements(t):
    works = t("f_works")
    extra = works.filter(F.col("doc_id") % 17 == 0).select(F.concat("doi", F.lit(".s001")).alias("doi"))
    return ids.fold_supplements(works.select("doi").unionByName(extra), "doi")


@query("q_filename_clues", "f_filenames", f"""
WITH {duck.clues("f_filenames", "o_orderkey").strip()}
SELECT o_orderkey, author, year, array_to_string(keywords, ' ') AS keywords, segments,
  round(CASE WHEN year IS NULL THEN 0 ELSE 0.3 END + CASE WHEN author = '' THEN 0 ELSE 0.3 END
   + CASE WHEN year IS NOT NULL AND segments >= 3 THEN 0.2 ELSE 0 END + CASE WHEN segments >= 2 THEN 0.2 ELSE 0 END, 2)::DOUBLE AS confidence
FROM clue""")
def filename_clues(t):
    clues = ids.filename_clues(t("f_filenames"), "pdf_name")
    return clues.select(
        "o_orderkey", "author", "year", F.concat_ws(" ", "keywords").alias("keywords"),
        F.size("segments").alias("segments"), "confidence",
    )


@query("q_entry_class", "f_entries", r"""
SELECT CASE WHEN json_title <> '' AND json_author <> '' THEN 'A' WHEN json_title <> '' THEN 'B' ELSE 'C' END AS entry_class,
       count(*) AS entries
FROM f_entries
WHERE NOT regexp_matches(pdf_name, '^10[._][0-9]{4,}') AND NOT starts_with(pdf_name, '1-s2.0-') GROUP BY 1""")
def entry_classes(t):
    name = F.col("pdf_name")
    scanned = t("f_entries").filter(~ids.is_doi_name(name) & ~ids.is_publisher_name(name))
    kind = entry_class(F.col("json_title"), F.col("json_author")).alias("entry_class")
    return scanned.select(kind).groupBy("entry_class").agg(F.count("*").alias("entries"))


@query("q_authors_match", "f_entries f_works", f"""
SELECT e.page_id, w.doi, {duck.authors_match("e.json_author", "w.first_author")} AS same_author
FROM f_entries e JOIN f_works w ON w.year = 1990 + e.page_id % 35 AND substring(w.first_author, 1, 1) = substring(e.json_author, 1, 1)""")
def author_pairs(t):
    """The predicate behind an equi-join block of year and initial."""
    e, w, initial = t("f_entries"), t("f_works"), lambda c: F.substring(c, 1, 1)
    e = e.select("page_id", "json_author", (1990 + F.col("page_id") % 35).alias("year"), initial("json_author").alias("_initial"))
    w = w.select("doi", "first_author", F.col("year").cast("long").alias("year"), initial("first_author").alias("_initial"))
    return link.author_pairs(e, w, ["year", "_initial"]).select("page_id", "doi", "same_author")


@query("q_authors_composed", "f_entries f_works", f"""
SELECT e.page_id, w.doi,
       {duck.authors_match("nfc_normalize(replace(e.json_author, 'e', 'e' || chr(769)))", "nfc_normalize(replace(w.first_author, 'e', chr(233)))")} AS same_author,
       nfc_normalize(replace(e.json_author, 'e', 'e' || chr(769))) AS author
FROM f_entries e JOIN f_works w ON w.doc_id = e.page_id""")
def composed_author_pairs(t):
    """Names with marks apart on one side and as one letter on the other."""
    e = t("f_entries").select("page_id", F.replace("json_author", F.lit("e"), F.lit("e\u0301")).alias("_apart"))
    pairs = e.join(t("f_works"), F.col("page_id") == F.col("doc_id"))
    whole = F.replace("first_author", F.lit("e"), F.lit("\u00e9"))
    return pairs.select("page_id", "doi", authors_match(F.col("_apart"), whole).alias("same_author"), compose(F.col("_apart")).alias("author"))


@query("q_title_similarity", "f_page_titles f_works", f"""
SELECT p.page_id, w.doi, round({duck.similarity(duck.tokens("p.title"), duck.tokens("w.title"))}, 3)::DOUBLE AS title_sim
FROM f_page_titles p JOIN f_works w ON w.doc_id = p.page_id""")
def title_similarities(t):
    p = t("f_page_titles").select("page_id", F.col("title").alias("left_title"))
    pairs = p.join(t("f_works"), F.col("page_id") == F.col("doc_id"))
    sim = title_similarity(F.col("left_title"), F.col("title"))
    return pairs.select("page_id", "doi", F.round(sim, 3).alias("title_sim"))


@query("q_confidence_band", "", """
SELECT CASE WHEN event_id % 101 >= 70 THEN 'auto' WHEN event_id % 101 >= 40 THEN 'review' ELSE 'skip' END AS band,
       count(*) AS results FROM events GROUP BY 1""")
def confidence_bands(t):
    band = confidence_band(F.col("event_id") % 101).alias("band")
    return t("events").select(band).groupBy("band").agg(F.count("*").alias("results"))
