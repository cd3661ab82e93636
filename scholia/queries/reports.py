"""Queries that produce reports as ordered lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import reports, stats
from scholia.operators.verify import three_way_verify
from scholia.queries import query
from scholia.session import cut_lineage
from scholia.queries.linkage import folders, identified, match, secondary_titles


@query("q_report", "f_extractions", r"""
WITH s AS (SELECT prompt_name AS p, event_id, json_extract_string(body, '$.citation.title') AS title, json_extract_string(body, '$.citation.year')::DOUBLE AS y FROM f_extractions),
v AS (SELECT lower(title) AS v, count(*) AS n FROM s WHERE p = 'click' AND lower(title) <> 'not reported' GROUP BY 1),
a AS (SELECT 0 AS section, '# Review' || chr(10) AS text
 UNION ALL SELECT 1, '## Titles' || chr(10) || (SELECT string_agg('  - **' || v || '**: ' || n || ' (' || printf('%.1f', n * 100.0 / (SELECT sum(n) FROM v)) || '%)', chr(10) ORDER BY n DESC, v) FROM v) || chr(10)
   || (SELECT '  Total entries: **' || count(*) || '**' FROM s WHERE p = 'click') || chr(10)
 UNION ALL SELECT 2, '## Years' || chr(10) || (SELECT printf('  Mean: %.2f (n=%d, min=%.2f, max=%.2f)', avg(y), count(*), min(y), max(y)) FROM s WHERE p = 'view') || ' and {{other x y}}' || chr(10)
   || (SELECT '  **' || count(*) FILTER (WHERE event_id % 3 = 0) || '** / ' || count(*) || ' (' || printf('%.1f', count(*) FILTER (WHERE event_id % 3 = 0) * 100.0 / count(*)) || '%)' FROM s WHERE p = 'error') || chr(10)),
l AS (SELECT section, string_split(text, chr(10)) AS ls FROM a)
SELECT section, (generate_subscripts(ls, 1) - 1)::INTEGER AS pos, unnest(ls) AS line FROM l""")
def report(t):
    templates = [
        ("Titles", '{{value_counts "click" "citation.title"}}\n{{count "click"}}'),
        ("Years", '{{mean "view" "citation.year"}} and {{other x y}}\n{{count_true "error" "flag"}}'),
    ]
    return reports.render_report(t.spark, t("f_extractions"), "body", "Review", templates)


@query("q_match_report", "f_entries f_works")
def match_report(t):
    results = cut_lineage(identified(t).withColumn("final_author", F.lit("")))
    conflicts = stats.doi_conflicts(results)
    summary = stats.match_summary(results.select("entry_class"), results)
    return reports.match_report(results, conflicts, summary)


@query("q_verify_report", "f_works f_extractions f_bib f_page_titles")
def verify_report(t):
    return reports.verify_report(three_way_verify(folders(t), t("f_works"), t("f_bib"), secondary_titles(t)))


@query("q_doi_report", "f_page_titles f_works")
def doi_report(t):
    rows = match(t).withColumn("pdf_name", F.concat(F.col("page_id").cast("string"), F.lit(".pdf")))
    return reports.doi_report(rows)


@query("q_checklist", "f_entries f_works", r"""
WITH r AS (SELECT lpad(page_id::VARCHAR, 6, '0') || '.pdf' AS pdf_name, substring(regexp_replace(json_title, '[^A-Za-z ]', '', 'g'), 1, 50) AS title, w.doi
  FROM f_entries e LEFT JOIN f_works w ON w.doc_id = e.page_id WHERE page_id % 100 BETWEEN 40 AND 69),
b AS (SELECT *, row_number() OVER (ORDER BY pdf_name) AS n FROM r)
SELECT 1 AS section, n AS pos, '| ' || n || ' | `' || pdf_name || '` | ' || title || ' | `' || coalesce(doi, '(not found)') || '` | [search](https://example.org/?q=' || replace(title, ' ', '%20') || ') |' AS line FROM b
UNION ALL SELECT 1, -10, '## To confirm: ' || count(*) FROM b HAVING count(*) > 0
UNION ALL SELECT 1, -9, '' FROM b HAVING count(*) > 0
UNION ALL SELECT 1, -8, '| # | File | Title | DOI | Link |' FROM b HAVING count(*) > 0
UNION ALL SELECT 1, -7, '|---|---|---|---|---|' FROM b HAVING count(*) > 0""")
def checklist(t):
    key = F.col("page_id")
    works = t("f_works").select(F.col("doc_id").alias("page_id"), F.col("doi").alias("cr_doi"))
    rows = t("f_entries").join(works, "page_id", "left").select(
        F.concat(F.lpad(key.cast("string"), 6, "0"), F.lit(".pdf")).alias("pdf_name"), "cr_doi",
        F.regexp_replace("json_title", "[^A-Za-z ]", "").alias("final_title"), (key % 100).alias("clue_score"),
    )
    return reports.review_checklist(rows, "https://example.org/?q=")
