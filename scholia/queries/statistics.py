"""Queries on semi-structured extraction results."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import semi, stats
from scholia.queries import query
from scholia.queries.linkage import cascade_sql, identified
from scholia.session import cut_lineage

CLEAN = "NULLIF(NULLIF(NULLIF(NULLIF(NULLIF(trim(lower(v)), ''), 'not reported'), 'none'), 'null'), 'n/a')"


@query("q_leaves", "f_extractions", """
WITH t AS (SELECT event_id, j.fullkey AS path, j.key AS k, j.type AS jt, j.atom AS atom FROM f_extractions, json_tree(body::JSON) j)
SELECT event_id, path, CASE WHEN regexp_matches(path, '\\]$') THEN NULL ELSE k END AS key,
  CASE WHEN starts_with(path, '$.citation.') THEN 'citation' WHEN starts_with(path, '$.tags[') THEN 'tags' ELSE '' END AS above,
  CASE jt WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' ELSE jt END AS kind,
  CASE WHEN jt NOT IN ('OBJECT', 'ARRAY') THEN atom ->> '$' END AS value FROM t WHERE path <> '$'""")
def leaves(t):
    rows = semi.leaves(t("f_extractions"), ["event_id"], "body")
    return rows.withColumn("above", F.array_join("ancestors", ".")).drop("ancestors", "depth")


@query("q_deep_bodies", "", """
SELECT event_id, 2 * (event_id % 12) + 3 AS nodes, CAST(2 * (event_id % 12) + 3 AS INTEGER) AS deepest, event_type AS leaf, 1::BIGINT AS flat FROM events""")
def deep_bodies(t):
    """Bodies nested up to 25 levels, with a list nested as deeply: all nodes, the innermost value, the list made flat."""
    n = (F.col("event_id") % 12).cast("int")
    core = F.concat(F.lit('{"v":["'), "event_type", F.lit('"]}'))
    body = F.concat(F.lit('{"t":'), F.repeat(F.lit('{"a":['), n), core, F.repeat(F.lit("]}"), n), F.lit("}"))
    listed = F.concat(F.repeat(F.lit("["), n + 1), F.lit('"x"'), F.repeat(F.lit("]"), n + 1))
    rows = t("events").select("event_id", body.alias("body"), listed.alias("listed"))
    found = semi.leaves(rows, ["event_id", "listed"], "body")
    flat = F.size(semi.clean_values(F.array(semi.parse(F.col("listed"))))).cast("long")
    whole = found.groupBy("event_id", "listed").agg(F.count("*").alias("nodes"), F.max("depth").alias("deepest"), F.max("value").alias("leaf"))
    return whole.select("event_id", "nodes", "deepest", "leaf", flat.alias("flat"))


@query("q_find_key", "f_extractions", """
SELECT event_id, '$.citation.title' AS path, json_extract_string(body, '$.citation.title') AS value FROM f_extractions""")
def find_key(t):
    rows = semi.leaves(t("f_extractions"), ["event_id"], "body")
    return semi.find_key_rows(rows, "title").select("event_id", "path", "value")




@query("q_find_path", "f_extractions", """
SELECT (event_id // 10)::BIGINT AS grp, json_extract_string(body, '$.citation.year') AS value FROM f_extractions
UNION ALL SELECT event_id + 1000000000, json_extract_string(body, '$.citation.year') FROM f_extractions""")
def find_path(t):
    """Plain bodies and lists of ten bodies, the path fanning out over the list."""
    rows = t("f_extractions")
    in_order = F.array_sort(F.collect_list(F.struct("event_id", "body")))
    joined = F.concat(F.lit("["), F.array_join(F.transform(in_order, lambda b: b.body), ","), F.lit("]"))
    lists = rows.groupBy(F.floor(F.col("event_id") / 10).alias("grp")).agg(joined.alias("body"))
    single = rows.select((F.col("event_id") + 1000000000).alias("grp"), "body")
    both = lists.unionByName(single)
    values = semi.find_path(semi.parse(F.col("body")), "citation.year")
    return both.select("grp", F.explode(F.transform(values, lambda v: semi.as_text(v))).alias("value"))


@query("q_clean_value", "f_extractions", f"""
WITH v AS (SELECT event_id, 'title' AS field, json_extract_string(body, '$.citation.title') AS v FROM f_extractions
  UNION ALL SELECT event_id, 'flag', json_extract_string(body, '$.flag') FROM f_extractions
  UNION ALL SELECT event_id, 'k', json_extract_string(body, '$.k') FROM f_extractions
  UNION ALL SELECT event_id, 'tags', NULL FROM f_extractions)
SELECT event_id, field, {CLEAN} AS value FROM v""")
def clean_value(t):
    body = F.col("_b")
    paths = {"title": "$.citation.title", "flag": "$.flag", "k": "$.k", "tags": "$.tags"}
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("field"), semi.clean_value(F.try_variant_get(body, p, "variant")).alias("value"))
            for n, p in paths.items()
        ]
    )
    rows = t("f_extractions").select("event_id", semi.parse(F.col("body")).alias("_b"))
    return rows.select("event_id", F.explode(cells).alias("c")).select("event_id", "c.*")


@query("q_flatten_values", "f_extractions", """
SELECT event_id, 't' || (event_id % 4) AS value FROM f_extractions UNION ALL SELECT event_id, 't' || (event_id % 6) FROM f_extractions""")
def flatten_values(t):
    return stats.values_of(t("f_extractions"), "body", "tags", ["event_id"])


@query("q_first_usable", "f_extractions", """
SELECT event_id, paper_id, json_extract_string(body, '$.citation.title') AS paper_title,
  json_extract_string(body, '$.citation.year') AS year, json_extract_string(body, '$.flag') AS flag, NULL::VARCHAR AS absent FROM f_extractions""")
def first_usable(t):
    fields = {"paper_title": "citation.title", "year": "year", "flag": "flag", "absent": "citation.none"}
    return semi.first_usable(t("f_extractions").select("event_id", "paper_id", "body"), "body", fields)


@query("q_repair_json", "f_responses f_extractions", """
SELECT event_id AS task_id, CASE event_id % 5 WHEN 3 THEN '{}' WHEN 4 THEN NULL ELSE body END AS json,
  CASE event_id % 5 WHEN 1 THEN 2 WHEN 4 THEN NULL ELSE 1 END AS tier FROM f_extractions""")
def repair_json(t):
    return semi.repair_json(t("f_responses"), "response").select("task_id", "json", "tier")


@query("q_repair_json_scan", "f_extractions", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN body ELSE '[1, 2]' END AS json FROM f_extractions""")
def repair_json_scan(t):
    """Responses that need the bracket scan: more braces after the object, a bare list."""
    twice = F.concat(F.lit("First "), F.col("body"), F.lit(" then {broken} and "), F.col("body"))
    text = F.when(F.col("event_id") % 2 == 0, twice).otherwise(F.lit("The list [1, 2] is all ]."))
    rows = t("f_extractions").select("event_id", text.alias("response"))
    return semi.repair_json(rows, "response").select("event_id", "json")


@query("q_validate_object", "f_responses", """
SELECT task_id, task_id % 5 = 2 AS valid FROM f_responses""")
def validate_object(t):
    return t("f_responses").select("task_id", semi.is_valid_object(F.col("response")).alias("valid"))


@query("q_flatten_works", "f_works", """
SELECT doi, title, 'G. ' || first_author AS first_author, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE year END AS year FROM f_works""")
def flatten_works(t):
    works, part = t("f_works"), F.col("doc_id") % 3
    date = F.struct(F.array(F.array(F.col("year"))).alias("date-parts"))
    person = lambda g, f, s: F.struct(F.lit(g).alias("given"), f.alias("family"), F.lit(s).alias("sequence"))
    main = F.col("first_author")
    authors = F.when(part == 0, F.array(person("G.", main, "first"), person("X.", main, "additional"))).otherwise(
        F.array(person("G.", main, "additional"))
    )
    dated = F.col("doc_id") % 7 != 0
    raw = works.select(
        F.to_json(
            F.struct(
                F.col("doi").alias("DOI"), F.array("title").alias("title"), authors.alias("author"),
                F.when(dated & (part == 0), date).alias("published-print"),
                F.when(dated & (part == 1), date).alias("published-online"),
                F.when(dated & (part == 2), date).alias("created"),
            )
        ).alias("raw")
    )
    return semi.flatten_works(raw.select(F.from_json("raw", semi.WORK_SCHEMA).alias("w")).select("w.*"))


@query("q_flatten_catalogue", "f_works", """
SELECT doc_id, doi, title, CASE WHEN doc_id % 2 = 0 THEN first_author || '; B' ELSE first_author || '; C D' END AS authors,
  year, 'ok' AS note FROM f_works""")
def flatten_catalogue(t):
    marked = F.concat(F.lit("<span>"), F.col("title"), F.lit("</span>"))
    clean = t("f_works")
    record = F.struct(
        "doi", marked.alias("title"), F.col("year"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.col("first_author"), F.lit("B"))).alias("authorList"),
        F.concat("first_author", F.lit(" , C D,")).alias("author"),
    )
    nested = F.struct(F.struct(F.struct(F.struct(F.array(record).alias("results")).alias("pageResults")).alias("paperSimpleSearchResult")).alias("value"))
    flat = F.struct(F.array(record).alias("list"))
    answer = F.when(F.col("doc_id") % 3 == 0, F.to_json(flat)).otherwise(F.to_json(nested))
    rows = semi.flatten_catalogue(clean.select("doc_id", answer.alias("response")), "response")
    return rows.select("doc_id", "doi", "title", F.array_join("authors", "; ").alias("authors"), "year", "note")


# --- aggregations ---------------------------------------------------------------


@query("q_collect_by_prompt", "f_result_files", """
WITH s AS (SELECT regexp_replace(file_name, '\\.json$', '') AS stem FROM f_result_files)
SELECT p AS prompt_name, count(*) AS entries, count(DISTINCT substring(stem, 1, length(stem) - length(p) - 4)) AS papers
FROM s JOIN (VALUES ('error'), ('view'), ('click'), ('signup'), ('purchase')) x(p) ON ends_with(stem, '_' || p || '_m0') GROUP BY 1""")
def collect_by_prompt(t):
    prompts = ["error", "view", "click", "signup", "purchase", "up"]
    rows = stats.collect_by_prompt(t("f_result_files"), prompts, "m0")
    return rows.groupBy("prompt_name").agg(
        F.count("*").alias("entries"), F.countDistinct("paper_id").alias("papers")
    )


@query("q_value_counts", "f_extractions", f"""
WITH v AS (SELECT json_extract_string(body, '$.citation.title') AS v FROM f_extractions)
SELECT {CLEAN} AS value, count(*) AS uses FROM v WHERE {CLEAN} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def value_counts(t):
    return stats.value_counts(t("f_extractions"), "body", "citation.title", 3)


@query("q_value_counts_pct", "f_extractions", """
WITH v AS (SELECT json_extract_string(body, '$.k') AS value FROM f_extractions),
c AS (SELECT value, count(*) AS uses FROM v GROUP BY 1)
SELECT value, uses, round(uses * 100.0::DOUBLE / (SELECT sum(uses) FROM c), 1)::DOUBLE AS pct FROM c ORDER BY uses DESC, value LIMIT 10""")
def value_counts_pct(t):
    return stats.value_counts_pct(t("f_extractions"), "body", "k", 10)


@query("q_numeric_summary", "f_extractions", """
WITH v AS (SELECT json_extract_string(body, '$.citation.year')::DOUBLE AS x FROM f_extractions)
SELECT round(avg(x), 6)::DOUBLE AS mean, max(x) AS max, min(x) AS min, count(x) AS count FROM v""")
def numeric_summary(t):
    return stats.numeric_summary(t("f_extractions"), "body", "citation.year").withColumn("mean", F.round("mean", 6))


@query("q_count_true", "f_extractions", "SELECT count(*) AS hits FROM f_extractions WHERE event_id % 3 = 0")
def count_true(t):
    return stats.count_true(t("f_extractions"), "body", "flag, citation.open").select("hits")


@query("q_count_true_pct", "f_extractions", """
SELECT count(*) FILTER (WHERE event_id % 3 = 0) AS hits, count(*) AS total,
  round(count(*) FILTER (WHERE event_id % 3 = 0) * 100.0::DOUBLE / count(*), 1)::DOUBLE AS pct FROM f_extractions""")
def count_true_pct(t):
    return stats.count_true(t("f_extractions"), "body", "flag")


@query("q_entry_count", "f_extractions", "SELECT prompt_name, count(*) AS entries FROM f_extractions GROUP BY 1")
def entry_count(t):
    return stats.entry_count(t("f_extractions"))


@query("q_crosstab", "f_extractions", f"""
WITH v AS (SELECT json_extract_string(body, '$.citation.title') AS v, json_extract_string(body, '$.flag') AS f FROM f_extractions)
SELECT {CLEAN} AS row_value, count(*) FILTER (WHERE f = 'true') AS "true", count(*) FILTER (WHERE f = 'false') AS "false"
FROM v WHERE {CLEAN} IS NOT NULL GROUP BY 1""")
def crosstab(t):
    return stats.crosstab(t("f_extractions"), "body", "citation.title", "flag", ["true", "false"])


SECTIONS = [
    stats.Section("click", "citation.title", "value_counts", 2),
    stats.Section("error", "tags", "value_counts", 3),
    stats.Section("view", "citation.year", "mean"),
    stats.Section("signup", "flag", "count_true"),
    stats.Section("purchase", "", "count"),
]


@query("q_stats_sections", "f_extractions", f"""
WITH v AS (SELECT 0 AS section, json_extract_string(body, '$.citation.title') AS v FROM f_extractions WHERE prompt_name = 'click'
  UNION ALL SELECT 1, 't' || (event_id % 4) FROM f_extractions WHERE prompt_name = 'error'
  UNION ALL SELECT 1, 't' || (event_id % 6) FROM f_extractions WHERE prompt_name = 'error'),
c AS (SELECT section, {CLEAN} AS value, count(*) AS n, sum(count(*)) OVER (PARTITION BY section)::BIGINT AS total FROM v WHERE {CLEAN} IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, value)::INTEGER AS rank FROM c),
y AS (SELECT json_extract_string(body, '$.citation.year')::DOUBLE AS x FROM f_extractions WHERE prompt_name = 'view')
SELECT section, CASE section WHEN 0 THEN 'click' ELSE 'error' END AS prompt, CASE section WHEN 0 THEN 'citation.title' ELSE 'tags' END AS field,
  'value_counts' AS type, rank, value, n, total, NULL::DOUBLE AS mean, NULL::DOUBLE AS min, NULL::DOUBLE AS max
FROM r WHERE rank <= CASE section WHEN 0 THEN 2 ELSE 3 END
UNION ALL SELECT 2, 'view', 'citation.year', 'mean', NULL, NULL, count(*), NULL, round(avg(x), 6)::DOUBLE, min(x), max(x) FROM y
UNION ALL SELECT 3, 'signup', 'flag', 'count_true', NULL, NULL, count(*) FILTER (WHERE event_id % 3 = 0), count(*), NULL, NULL, NULL FROM f_extractions WHERE prompt_name = 'signup'
UNION ALL SELECT 4, 'purchase', '', 'count', NULL, NULL, count(*), count(*), NULL, NULL, NULL FROM f_extractions WHERE prompt_name = 'purchase'""")
def stats_sections(t):
    rows = stats.stats_sections(t("f_extractions"), "body", SECTIONS)
    return rows.withColumn("mean", F.round("mean", 6))


@query("q_enrich", "f_extractions", """
WITH m AS (SELECT paper_id, prompt_name, ts, event_id, json_extract_string(body, '$.citation.year') AS year, NULLIF(NULLIF(json_extract_string(body, '$.citation.title'), 'not reported'), '') AS title
  FROM f_extractions WHERE prompt_name IN ('signup', 'purchase')),
y AS (SELECT paper_id, year FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY prompt_name = 'purchase' DESC, ts DESC, event_id DESC) AS rk FROM m WHERE year IS NOT NULL) WHERE rk = 1),
t AS (SELECT paper_id, title FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY prompt_name = 'purchase' DESC, ts DESC, event_id DESC) AS rk FROM m WHERE title IS NOT NULL) WHERE rk = 1)
SELECT e.event_id, e.paper_id, json_extract_string(e.body, '$.k') AS k, y.year, NULL::VARCHAR AS doi, coalesce(t.title, 'none') AS title, NULL::VARCHAR AS first_author, NULL::VARCHAR AS author
FROM f_extractions e LEFT JOIN y USING (paper_id) LEFT JOIN t USING (paper_id) WHERE e.prompt_name = 'click'""")
def enrich(t):
    extractions = t("f_extractions")
    clicks = extractions.filter("prompt_name = 'click'").select("event_id", "paper_id", "body")
    rows = semi.first_usable(clicks, "body", {"k": "k"}).withColumn("title", F.lit("none"))
    meta = extractions.select("paper_id", "prompt_name", "ts", "event_id", "body")
    return stats.enrich(rows, meta, ["signup", "purchase"])


@query("q_match_summary", "f_entries f_works", cascade_sql("""
SELECT count(*) AS total_scanned, count(*) FILTER (WHERE entry_class = 'A') AS class_a, count(*) FILTER (WHERE entry_class = 'B') AS class_b,
 count(*) FILTER (WHERE entry_class = 'C') AS class_c, count(*) FILTER (WHERE match) AS matched,
 count(*) FILTER (WHERE NOT match AND cr_doi IS NOT NULL) AS mismatched, count(*) FILTER (WHERE cr_doi IS NULL) AS not_found, count(*) AS results_checked,
 count(*) FILTER (WHERE starts_with(note, 'clue:')) AS clue_attempted, count(*) FILTER (WHERE starts_with(note, 'clue:') AND match) AS clue_matched,
 count(*) FILTER (WHERE starts_with(note, 'clue:') AND cr_doi IS NOT NULL AND NOT match) AS clue_needs_review,
 count(*) FILTER (WHERE starts_with(note, 'clue:') AND cr_doi IS NULL) AS clue_failed,
 count(*) FILTER (WHERE starts_with(note, 'text:')) AS text_attempted, count(*) FILTER (WHERE starts_with(note, 'text:') AND match) AS text_matched,
 count(*) FILTER (WHERE starts_with(note, 'text:') AND cr_doi IS NULL) AS text_failed, 0::BIGINT AS cache_hits FROM fin"""))
def match_summary(t):
    # counted twice, by class and by outcome
    results = cut_lineage(identified(t))
    return stats.match_summary(results.select("entry_class"), results)


@query("q_status_counts", "f_task_state", "SELECT model_alias, status, count(*) AS \"rows\" FROM f_task_state GROUP BY 1, 2")
def status_counts(t):
    return stats.status_counts(t("f_task_state"), ["model_alias", "status"])


@query("q_doi_conflicts", "f_entries f_works", """
WITH r AS (SELECT e.pdf_name || e.page_id AS pdf_name, w.doi AS cr_doi FROM f_entries e LEFT JOIN f_works w ON w.doc_id = e.page_id % 60 AND e.page_id % 5 <> 0),
c AS (SELECT cr_doi, count(*) AS files FROM r WHERE cr_doi IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT r.pdf_name, r.cr_doi, c.files FROM r JOIN c USING (cr_doi)""")
def doi_conflicts(t):
    works = t("f_works").select("doc_id", F.col("doi").alias("cr_doi"))
    key = F.col("page_id")
    rows = t("f_entries").select(F.concat("pdf_name", key.cast("string")).alias("pdf_name"), "page_id")
    rows = rows.join(works, (key % 60 == F.col("doc_id")) & (key % 5 != 0), "left")
    return stats.doi_conflicts(rows)
