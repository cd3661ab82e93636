"""Queries on record linkage and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions.text import title_tokens
from scholia.operators import linkage as link
from scholia.operators import verify
from scholia.operators.identifiers import filename_clues
from scholia.operators.titles import scored_title
from scholia.plans.identify import direct_stage, identify
from scholia.plans.match import match_status
from scholia.queries import duck, query
from scholia.queries.texts import scored_titles

# --- shared check SQL ---------------------------------------------------------


def top_titles(name: str, source: str, key: str, title: str, works: str = "f_works", n: int = 3) -> str:
    """CTE body of the n candidates by shared title words."""
    return f"""
{name}_q AS (SELECT {key}, unnest({duck.words(title)}) AS tok FROM {source}),
{name}_w AS (SELECT doi, unnest({duck.words("title")}) AS tok FROM {works}),
{name}_c AS (SELECT {key}, doi, count(*)::INTEGER AS overlap FROM {name}_q JOIN {name}_w USING (tok) GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY overlap DESC, doi)::INTEGER AS rank
  FROM {name}_c) WHERE rank <= {n})"""


def best_of(name: str, cands: str, key: str, author: str, year: str, works: str = "f_works") -> str:
    """CTE body choosing the best scored candidate; expressions are over e.*."""
    bonus = f"CASE WHEN {duck.authors_match(author, 'w.first_author')} THEN 50 ELSE 0 END"
    gap = f"abs(w.year - {year})"
    return f"""
{name} AS (SELECT * EXCLUDE (rk) FROM (
  SELECT e.{key}, w.doi, w.title, w.first_author, w.year,
    (e.overlap + {bonus} + CASE WHEN {gap} = 0 THEN 30 WHEN {gap} <= 1 THEN 20 ELSE 0 END)::INTEGER AS score,
    row_number() OVER (PARTITION BY e.{key} ORDER BY e.overlap + {bonus}
      + CASE WHEN {gap} = 0 THEN 30 WHEN {gap} <= 1 THEN 20 ELSE 0 END DESC, e.rank) AS rk
  FROM {cands} e JOIN {works} w USING (doi)) WHERE rk = 1)"""


def clue_top(name: str, clue: str, key: str) -> str:
    """CTE body of the five candidates by clues; a known year must be equal."""
    return f"""
{name}_k AS (
  SELECT {key}, year, unnest(list_distinct(list_concat(list_transform(keywords, lambda k: 't:' || lower(k)),
     list_transform({duck.words("author")}, lambda a: 'a:' || a)))) AS tok FROM {clue}),
{name}_w AS (
  SELECT doi, year, unnest(list_concat(list_transform({duck.words("title")}, lambda k: 't:' || k),
     list_transform({duck.words("first_author")}, lambda a: 'a:' || a))) AS tok FROM f_works),
{name}_c AS (
  SELECT k.{key}, w.doi, count(*)::INTEGER AS overlap FROM {name}_k k JOIN {name}_w w ON k.tok = w.tok
    AND (k.year IS NULL OR k.year = w.year) GROUP BY 1, 2
  UNION ALL
  SELECT c.{key}, w.doi, 1 FROM {clue} c JOIN f_works w ON c.year = w.year WHERE c.author = '' AND len(c.keywords) = 0),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY overlap DESC, doi)::INTEGER AS rank
  FROM {name}_c) WHERE rank <= 5)"""


def clue_points(c: str, w: str) -> str:
    surname = f"list_last(string_split({w}.first_author, ' '))"
    return f"""least(CASE WHEN {duck.authors_match(c + '.author', surname)} THEN 50 ELSE 0 END
  + CASE WHEN abs({w}.year - {c}.year) = 0 THEN 30 WHEN abs({w}.year - {c}.year) <= 1 THEN 20 ELSE 0 END
  + CASE WHEN len({c}.keywords) > 0 THEN floor(len(list_filter({c}.keywords, lambda k: contains(lower({w}.title), lower(k))))::DOUBLE
      / len({c}.keywords) * 20) ELSE 0 END, 100)::INTEGER"""


# --- candidates ---------------------------------------------------------------


@query("q_title_candidates", "f_page_titles f_works", f"""
WITH {top_titles("c", "f_page_titles", "page_id", "title").strip()}
SELECT page_id, doi, overlap, rank FROM c""")
def title_candidates(t):
    return link.title_candidates(t("f_page_titles"), t("f_works"), "page_id", "title")


@query("q_pick_best", "f_entries f_works", f"""
WITH {top_titles("c", "f_entries", "page_id", "json_title").strip()},
x AS (SELECT c.*, e.json_author FROM c JOIN f_entries e USING (page_id)),
{best_of("b", "x", "page_id", "e.json_author", "(1990 + e.page_id % 35)").strip()}
SELECT * FROM b""")
def pick_best(t):
    entries, works = t("f_entries"), t("f_works")
    found = link.title_candidates(entries, works, "page_id", "json_title")
    expected = found.join(entries.select("page_id", "json_author"), "page_id")
    return link.pick_best(expected, works, "page_id", F.col("json_author"), 1990 + F.col("page_id") % 35)


@query("q_lookup_doi", "f_works", """
WITH d AS (SELECT p_partkey, concat('10.', cast(1000 + p_partkey % 50 AS string), '/', 'src', cast(p_partkey % 3 AS string), '.', cast(p_partkey AS string)) AS miss FROM part),
k AS (SELECT d.p_partkey, coalesce(w.doi, d.miss) AS doi FROM d LEFT JOIN f_works w ON w.doc_id = d.p_partkey AND d.p_partkey % 3 <> 0)
SELECT k.p_partkey, k.doi, w.title AS found_title, w.first_author AS found_author,
  CASE WHEN w.doi IS NULL THEN 'not_found' ELSE 'ok' END AS note FROM k LEFT JOIN f_works w ON w.doi = k.doi""")
def lookup_doi(t):
    works, key = t("f_works"), F.col("p_partkey")
    miss = F.concat(
        F.lit("10."), (1000 + key % 50).cast("string"), F.lit("/src"), (key % 3).cast("string"),
        F.lit("."), key.cast("string"),
    )
    known = works.filter(F.col("doc_id") % 3 != 0).select(F.col("doc_id").alias("p_partkey"), "doi")
    asked = t("part").select("p_partkey", miss.alias("miss")).join(known, "p_partkey", "left")
    asked = asked.select("p_partkey", F.coalesce("doi", "miss").alias("doi"))
    return link.lookup_by_doi(asked, works)


@query("q_clue_candidates", "f_filenames f_works", f"""
WITH {duck.clues("f_filenames", "o_orderkey").strip()},
{clue_top("c", "clue", "o_orderkey").strip()}
SELECT o_orderkey, doi, overlap, rank FROM c""")
def clue_candidates(t):
    clues = filename_clues(t("f_filenames"), "pdf_name")
    return link.clue_candidates(clues, t("f_works"), "o_orderkey")


@query("q_clue_score", "f_filenames f_works", f"""
WITH {duck.clues("f_filenames", "o_orderkey").strip()}
SELECT c.o_orderkey, w.doi, {clue_points("c", "w")} AS clue_score
FROM clue c JOIN f_works w ON w.doc_id = c.o_orderkey % 200""")
def clue_score(t):
    clues = filename_clues(t("f_filenames"), "pdf_name")
    works = t("f_works").withColumnRenamed("year", "work_year")
    pairs = clues.join(works, F.col("o_orderkey") % 200 == F.col("doc_id"))
    score = link.clue_score(
        F.col("author"), F.col("year"), F.col("keywords"),
        F.col("first_author"), F.col("title"), F.col("work_year"),
    )
    return pairs.select("o_orderkey", "doi", score.alias("clue_score"))


@query("q_similarity_join", "f_page_titles f_works", f"""
WITH l AS (SELECT list_sort({duck.tokens("title")}) AS l, min(page_id) AS left_id, count(*) AS left_rows FROM f_page_titles GROUP BY 1),
r AS (SELECT list_sort({duck.tokens("title")}) AS r, min(doi) AS right_id, count(*) AS right_rows FROM f_works GROUP BY 1),
lt AS (SELECT left_id, unnest(l) AS tok FROM l),
rt AS (SELECT right_id, unnest(r) AS tok FROM r),
c AS (SELECT left_id, right_id, count(*) AS shared FROM lt JOIN rt USING (tok) GROUP BY 1, 2)
SELECT left_id, left_rows, right_id, right_rows, round(shared::DOUBLE / (len(l) + len(r) - shared), 6)::DOUBLE AS similarity
FROM c JOIN l USING (left_id) JOIN r USING (right_id) WHERE shared::DOUBLE / (len(l) + len(r) - shared) >= 0.5""")
def similarity_join(t):
    tokens = title_tokens(F.col("title"))
    pairs = link.similarity_join(
        t("f_page_titles"), t("f_works"), tokens, tokens, "page_id", "doi", 0.5
    )
    return pairs.select(
        "left_id", "left_rows", "right_id", "right_rows", F.round("similarity", 6).alias("similarity")
    )


# --- verification -------------------------------------------------------------

SUPPLEMENTED = """
w AS (SELECT CASE WHEN doc_id % 17 = 0 THEN doi || '.s001' ELSE doi END AS doi, title,
        CASE WHEN doc_id % 17 = 0 THEN 'Qq' ELSE first_author END AS first_author, year, doc_id FROM f_works)"""


def supplemented(t):
    """Works whose every 17th record stands under a supplement DOI of its own."""
    extra = F.col("doc_id") % 17 == 0
    return t("f_works").select(
        F.when(extra, F.concat("doi", F.lit(".s001"))).otherwise(F.col("doi")).alias("doi"), "title",
        F.when(extra, "Qq").otherwise(F.col("first_author")).alias("first_author"), "year", "doc_id",
    )


@query("q_verify_author", "f_entries f_works", f"""
WITH {SUPPLEMENTED.strip()},
e AS (SELECT * FROM f_entries WHERE json_title <> '' AND json_author <> ''),
{top_titles("c", "e", "page_id", "json_title", "w").strip()},
x AS (SELECT c.*, e.json_author FROM c JOIN e USING (page_id)),
{best_of("b", "x", "page_id", "e.json_author", "NULL::INTEGER", "w").strip()},
m AS (SELECT e.*, b.doi, b.first_author, f.doi AS base, f.first_author AS base_author,
   {duck.authors_match("e.json_author", "b.first_author")} AS direct,
   {duck.authors_match("e.json_author", "f.first_author")} AS retry
  FROM e LEFT JOIN b USING (page_id) LEFT JOIN f_works f
   ON f.doi = regexp_replace(b.doi, '\\.s[0-9]{{3,}}$', '') AND f.doi <> b.doi)
SELECT page_id, pdf_name, json_title, json_author,
  CASE WHEN NOT direct AND retry THEN base ELSE doi END AS cr_doi,
  CASE WHEN NOT direct AND retry THEN base_author ELSE first_author END AS cr_author,
  doi IS NOT NULL AND (direct OR retry) AS match,
  CASE WHEN doi IS NULL THEN 'not_found' WHEN direct THEN 'ok' WHEN retry THEN 'ok (stripped suffix)'
       ELSE 'author_mismatch: ' || json_author || ' vs ' || first_author END AS note
FROM m""")
def verify_author(t):
    entries = t("f_entries").filter((F.col("json_title") != "") & (F.col("json_author") != ""))
    registry = supplemented(t)
    found = link.title_candidates(entries, registry, "page_id", "json_title")
    expected = found.join(entries.select("page_id", "json_author"), "page_id")
    best = link.pick_best(expected, registry, "page_id", F.col("json_author"))
    return link.verify_author(entries, best, t("f_works"), "page_id")


@query("q_lookup_unverified", "f_entries f_works", f"""
WITH e AS (SELECT * FROM f_entries WHERE json_title <> '' AND json_author = ''),
{top_titles("c", "e", "page_id", "json_title").strip()},
{best_of("b", "c", "page_id", "''", "NULL::INTEGER").strip()}
SELECT e.page_id, e.pdf_name, b.doi AS cr_doi, b.first_author AS cr_author, b.doi IS NOT NULL AS match,
  CASE WHEN b.doi IS NULL THEN 'not_found' ELSE 'found: ' || b.doi || ' (no author verify)' END AS note
FROM e LEFT JOIN b USING (page_id)""")
def lookup_unverified(t):
    entries = t("f_entries").filter((F.col("json_title") != "") & (F.col("json_author") == ""))
    works = t("f_works")
    best = link.pick_best(
        link.title_candidates(entries, works, "page_id", "json_title"), works, "page_id"
    )
    return link.lookup_unverified(entries.select("page_id", "pdf_name"), best, "page_id")


@query("q_resolve_supplements", "f_entries f_works", f"""
WITH r AS (SELECT e.page_id, e.json_author, CASE WHEN w.doc_id % 17 = 0 THEN w.doi || '.s001' ELSE w.doi END AS cr_doi,
   CASE WHEN e.page_id % 13 = 0 THEN k.doi END AS known_doi
 FROM f_entries e LEFT JOIN f_works w ON w.doc_id = e.page_id LEFT JOIN f_works k ON k.doc_id = e.page_id + 1),
n AS (SELECT *, coalesce(known_doi, CASE WHEN regexp_matches(cr_doi, '\\.s[0-9]{{3,}}$') THEN regexp_replace(cr_doi, '\\.s[0-9]{{3,}}$', '') END) AS doi FROM r)
SELECT n.page_id, n.doi AS cr_doi, w.first_author AS cr_author, n.json_author,
  {duck.authors_match("n.json_author", "w.first_author")} AS match, substring(w.title, 1, 60) AS cr_title
FROM n LEFT JOIN f_works w ON w.doi = n.doi WHERE n.doi IS NOT NULL""")
def resolve_supplements(t):
    entries, works = t("f_entries"), t("f_works")
    results = supplemented(t).select(F.col("doc_id").alias("page_id"), F.col("doi").alias("cr_doi"))
    known = works.select((F.col("doc_id") - 1).alias("page_id"), F.col("doi").alias("known_doi"))
    known = known.filter(F.col("page_id") % 13 == 0)
    return link.resolve_supplements(entries, results, works, "page_id", known)


@query("q_unmatched_anti", "f_entries f_works", """
WITH r AS (SELECT e.page_id, CASE WHEN e.page_id % 6 = 0 OR w.doi IS NULL THEN NULL ELSE w.doi END AS cr_doi
  FROM f_entries e LEFT JOIN f_works w ON w.doc_id = e.page_id WHERE e.page_id % 9 <> 0)
SELECT e.page_id, CASE WHEN e.json_title = '' THEN 'C' ELSE 'B' END AS entry_class
FROM f_entries e LEFT JOIN r USING (page_id)
WHERE (e.json_title = '' AND r.cr_doi IS NULL)
   OR (e.json_title <> '' AND e.json_author = '' AND r.page_id IS NOT NULL AND r.cr_doi IS NULL)""")
def unmatched(t):
    entries = t("f_entries").withColumn("entry_class", link.entry_class(F.col("json_title"), F.col("json_author")))
    tried = entries.filter(F.col("page_id") % 9 != 0).select("page_id")
    works = t("f_works").select(F.col("doc_id").alias("page_id"), "doi")
    results = tried.join(works, "page_id", "left").select(
        "page_id", F.when(F.col("page_id") % 6 != 0, F.col("doi")).alias("cr_doi")
    )
    return link.unmatched(entries.select("page_id", "entry_class"), results, "page_id")


def cascade_sql(select: str) -> str:
    return f"""
WITH e AS (SELECT f.*, p.title AS text_title, CASE WHEN json_title <> '' AND json_author <> '' THEN 'A' WHEN json_title <> '' THEN 'B' ELSE 'C' END AS entry_class
  FROM f_entries f JOIN f_page_titles p USING (page_id)
  WHERE NOT regexp_matches(pdf_name, '^10[._][0-9]{{4,}}') AND NOT starts_with(pdf_name, '1-s2.0-')),
et AS (SELECT * FROM e WHERE entry_class <> 'C'),
{top_titles("c", "et", "page_id", "json_title").strip()},
x AS (SELECT c.*, e.json_author FROM c JOIN e USING (page_id)),
{best_of("b", "x", "page_id", "e.json_author", "NULL::INTEGER").strip()},
direct AS (SELECT e.page_id, b.doi AS cr_doi, b.first_author AS cr_author, e.json_title AS final_title,
   CASE WHEN e.entry_class = 'B' THEN b.doi IS NOT NULL ELSE b.doi IS NOT NULL AND {duck.authors_match("e.json_author", "b.first_author")} END AS match,
   CASE WHEN b.doi IS NULL THEN 'not_found' WHEN e.entry_class = 'B' THEN 'found: ' || b.doi || ' (no author verify)'
        WHEN {duck.authors_match("e.json_author", "b.first_author")} THEN 'ok'
        ELSE 'author_mismatch: ' || e.json_author || ' vs ' || b.first_author END AS note
  FROM et e LEFT JOIN b USING (page_id)),
lft AS (SELECT e.* FROM e LEFT JOIN direct d USING (page_id) WHERE e.entry_class = 'C' OR (e.entry_class = 'B' AND d.cr_doi IS NULL)),
{duck.clues("lft", "page_id").strip()},
{clue_top("k", "clue", "page_id").strip()},
ky AS (SELECT k.*, clue.author, clue.year AS clue_year FROM k JOIN clue USING (page_id)),
{best_of("kb", "ky", "page_id", "e.author", "e.clue_year").strip()},
clued AS (SELECT clue.page_id, kb.doi AS cr_doi, kb.first_author AS cr_author, kb.title AS final_title,
   CASE WHEN kb.doi IS NULL THEN 0 ELSE {clue_points("clue", "kb")} END AS clue_score,
   clue.author = '' AND clue.year IS NULL AND len(clue.keywords) = 0 AS no_clue
  FROM clue LEFT JOIN kb USING (page_id)),
rest AS (SELECT l.* FROM lft l JOIN clued USING (page_id) WHERE clued.cr_doi IS NULL),
rt AS (SELECT * FROM rest WHERE text_title <> ''),
{top_titles("tc", "rt", "page_id", "text_title").strip()},
{best_of("tb", "tc", "page_id", "''", "NULL::INTEGER").strip()},
texted AS (SELECT r.page_id, tb.doi AS cr_doi, tb.first_author AS cr_author, r.text_title AS final_title, tb.doi IS NOT NULL AS match,
   CASE WHEN tb.doi IS NOT NULL THEN 'text: found ' || tb.doi WHEN r.text_title = '' THEN 'text: no_title' ELSE 'text: not_found' END AS note
  FROM rest r LEFT JOIN tb USING (page_id)),
allr AS (SELECT page_id, cr_doi, cr_author, final_title, match, note, NULL::INTEGER AS clue_score, 'registry' AS source, 0 AS stage FROM direct
  UNION ALL SELECT page_id, cr_doi, cr_author, final_title, cr_doi IS NOT NULL AND clue_score >= 70,
     CASE WHEN no_clue THEN 'clue: insufficient_clues' WHEN cr_doi IS NULL THEN 'clue: no_results'
          WHEN clue_score >= 70 THEN 'clue: score=' || clue_score || ' (auto)' ELSE 'clue: score=' || clue_score || ' (review)' END, clue_score, 'clue', 1 FROM clued
  UNION ALL SELECT page_id, cr_doi, cr_author, final_title, match, note, NULL, 'text', 2 FROM texted),
res AS (SELECT * EXCLUDE (rk, stage) FROM (SELECT *, row_number() OVER (PARTITION BY page_id
   ORDER BY CASE WHEN cr_doi IS NOT NULL THEN stage ELSE 1000 - stage END) AS rk FROM allr) WHERE rk = 1),
man AS (SELECT w.doc_id AS page_id, w.doi FROM f_works w WHERE w.doc_id % 50 = 3),
fin AS (SELECT e.page_id, e.pdf_name, e.entry_class, res.cr_author, res.final_title, res.clue_score,
   coalesce(man.doi, res.cr_doi) AS cr_doi, man.doi IS NOT NULL OR res.match AS match,
   CASE WHEN man.doi IS NOT NULL THEN 'manual_verify' ELSE res.note END AS note,
   CASE WHEN man.doi IS NOT NULL THEN 'manual' ELSE res.source END AS source
  FROM res JOIN e USING (page_id) LEFT JOIN man USING (page_id))
{select}"""


def identified(t):
    """Entries named after neither DOI nor publisher item, through all stages."""
    from scholia.operators.identifiers import is_doi_name, is_publisher_name

    titles = t("f_page_titles").select("page_id", F.col("title").alias("text_title"))
    name = F.col("pdf_name")
    entries = t("f_entries").filter(~is_doi_name(name) & ~is_publisher_name(name)).join(titles, "page_id")
    works = t("f_works")
    manual = works.filter(F.col("doc_id") % 50 == 3).select(F.col("doc_id").alias("page_id"), "doi")
    return identify(entries, works, "page_id", "text_title", manual)


@query("q_cascade", "f_entries f_works", cascade_sql("SELECT * FROM fin"))
def cascade(t):
    return identified(t)


@query("q_apply_manual", "f_entries f_works", """
WITH r AS (SELECT e.page_id, w.doi AS cr_doi, e.page_id % 2 = 0 AS match, 'ok' AS note, 'registry' AS source
  FROM f_entries e LEFT JOIN f_works w ON w.doc_id = e.page_id),
m AS (SELECT doc_id - 1 AS page_id, doi FROM f_works WHERE doc_id % 10 = 1)
SELECT r.page_id, coalesce(m.doi, r.cr_doi) AS cr_doi, m.doi IS NOT NULL OR r.match AS match,
  CASE WHEN m.doi IS NULL THEN r.note ELSE 'manual_verify' END AS note,
  CASE WHEN m.doi IS NULL THEN r.source ELSE 'manual' END AS source
FROM r LEFT JOIN m USING (page_id)""")
def apply_manual(t):
    works = t("f_works")
    results = t("f_entries").select("page_id").join(
        works.select(F.col("doc_id").alias("page_id"), F.col("doi").alias("cr_doi")), "page_id", "left"
    )
    results = results.select(
        "page_id", "cr_doi", (F.col("page_id") % 2 == 0).alias("match"),
        F.lit("ok").alias("note"), F.lit("registry").alias("source"),
    )
    manual = works.filter(F.col("doc_id") % 10 == 1).select((F.col("doc_id") - 1).alias("page_id"), "doi")
    return link.apply_manual(results, manual, "page_id")


SECONDARY = """
sec AS (SELECT w.doi, CASE WHEN e.event_id % 4 = 0 THEN w.title WHEN e.event_id % 4 = 1 THEN '' ELSE w.title || ' ' || x.prompt_name || ' draft notes' END AS title
  FROM events e JOIN f_extractions x USING (event_id) JOIN f_works w ON w.doc_id = e.event_id % 200)"""


def secondary_titles(t):
    """Titles that several extraction models reported for a DOI."""
    works = t("f_works").select("doc_id", "doi", F.col("title").alias("work_title"))
    events = t("f_extractions").select("event_id", "prompt_name")
    rows = events.join(works, F.col("event_id") % 200 == F.col("doc_id"))
    kind = F.col("event_id") % 4
    title = (
        F.when(kind == 0, F.col("work_title"))
        .when(kind == 1, "")
        .otherwise(F.concat("work_title", F.lit(" "), "prompt_name", F.lit(" draft notes")))
    )
    return rows.select("doi", title.alias("title"))


@query("q_best_secondary_sim", "f_works f_extractions", f"""
WITH {SECONDARY.strip()},
d AS (SELECT doi, title FROM f_works WHERE doc_id % 2 = 0)
SELECT d.doi, round(max({duck.similarity(duck.tokens("d.title"), duck.tokens("sec.title"))}), 3)::DOUBLE AS secondary_sim
FROM d JOIN sec ON sec.doi = d.doi AND sec.title <> '' GROUP BY 1""")
def best_secondary(t):
    docs = t("f_works").filter(F.col("doc_id") % 2 == 0).select("doi", "title")
    best = verify.best_secondary_similarity(docs, secondary_titles(t))
    return best.select("doi", F.round("secondary_sim", 3).alias("secondary_sim"))


@query("q_three_way_verify", "f_works f_extractions f_bib f_page_titles", f"""
WITH {SECONDARY.strip()},
docs AS (SELECT p.page_id, replace(coalesce(w.doi, 'none/' || p.page_id), '/', '_') AS folder,
   CASE WHEN p.page_id % 7 = 0 THEN '10.0/unknown.' || p.page_id ELSE coalesce(w.doi, 'none/' || p.page_id) END AS doi,
   CASE WHEN p.page_id % 2 = 0 THEN p.title ELSE w.title END AS title
  FROM f_page_titles p LEFT JOIN f_works w ON w.doc_id = p.page_id),
j AS (SELECT d.folder, d.doi, d.title, w.title AS ct, w.first_author, b.title AS bt,
   (SELECT max({duck.similarity(duck.tokens("d.title"), duck.tokens("s.title"))}) FROM sec s WHERE s.doi = d.doi AND s.title <> '') AS ss
  FROM docs d LEFT JOIN f_works w ON w.doi = d.doi LEFT JOIN f_bib b ON b.doi = lower(d.doi)),
s AS (SELECT *, coalesce(ct, '') <> '' AS ok, {duck.similarity(duck.tokens("title"), duck.tokens("ct"))} AS sim,
   CASE WHEN coalesce(bt, '') <> '' THEN {duck.similarity(duck.tokens("title"), duck.tokens("bt"))} END AS bs FROM j)
SELECT folder, doi AS expected_doi, title, CASE WHEN ok THEN ct END AS canonical_title, CASE WHEN ok THEN first_author END AS first_author,
  CASE WHEN ok THEN round(sim, 3) ELSE 0 END::DOUBLE AS title_sim, CASE WHEN ok THEN round(bs, 3) END::DOUBLE AS bib_sim,
  CASE WHEN ok THEN round(ss, 3) END::DOUBLE AS secondary_sim,
  CASE WHEN NOT ok THEN 'cannot_verify' WHEN sim >= 0.5 AND (bs IS NULL OR bs >= 0.5) AND (ss IS NULL OR ss >= 0.5) THEN 'verified' ELSE 'mismatch' END AS status
FROM s""")
def three_way_verify(t):
    return verify.three_way_verify(folders(t), t("f_works"), t("f_bib"), secondary_titles(t))


def folders(t):
    """Documents filed under a DOI, half of them with the title of another page."""
    works = t("f_works").select(F.col("doc_id").alias("page_id"), "doi", F.col("title").alias("work_title"))
    pages = t("f_page_titles").join(works, "page_id", "left")
    key = F.col("page_id")
    filed = F.coalesce(F.col("doi"), F.concat(F.lit("none/"), key.cast("string")))
    doi = F.when(key % 7 == 0, F.concat(F.lit("10.0/unknown."), key.cast("string"))).otherwise(filed)
    return pages.select(
        F.replace(filed, F.lit("/"), F.lit("_")).alias("folder"), doi.alias("doi"),
        F.when(key % 2 == 0, F.col("title")).otherwise(F.col("work_title")).alias("title"),
    )


@query("q_dual_channel", "", """
WITH c AS (SELECT event_id, (event_id % 11) / 10.0::DOUBLE AS sim, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS second, event_id % 7 <> 0 AS known FROM events)
SELECT event_id, CASE WHEN NOT known THEN 'matched' WHEN sim < 0.5 AND second = false THEN 'no_confidence' ELSE 'matched' END AS status,
  known AND sim >= 0.5 AND coalesce(second, true) AS verified FROM c""")
def dual_channel(t):
    key = F.col("event_id")
    second = F.when(key % 3 == 0, True).when(key % 3 == 1, False)
    decision = verify.dual_channel((key % 11) / 10.0, second, key % 7 != 0)
    return t("events").select("event_id", decision.alias("d")).select("event_id", "d.*")


@query("q_match_status", "f_page_titles f_works", f"""
WITH {scored_titles("f_page_titles", "page_id", "title").strip()},
docs AS (SELECT p.page_id, s.scored_title AS title, CASE p.page_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS second_ok FROM f_page_titles p LEFT JOIN scored s USING (page_id)),
dt AS (SELECT * FROM docs WHERE title IS NOT NULL),
{top_titles("c", "dt", "page_id", "title").strip()},
{best_of("b", "c", "page_id", "''", "NULL::INTEGER").strip()},
j AS (SELECT d.*, b.doi AS bdoi, b.title AS bt, b.first_author, b.year, {duck.similarity(duck.tokens("d.title"), duck.tokens("b.title"))} AS sim,
   coalesce(b.title, '') <> '' AS known FROM docs d LEFT JOIN b USING (page_id)),
s AS (SELECT *, CASE WHEN title IS NULL THEN 'no_title' WHEN bdoi IS NULL THEN 'not_found'
   WHEN known AND sim < 0.5 AND second_ok = false THEN 'no_confidence' ELSE 'matched' END AS status FROM j)
SELECT page_id, title, status, CASE WHEN status = 'matched' THEN bdoi END AS doi, CASE WHEN status = 'matched' THEN first_author END AS author,
  CASE WHEN status = 'matched' THEN year END AS year, CASE WHEN status = 'matched' THEN known AND sim >= 0.5 AND coalesce(second_ok, true) END AS verified,
  CASE WHEN status = 'matched' THEN bt END AS canonical_title, CASE WHEN bdoi IS NOT NULL THEN round(sim, 3) END::DOUBLE AS title_sim,
  CASE WHEN status = 'matched' AND known THEN second_ok END AS second_ok,
  CASE WHEN status = 'no_confidence' THEN bdoi END AS nearest_doi, CASE WHEN status = 'no_confidence' THEN bt END AS nearest_title
FROM s""")
def match(t):
    key = F.col("page_id")
    second = F.when(key % 3 == 0, False).when(key % 3 == 1, True)
    docs = t("f_page_titles").select("page_id", scored_title(F.col("title")).alias("title"), second.alias("second_ok"))
    return match_status(docs, t("f_works"), "page_id")


@query("q_cache_lookup", "f_entries f_works", """
WITH cache AS (SELECT e.pdf_name, CASE WHEN e.page_id % 4 = 1 THEN '' ELSE w.doi END AS doi, w.first_author AS author,
   e.page_id % 2 = 0 AS match, 'ok' AS note, CASE WHEN e.page_id % 5 = 0 THEN 0 ELSE 1 END AS version
  FROM f_entries e JOIN f_works w ON w.doc_id = e.page_id WHERE e.page_id % 3 = 0),
f AS (SELECT pdf_name, min(doi) AS doi, min(author) AS author, bool_or(match) AS match, min(note) AS note FROM cache WHERE version = 1 AND coalesce(doi, '') <> '' GROUP BY 1)
SELECT e.page_id, e.pdf_name, f.doi AS cached_doi, f.author AS cached_author, f.match AS cached_match, f.note AS cached_note, f.doi IS NOT NULL AS cached
FROM f_entries e LEFT JOIN f USING (pdf_name)""")
def cache_lookup(t):
    key = F.col("page_id")
    works = t("f_works").select(F.col("doc_id").alias("page_id"), "doi", F.col("first_author").alias("author"))
    rows = t("f_entries").filter(key % 3 == 0).select("page_id", "pdf_name").join(works, "page_id")
    cache = rows.select(
        "pdf_name", F.when(key % 4 == 1, "").otherwise(F.col("doi")).alias("doi"), "author",
        (key % 2 == 0).alias("match"), F.lit("ok").alias("note"),
        F.when(key % 5 == 0, 0).otherwise(1).alias("version"),
    )
    usable = cache.filter((F.col("version") == 1) & (F.col("doi") != ""))
    unique = usable.groupBy("pdf_name", "version").agg(
        F.min("doi").alias("doi"), F.min("author").alias("author"),
        F.max("match").alias("match"), F.min("note").alias("note"),
    )
    return link.cache_lookup(t("f_entries").select("page_id", "pdf_name"), unique, "pdf_name")
