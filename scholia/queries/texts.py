"""Queries on texts: titles, prompts, mark-up, pages, captions, LaTeX."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from scholia.functions.chunked import number_rows
from scholia.operators import includes, markup, ordered, pages, tex
from scholia.operators.titles import plain_title, scored_title
from scholia.queries import duck, query
from scholia.vocab import FRONT_MATTER, PLAIN_TITLE_PREFIXES, SCORED_TITLE_PREFIXES, TITLE_HINTS

BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _starts(col, prefixes):
    return "(" + " OR ".join(f"starts_with({col}, '{p}')" for p in prefixes) + ")"


def line_rows(source: str, key: str, text: str) -> str:
    return rf"""
line_lists AS (SELECT {key}, regexp_split_to_array({text}, '{BREAK}') AS ls FROM {source}),
line_raw AS (SELECT {key}, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM line_lists),
line_rows AS (SELECT {key}, i, {duck.strip("raw")} AS line FROM line_raw)"""


def scored_titles(source: str, key: str, text: str) -> str:
    hints = " OR ".join(f"contains(lower(body), '{h}')" for h in TITLE_HINTS)
    return rf"""{line_rows(source, key, text)},
line_body AS (SELECT {key}, i, starts_with(line, '#') AS heading, {duck.strip(r"regexp_replace(line, '^#+\s*', '')")} AS body
  FROM line_rows WHERE line <> '' AND NOT {_starts("line", [">", "```", "!["])}),
line_kept AS (SELECT {key}, i, heading, ({hints}) AS hint, {duck.strip(r"regexp_replace(body, '^\d+(\.\d+)*\s+', '')")} AS line
  FROM line_body WHERE NOT regexp_matches(lower(body), '{FRONT_MATTER}') AND length(body) >= 15 AND NOT {_starts("lower(body)", SCORED_TITLE_PREFIXES)}),
scored AS (SELECT {key}, coalesce(arg_min(line, i) FILTER (WHERE heading), arg_max(line, i) FILTER (WHERE hint), arg_min(line, i)) AS scored_title
  FROM line_kept WHERE length(line) >= 15 GROUP BY 1)"""


@query("q_title_plain", "", f"""
WITH {line_rows("documents", "doc_id", "text").strip()},
ok AS (SELECT * FROM line_rows WHERE length(line) >= 15 AND NOT {_starts("line", ["#", ">", "```", "!["])} AND NOT {_starts("lower(line)", PLAIN_TITLE_PREFIXES)})
SELECT d.doc_id, t.title FROM documents d LEFT JOIN (SELECT doc_id, arg_min(line, i) AS title FROM ok GROUP BY 1) t USING (doc_id)""")
def plain_titles(t):
    return t("documents").select("doc_id", plain_title(F.col("text")).alias("title"))


@query("q_title_scored", "", f"""
WITH {scored_titles("documents", "doc_id", "text").strip()}
SELECT d.doc_id, s.scored_title AS title FROM documents d LEFT JOIN scored s USING (doc_id)""")
def scored_titles_of_documents(t):
    return t("documents").select("doc_id", scored_title(F.col("text")).alias("title"))


@query("q_render_prompt", "", """
SELECT doc_id, 'Source ' || source || ' in ' || lang || ':' || chr(10) || substring(text, 1, 500) || chr(10) || 'Keep {unknown}.' AS prompt FROM documents""")
def render_prompts(t):
    template = F.lit("Source {source} in {lang}:\n{content}\nKeep {unknown}.")
    values = {"source": F.col("source"), "lang": F.col("lang")}
    return t("documents").select("doc_id", markup.render_prompt(template, F.col("text"), values, 500).alias("prompt"))


def _duck_html(col: str) -> str:
    quoted = lambda s: s.replace("'", "''")
    steps = [(p, r.replace("$1", r"\1").replace("$2", r"\2")) for p, r in markup.HTML_RULES]
    return duck.strip(reduce(lambda c, s: f"regexp_replace({c}, '{quoted(s[0])}', '{quoted(s[1])}', 'g')", steps, col))


@query("q_html_text", "", f"SELECT page_id, {_duck_html('html')} AS text FROM pages")
def html_text(t):
    return t("pages").select("page_id", markup.html_to_text(F.col("html")).alias("text"))


@query("q_layout_refs", "f_layout", r"""
WITH p AS (SELECT page_id, width, height, regexp_extract(content, '<\|ref\|>(.*?)<\|/ref\|>', 1) AS label,
   string_split(regexp_extract(content, '\[\[(.*?)\]\]', 1), ',') AS b FROM f_layout)
SELECT page_id, width, height, 0 AS ref_pos, 0 AS box_pos, label, floor(b[1]::INTEGER / 999.0::DOUBLE * width)::INTEGER AS x1,
  floor(b[2]::INTEGER / 999.0::DOUBLE * height)::INTEGER AS y1, floor(b[3]::INTEGER / 999.0::DOUBLE * width)::INTEGER AS x2,
  floor(b[4]::INTEGER / 999.0::DOUBLE * height)::INTEGER AS y2 FROM p""")
def layout_refs(t):
    return markup.layout_refs(t("f_layout"), "content", "width", "height")


@query("q_clean_layout", "f_layout", r"""
SELECT page_id, regexp_replace(trim(replace(replace(replace(replace(regexp_replace(regexp_replace(content, '\|?ref\|>.*?\|/ref\|>', '', 'g'),
   '\|?det\|>.*?\|/det\|>', '', 'g'), '\coloneqq', ':='), '\eqqcolon', '=:'), '\approx', '≈'), '<<', ''), ' ' || chr(10)), '\n\n+', chr(10), 'g') AS content FROM f_layout""")
def clean_layout(t):
    return t("f_layout").select("page_id", markup.clean_layout(F.col("content")).alias("content"))


@query("q_rewrite_images", "", r"""
SELECT conv_id, turn, text || chr(10) || '![fig](../images/' || turn || '.jpg) and ![](' || CASE WHEN turn % 2 = 0 THEN 'media/c' || conv_id || '_' || turn || '.jpg' ELSE 'images/' || turn || '.jpg' END || ')' AS text
FROM (SELECT conv_id, turn, regexp_replace(text, '\]\(', '] (', 'g') AS text FROM conversations) WHERE turn % 2 = 1
UNION ALL
SELECT conv_id, turn, text || chr(10) || '![fig](media/c' || conv_id || '_' || turn || '.jpg) and ![](media/c' || conv_id || '_' || turn || '.jpg)'
FROM (SELECT conv_id, turn, regexp_replace(text, '\]\(', '] (', 'g') AS text FROM conversations) WHERE turn % 2 = 0""")
def rewrite_images(t):
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    base = F.regexp_replace("text", r"\]\(", "] (")
    text = F.concat(
        base, F.lit("\n![fig](../images/"), turn, F.lit(".jpg) and ![](images/"), turn, F.lit(".jpg)")
    )
    rows = t("conversations").select("conv_id", "turn", text.alias("text"))
    moved = t("conversations").filter("turn % 2 = 0").select(
        "conv_id", F.concat(F.lit("images/"), turn, F.lit(".jpg")).alias("old_path"),
        F.concat(F.lit("media/c"), conv, F.lit("_"), turn, F.lit(".jpg")).alias("new_path"),
    )
    return markup.rewrite_image_paths(rows, ["conv_id", "turn"], "text", moved, ["conv_id"])


# --- pages and chapters -------------------------------------------------------


@query("q_assemble_pages", "f_ocr_pages", r"""
WITH n AS (SELECT doc_id, max(page_idx) + 1 AS total FROM f_ocr_pages WHERE page_idx <> 2 OR doc_id % 3 <> 0 GROUP BY 1),
e AS (SELECT doc_id, unnest(range(total)) AS page_idx FROM n),
r AS (SELECT e.doc_id, e.page_idx, CASE WHEN p.success THEN p.content || chr(10) || chr(10)
   WHEN p.success IS NULL THEN chr(10) || chr(10) || '> [Error on Page ' || e.page_idx || ': Missing]' || chr(10) || chr(10)
   ELSE chr(10) || chr(10) || '> [Error on Page ' || e.page_idx || ': ' || p.content || ']' || chr(10) || chr(10) END AS txt
 FROM e LEFT JOIN (SELECT * FROM f_ocr_pages WHERE page_idx <> 2 OR doc_id % 3 <> 0) p ON p.doc_id = e.doc_id AND p.page_idx = e.page_idx)
SELECT doc_id, 0 AS part_no, string_agg(txt, '' ORDER BY page_idx) AS text, count(*) AS pages FROM r GROUP BY 1""")
def assemble_pages(t):
    kept = t("f_ocr_pages").filter((F.col("page_idx") != 2) | (F.col("doc_id") % 3 != 0))
    return pages.assemble_pages(kept)


@query("q_assemble_chapters", "f_ocr_pages", r"""
SELECT doc_id, 0 AS part_no, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_idx) AS text
FROM f_ocr_pages WHERE page_idx % 3 <> 1 GROUP BY 1""")
def assemble_chapters(t):
    blank = F.when(F.col("page_idx") % 3 == 1, "  ").otherwise(F.col("content"))
    return pages.assemble_chapters(t("f_ocr_pages").select("doc_id", F.col("page_idx").alias("pos"), blank.alias("text")))


@query("q_page_completeness", "f_ocr_pages", """
SELECT doc_id, count(*) FILTER (WHERE success AND page_idx % 4 <> 3) AS received, (max(page_idx) + 1)::BIGINT AS total,
  count(*) FILTER (WHERE success AND page_idx % 4 <> 3) = max(page_idx) + 1 AS done FROM f_ocr_pages GROUP BY 1""")
def page_completeness(t):
    tagged = F.when(F.col("page_idx") % 4 == 3, F.concat("content", F.lit("<|ref|>"))).otherwise(F.col("content"))
    return pages.page_completeness(t("f_ocr_pages").withColumn("content", tagged))


# --- ordered rows -------------------------------------------------------------


@query("q_pair_captions", "f_markers", """
WITH s AS (SELECT *, last_value(CASE WHEN kind = 'image' THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS image FROM f_markers)
SELECT doc_id, image, arg_min(value, pos) FILTER (WHERE kind = 'caption') AS caption, min(pos) AS first_pos
FROM s WHERE image IS NOT NULL GROUP BY 1, 2""")
def pair_captions(t):
    return ordered.pair_captions(t("f_markers"), "doc_id", span=4)


@query("q_caption_markers", "", r"""
WITH d AS (SELECT conv_id, '![a](images/1.jpg) ' || replace(replace(text, '!', '.'), 'igure', 'igur_') || chr(10) || 'Figure 2. About turn ' || turn || chr(10)
   || '<center>Fig. 3 centred</center>' AS text, turn FROM conversations)
SELECT conv_id * 100 + turn AS doc, 0 AS pos, 'image' AS kind, 'images/1.jpg' AS value FROM d
UNION ALL SELECT conv_id * 100 + turn, 1, 'caption', 'Figure 2. About turn ' || turn FROM d
UNION ALL SELECT conv_id * 100 + turn, 2, 'caption', 'Figure 3 centred' FROM d""")
def caption_markers(t):
    clean = F.replace(F.replace("text", F.lit("!"), F.lit(".")), F.lit("igure"), F.lit("igur_"))
    text = F.concat(
        F.lit("![a](images/1.jpg) "), clean, F.lit("\nFigure 2. About turn "), F.col("turn").cast("string"),
        F.lit("\n<center>Fig. 3 centred</center>"),
    )
    docs = t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc"), text.alias("text"))
    return ordered.caption_markers(docs, "doc", "text")


@query("q_renumber", "f_markers", """
SELECT doc_id, pos, value, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::BIGINT AS image_no FROM f_markers WHERE kind = 'image'""")
def renumber(t):
    images = t("f_markers").filter("kind = 'image'").drop("kind")
    return ordered.renumber(images, ["doc_id"], "pos", "image_no", start=0, span=4)


@query("q_ordered_distinct", "f_doc_titles", r"""
WITH l AS (SELECT doc_id, string_split(title, ' ') AS ws FROM f_doc_titles),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM l)
SELECT doc_id, word, min(pos)::INTEGER AS pos FROM (SELECT doc_id, regexp_replace(word, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS word, pos FROM w) WHERE word <> '' GROUP BY 1, 2""")
def ordered_distinct(t):
    rows = ordered.with_index(t("f_doc_titles"), ["doc_id"], F.split("title", " ", -1), "pos", "word")
    return ordered.ordered_distinct(rows, ["doc_id"], "pos", "word")


@query("q_rate_audit", "", """
SELECT event_id, user_id, ts, count(*) OVER w AS in_window, count(*) OVER w > 3 AS over_limit FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999' SECOND PRECEDING AND CURRENT ROW)""")
def rate_audit(t):
    events = t("events").select("event_id", "user_id", "ts")
    return ordered.rate_audit(events, "user_id", "ts", 3, 86400)


# --- LaTeX --------------------------------------------------------------------

BODY = r"regexp_replace(regexp_replace(tex, '(?s)^.*?\\begin\{document\}', ''), '(?s)\\end\{document\}.*$', '')"


@query("q_top_level_spans", "f_tex", rf"""
WITH b AS (SELECT doc_id, {BODY} AS body FROM f_tex),
p AS (SELECT doc_id, body, instr(body, '\begin{{figure}}') - 1 AS s, instr(body, '\end{{figure}}') - 1 + length('\end{{figure}}') AS e FROM b)
SELECT doc_id, 0 AS pos, 'figure' AS name, s::INTEGER AS start, e::INTEGER AS "end", true AS protected, substring(body, s + 1, e - s) AS block FROM p""")
def top_level_spans(t):
    bodies = t("f_tex").select("doc_id", tex.document_body(F.col("tex")).alias("body"))
    return tex.top_level_spans(bodies, "doc_id", "body")


@query("q_balanced_args", "f_doc_titles", r"""
SELECT doc_id, unnest([0, 1])::INTEGER AS pos, unnest(['a {' || t || '} b', '{x{' || lang || '}}']) AS argument
FROM (SELECT doc_id, lang, regexp_replace(title, '[{}\\]', '', 'g') AS t FROM f_doc_titles)""")
def balanced_args(t):
    title = F.regexp_replace("title", r"[{}\\]", "")
    text = F.concat(
        F.lit("start {kept} \\note{a {"), title, F.lit("} b} mid \\note{{x{"), F.col("lang"), F.lit("}}} end"),
    )
    return tex.balanced_args(t("f_doc_titles").select("doc_id", text.alias("text")), "doc_id", "text", "note")


@query("q_normalise_tex", "f_tex", rf"""
WITH b AS (SELECT doc_id, {BODY} AS x FROM f_tex),
c AS (SELECT doc_id, replace(regexp_replace(replace(x, '\%', chr(1)), '(?m)%[^\n]*$', '', 'g'), chr(1), '%') AS x FROM b),
k AS (SELECT doc_id, '\begin{{figure}}\begin{{tabular}}x\end{{tabular}}\end{{figure}}' AS fig, x FROM c),
p AS (SELECT doc_id, fig, replace(x, fig, chr(2)) AS x FROM k),
s AS (SELECT doc_id, fig, regexp_replace(x, '(?s)\\section\*?\{{\s*(.*?)\s*\}}', '# \1' || chr(10) || chr(10), 'g') AS x FROM p),
f AS (SELECT doc_id, fig, regexp_replace(regexp_replace(x, '(?s)\\textbf\{{(.*?)\}}', '**\1**', 'g'), '\\cite(\[.*?\])?\{{.*?\}}', '[citation]', 'g') AS x FROM s),
r AS (SELECT doc_id, replace(replace(x, '~', ' '), chr(2), fig) AS x FROM f),
w AS (SELECT doc_id, {duck.strip(r"regexp_replace(regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g'), ' +\n', chr(10), 'g')")} AS plain FROM r)
SELECT * FROM w""")
def normalise_tex(t):
    return t("f_tex").select("doc_id", tex.tex_to_text(F.col("tex")).alias("plain"))


@query("q_section_inventory", "f_tex", rf"""
SELECT doc_id, 0 AS pos, 'section' AS command, 1 AS level, {duck.strip(r"regexp_extract(tex, '(?s)\\section\*?\{(.*?)\}', 1)")} AS heading FROM f_tex""")
def section_inventory(t):
    return tex.section_inventory(t("f_tex"), "doc_id", "tex")


@query("q_citation_counts", "f_tex", r"SELECT doc_id, 'cite' AS kind, count(*) AS uses FROM f_tex WHERE contains(tex, '\cite{') GROUP BY 1")
def citation_counts(t):
    return tex.citation_counts(t("f_tex"), "doc_id", "tex")


@query("q_citation_keys", "f_tex", r"""
WITH k AS (SELECT unnest(string_split(regexp_extract(tex, '\\cite\{(.*?)\}', 1), ',')) AS cited FROM f_tex),
c AS (SELECT cited, count(*) AS uses FROM k GROUP BY 1)
SELECT cited, uses, row_number() OVER (ORDER BY uses DESC, cited) AS rank FROM c""")
def citation_keys(t):
    counts = tex.citations(t("f_tex"), "doc_id", "tex").groupBy("cited").agg(F.count("*").alias("uses"))
    return number_rows(counts, [F.desc("uses"), F.asc("cited")], "rank")


@query("q_include_closure", "f_tex_edges", """
WITH RECURSIVE walk AS (
  SELECT 'main' AS root, 'main' AS node, []::INTEGER[] AS key, ['main'] AS path
  UNION ALL SELECT w.root, e.dst, list_append(w.key, e.pos), list_append(w.path, e.dst)
  FROM walk w JOIN f_tex_edges e ON e.src = w.node WHERE NOT list_contains(w.path, e.dst)),
best AS (SELECT root, node, min(key) AS key FROM walk GROUP BY 1, 2)
SELECT root, node, array_to_string(key, '.') AS place, len(key)::INTEGER AS depth FROM best""")
def include_closure(t):
    edges = t("f_tex_edges")
    roots = edges.filter("src = 'main'").select(F.col("src").alias("root")).distinct()
    closure = includes.include_closure(edges, roots)
    return closure.select("root", "node", F.array_join("key", ".").alias("place"), "depth")


@query("q_resolve_includes", "", r"""
WITH RECURSIVE f AS (SELECT doc_id, doc_id // 40 AS g, (doc_id % 40)::INTEGER AS k, doc_id % 7 = 3 AS more FROM documents),
e AS (SELECT g, k AS src, 1 AS pos, 2 * k + 1 AS dst FROM f UNION ALL SELECT g, k, 3, 2 * k + 2 FROM f UNION ALL SELECT g, k, 5, k // 2 FROM f WHERE more),
walk AS (
  SELECT g, 0 AS node, []::INTEGER[] AS key, [0] AS path FROM f WHERE k = 0
  UNION ALL SELECT w.g, e.dst, list_append(w.key, e.pos), list_append(w.path, e.dst)
  FROM walk w JOIN e ON e.g = w.g AND e.src = w.node JOIN f ON f.g = w.g AND f.k = e.dst WHERE NOT list_contains(w.path, e.dst)),
best AS (SELECT g, node, min(key) AS key FROM walk GROUP BY 1, 2),
pieces AS (
  SELECT b.g, list_append(b.key, 2 * n.n) AS key, CASE n.n WHEN 0 THEN 'T' || f.doc_id || ' ' WHEN 1 THEN ' m ' WHEN CASE WHEN f.more THEN 3 ELSE 2 END THEN ' e' || chr(10) ELSE ' ' END AS piece
  FROM best b JOIN f ON f.g = b.g AND f.k = b.node JOIN (SELECT unnest([0, 1, 2, 3])::INTEGER AS n) n ON n.n <= CASE WHEN f.more THEN 3 ELSE 2 END)
SELECT 'p' || g || '/f0.tex' AS root, string_agg(piece, '' ORDER BY key) AS text FROM pieces GROUP BY g""")
def resolve_includes(t):
    """Whole texts of every project: a tree of files with links across it and includes of files that are not there."""
    files = t("f_tex_files")
    roots = files.where("path LIKE '%/f0.tex'").select(F.col("path").alias("root"))
    return includes.expanded_texts(includes.resolve_includes(files, roots))
