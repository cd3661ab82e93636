"""Input tables and the derived views that the registered queries read.

Each view is one SQL text that runs unchanged on Spark and as a leading ``WITH``
clause in the check SQL, so both sides of a check start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# view name -> (tables and views it reads, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "f_doc_titles": (
        ["documents"],
        "SELECT doc_id, lang, source, trim(split_part(text, chr(10), 1)) AS title FROM documents",
    ),
    "f_page_titles": (
        ["pages"],
        "SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages",
    ),
    "f_works": (
        ["f_doc_titles", "part"],
        """SELECT concat('10.', cast(1000 + d.doc_id % 50 AS string), '/', d.source, '.', cast(d.doc_id AS string)) AS doi,
       d.title, p.p_name AS first_author, cast(1990 + d.doc_id % 35 AS int) AS year, d.doc_id
FROM f_doc_titles d JOIN part p ON p.p_partkey = d.doc_id % 200""",
    ),
    "f_entries": (
        ["f_page_titles", "part"],
        """SELECT t.page_id,
       CASE WHEN t.page_id % 7 = 0 THEN concat('1-s2.0-S', lpad(cast(t.page_id AS string), 8, '0'), '24', lpad(cast(t.page_id AS string), 5, '0'), '-main.pdf')
            WHEN t.page_id % 5 = 0 THEN concat('10.1000_x.', cast(t.page_id AS string), '.pdf')
            ELSE concat(split_part(p.p_name, ' ', 2), '_', cast(1990 + t.page_id % 35 AS string), '_', split_part(p.p_name, ' ', 1), '.pdf') END AS pdf_name,
       CASE WHEN t.page_id % 4 = 0 THEN '' ELSE t.title END AS json_title,
       CASE WHEN t.page_id % 3 = 0 THEN '' ELSE p.p_name END AS json_author
FROM f_page_titles t JOIN part p ON p.p_partkey = t.page_id % 200""",
    ),
    "f_filenames": (
        ["orders", "part"],
        """SELECT o.o_orderkey, concat(split_part(p.p_name, ' ', 2), '_', cast(year(o.o_orderdate) AS string),
       CASE WHEN o.o_orderkey % 2 = 0 THEN '_' ELSE '-' END, split_part(p.p_name, ' ', 1), '.pdf') AS pdf_name
FROM orders o JOIN part p ON p.p_partkey = o.o_orderkey % 200""",
    ),
    "f_extractions": (
        ["events"],
        """SELECT event_id, concat('P', cast(user_id AS string)) AS paper_id, event_type AS prompt_name,
       CASE WHEN event_id % 2 = 0 THEN 'm0' ELSE 'm1' END AS model_alias, ts,
       concat('{"citation":{"year":', cast(2000 + event_id % 25 AS string), ',"title":"', CASE WHEN event_id % 11 = 0 THEN 'Not Reported' ELSE event_type END,
              '"},"flag":', CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END,
              ',"tags":["t', cast(event_id % 4 AS string), '",["t', cast(event_id % 6 AS string), '"]],"k":', regexp_extract(props, '[0-9]+', 0), '}') AS body
FROM events""",
    ),
    "f_result_files": (
        ["f_extractions"],
        "SELECT event_id, concat(paper_id, '_', prompt_name, '_', model_alias, '.json') AS file_name, body FROM f_extractions",
    ),
    "f_responses": (
        ["f_extractions"],
        """SELECT event_id AS task_id, CASE event_id % 5
       WHEN 0 THEN concat('```json', chr(10), body, chr(10), '```')
       WHEN 1 THEN concat('Here is the result: ', body, '. I hope this helps.')
       WHEN 2 THEN body WHEN 3 THEN '{}' ELSE concat('{"k": ', cast(event_id AS string)) END AS response
FROM f_extractions""",
    ),
    "f_task_state": (
        ["events"],
        """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'm0' ELSE 'm1' END AS model_alias,
       concat(cast(user_id AS string), '|', cast(event_id % 10 AS string)) AS task_id,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'in_progress' ELSE 'success' END AS status,
       cast(event_id % 4 AS int) AS retries, ts FROM events""",
    ),
    "f_ocr_pages": (
        ["conversations"],
        "SELECT conv_id AS doc_id, cast(turn AS int) AS page_idx, text AS content, role <> 'system' AS success FROM conversations",
    ),
    "f_markers": (
        ["conversations"],
        """SELECT conv_id AS doc_id, cast(turn AS int) AS pos, CASE role WHEN 'assistant' THEN 'caption' ELSE 'image' END AS kind,
       CASE role WHEN 'assistant' THEN concat('Figure ', cast(turn AS string), '. ', substring(text, 1, 20)) ELSE concat('images/', cast(turn % 5 AS string), '.jpg') END AS value
FROM conversations""",
    ),
    "f_layout": (
        ["f_page_titles"],
        """SELECT page_id, 1000 AS width, 1400 AS height, concat('<|ref|>', CASE WHEN page_id % 2 = 0 THEN 'image' ELSE 'text' END, '<|/ref|><|det|>[[', cast(page_id % 400 AS string), ',10,', cast(page_id % 400 + 100 AS string),
       ',999]]<|/det|>', chr(10), chr(10), title) AS content FROM f_page_titles""",
    ),
    "f_tex": (
        ["f_doc_titles"],
        """SELECT doc_id, concat(chr(92), 'begin{document}', chr(92), 'section{', title, '}', chr(10), 'Body ', cast(doc_id AS string), ' ', chr(92), 'cite{k', cast(doc_id % 9 AS string), ',k', cast(doc_id % 13 AS string), '} % note', chr(10),
       chr(92), 'begin{figure}', chr(92), 'begin{tabular}x', chr(92), 'end{tabular}', chr(92), 'end{figure}', chr(10), chr(92), 'textbf{', lang, '}', chr(92), 'end{document}') AS tex
FROM f_doc_titles""",
    ),
    "f_tex_edges": (
        ["region", "nation"],
        """SELECT 'main' AS src, cast(r_regionkey AS int) AS pos, r_name AS dst FROM region
UNION ALL SELECT r.r_name, cast(n.n_nationkey AS int), n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
UNION ALL SELECT n.n_name, 0, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey % 5 = 0""",
    ),
    "f_tex_files": (
        ["documents"],
        """SELECT concat('p', cast(cast((doc_id - doc_id % 40) / 40 AS int) AS string), '/f', cast(doc_id % 40 AS string), '.tex') AS path, concat('p', cast(cast((doc_id - doc_id % 40) / 40 AS int) AS string)) AS root_dir,
       concat('T', cast(doc_id AS string), ' ', chr(92), 'input{f', cast(2 * (doc_id % 40) + 1 AS string), '} m ', chr(92), 'include{f', cast(2 * (doc_id % 40) + 2 AS string), '.tex}',
       CASE WHEN doc_id % 7 = 3 THEN concat(' ', chr(92), 'input{f', cast(cast((doc_id % 40 - doc_id % 2) / 2 AS int) AS string), '}') ELSE '' END, ' e', chr(10)) AS text
FROM documents""",
    ),
    "f_bib": (
        ["f_works"],
        "SELECT lower(doi) AS doi, title, first_author FROM f_works WHERE doc_id % 3 = 0",
    ),
}


def _needed(names: list[str]) -> list[str]:
    """Views behind the given names, each after the views it reads."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in out:
            for parent in VIEWS[name][0]:
                visit(parent)
            out.append(name)

    for name in names:
        visit(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table read from parquet, or a derived view over base tables."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parents, sql = VIEWS[name]
    return spark.sql(
        _bind(sql, parents), **{parent: table(spark, sf_dir, parent) for parent in parents}
    )


def _bind(sql: str, parents: list[str]) -> str:
    """Turn the table names after FROM and JOIN into DataFrame parameters."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for parent in parents:
        sql = re.sub(rf"\b(FROM|JOIN) {parent}\b", r"\1 {" + parent + "}", sql)
    return sql


def with_clause(names: list[str]) -> str:
    """The views as a leading WITH clause for the check SQL."""
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in _needed(names)]
    return "WITH " + ",\n".join(parts) if parts else ""
