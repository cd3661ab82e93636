"""Queries on task planning, task state and renaming plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import stats, tasks
from scholia.operators.verify import dual_channel
from scholia.plans.extraction import extraction_run, render_tasks
from scholia.queries import query
from scholia.sources.corpus import reader_kind
from scholia.sources.sinks import result_name

PROMPTS = [tasks.Prompt(f"prompt {i}", str(i), limit=200) for i in range(10)]


@query("q_route_format", "", """
WITH n AS (SELECT doc_id, 'dir/' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.pdf.txt' WHEN 3 THEN '.pdf_text' WHEN 4 THEN '.pdf' ELSE '.docx' END AS name FROM documents)
SELECT doc_id, name, CASE doc_id % 6 WHEN 0 THEN 'markdown' WHEN 1 THEN 'text' WHEN 5 THEN 'rejected' ELSE 'pdf_text' END AS reader FROM n""")
def route_format(t):
    key = F.col("doc_id")
    endings = F.array(*[F.lit(e) for e in (".md", ".TXT", ".pdf.txt", ".pdf_text", ".pdf", ".docx")])
    name = F.concat(F.lit("dir/"), key.cast("string"), F.get(endings, (key % 6).cast("int")))
    rows = t("documents").select("doc_id", name.alias("name"))
    return rows.withColumn("reader", F.coalesce(reader_kind(F.col("name")), F.lit("rejected")))


@query("q_result_name", "f_result_files", """
SELECT event_id, regexp_replace(file_name, '\\.json$', '') || '_' || 'meta' || '_1_m0_{unknown}.json' AS result_name FROM f_result_files""")
def result_names(t):
    pattern = "{base}_{prompt_name}_{prompt_id}_{model_alias}_{unknown}.json"
    path = F.concat(F.lit("some/folder.x/"), "file_name")
    name = result_name(pattern, path, F.lit("meta"), F.lit("1"), F.lit("m0"), F.lit("model"))
    return t("f_result_files").select("event_id", name.alias("result_name"))


PLANNED = """
d AS (SELECT DISTINCT user_id::VARCHAR AS rel_path FROM events),
p AS (SELECT rel_path, i::VARCHAR AS prompt_id FROM d, range(10) r(i))"""


def user_documents(t):
    return t("events").select(F.col("user_id").cast("string").alias("rel_path")).distinct()


def state_of(t):
    """Task state whose ids agree with the planned tasks of model m0."""
    return t("f_task_state").withColumn("task_id", F.concat("task_id", F.lit("|m0")))


@query("q_plan_tasks", "", f"""
WITH {PLANNED.strip()}
SELECT rel_path AS document, rel_path, 'prompt ' || prompt_id AS prompt_name, prompt_id, NULL::VARCHAR AS caption, 'm0' AS model_alias, rel_path || '|' || prompt_id || '|m0' AS task_id FROM p""")
def plan_tasks(t):
    return tasks.plan_tasks(user_documents(t), PROMPTS, "m0")


@query("q_plan_image_tasks", "f_markers", """
WITH s AS (SELECT *, last_value(CASE WHEN kind = 'image' THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS image FROM f_markers),
m AS (SELECT doc_id, image, coalesce(arg_min(value, pos) FILTER (WHERE kind = 'caption'), '') AS caption FROM s WHERE image IS NOT NULL GROUP BY 1, 2)
SELECT doc_id || '/text.md' AS document, doc_id || '/' || image AS rel_path, 'figures' AS prompt_name, 'f' AS prompt_id, caption, 'm0' AS model_alias,
  doc_id || '/' || image || '|f|m0' AS task_id FROM m WHERE image <> 'images/3.jpg'""")
def plan_image_tasks(t):
    from scholia.operators.ordered import pair_captions

    path = F.concat(F.col("doc_id").cast("string"), F.lit("/text.md"))
    images = pair_captions(t("f_markers"), "doc_id").select(path.alias("rel_path"), "image", "caption")
    present = t("f_markers").filter("kind = 'image' AND value <> 'images/3.jpg'")
    present = present.select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), "value").alias("path"))
    docs = images.select("rel_path").distinct()
    return tasks.plan_tasks(docs, [tasks.Prompt("figures", "f", per_image=True)], "m0", images, present)


@query("q_preview", "", """
WITH d AS (SELECT doc_id::VARCHAR AS rel_path FROM documents ORDER BY 1 LIMIT 5)
SELECT rel_path, i::VARCHAR AS prompt_id FROM d, range(10) r(i)""")
def preview(t):
    docs = t("documents").select(F.col("doc_id").cast("string").alias("rel_path"))
    return tasks.preview(docs, PROMPTS, "m0").select("rel_path", "prompt_id")


LATEST = """
latest AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY model_alias, task_id ORDER BY ts DESC, event_id DESC) AS rk FROM f_task_state) WHERE rk = 1)"""


@query("q_skip_completed", "f_task_state", f"""
WITH {PLANNED.strip()}, {LATEST.strip()},
x AS (SELECT rel_path || '|' || prompt_id AS tid FROM p)
SELECT tid || '|m0' AS task_id FROM x WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.model_alias = 'm0' AND l.status = 'success' AND l.task_id = tid)""")
def skip_completed(t):
    planned = tasks.plan_tasks(user_documents(t), PROMPTS, "m0")
    return tasks.skip_completed(planned, state_of(t), ["ts", "event_id"]).select("task_id")


@query("q_run_batch", "f_responses", """
SELECT task_id, length(response)::BIGINT AS chars, upper(substring(response, 1, 5)) AS head FROM f_responses""")
def run_batch(t):
    """A deterministic function in place of a model call."""

    def answer(batches):
        for batch in batches:
            text = batch["response"]
            yield batch[["task_id"]].assign(chars=text.str.len(), head=text.str[:5].str.upper())

    return tasks.run_batch(t("f_responses"), answer, "task_id long, chars long, head string", partitions=8)


@query("q_route_outcomes", "f_responses f_extractions", """
SELECT event_id AS task_id, CASE WHEN event_id % 10 >= 8 OR event_id % 5 > 2 THEN NULL ELSE body END AS json,
  CASE WHEN event_id % 10 >= 8 OR event_id % 5 > 2 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN event_id % 10 = 8 THEN 'HTTP 503' WHEN event_id % 10 = 9 THEN repeat('x', 500) WHEN event_id % 5 = 3 THEN 'Schema validation failed' WHEN event_id % 5 = 4 THEN 'JSON parse failed' END AS error,
  CASE WHEN event_id % 10 = 9 THEN 'permanent' WHEN event_id % 10 = 8 OR event_id % 5 > 2 THEN 'retriable' END AS reason FROM f_extractions""")
def route_outcomes(t):
    last = F.col("task_id") % 10
    error = F.when(last == 8, "HTTP 503").when(last == 9, F.repeat(F.lit("x"), 600))
    rows = t("f_responses").withColumn("call_error", error)
    return tasks.route_outcomes(rows).select("task_id", "json", "status", "error", "reason")


@query("q_merge_state", "f_task_state", f"""
WITH {LATEST.strip()}
SELECT model_alias, task_id, status, retries, ts FROM latest""")
def merge_state(t):
    rows = t("f_task_state")
    old, new = rows.filter("event_id % 3 <> 0"), rows.filter("event_id % 3 = 0")
    merged = tasks.merge_state(old, new, ["ts", "event_id"])
    return merged.select("model_alias", "task_id", "status", "retries", "ts")


@query("q_failed_tasks", "f_task_state", f"""
WITH {LATEST.strip()}
SELECT model_alias, task_id, retries FROM latest WHERE status = 'failed'""")
def failed_tasks(t):
    latest = tasks.latest_state(t("f_task_state"), ["ts", "event_id"])
    return tasks.failed_tasks(latest).select("model_alias", "task_id", "retries")


@query("q_reset_failed", "f_task_state", f"""
WITH {LATEST.strip()}
SELECT model_alias, task_id, status FROM latest WHERE model_alias <> 'm1' AND NOT (model_alias = 'm0' AND status = 'failed' AND ends_with(task_id, '|4'))""")
def reset_failed(t):
    latest = tasks.latest_state(t("f_task_state"), ["ts", "event_id"])
    ids = latest.filter(F.col("task_id").endswith("|4")).select("task_id").distinct()
    kept = tasks.reset_failed(tasks.reset_model(latest, "m1"), "m0", ids)
    return kept.select("model_alias", "task_id", "status")


@query("q_run_counters", "f_task_state", f"""
WITH {PLANNED.strip()}, {LATEST.strip()},
x AS (SELECT p.rel_path || '|' || p.prompt_id AS tid FROM p),
j AS (SELECT x.tid, l.status, l.retries, coalesce(l.event_id % 2 = 0 AND l.event_id < 5000, false) AS before FROM x LEFT JOIN latest l ON l.task_id = x.tid AND l.model_alias = 'm0'),
c AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success' AND before) AS skipped, count(*) FILTER (WHERE status = 'success' AND NOT before) AS completed,
  count(*) FILTER (WHERE status = 'failed' AND NOT before) AS failed, coalesce(sum(retries) FILTER (WHERE NOT before), 0)::BIGINT AS retries FROM j)
SELECT 'm0' AS model_alias, *, total - skipped - completed - failed AS remaining FROM c""")
def run_counters(t):
    planned = tasks.plan_tasks(user_documents(t), PROMPTS, "m0")
    latest = tasks.latest_state(state_of(t), ["ts", "event_id"])
    return stats.run_counters(planned, latest.withColumn("before", F.col("event_id") < 5000))


RENAMES = """
r AS (SELECT e.page_id || '.pdf' AS pdf_name, w.doi AS cr_doi, e.page_id % 4 <> 0 AS match FROM f_entries e LEFT JOIN f_works w ON w.doc_id = CASE WHEN e.page_id % 9 = 0 THEN e.page_id - e.page_id % 27 ELSE e.page_id END),
ex AS (SELECT page_id || '.pdf' AS file_name FROM f_entries WHERE page_id % 11 <> 0 UNION SELECT replace(doi, '/', '_') || '.pdf' FROM f_works WHERE doc_id % 6 = 1)"""


def renames(t):
    """Results, some sharing a DOI, and the files present, some under their target."""
    key = F.col("page_id")
    works = t("f_works").select("doc_id", F.col("doi").alias("cr_doi"))
    rows = t("f_entries").select(
        F.concat(key.cast("string"), F.lit(".pdf")).alias("pdf_name"), (key % 4 != 0).alias("match"),
        F.when(key % 9 == 0, key - key % 27).otherwise(key).alias("doc_id"),
    )
    results = rows.join(works, "doc_id", "left").drop("doc_id")
    present = t("f_entries").filter(key % 11 != 0).select(F.concat(key.cast("string"), F.lit(".pdf")).alias("file_name"))
    named = t("f_works").filter("doc_id % 6 = 1").select(
        F.concat(F.replace("doi", F.lit("/"), F.lit("_")), F.lit(".pdf")).alias("file_name")
    )
    return results, present.unionByName(named)


@query("q_rename_plan", "f_entries f_works", f"""
WITH {RENAMES.strip()},
m AS (SELECT pdf_name, cr_doi, replace(cr_doi, '/', '_') || '.pdf' AS target FROM r WHERE match AND cr_doi IS NOT NULL)
SELECT m.pdf_name, m.cr_doi, m.target, CASE WHEN (SELECT count(*) FROM m n WHERE n.cr_doi = m.cr_doi) > 1 THEN 'skip_conflict' WHEN m.pdf_name = m.target THEN 'already_named'
  WHEN m.target IN (SELECT file_name FROM ex) THEN 'dedup' ELSE 'rename' END AS action FROM m WHERE m.pdf_name IN (SELECT file_name FROM ex)""")
def rename_plan(t):
    return tasks.rename_plan(*renames(t))


@query("q_gated_rename", "f_entries f_works", f"""
WITH {RENAMES.strip()},
m AS (SELECT pdf_name, cr_doi AS doi, replace(cr_doi, '/', '_') || '.pdf' AS target, match AS verified FROM r WHERE cr_doi IS NOT NULL)
SELECT pdf_name, doi, target, CASE WHEN NOT verified THEN 'blocked' WHEN target IN (SELECT file_name FROM ex) THEN 'skip_exists' ELSE 'rename' END AS action FROM m""")
def gated_rename(t):
    results, existing = renames(t)
    status = F.when(F.col("cr_doi").isNull(), "not_found").otherwise("matched")
    doi_map = results.select("pdf_name", F.col("cr_doi").alias("doi"), status.alias("status"), F.col("match").alias("verified"))
    return tasks.gated_rename_plan(doi_map, existing)


@query("q_rename_history", "f_entries f_works", f"""
WITH {RENAMES.strip()},
m AS (SELECT pdf_name, cr_doi, replace(cr_doi, '/', '_') || '.pdf' AS target FROM r WHERE match AND cr_doi IS NOT NULL),
pl AS (SELECT m.pdf_name, m.target FROM m WHERE pdf_name IN (SELECT file_name FROM ex) AND (SELECT count(*) FROM m n WHERE n.cr_doi = m.cr_doi) = 1)
SELECT r.pdf_name, r.cr_doi AS doi, pl.target AS renamed_to, CASE WHEN pl.target IS NOT NULL THEN '2024-01-01' END AS renamed_at FROM r LEFT JOIN pl USING (pdf_name)""")
def rename_history(t):
    results, existing = renames(t)
    cache = results.select("pdf_name", F.col("cr_doi").alias("doi"))
    return tasks.record_history(cache, tasks.rename_plan(results, existing), F.lit("2024-01-01"))


@query("q_outcome_status", "", """
SELECT CASE WHEN event_id % 11 / 10.0::DOUBLE < 0.5 AND event_id % 3 = 0 AND event_id % 7 <> 0 THEN 'no_confidence' ELSE 'matched' END AS status, count(*) AS "rows" FROM events GROUP BY 1""")
def outcome_status(t):
    key = F.col("event_id")
    decision = dual_channel((key % 11) / 10.0, F.when(key % 3 == 0, False), key % 7 != 0)
    return stats.status_counts(t("events").select(decision.alias("d")).select("d.status"), ["status"])


ASKED = """
a AS (SELECT d.doc_id, p.id, d.lang, length(CASE p.id WHEN 'r' THEN 'Read ' || d.doc_id || ': ' || substring(coalesce(d.text, ''), 1, 50) ELSE 'All ' || coalesce(d.text, '') END) AS n
  FROM documents d, (VALUES ('r'), ('a')) AS p(id)),
o AS (SELECT *, CASE n % 3 WHEN 0 THEN 'failed' ELSE 'success' END AS status, n % 6 = 3 AS call FROM a)"""


def deterministic_answers(batches):
    """In place of a model: an object with the length, or a failure that depends on it."""
    for batch in batches:
        n = batch["prompt"].str.len()
        answer = "The object is {\"chars\": " + n.astype(str) + "}."
        yield batch[["task_id"]].assign(response=answer.where(n % 3 != 0, "no object"), call_error=None).assign(
            call_error=(n % 6 == 3).map({True: "HTTP 503", False: None})
        )


@query("q_run_state", "", f"""
WITH {ASKED.strip()}
SELECT doc_id || '|' || id || '|m0' AS task_id, status, CAST(CASE WHEN status = 'failed' AND lang = 'en' THEN 3 WHEN status = 'failed' THEN 1 ELSE 0 END AS INTEGER) AS retries,
  CASE WHEN status = 'success' THEN '{{"chars": ' || n || '}}' END AS json,
  CASE WHEN status = 'failed' AND call THEN 'HTTP 503' WHEN status = 'failed' THEN 'JSON parse failed' END AS error FROM o""")
def run_state(t):
    """State after a run over the English documents and one over all, each with one retry: finished tasks are not asked again."""
    docs = t("documents").select(F.col("doc_id").cast("string").alias("rel_path"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    prompts = [tasks.Prompt("read", "r", "Read {document}: {content}", limit=50), tasks.Prompt("all", "a", "All {content}")]
    at = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    _, first = extraction_run(docs.where("lang = 'en'"), prompts, "m0", None, deterministic_answers, at(1), max_retries=1)
    _, second = extraction_run(docs, prompts, "m0", first, deterministic_answers, at(2), max_retries=1)
    return tasks.merge_state(first, second).select("task_id", "status", "retries", "json", "error")


@query("q_render_image_prompt", "f_markers", """
WITH s AS (SELECT *, last_value(CASE WHEN kind = 'image' THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS image FROM f_markers),
m AS (SELECT doc_id, image, coalesce(arg_min(value, pos) FILTER (WHERE kind = 'caption'), '') AS caption FROM s WHERE image IS NOT NULL GROUP BY 1, 2)
SELECT doc_id || '/' || image || '|f|m0' AS task_id, 'Figure ' || regexp_extract(image, '([0-9]+)\\.jpg', 1) || ' of ' || doc_id || ': ' || caption || ' {unknown}' AS prompt FROM m""")
def render_image_prompt(t):
    """Prompts of image tasks: the whole caption, the image's stem, the document's folder."""
    from scholia.operators.ordered import pair_captions

    path = F.concat(F.col("doc_id").cast("string"), F.lit("/text.md"))
    images = pair_captions(t("f_markers"), "doc_id").select(path.alias("rel_path"), "image", "caption")
    docs = images.select("rel_path").distinct().withColumn("text", F.lit("not used"))
    prompt = tasks.Prompt("figures", "f", "Figure {image_stem} of {doi_slug}: {content} {unknown}", limit=3, per_image=True)
    planned = tasks.plan_tasks(docs, [prompt], "m0", images)
    return render_tasks(planned, docs, [prompt]).select("task_id", "prompt")
