"""The extraction run: documents to tasks, answers, results and state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.operators.markup import render_prompt
from scholia.operators.tasks import TASK_KEY, Prompt, latest_state, plan_tasks, route_outcomes, run_batch, skip_completed
from scholia.session import cut_lineage

ANSWER = "task_id string, response string, call_error string"


def image_values() -> dict[str, Column]:
    """Template values of image tasks: file stem of the image, folder of the document."""
    stem = F.regexp_replace(F.regexp_extract("rel_path", r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    folder = F.regexp_extract("document", r"([^/]*)/[^/]*$", 1)
    return {"image_stem": stem, "doi_slug": folder}


def render_tasks(tasks: DataFrame, docs: DataFrame, prompts: list[Prompt]) -> DataFrame:
    """Adds the rendered prompt; image tasks get the caption as content.

    The content of image tasks is not cut, and their templates also know
    ``{image_stem}`` and ``{doi_slug}``.
    """
    content = F.coalesce("caption", "text")
    cases: Column | None = None
    for p in prompts:
        values = {"document": F.col("document")} | (image_values() if p.per_image else {})
        case = render_prompt(F.lit(p.template), content, values, None if p.per_image else p.limit)
        hit = F.col("prompt_id") == p.id
        cases = F.when(hit, case) if cases is None else cases.when(hit, case)
    texts = docs.select(F.col("rel_path").alias("document"), "text")
    # only documents with something to ask send their text
    texts = texts.join(tasks.select("document").distinct(), "document", "left_semi")
    rows = tasks.join(texts, "document")
    return rows.withColumn("prompt", cases).drop("text")


def extraction_run(
    docs: DataFrame, prompts: list[Prompt], alias: str, state: DataFrame | None, ask: Callable,
    at: Column, partitions: int | None = None, max_retries: int = 0, images: DataFrame | None = None, existing: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Tasks and new state rows of one run over the documents not yet done.

    ``ask`` maps batches of ``(task_id, prompt)`` to :data:`ANSWER` rows.  The
    answers are kept at once: nothing later asks a second time, also not after
    an executor was lost.  Answers that may be retried are asked again up to
    ``max_retries`` times; ``retries`` counts those and the earlier runs that failed.
    """
    tasks = plan_tasks(docs, prompts, alias, images, existing)
    if state is not None:
        tasks = skip_completed(tasks, state)
    asked = cut_lineage(render_tasks(tasks, docs, prompts))
    open_, judged = asked.select("task_id", "prompt"), None
    for retry in range(max_retries + 1):
        answers = cut_lineage(run_batch(open_, ask, ANSWER, partitions))
        round_ = cut_lineage(answers_with_state(answers, alias, at).withColumn("retries", F.lit(retry)))
        again = round_.where("reason = 'retriable'").select("task_id")
        if retry == max_retries or again.isEmpty():
            judged = round_ if judged is None else judged.unionByName(round_)
            break
        done = round_.join(again, "task_id", "left_anti")
        judged = done if judged is None else judged.unionByName(done)
        open_ = asked.select("task_id", "prompt").join(again, "task_id", "left_semi")
    if state is not None:
        # a task that failed before was asked once more than its row says
        before = latest_state(state).where("status = 'failed'").select(*TASK_KEY, (F.coalesce("retries", F.lit(0)) + 1).alias("_before"))
        judged = judged.join(before, TASK_KEY, "left").withColumn("retries", F.col("retries") + F.coalesce("_before", F.lit(0))).drop("_before")
    return asked.drop("prompt"), judged


def answers_with_state(answers: DataFrame, alias: str, at: Column) -> DataFrame:
    """Judged answers with the columns of the task state."""
    return route_outcomes(answers).select(
        F.lit(alias).alias("model_alias"), "task_id", "json", "status",
        F.lit(0).alias("retries"), at.alias("ts"), "error", "reason",
    )
