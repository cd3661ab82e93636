"""Extraction tasks: planning, running, outcomes, state, renaming plans."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scholia.functions.chunked import heavy_join
from scholia.functions.text import doi_to_file
from scholia.operators.semi import is_valid_object, repair_json
from scholia.session import cut_lineage

TASK_KEY = ["model_alias", "task_id"]
#: Tasks that an injected function gets at once.
BATCH_ROWS = 512
MAX_ERROR = 500


@dataclass(frozen=True)
class Prompt:
    """A prompt of a review; ``limit`` cuts the content, images get a task each."""

    name: str
    id: str
    template: str = "{content}"
    limit: int | None = None
    per_image: bool = False


def _prompt_column(prompts: Iterable[Prompt]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(p.name).alias("prompt_name"), F.lit(p.id).alias("prompt_id"),
                F.lit(p.template).alias("template"), F.lit(p.limit).cast("int").alias("limit"),
            )
            for p in prompts
        ]
    )


def plan_tasks(
    docs: DataFrame, prompts: list[Prompt], alias: str,
    images: DataFrame | None = None, existing: DataFrame | None = None,
) -> DataFrame:
    """One task per document and prompt, or per image of it that exists.

    ``docs(rel_path)``; ``images(rel_path, image, caption)`` with image paths
    relative to the document; ``existing(path)`` lists image files.
    """
    plain = [p for p in prompts if not p.per_image]
    visual = [p for p in prompts if p.per_image]
    parts = []
    if plain:
        rows = docs.select(F.col("rel_path").alias("document"), F.explode(_prompt_column(plain)).alias("p"))
        parts.append(
            rows.select(
                "document", F.col("document").alias("rel_path"), "p.prompt_name", "p.prompt_id",
                F.lit(None).cast("string").alias("caption"),
            )
        )
    if visual and images is not None:
        folder = F.regexp_replace("rel_path", r"[^/]*$", "")
        placed = images.select(
            F.col("rel_path").alias("document"), F.concat(folder, "image").alias("rel_path"),
            F.coalesce("caption", F.lit("")).alias("caption"),
        )
        if existing is not None:
            placed = placed.join(existing.select(F.col("path").alias("rel_path")), "rel_path", "left_semi")
        rows = placed.select("document", "rel_path", "caption", F.explode(_prompt_column(visual)).alias("p"))
        parts.append(rows.select("document", "rel_path", "p.prompt_name", "p.prompt_id", "caption"))
    tasks = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    task_id = F.concat_ws("|", "rel_path", "prompt_id", F.lit(alias))
    return (
        tasks.withColumn("model_alias", F.lit(alias))
        .withColumn("task_id", task_id)
        .dropDuplicates(TASK_KEY)
    )


def preview(docs: DataFrame, prompts: list[Prompt], alias: str, n: int = 5) -> DataFrame:
    """The tasks of the first n documents in path order."""
    return plan_tasks(docs.orderBy("rel_path").limit(n), prompts, alias)


def merge_state(old: DataFrame, new: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Last write per task; at equal times the new row wins."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in rows.columns if c not in (*TASK_KEY, "_new")]
    latest = F.max_by(F.struct(*rest), F.struct(*(order or ["ts"]), "_new"))
    return rows.groupBy(*TASK_KEY).agg(latest.alias("_s")).select(*TASK_KEY, "_s.*")


def latest_state(state: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Last row per task of a state log."""
    rest = [c for c in state.columns if c not in TASK_KEY]
    latest = F.max_by(F.struct(*rest), F.struct(*(order or ["ts"])))
    return state.groupBy(*TASK_KEY).agg(latest.alias("_s")).select(*TASK_KEY, "_s.*")


def skip_completed(tasks: DataFrame, state: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Tasks whose latest status is not success; failed ones are planned again."""
    done = latest_state(state, order).filter(F.col("status") == "success").select(*TASK_KEY)
    return tasks.join(done, TASK_KEY, "left_anti")


def failed_tasks(state: DataFrame, alias: str | None = None) -> DataFrame:
    failed = state.filter(F.col("status") == "failed")
    return failed if alias is None else failed.filter(F.col("model_alias") == alias)


def reset_failed(state: DataFrame, alias: str, ids: DataFrame | None = None) -> DataFrame:
    """State without the failed tasks of a model, all or only the given ones."""
    gone = failed_tasks(state, alias).select(*TASK_KEY)
    if ids is not None:
        gone = gone.join(ids.select("task_id"), "task_id", "left_semi")
    return state.join(gone, TASK_KEY, "left_anti")


def reset_model(state: DataFrame, alias: str) -> DataFrame:
    return state.filter(F.col("model_alias") != alias)



def run_batch(tasks: DataFrame, fn: Callable, schema: str, partitions: int | None = None) -> DataFrame:
    """Applies a function over batches of tasks; the caller supplies it.

    ``partitions`` sets how many run at the same time. The function gets at most ``BATCH_ROWS``
    tasks at once, so that a worker holds few prompts, which may be whole texts, as Python objects.
    """
    if partitions:
        tasks = tasks.repartition(partitions, "task_id")
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(at, BATCH_ROWS).to_pandas() for b in batches for at in range(0, b.num_rows, BATCH_ROWS))
        for found in fn(parts):
            yield pa.RecordBatch.from_pandas(found, schema=made, preserve_index=False)

    return tasks.mapInArrow(run, schema)


_RETRIABLE = r"(?i)\b(429|5\d\d)\b|time.?out|rate.?limit|connection|overloaded"


def route_outcomes(responses: DataFrame) -> DataFrame:
    """Adds ``json, status, error, reason`` to answered tasks.

    ``responses(task_id, response, call_error)``.  A call error is permanent
    unless it looks temporary; an answer without a usable object may be retried.
    """
    rows = repair_json(responses, "response")
    ok = F.col("call_error").isNull() & is_valid_object(F.col("json"))
    error = (
        F.when(F.col("call_error").isNotNull(), F.substring("call_error", 1, MAX_ERROR))
        .when(F.col("json").isNull(), "JSON parse failed")
        .otherwise("Schema validation failed")
    )
    retry = F.col("call_error").isNull() | F.col("call_error").rlike(_RETRIABLE)
    rows = rows.withColumn("_ok", ok)
    return rows.select(
        *responses.columns,
        F.when(F.col("_ok"), F.col("json")).alias("json"),
        F.when(F.col("_ok"), "success").otherwise("failed").alias("status"),
        F.when(~F.col("_ok"), error).alias("error"),
        F.when(~F.col("_ok"), F.when(retry, "retriable").otherwise("permanent")).alias("reason"),
    )


# --- renaming, as plan tables -------------------------------------------------


def rename_plan(results: DataFrame, existing: DataFrame, key: str = "pdf_name") -> DataFrame:
    """What to do with every matched file: skip, keep, drop as duplicate, rename.

    ``results(pdf_name, cr_doi, match)``; ``existing(file_name)`` are the files
    present.  Files that are gone give no row.
    """
    present = existing.select("file_name").distinct()
    matched = cut_lineage(results.filter(F.col("match") & F.col("cr_doi").isNotNull()).select(key, "cr_doi"))
    # what depends on the DOI alone is found once per DOI
    claims = matched.groupBy("cr_doi").agg((F.count("*") > 1).alias("_shared"))
    claims = claims.withColumn("target", F.concat(doi_to_file(F.col("cr_doi")), F.lit(".pdf")))
    taken = present.select(F.col("file_name").alias("target"), F.lit(True).alias("_taken"))
    rows = cut_lineage(heavy_join(matched, claims.join(taken, "target", "left"), ["cr_doi"]))
    # a file is left alone when any of its DOIs is shared
    held = rows.groupBy(key).agg(F.bool_or("_shared").alias("_held"))
    here = present.withColumnRenamed("file_name", key).join(held, key)
    rows = heavy_join(rows, here, [key])
    action = (
        F.when(F.col("_held"), "skip_conflict")
        .when(F.col(key) == F.col("target"), "already_named")
        .when(F.col("_taken"), "dedup")
        .otherwise("rename")
    )
    return rows.select(key, "cr_doi", "target", action.alias("action"))


def gated_rename_plan(doi_map: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Matched rows only; unverified ones are blocked unless forced."""
    rows = doi_map.filter(F.col("status") == "matched")
    rows = rows.withColumn("target", F.concat(doi_to_file(F.col("doi")), F.lit(".pdf")))
    taken = existing.select(F.col("file_name").alias("target"), F.lit(True).alias("_taken")).distinct()
    rows = heavy_join(rows, taken, ["target"], "left")
    blocked = F.lit(not force) & F.coalesce(~F.col("verified"), F.lit(False))
    action = F.when(blocked, "blocked").when(F.col("_taken"), "skip_exists").otherwise("rename")
    return rows.select("pdf_name", "doi", "target", action.alias("action"))


def record_history(cache: DataFrame, plan: DataFrame, at: Column) -> DataFrame:
    """Cache rows with the new name and time of the files that were renamed."""
    done = plan.filter(F.col("action").isin("rename", "dedup")).select(
        "pdf_name", F.col("target").alias("_to"), at.alias("_at")
    )
    rows = cache.join(done, "pdf_name", "left")
    keep = lambda c, new: F.coalesce(new, F.col(c)) if c in cache.columns else F.col(new)
    return rows.select(
        *[c for c in cache.columns if c not in ("renamed_to", "renamed_at")],
        keep("renamed_to", "_to").alias("renamed_to"),
        keep("renamed_at", "_at").alias("renamed_at"),
    )
