"""Functions that callers supply get batches of bounded size."""

from pyspark.sql import functions as F

from scholia.operators.tasks import BATCH_ROWS, run_batch


def test_injected_functions_get_few_tasks_at_once(spark):
    tasks = spark.range(3 * BATCH_ROWS + 7).select(F.col("id").cast("string").alias("task_id"), F.lit("x").alias("prompt")).coalesce(1)

    def sizes(batches):
        for batch in batches:
            # an order of columns of its own, an index, a null
            made = batch[["task_id"]].assign(error=None, n=len(batch))[["n", "task_id", "error"]]
            made.index = made.index + 5
            yield made

    rows = run_batch(tasks, sizes, "task_id string, n long, error string").collect()
    assert sorted(int(r["task_id"]) for r in rows) == list(range(3 * BATCH_ROWS + 7))
    assert {r["n"] for r in rows} == {BATCH_ROWS, 7} and {r["error"] for r in rows} == {None}
    assert run_batch(tasks.limit(0), sizes, "task_id string, n long, error string").count() == 0
