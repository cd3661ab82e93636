"""Incremental ingest, latest task state and rate audit as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholia.operators.tasks import TASK_KEY, Prompt
from scholia.plans.extraction import extraction_run
from scholia.sources.corpus import exclude_globs, plain_path
from scholia.sources.hidden import hidden_texts
from scholia.sources.sinks import merge_rows, path_exists, read_merged, write_extractions
from scholia.streaming.windows import WindowCounts

STATE_SCHEMA = (
    "model_alias string, task_id string, json string, status string, retries int, "
    "ts timestamp, error string, reason string, batch bigint"
)


def corpus_stream(
    spark: SparkSession, root: str, extension: str | list[str], exclude: list[str] | None = None, files_per_batch: int = 1000,
    hidden: bool = True,
) -> DataFrame:
    """New files below a folder as ``rel_path, text``, bounded per batch; hidden ones as well."""
    root = root.rstrip("/")
    extensions = [extension] if isinstance(extension, str) else extension
    raw = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{" + ",".join(f"*{e}" for e in extensions) + "}")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
        .select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
    )
    rel = raw.select(F.expr(f"substring(path, {len(root) + 2})").alias("rel_path"), "text")
    if hidden:
        rel = rel.unionByName(hidden_texts(spark, root, extensions, stream=True, files_per_batch=files_per_batch))
    return exclude_globs(rel, exclude or [], root)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of every task, as :func:`ingest` keeps it."""
    return read_merged(spark, f"{path.rstrip('/')}/latest", schema=STATE_SCHEMA)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All answers that :func:`ingest` ever got, by batch."""
    return spark.read.schema(STATE_SCHEMA).parquet(f"{path.rstrip('/')}/log")


def ingest(
    docs: DataFrame, prompts: list[Prompt], alias: str, ask: Callable, state_path: str, checkpoint: str,
    results_path: str | None = None, max_retries: int = 0,
) -> StreamingQuery:
    """Runs the extraction on every batch of new documents until none are left.

    A batch reads the latest state of its tasks, one row each however many batches
    there were. It writes its answers to the log under its own number, merges them
    into the state, and its objects into the results. A batch repeated after a failure
    finds its own answers in the log and asks no task twice.
    """
    root = state_path.rstrip("/")

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = f"{root}/log/batch={number}"
        earlier = read_state(spark, root) if path_exists(spark, f"{root}/latest") else None
        if not path_exists(spark, f"{log}/_SUCCESS"):
            tasks, rows = extraction_run(batch, prompts, alias, earlier, ask, F.current_timestamp(), max_retries=max_retries)
            named = rows.join(tasks.select("task_id", F.col("rel_path").alias("document_path"), "prompt_name"), "task_id")
            named.write.mode("overwrite").parquet(log)
        answers = spark.read.parquet(log)
        state = answers.withColumn("batch", F.lit(number).cast("bigint"))
        merge_rows(state.select(*[c.split()[0] for c in STATE_SCHEMA.split(", ")]), f"{root}/latest", TASK_KEY, ["model_alias"], ["ts"])
        if results_path:
            good = answers.where("status = 'success'").select("document_path", "prompt_name", "model_alias", F.col("json").alias("body"))
            write_extractions(good, results_path)

    return (
        docs.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_state_stream(state: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Latest status per task of a state stream; write it in update mode."""
    rest = [c for c in state.columns if c not in TASK_KEY]
    latest = F.max_by(F.struct(*rest), F.struct(*(order or ["ts"])))
    return state.groupBy(*TASK_KEY).agg(latest.alias("_s")).select(*TASK_KEY, "_s.*")


def rate_stream(
    events: DataFrame, key: str, ts: str, seconds: int, slide: int, late: str, limit: int
) -> DataFrame:
    """Events per key and sliding window; rows later than ``late`` are dropped.

    The windows start at multiples of ``slide``; ``exact_rate_stream`` has the
    exact count at every event.
    """
    rows = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    window = F.window("_at", f"{seconds} seconds", f"{slide} seconds")
    counts = rows.groupBy(key, window.alias("w")).agg(F.count("*").alias("in_window"))
    return counts.select(
        key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "in_window", (F.col("in_window") > limit).alias("over_limit"),
    )



def exact_rate_stream(events: DataFrame, key: str, ts: str, seconds: int, late: str, limit: int) -> DataFrame:
    """Events of the key in ``(ts - seconds, ts]`` at every time of an event, as the batch operator ``rate_audit`` has it.

    Returns ``key, ts, events, in_window, over_limit`` in append mode, one row for each key and
    time; ``events`` happened at that time. A time is answered once the watermark has
    passed it, so rows in any order count as long as they are not later than ``late``, and later ones
    are dropped by Spark. A key keeps a number for each time that is not answered or may
    still be in the window of one, and one timer. Rows without key or time are left out. The session
    must use the RocksDB state store, as keyed state with timers needs it.
    """
    rows = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("at")).where("key IS NOT NULL AND at IS NOT NULL")
    # the time comes twice: Spark takes the marked column for its watermark, the state wants microseconds
    rows = rows.withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
    kind = rows.schema["key"].dataType.simpleString()
    answers = rows.groupBy("key").transformWithStateInPandas(
        WindowCounts(seconds), f"key {kind}, micros bigint, events bigint, in_window bigint", "append", "eventtime"
    )
    return answers.select(
        F.col("key").alias(key), F.timestamp_micros("micros").alias(ts), "events", "in_window", (F.col("in_window") > limit).alias("over_limit"),
    )
