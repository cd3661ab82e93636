"""Streams against the batch operators."""

import pandas as pd
from pyspark.sql import functions as F

from scholia.operators.tasks import Prompt, latest_state
from scholia.operators.ordered import rate_audit
from scholia.streaming.incremental import corpus_stream, exact_rate_stream, ingest, latest_state_stream, rate_stream, read_state

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
SF_DIR = "/root/testdata/sf0.001"


def _events(spark):
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(SF_DIR)


def _drain(df, spark, mode, name):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def _ask(batches):
    """Deterministic answers: fenced JSON, and a failure for texts that say so."""
    for batch in batches:
        bad = batch["prompt"].str.contains("bad")
        answer = "```json\n{\"chars\": " + batch["prompt"].str.len().astype(str) + "}\n```"
        yield pd.DataFrame({
            "task_id": batch["task_id"], "response": answer.where(~bad, "no json"), "call_error": None,
        })


def test_only_new_documents_are_asked(spark, tmp_path):
    root, state, check = tmp_path / "docs", str(tmp_path / "state"), str(tmp_path / "check")
    root.mkdir()
    prompts = [Prompt("meta", "1", "Read {content}", limit=3), Prompt("full", "2")]

    def run():
        docs = corpus_stream(spark, str(root), ".md")
        ingest(docs, prompts, "m0", _ask, state, check).awaitTermination()
        return {(r.task_id, r.batch): r for r in read_state(spark, state).collect()}

    (root / "a.md").write_text("hello")
    (root / "b.md").write_text("bad")
    first = run()
    assert {k: r.status for k, r in first.items()} == {
        ("a.md|1|m0", 0): "success", ("a.md|2|m0", 0): "success", ("b.md|1|m0", 0): "failed", ("b.md|2|m0", 0): "failed",
    }
    assert first["a.md|1|m0", 0].json == '{"chars": 8}'
    (root / "c.md").write_text("new")
    second = run()
    assert {k for k in second if k[1] == 1} == {("c.md|1|m0", 1), ("c.md|2|m0", 1)}
    assert len(second) == 6


def test_failed_tasks_are_asked_again_and_counted(spark, tmp_path):
    root, state, results = tmp_path / "docs", str(tmp_path / "state"), str(tmp_path / "results")
    root.mkdir()
    prompts = [Prompt("meta", "1", "{content}")]

    def run(check):
        docs = corpus_stream(spark, str(root), ".md")
        ingest(docs, prompts, "m0", _ask, state, str(tmp_path / check), results, max_retries=2).awaitTermination()
        rows = {r.task_id.split("|")[0]: (r.status, r.retries) for r in read_state(spark, state).collect()}
        return rows, {r.document_path: r.body for r in spark.read.parquet(results).collect()}

    (root / "a.md").write_text("fine")
    (root / "b.md").write_text("bad")
    rows, made = run("c")
    assert rows == {"a.md": ("success", 0), "b.md": ("failed", 2)} and made == {"a.md": '{"chars": 4}'}
    (root / "b.md").write_text("now fine")
    (root / "b2.md").write_text("new")
    # a stream of its own sees the changed file; the state says what is done
    (tmp_path / "state/log").rename(tmp_path / "state/log1")
    rows, made = run("d")
    assert rows == {"a.md": ("success", 0), "b.md": ("success", 3), "b2.md": ("success", 0)}
    assert made == {"a.md": '{"chars": 4}', "b.md": '{"chars": 8}', "b2.md": '{"chars": 3}'}


def test_a_repeated_batch_asks_nothing_again(spark, tmp_path):
    import shutil

    root, state, check = tmp_path / "docs", str(tmp_path / "state"), tmp_path / "check"
    root.mkdir()
    (root / "a.md").write_text("bad")
    calls = spark.sparkContext.accumulator(0)

    def ask(batches):
        for batch in batches:
            calls.add(len(batch))
            yield from _ask([batch])

    def run():
        ingest(corpus_stream(spark, str(root), ".md"), [Prompt("meta", "1")], "m0", ask, state, str(check)).awaitTermination()
        return [(r.task_id, r.status, r.retries) for r in read_state(spark, state).collect()]

    first = run()
    assert calls.value == 1
    shutil.rmtree(check / "commits")  # as if the batch had not been finished
    assert run() == first == [("a.md|1|m0", "failed", 0)] and calls.value == 1


def test_latest_state_equals_batch(spark):
    def state(df):
        return df.select(
            F.lit("m0").alias("model_alias"), F.col("user_id").cast("string").alias("task_id"),
            F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        )

    streamed = _drain(latest_state_stream(state(_events(spark)), ["ts", "event_id"]), spark, "complete", "latest")
    batch = latest_state(state(spark.read.parquet(f"{SF_DIR}/events.parquet")), ["ts", "event_id"])
    assert {tuple(r) for r in streamed.collect()} == {tuple(r) for r in batch.collect()}


def test_rate_windows_equal_batch(spark):
    streamed = _drain(rate_stream(_events(spark), "user_id", "ts", 86400, 43200, "1 day", 2), spark, "append", "rates")
    rows = spark.read.parquet(f"{SF_DIR}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    counts = rows.groupBy("user_id", F.window("at", "86400 seconds", "43200 seconds").alias("w")).count()
    want = {(r.user_id, r.w.start, r["count"]) for r in counts.collect()}
    got = {(r.user_id, r.window_start, r.in_window) for r in streamed.collect()}
    closed = max(w for _, w, _ in got)
    assert got == {x for x in want if x[1] <= closed} and len(got) > 100


def test_hidden_files_stream_once(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "_in").mkdir(parents=True)

    def run():
        query = corpus_stream(spark, str(root), ".md", files_per_batch=1).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/n={n}")))
        query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.rel_path, r.text) for r in spark.read.schema("rel_path string, text string, n long").parquet(str(tmp_path / "out")).collect())

    (root / "a.md").write_text("A")
    (root / "_b.md").write_text("B")
    (root / "_in/c.md").write_text("C")
    assert run() == [("_b.md", "B"), ("_in/c.md", "C"), ("a.md", "A")]
    (root / ".d.md").write_text("D")
    assert run() == [(".d.md", "D"), ("_b.md", "B"), ("_in/c.md", "C"), ("a.md", "A")]


def test_exact_rates_equal_batch_with_late_rows(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source = tmp_path / "in"
    # three files in turn; b's rows come late, but within the ten seconds that are waited for; the last file ends all windows
    files = [
        [("a", 0.0), ("a", 3.0), ("a", 3.0), ("b", 12.0), (None, 1.0), ("a", None)],
        [("a", 9.999999), ("b", 5.5), ("a", 10.0), ("b", 21.0)],
        [("a", 13.0), ("b", 14.0), ("b", 12.0), ("a", 60.0)],
        [("z", 500.0)],
    ]
    schema = "k string, s double, x int"
    try:
        got = []
        for number, rows in enumerate(files):
            part = spark.createDataFrame([(k, s, 1) for k, s in rows], schema)
            part.coalesce(1).write.mode("append").parquet(str(source))
            events = spark.readStream.schema(schema).parquet(str(source)).select("k", F.expr("timestamp_micros(cast(round((s + 1000) * 1000000) as bigint))").alias("ts"))
            out = exact_rate_stream(events, "k", "ts", 10, "10 seconds", 2)
            query = out.writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).outputMode("append")
            query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        every = spark.createDataFrame([(k, s) for rows in files for k, s in rows if k and s is not None and k != "z"], "k string, s double")
        batch = rate_audit(every.select("k", F.expr("timestamp_micros(cast(round((s + 1000) * 1000000) as bigint))").alias("ts")), "k", "ts", 2, 10)
        want = batch.groupBy("k", "ts", "in_window", "over_limit").count()
        assert sorted((r.k, r.ts, r.events, r.in_window, r.over_limit) for r in got) == sorted((r.k, r.ts, r["count"], r.in_window, r.over_limit) for r in want.collect())
        assert any(r.over_limit for r in got)
    finally:
        spark.conf.unset(provider)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
