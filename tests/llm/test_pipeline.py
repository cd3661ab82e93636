"""The corpus pipeline stage by stage."""

from __future__ import annotations

import corpus_pipeline
import __spark_entry__
from tests.llm.test_operators import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
            assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before}
        if name == "near_copies":
            groups = brute_groups([(r["doc_id"], r["text"]) for r in before])
            assert {r["doc_id"] for r in docs.collect()} == {root for _, root in groups.values()}
        if name == "mixing":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before} and docs.count() <= 2 * len(before)
    assert docs.count() and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)


def test_stages_without_ratings_or_languages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rated = {"none": labels.limit(0), "others": labels.withColumn("doc_id", labels.doc_id + 10**9)}
    for name, rows in rated.items():
        rows.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.keep_good(spark, docs, f"{tmp_path}/{name}").count() == 40
    assert corpus_pipeline.keep_known_languages(spark, docs, str(tmp_path)).count() == 40


def test_rows_of_one_id_with_unlike_texts_stay(spark):
    words = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    rows = [
        (1, words("a", 40), "en", "s", 1), (1, words("b", 40), "en", "s", 2), (1, words("b", 40), "en", "s", 2), (2, words("b", 40) + " tail", "en", "s", 3),
        (3, None, None, None, None), (3, "", "en", "s", 0), (None, words("a", 40), "en", "s", 4), (4, words("c", 40), "en", "s", 5), (5, words("c", 40), "en", "s", 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row_key", corpus_pipeline.F.lit(0)).withColumn("again", corpus_pipeline.F.lit(0))
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, [(1, rows[0][1]), (2, rows[3][1]), (3, None), (3, ""), (None, rows[6][1]), (4, rows[7][1])]))
    plain = corpus_pipeline.one_of_each_group(spark, docs.where("doc_id > 3"), SF)
    assert plain.columns == corpus_pipeline.COLUMNS and [r["doc_id"] for r in plain.collect()] == [4]


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_no_text_moves_for_the_copies_that_go(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        kept = corpus_pipeline.one_of_each_group(spark, docs, SF)
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" not in plan
