"""Inputs that once gave wrong, incomplete or size-dependent answers, with literal results."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import chunked
from scholia.operators import identifiers, includes, ordered, pages, semi
from scholia.sources.sinks import write_extractions
from scholia.vocab import FILENAME_COMMON_WORDS


def test_too_is_no_author():
    assert "too" in FILENAME_COMMON_WORDS


def test_parent_folders_at_any_depth(spark):
    deep = "a/" * 12 + "../" * 12 + "b.tex"
    rows = spark.createDataFrame([(deep,), ("./x/./y/../z.tex",), ("../up.tex",), ("/../root.tex",), ("a/../../b.tex",)], "p string")
    got = [r[0] for r in rows.select(includes._normal(F.col("p"))).collect()]
    assert got == ["b.tex", "x/z.tex", "../up.tex", "/../root.tex", "../b.tex"]


def test_image_on_a_caption_line(spark):
    text = "Figure 1. A cell ![x](images/a.png)\nFigure 2. Next\n![y](images/b.png)"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r["kind"], r["value"]) for r in ordered.caption_markers(rows, "doc_id", "text").orderBy("pos").collect()]
    assert [v for k, v in got if k == "image"] == ["images/a.png", "images/b.png"]
    assert [k for k, _ in got].count("caption") == 2


def test_pages_lost_at_the_end_and_without_content(spark):
    rows = spark.createDataFrame([(1, 0, "one", True), (1, 1, None, True)], "doc_id long, page_idx int, content string, success boolean")
    totals = spark.createDataFrame([(1, 3), (2, 1)], "doc_id long, total int")
    got = {r["doc_id"]: (r["text"], r["pages"]) for r in pages.assemble_pages(rows, totals=totals).collect()}
    assert got[1][1] == 3 and got[1][0].startswith("one\n\n") and "Page 1: Missing" in got[1][0] and "Page 2: Missing" in got[1][0]
    assert "Page 0: Missing" in got[2][0]
    done = {r["doc_id"]: (r["received"], r["total"], r["done"]) for r in pages.page_completeness(rows.where("page_idx = 0"), totals).collect()}
    assert done == {1: (1, 3, False), 2: (0, 1, False)}


def test_blank_chapters_go(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "\n \n"), (1, 2, "b")], "doc_id long, pos int, text string")
    assert [r["text"] for r in pages.assemble_chapters(rows).collect()] == ["a\n\n---\n\nb"]


def test_events_without_time_or_key_stay(spark):
    rows = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", None), (None, "2024-01-01 00:00:00")], "u string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = ordered.rate_audit(rows, "u", "t", 5, 60).collect()
    assert len(got) == 3 and sorted(str(r["in_window"]) for r in got) == ["1", "None", "None"]


def test_json_repair_in_the_jvm(spark):
    texts = ['{"a":"}"} then {broken}', "[1, 2] is all ].", "none", 'x {"a": {"b": 1}} y {"c"', "```json\n{\"k\": 1}\n```", None, "{ [3]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, r string")
    out = semi.repair_json(rows, "r")
    assert {r["i"]: r["json"] for r in out.collect()} == {0: '{"a":"}"}', 1: "[1, 2]", 2: None, 3: '{"a": {"b": 1}}', 4: '{"k": 1}', 5: None, 6: "[3]"}
    assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()


def test_json_repair_takes_linear_time(spark):
    import time

    quote, slash = '"', "\\"
    bodies = {
        "escapes": ("{" + quote + slash * 300_001, None), "quotes": ("{" + quote + (slash + quote) * 300_000, None), "braces": ("{" * 500_000, None),
        "lists": ("[" * 200_000 + "x" + "]" * 200_000 + "{", None), "items": ('{"a": [' + '{"k": "v {x} \\" y"}, ' * 40_000, None),
        "whole": ('noise {"a": [' + '{"k": "v {x} \\" y"}, ' * 40_000 + "1]} } tail {", 3),
    }
    rows = spark.createDataFrame([(k, v[0]) for k, v in bodies.items()], "k string, r string").repartition(1)
    semi.repair_json(rows.limit(0), "r").collect()
    start = time.perf_counter()
    got = {r["k"]: r["tier"] for r in semi.repair_json(rows, "r").select("k", "tier").collect()}
    assert got == {k: v[1] for k, v in bodies.items()}
    assert time.perf_counter() - start < 30  # six texts of about a megabyte; quadratic work takes hours


def test_marks_in_strings_do_not_end_a_value(spark):
    texts = ['{"a":"\\"}"} {', '{"a\\\\":1} }{', 'x ["[\\"", {"b":"]"}] tail ]', "{'a': 1} {", '{"a": "open } {', "[1, [2]] {"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, r string")
    got = {r["i"]: r["json"] for r in semi.repair_json(rows, "r").collect()}
    assert got == {0: '{"a":"\\"}"}', 1: '{"a\\\\":1}', 2: '{"b":"]"}', 3: None, 4: None, 5: "[1, [2]]"}


def test_nodes_and_lists_at_any_depth(spark):
    lists, objects = lambda n: "[" * n + '1,"x"' + "]" * n, lambda n: '{"a":' * n + "7" + "}" * n
    rows = [(1, lists(13)), (2, lists(200)), (3, objects(13)), (4, objects(200)), (5, '{"t":[["a",["b"]],[],"c"]}'), (6, "broken"), (7, None)]
    df = spark.createDataFrame(rows, "i int, b string")
    got = {r["i"]: (r["n"], r["d"]) for r in semi.leaves(df, ["i"], "b").groupBy("i").agg(F.count("*").alias("n"), F.max("depth").alias("d")).collect()}
    assert got == {1: (14, 13), 2: (201, 200), 3: (13, 13), 4: (200, 200), 5: (7, 4)}
    flat = {r["i"]: r["v"] for r in df.select("i", semi.clean_values(F.array(semi.parse(F.col("b")))).alias("v")).collect()}
    assert flat[2] == ["1", "x"] and flat[4] == [] and flat[6] == []
    # a key search still ends where its bound is
    assert semi.find_key_rows(semi.leaves(df, ["i"], "b"), "a").count() == 2
    chain = spark.createDataFrame([(1, '{"b":' * 11 + '{"k":1}' + "}" * 11), (2, '{"b":' * 10 + '{"k":1}' + "}" * 10)], "i int, b string")
    assert [r["i"] for r in semi.find_key_rows(semi.leaves(chain, ["i"], "b"), "k").collect()] == [2]


def test_rerun_replaces_results(spark, tmp_path):
    rows = spark.createDataFrame([("d", "p", "m", "{}")], "document_path string, prompt_name string, model_alias string, body string")
    for _ in range(2):
        write_extractions(rows, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 1


def test_results_of_other_documents_stay(spark, tmp_path):
    schema, path = "document_path string, prompt_name string, model_alias string, body string", str(tmp_path / "x")

    def run(*rows):
        write_extractions(spark.createDataFrame(list(rows), schema), path, buckets=4)
        return {(r.document_path, r.prompt_name, r.model_alias): r.body for r in spark.read.parquet(path).collect()}

    run(*[(f"d{i}", "p", "m", "old") for i in range(20)], ("d1", "q", "m", "q"))
    got = run(("d1", "p", "m", "new"), ("d99", "p", "m", "new"), ("d1", "p", "n", "n"))
    assert got == {(f"d{i}", "p", "m"): "old" for i in range(20) if i != 1} | {
        ("d1", "q", "m"): "q", ("d1", "p", "m"): "new", ("d99", "p", "m"): "new", ("d1", "p", "n"): "n",
    }
    assert len(run()) == 23  # a run without rows changes nothing


def test_hot_key_is_cut_without_one_task_holding_it(spark):
    left = spark.range(4000).select((F.col("id") % 1000 * (F.col("id") % 4 == 0).cast("int")).alias("k"), F.col("id").alias("a"))
    right = spark.range(400).select((F.col("id") % 2 * F.col("id")).alias("k"), F.col("id").alias("b"))
    cut = chunked.chunked_join(left, right, "k", "a", "b", chunk=64)
    want = left.join(right, "k")
    assert cut.count() == want.count() == cut.distinct().count() and cut.select("k", "a", "b").exceptAll(want).isEmpty()
