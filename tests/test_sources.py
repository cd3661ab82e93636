"""Files in, files out."""

import json

from pyspark.sql import functions as F

from scholia.operators.semi import flatten_catalogue
from scholia.operators.linkage import cache_lookup
from scholia.operators.reports import search_link
from scholia.plans.postproc import PostProcessing
from scholia.sources import corpus, sinks


def _write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")


def test_scan_and_exclude(spark, tmp_path):
    _write(tmp_path, {
        "a.md": "A\nB", "b.txt": "t", "c.pdf.txt": "p", "d.doc": "no", "sub/e e.md": "E",
        "draft/f.md": "F", "draft/deep/g.md": "G", "sub/h.tmp.md": "H",
    })
    found = corpus.scan_corpus(spark, str(tmp_path), [".md", ".txt"], exclude=["*/draft", "*.tmp.md"])
    rows = {r.rel_path: r for r in found.collect()}
    assert sorted(rows) == ["a.md", "b.txt", "c.pdf.txt", "sub/e e.md"]
    assert rows["a.md"].text == "A\nB"
    flat = corpus.scan_corpus(spark, str(tmp_path), [".md"], recursive=False)
    assert [r.rel_path for r in flat.collect()] == ["a.md"]
    good, bad = corpus.route_format(found.unionByName(found.filter("name = 'a.md'").withColumn("name", F.lit("x.doc"))))
    assert {r.name: r.reader for r in good.collect()} == {"a.md": "markdown", "b.txt": "text", "c.pdf.txt": "pdf_text", "e e.md": "markdown"}
    assert [r.name for r in bad.collect()] == ["x.doc"]


def test_hidden_files_are_read(spark, tmp_path):
    from scholia.sources.hidden import is_hidden

    _write(tmp_path, {"a.md": "A", "_b.md": "B", ".c.md": "C", "_x/d.md": "D", ".git/deep/e.md": "E", "s/_f.md": "F", "_k=v.md": "K", "_n.txt": "N", "draft/_g.md": "G"})
    found = corpus.scan_corpus(spark, str(tmp_path), [".md"], exclude=["*/draft"])
    assert {(r.rel_path, r.name, r.text) for r in found.collect()} == {
        ("a.md", "a.md", "A"), ("_b.md", "_b.md", "B"), (".c.md", ".c.md", "C"), ("_x/d.md", "d.md", "D"), (".git/deep/e.md", "e.md", "E"), ("s/_f.md", "_f.md", "F"), ("_k=v.md", "_k=v.md", "K"),
    }
    assert all(r.path == f"{tmp_path}/{r.rel_path}" for r in found.collect())
    flat = corpus.scan_corpus(spark, str(tmp_path), [".md"], recursive=False)
    assert sorted(r.rel_path for r in flat.collect()) == [".c.md", "_b.md", "_k=v.md", "a.md"]
    assert [is_hidden(n) for n in ("_metadata", "x._COPYING_", "a_b", "_a=1")] == [False, True, False, False]


def test_globs():
    import re

    cases = [("*/draft/*", "/p/draft/x/y.md", True), ("a?.md", "ab.md", True), ("[!a]*.md", "ab.md", False), ("[ab].md", "b.md", True), ("*.t+p", "x.t+p", True), ("a.md", "aXmd", False)]
    for pattern, path, want in cases:
        assert bool(re.match(corpus.glob_regex(pattern), path)) == want, pattern


def test_extractions_of_folders(spark, tmp_path):
    body = {"paper_metadata": {"title": " T ", "first_author": "not reported", "doi": "None"}}
    _write(tmp_path, {
        "Smith/derived/a_full_extraction.json": "{broken", "Smith/derived/b_full_extraction.json": json.dumps(body),
        "Smith/derived/c_full_extraction.json": json.dumps({"paper_metadata": {"title": "later"}}),
        "Wang/derived/other.json": json.dumps(body), "Wang/x_full_extraction.json": json.dumps(body),
    })
    found = corpus.load_extractions(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [("Smith", "T", "", "")]
    names = spark.createDataFrame([("Smith.pdf",), ("Wang.PDF",)], "pdf_name string")
    got = {tuple(r) for r in corpus.scan_entries(names, found).collect()}
    assert got == {("Smith.pdf", True, "T", "", ""), ("Wang.PDF", False, "", "", "")}


def test_bib_ids_and_maps(spark, tmp_path):
    bib = "@article{k1,\n title = {First},\n author = {Smith, John and Doe, A},\n DOI = {10.1/A}\n}\n@book{k2, title={No doi}}\n@misc{k3, title = {Again}, author = {M\\^uller~, Kai and X}, DOI = {10.1/a}}"
    _write(tmp_path, {"refs.bib": bib, "ids.txt": " 10.1/x \n\n10.1/y\n", "manual.json": '{"a.pdf": "10.1/z"}'})
    assert [tuple(r) for r in corpus.read_bib(spark, str(tmp_path / "refs.bib")).collect()] == [("10.1/a", "Again", "Muller")]
    assert [r.id for r in corpus.read_id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["10.1/x", "10.1/y"]
    assert [tuple(r) for r in corpus.read_manual_map(spark, str(tmp_path / "manual.json")).collect()] == [("a.pdf", "10.1/z")]


def test_cache_versions(spark, tmp_path):
    entry = {"a.pdf": {"doi": "10.1/a", "author": "A", "match": True, "note": "ok"}, "b.pdf": {"doi": ""}}
    _write(tmp_path, {"good.json": json.dumps({"version": 1, "entries": entry}), "old.json": json.dumps({"version": 999, "entries": {"x.pdf": {"doi": "10.x"}}}), "bad.json": "{ not valid json"})
    names = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("x.pdf",)], "pdf_name string")
    cache = corpus.read_cache(spark, str(tmp_path))
    got = {r.pdf_name: r.cached_doi for r in cache_lookup(names, cache, "pdf_name").collect()}
    assert got == {"a.pdf": "10.1/a", "b.pdf": None, "x.pdf": None}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s/a.md", "p", "m0", "{}"), ("t/b.md", "p", "m1", "{}")], "document_path string, prompt_name string, model_alias string, body string")
    sinks.write_extractions(rows, str(tmp_path / "flat"))
    back = spark.read.parquet(str(tmp_path / "flat")).filter("model_alias = 'm1'")
    assert [r.document_path for r in back.collect()] == ["t/b.md"]
    sinks.write_extractions(rows, str(tmp_path / "mirror"), layout="mirror", fmt="json")
    assert {p.parent.parent.name for p in (tmp_path / "mirror").glob("prompt_name=p/*/*/*.json")} == {"model_alias=m0", "model_alias=m1"}
    assert sorted((r.rel_dir, r.document_path) for r in sinks.read_merged(spark, str(tmp_path / "mirror"), "json").collect()) == [("s", "s/a.md"), ("t", "t/b.md")]
    sinks.write_csv(rows.select("document_path", "body"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    lines = spark.createDataFrame([(1, 2, "c"), (0, 1, "a"), (1, 1, "b")], "section int, pos int, line string")
    sinks.write_report(lines, str(tmp_path / "report"))
    parts = sorted((tmp_path / "report").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "a\nb\nc\n"


def test_catalogue_paths(spark):
    nested = {"value": {"paperSimpleSearchResult": {"pageResults": {"results": [{"doi": "10.1/a", "title": "<b>T</b>", "author": "A, B ,", "year": "2020", "isOa": False}]}}}}
    flat = {"results": [{"title": "U", "authorList": ["X"], "journalName": "J"}]}
    df = spark.createDataFrame([(1, json.dumps(nested)), (2, json.dumps(flat)), (3, "{}")], "id int, r string")
    got = {r.id: r for r in flatten_catalogue(df, "r").collect()}
    assert (got[1].doi, got[1].title, got[1].authors, got[1].year, got[1].is_oa, got[1].note) == ("10.1/a", "T", ["A", "B"], 2020, False, "ok")
    assert (got[2].title, got[2].authors, got[2].journal, got[2].note) == ("U", ["X"], "J", "no_doi")
    assert got[3].note == "not_found"


def test_search_link(spark):
    link = spark.range(1).select(search_link("https://example.org/?q=", F.lit("a b/c*~é"))).first()[0]
    assert link == "https://example.org/?q=a%20b/c%2A~%C3%A9"


def test_steps_do_not_stop_each_other(spark):
    steps = PostProcessing()
    steps.register("double")(lambda df: df.withColumn("id", F.col("id") * 2))
    steps.register("broken")(lambda df: df.select(F.raise_error(F.lit("no"))))
    steps.register("more")(lambda df: df.withColumn("id", F.col("id") + 1))
    out, outcomes = steps.run(spark.range(3), ["double", "broken", "missing", "more"], disabled=("other",))
    assert sorted(r.id for r in out.collect()) == [1, 3, 5]
    assert [(r.step, r.ok) for r in outcomes.collect()] == [("double", True), ("broken", False), ("missing", False), ("more", True)]
