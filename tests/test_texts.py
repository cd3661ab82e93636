"""LaTeX, JSON and page operators on written examples and generated texts."""

import random
import time

from pyspark.sql import functions as F

from scholia.operators import includes, semi, tex
from scholia.operators.markup import clean_layout, html_to_text, render_prompt
from scholia.operators.pages import assemble_pages


def _stack_spans(text):
    """Outermost matched environments by a stack, for comparison."""
    import re

    stack, spans = [], []
    for m in re.finditer(r"\\(begin|end)\{(\w+)\*?\}", text):
        if m[1] == "begin":
            stack.append((m[2], m.start()))
        elif stack and stack[-1][0] == m[2]:
            name, start = stack.pop()
            spans = [s for s in spans if s[1] < start] + [(name, start, m.end())]
    return spans


def test_spans_agree_with_a_stack(spark):
    rng = random.Random(6)
    parts = [r"\begin{a}", r"\end{a}", r"\begin{b*}", r"\end{b*}", "x", "yy ", r"\end{c}"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", tex.environment_spans(F.col("t")).alias("s")).collect():
        assert [tuple(s) for s in row.s] == _stack_spans(row.t), row.t


def test_spans_and_arguments_of_long_texts(spark):
    """Many runs of the fold: outer environments that close in later runs, calls that cross runs, linear time."""
    rng = random.Random(8)
    parts = [r"\begin{a}", r"\end{a}", r"\begin{b*}", r"\end{b*}", "x", "yy "]
    texts = ["".join(rng.choice(parts) for _ in range(3000)) for _ in range(3)] + [r"\begin{o}" + r"\begin{a}\end{a}" * 900 + r"\end{o}\begin{a}\end{a}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", tex.environment_spans(F.col("t")).alias("s")).collect():
        assert [tuple(s) for s in row.s] == _stack_spans(row.t)
    long = r"\t{" + "{x}" * 700 + "} mid " + r"\t{y} z " * 5000 + "p" * 900_000
    start = time.monotonic()
    got = spark.createDataFrame([(long,)], "t string").select(tex.balanced(F.col("t"), "t").alias("r")).first().r
    assert got["args"] == ["{x}" * 700] + ["y"] * 5000 and got["text"] == " mid " + " z " * 5000 + "p" * 900_000
    assert time.monotonic() - start < 30


def test_balanced(spark):
    text = r"a \t{x{y}z} b {k} \t{1} {2} c \t{open {"
    df = spark.createDataFrame([(text,)], "t string")
    one = df.select(tex.balanced(F.col("t"), "t").alias("r")).first().r
    assert one["args"] == ["x{y}z", "1", "open {"] and one["text"] == "a  b {k}  {2} c "
    two = df.select(tex.balanced(F.col("t"), "t", 2).alias("r")).first().r
    assert two["args"] == ["x{y}z", "1", "2", "open {"] and two["text"] == "a  b {k}  c "


def test_tex_to_text(spark):
    source = r"""preamble \begin{document}
\title{A {nested} title}\maketitle
\begin{abstract}
Short one.
\end{abstract}
\section*{Intro} 50\% of \textbf{all} \emph{text}~here. % gone
See \cite[p.~2]{a,b}, \eqref{e}.\footnote{ a note }
\begin{itemize}\item one \item two\end{itemize}
\begin{enumerate}\item first \item second\end{enumerate}
\begin{equation} x % kept
\end{equation}
R\&D \dots{} \smallskip \small done\\next
\end{document} after"""
    got = spark.createDataFrame([(source,)], "t string").select(tex.tex_to_text(F.col("t"))).first()[0]
    for part in (
        "# Abstract\n\nShort one.", "# Intro\n\n", "50% of **all** *text* here.", "See [citation], [eqref]. (a note)",
        "- one\n- two", "1. first\n2. second", "\\begin{equation} x", "R&D ...{} \\smallskip  done\nnext",
    ):
        assert part in got, (part, got)
    for part in ("preamble", "after", "nested", "gone", "maketitle"):
        assert part not in got


def test_includes(spark):
    files = [
        ("/p/main.tex", "/p", r"A\input{sec/one}B\include{two}C\input{sec/one}D\input{lost}E"),
        ("/p/sec/one.tex", "/p", r"1\input{two}1"),
        ("/p/two.tex", "/p", r"2\input{main}2"),
    ]
    df = spark.createDataFrame(files, "path string, root_dir string, text string")
    roots = spark.createDataFrame([("/p/main.tex",)], "root string")
    pieces = includes.resolve_includes(df, roots).orderBy("key").collect()
    assert "".join(p.piece for p in pieces) == "A1221BCDE"
    _, missing = includes.include_edges(df)
    assert [(r.src, r.wanted) for r in missing.collect()] == [("/p/main.tex", "/p/lost.tex")]


def test_include_order_is_depth_first(spark):
    rng = random.Random(7)
    for _ in range(3):
        edges = {(f"n{rng.randrange(7)}", p, f"n{rng.randrange(7)}") for p in range(14)}
        order = []

        def walk(node):
            if node not in order:
                order.append(node)
                for _, _, child in sorted(e for e in edges if e[0] == node):
                    walk(child)

        walk("n0")
        closure = includes.include_closure(
            spark.createDataFrame(list(edges), "src string, pos int, dst string"),
            spark.createDataFrame([("n0",)], "root string"),
        )
        assert [r.node for r in closure.orderBy("key").collect()] == order


def test_responses(spark):
    cases = [
        ('```json\n{"key": "value"}\n```', '{"key": "value"}', True),
        ('{"a": 1}', '{"a": 1}', True),
        ('Here is the result: {"answer": 42}.', '{"answer": 42}', True),
        ("{}", "{}", False),
        ("[]", "[]", False),
        ("so [1, 2] it is ]", "[1, 2]", False),
        ('x {"a": {"b": 1}} then {oops', '{"a": {"b": 1}}', True),
        ('{"k": 1} trailing', '{"k": 1}', True),
        ("nothing here", None, False),
    ]
    df = spark.createDataFrame(cases, "response string, want string, valid boolean")
    for r in semi.repair_json(df, "response").withColumn("ok", semi.is_valid_object(F.col("json"))).collect():
        assert (r.json, r.ok) == (r.want, r.valid), r.response


def test_fields(spark):
    body = '[{"c":{"y":1,"k":"N/A"}},{"c":{"y":"2","k":["A",["b"]]}},{"c":{"y":null}},{"x":{"k":{"k":3}}}]'
    df = spark.createDataFrame([(body,)], "b string")
    b = semi.parse(F.col("b"))
    row = df.select(
        semi.clean_values(semi.find_path(b, "c.y")).alias("path"), semi.clean_values(semi.find_key(b, "k")).alias("key"),
        semi.numbers(semi.find_path(b, "c.y")).alias("numbers"),
    ).first()
    assert row.path == ["1", "2"] and row.key == ["a", "b"] and row.numbers == [1.0, 2.0]


def test_pages_in_parts(spark):
    pages = [(1, 0, "a", True), (1, 2, "bad", False), (1, 3, "d", True)]
    df = spark.createDataFrame(pages, "doc_id int, page_idx int, content string, success boolean")
    rows = assemble_pages(df, part=2).orderBy("part_no").collect()
    assert len(rows) == 2
    text = "".join(r.text for r in rows)
    assert text == "a\n\n\n\n> [Error on Page 1: Missing]\n\n\n\n> [Error on Page 2: bad]\n\nd\n\n"


def test_markup(spark):
    df = spark.createDataFrame([("<p>A <a href=\"u\">b</a><script>x</script></p><style>s</style><h2>H</h2>&lt;",)], "h string")
    assert df.select(html_to_text(F.col("h"))).first()[0] == "A [b](u)\n\n## H\n\n<"
    prompt = render_prompt(F.lit("{x}: {content} {y}"), F.lit("abcdef"), {"x": F.lit("X")}, 3)
    assert df.select(prompt).first()[0] == "X: abc {y}"
    page = "<|ref|>text<|/ref|><|det|>[[1,2,3,4]]<|/det|>\n\n\nA \\approx B"
    assert spark.createDataFrame([(page,)], "c string").select(clean_layout(F.col("c"))).first()[0] == "A ≈ B"


def test_include_walk_takes_the_first_place_of_a_file(spark):
    """More rounds than are read one by one, and a file found late at an earlier place."""
    chain = [(f"n{i}", 1, f"n{i + 1}") for i in range(20)]
    # x is two steps away at place 5, and at the end of the chain, which starts at place 1
    edges = spark.createDataFrame([*chain, ("n0", 5, "y"), ("y", 1, "x"), ("n20", 1, "x"), ("x", 1, "n0"), ("x", 2, "z")], "src string, pos int, dst string")
    roots = spark.createDataFrame([("n0",)], "root string")
    got = {r.node: (list(r.key), r.depth) for r in includes.include_closure(edges, roots).collect()}
    assert len(got) == 24 and got["n20"] == ([1] * 20, 20)
    assert got["x"] == ([1] * 21, 21) and got["z"] == ([1] * 21 + [2], 22) and got["y"] == ([5], 1)


def test_expanded_texts(spark):
    rows = [("p/a.tex", "p", r"A \input{b} C \input{none} D \include{b.tex} E"), ("p/b.tex", "p", r"B\input{a}")]
    files = spark.createDataFrame(rows, "path string, root_dir string, text string")
    roots = spark.createDataFrame([("p/a.tex",)], "root string")
    assert [tuple(r) for r in includes.expanded_texts(includes.resolve_includes(files, roots)).collect()] == [("p/a.tex", "A B C  D  E")]


def test_first_usable_looks_once_and_no_deeper_than_it_has_to(spark):
    bodies = ['{"a":{"k":"deep"},"k":"not reported"}', '{"a":[{"k":null},[{"k":[1]}]]}', '{"a":{"k":"deep"},"k":"top"}', '{"a":{"c":1},"k":{"k":"in a hit"}}', "{", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "i long, b string").withColumn("paper_id", F.lit("p"))
    rows = semi.first_usable(df, "b", {"found": "k", "path": "a.c"})
    assert [(r["found"], r["path"]) for r in rows.orderBy("i").collect()] == [("deep", None), ("[1]", None), ("top", None), ('{"k":"in a hit"}', "1"), (None, None), (None, None)]
    # a value that is not there is looked for once
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("$['c']") == 1
