"""The training-data operators against brute force, round trips and held-out accuracy, with the hard cases."""

from __future__ import annotations

import dataclasses
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import bpe, innerproduct, jaccard, language, licenses, mincut, mixing, polytope, quality, urlfilter
from scholia.llm.components import components
from scholia.llm.queries import RULES, vocabulary_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7),
    (None, "lost id here", "de", None, 3), (5, "word " * 20_000, "en", "b", 9), (6, "!!! 123", None, "b", 1), (7, " \n\t ", "fr", "b", 1),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# --- 1: url rules


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = min(fits, key=lambda r: (-len(r[0]), r[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "http://com", "http://COM/", "http://a.example.com/en/x?q#f", "http://www.example.com/en/", "http://www.example.com/EN/",
        "ftp://x.net/es/1", "http://x.net/fr", "http://x.net/fr/", "http://xnet/fr/", "http://a://b.com/", "http://notexample.com/en/", "http://é.example.com/en/?", "http://a.com/" + "p" * 50_000,
    ] * 2
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(rows, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()}
    assert got == {i: brute_verdict(u) for i, u in enumerate(urls)}


def test_working_columns_clash_with_none_of_the_input(spark, docs):
    urls = spark.createDataFrame([(1, "http://a.example.com/en/x"), (2, "http://b.net/es/"), (3, None)], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    extra = ["_v", "_h", "_block", "start", "rule", "carried 0", "_w0"]
    wide = urls.select(*[F.lit(9).alias(c) for c in extra], "*")
    plain = sorted(urlfilter.judge(urls, rules).collect())
    got = urlfilter.judge(wide, rules)
    assert got.columns == [c for c in extra if c != "rule"] + plain[0].__fields__
    assert sorted(got.select(*plain[0].__fields__).collect()) == plain and got.where("_v = 9 AND start = 9").count() == 3

    some = docs.limit(60)
    extra = ["_s", "_b", "_take", "_left", "_r", "_in", "_full", "n", "mix_pass"]
    wide = some.select("*", *[F.lit(9).alias(c) for c in extra])
    plain, got = mixing.mix_sources(some), mixing.mix_sources(wide)
    assert got.columns == some.columns + extra[:-1] + plain.columns[-4:]
    assert sorted(got.select(*plain.columns).collect(), key=str) == sorted(plain.collect(), key=str) and got.where("_s <> 9 OR n <> 9").count() == 0

    model = licenses.fit(docs)
    rows = spark.createDataFrame([(1, "Some words.\nReleased under the MIT License.")], "doc_id long, text string")
    extra = ["w", "grams", "p", "best", "_p", "licence", "t"]
    plain, got = licenses.scan(rows, model), licenses.scan(rows.select(*[F.lit(9).alias(c) for c in extra], "*"), model)
    assert got.columns == [c for c in extra if c != "licence"] + plain.columns
    assert got.select(*plain.columns).collect() == plain.collect() and got.first()["w"] == 9


def test_url_rules_none(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert urlfilter.judge(pages, none).first()["verdict"] == "allow"
    assert urlfilter.judge(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


# --- 2 and 4: vectors


def vector_table(spark):
    random.seed(1)
    rows = [(i, [random.gauss(0, 1) * (1 + i % 5) for _ in range(12)]) for i in range(300)]
    rows += [(300 + i, rows[20][1]) for i in range(60)]
    rows += [(400, None), (420, [float("nan")] * 12), (440, [None] + [1.0] * 11), (460, [0.0] * 12), (480, [2.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def dense(rows):
    return {i: np.array(v + [0.0] * (12 - len(v))) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}


def brute_search(vectors, k=20):
    out = {}
    for q in (i for i in vectors if i % 20 == 0):
        best = sorted(((-float(v @ vectors[q]), i) for i, v in vectors.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_exact_search(spark):
    rows, table = vector_table(spark)
    whole = {i: np.floor(64 * v) for i, v in dense(rows).items()}
    assert grouped(innerproduct.search(table, table.where("vec_id % 20 = 0"))) == {q: [(i, int(s)) for i, s in b] for q, b in brute_search(whole).items()}


def test_exact_search_large_numbers(spark):
    table = spark.createDataFrame([(0, [1e12, 3.0]), (1, [1e12, 1.0]), (2, [1e300, 0.0])], "vec_id long, embedding array<double>")
    got = grouped(innerproduct.search(table, table.where("vec_id = 0"), k=5))
    assert [i for i, _ in got[0]] == [1, 2] and got[0][0][1] == 2**63 - 1


def test_exact_search_repeated_rows(spark):
    random.seed(11)
    rows = [(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(80)]
    rows += [(7, [9.0] * 6)] * 25 + [(20, rows[20][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, np.floor(64 * np.array(v))) for i, v in rows]
    want = {q: sorted((-int(w @ v), i) for p, v in whole if p == q for i, w in whole if i != q)[:20] for q in (0, 20, 40, 60)}
    got = grouped(innerproduct.search(table, table.where("vec_id % 20 = 0")))
    assert got == {q: [(i, -s) for s, i in b] for q, b in want.items()} and all(len(b) == 20 for b in got.values())
    assert any(b[0][0] == b[19][0] == 7 for b in got.values()) and len({i for b in got.values() for i, _ in b}) > 1


def test_searches_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert innerproduct.search(none, none).count() == polytope.search(none, none).count() == 0


def test_cross_polytope_recall(spark):
    rows, table = vector_table(spark)
    vectors = {i: v for i, v in dense(rows).items() if v.any()}
    want, got = brute_search(vectors), grouped(polytope.search(table, table.where("vec_id % 20 = 0")))
    assert set(got) <= set(want)
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in b}) for q, b in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert all(abs(s - float(vectors[i] @ vectors[q])) < 1e-9 for i, s in found)


def test_cross_polytope_recall_of_large_tables(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    want = dict(list(brute_search(vectors).items())[::5])
    # a table that says it has millions of rows is searched as widely
    monkeypatch.setattr(type(table), "count", lambda self: 6_000_000)
    got = grouped(polytope.search(table, table.where("vec_id % 100 = 0")))
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in b}) for q, b in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


# --- 3: similar texts


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_similar_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    random.seed(3)
    rows, n = [], 0
    for size in (3, 5, 6, 12, 40, 150):
        for _ in range(6):
            words = [f"w{random.randrange(300)}" for _ in range(size)]
            for change in range(6):
                copy = words[:]
                for _ in range(change * size // 60):
                    copy[random.randrange(size)] = f"x{random.randrange(50)}"
                rows.append((n, " ".join(copy).upper() if change == 1 else " ".join(copy)))
                n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "\x0b \n"), (n + 3, "a"), (n + 4, "A\x0c"), (n + 5, "é\xa0b c d e f"), (n + 6, "long text " * 30_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_sketch_bounds():
    random.seed(4)
    for _ in range(200):
        a = {random.getrandbits(64) for _ in range(random.randrange(1, 90))}
        b = {x for x in a if random.random() < 0.9} | {random.getrandbits(64) for _ in range(random.randrange(3))}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if not len(y):
            continue
        assert jaccard.sketch_distance(jaccard.bit_sketch(x), jaccard.bit_sketch(y)) <= len(a ^ b)
        if 100 * len(a & b) >= 80 * len(a | b):
            assert set(np.concatenate(jaccard.keys_of(x, 80)).tolist()) & set(np.concatenate(jaccard.keys_of(y, 80)).tolist())


def test_similar_groups_hard(hard):
    got = [tuple(r) for r in jaccard.similar_groups(hard).collect()]
    assert len(got) == len(HARD) and (1, 0, 1) in got and got.count((3, 1, 3)) == 2 and (None, 1, None) in got
    assert jaccard.similar_groups(hard.limit(0)).count() == 0


def test_similar_groups_of_a_crowded_bucket(spark, monkeypatch):
    # unlike texts with one opening meet in a bucket, which has to be divided; some are similar
    monkeypatch.setattr(jaccard, "CHUNK", 1)
    divisions, divided = [], jaccard.divided
    monkeypatch.setattr(jaccard, "divided", lambda *a: divisions.append(a[1]) or divided(*a))
    random.seed(9)
    rows = []
    for i in range(400):
        words = "all of them start alike".split() + [f"w{random.randrange(10**6)}" for _ in range(random.choice((3, 4, 9, 30)))]
        rows.append((2 * i, " ".join(words)))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join([*words, "more"])))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: frozenset(jaccard.shingles(t).tolist()) for i, t in rows}
    want = {i: i - 1 if i % 2 and 100 * len(sets[i] & sets[i - 1]) >= 80 * len(sets[i] | sets[i - 1]) else i for i in sets}
    assert got == want and len(set(want.values())) < len(want) and divisions


def test_cells_hold_few_probes(monkeypatch):
    import pyarrow as pa

    random.seed(10)
    sizes, cell_pairs = [], jaccard.cell_pairs
    rows = [(cell, 0, probe, 10_000 * cell + i + 5000 * probe, i, 60, random.randbytes(1) * 8) for cell in (1, 2) for probe, n in ((False, 9), (True, 3000)) for i in range(n)]
    want = [p for c in (1, 2) for p in cell_pairs([r for r in rows if r[0] == c], 80)]
    monkeypatch.setattr(jaccard, "cell_pairs", lambda held, *a: sizes.append(len(held)) or cell_pairs(held, *a))
    batches = [pa.RecordBatch.from_pylist([dict(zip("abcdefg", r)) for r in rows[at : at + 500]]) for at in range(0, len(rows), 500)]
    got = [p for b in jaccard.compared(iter(batches), 80, None) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(got) == sorted(want) and want and max(sizes) <= 9 + jaccard.PROBES


def test_components(spark):
    random.seed(5)
    links = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    label = {x: x for ab in links for x in ab}
    for _ in range(60):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: m for x, m in label.items() if any(x in ab and ab[0] != ab[1] for ab in links)}


def test_components_of_short_paths(spark):
    # here a node hangs on two parents when no node is both child and parent
    for path in ([1, 5, 4, 3, 2], [8, 3, 7, 5, 4, 1, 6, 2]):
        links = spark.createDataFrame(list(zip(path, path[1:])), "a long, b long")
        got = sorted((r["node"], r["label"]) for r in components(links).collect())
        assert got == [(x, 1) for x in sorted(path)]


# --- 5: main text


def test_minimum_cut_is_minimal():
    random.seed(6)
    for _ in range(150):
        n = random.randint(1, 8)
        sides = [(random.random() * 2, random.random() * 2) for _ in range(n)]
        edges = [(random.randrange(n), random.randrange(n), random.random()) for _ in range(2 * n)]

        def cost(labels):
            return sum(b if x else a for (a, b), x in zip(sides, labels)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        assert cost(mincut.minimum_cut(sides, edges)) == pytest.approx(min(map(cost, itertools.product((False, True), repeat=n))))


def test_main_text(spark):
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>Menu item</a></ul></nav>"
        "<div class='cookie notice'>We use cookies on this site for many good reasons.</div><article><h1>A &amp; B</h1><p>First  long\n paragraph of the text.<br>More<p>Second &eacute;.</p></article>"
        "<aside>Related things</aside><div id=comments><p>What a great article, I liked it so much.</p></div><form>Mail <input></form><footer>&copy; me</footer>"
    )
    rows = [(1, page), (2, None), (3, ""), (4, "<p>"), (5, "<div>" * 3000 + "deep"), (6, page)]
    got = {r["page_id"]: r["text"] for r in mincut.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    want = "A & B\nFirst long paragraph of the text. More\nSecond é."
    assert got[1] == got[6] == want and got[2] == got[3] == got[4] == ""


def test_main_text_long_values_and_stray_quotes():
    said = "These are some words of the main text, enough of them to be kept."
    long = "x > y <p> z " * 10_000
    assert mincut.main_text(f"<article><p>{said}<img src='data:{long}'> More.</p></article>") == said + " More."
    assert mincut.main_text(f"<nav data-json=\"{long}\">Menu item</nav><div class=content data-x='{long}'>{said}</div>") == said
    for stray in ("title=it's", "title='it's'", 'title="5" wide"', "'", 'alt="', "alt= '", "a==b"):
        assert mincut.main_text(f"<article><p {stray}>{said}</p></article>") == said


def test_main_text_hidden_elements_and_embedded_text():
    said = "These are some words of the main text, enough of them to be kept."
    for shown in ('class="overflow-hidden"', "class='md:hidden prose'", 'aria-hidden="false"', 'title="the hidden part"', "data-hidden=1", 'data-x="aria-hidden=true display:none"', 'style="display:block"'):
        assert mincut.main_text(f"<div {shown}><article><p>{said}</article></div>") == said
    for gone in ("hidden", 'HIDDEN=""', "aria-hidden=true", "aria-hidden = 'true'", 'style="color:red; display : none"', "class='a' hidden id=b"):
        assert mincut.main_text(f"<article><p>{said}</p><div {gone}><p>{said}</div></article>") == said
    page = f"<article><p>{said} Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.<p><object data=a><param name=b>{said}</object><p><video src=c><source src=d>{said}</video></article>"
    assert mincut.main_text(page).split("\n") == [said + " Here x=2 holds.", said, said]


def test_main_text_keeps_short_lines_and_items_of_content():
    said = "These are some words of the main text, enough of them to be kept."
    said = f"{said} {said}"
    items = "Salt", "Two eggs", "Flour", "Milk"
    page = f"<body><div><a href=/>Home</a></div><div><p>{said}</p><p>Yes.</p><p>{said}</p><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul><p>{said}</p></div><div>Share this</div>"
    assert mincut.main_text(page).split("\n") == [said, "Yes.", said, *items, said]
    menu = "".join(f"<li><a href=/{x}>{x}</a>" for x in items)
    assert mincut.main_text(f"<div><p>{said}</p><ul>{menu}</ul><p>{said}</p></div>").split("\n") == [said, said]
    assert mincut.main_text(f"<div class='search-results'><p>{said}</div><div class=search-box><p>{said}</div>") == said
    inside = f"<article><p>{said}<p><noscript>{said}</noscript><p><svg><text>{said}</text></svg><p><iframe>{said}</iframe></article>"
    assert mincut.main_text(inside).split("\n") == [said] * 4


def test_main_text_of_small_pages_is_the_least_cut():
    rng, changed = random.Random(5), 0
    texts = ["Yes.", "Two eggs", "Some words of a text that goes on for a while and says things.", "<a href=/>Home page</a>", "A line of six words here."]
    for _ in range(120):
        page = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<ul>", "<li>", "</ul>", "<nav>", "</nav>", "<table><tr><td>"]) + rng.choice(texts) * rng.randint(0, 1) for _ in range(18))
        blocks = mincut.Page.read(page).blocks[:12]
        sides, edges = [mincut.costs(mincut.score(b)) for b in blocks], [e for e in mincut.edges(blocks)]
        cost = lambda x: sum(b if k else a for (a, b), k in zip(sides, x)) + sum(w for a, b, w in edges if x[a] != x[b])
        got = mincut.minimum_cut(sides, edges)
        assert cost(got) == pytest.approx(min(map(cost, itertools.product((False, True), repeat=len(blocks)))))
        changed += got != [mincut.score(b) > 0 for b in blocks]
        # no two edges cross
        spans = {(a, b) for a, b, _ in edges}
        assert not any(a < c < b < d for a, b in spans for c, d in spans)
    assert changed > 20


def test_main_text_takes_linear_time():
    said = "These are some words of the main text, enough of them to be kept."
    pages = ["<div>" + "".join(f"<p>{said if i % 2 else 'Yes.'}</p>" for i in range(20_000)) + "</div>"]
    pages += [f"<p>{said}</p><ul>" + "<li>Salt" * 20_000, "<b>" * 10_000 + "Yes.<hr>" * 10_000, "<button>" * 20_000, "<ul><li>Yes." * 10_000]
    for page in pages:
        began = time.perf_counter()
        mincut.main_text(page)
        assert time.perf_counter() - began < 4


def test_main_text_weights_are_learned(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    weights = mincut.fit(pages)
    assert weights != mincut.WEIGHTS and weights[2] == mincut.WEIGHTS[2] and weights[3] < -1
    blocks = [b for r in pages.limit(20).collect() for b in mincut.Page.read(r["html"]).blocks]
    assert sum(w == mincut.SIBLING for _, _, w in mincut.edges(blocks)) > 0
    assert mincut.extract(pages, weights=weights).collect() == mincut.extract(pages).collect()
    assert mincut.fit(pages.limit(0)) == mincut.fit(pages.select(F.lit("<p>no mark").alias("html"))) == mincut.WEIGHTS
    assert mincut.extract(pages.limit(0)).count() == 0


def test_main_text_of_pages(spark):
    import html

    for r in mincut.extract(spark.read.parquet(f"{DATA}/pages.parquet").withColumn("source", F.col("html")), "html").collect():
        inner = re.search("<article>(.*)</article>", r["source"], re.S)[1]
        lines = [" ".join(html.unescape(re.sub("</?b>|<br>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


# --- 6: licences


def test_license_scan(spark, docs):
    model = licenses.fit(docs)
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts]
    named = {t: f for f, ts in licenses.TEMPLATES.items() for t in ts}
    extra = spark.createDataFrame([(10_000 + i, f"Some words.\n{t}\n{t}") for i, t in enumerate(lines)] + [(1, None), (2, ""), (3, "the version of the word is general and public")], "doc_id long, text string")
    got = licenses.scan(extra, model).collect()
    right = sum(r["licence"] == named[lines[r["doc_id"] - 10_000]] for r in got)
    assert right >= 0.9 * 2 * len(lines) and right == len(got) and all(r["paragraph"] in (1, 2) for r in got)
    stated = re.compile(r"licen[cs]e|rights reserved", re.I)
    found = {(r["doc_id"], r["paragraph"]) for r in licenses.scan(docs, model).collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, line in enumerate((r["text"] or "").split("\n")) if stated.search(line)}
    assert found == want
    assert licenses.scan(docs.limit(0), model).count() == 0


def test_license_scan_where_its_words_are_common(spark):
    # each word of the licence line is an everyday word of this corpus; on few rows one occurrence was already often
    texts = ["Er kommt mit dem Zug und mit der Bahn.", "The film was released in May.", "Under the bridge, under the road.", "My driving license is new.", "The end of the day."] * 20
    texts += [f"Ein Satz mit Nummer {i} und noch mehr." for i in range(100)]
    rows = spark.createDataFrame([*enumerate(texts), (900, "Released under the MIT License."), (901, "Distributed under the MIT license.")], "doc_id long, text string")
    model = licenses.fit(rows)
    found = lambda m: {(r["doc_id"], r["licence"]) for r in licenses.scan(rows, m).collect()}
    got = found(model)
    assert {(900, "mit"), (901, "mit")} <= got
    # the same as by scoring every paragraph
    assert got == found(dataclasses.replace(model, telling=None))


def test_license_model_learns_from_every_paragraph(spark):
    # the lines with words of a template come late in the order of their hashes, where no sample of forty reaches
    plain = [f"Ein Satz mit Nummer {i} und noch mehr." for i in range(100)]
    hashed = lambda lines: [(r["h"], r["t"]) for r in spark.createDataFrame([(x,) for x in lines], "t string").select("t", F.xxhash64("t").alias("h")).collect()]
    last = sorted(hashed(plain))[60][0]
    late = [t for h, t in hashed([f"Version {i} of the public notice." for i in range(200)]) if h > last][:40]
    model = lambda lines: licenses.fit(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), rows=20)
    without, having = dict(model(plain).weights), dict(model(plain + late).weights)
    unknown = lambda weights, gram: weights.get(gram, [0.0])[-1]
    assert len(late) == 40 and unknown(having, "version") > unknown(without, "version")


def test_telling_words_are_a_bound():
    random.seed(8)
    for _ in range(200):
        words = list("abcdef")
        names = [*words, *(f"{x} {y}" for x in words for y in words)]
        weights = [(g, [random.gauss(0, 1) for _ in range(3)]) for g in random.sample(names, 12)]
        intercepts, level = [random.gauss(-1, 1), random.gauss(-1, 1), 1.0], random.uniform(0.5, 0.9)
        telling = licenses.telling_words(weights, intercepts, level, words)
        if telling is not None:
            for _ in range(50):
                said = random.choices([x for x in [*words, "z"] if x not in telling], k=random.randint(0, 8))
                has = {*said, *(f"{x} {y}" for x, y in zip(said, said[1:]))}
                sums = np.exp(np.array(intercepts) + sum((np.array(w) for g, w in weights if g in has), np.zeros(3)))
                assert (sums[:2] / sums.sum() < level).all()


# --- 7: tokens


def test_bpe_matches_tokenizer(spark, docs, hard):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    right = Tokenizer.from_file(path)
    texts = ["Hello THERE's  we'LL 123<|endoftext|> <|startoftext|>x", "ΣΑΣ ş İ é e\u0301", "ab" * 4000, "\x1c a\x1db\u2003c\x85", "😀👍🏽 漢字かな", "'s''re 'Tis", "x" * 10_000]
    more = spark.createDataFrame([(100 + i, t, "ids") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = docs.select("doc_id", "text").union(hard.select("doc_id", "text")).union(more.select("doc_id", "text"))
    for r in bpe.decode(bpe.encode(rows, path), path).collect():
        want = right.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["decoded"] == right.decode(want, skip_special_tokens=False)
    both = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.round_trip(more, path).collect()}
    assert both == {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.decode(bpe.encode(more, path), path).collect()}
    assert bpe.encode(more, path).columns == ["doc_id", "text", "ids"] and bpe.encode(more.limit(0), path).count() == 0


def test_merge_is_leftmost_lowest():
    random.seed(7)
    for _ in range(200):
        pairs = {}
        for rank in range(40):
            pairs.setdefault(random.randrange(12) << bpe.SHIFT | random.randrange(12), rank << bpe.SHIFT | random.randrange(12))
        word = [random.randrange(12) for _ in range(random.randrange(1, 40))]
        plain = word[:]
        while True:
            ranks = [pairs.get(a << bpe.SHIFT | b, bpe.NONE) for a, b in zip(plain, plain[1:])]
            if not ranks or min(ranks) == bpe.NONE:
                break
            i = ranks.index(min(ranks))
            plain[i : i + 2] = [ranks[i] & bpe.MASK]
        assert bpe.merge(word, pairs) == plain


# --- 8: mixing


def test_mix_reaches_weights(docs):
    out = mixing.mix_sources(docs, most_passes=3.0).collect()
    tokens = {}
    for r in out:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["tokens"]
    total = sum(tokens.values())
    weights = {r["source"]: r["mix_weight"] for r in out}
    longest = max(r["tokens"] for r in out)
    for s, n in tokens.items():
        assert abs(n - weights[s] * total) <= longest + 1
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in docs.collect()}
    assert max(r["mix_pass"] for r in out) <= 2


def test_mix_budget_entropy_and_hard(docs, hard):
    part = mixing.mix_sources(docs, most_passes=None, target_entropy=0.5, budget=5_000).agg(F.sum("tokens")).first()[0]
    assert part <= 5_000
    shares = [0.7, 0.2, 0.1]
    e = mixing.find_exponent([0.6, 0.25, 0.15], target_entropy=0.95)
    assert abs(mixing.entropy(mixing.weights_at([0.6, 0.25, 0.15], e)) - 0.95) < 1e-6
    e = mixing.find_exponent(shares, most_passes=2.0)
    assert abs((0.1 / 0.7) ** (e - 1) - 2.0) < 1e-6
    got = mixing.mix_sources(hard.withColumn("tokens", F.lit(1)), most_passes=1.0).collect()
    assert len(got) == len(HARD) and mixing.mix_sources(hard.limit(0)).count() == 0
    assert [r[0] for r in hard.select(mixing.word_count()).collect()] == [0, 0, 2, 2, 3, 20_000, 2, 0]


# --- 9 and 10: trained classifiers


def test_language_accuracy(spark, hard):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit(docs.where(~held))
    got = language.predict(docs.where(held), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: (r["lang_pred"], r["lang_rejected"]) for r in language.predict(hard.withColumn("score", F.lit("x")), model).collect()}
    assert all(odd[i] == (language.UNKNOWN, True) for i in (1, 2, 6, 7)) and odd[3][0] in {"en", "fr", "de", "es"}
    empty = language.fit(hard.limit(0))
    assert {r["lang_pred"] for r in language.predict(hard, empty).collect()} == {language.UNKNOWN}


def test_quality_held_out(spark, hard):
    sf = "/root/testdata/sf0.1"
    rated = quality.graded(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.fit(rated.where(~held))
    got = quality.score(rated.where(held), model).collect()
    good, bad = ([r for r in got if (r["grade"] == 2) == kind] for kind in (True, False))
    assert sum(r["p_good"] < 0.4 for r in good) <= 0.03 * len(good) and sum(r["p_good"] >= 0.4 for r in bad) <= 0.15 * len(bad)
    assert all(r["p_clean"] >= r["p_good"] for r in got) and list(model.thresholds) == sorted(model.thresholds)
    assert quality.score(hard, model).count() == len(HARD)
    none = quality.fit(rated.limit(0))
    first = quality.score(hard, none).first()
    assert abs(first["p_clean"] - 2 / 3) < 1e-6 and abs(first["p_good"] - 1 / 3) < 1e-6


def test_small_cells_find_the_pairs_of_large_ones(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(base, 360, replace=False)) for _ in range(40)]
    cell = [(1, 0, i % 3 == 0, i, i % 7, len(s), jaccard.bit_sketch(s)) for i, s in enumerate(sets)]
    few = jaccard.cell_pairs(cell, 80), jaccard.cell_pairs(cell, 80, 2)
    monkeypatch.setattr(jaccard, "SMALL", 0)
    assert few == (jaccard.cell_pairs(cell, 80), jaccard.cell_pairs(cell, 80, 2)) and few[0]
    for a, b in [(sets[0], sets[1]), (sets[0][:50], sets[1]), (sets[2], sets[3][:9])]:
        x, y = jaccard.bit_sketch(a), jaccard.bit_sketch(b)
        assert jaccard.folded_distance(x, y) == jaccard.folded_distance(y, x) == jaccard.sketch_distance(x, y)
