"""Filter audit, merge-type pieces and hard negatives against brute force and the public library."""

import itertools
import random

import pytest

from scholia.llm import bond, filteraudit, piecewise
from scholia.llm.queries import SQL, vocabulary_path

PIECES = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(PIECES))


def random_texts(n, seed=7):
    alphabet = "ab  ▁\n\t\0é€😀ﬁ́1.,'<s></s><0x0A>中 thequickÀß"
    draw = random.Random(seed)
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(n)]


def test_pieces_equal_the_library(library):
    known = piecewise.vocabulary(vocabulary_path(PIECES))
    for text in [*random_texts(3000), "x" * 5000, " " * 300, "the " * 3000, "", "\n\n", "a" + "́" * 50]:
        ids = library.encode(text)
        assert known.encode(text) == ids
        assert known.decode(ids) == library.decode(ids)
        assert known.joined(text) == (",".join(map(str, ids)), len(ids), library.decode(ids))


def test_decoding_of_any_ids(library):
    known = piecewise.vocabulary(vocabulary_path(PIECES))
    draw = random.Random(3)
    for _ in range(2000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259), draw.randrange(3, 259)]) for _ in range(draw.randint(0, 12))]
        assert known.decode(ids) == library.decode(ids), ids


def test_pieces_without_segments(library):
    """One agenda over a whole text gives what its segments give."""
    known = piecewise.Vocabulary(vocabulary_path(PIECES))
    for text in random_texts(300, 11):
        assert (known.numbers(known.prepared(text)) if text else []) == known.encode(text)


def test_unknown_symbols_without_bytes():
    """Without bytes a run of unknown symbols is one unknown id, whose text is not the symbols'."""
    known = piecewise.Vocabulary(vocabulary_path(PIECES))
    known.bytes, known.by_byte = {}, {}
    ids, n, decoded = known.joined("a\n\nb")
    assert known.lossy and n == len(ids.split(",")) and decoded == known.decode([int(i) for i in ids.split(",")])
    assert "⁇" in decoded


def test_fixed_and_unused_pieces():
    known = piecewise.Vocabulary(vocabulary_path(PIECES))
    known.fixed, known.marks = ["th"], piecewise.re.compile("th")
    assert "th" in known.merged("▁then") and known.merged("▁then") == ["▁", "th", "en"]
    known.fixed, known.marks, known.unused = [], None, {"▁then"}
    assert "".join(known.merged("▁then")) == "▁then" and "▁then" not in known.merged("▁then")


def test_piece_check_finds_differences():
    path = vocabulary_path(PIECES)
    known = piecewise.vocabulary(path)
    texts = ["Onreorin naïve", "two\nlines"]
    known.known.clear(), known.known.older.clear(), known.known.fresh.clear()
    found = [known.joined(t) for t in texts]
    fresh = dict(known.known.fresh)
    assert fresh and not piecewise.differs(path, fresh)
    assert piecewise.agreeing(path, texts, found) == [True, True]
    fresh[next(iter(fresh))] = "5"
    assert piecewise.differs(path, fresh)
    assert piecewise.agreeing(path, texts, [found[1], found[1]]) == [False, True]


def test_piece_jobs(spark):
    path = vocabulary_path(PIECES)
    rows = [(1, None, "x"), (2, "", "x"), (3, "Some text.", "x"), (3, "Some text.", "x"), (4, "lo ng" * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = piecewise.encode(docs, path, ids="coded")
    back = {r["doc_id"]: r["decoded"] for r in piecewise.decode(coded, path, "coded").collect()}
    assert back == {1: "", 2: "", 3: "Some text.", 4: "lo ng" * 20000}
    for check in ("segments", "texts"):
        out = piecewise.round_trip(docs, path, check=check)
        assert sorted(out.columns) == ["agrees", "decoded", "doc_id", "ids", "n_tokens"]
        assert out.count() == 5 and out.where("agrees").count() == 5
    assert piecewise.digests(docs.limit(0), path).count() == 0


def test_models_of_other_kinds_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(bytes([0x12, 2, 0x18, 1]))
    with pytest.raises(ValueError):
        piecewise.Vocabulary(str(tmp_path / "m"))


def test_trie_holds_the_smallest_id_of_each_text():
    draw = random.Random(5)
    for _ in range(300):
        texts = [bytes(draw.choice(b"ab\0") for _ in range(draw.randint(0, 6))) * draw.choice([1, 1, 9]) for _ in range(draw.randint(1, 40))]
        rows = sorted((t, draw.randint(0, 9)) for t in texts)
        trie, least = filteraudit.Trie(), {}
        for t, i in rows:
            least[t] = min(i, least.get(t, i))
            assert trie.insert(t, i) == least[t]
            assert trie.ends == sorted(set(trie.ends)) and trie.ends[-1] == len(t)
    assert filteraudit.shared(b"a" * 1000 + b"x", b"a" * 1000 + b"y") == 1000
    assert filteraudit.shared(b"", b"a") == 0 and filteraudit.shared(b"b", b"a") == 0


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        words = [w for w in piecewise.re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = ""
        fails += "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        fails += "E" * (i is not None and i > least[t])
        rows.append((i, lang or "", fails))
    out = {}
    for part in {r[1] for r in rows}:
        of = [r for r in rows if r[1] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = of
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[2]]
                kept = [r for r in left if f not in r[2]]
                shapley[f] += len(here)
                out[part, "".join(order), step] = [
                    len(kept), len(here), sum(f in r[2] for r in of) - len(here), sum(r[2] == f for r in of),
                    sum(r[0] in good for r in here), sum(r[0] in toxic for r in here),
                ]
                left = kept
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    return {tuple(r[:3]): tuple(r[3:]) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}


def test_filter_audit_against_brute_force(spark):
    draw = random.Random(2)
    pool = [None, "", " \t", "plain words here", "ABC def", "cost $5", "word " * 300, " ".join(f"w{k}" for k in range(250)), "é" * 50 + "A", "nbsp one\u0085two", "x" * 100_000]
    docs = [(draw.choice([None, *range(30)]), draw.choice(pool), draw.choice([None, "", "en", "fr"])) for _ in range(300)]
    docs += [(100 + k, "the same text of many", "en") for k in range(400)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in [None, *range(40), *range(0, 40, 3), 105]]
    # columns of the input that are named like the operator's own stay out of its way
    frame = spark.createDataFrame([(*d, 7, "z", 1) for d in docs], "doc_id long, text string, lang string, mask int, part string, n int").repartition(7)
    got = audited(filteraudit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute_audit(docs, labels)


def test_filter_audit_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(filteraudit.audit(docs, labels)) == {}
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    assert audited(filteraudit.audit(one, labels)) == brute_audit([(1, None, None)], [])
    with pytest.raises(ValueError):
        filteraudit.audit(docs, labels, copies="A")


def brute_negatives(rows):
    whole = [(i, la, [int(x * 256 // 1) for x in v]) for i, la, v in rows if i is not None and la is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    width = max((len(v) for *_, v in whole), default=0)
    whole = [(i, la, v + [0] * (width - len(v))) for i, la, v in whole]
    out = []
    anchors = {}
    for i, la, v in whole:
        if i % 100 == 0:
            anchors[i] = min((la, v), anchors.get(i, (la, v)))
    for a, (label, v) in anchors.items():
        score = lambda w: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w))))  # noqa: E731, B023
        best = sorted((-score(w), i) for i, la, w in whole if la == label and i != a)[:5]
        others = sorted((-score(w), i) for i, la, w in whole if la != label)
        for s, p in best:
            fits = [(n, i) for n, i in others if -30 * s <= -100 * n <= -90 * s][:10]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives_against_brute_force(spark):
    draw = random.Random(9)
    near = lambda c: [c * 0.2 + draw.gauss(0, 0.3) for _ in range(12)]
    rows = [(i, draw.randrange(4), near(draw.choice([1, -1, 2]))) for i in range(900)]
    rows += [(5, 1, rows[0][2]), (5, 1, rows[0][2]), (200, 0, near(1)), (200, 3, near(1)), (None, 1, near(1)), (901, None, near(1)), (902, 1, None)]
    rows += [(903, 1, [float("nan")] * 12), (904, 1, [None] * 12), (905, 2, [1.0, 2.0]), (906, 2, []), (1000, 7, near(1)), (300, 2, [0.0] * 12)]
    rows += [(907 + k, k % 4, rows[300][2]) for k in range(60)]  # ties
    schema = "vec_id long, label int, embedding array<double>"
    frame = spark.createDataFrame(rows, schema).withColumn("id", bond.F.lit("x")).withColumn("cell", bond.F.lit(0)).repartition(5)
    got = sorted(tuple(r) for r in bond.mine(frame, bond.F.col("id") % 100 == 0).collect())
    want = brute_negatives(rows)
    assert got == want and len(want) > 100
    small, bond.BLOCK = bond.BLOCK, 64  # many blocks give the same
    try:
        assert sorted(tuple(r) for r in bond.mine(frame, bond.F.col("id") % 100 == 0).collect()) == want
    finally:
        bond.BLOCK = small


def test_hard_negatives_of_huge_values_and_none(spark):
    schema = "vec_id long, label int, embedding array<double>"
    big = [(0, 1, [3e7, 1e8]), (1, 1, [2e7, 1e8]), (2, 2, [1e7, 5e7]), (3, 2, [1e15, 1e15]), (4, 1, [1e12, -1e12]), (5, 3, [1.0, 4e7])]
    assert sorted(tuple(r) for r in bond.mine(spark.createDataFrame(big, schema), bond.F.col("id") % 100 == 0).collect()) == brute_negatives(big)
    for rows in ([], [(1, 1, [1.0])], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 2, [1.0])], [(0, 1, []), (1, 1, [])]):
        assert bond.mine(spark.createDataFrame(rows, schema), bond.F.col("id") % 100 == 0).count() == 0


def test_bounds_leave_few_rows(spark):
    """The scan stops looking at rows that no bound keeps."""
    import numpy as np

    draw = np.random.default_rng(1)
    x = np.floor(draw.normal(size=(500, 32)) * 256 * np.linspace(2, 0.05, 32))
    block = bond.Block(list(range(500)), [0] * 500, [r.tobytes() for r in x])
    seen = []
    rows, _ = block.scan(x[0], np.arange(1, 500), lambda low, high: seen.append(len(low)) or high >= bond.kth(low, 5))
    assert seen[-1] < seen[0] / 4 and len(rows) >= 5


def test_new_queries_have_their_sql():
    assert {"op11_filter_audit", "op13_hard_negatives"} <= set(SQL)
