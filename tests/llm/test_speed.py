"""Work that is done once: looked at in plans and calls, never on the clock."""

from __future__ import annotations

from zlib import crc32

import numpy as np

from scholia.llm import bond, bpe, quality
from scholia.llm.queries import vocabulary_path


def test_a_text_drawn_twice_is_encoded_once(monkeypatch):
    v = bpe.Vocabulary(vocabulary_path())
    asked, pieces = [], v.pieces
    monkeypatch.setattr(v, "pieces", lambda text: asked.append(text) or pieces(text))
    texts = ["some words", "some words", None, "others", "some words", None, ""]
    assert v.all(texts) == [bpe.Vocabulary(vocabulary_path()).all([t])[0] for t in texts]
    assert asked == ["some words", None, "others", ""]


def test_a_word_known_as_a_piece_is_not_merged_again(monkeypatch):
    v = bpe.Vocabulary(vocabulary_path())
    v.all(["token unseen"])
    asked, word_ids = [], v.word_ids
    monkeypatch.setattr(v, "word_ids", lambda words: asked.extend(words) or word_ids(words))
    assert v.all(["token, (unseen) newer"]) == bpe.Vocabulary(vocabulary_path()).all(["token, (unseen) newer"])
    assert sorted(asked) == ["(", ")", ",", "newer"]


def test_buckets_of_all_words_at_once():
    words = {"Word", "'Word,", "###", "ΟΔΟΣ", "(ΟΔΟΣ)", "Σ", "a_b", "İ", "\ud800x", "x́!"}
    ends = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
    alone = [crc32((w.strip(ends).lower() or w).encode("utf-8", "replace")) & ((1 << quality.BITS) - 1) for w in words]
    assert sorted(quality.buckets(words).tolist()) == sorted(alone)
    assert not len(quality.buckets(set()))
    # runs of two marks or more are told word by word, a run of one is none
    with_runs, without = (quality.features(f"plain {x} words")[-quality.SHAPES:] for x in ("a!!b", "a! !b"))
    assert not np.array_equal(with_runs, without)


def test_first_columns_are_read_before_the_bounds_are_looked_at():
    draw = np.random.default_rng(3)
    x = np.floor(draw.normal(size=(600, 64)) * 256)
    block = bond.Block(list(range(600)), [i % 3 for i in range(600)], [r.tobytes() for r in x])
    for i, begun in enumerate(block.begun(x[:40])):
        looks = []
        rows, scores = block.scan(x[i], np.arange(600), lambda low, high: looks.append(len(low)) or high >= bond.kth(low, 5), begun)  # noqa: B023
        assert len(looks) <= 4 and begun[3] % bond.STEP == 0 and (x[rows] @ x[i]).tolist() == scores.tolist()
        # bounds enclose every row's score at the first look
        order, least, most, to, partial = begun
        assert (partial + least[to] <= x @ x[i]).all() and (x @ x[i] <= partial + most[to]).all()
    # a few large components are read first, and then looked at
    steep = x * np.linspace(4, 0.001, 64) ** 2
    assert max(b[3] for b in bond.Block([0, 1], [0, 1], [r.tobytes() for r in steep[:2]]).begun(steep[:40])) < min(b[3] for b in block.begun(x[:40]))


def test_windows_that_meet_are_looked_at_as_one():
    assert bond.joined(np.array([5.0, 1.0, 20.0]), np.array([9.0, 6.0, 30.0])) == [[1.0, 9.0], [20.0, 30.0]]
    assert bond.joined(np.empty(0), np.empty(0)) == []


def test_blocks_are_dealt_by_their_number_not_their_bytes(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    plan = bond.mine(vectors, bond.F.col("id") % 100 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan
