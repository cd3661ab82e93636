"""The work that operators do stays within bounds, with the results of the plain way."""

import random
import struct

import numpy as np

from scholia.llm import bpe, jaccard
from scholia.llm.queries import vocabulary_path


def test_words_merge_side_by_side_as_alone():
    random.seed(7)
    for _ in range(60):
        pairs = {}
        for rank in range(40):
            pairs.setdefault(random.randrange(12) << bpe.SHIFT | random.randrange(12), rank << bpe.SHIFT | random.randrange(12))
        words = [[random.randrange(12) for _ in range(random.randrange(40))] for _ in range(50)]
        keys = np.array(sorted(pairs), np.int64)
        made = np.array([pairs[k] for k in keys.tolist()], np.int64)
        left, counts = bpe.merge_all(np.array([s for w in words for s in w], np.int64), np.array([len(w) for w in words]), keys, made)
        ends = np.cumsum(counts)
        assert [left[a:b].tolist() for a, b in zip(ends - counts, ends)] == [bpe.merge(w, pairs) for w in words]


def test_batch_encodes_as_single_texts_and_is_bounded():
    random.seed(8)
    made = bpe.Vocabulary(vocabulary_path())
    alphabet = "abcdeé ñ'sK\n\tΣς<|endoftext|>12٣漢\U0001F600\ud800_-"
    texts = [None, "", " ", "x" * 500, "a" * 64, "a" * 65, *("".join(random.choices(alphabet, k=random.randrange(90))) for _ in range(300))]
    batch = made.all(texts)
    assert batch == [made.all([t])[0] for t in texts]

    def alone(text):
        out = []
        for k, part in enumerate(made.pieces(text)):
            words = [w for piece in part for w in made.words.findall(piece)]
            out += [made.special[part[0]].to_bytes(4, "little")] if k % 2 else [made.long_word(w.encode("utf-8", "replace")) for w in words]
        return b"".join(out)

    assert [ids for ids, _ in batch] == [alone(t) for t in texts]
    assert [text for _, text in batch] == [made.decode(ids) for ids, _ in batch]
    made.kept.most = 100
    made.all([" ".join(map(str, range(1000)))])
    made.all(["one"])
    assert set(made.kept) == {"one"} and len(made.kept.older) <= 2000


def test_equal_buckets_count_once_and_pairs_are_sent_on_once(spark):
    """Near copies of a large group share many buckets; a pair whose sets have one among their first few is sent on from the smallest."""
    random.seed(9)
    base = [f"w{i}" for i in range(300)]

    def changed(n):
        words = base[:]
        for at in random.sample(range(0, 300, 5), n):
            words[at] = f"x{random.randrange(10**9)}"
        return " ".join(words)

    # about 10 % of the shingles of each are its own: pairs are near the threshold
    texts = [changed(8) for _ in range(jaccard.SMALL + 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(docs).collect()}
    assert got == dict(enumerate(label))

    def cell(bucket, size):
        rows = [jaccard.shingles(t) for t in texts[:size]]
        first = struct.pack(">2q", 3, 5)
        return [(bucket, 0, probe, i, i, len(m), jaccard.bit_sketch(m), first) for probe in (False, True) for i, m in enumerate(rows)]

    for size in (8, jaccard.SMALL + 1):
        assert not jaccard.cell_pairs(cell(5, size), 40)
        assert len(set(jaccard.cell_pairs(cell(3, size), 40))) == size * (size - 1) // 2
        assert jaccard.cell_pairs(cell(5, size), 40, 2)

    members = spark.createDataFrame([(b, n) for b in (5, 3, 9) for n in (1, 2, 3)] + [(7, 1), (7, 2)], "bucket long, name long")
    assert sorted(r["bucket"] for r in jaccard.unlike_buckets(members).collect()) == [3, 7]


def test_closed_buckets_are_not_looked_at_again(spark, monkeypatch):
    # unlike texts with one opening meet in a bucket that has no open pair; near copies of another text stay open
    random.seed(21)
    held, open_pairs = [], jaccard.open_pairs
    monkeypatch.setattr(jaccard, "open_pairs", lambda members, *a: held.append(members.count()) or open_pairs(members, *a))
    rows = [(i, " ".join("all of them start alike".split() + [f"w{random.randrange(10**6)}" for _ in range(30)])) for i in range(40)]
    long = [f"v{i}" for i in range(200)]
    for i in range(40, 60):
        rows.append((i, " ".join(f"y{random.randrange(10**6)}" if random.random() < 0.02 else w for w in long)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: set(jaccard.shingles(t).tolist()) for i, t in rows}
    want = {i: i for i in sets}
    for _ in sets:
        for i in range(40, 60):
            for j in range(40, 60):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    want[i] = want[j] = min(want[i], want[j])
    assert got == want and len(held) > 1 and held[-1] < held[0]


def test_texts_of_a_repeated_key_stay_apart(spark):
    # x and a copy of it under the key of a; a and x are just below the threshold and their sketches leave them open
    random.seed(22)
    while True:
        a = [f"w{i}" for i in range(200)]
        x = [f"y{random.randrange(10**6)}" if random.random() < 0.025 else w for w in a]
        m, n = (jaccard.shingles(" ".join(t)) for t in (a, x))
        both = len(set(m.tolist()) & set(n.tolist()))
        near = 9 * jaccard.sketch_distance(jaccard.bit_sketch(m), jaccard.bit_sketch(n)) <= len(m) + len(n)
        met = set(jaccard.keys_of(m, 80)[0].tolist()) & set(jaccard.keys_of(n, 80)[0].tolist())
        if 100 * both < 80 * (len(m) + len(n) - both) and near and met:
            break
    rows = [(5, " ".join(a)), (5, " ".join(x)), (3, " ".join(x))]
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 3), (5, 5)]
