"""Quality by ordinal cumulative-link regression on graded ratings.

One weight per hashed feature and ordered thresholds give the logistic chance of
each grade or better: ``P(grade > k) = sigmoid(w.x - t_k)``. Features are the
presence of hashed words and of a text's shape (share of marks, of repeated
words, of capitals, word length, in steps), so a single telling word counts in a
text of any length. Grades come from labels: toxic is 0, poor 1, good 2.

The fit uses at most ``rows`` rated rows, those of the smallest hash; every text
is scored whole.

Defined results: null and empty texts have no words and are scored by their
shape alone; without rated rows every grade has the same chance; repeated rows are
scored each; clashing columns are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.hashed import mapped

GRADES = 3
BITS = 18
#: Buckets of the shape features, after those of the words.
SHAPES, STEPS = 6, 12
#: Runs of two marks or more.
_MARKS = re.compile(r"[^\w\s]{2,}")
_ENDS = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"


def buckets(words: set[str]) -> np.ndarray:
    """Hashes of words in lower case without marks at their ends; words hold no blanks."""
    if not words:
        return np.empty(0, np.int64)
    # words keep a bucket of their marks as well: '###' or '!!' tells as much as a word
    bare = " ".join([w.strip(_ENDS) or w for w in words])
    return np.array(list(map(crc32, bare.lower().encode("utf-8", "replace").split(b" "))), np.int64) & ((1 << BITS) - 1)


def step(x: float) -> int:
    """Place of a share from 0 to 1 among the steps, finer near 0."""
    return min(STEPS - 1, int(STEPS * min(1.0, max(0.0, x)) ** 0.5))


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature buckets of a whole text."""
    text = text or ""
    words = text.split()
    distinct = set(words)
    n, size = max(1, len(words)), max(1, len(text))
    # no run of marks crosses a blank, so one search does for all words
    marked = len(_MARKS.findall(" ".join(distinct))) / max(1, len(distinct))
    lines = [x for x in text.split("\n") if x]
    shape = (
        len(distinct) / n, marked, text.count("|") / n, sum(map(str.isupper, words)) / n,
        min(1.0, (size / n) / 40), len(set(lines)) / max(1, len(lines)),
    )
    # shares count only where there are enough words to have one
    base, few = 1 << BITS, len(words) < 12
    shaped = [base + i * STEPS + (STEPS - 1 if few and i in (0, 4, 5) else step(x)) for i, x in enumerate(shape)]
    return np.unique(np.concatenate((buckets(distinct), np.array(shaped, np.int64))))


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each k below the best grade."""
        score = self.weights[features(text)].sum()
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))


def telling(flat: np.ndarray, of: np.ndarray, grades: np.ndarray, size: int, least_rows: int, least_z: float) -> np.ndarray:
    """Features in least_rows rows or more whose share of some tail is least_z standard deviations off the mean share."""
    n = np.bincount(flat, minlength=size)
    keep = np.zeros(size, bool)
    for k in range(GRADES - 1):
        low = grades <= k
        p = min(max(low.mean(), 1e-3), 1 - 1e-3)
        keep |= np.abs(np.bincount(flat, low[of], minlength=size) - n * p) >= least_z * np.sqrt(np.maximum(n, 1) * p * (1 - p))
    return np.flatnonzero(keep & (n >= least_rows))


def regress(rows: list[np.ndarray], grades: np.ndarray, least_rows: int = 8, least_z: float = 4.5, rounds: int = 300, rate: float = 0.05, shrink: float = 1e-4) -> QualityModel:
    """Maximum likelihood by adaptive gradient steps, over the telling features."""
    size = (1 << BITS) + SHAPES * STEPS
    used = telling(np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), grades, size, least_rows, least_z)
    index = np.full(size, -1)
    index[used] = np.arange(len(used))
    kept = [x[x >= 0] for x in (index[r] for r in rows)]
    flat, of = np.concatenate(kept), np.repeat(np.arange(len(rows)), [len(k) for k in kept])
    w, cuts = np.zeros(len(used)), np.linspace(-1, 1, GRADES - 1)
    state = np.zeros((2, len(w) + len(cuts)))
    levels = np.arange(GRADES - 1)
    y = grades[:, None] > levels[None, :]
    for t in range(1, rounds + 1):
        score = np.bincount(of, w[flat], minlength=len(rows))
        tail = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -50, 50)))
        # likelihood of the grade: the difference of two neighbouring tails
        full = np.concatenate([np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))], axis=1)
        at = np.arange(len(rows))
        p = np.maximum(full[at, grades] - full[at, grades + 1], 1e-9)
        slope = full * (1 - full)
        d_score = -(slope[at, grades] - slope[at, grades + 1]) / p / len(rows)
        d_cut = np.zeros((len(rows), GRADES + 1))
        d_cut[at, grades] += slope[at, grades] / p / len(rows)
        d_cut[at, grades + 1] -= slope[at, grades + 1] / p / len(rows)
        g = np.concatenate([np.bincount(flat, d_score[of], minlength=len(w)) + shrink * w, d_cut[:, 1:GRADES].sum(axis=0)])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w -= move[: len(w)]
        cuts = np.sort(cuts - move[len(w) :])
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return QualityModel(weights, cuts)


def graded(docs: DataFrame, labels: DataFrame, rows: int = 6000) -> DataFrame:
    """text and grade of documents with labels, of at most rows ids, those of the smallest hash; of repeated labels of a document the worst counts.

    The ids are chosen among the labels alone and sent to all tasks, so no text moves for it.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    # a first cut by the hash leaves few more than are wanted, wherever they lie
    share = min(1.0, 1.2 * rows / max(1, labels.select("doc_id").distinct().count()))
    place = F.xxhash64("doc_id")
    near = rated.where(F.pmod(place, F.lit(1 << 30)) <= int(share * (1 << 30)))
    chosen = near.orderBy(F.pmod(place, F.lit(1 << 30)), "doc_id").limit(rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")


def fit(rated: DataFrame, rows: int = 6000) -> QualityModel:
    """Fit on at most rows rated rows, those of the smallest hash of doc_id and text; the driver gets their features."""
    made = {"features": ("array<long>", pa.list_(pa.int64()))}
    hashed = rated.select("grade", "text", F.xxhash64("doc_id", "text").alias("place"))
    found = mapped(hashed, "text", made, lambda texts: {"features": [features(t) for t in texts]}).select("place", "grade", "features")
    found = found.orderBy("place", "grade").limit(rows).select("grade", "features").toArrow()
    data = [np.asarray(x, np.int64) for x in found["features"].to_pylist()]
    if not data:
        return QualityModel(np.zeros((1 << BITS) + SHAPES * STEPS, np.float32), np.log(np.arange(1, GRADES) / np.arange(GRADES - 1, 0, -1)))
    return regress(data, np.asarray(found["grade"].to_pylist(), np.int64))


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """docs with expected_grade (0 to 2), p_clean (better than toxic) and p_good (the best grade) of every whole text."""

    def judge(texts: list[str | None]) -> dict[str, list]:
        tails = [model.tails(t) for t in texts]
        return {"expected_grade": [float(t.sum()) for t in tails], "p_clean": [float(t[0]) for t in tails], "p_good": [float(t[1]) for t in tails]}

    return mapped(docs, text, {k: ("double", pa.float64()) for k in ("expected_grade", "p_clean", "p_good")}, judge)
