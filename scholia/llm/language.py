"""Language identification by nearest centroid.

A text is the TF-IDF vector of its hashed letter grams (one to three characters,
logarithmic counts, unit length). Document counts come from all training rows.
Each language has several centroids, found by spherical k-means on a bounded
sample. A text gets the language of the centroid of the largest cosine; it is
rejected where the cosine is below the level that almost all training texts of
the centroid reach.

Defined results: a null text or one without a letter is `UNKNOWN` with score 0
and rejected; ties go to the smaller language name; training rows with a null
language or text are left out; without training rows every text is `UNKNOWN`.
Repeated rows are judged each; clashing columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.hashed import gram_buckets, mapped

UNKNOWN = "und"
BITS = 12


@dataclass(frozen=True)
class LanguageModel:
    """What a fit gives: languages x centroids x 2^bits numbers, whatever the corpus."""

    bits: int
    idf: np.ndarray
    names: list[str]
    centroids: np.ndarray
    least: np.ndarray

    def vector(self, text: str) -> np.ndarray | None:
        return weighted(text, self.bits, self.idf)


def weighted(text: str | None, bits: int, idf: np.ndarray) -> np.ndarray | None:
    """Unit TF-IDF vector, or None without letters."""
    counts = np.bincount(gram_buckets(text, bits), minlength=1 << bits) if text else np.zeros(1)
    if not counts.any():
        return None
    v = np.log1p(counts) * idf
    norm = np.sqrt(v @ v)
    return (v / norm).astype(np.float32) if norm > 0 else None


def document_counts(docs: DataFrame, text: str, bits: int) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, over all rows; the driver gets 2^bits sums."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) + 1, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                found = np.zeros((1 << bits) + 1, bool)
                found[gram_buckets(value, bits)] = True
                found[-1] = found.any()
                total += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(counts, "bucket long, n long")
    out = np.zeros((1 << bits) + 1, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out[:-1], int(out[-1])


#: Languages whose rows are thinned before they are dealt; those of fewer rows beyond are dealt whole.
MOST_LANGUAGES = 10_000


def k_means(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; at most k unit centroids."""
    centres = vectors[np.linspace(0, len(vectors) - 1, min(k, len(vectors))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(vectors @ centres.T, axis=1)
        sums = np.stack([vectors[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS, centroids: int = 4,
    per_language: int = 500, share: float = 0.002, slack: float = 0.25,
) -> LanguageModel:
    """Fit on labelled rows. Document counts cover all of them; centroids come from at most per_language rows of a language,
    those of the smallest hash. A centroid's level is slack times the cosine that all but share of its rows reach."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts, n = document_counts(rows, "text", bits)
    idf = np.log((1 + n) / (1 + counts)) + 0.1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(la, v.tobytes()) for t, la in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (v := weighted(t, bits, idf)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in ((0, pa.string()), (1, pa.binary()))], ["lang", "v"])

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        data = np.stack([np.frombuffer(v, np.float32) for v in group.sort_values("v")["v"]])
        centres = k_means(data, centroids)
        cosines = data @ centres.T
        near, best = cosines.argmax(axis=1), cosines.max(axis=1)
        own = [best[near == c] if (near == c).any() else best for c in range(len(centres))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "v": [c.astype(np.float32).tobytes() for c in centres], "least": [float(np.quantile(x, share) * slack) for x in own]})

    # rows of a language beyond a hash threshold cannot be among its first: only few more than are wanted are dealt
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    reach = F.broadcast(sizes.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).select("lang", F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("n")).alias("reach")))
    hashed = rows.withColumn("_h", F.xxhash64("text")).join(reach, "lang", "left")
    near = hashed.where(F.pmod("_h", F.lit(1 << 30)) <= F.coalesce("reach", F.lit(1.0)) * (1 << 30)).withColumn("_h", F.pmod("_h", F.lit(1 << 30)))
    picked = sample(near, "lang", "_h", per_language).select("text", "lang")
    found = picked.mapInArrow(vectors, "lang string, v binary").groupBy("lang").applyInPandas(cluster, "lang string, v binary, least double").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    matrix = np.stack([np.frombuffer(r["v"], np.float32) for r in found]) if found else np.zeros((0, 1 << bits), np.float32)
    return LanguageModel(bits, idf, [r["lang"] for r in found], matrix, np.array([r["least"] for r in found]))


def sample(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """At most n rows of each key, by a random order column; map tasks keep n each before the shuffle."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (cosine from 0 to 1) and lang_rejected of every whole text."""

    def judge(texts: list[str | None]) -> dict[str, list]:
        langs, scores, rejected = [], [], []
        for t in texts:
            v = model.vector(t) if t and model.names else None
            if v is None:
                lang, score, out = UNKNOWN, 0.0, True
            else:
                cosines = model.centroids @ v
                i = int(cosines.argmax())
                lang, score = model.names[i], float(min(1.0, max(0.0, cosines[i])))
                out = score < model.least[i]
            langs.append(lang)
            scores.append(score)
            rejected.append(bool(out))
        return {"lang_pred": langs, "score": scores, "lang_rejected": rejected}

    made = {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64()), "lang_rejected": ("boolean", pa.bool_())}
    return mapped(docs, text, made, judge)
