"""Corpus pipeline: quality, language, near copies, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the
result is written as Parquet and read again. All stages but the last return the columns
of documents and drop others; an empty table gives an empty table; null texts count as
the operators say; rows that share a doc_id are rows of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import bpe, jaccard, language, mixing, quality
from scholia.llm.queries import held_out, vocabulary_path
from scholia.session import cut_lineage, ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of a smaller chance of the best grade go.
LEAST_GOOD = 0.4


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: a fit on rated documents; toxic and poor ones go. All stay where the ratings tell no texts apart."""
    model = quality.fit(quality.graded(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    if not model.weights.any():
        return docs.select(*COLUMNS)
    return quality.score(docs, model).where(F.col("p_good") >= LEAST_GOOD).select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: what has no letters or is far from every learned language goes. All stay where none was learned."""
    model = language.fit(docs.where(~held_out("doc_id")))
    if not model.names:
        return docs.select(*COLUMNS)
    return language.predict(docs, model).where(~F.col("lang_rejected")).select(*COLUMNS)


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """docs whose key is not in gone; up to jaccard.BROADCAST_ROWS keys are sent to all tasks, so that no text moves."""
    gone = cut_lineage(gone)
    few = gone.limit(jaccard.BROADCAST_ROWS + 1).count() <= jaccard.BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, key, "left_anti")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the smallest doc_id of each group of similar documents stays; documents without words or id stay.

    Rows that share a doc_id are told apart by their texts: each takes part with a
    number of its own above all ids, and of equal rows one stays.
    """
    copies = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if copies.isEmpty():
        groups = jaccard.similar_groups(docs.select("doc_id", "text"))
        gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
        return without(docs, gone, "doc_id").select(*COLUMNS)
    again = docs.select(*COLUMNS).join(copies.withColumn("again", F.lit(True)), "doc_id", "left")
    own = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    keyed = again.withColumn("row_key", F.when(F.col("again"), own).otherwise(F.col("doc_id").cast("long")))
    groups = jaccard.similar_groups(keyed.select("row_key", "text"), key="row_key")
    gone = groups.where("component_id <> row_key").select("row_key").distinct()
    kept = without(keyed, gone, "row_key")
    one = kept.where("again").groupBy("doc_id", "row_key").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.where("again IS NULL").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document once, documents of small sources up to twice, by temperature."""
    return mixing.mix_sources(docs, most_passes=2.0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-pair encoding and decoding of every whole text."""
    path = vocabulary_path()
    out = bpe.round_trip(docs.select("doc_id", "text", "lang", "source"), path)
    return out.select("doc_id", "lang", "source", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good),
    ("language", keep_known_languages),
    ("near_copies", one_of_each_group),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: Trained models and the tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}-{name}")
        docs = spark.read.parquet(f"{folder}/{place}-{name}")
    return docs
