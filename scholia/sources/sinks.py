"""Writing extraction results, exports and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.text import fill
from scholia.session import cut_lineage


def result_name(
    pattern: str, document: Column, prompt_name: Column, prompt_id: Column,
    alias: Column, model: Column, image_stem: Column | None = None,
) -> Column:
    """Name of a result file; unknown placeholders stay."""
    base = F.regexp_extract(document, r"[^/]*$", 0)
    base = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    values = {
        "base": base, "prompt_name": prompt_name, "prompt_id": prompt_id,
        "model_alias": alias, "model_name": model,
    }
    if image_stem is not None:
        values["image_stem"] = image_stem
    return fill(F.lit(pattern), values)


#: Hash buckets of a merged table below each of its folders.
BUCKETS = 64


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_merged(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Rows of a table written by :func:`merge_rows`."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path).drop("bucket")


def merge_rows(
    new: DataFrame, path: str, keys: list[str], folders: list[str], order: list[str] | None = None, buckets: int = BUCKETS, fmt: str = "parquet",
) -> None:
    """Puts rows into a table of one row per key; a new row replaces the old one.

    The table lies in folders by column and, below, in hash buckets of the key. Only
    buckets that get rows are read and written again, so a run over new documents
    leaves all other rows where they are. Of several new rows of a key the one that
    comes last in ``order``, else the greatest, counts. The number of buckets has to stay.

    ``folders`` are columns of few values (prompts, models): a line per bucket that
    gets rows comes to the driver, at most their number times ``buckets``.
    """
    spark = new.sparkSession
    rest = [c for c in new.columns if c not in keys]
    row = F.struct(*(rest or keys))
    last = F.max_by(row, F.struct(*order)) if order else F.max(row)
    rows = new.groupBy(*keys).agg(last.alias("_row")).select(*keys, *([F.col(f"_row.{c}").alias(c) for c in rest]))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int"))
    rows = cut_lineage(rows)
    places = [*folders, "bucket"]
    touched = rows.select(*places).distinct().collect()
    if not touched:
        return
    out = rows
    if path_exists(spark, path):
        old = spark.read.format(fmt).load(path)
        for place in places:
            # values of the folders prune what is listed and read
            old = old.where(F.col(place).cast("string").isin(sorted({str(t[place]) for t in touched if t[place] is not None})))
        here = rows.select(*places).distinct()
        old = old.join(F.broadcast(here), places, "left_semi").join(rows.select(*keys), keys, "left_anti")
        out = old.unionByName(rows, allowMissingColumns=True)
    # rows of a folder meet in few files; adaptive execution splits a hot one
    writer = out.hint("rebalance", *places).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*places).format(fmt).save(path)


def write_extractions(df: DataFrame, path: str, layout: str = "flat", fmt: str = "parquet", buckets: int = BUCKETS) -> None:
    """One row per document, prompt and model, in folders by prompt and model.

    A run replaces the rows of the documents it holds and keeps all others. The mirror
    layout adds the directory of the document as a column.
    """
    keys = ["document_path", "prompt_name", "model_alias"]
    if layout == "mirror":
        df = df.withColumn("rel_dir", F.regexp_replace(F.regexp_extract("document_path", r"^(.*/)?", 0), "/$", ""))
    merge_rows(df, path, keys, ["prompt_name", "model_alias"], buckets=buckets, fmt=fmt)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report lines as text; the part files in name order are the report."""
    lines.orderBy("section", "pos").select("line").write.mode(mode).text(path)
