"""Scanning corpora and reading the small formats around them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.text import strip
from scholia.operators.semi import parse_whole
from scholia.sources.hidden import hidden_texts

# --- fixed values: file endings and the reader they belong to -----------------
READERS = {".pdf.txt": "pdf_text", ".pdf_text": "pdf_text", ".md": "markdown", ".txt": "text"}


def glob_regex(pattern: str) -> str:
    """Regular expression of a shell pattern whose ``*`` also crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", r"\\")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            i = end
        else:
            out += re.sub(r"([.^$+(){}|\\\[\]])", r"\\\1", c)
        i += 1
    return f"(?s)^{out}$"


def exclude_globs(df: DataFrame, patterns: list[str], root: str, rel_path: str = "rel_path") -> DataFrame:
    """Drops files that match a pattern or lie in a folder below the root that does."""
    if not patterns:
        return df
    steps = F.split(F.replace(F.col(rel_path), F.lit("\\"), F.lit("/")), "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda i: F.concat(F.lit(root.rstrip("/") + "/"), F.array_join(F.slice(steps, F.lit(1), i), "/")),
    )
    any_of = "|".join(f"(?:{glob_regex(p)})" for p in patterns)
    return df.filter(~F.exists(ancestors, lambda path: path.rlike(any_of)))


def plain_path(column: Column) -> Column:
    """Plain path of a file URI."""
    return F.regexp_replace(F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B"))), r"^file:/+", "/")


def scan_corpus(
    spark: SparkSession, root: str, extensions: list[str], recursive: bool = True,
    exclude: list[str] | None = None, hidden: bool = True,
) -> DataFrame:
    """``path, rel_path, name, text``: one row per matching file, whole text.

    Names are matched by their ending, when files are listed; files that match
    an exclusion are dropped right after the scan.  Hidden files, which Spark's
    text source passes over, are read as well.
    """
    root = root.rstrip("/")
    reader = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", recursive)
        .option("pathGlobFilter", "{" + ",".join(f"*{e}" for e in extensions) + "}")
    )
    raw = reader.load(root).select("_metadata.file_path", "_metadata.file_name", F.col("value").alias("text"))
    path = plain_path(F.col("file_path"))
    df = raw.select(path.alias("path"), "text")
    df = df.withColumn("rel_path", F.expr(f"substring(path, {len(root) + 2})"))
    df = df.withColumn("name", F.regexp_extract("path", r"[^/]*$", 0))
    if not recursive:
        df = df.filter(~F.contains("rel_path", F.lit("/")))
    if hidden:
        more = hidden_texts(spark, root, extensions, recursive)
        df = df.unionByName(more.select(
            F.concat(F.lit(plain_root(root) + "/"), "rel_path").alias("path"), "text", "rel_path",
            F.regexp_extract("rel_path", r"[^/]*$", 0).alias("name"),
        ))
    return exclude_globs(df, exclude or [], root)


def plain_root(root: str) -> str:
    """A root as plain paths show it."""
    return re.sub(r"^file:/+", "/", root.rstrip("/"))


def reader_kind(name: Column, allowed: list[str] | None = None) -> Column:
    """Reader for a file name, compound endings first; NULL when there is none."""
    allowed = allowed or list(READERS)
    lower = F.lower(name)
    kinds = [F.when(lower.endswith(e), k) for e, k in READERS.items() if e in allowed]
    if ".pdf.txt" in allowed:
        kinds.append(F.when(lower.endswith(".pdf"), READERS[".pdf.txt"]))
    return F.coalesce(*kinds)


def route_format(df: DataFrame, name: str = "name", allowed: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with their reader, and rows no reader takes."""
    rows = df.withColumn("reader", reader_kind(F.col(name), allowed))
    rejects = rows.filter(F.col("reader").isNull()).drop("reader")
    return rows.filter(F.col("reader").isNotNull()), rejects.withColumn("reason", F.lit("permanent: no reader"))


def load_extractions(spark: SparkSession, root: str) -> DataFrame:
    """Title, author and DOI per folder, from its first full extraction that parses."""
    files = scan_corpus(spark, root, [".json"])
    files = files.filter(F.contains("name", F.lit("full_extraction")) & F.contains("rel_path", F.lit("/derived/")))
    folder = F.regexp_extract("rel_path", r"^(.*)/derived/[^/]*$", 1)
    rows = files.select(folder.alias("folder"), "name", parse_whole(F.col("text")).alias("body"))
    rows = rows.filter(F.col("body").isNotNull() & F.schema_of_variant("body").startswith("OBJECT"))

    def value(name: str, *blank: str) -> Column:
        text = strip(F.coalesce(F.try_variant_get("body", f"$.paper_metadata.{name}", "string"), F.lit("")))
        return F.when(text.isin(*blank), "").otherwise(text)

    fields = F.struct(
        value("title", "not reported").alias("json_title"),
        value("first_author", "not reported").alias("json_author"),
        value("doi", "not reported", "None").alias("json_doi"),
    )
    return rows.groupBy("folder").agg(F.min_by(fields, "name").alias("f")).select("folder", "f.*")


def scan_entries(names: DataFrame, extractions: DataFrame, name: str = "pdf_name") -> DataFrame:
    """File names with what was extracted for the folder of the same stem."""
    stem = F.regexp_replace(name, r"(?i)\.pdf$", "")
    known = extractions.withColumn("_hit", F.lit(True))
    rows = names.withColumn("folder", stem).join(known, "folder", "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(
        name, F.coalesce("_hit", F.lit(False)).alias("folder_exists"),
        blank("json_title"), blank("json_author"), blank("json_doi"),
    )


def parse_bib(text: DataFrame, column: str = "text", order: str = "path") -> DataFrame:
    """``doi, title, first_author`` per lower-cased DOI; the last entry counts."""
    rows = text.select(order, F.posexplode(F.split(column, r"@\w+\{", -1)).alias("pos", "entry"))
    field = lambda n: F.regexp_extract("entry", rf"{n}\s*=\s*\{{([^}}]+)\}}", 1)
    first = F.get(F.split(field("author"), " and "), F.lit(0))
    first = strip(F.regexp_replace(first, r"[\\{}~^'\"]", ""))
    author = F.when(F.contains(first, F.lit(",")), strip(F.get(F.split(first, ","), F.lit(0)))).otherwise(first)
    rows = rows.withColumn("doi", F.lower(strip(field("DOI"))))
    rows = rows.filter((F.col("doi") != "") & F.col("entry").rlike(r"^[^,]"))
    fields = F.struct(F.nullif(field("title"), F.lit("")).alias("title"), author.alias("first_author"))
    return rows.groupBy("doi").agg(F.max_by(fields, F.struct(order, "pos")).alias("f")).select("doi", "f.*")


def read_bib(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("text").option("wholetext", True).load(path)
    return parse_bib(raw.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path")))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not blank."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("id"))
    return lines.filter(F.col("id") != "")


def read_manual_map(spark: SparkSession, path: str) -> DataFrame:
    """``pdf_name, doi`` from a JSON object of confirmed matches."""
    raw = spark.read.format("text").option("wholetext", True).load(path)
    pairs = F.explode(F.from_json("value", "map<string,string>")).alias("pdf_name", "doi")
    return raw.select(pairs)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Look-up cache rows with the version of their file; a broken file has none."""
    raw = spark.read.format("text").option("wholetext", True).load(path)
    entry = "struct<doi:string,author:string,title:string,match:boolean,note:string,ts:string,renamed_to:string>"
    schema = f"struct<version:int,entries:map<string,{entry}>>"
    rows = raw.select(F.from_json("value", schema).alias("c"))
    rows = rows.select("c.version", F.explode("c.entries").alias("pdf_name", "e"))
    return rows.select("pdf_name", "version", "e.*")
