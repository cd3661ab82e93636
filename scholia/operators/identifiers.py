"""Identifiers and clues in file names and DOIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import doi_to_file, file_to_doi, first_of, let, strip_supplement
from scholia.vocab import FILENAME_COMMON_WORDS


def is_doi_name(name: Column) -> Column:
    return name.rlike(r"^10[._]\d{4,}")


def is_publisher_name(name: Column) -> Column:
    return name.startswith("1-s2.0-") & F.lower(name).endswith(".pdf")


def classify_identifiers(df: DataFrame, name: str) -> DataFrame:
    """Adds what the file name itself identifies: DOI, publisher item, neither."""
    col = F.col(name)
    pii = F.regexp_extract(col, r"^1-s2\.0-(S\d+)", 1)
    part = lambda i: F.regexp_extract("pii", r"^S(\d{8})(\d{2})(\d{5,6})", i)
    df = df.withColumn("pii", pii).withColumn("issn", part(1))
    df = df.withColumn("pub_year", F.when(F.col("issn") != "", F.concat(F.lit("20"), part(2))).otherwise(""))
    df = df.withColumn("seq", part(3))
    described = (
        F.when(F.col("pii") == "", F.concat(col, F.lit(": not a publisher item name")))
        .when(F.col("issn") == "", F.concat(F.lit("PII: "), F.col("pii"), F.lit(" (malformed)")))
        .otherwise(
            F.concat_ws(
                " | ",
                F.concat(F.lit("PII: "), F.col("pii")),
                F.concat(F.lit("ISSN: "), F.col("issn")),
                F.concat(F.lit("year: "), F.col("pub_year")),
                F.concat(F.lit("item: "), F.col("seq")),
                F.lit("DOI by title look-up"),
            )
        )
    )
    kind = (
        F.when(is_doi_name(col), "doi").when(is_publisher_name(col), "publisher").otherwise("other")
    )
    return (
        df.withColumn("is_doi_pdf", is_doi_name(col))
        .withColumn("is_publisher_pii", is_publisher_name(col))
        .withColumn("description", described)
        .withColumn("name_class", kind)
    )


def identifier_counts(df: DataFrame, name: str) -> DataFrame:
    return classify_identifiers(df.select(name), name).groupBy("name_class").agg(F.count("*").alias("files"))


def safe_title(title: Column) -> Column:
    """Free text as a file name: reserved characters replaced, 200 characters kept."""
    return F.substring(F.regexp_replace(title, r'[\\/:*?"<>|]', "_"), 1, 200)


def doi_round_trip(df: DataFrame, doi: str) -> DataFrame:
    """DOIs that a safe file name cannot be turned back into."""
    return (
        df.select(doi, doi_to_file(F.col(doi)).alias("file_name"))
        .withColumn("restored", file_to_doi(F.col("file_name")))
        .filter(F.col("restored") != F.col(doi))
    )


def fold_supplements(df: DataFrame, doi: str) -> DataFrame:
    """Base DOIs with the number of rows and of supplements folded into them."""
    base = strip_supplement(F.col(doi))
    return (
        df.select(base.alias("base_doi"), (base != F.col(doi)).alias("_s"))
        .groupBy("base_doi")
        .agg(F.count("*").alias("rows"), F.count_if("_s").alias("supplements"))
    )


def filename_clues(df: DataFrame, name: str) -> DataFrame:
    """Adds ``author, year, keywords, segments, confidence`` from a file name.

    Everything is done on arrays inside the row, so no shuffle is needed.
    """
    stem = F.regexp_replace(F.col(name), r"(?i)\.pdf$", "")
    pieces = F.flatten(
        F.transform(
            F.split(stem, r"[_\s]+"),
            lambda p: F.split(p, r"(?<=[A-Za-z])-(?=\d)|(?<=\d)-(?=[A-Za-z])"),
        )
    )
    clues = let(F.filter(pieces, lambda s: s != ""), _clues_of_segments)
    return df.withColumn("_c", clues).select(*df.columns, "_c.*")


def _clues_of_segments(segments: Column) -> Column:
    common = F.array(*[F.lit(w) for w in FILENAME_COMMON_WORDS])
    marked = F.transform(
        segments,
        lambda s, i: F.struct(
            i.alias("i"),
            s.alias("s"),
            s.rlike(r"^(?:19|20)\d{2}$").alias("is_year"),
            (~s.rlike(r"^\p{Nd}+$") & ~F.array_contains(common, F.lower(s))).alias("is_word"),
        ),
    )

    def with_year(m: Column) -> Column:
        year = first_of(F.filter(m, lambda x: x.is_year))
        return let(F.struct(m.alias("m"), year.alias("year")), with_author)

    def with_author(v: Column) -> Column:
        named = F.filter(v.m, lambda x: x.is_word & (F.length(x.s) >= 2))
        before = first_of(F.filter(named, lambda x: x.i < v.year.i))
        after = first_of(F.filter(named, lambda x: (x.i > v.year.i) & (x.i + 1 < F.size(v.m))))
        author = F.when(v.year.isNotNull(), F.coalesce(before, after)).otherwise(first_of(named))
        return let(
            F.struct(v.m.alias("m"), v.year.alias("year"), author.alias("author")), finished
        )

    def finished(v: Column) -> Column:
        author = F.coalesce(v.author.s, F.lit(""))
        hyphen_parts = F.when(F.contains(author, F.lit("-")), F.split(F.lower(author), "-"))
        kept = F.filter(
            v.m,
            lambda x: x.is_word
            & (x.i != F.coalesce(v.year.i, F.lit(-1)))
            & (x.i != F.coalesce(v.author.i, F.lit(-1)))
            & (F.lower(x.s) != F.lower(author))
            & ~F.coalesce(F.array_contains(hyphen_parts, F.lower(x.s)), F.lit(False)),
        )
        has_year, size = v.year.isNotNull(), F.size(v.m)
        confidence = (
            F.when(has_year, 0.3).otherwise(0.0)
            + F.when(author != "", 0.3).otherwise(0.0)
            + F.when(has_year & (size >= 3), 0.2).otherwise(0.0)
            + F.when(size >= 2, 0.2).otherwise(0.0)
        )
        return F.struct(
            author.alias("author"),
            v.year.s.cast("int").alias("year"),
            F.transform(kept, lambda x: x.s).alias("keywords"),
            segments.alias("segments"),
            F.least(F.round(confidence, 2), F.lit(1.0)).alias("confidence"),
        )

    return let(marked, with_year)
