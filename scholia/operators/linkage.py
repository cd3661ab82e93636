"""Record linkage of document entries with a table of bibliographic works.

``works`` always has ``doi, title, first_author, year`` with unique DOIs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.chunked import heavy_join
from scholia.functions.names import authors_match
from scholia.functions.text import SPACE, last_of, strip_supplement, words
from scholia.operators.candidates import set_key, similar_sets, top_overlap
from scholia.session import cut_lineage
from scholia.vocab import (
    AUTO_SCORE, BEST_AUTHOR_BONUS, BEST_YEAR_EXACT_BONUS, BEST_YEAR_NEAR_BONUS,
    CACHE_VERSION, CLUE_AUTHOR_POINTS, CLUE_CANDIDATES, CLUE_KEYWORD_POINTS,
    CLUE_YEAR_EXACT_POINTS, CLUE_YEAR_NEAR_POINTS, REVIEW_SCORE, TITLE_CANDIDATES,
)


def _search(entries: DataFrame, tokens: Column, items: DataFrame, n: int) -> DataFrame:
    """``top_overlap`` of the entries' token sets, at the entries: adds ``doi, overlap, rank``.

    Tokens are found once. Entries without any have no result and do not move.
    """
    # a filter before the cut would be pushed below the tokens and find them again
    keyed = cut_lineage(entries.withColumn("q", tokens).withColumn("_q", set_key(F.col("q")))).filter(F.size("q") > 0)
    found = top_overlap(keyed.select("q"), items, n)
    rows = heavy_join(keyed.drop("q"), found.withColumnRenamed("q", "_q"), ["_q"])
    return rows.drop("_q").withColumnRenamed("item", "doi")


def title_candidates(
    entries: DataFrame, works: DataFrame, key: str, title: str, n: int = TITLE_CANDIDATES
) -> DataFrame:
    """n works per entry by shared title words: adds ``doi, overlap, rank``."""
    items = works.select(F.col("doi").alias("item"), words(F.col("title")).alias("tokens"))
    return _search(entries.select(key, title), words(F.col(title)), items, n).select(key, "doi", "overlap", "rank")


def pick_best(
    candidates: DataFrame, works: DataFrame, key: str,
    author: Column | None = None, year: Column | None = None,
) -> DataFrame:
    """Best candidate per entry; a tie goes to the earlier candidate.

    Adds ``doi, title, first_author, year, score``; ``author`` and ``year`` are
    expressions over the candidate columns giving what the entry expects.
    """
    scored = candidates.withColumn("_author", author if author is not None else F.lit(""))
    scored = scored.withColumn("_year", year if year is not None else F.lit(None).cast("int"))
    scored = scored.select(key, "doi", "overlap", "rank", "_author", "_year").join(
        works.select("doi", "title", "first_author", "year"), "doi"
    )
    gap = F.abs(F.col("year") - F.col("_year"))
    score = (
        F.col("overlap")
        + F.when(authors_match(F.col("_author"), F.col("first_author")), BEST_AUTHOR_BONUS).otherwise(0)
        + F.when(gap == 0, BEST_YEAR_EXACT_BONUS).when(gap <= 1, BEST_YEAR_NEAR_BONUS).otherwise(0)
    )
    best = F.struct("doi", "title", "first_author", "year", F.col("score").cast("int").alias("score"))
    return (
        scored.withColumn("score", score)
        .groupBy(key)
        .agg(F.max_by(best, F.struct("score", -F.col("rank"))).alias("best"))
        .select(key, "best.*")
    )


def author_pairs(entries: DataFrame, works: DataFrame, block: list[str]) -> DataFrame:
    """Entries and works of equal ``block`` columns, and whether their authors match: adds ``same_author``.

    ``entries`` has ``json_author`` and ``works`` has ``first_author``. The names that meet are
    compared once, not once for each pair of their rows; all pairs are returned.
    """
    left, right = [*block, "json_author"], [*block, "first_author"]
    met = entries.select(*left).distinct().join(works.select(*right).distinct(), block)
    names = met.select("json_author", "first_author").distinct()
    same = authors_match(F.col("json_author"), F.col("first_author"))
    judged = cut_lineage(names.select("*", same.alias("same_author")))
    judged = met.join(judged, ["json_author", "first_author"])
    return entries.join(judged, left).join(works, right)


def lookup_by_doi(df: DataFrame, works: DataFrame, doi: str = "doi") -> DataFrame:
    """Adds ``found_title, found_author, note`` of the work with this DOI."""
    found = works.select(
        F.col("doi").alias(doi), F.col("title").alias("found_title"),
        F.col("first_author").alias("found_author"), F.lit(True).alias("_hit"),
    )
    return (
        df.join(found, doi, "left")
        .withColumn("note", F.when(F.col("_hit"), "ok").otherwise("not_found"))
        .drop("_hit")
    )


def _clue_tokens(author: Column, year: Column, keywords: Column) -> Column:
    """Search keys of a clue set; a known year becomes part of every key."""
    suffix = F.coalesce(F.concat(F.lit("|"), year.cast("string")), F.lit(""))
    text_keys = F.transform(keywords, lambda k: F.concat(F.lit("t:"), F.lower(k), suffix))
    name_keys = F.transform(words(author), lambda a: F.concat(F.lit("a:"), a, suffix))
    keys = F.array_distinct(F.concat(text_keys, name_keys))
    only_year = F.array(F.concat(F.lit("y:"), suffix))
    return F.when((F.size(keys) == 0) & year.isNotNull(), only_year).otherwise(keys)


def _work_tokens() -> Column:
    """All keys under which a work can be found by clues."""
    suffix = F.concat(F.lit("|"), F.col("year").cast("string"))
    plain = F.concat(
        F.transform(words(F.col("title")), lambda t: F.concat(F.lit("t:"), t)),
        F.transform(words(F.col("first_author")), lambda a: F.concat(F.lit("a:"), a)),
    )
    dated = F.transform(plain, lambda k: F.concat(k, suffix))
    return F.when(
        F.col("year").isNotNull(), F.concat(plain, dated, F.array(F.concat(F.lit("y:"), suffix)))
    ).otherwise(plain)


def clue_candidates(
    clues: DataFrame, works: DataFrame, key: str, n: int = CLUE_CANDIDATES
) -> DataFrame:
    """n works per clue set, found by keywords in the title and author name.

    ``clues`` has ``author, year, keywords``; a known year must be equal.  Clue
    sets without any clue give no row.
    """
    tokens = _clue_tokens(F.col("author"), F.col("year"), F.col("keywords"))
    items = works.select(F.col("doi").alias("item"), _work_tokens().alias("tokens"))
    return _search(clues.select(key, "author", "year", "keywords"), tokens, items, n).select(
        key, "doi", "overlap", "rank"
    )


def clue_score(
    author: Column, year: Column, keywords: Column,
    work_author: Column, work_title: Column, work_year: Column,
) -> Column:
    """0 to 100 from surname, year and the share of keywords in the title."""
    surname = last_of(F.filter(F.split(work_author, rf"{SPACE}+"), lambda p: p != ""))
    by_author = F.when(authors_match(author, surname), CLUE_AUTHOR_POINTS).otherwise(0)
    gap = F.abs(work_year.try_cast("int") - year)
    by_year = (
        F.when(gap == 0, CLUE_YEAR_EXACT_POINTS).when(gap <= 1, CLUE_YEAR_NEAR_POINTS).otherwise(0)
    )
    title = F.lower(work_title)
    hits = F.size(F.filter(keywords, lambda k: F.contains(title, F.lower(k))))
    by_keyword = F.when(
        (F.size(keywords) > 0) & (work_title != ""),
        F.floor(hits / F.size(keywords) * CLUE_KEYWORD_POINTS),
    ).otherwise(0)
    return F.least(by_author + by_year + by_keyword, F.lit(100)).cast("int")


def confidence_band(score: Column) -> Column:
    return (
        F.when(score >= AUTO_SCORE, "auto").when(score >= REVIEW_SCORE, "review").otherwise("skip")
    )


def similarity_join(
    left: DataFrame, right: DataFrame, left_tokens: Column, right_tokens: Column,
    left_id: str, right_id: str, threshold: float,
) -> DataFrame:
    """All pairs of distinct titles with Jaccard similarity >= threshold.

    A row stands for two token sets and says how many rows of each side have
    them and which is the smallest; copies are not multiplied out.
    """
    # tokens are found once
    left = cut_lineage(left.select(left_id, left_tokens.alias("l")))
    right = cut_lineage(right.select(right_id, right_tokens.alias("r")))
    pairs = similar_sets(left.select("l"), right.select("r"), threshold)

    def members(df: DataFrame, key: str, side: str, name: str) -> DataFrame:
        return df.groupBy(set_key(F.col(side)).alias(side)).agg(
            F.min(key).alias(f"{name}_id"), F.count("*").alias(f"{name}_rows")
        )

    return (
        pairs.join(members(left, left_id, "l", "left"), "l")
        .join(members(right, right_id, "r", "right"), "r")
    )


def entry_class(title: Column, author: Column) -> Column:
    """A has title and author, B a title only, C no title."""
    has_title = F.coalesce(title, F.lit("")) != ""
    has_author = F.coalesce(author, F.lit("")) != ""
    return F.when(has_title & has_author, "A").when(has_title, "B").otherwise("C")


def verify_author(entries: DataFrame, best: DataFrame, works: DataFrame, key: str) -> DataFrame:
    """Author check of the best candidate, with one retry under the base DOI.

    ``entries`` has ``json_author``; ``best`` has ``doi, first_author``.  The
    result adds ``cr_doi, cr_author, match, note``.
    """
    first = entries.join(
        best.select(key, F.col("doi").alias("_doi"), F.col("first_author").alias("_author")), key, "left"
    )
    base = works.select(
        F.col("doi").alias("_base"), F.col("first_author").alias("_base_author")
    )
    author = F.coalesce(F.col("json_author"), F.lit(""))
    tried = first.withColumn(
        "_base", F.when(strip_supplement(F.col("_doi")) != F.col("_doi"), strip_supplement(F.col("_doi")))
    ).join(base, "_base", "left")
    direct = authors_match(author, F.col("_author"))
    retry = authors_match(author, F.col("_base_author"))
    found = F.col("_doi").isNotNull()
    mismatch = F.concat(
        F.lit("author_mismatch: "), author, F.lit(" vs "), F.coalesce(F.col("_author"), F.lit("?"))
    )
    note = (
        F.when(~found, "not_found")
        .when(author == "", "no_author_to_verify")
        .when(direct, "ok")
        .when(retry, "ok (stripped suffix)")
        .otherwise(mismatch)
    )
    stripped = F.col("_note") == "ok (stripped suffix)"
    return (
        tried.withColumn("_note", note)
        .select(
            *entries.columns,
            F.when(stripped, F.col("_base")).otherwise(F.col("_doi")).alias("cr_doi"),
            F.when(stripped, F.col("_base_author")).otherwise(F.col("_author")).alias("cr_author"),
            F.col("_note").isin("ok", "ok (stripped suffix)").alias("match"),
            F.col("_note").alias("note"),
        )
    )


def lookup_unverified(entries: DataFrame, best: DataFrame, key: str) -> DataFrame:
    """Entries without an author match as soon as a DOI is found."""
    found = best.select(key, F.col("doi").alias("cr_doi"), F.col("first_author").alias("cr_author"))
    hit = F.col("cr_doi").isNotNull()
    note = F.when(
        hit, F.concat(F.lit("found: "), F.col("cr_doi"), F.lit(" (no author verify)"))
    ).otherwise("not_found")
    return entries.join(found, key, "left").withColumn("match", hit).withColumn("note", note)


def resolve_supplements(
    entries: DataFrame, results: DataFrame, works: DataFrame, key: str, known: DataFrame | None = None
) -> DataFrame:
    """Second look-up under a known DOI, else under the DOI without its suffix.

    ``known(key, known_doi)`` is optional; entries whose DOI does not change and
    that are not known give no row.
    """
    base = entries.select(key, "json_author").join(results.select(key, "cr_doi"), key, "left")
    if known is None:
        base = base.withColumn("known_doi", F.lit(None).cast("string"))
    else:
        base = base.join(known, key, "left")
    stripped = F.when(strip_supplement(F.col("cr_doi")) != F.col("cr_doi"), strip_supplement(F.col("cr_doi")))
    base = base.withColumn("new_doi", F.coalesce("known_doi", stripped)).filter(F.col("new_doi").isNotNull())
    looked = lookup_by_doi(base, works, "new_doi")
    return looked.select(
        key,
        F.col("new_doi").alias("cr_doi"),
        F.col("found_author").alias("cr_author"),
        "json_author",
        authors_match(F.col("json_author"), F.col("found_author")).alias("match"),
        F.substring("found_title", 1, 60).alias("cr_title"),
    )


def unmatched(entries: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Entries without a title that no stage matched, and failed title-only ones.

    ``entries`` has ``entry_class``; a title-only entry counts as failed when it
    was tried and has no DOI.
    """
    matched = results.filter(F.col("cr_doi").isNotNull()).select(key)
    failed = results.filter(F.col("cr_doi").isNull()).select(key)
    no_title = entries.filter(F.col("entry_class") == "C").join(matched, key, "left_anti")
    title_only = (
        entries.filter(F.col("entry_class") == "B")
        .join(failed, key, "left_semi")
        .join(matched, key, "left_anti")
    )
    return no_title.unionByName(title_only)


def cascade(stages: list[DataFrame], key: str) -> DataFrame:
    """One row per key: the first stage that found a DOI, else the last tried."""
    tagged = [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = F.struct(*[c for c in rows.columns if c != key])
    hit = F.col("cr_doi").isNotNull()
    order = F.when(hit, F.col("stage")).otherwise(F.lit(1000) - F.col("stage"))
    return (
        rows.groupBy(key)
        .agg(F.min_by(rest, order).alias("_row"))
        .select(key, "_row.*")
        .drop("stage")
    )


def clue_stage(clues: DataFrame, works: DataFrame, key: str) -> DataFrame:
    """Clue fall-back: best clue candidate with its score, or why there is none."""
    candidates = clue_candidates(clues, works, key)
    expected = candidates.join(clues.select(key, "author", F.col("year").alias("clue_year")), key)
    best = pick_best(expected, works, key, F.col("author"), F.col("clue_year"))
    best = best.select(
        key, F.col("doi").alias("cr_doi"), F.col("title").alias("final_title"),
        F.col("first_author").alias("cr_author"), F.col("year").alias("cr_year"),
    )
    rows = clues.select(key, "author", "year", "keywords").join(best, key, "left")
    score = clue_score(
        F.col("author"), F.col("year"), F.col("keywords"),
        F.col("cr_author"), F.col("final_title"), F.col("cr_year"),
    )
    none = (F.col("author") == "") & F.col("year").isNull() & (F.size("keywords") == 0)
    rows = rows.withColumn("clue_score", F.when(F.col("cr_doi").isNotNull(), score).otherwise(0))
    auto = F.col("cr_doi").isNotNull() & (F.col("clue_score") >= AUTO_SCORE)
    note = (
        F.when(none, "clue: insufficient_clues")
        .when(F.col("cr_doi").isNull(), "clue: no_results")
        .otherwise(
            F.concat(
                F.lit("clue: score="), F.col("clue_score").cast("string"),
                F.when(auto, " (auto)").otherwise(" (review)"),
            )
        )
    )
    return rows.select(
        key, "cr_doi", "cr_author", "final_title", auto.alias("match"), note.alias("note"),
        "clue_score", F.lit("clue").alias("source"),
    )


def apply_manual(results: DataFrame, manual: DataFrame, key: str) -> DataFrame:
    """Confirmed DOIs override what was found."""
    rows = results.join(manual.select(key, F.col("doi").alias("_manual")), key, "left")
    confirmed = F.col("_manual").isNotNull()
    return rows.select(
        *[c for c in results.columns if c not in ("cr_doi", "match", "note", "source")],
        F.coalesce("_manual", "cr_doi").alias("cr_doi"),
        F.when(confirmed, True).otherwise(F.col("match")).alias("match"),
        F.when(confirmed, "manual_verify").otherwise(F.col("note")).alias("note"),
        F.when(confirmed, "manual").otherwise(F.col("source")).alias("source"),
    )


def cache_lookup(entries: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Adds the cached DOI where a current cache row has one.

    ``cached`` tells which entries are answered; the others go on to a look-up.
    """
    usable = cache.filter((F.col("version") == CACHE_VERSION) & (F.coalesce("doi", F.lit("")) != ""))
    usable = usable.select(
        key, F.col("doi").alias("cached_doi"), F.col("author").alias("cached_author"),
        F.col("match").alias("cached_match"), F.col("note").alias("cached_note"),
    )
    rows = entries.join(usable, key, "left")
    return rows.withColumn("cached", F.col("cached_doi").isNotNull())
