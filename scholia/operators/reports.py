"""Reports as ordered lines ``(section, pos, line)``, numbered without one big task."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.chunked import number_rows
from scholia.operators.stats import Section, stats_sections
from scholia.vocab import AUTO_SCORE, REVIEW_SCORE


@dataclass(frozen=True)
class Part:
    """A report section: rows that match, and how one of them is written."""

    title: str
    rows: Column
    body: Column
    columns: tuple[str, ...] = ()


def _heading(part: Part, count: Column) -> Column:
    title = F.concat(F.lit(f"## {part.title}: "), count.cast("string"))
    lines = [title, F.lit("")]
    if part.columns:
        lines.append(F.lit("| # | " + " | ".join(part.columns) + " |"))
        lines.append(F.lit("|---" * (len(part.columns) + 1) + "|"))
    return F.array(*lines)


def report_lines(df: DataFrame, parts: list[Part], order: list[str], first: int = 1) -> DataFrame:
    """Lines of all parts; a row may be in several parts, empty parts are left out."""
    picked = F.array_compact(
        F.array(*[F.when(p.rows, F.struct(F.lit(first + i).alias("section"), p.body.alias("body"))) for i, p in enumerate(parts)])
    )
    rows = df.select(*order, F.explode(picked).alias("_p")).select("_p.section", *order, "_p.body")
    rows = number_rows(rows, [*order, "body"], "n", keys=("section",))
    tables = [first + i for i, p in enumerate(parts) if p.columns]
    line = F.when(
        F.col("section").isin(tables), F.concat(F.lit("| "), F.col("n").cast("string"), F.lit(" | "), "body", F.lit(" |"))
    ).otherwise(F.concat(F.lit("- "), "body"))
    items = rows.select("section", F.col("n").alias("pos"), line.alias("line"))
    counts = rows.groupBy("section").agg(F.max("n").alias("_n"))
    heading = F.coalesce(*[F.when(F.col("section") == first + i, _heading(p, F.col("_n"))) for i, p in enumerate(parts)])
    heads = counts.select("section", F.posexplode(heading).alias("_i", "line"))
    heads = heads.select("section", (F.col("_i") - 10).cast("long").alias("pos"), "line")
    return heads.unionByName(items)


def overview_lines(counts: DataFrame, title: str, labels: dict[str, str]) -> DataFrame:
    """Title and a table of counters from a one-row frame, as section 0."""
    lines = [F.lit(f"# {title}"), F.lit(""), F.lit("| Count | Value |"), F.lit("|---|---|")]
    lines += [F.concat(F.lit(f"| {text} | "), F.col(c).cast("string"), F.lit(" |")) for c, text in labels.items()]
    return counts.select(
        F.lit(0).alias("section"), F.posexplode(F.array(*lines, F.lit(""))).alias("pos", "line")
    ).withColumn("pos", F.col("pos").cast("long"))


def _code(column: str, width: int) -> Column:
    return F.concat(F.lit("`"), F.substring(column, 1, width), F.lit("`"))


def _cells(*columns: Column) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("?")) for c in columns])


def match_report(results: DataFrame, conflicts: DataFrame, summary: DataFrame) -> DataFrame:
    """Report of an identity-matching run by outcome."""
    doi, hit, note = F.col("cr_doi").isNotNull(), F.col("match"), F.coalesce("note", F.lit(""))
    author = F.coalesce("final_author", F.lit(""))
    clue, text, name = note.startswith("clue:"), note.startswith("text:"), _code("pdf_name", 45)
    found = F.concat(F.lit("`"), F.coalesce("cr_doi", F.lit("?")), F.lit("`"))
    title = F.substring(F.coalesce("final_title", F.lit("")), 1, 40)
    why = F.concat(name, F.lit(" - "), note)
    parts = [
        Part("Safe to rename", hit, _cells(name, found), ("File", "DOI")),
        Part(
            "Author mismatch", ~hit & doi & (author != ""),
            _cells(_code("pdf_name", 42), F.substring(author, 1, 18), F.substring("cr_author", 1, 18), found),
            ("File", "Author", "Registered author", "DOI"),
        ),
        Part("Not found", ~doi, why),
        Part("Without author", author == "", F.concat(name, F.lit(" -> "), F.coalesce("cr_doi", F.lit("(not found)")))),
        Part("Matched by clues", clue & hit, _cells(_code("pdf_name", 35), title, found, F.col("clue_score")), ("File", "Title", "DOI", "Score")),
        Part("Clue matches to review", clue & doi & ~hit, F.concat(_code("pdf_name", 40), F.lit(" -> "), found, F.lit(" (score: "), F.col("clue_score").cast("string"), F.lit(")"))),
        Part("Matched by text title", text & hit, _cells(_code("pdf_name", 35), title, found), ("File", "Title", "DOI")),
        Part("Text title without match", text & ~doi, why),
    ]
    lines = report_lines(results, parts, ["pdf_name"])
    shared = Part("Shared DOIs", F.lit(True), F.concat(found, F.lit(" claimed by "), _code("pdf_name", 200)))
    labels = {
        "total_scanned": "Files scanned", "class_a": "A. title and author", "class_b": "B. title only",
        "class_c": "C. no title", "matched": "Matched", "not_found": "Not found",
    }
    return (
        overview_lines(summary, "DOI match report", labels)
        .unionByName(lines)
        .unionByName(report_lines(conflicts, [shared], ["cr_doi", "pdf_name"], first=len(parts) + 1))
    )


def verify_report(rows: DataFrame) -> DataFrame:
    """Report of a content verification."""
    status = F.col("status")
    counts = rows.agg(
        F.count("*").alias("total"), F.count_if(status == "verified").alias("verified"),
        F.count_if(status == "mismatch").alias("mismatch"), F.count_if(status == "cannot_verify").alias("unknown"),
    )
    labels = {"total": "Folders", "verified": "Verified", "mismatch": "Mismatch", "unknown": "Cannot verify"}
    sim = F.format_string("%.2f", "title_sim")
    parts = [
        Part("Verified", status == "verified", F.concat(_code("folder", 45), F.lit(" - similarity "), sim)),
        Part(
            "Mismatch", status == "mismatch",
            _cells(_code("folder", 35), _code("expected_doi", 200), F.substring("title", 1, 40), F.substring("canonical_title", 1, 40), sim),
            ("Folder", "Expected DOI", "Title", "Registered title", "Similarity"),
        ),
        Part("Cannot verify", status == "cannot_verify", _code("folder", 45)),
    ]
    return overview_lines(counts, "Verification report", labels).unionByName(report_lines(rows, parts, ["folder"]))


def doi_report(doi_map: DataFrame, key: str = "pdf_name") -> DataFrame:
    """Report of a match run: matched, not found, without title, rejected."""
    status = F.col("status")
    kinds = ["matched", "not_found", "no_title", "no_confidence"]
    counts = doi_map.agg(F.count("*").alias("total"), *[F.count_if(status == k).alias(k) for k in kinds])
    labels = {"total": "Files", "matched": "Matched", "not_found": "Not found", "no_title": "No title", "no_confidence": "Probably unregistered"}
    name, title = _code(key, 45), F.substring("title", 1, 40)
    parts = [
        Part(
            "Matched", status == "matched",
            _cells(name, title, F.col("doi"), F.substring("author", 1, 20), F.col("year"), F.when(F.col("verified"), "yes").otherwise("check")),
            ("File", "Title", "DOI", "Author", "Year", "Verified"),
        ),
        Part("Not found", status == "not_found", F.concat(name, F.lit(" - title: "), F.substring("title", 1, 50))),
        Part("No title", status == "no_title", name),
        Part("Probably unregistered", status == "no_confidence", _cells(name, title, F.col("nearest_doi"), F.col("title_sim")), ("File", "Title", "Nearest", "Similarity")),
    ]
    return overview_lines(counts, "DOI report", labels).unionByName(report_lines(doi_map, parts, [key]))


def search_link(base: str, title: Column) -> Column:
    """Search link with the title percent-encoded, slashes kept."""
    encoded = F.url_encode(title)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(a), F.lit(b))
    return F.concat(F.lit(base), encoded)


def review_checklist(results: DataFrame, search: str, score: str = "clue_score") -> DataFrame:
    """Numbered table of the matches that need a person to confirm them."""
    rows = results.filter((F.col(score) >= REVIEW_SCORE) & (F.col(score) < AUTO_SCORE))
    title = F.substring(F.coalesce("final_title", F.lit("")), 1, 50)
    link = F.concat(F.lit("[search]("), search_link(search, title), F.lit(")"))
    part = Part(
        "To confirm", F.lit(True),
        _cells(_code("pdf_name", 40), title, F.concat(F.lit("`"), F.coalesce("cr_doi", F.lit("(not found)")), F.lit("`")), link),
        ("File", "Title", "DOI", "Link"),
    )
    return report_lines(rows, [part], ["pdf_name"])


# --- templated report over extraction results ----------------------------------

_COMMAND = re.compile(r"\{\{(.+?)\}\}")


def _command(text: str, top_k: int) -> Section | None:
    words = [w.strip("\"'") for w in text.split()]
    if words and words[0] in ("value_counts", "count_true", "mean") and len(words) >= 3:
        return Section(words[1], words[2], words[0], top_k)
    if words and words[0] == "count" and len(words) >= 2:
        return Section(words[1], "", "count", top_k)
    return None


def render_report(
    spark: SparkSession, extractions: DataFrame, body: str, title: str,
    templates: list[tuple[str, str]], top_k: int = 10,
) -> DataFrame:
    """Template sections with their ``{{command "prompt" "field"}}`` resolved.

    All commands of all templates are answered by one scan; unknown ones stay.
    """
    commands: list[Section] = []
    pieces: list[tuple[int, int, str, int | None]] = []
    for number, (heading, content) in enumerate(templates, 1):
        at = 0
        text = f"## {heading}\n{content}\n"
        for n, m in enumerate(_COMMAND.finditer(text)):
            pieces.append((number, 2 * n, text[at : m.start()], None))
            section = _command(m.group(1), top_k)
            if section is None:
                pieces.append((number, 2 * n + 1, m.group(0), None))
            else:
                if section not in commands:
                    commands.append(section)
                pieces.append((number, 2 * n + 1, "", commands.index(section)))
            at = m.end()
        pieces.append((number, 1_000_000, text[at:], None))
    layout = spark.createDataFrame(
        [(0, 0, f"# {title}\n", None), *pieces], "section int, piece int, text string, command int"
    )
    if not commands:
        answers = spark.createDataFrame([], "command int, answer string")
    else:
        answers = _answers(stats_sections(extractions, body, commands))
    empty = F.coalesce(*[F.when(F.col("command") == i, F.lit(_no_data(c))) for i, c in enumerate(commands)], F.lit(""))
    filled = layout.join(answers, "command", "left")
    filled = filled.withColumn("text", F.when(F.col("command").isNull(), F.col("text")).otherwise(F.coalesce("answer", empty)))
    in_order = F.array_sort(F.collect_list(F.struct("piece", "text")))
    whole = filled.groupBy("section").agg(F.array_join(F.transform(in_order, lambda p: p.text), "").alias("text"))
    return whole.select("section", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _no_data(s: Section) -> str:
    return {
        "value_counts": "  (no data)", "mean": "  (no numeric data)",
        "count_true": "  **0** / 0 (0.0%)", "count": "  Total entries: **0**",
    }[s.type]


def _answers(rows: DataFrame) -> DataFrame:
    """Rendered text per command; at most top-k rows meet per command."""
    pct = F.format_string("%.1f", F.col("n") * 100.0 / F.col("total"))
    kind = F.col("type")
    line = (
        F.when(kind == "value_counts", F.concat(F.lit("  - **"), "value", F.lit("**: "), F.col("n").cast("string"), F.lit(" ("), pct, F.lit("%)")))
        .when(kind == "mean", F.format_string("  Mean: %.2f (n=%d, min=%.2f, max=%.2f)", "mean", "n", "min", "max"))
        .when(kind == "count_true", F.concat(F.lit("  **"), F.col("n").cast("string"), F.lit("** / "), F.col("total").cast("string"), F.lit(" ("), pct, F.lit("%)")))
        .otherwise(F.concat(F.lit("  Total entries: **"), F.col("n").cast("string"), F.lit("**")))
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(0)).alias("r"), line.alias("line"))))
    return rows.groupBy(F.col("section").alias("command")).agg(
        F.array_join(F.transform(ordered, lambda x: x.line), "\n").alias("answer")
    )
