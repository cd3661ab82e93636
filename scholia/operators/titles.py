"""Titles read from the text of a document, inside the row and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.text import contains_any, first_of, last_of, let, lines, starts_with_any, strip
from scholia.vocab import (
    FRONT_MATTER, MIN_TITLE_CHARS, PLAIN_TITLE_PREFIXES, SCORED_TITLE_PREFIXES, TITLE_HINTS,
)

_MARKUP = [">", "```", "!["]


def plain_title(text: Column) -> Column:
    """First line that can be a title; headings and quotes are skipped."""
    stripped = F.transform(lines(text), strip)
    usable = F.filter(
        stripped,
        lambda line: ~starts_with_any(line, ["#", *_MARKUP])
        & (F.length(line) >= MIN_TITLE_CHARS)
        & ~starts_with_any(F.lower(line), PLAIN_TITLE_PREFIXES),
    )
    return first_of(usable)


def scored_title(text: Column) -> Column:
    """First heading, else the last line with a title word, else the first line."""
    kept = F.filter(
        F.transform(lines(text), strip), lambda line: (line != "") & ~starts_with_any(line, _MARKUP)
    )
    parts = F.transform(
        kept,
        lambda line: F.struct(
            line.startswith("#").alias("heading"),
            strip(F.regexp_replace(line, r"^#+\s*", "")).alias("line"),
        ),
    )
    parts = F.filter(
        parts,
        lambda p: ~F.lower(p.line).rlike(FRONT_MATTER)
        & (F.length(p.line) >= MIN_TITLE_CHARS)
        & ~starts_with_any(F.lower(p.line), SCORED_TITLE_PREFIXES),
    )
    parts = F.transform(
        parts,
        lambda p: F.struct(
            p.heading.alias("heading"),
            strip(F.regexp_replace(p.line, r"^\d+(\.\d+)*\s+", "")).alias("line"),
            contains_any(F.lower(p.line), TITLE_HINTS).alias("hint"),
        ),
    )
    parts = F.filter(parts, lambda p: F.length(p.line) >= MIN_TITLE_CHARS)
    return let(
        parts,
        lambda ps: F.coalesce(
            first_of(F.filter(ps, lambda p: p.heading)),
            last_of(F.filter(ps, lambda p: p.hint)),
            first_of(ps),
        )["line"],
    )
