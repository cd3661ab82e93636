"""Column expressions for text: trimming, lines, tokens, set similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.vocab import TITLE_STOPWORDS

SPACE = r"[\s\p{Z}]"
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once.

    A lambda variable is evaluated once per row, and the expression stays small
    when the optimizer copies it into a pushed-down filter.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, rf"^{SPACE}+|{SPACE}+$", "")


def lines(col: Column) -> Column:
    """Lines of a text as an array, in order, empty lines included."""
    return F.split(col, LINE_BREAK, -1)


def starts_with_any(col: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, (col.startswith(p) for p in prefixes))


def contains_any(col: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, (col.contains(p) for p in parts))


def first_of(array: Column) -> Column:
    """First element of an array or NULL when it is empty."""
    return F.get(array, F.lit(0))


def last_of(array: Column) -> Column:
    """Last element of an array or NULL when it is empty."""
    return F.get(array, F.size(array) - 1)


def words(col: Column) -> Column:
    """Distinct lower-case white-space tokens."""
    parts = F.split(F.lower(col), rf"{SPACE}+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def title_tokens(col: Column) -> Column:
    """Distinct title words without punctuation, digits and stop words."""
    letters = F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}_\s]", " ")
    letters = F.regexp_replace(letters, r"\p{Nd}+", " ")
    stop = F.array(*[F.lit(w) for w in TITLE_STOPWORDS])
    kept = F.filter(F.split(letters, r"\s+"), lambda w: w != "")
    return F.array_except(kept, stop)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays, 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0),
        let(shared, lambda n: n / (F.size(a) + F.size(b) - n)),
    ).otherwise(F.lit(0.0))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the title words of two strings."""
    left = title_tokens(F.coalesce(a, F.lit("")))
    right = title_tokens(F.coalesce(b, F.lit("")))
    return let(F.struct(left.alias("l"), right.alias("r")), lambda t: jaccard(t.l, t.r))


def doi_to_file(doi: Column) -> Column:
    return F.replace(doi, F.lit("/"), F.lit("_"))


def file_to_doi(name: Column) -> Column:
    """Inverse of :func:`doi_to_file`; only the first underscore is a slash."""
    return F.regexp_replace(name, r"^([^_]*)_", "$1/")


def strip_supplement(doi: Column) -> Column:
    """Drop a trailing supplement suffix such as ``.s001``."""
    return F.regexp_replace(doi, r"\.s\d{3,}$", "")


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` placeholders in the given order; others are kept."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out
