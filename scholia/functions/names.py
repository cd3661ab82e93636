"""Author names: normal form and the tolerant match predicate."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scholia.functions.text import let
from scholia.vocab import AUTHOR_CHAR_SIMILARITY, AUTHOR_MIN_DISTINCT_CHARS


@F.pandas_udf(StringType())
def to_nfc(names: pd.Series) -> pd.Series:
    """Unicode composition, which Spark has no built-in for."""
    return names.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


@lru_cache(maxsize=1)
def _compositions() -> str:
    """JSON of every letter with a mark that has a letter of its own, by rule from the character database."""
    made = {}
    for code in range(0x80, 0x10000):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        pair = unicodedata.normalize("NFC", parts[:-1]) + parts[-1:]
        if len(pair) == 2 and unicodedata.combining(pair[1]) and unicodedata.normalize("NFC", pair) == letter:
            made[pair] = letter
    return json.dumps(made)


def compose(name: Column) -> Column:
    """Letters followed by their marks as one letter each, in the JVM; names without marks stay untouched.

    Marks are taken in their order, as file systems and catalogues write them.
    Korean letters in parts are composed by ``to_nfc`` only.
    """
    pairs = F.from_json(F.lit(_compositions()), "map<string,string>")

    def step(acc: Column, c: Column) -> Column:
        met = F.element_at(pairs, F.concat(acc.last, c))
        return let(met, lambda m: F.when(m.isNotNull(), F.struct(acc.done.alias("done"), m.alias("last"))).otherwise(
            F.struct(F.concat(acc.done, acc.last).alias("done"), c.alias("last"))))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"))
    whole = F.aggregate(F.split(name, ""), start, step, lambda acc: F.concat(acc.done, acc.last))
    return F.when(name.rlike(r"\p{M}"), whole).otherwise(name)


def fold_author(name: Column) -> Column:
    """Lower-case name without blanks, dashes, underscores and dots."""
    dashed = F.regexp_replace(name, "[‐‑‒–—―−]", "-")
    return F.regexp_replace(F.lower(dashed), r"[\s\p{Z}\-_.]+", "")


def normalize_author(name: Column) -> Column:
    """Composed and folded name; use at ingest, matching itself stays in the JVM."""
    return fold_author(to_nfc(name))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def authors_match(left: Column, right: Column) -> Column:
    """Containment either way, else enough of the left characters on the right, of composed names.

    The character count runs over the left name with repeats, so the predicate
    is not symmetric.
    """
    present = (F.coalesce(left, F.lit("")) != "") & (F.coalesce(right, F.lit("")) != "")
    composed = F.struct(compose(left).alias("a"), compose(right).alias("b"))
    folded = lambda n: F.struct(fold_author(n.a).alias("a"), fold_author(n.b).alias("b"))
    return F.coalesce(present & let(composed, lambda n: let(folded(n), _alike)), F.lit(False))


def _alike(n: Column) -> Column:
    surnames = F.struct(
        _characters(F.replace(n.a, F.lit(","))).alias("a"),
        _characters(F.replace(n.b, F.lit(","))).alias("b"),
    )
    return F.contains(n.b, n.a) | F.contains(n.a, n.b) | let(surnames, _similar)


def _similar(c: Column) -> Column:
    kinds_a, kinds_b = F.size(F.array_distinct(c.a)), F.size(F.array_distinct(c.b))
    common = F.size(F.filter(c.a, lambda x: F.array_contains(c.b, x)))
    return (
        (kinds_a >= AUTHOR_MIN_DISTINCT_CHARS)
        & (kinds_b >= AUTHOR_MIN_DISTINCT_CHARS)
        & (common / F.greatest(kinds_a, kinds_b) >= AUTHOR_CHAR_SIMILARITY)
    )
