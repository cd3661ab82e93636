"""Fragments of check SQL shared by several queries."""

from scholia.vocab import FILENAME_COMMON_WORDS, TITLE_STOPWORDS


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STOP = _list(TITLE_STOPWORDS)
COMMON = _list(FILENAME_COMMON_WORDS)


def words(col: str) -> str:
    return (
        rf"list_distinct(list_filter(regexp_split_to_array(lower({col}), '[\s\p{{Z}}]+'), lambda w: w <> ''))"
    )


def tokens(col: str) -> str:
    clean = rf"regexp_replace(regexp_replace(lower(coalesce({col}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\p{{Nd}}+', ' ', 'g')"
    return (
        rf"list_filter(list_distinct(regexp_split_to_array({clean}, '\s+')), "
        rf"lambda w: w <> '' AND NOT list_contains({STOP}, w))"
    )


def similarity(a: str, b: str) -> str:
    """Jaccard of two token list expressions."""
    return (
        f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE "
        f"len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)"
    )


def fold(col: str) -> str:
    dashed = f"regexp_replace({col}, '[‐‑‒–—―−]', '-', 'g')"
    return rf"regexp_replace(lower({dashed}), '[\s\p{{Z}}\-_.]+', '', 'g')"


def authors_match(a: str, b: str) -> str:
    fa, fb = fold(a), fold(b)
    ca, cb = f"replace({fa}, ',', '')", f"replace({fb}, ',', '')"
    chars = lambda c: f"string_split({c}, '')"
    kinds = lambda c: f"len(list_distinct({chars(c)}))"
    common = f"len(list_filter({chars(ca)}, lambda c: contains({cb}, c)))"
    return (
        f"coalesce({a} <> '' AND {b} <> '' AND (contains({fb}, {fa}) OR contains({fa}, {fb}) OR "
        f"({kinds(ca)} >= 4 AND {kinds(cb)} >= 4 AND "
        f"{common}::DOUBLE / greatest({kinds(ca)}, {kinds(cb)}) >= 0.7)), false)"
    )


def strip(col: str) -> str:
    return rf"regexp_replace({col}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def clues(source: str, key: str) -> str:
    """CTE bodies ``segs`` and ``clue(key, author, year, keywords, segments)``."""
    return rf"""
segs AS (
  SELECT {key}, pdf_name, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(
           regexp_replace(pdf_name, '(?i)\.pdf$', ''), '[_\s]+', '_', 'g'),
           '([A-Za-z])-([0-9])', '\1_\2', 'g'), '([0-9])-([A-Za-z])', '\1_\2', 'g'), '_'), lambda s: s <> '') AS seg
  FROM {source}),
seg_rows AS (
  SELECT {key}, len(seg) AS n, unnest(seg) AS s, generate_subscripts(seg, 1) AS i FROM segs),
seg_flags AS (
  SELECT *, NOT regexp_full_match(s, '[0-9]+') AND NOT list_contains({COMMON}, lower(s)) AS p,
         min(CASE WHEN regexp_full_match(s, '(19|20)[0-9][0-9]') THEN i END) OVER (PARTITION BY {key}) AS yi
  FROM seg_rows),
seg_author AS (
  SELECT {key}, any_value(yi) AS yi, coalesce(
      min(CASE WHEN p AND length(s) >= 2 AND (yi IS NULL OR i < yi) THEN i END),
      min(CASE WHEN p AND length(s) >= 2 AND i > yi AND i < n THEN i END)) AS ai
  FROM seg_flags GROUP BY {key}),
seg_named AS (
  SELECT f.*, a.ai, max(CASE WHEN f.i = a.ai THEN f.s END) OVER (PARTITION BY f.{key}) AS author
  FROM seg_flags f JOIN seg_author a USING ({key})),
clue AS (
  SELECT s.{key}, any_value(s.pdf_name) AS pdf_name, len(any_value(s.seg))::INTEGER AS segments,
         coalesce(max(g.author), '') AS author,
         max(CASE WHEN g.i = g.yi THEN g.s END)::INTEGER AS year,
         coalesce(list(g.s ORDER BY g.i) FILTER (WHERE g.p AND g.i <> coalesce(g.yi, -1) AND g.i <> coalesce(g.ai, -1)
            AND lower(g.s) <> lower(coalesce(g.author, ''))
            AND NOT (contains(coalesce(g.author, ''), '-') AND list_contains(string_split(lower(g.author), '-'), lower(g.s)))), []) AS keywords
  FROM segs s LEFT JOIN seg_named g USING ({key}) GROUP BY s.{key})"""
