"""Prompt rendering, HTML to text, layout tags and image links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import fill, first_of, strip
from scholia.vocab import LAYOUT_GRID, PAGE_SYMBOLS


def render_prompt(template: Column, content: Column, values: dict[str, Column], limit: int | None = None) -> Column:
    """Content is cut first, then put in, then the other values; the rest stays."""
    text = content if limit is None else F.substring(content, 1, limit)
    return fill(template, {"content": text, **values})


# Ordered rewrite rules from HTML to Markdown-like text.
HTML_RULES = [
    (r"(?is)<(style|script)\b[^>]*>.*?</(style|script)>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<title\b[^>]*>.*?</title>", ""),
    (r"(?is)<a\b[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>", r"[$2]($1)"),
    (r"(?is)<img\b[^>]*?src=\"([^\"]*)\"[^>]*>", r"![]($1)"),
    *[(rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ") for n in range(1, 7)],
    (r"(?i)<li\b[^>]*>", "\n  * "),
    (r"(?i)</?(b|strong)>", "**"),
    (r"(?i)</?(i|em)>", "_"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</?(p|div|ul|ol|table|tr|article|section|nav|header|footer|h[1-6])\b[^>]*>", "\n\n"),
    (r"<[^>]+>", ""),
    (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#39;", "'"), (r"&amp;", "&"),
    (r"\n{3,}", "\n\n"),
]


def html_to_text(html: Column) -> Column:
    text = reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), HTML_RULES, html)
    return strip(text)


def drop_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", "")


def layout_refs(df: DataFrame, content: str, width: str, height: str) -> DataFrame:
    """One row per box: label, position and pixel coordinates."""
    pattern = r"(?s)<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>"
    text = F.col(content)
    refs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("label"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("boxes"),
    )
    rows = df.select("*", F.posexplode(refs).alias("ref_pos", "_ref"))
    rows = rows.select("*", F.posexplode(F.from_json("_ref.boxes", "array<array<int>>")).alias("box_pos", "_box"))
    at = lambda i, size: F.floor(F.get("_box", F.lit(i)) / LAYOUT_GRID * F.col(size)).cast("int")
    return rows.select(
        *[c for c in df.columns if c != content], "ref_pos", "box_pos",
        F.col("_ref.label").alias("label"),
        at(0, width).alias("x1"), at(1, height).alias("y1"),
        at(2, width).alias("x2"), at(3, height).alias("y2"),
    )


def clean_layout(content: Column) -> Column:
    """Removes layout tags and left-overs and collapses blank lines."""
    text = F.regexp_replace(content, r"\|?ref\|>.*?\|/ref\|>", "")
    text = F.regexp_replace(text, r"\|?det\|>.*?\|/det\|>", "")
    for symbol, plain in PAGE_SYMBOLS.items():
        text = F.replace(text, F.lit(symbol), F.lit(plain))
    text = strip(F.replace(text, F.lit("<<")))
    return F.regexp_replace(text, r"\n\n+", "\n")


IMAGE_LINK = r"!\[([^\]]*)\]\(([^)]*)\)"


def rewrite_image_paths(df: DataFrame, keys: list[str], text: str, moved: DataFrame, scope: list[str]) -> DataFrame:
    """Replaces the target of image links by the new path of the image.

    ``moved`` has the ``scope`` columns, ``old_path`` and ``new_path``.  A link
    matches when its target ends with the old path at a slash; the longest such
    path counts.  ``keys`` identify a row of ``df`` and include ``scope``.
    """
    links = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(IMAGE_LINK), F.lit(1)).alias("alt"),
        F.regexp_extract_all(text, F.lit(IMAGE_LINK), F.lit(2)).alias("path"),
    )
    found = df.select(*keys, F.posexplode(links).alias("pos", "link"))
    steps = F.split("link.path", "/")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda i: F.array_join(F.slice(steps, i, F.size(steps)), "/"),
    )
    tried = found.select(*keys, "pos", F.posexplode(tails).alias("cut", "old_path"))
    new = (
        tried.join(moved, [*scope, "old_path"])
        .groupBy(*keys, "pos")
        .agg(F.min_by("new_path", "cut").alias("new_path"))
    )
    # the links of one text value, back in that text
    replaced = new.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "new_path"))).alias("_new")
    )
    pieces, whole = F.split(text, IMAGE_LINK, -1), F.regexp_extract_all(text, F.lit(IMAGE_LINK), F.lit(0))
    alts = F.regexp_extract_all(text, F.lit(IMAGE_LINK), F.lit(1))
    link = lambda i: F.coalesce(
        F.concat(F.lit("!["), F.get(alts, i), F.lit("]("), F.try_element_at("_new", i), F.lit(")")),
        F.get(whole, i),
        F.lit(""),
    )
    rebuilt = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, link(i))), "")
    return (
        df.join(replaced, keys, "left")
        .withColumn(text, F.when(F.col("_new").isNull(), F.col(text)).otherwise(rebuilt))
        .drop("_new")
    )


def image_stem(path: Column) -> Column:
    """File name without directory and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
