"""Statistics over extraction results and counters over match results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.chunked import first_n, heavy_join
from scholia.operators.semi import clean_values, field, is_true, is_valid_object, numbers, parse
from scholia.session import cut_lineage
from scholia.vocab import METADATA_KEYS, METADATA_MISSING_MARKERS


def collect_by_prompt(files: DataFrame, prompts: list[str], alias: str, name: str = "file_name", body: str = "body") -> DataFrame:
    """Result files of one model with their prompt and paper; objects only.

    The longest prompt name that ends the file stem counts, so that a short
    name does not take the files of a longer one.
    """
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    ordered = sorted(prompts, key=lambda p: (-len(p), p))
    found = F.coalesce(*[F.when(stem.endswith(f"_{p}_{alias}"), F.lit(p)) for p in ordered])
    rows = files.withColumn("prompt_name", found).filter(F.col("prompt_name").isNotNull())
    rows = rows.filter(F.coalesce(F.schema_of_variant(parse(F.col(body))).startswith("OBJECT"), F.lit(False)))
    suffix = F.length("prompt_name") + len(alias) + 2
    return rows.withColumn("model_alias", F.lit(alias)).withColumn(
        "paper_id", F.substring(stem, F.lit(1), F.length(stem) - suffix)
    )


def entry_count(df: DataFrame, prompt: str = "prompt_name") -> DataFrame:
    return df.groupBy(prompt).agg(F.count("*").alias("entries"))


def values_of(df: DataFrame, body: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """One row per clean value of a field."""
    return df.select(*(keys or []), F.explode(clean_values(field(parse(F.col(body)), name))).alias("value"))


def value_counts(df: DataFrame, body: str, name: str, k: int = 10) -> DataFrame:
    """Most common values; a tie goes to the smaller value."""
    counts = values_of(df, body, name).groupBy("value").agg(F.count("*").alias("uses"))
    return counts.orderBy(F.desc("uses"), "value").limit(k)


def value_counts_pct(df: DataFrame, body: str, name: str, k: int = 10) -> DataFrame:
    """Most common values with their share of all values."""
    counts = values_of(df, body, name).groupBy("value").agg(F.count("*").alias("uses"))
    total = counts.agg(F.sum("uses")).scalar()
    top = counts.orderBy(F.desc("uses"), "value").limit(k)
    return top.withColumn("pct", F.round(F.col("uses") * 100.0 / total, 1).cast("double"))


def numeric_summary(df: DataFrame, body: str, name: str) -> DataFrame:
    rows = df.select(F.explode(numbers(field(parse(F.col(body)), name))).alias("x"))
    return rows.agg(
        F.avg("x").alias("mean"), F.max("x").alias("max"), F.min("x").alias("min"), F.count("x").alias("count")
    )


def count_true(df: DataFrame, body: str, fields: str) -> DataFrame:
    """Entries where any of the comma-separated fields is true, of all entries."""
    flags = df.select(is_true(parse(F.col(body)), fields).alias("hit"))
    out = flags.agg(F.count_if("hit").alias("hits"), F.count("*").alias("total"))
    pct = F.when(F.col("total") > 0, F.round(F.col("hits") * 100.0 / F.col("total"), 1)).otherwise(0)
    return out.withColumn("pct", pct.cast("double"))


def crosstab(df: DataFrame, body: str, row: str, column: str, values: list[str] | None = None) -> DataFrame:
    """Entries per pair of field values; ``values`` are the columns wanted.

    Name them where they are known: otherwise a job has to find them first.
    """
    parsed = parse(F.col(body))
    pairs = df.select(F.explode(clean_values(field(parsed, row))).alias("row_value"), parsed.alias("_b"))
    pairs = pairs.select("row_value", F.explode(clean_values(field(F.col("_b"), column))).alias("_c"))
    return pairs.groupBy("row_value").pivot("_c", values).agg(F.count(F.lit(1))).na.fill(0)


@dataclass(frozen=True)
class Section:
    """One statistic wanted: ``value_counts``, ``mean``, ``count_true`` or ``count``."""

    prompt: str
    field: str
    type: str = "value_counts"
    top_k: int = 10


def stats_cells(df: DataFrame, body: str, sections: list[Section], prompt: str = "prompt_name") -> DataFrame:
    """``(section, value, n, sum, min, max)``: everything the sections need, from one scan.

    Only values that are counted one by one make a row each; a mean or a count
    is one row per section, put together in the map tasks.
    """
    parsed = F.col("_b")
    cell = lambda value, x: F.struct(value.cast("string").alias("value"), x.cast("double").alias("x"))
    nothing = F.lit(None)

    def wanted(s: Section) -> Column:
        if s.type == "value_counts":
            return F.transform(clean_values(field(parsed, s.field)), lambda v: cell(v, nothing))
        if s.type == "mean":
            return F.transform(numbers(field(parsed, s.field)), lambda x: cell(nothing, x))
        if s.type == "count_true":
            return F.array(cell(is_true(parsed, s.field), nothing))
        return F.array(cell(F.lit("entry"), nothing))

    parts = F.array(
        *[
            F.struct(F.lit(i).alias("section"), F.when(F.col(prompt) == s.prompt, wanted(s)).alias("values"))
            for i, s in enumerate(sections)
        ]
    )
    used = df.filter(F.col(prompt).isin([s.prompt for s in sections]))
    rows = used.select(prompt, parse(F.col(body)).alias("_b")).select(F.explode(parts).alias("_p"))
    rows = rows.select("_p.section", F.explode("_p.values").alias("_c")).select("section", "_c.value", "_c.x")
    return rows.groupBy("section", "value").agg(
        F.count("*").alias("n"), F.sum("x").alias("sum"), F.min("x").alias("min"), F.max("x").alias("max")
    )


def stats_sections(df: DataFrame, body: str, sections: list[Section], prompt: str = "prompt_name") -> DataFrame:
    """Rows of all sections: top values, or one summary row per section."""
    # the cells are kept, so that the parts below do not scan the bodies again
    cells = cut_lineage(stats_cells(df, body, sections, prompt))
    of = lambda *kinds: F.col("section").isin([i for i, s in enumerate(sections) if s.type in kinds])
    limits = F.array(*[F.lit(s.top_k) for s in sections])
    top_k = max([s.top_k for s in sections if s.type == "value_counts"], default=1)
    top = first_n(cells.filter(of("value_counts")), ["section"], [F.desc("n"), "value"], top_k)
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "value"))
    top = top.withColumn("rank", place).filter(F.col("rank") <= F.get(limits, F.col("section")))
    totals = cells.filter(of("value_counts")).groupBy("section").agg(F.sum("n").alias("total"))
    top = top.join(totals, "section")
    means = cells.filter(of("mean")).select("section", "n", (F.col("sum") / F.col("n")).alias("mean"), "min", "max")
    hits = F.when(F.col("value") != "false", F.col("n")).otherwise(0)
    flags = cells.filter(of("count_true", "count")).groupBy("section").agg(
        F.sum(hits).alias("n"), F.sum("n").alias("total")
    )
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [top, means, flags])
    names = lambda attr: F.get(F.array(*[F.lit(getattr(s, attr)) for s in sections]), F.col("section"))
    return rows.select(
        "section", names("prompt").alias("prompt"), names("field").alias("field"), names("type").alias("type"),
        "rank", "value", "n", "total", "mean", "min", "max",
    )


def enrich(rows: DataFrame, metadata: DataFrame, prompts: list[str], keys: list[str] | None = None) -> DataFrame:
    """Adds metadata of the same paper; a later prompt overrides an earlier one.

    ``rows`` and ``metadata(paper_id, prompt_name, body)`` meet on ``paper_id``.
    A key is taken from the top level, else from ``citation``; an added column
    replaces one of the same name where a value was found.
    """
    keys = keys or METADATA_KEYS
    body = F.col("_b")
    order = F.array_position(F.array(*[F.lit(p) for p in prompts]), F.col("prompt_name"))
    used = metadata.filter(F.col("prompt_name").isin(prompts)).withColumn("_b", parse(F.col("body")))
    # a key present at the top level hides the nested one, even when it is empty
    has = lambda k: F.map_contains_key(F.try_variant_get(body, "$", "map<string,variant>"), k)
    text = lambda p: F.try_variant_get(body, p, "string")
    pick = lambda k: F.when(has(k), text(f"$.{k}")).otherwise(text(f"$.citation.{k}"))
    usable = lambda c: F.when(~c.isin(METADATA_MISSING_MARKERS), c)
    tie = [c for c in ("ts", "event_id") if c in metadata.columns]
    values = used.select("paper_id", order.alias("_o"), *tie, *[usable(pick(k)).alias(k) for k in keys])
    latest = lambda k: F.max_by(k, F.when(F.col(k).isNotNull(), F.struct("_o", *tie)))
    meta = values.groupBy("paper_id").agg(*[latest(k).alias(f"_m_{k}") for k in keys])
    joined = heavy_join(rows, meta, ["paper_id"], "left")
    merged = [
        (F.coalesce(f"_m_{k}", F.col(k).cast("string")) if k in rows.columns else F.col(f"_m_{k}")).alias(k)
        for k in keys
    ]
    return joined.select(*[c for c in rows.columns if c not in keys], *merged)


def match_summary(entries: DataFrame, results: DataFrame, cache_hits: str | None = None) -> DataFrame:
    """The counters of a matching run in one row."""
    doi, hit, note = F.col("cr_doi").isNotNull(), F.col("match"), F.coalesce(F.col("note"), F.lit(""))
    clue, text = note.startswith("clue:"), note.startswith("text:")
    classes = entries.agg(
        F.count("*").alias("total_scanned"),
        *[F.count_if(F.col("entry_class") == c).alias(f"class_{c.lower()}") for c in "ABC"],
    )
    counters = results.agg(
        F.count_if(hit).alias("matched"),
        F.count_if(~hit & doi).alias("mismatched"),
        F.count_if(~doi).alias("not_found"),
        F.count("*").alias("results_checked"),
        F.count_if(clue).alias("clue_attempted"),
        F.count_if(clue & hit).alias("clue_matched"),
        F.count_if(clue & doi & ~hit).alias("clue_needs_review"),
        F.count_if(clue & ~doi).alias("clue_failed"),
        F.count_if(text).alias("text_attempted"),
        F.count_if(text & hit).alias("text_matched"),
        F.count_if(text & ~doi).alias("text_failed"),
        (F.count_if(F.col(cache_hits)) if cache_hits else F.lit(0).cast("long")).alias("cache_hits"),
    )
    one = F.lit(1).alias("_k")
    return classes.select(one, "*").join(counters.select(one, "*"), "_k").drop("_k")


def status_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"))


def run_counters(tasks: DataFrame, state: DataFrame) -> DataFrame:
    """Progress of a run per model: tasks planned against their latest state.

    A task that was done before the run counts as skipped; ``state`` tells by
    ``before`` which rows are older than the run.
    """
    rows = tasks.select("model_alias", "task_id").join(
        state.select("model_alias", "task_id", "status", "retries", "before"), ["model_alias", "task_id"], "left"
    )
    done, before = F.col("status") == "success", F.coalesce("before", F.lit(False))
    out = rows.groupBy("model_alias").agg(
        F.count("*").alias("total"),
        F.count_if(done & before).alias("skipped"),
        F.count_if(done & ~before).alias("completed"),
        F.count_if((F.col("status") == "failed") & ~before).alias("failed"),
        F.coalesce(F.sum(F.when(~before, F.col("retries"))), F.lit(0)).cast("long").alias("retries"),
    )
    rest = F.col("total") - F.col("skipped") - F.col("completed") - F.col("failed")
    return out.withColumn("remaining", rest)


def doi_conflicts(results: DataFrame, key: str = "pdf_name", doi: str = "cr_doi") -> DataFrame:
    """One row per file whose DOI is claimed by several files.

    Groups stay rows, so a DOI claimed by very many files is no single value.
    """
    claimed = cut_lineage(results.filter(F.col(doi).isNotNull()).select(key, doi))
    many = claimed.groupBy(doi).agg(F.count("*").alias("files")).filter(F.col("files") > 1)
    return heavy_join(claimed, many, [doi])
