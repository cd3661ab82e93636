"""Files that include files: the closure in document order, each file once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import strip
from scholia.session import cut_lineage

#: Rounds of the walk that are read one by one before they are put together.
ROUNDS_KEPT = 16
INCLUDE = r"\\(?:input|include)\{(.+?)\}"


def include_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, node, key, depth)``: every reachable file at its first place.

    ``edges(src, pos, dst)`` with the place of the include in ``src``;
    ``roots(root)``.  ``key`` is the list of places from the root; comparing
    keys gives document order.  A depth-first walk that visits a file once
    reaches it over the smallest key among all cycle-free paths, so each round
    keeps the smallest key per file and only follows files whose key changed.
    A round writes these files only; what earlier rounds found is read, not
    rewritten, until so many rounds have gone that they are put together.
    """
    start = roots.select(
        "root", F.col("root").alias("node"), F.array().cast("array<int>").alias("key"), F.array("root").alias("_path"),
    )
    first = F.min(F.struct("key", "_path"))
    found = [cut_lineage(start)]
    while True:
        steps = found[-1].join(edges, F.col("node") == F.col("src")).filter(~F.array_contains("_path", F.col("dst")))
        steps = steps.select(
            "root", F.col("dst").alias("node"),
            F.concat("key", F.array(F.col("pos").cast("int"))).alias("key"), F.concat("_path", F.array("dst")).alias("_path"),
        )
        steps = steps.groupBy("root", "node").agg(first.alias("_p"))
        known = reduce(DataFrame.unionByName, found).groupBy("root", "node").agg(F.min("key").alias("_key"))
        better = steps.join(known, ["root", "node"], "left").filter("_key IS NULL OR _p.key < _key")
        changed = cut_lineage(better.select("root", "node", "_p.key", "_p._path"))
        if changed.isEmpty():
            break
        if len(found) >= ROUNDS_KEPT:
            found = [cut_lineage(reduce(DataFrame.unionByName, found).groupBy("root", "node").agg(first.alias("_p")).select("root", "node", "_p.*"))]
        found.append(changed)
    best = reduce(DataFrame.unionByName, found).groupBy("root", "node").agg(F.min("key").alias("key"))
    return best.select("root", "node", "key", F.size("key").alias("depth"))


def include_edges(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between files, and the includes that name no file.

    ``files(path, root_dir, text)``; a target gets ``.tex`` added and is looked
    up next to the including file, else in the root directory.
    """
    names = F.regexp_extract_all("text", F.lit(INCLUDE), F.lit(1))
    rows = files.select("path", "root_dir", F.posexplode(names).alias("n", "_name"))
    name = strip(F.col("_name"))
    name = F.when(name.endswith(".tex"), name).otherwise(F.concat(name, F.lit(".tex")))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    base = F.when(F.col("root_dir") == "", "").otherwise(F.concat("root_dir", F.lit("/")))
    full = lambda d: _normal(F.when(name.startswith("/"), name).otherwise(F.concat(d, name)))
    rows = rows.select(
        F.col("path").alias("src"), (2 * F.col("n") + 1).alias("pos"), full(folder).alias("_near"), full(base).alias("_far")
    )
    known = files.select(F.col("path").alias("_near"), F.lit(True).alias("_a"))
    other = files.select(F.col("path").alias("_far"), F.lit(True).alias("_b"))
    rows = rows.join(known, "_near", "left").join(other, "_far", "left")
    dst = F.when(F.col("_a"), F.col("_near")).when(F.col("_b"), F.col("_far"))
    rows = rows.select("src", "pos", dst.alias("dst"), F.col("_far").alias("wanted"))
    return rows.filter("dst IS NOT NULL").drop("wanted"), rows.filter("dst IS NULL").select("src", "pos", "wanted")


def _normal(path):
    """Drops ``.`` and resolves ``x/..`` at any depth; a ``..`` with nothing before it stays."""
    steps = F.filter(F.split(path, "/"), lambda s: s != ".")
    empty = F.array().cast("array<string>")
    last = lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(""))
    resolved = F.aggregate(
        steps, empty,
        lambda kept, s: F.when(
            (s == "..") & (last(kept) != "") & (last(kept) != ".."), F.slice(kept, F.lit(1), F.size(kept) - 1)
        ).otherwise(F.concat(kept, F.array(s))),
    )
    return F.array_join(resolved, "/")


def resolve_includes(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root, key, path, piece)``: the expanded texts as ordered pieces.

    Sorted by ``key`` the pieces of a root are its expanded text; includes of
    files that already appeared or are missing contribute nothing.
    """
    edges, _ = include_edges(files)
    closure = include_closure(edges, roots)
    pieces = files.select(
        F.col("path").alias("node"), F.posexplode(F.split("text", INCLUDE, -1)).alias("_n", "piece")
    )
    rows = closure.join(pieces, "node")
    return rows.select(
        "root", F.concat("key", F.array(2 * F.col("_n"))).alias("key"), F.col("node").alias("path"), "piece"
    )


def expanded_texts(pieces: DataFrame) -> DataFrame:
    """``(root, text)``: the pieces of :func:`resolve_includes` put together; a root's whole text is one value."""
    parts = F.array_sort(F.collect_list(F.struct("key", "piece")))
    return pieces.groupBy("root").agg(F.array_join(F.transform(parts, lambda p: p.piece), "").alias("text"))
