"""Licence scan of paragraphs by a sparse word n-gram classifier.

Paragraphs are lines. A logistic regression with an L1 penalty over one- and two-word
grams is trained on parts of the licence templates and on all paragraphs of the corpus
without any licence (the unknown class). Only grams of the templates are features, so a
paragraph is the set of those it holds; equal sets are one row with their count as weight, and
all together weigh as much as a fixed number of paragraphs. The level that a family's
probability must reach is counted over the same paragraphs, all of them. A
prediction counts when it also agrees with a template of its family: the share of the
paragraph's grams, or of the template's, found in the other. DataFrame functions only.

A paragraph is scored unless a bound from the weights excludes it. A family that reaches
the level leads the unknown class by at least the level's log odds. The words that are not telling are chosen, the
frequent ones first, so that all positive weights of the grams made of them alone do not
give any family that lead; so a paragraph needs a telling word to be a finding.

Defined results: null and empty texts have no paragraphs; a licence line that
occurs twice is found twice; rows are kept apart by their position only, repeated
rows give repeated findings; clashing columns are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.columns import set_aside

UNKNOWN = "unknown"
#: How works state their licence, by family.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Distributed under the MIT license.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL version 3.",
    ],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Available under the Creative Commons Attribution License.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under the Creative Commons Attribution-NonCommercial License.",
    ],
    "cc0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.",
    ],
}


#: Characters that end a word; everything else is part of one.
MARKS = "\t\r\f\v\xa0!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»·–—‘’“”„…©®"
#: The same and the blank, for the inside of a character class.
ENDS = "".join(f"\\x{{{ord(c):x}}}" for c in " " + MARKS)
#: Where a word of a lower-case line can begin; the first half is quick and decides mostly.
BEGIN = f"(?<![a-z0-9])(?<![^{ENDS}\\n])"
#: Steps of the level.
STEPS = 10_000


def one_of(words: list[str]) -> str:
    """Pattern of any of the words, branching letter by letter."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [(c if c.isalnum() else "\\" + c) + pattern(rest) for c, rest in sorted(node.items()) if c]
        return f"(?:{'|'.join(ways)})" + ("?" if "" in node else "") if ways else ""

    return pattern(tree) or "(?!)"


def holds_word(text: Column, words: list[str]) -> Column:
    """Whether a text of any number of lines has one of these lower-case words."""
    return F.lower(text).rlike(f"{BEGIN}{one_of(words)}(?![^{ENDS}\\n])")


def runs(text: Column, words: list[str]) -> Column:
    """The longest runs of these words that a line has, each as an array of words."""
    word = f"{one_of(words)}(?![^{ENDS}])"
    found = F.regexp_extract_all(F.lower(text), F.lit(f"{BEGIN}{word}(?:[{ENDS}]++{word})*+"), F.lit(0))
    return F.transform(found, lambda r: F.split(r, f"[{ENDS}]+"))


def pieces(text: Column) -> Column:
    """Lower-case words, with empty strings between neighbouring marks."""
    return F.split(F.translate(F.lower(text), MARKS, " " * len(MARKS)), " ")


def words(text: Column) -> Column:
    return F.filter(pieces(text), lambda w: w != "")


def grams(tokens: Column) -> Column:
    """Distinct words and pairs of neighbouring words."""
    pairs = F.transform(F.arrays_zip(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("a"), F.slice(tokens, 2, F.size(tokens)).alias("b")), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    return F.array_distinct(F.concat(tokens, pairs))


@dataclass(frozen=True)
class LicenceModel:
    """Weights of grams by family, levels and templates: small tables, whatever the corpus."""

    families: list[str]
    weights: list[tuple[str, list[float]]]
    intercepts: list[float]
    level: float
    #: a paragraph without any of them is unknown; None where every paragraph has to be scored
    telling: list[str] | None


def paragraphs(docs: DataFrame, text: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select("*", F.posexplode(F.split(F.col(text), "\n")).alias("paragraph", "_p")).where("_p <> ''")


def threes(tokens: Column) -> Column:
    """Every three words in a row; fewer are one."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(tokens, i, 3)))


def fit(docs: DataFrame, text: str = "text", rows: int = 4000, templates: dict[str, list[str]] | None = None) -> LicenceModel:
    """Train on the templates, their parts, and all paragraphs of the corpus, which together weigh as much as at most so many rows."""
    spark, templates = docs.sparkSession, templates or TEMPLATES
    families = [*sorted(templates), UNKNOWN]
    positive = spark.createDataFrame([(families.index(f), t) for f in sorted(templates) for t in templates[f]], "label int, t string")
    positive = positive.select("label", words(F.col("t")).alias("w"))
    # whole templates weigh more than their parts of six words or more
    parts = positive.select("label", F.explode(F.expr("transform(sequence(0, greatest(size(w) - 6, 0)), i -> slice(w, i + 1, 12))")).alias("w"))
    positive = positive.select("label", "w", F.lit(5.0).alias("weight")).union(parts.select("label", "w", F.lit(1.0)))
    positive = positive.where("size(w) > 0").withColumn("grams", grams(F.col("w")))
    counted = CountVectorizer(inputCol="grams", outputCol="x", binary=True, vocabSize=1 << 30).fit(positive)
    known = [r["t"] for r in positive.select(F.explode(threes(F.col("w"))).alias("t")).distinct().collect()]
    in_grams = sorted({x for g in counted.vocabulary for x in g.split(" ")})
    # paragraphs of the corpus that share three words in a row with a template are no examples of the unknown
    lines = paragraphs(docs.select(F.col(text).alias("_t")), "_t").where(~F.col("_p").rlike(f"^[{ENDS}]*+$"))
    least = min(len(t.split(" ")) for t in known)
    stated = lambda rs: F.exists(rs, lambda r: F.when(F.size(r) >= least, F.arrays_overlap(threes(r), F.lit(known))).otherwise(False))
    held = lambda rs: F.when(~stated(rs), F.array(F.array_distinct(F.flatten(F.transform(rs, grams)))))
    # a filter on what is made here would make it a second time
    lines = lines.select(F.explode(let(runs(F.col("_p"), in_grams), held)).alias("grams"))
    # cached: equal sets of features with the number of their paragraphs
    unknown = counted.transform(lines).groupBy("x").count().cache()
    total = unknown.agg(F.sum("count")).first()[0] or 0
    weight = F.col("count") * F.lit(min(1.0, rows / max(1, total)))
    negative = unknown.select(F.lit(len(families) - 1).alias("label"), "x", weight.alias("weight"))
    training = counted.transform(positive).select("label", "x", "weight").union(negative)
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", elasticNetParam=1.0, regParam=2e-4, maxIter=60, standardization=False).fit(training)
    w = model.coefficientMatrix.toArray()
    used = np.flatnonzero(np.abs(w).max(axis=0) > 1e-6)
    weights = [(counted.vocabulary[i], [float(x) for x in w[:, i]]) for i in used]
    intercepts = [float(x) for x in model.interceptVector.toArray()]
    # calibration: what one in a thousand unknown paragraphs reaches at most; half is the least that is asked
    best = F.array_max(F.slice(vector_to_array("probability"), 1, len(families) - 1))
    reached = model.transform(unknown).select(F.ceil(best * STEPS).alias("step"), "count").where(F.col("step") > STEPS // 2)
    level, above = 0.5, 0
    for r in sorted(reached.groupBy("step").agg(F.sum("count").alias("n")).collect(), reverse=True):
        above += r["n"]
        if above * 1000 > total:
            level = min(0.9, r["step"] / STEPS)
            break
    # how many paragraphs have each word that is a feature by itself
    here = unknown.agg(Summarizer.sum(F.col("x"), F.col("count").cast("double"))).first()[0] if total else []
    often = dict(zip(counted.vocabulary, map(float, here)))
    unknown.unpersist()
    in_weights = {x for g, _ in weights for x in g.split(" ")}
    telling = telling_words(weights, intercepts, level, sorted(in_weights, key=lambda x: (-often.get(x, 0), x)))
    return LicenceModel(families, weights, intercepts, level, telling)


def telling_words(weights: list[tuple[str, list[float]]], intercepts: list[float], level: float, words: list[str]) -> list[str] | None:
    """The words of which a paragraph must hold one for any family to reach the level; the first words are left out if they can be.

    None if a family reaches it without any word.
    """
    # p >= level needs p / (p + unknown) >= level, so a lead of this many log odds
    lead = np.log(level / (1 - level)) - 1e-6
    bound = np.array(intercepts[:-1]) - intercepts[-1]
    if (bound >= lead).any():
        return None
    holding: dict[str, list[tuple[set[str], np.ndarray]]] = {}
    for gram, w in weights:
        parts, gain = set(gram.split(" ")), np.maximum(0.0, np.array(w[:-1]) - w[-1])
        for x in parts:
            holding.setdefault(x, []).append((parts, gain))
    plain: set[str] = set()
    for x in words:
        # the grams that this word completes
        reached = bound + sum(gain for parts, gain in holding.get(x, []) if parts - {x} <= plain)
        if (reached < lead).all():
            bound = reached
            plain.add(x)
    return [x for x in words if x not in plain]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, wherever the optimiser moves the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def probabilities(model: LicenceModel) -> Column:
    """Probability of each family, from the column grams."""
    sums = F.array(*[F.lit(x) for x in model.intercepts])
    if model.weights:
        known = F.lit([g for g, _ in model.weights])
        table = F.map_from_arrays(known, F.array(*[F.array(*[F.lit(x) for x in w]) for _, w in model.weights]))
        sums = F.aggregate(F.array_intersect("grams", known), sums, lambda a, g: F.zip_with(a, F.element_at(table, g), lambda x, y: x + y))

    def normalised(raised: Column) -> Column:
        return let(F.aggregate(raised, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(raised, lambda x: x / total))

    return let(sums, lambda s: let(F.array_max(s), lambda top: let(F.transform(s, lambda x: F.exp(x - top)), normalised)))


def scan(docs: DataFrame, model: LicenceModel, text: str = "text", templates: dict[str, list[str]] | None = None, least_shared: float = 0.6) -> DataFrame:
    """docs without the text, a row for each licence paragraph: paragraph (from 0), licence, probability, shared."""
    templates = templates or TEMPLATES
    spark: SparkSession = docs.sparkSession
    docs, at, named_back = set_aside(docs, ["paragraph", "licence", "probability", "shared"], (text,))
    kept = [c for c in docs.columns if c != at[text]]
    if model.telling is None:
        rows = paragraphs(docs, at[text])
    else:
        # most texts are left out whole
        rows = paragraphs(docs.where(holds_word(F.col(at[text]), model.telling)), at[text]).where(holds_word(F.col("_p"), model.telling))
    rows = rows.select(*kept, "paragraph", words(F.col("_p")).alias("w"))
    families = F.lit(model.families)

    def named(p: Column) -> Column:
        best = F.array_max(F.slice(p, 1, len(model.families) - 1))
        reached = lambda b: F.when((b >= model.level) & (b >= F.element_at(p, -1)), F.struct(F.element_at(families, F.array_position(p, b).cast("int")).alias("licence"), b.alias("probability")))
        return let(best, reached)

    found = rows.withColumn("grams", grams(F.col("w"))).withColumn("best", let(probabilities(model), named)).where("best IS NOT NULL")
    found = found.select(*kept, "paragraph", "grams", F.col("best.licence").alias("licence"), F.col("best.probability").alias("probability"))
    # a template's grams by family: as many rows as there are families
    texts = spark.createDataFrame([(f, t) for f in sorted(templates) for t in templates[f]], "licence string, t string")
    texts = texts.groupBy("licence").agg(F.collect_list(grams(words(F.col("t")))).alias("_templates"))
    met = found.join(F.broadcast(texts), "licence")
    share = lambda t: F.size(F.array_intersect("grams", t)) / F.least(F.size("grams"), F.size(t))
    met = met.withColumn("shared", F.array_max(F.transform("_templates", share))).where(F.col("shared") >= least_shared)
    return named_back(met)
