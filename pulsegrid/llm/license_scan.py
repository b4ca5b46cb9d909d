"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A sparse multinomial logistic regression over word n-grams names the licence family of a
paragraph. It learns from variants of template notices with words left out, and, as the
unknown class, from paragraphs of the corpus that no template confirms, as they are and with
a stray licence word, and from a few fixed sentences. Its n-grams all hold an anchor: a word
of the templates outside a fixed list of stop words, however frequent it is in the corpus. A
paragraph without an anchor has no features and is unknown, so only those with one are
scored. What is predicted counts where its probability passes a held-out limit and the
paragraph shares enough word pairs with a template of the family.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import some_rows, table

TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["This work has been released into the public domain.", "This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "Copyright (c) 2020 by the authors. All rights reserved.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."],
}
#: Words of the templates that any text holds.
STOP_WORDS = (
    "the", "of", "to", "this", "and", "or", "is", "in", "an", "any", "you", "it", "on", "by", "at", "as", "be", "that", "with", "for", "are", "has", "been", "into", "under", "use", "may", "not", "can", "work",
    "all", "have", "no", "along", "above", "name", "names", "made", "available", "prior", "later", "either", "without", "should", "shall", "following", "person", "used", "its", "nor", "appear", "except", "unless",
)
#: Prose with licence words that licenses nothing.
PLAIN = (
    "The license to drive a car is granted to any person over eighteen.", "All rights of the child must be respected by the state.", "The new version of the software was released in May.",
    "She asked for permission to copy the documentation before the exam.", "The public library opened a branch in the general hospital.", "Free delivery is included in the price of any two copies.",
    "His copyright claim was dismissed by the court last year.", "The city council reserved the front rows for its own authors.", "They were granted a permit to redistribute food to the camps.",
    "Conditions for the race were met only after the rain had stopped.", "The commons were open to everyone in the parish.", "Attribution of the painting to the master is disputed.",
    "A general without an army is free to write.", "Warranties on the kitchen expire after two years.", "The file was modified and the source code moved.", "Public domain names are sold by the registrar.",
)
#: Documents that unknown paragraphs are taken from, and those paragraphs, about.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 1_000, 5_000
VARIANTS = 40
#: Most frequent n-grams of the variants that the regression sees.
NGRAMS = 2_000
CONTAINED = 0.6
UNKNOWN = "unknown"


@dataclass(frozen=True)
class LicenceModel:
    families: tuple[str, ...]
    anchors: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    biases: tuple[float, ...]
    limit: float


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*+"), F.lit(0))


def ngrams(words: Column, most: int = 3) -> Column:
    """All runs of one to ``most`` words, each once."""
    return F.array_distinct(F.concat(*[_runs(words, n) for n in range(1, most + 1)]))


def _runs(words: Column, n: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def paragraphs(text: Column) -> Column:
    """The lines of a text; a line that goes on without a full stop into one that doesn't begin like a sentence is one with it.

    Comment marks at the start of a line that goes on are left out.
    """
    joined = F.regexp_replace(text, r"(?<=[^\s.!?:])[ \t]*\r?\n[ \t]*(?:[#*/;-]{1,3}[ \t]*)?(?=[a-z0-9(\"'])", " ")
    return F.split(joined, r"[\r\n]+")


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())


def any_word(words: tuple[str, ...]) -> str:
    """A pattern of any of the words in either case; words are grouped by their first two characters, so that few are tried at a place."""
    groups: dict[str, dict[str, list[str]]] = {}
    for w in sorted(words):
        groups.setdefault(re.escape(w[0]), {}).setdefault(re.escape(w[1:2]), []).append(re.escape(w[2:]))
    firsts = [f"{a}(?:{'|'.join(f'{b}(?:{"|".join(c)})' for b, c in seconds.items())})" for a, seconds in groups.items()]
    return r"(?i)\b(?:" + "|".join(firsts) + r")\b"


def anchors_of(templates: dict[str, list[str]]) -> tuple[str, ...]:
    found = {w for texts in templates.values() for t in texts for w in _words(t) if len(w) > 1 and re.search("[a-z]", w)}
    return tuple(sorted(found - set(STOP_WORDS)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES) -> LicenceModel:
    """Fit on variants of the templates and paragraphs of a bounded sample of the corpus.

    Small and empty tables, and those of notices alone, leave the fixed sentences as unknown.
    """
    spark = docs.sparkSession
    families = (UNKNOWN, *sorted(templates))
    anchors = anchors_of(templates)
    anchored = _strings(anchors)
    notices = spark.createDataFrame([(families.index(f), t) for f in sorted(templates) for t in templates[f]], "label int, text string").select("label", tokens(F.col("text")).alias("words"))
    some = some_rows(docs, id_col, text_col, SAMPLE_DOCS)
    lines = some.select(F.explode(paragraphs(F.coalesce(F.col(text_col), F.lit("")))).alias("text")).distinct().orderBy(F.xxhash64("text"), "text").limit(SAMPLE_PARAGRAPHS)
    lines = lines.select(tokens(F.col("text")).alias("words")).where("size(words) > 0")
    plain = spark.createDataFrame([(t,) for t in PLAIN], "text string").select(tokens(F.col("text")).alias("words"))
    unknown = lines.where(~_confirmed(F.col("words"), None, templates)).union(plain)
    # Variant k leaves out words by a hash of place and k, a fifth at most; some are halves.
    varied = notices.select("label", "words", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("k")).select(
        "label", "k", F.filter("words", lambda w, i: (F.pmod(F.xxhash64(w, i, F.col("k")), F.lit(20)) >= F.col("k") % 5)
            & ((F.col("k") % 4 != 1) | (F.size("words") < 12) | (2 * i < F.size("words")))
            & ((F.col("k") % 4 != 2) | (F.size("words") < 12) | (2 * i >= F.size("words"))),
        ).alias("words"),
    )
    stray = F.concat(F.col("words"), F.array(F.element_at(anchored, F.pmod(F.xxhash64("words"), F.lit(len(anchors))).cast("int") + 1)))
    nothing = unknown.select(F.lit(0).alias("label"), F.pmod(F.xxhash64("words"), F.lit(VARIANTS)).cast("int").alias("k"), F.explode(F.array("words", stray)).alias("words"))
    rows = varied.union(nothing).withColumn("grams", F.filter(ngrams(F.col("words")), lambda g: F.arrays_overlap(F.split(g, " "), anchored))).drop("words").repartition(4, "k").cache()
    try:
        top = rows.where("label > 0").select(F.explode("grams").alias("g")).groupBy("g").count().orderBy(F.desc("count"), "g").limit(NGRAMS)
        vocabulary = [r["g"] for r in top.collect()]
        vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
        held = F.col("k") % 5 == 4
        fitted = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=2e-4, maxIter=80).fit(vectors.transform(rows.where(~held)))
        scored = fitted.transform(vectors.transform(rows.where(held))).select("label", vector_to_array("probability").alias("p"))
        tail = scored.agg(
            F.percentile(F.when(F.col("label") > 0, F.element_at("p", F.col("label") + 1)), F.lit(0.02)).alias("low"),
            F.percentile(F.when(F.col("label") == 0, 1 - F.col("p")[0]), F.lit(0.999)).alias("high"),
        ).first()
    finally:
        rows.unpersist()
    low, high = (x if x is not None else 0.5 for x in tail)
    w = fitted.coefficientMatrix.toArray()
    weights = {g: tuple(round(float(x), 6) for x in w[:, k]) for k, g in enumerate(vocabulary) if abs(w[:, k]).max() > 1e-9}
    return LicenceModel(families, anchors, weights, tuple(float(x) for x in fitted.interceptVector.toArray()), float(min(0.9, max(0.3, (low + high) / 2))))


def _predicted(words: Column, model: LicenceModel) -> Column:
    """Probabilities of the families, unknown first."""
    table_ = F.map_from_arrays(_strings(list(model.weights)), F.from_json(F.lit(str([list(x) for x in model.weights.values()])), "array<array<double>>"))
    present = F.array_intersect(ngrams(words), _strings(list(model.weights)))
    logits = F.aggregate(present, F.array(*[F.lit(b) for b in model.biases]), lambda acc, g: F.zip_with(acc, F.element_at(table_, g), lambda a, b: a + b))
    powers = F.transform(F.array(logits), lambda z: F.transform(z, lambda x: F.exp(x - F.array_max(z))))[0]
    return F.transform(F.array(powers), lambda z: F.transform(z, lambda x: x / F.aggregate(z, F.lit(0.0), lambda a, y: a + y)))[0]


def _confirmed(words: Column, family: Column | None, templates: dict[str, list[str]]) -> Column:
    """True where the paragraph and a template share most of the word pairs of the shorter, three at least or all of the template's.

    The template is one of the family, or any where that is None.
    """
    pairs = {name: [sorted({" ".join(x) for x in zip(ws, ws[1:])}) for ws in map(_words, texts)] for name, texts in templates.items()}
    if family is None:
        known = F.array(*[_strings(q) for p in pairs.values() for q in p])
    else:
        known = F.element_at(F.create_map(*[x for name, p in sorted(pairs.items()) for x in (F.lit(name), F.array(*[_strings(q) for q in p]))]), family)
    own = F.array_distinct(_runs(words, 2))

    def shared(t: Column) -> Column:
        n = F.size(F.array_intersect(t, own))
        return (n >= F.lit(CONTAINED) * F.least(F.size(t), F.size(own))) & (n >= F.least(F.lit(3), F.size(t)))

    return F.exists(known, shared)


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``id, notices``: one row per row; ``notices`` are structs of paragraph number, family, probability.

    A null or empty text has none. Whole texts are read, a paragraph of any length as one.
    Repeated rows and null ids each give a row; other columns play no part.
    """
    gate = any_word(model.anchors)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    numbered = F.transform(paragraphs(F.col("t")), lambda p, i: F.struct((i + 1).alias("paragraph"), p.alias("text")))
    asked = F.when(F.col("t").rlike(gate), F.filter(numbered, lambda p: p["text"].rlike(gate)))
    told = F.transform(asked, lambda p: F.struct(p["paragraph"].alias("paragraph"), tokens(p["text"]).alias("words")))
    scored = F.transform("told", lambda p: F.struct(p["paragraph"].alias("paragraph"), p["words"].alias("words"), _predicted(p["words"], model).alias("p")))
    best = F.transform(
        "scored",
        lambda s: F.struct(
            s["paragraph"].alias("paragraph"),
            s["words"].alias("words"),
            F.element_at(_strings(model.families), F.array_position(s["p"], F.array_max(s["p"])).cast("int")).alias("family"),
            F.array_max(s["p"]).alias("probability"),
        ),
    )
    sure = F.filter("best", lambda b: (b["family"] != UNKNOWN) & (b["probability"] >= model.limit) & _confirmed(b["words"], b["family"], templates))
    out = F.transform("sure", lambda b: F.struct(b["paragraph"].alias("paragraph"), b["family"].alias("family"), F.round(b["probability"], 6).alias("probability")))
    rows = rows.select("id", told.alias("told")).withColumn("scored", scored).withColumn("best", best).withColumn("sure", sure)
    empty = F.array().cast("array<struct<paragraph:int,family:string,probability:double>>")
    return rows.select("id", F.coalesce(out, empty).alias("notices"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.col("notices.family"))), ",").alias("families"),
        F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"])), ",").alias("notices"),
    )
