"""Licence notices: a sparse word n-gram classifier, confirmed against templates.

Paragraphs are lines, and runs of adjacent lines, as headers are wrapped.  Features are the distinct word pairs of a paragraph that occur in
the templates.  A multinomial logistic regression over the families and an unknown class
is trained here: positives are the templates and their variants, negatives are a bounded
sample of the corpus' own paragraphs (``MAX_NEGATIVES``) and fragments of templates; a
temperature is fitted on examples set apart.  A paragraph counts as a notice if a family
is likelier than ``MIN_SCORE`` and at least ``MIN_OVERLAP`` of the pairs of one of that
family's templates occur in it; pairs with a year, a holder's name or a paragraph's edge
are not counted, as they differ from notice to notice.

Scoring uses DataFrame functions only: pairs are hashed and exploded, joined with the
weight table (its size is the templates', so it is broadcast), and summed per paragraph.
A paragraph without any template pair has no features and is unknown.

Runs hold no line without words and no line that is a whole notice by itself (all pairs of
a template), and at most the longest template's number of words between their first and last line.  They are scored
only in texts that hold ``MIN_OVERLAP`` of some template's pairs outside such lines, line
breaks included, since no other text can have one.  Of runs of one template that share
more than an edge line, the one with most overlap counts (then the shortest, the first);
a run, or a line with a part of a template, that shares lines with another of its family
counts unless the other holds as much of its template, and does not count within a run of
another family with more overlap.

Defined results: null and empty texts have no notices; rows equal in id and text get
equal results; very long texts are handled whole; other columns are kept, and an input
column named like an output column is replaced.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm._common import in_share, materialize
from folioscope.llm.line_chunks import _let as let

MAX_NEGATIVES = 1000
MIN_SCORE = 0.5
MIN_OVERLAP = 0.6
UNKNOWN = "unknown"

# Customary wording of licence notices, by family.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache License 2.0.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU General Public License, version 2.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "Released into the public domain under CC0 1.0 Universal."],
    "reserved": ["All rights reserved.", "Copyright (c) 2020 The Authors. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."],
}

#: Words of the templates that differ from notice to notice: edges, year, holder.
_VARIABLE = {"^", "$", "2020", "authors"}
#: Other years and holders, for training.
_HOLDERS = ["2019 John Smith", "1998-2024 Acme Inc", "by the University"]

#: Sentences near the templates' vocabulary that are no notices.
_CONFUSABLE = [
    "The driver renewed the license at the office of the city and paid the fee.",
    "Permission to enter the building is granted by the guard of the school.",
    "A copy of the letter was found in the files of the court and of the church.",
    "The version of the story that was published in the paper is not complete.",
    "This work is of the same kind as the other works of the author.",
    "Any person may use the source of the river without restriction.",
    "The terms of the general public were met under the conditions of the law.",
    "The software of the bank is provided by the state for any purpose.",
]


def words_of(text: str) -> list[str]:
    """What ``pair_hashes`` takes as words (ASCII lower case)."""
    return [w for w in re.split("[^a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]


def pairs_of(text: str) -> set[str]:
    """Distinct word pairs, the paragraph's edges counted as words."""
    words = words_of(text)
    return {f"{a} {b}" for a, b in pairwise(["^", *words, "$"])} if words else set()


def core_of(text: str) -> set[str]:
    """The pairs of a template that every such notice has."""
    return {p for p in pairs_of(text) if not _VARIABLE & set(p.split(" "))}


def _covers(found: set[str], cores: list[set[str]]) -> bool:
    return any(len(found & c) >= MIN_OVERLAP * len(c) for c in cores)


def _fold(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _examples(negatives: list[str]) -> tuple[list[set[str]], list[str]]:
    features, labels = [], []
    cores = [core_of(t) for ts in TEMPLATES.values() for t in ts]
    for family, texts in TEMPLATES.items():
        for text in texts:
            whole = text.split()
            variants = [text, text, text.replace("License", "Licence"), "Copyright (c) 2021 A. Author. " + text, text + " See the file for details.", " ".join(whole[: max(4, len(whole) * 4 // 5)]), " ".join(whole[len(whole) // 5 :])]
            if "2020 The Authors" in text:
                variants += [text.replace("2020 The Authors", h) for h in _HOLDERS]
                variants += [v.replace("(c) ", "") for v in variants[-len(_HOLDERS) :]]
            for v in variants:
                features.append(pairs_of(v))
                labels.append(family)
            for a in range(0, len(whole) - 2, 3):  # a few words are not a notice
                part = pairs_of(" ".join(whole[a : a + 3]))
                if not _covers(part, cores):
                    features.append(part)
                    labels.append(UNKNOWN)
    for text in [*_CONFUSABLE, *negatives]:
        features.append(pairs_of(text))
        labels.append(UNKNOWN)
    return features, labels


class Model:
    """Weights of the template pairs, one row a pair."""

    def __init__(self, negatives: list[str], rounds: int = 400, rate: float = 2.0, penalty: float = 1e-4) -> None:
        self.classes = [UNKNOWN, *TEMPLATES]
        self.templates = [(f, pairs_of(t)) for f, texts in TEMPLATES.items() for t in texts]
        self.cores = [(f, core_of(t)) for f, texts in TEMPLATES.items() for t in texts]
        self.pairs = sorted(set().union(*(p for _, p in self.templates)))
        number = {p: i for i, p in enumerate(self.pairs)}
        features, labels = _examples(negatives)
        x = np.zeros((len(features), len(self.pairs) + 1))
        for i, found in enumerate(features):
            x[i, [number[p] for p in found if p in number]] = 1.0
        x[:, -1] = 1.0
        y = np.array([self.classes.index(label) for label in labels])
        apart = np.arange(len(y)) % 7 == 3
        w = np.zeros((x.shape[1], len(self.classes)))
        fit_x, target = x[~apart], np.eye(len(self.classes))[y[~apart]]
        for _ in range(rounds):
            w -= rate * (fit_x.T @ (_softmax(fit_x @ w) - target) / len(fit_x) + penalty * w)
        held, answer = x[apart] @ w, y[apart]
        scales = np.exp(np.linspace(-2, 2, 81))
        losses = [-np.log(np.maximum(_softmax(held / t)[np.arange(len(answer)), answer], 1e-12)).mean() for t in scales]
        w /= scales[int(np.argmin(losses))]
        self.bias, self.weights = w[-1], w[:-1]

    def classify(self, text: str) -> tuple[str, float] | None:
        """The same decision for one paragraph; None: no notice."""
        found = pairs_of(text)
        hits = [i for i, p in enumerate(self.pairs) if p in found]
        p = _softmax((self.bias + self.weights[hits].sum(axis=0))[None])[0]
        best = int(p.argmax())
        family = self.classes[best]
        overlap = max((len(found & t) / len(t) for f, t in self.cores if f == family), default=0.0)
        return (family, float(p[best])) if hits and best and p[best] >= MIN_SCORE and overlap >= MIN_OVERLAP else None


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Negatives: the first lines (at most 400 characters) of about ``MAX_NEGATIVES`` documents, chosen by hash."""
    rows = docs.where(F.col(text).isNotNull())
    n = max(1, rows.count())
    share = min(1.0, MAX_NEGATIVES / n)
    lines = rows.where(in_share(F.xxhash64(doc_id, text), share)).select(F.substring(F.substring_index(text, "\n", 1), 1, 400).alias("line")).distinct().collect()
    cores = [core_of(t) for ts in TEMPLATES.values() for t in ts]
    # A sampled line that holds a template's wording is no negative example.
    return Model(sorted(r["line"] for r in lines if not _covers(pairs_of(r["line"]), cores)))


def _weight_table(spark: SparkSession, model: Model) -> DataFrame:
    rows = [(p, w.tolist(), [1.0 if p in t else 0.0 for _, t in model.cores]) for p, w in zip(model.pairs, model.weights, strict=True)]
    table = spark.createDataFrame(rows, "pair string, w array<double>, t array<double>")
    return table.select(F.xxhash64(F.split_part("pair", F.lit(" "), F.lit(1)), F.split_part("pair", F.lit(" "), F.lit(2))).alias("g"), "w", "t")


def _words(line: Column) -> Column:
    return F.filter(F.split(_fold(line), "[^a-z0-9]+", -1), lambda w: w != "")


def _grams(lines: DataFrame) -> DataFrame:
    """(row, paragraph, g) of (row, paragraph, line)."""
    words = lines.select("row", "paragraph", _words(F.col("line")).alias("words")).where(F.size("words") > 0)
    framed = words.select("row", "paragraph", F.concat(F.array(F.lit("^")), "words", F.array(F.lit("$"))).alias("words"))
    grams = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.xxhash64(a, b))
    return framed.select("row", "paragraph", F.explode(grams).alias("g"))


def _breaks(lines: DataFrame) -> DataFrame:
    """(row, paragraph, g) of the pairs over the ends of lines (row, paragraph, line, after)."""
    a, b = F.element_at(_words(F.col("line")), -1), F.element_at(_words(F.col("after")), 1)
    has = lambda c: F.col(c).rlike("[A-Za-z0-9]")
    return lines.where(has("line") & has("after")).select("row", "paragraph", F.xxhash64(a, b).alias("g"))


def _decide(hits: DataFrame, table: DataFrame, model: Model) -> DataFrame:
    """Rows (row, paragraph, template, family, score, overlap, overlaps: of each template) of the notices among distinct (row, paragraph, g)."""
    # The table has as many rows as the templates have pairs.
    hits = hits.join(F.broadcast(table), "g")
    n, m = len(model.classes), len(model.cores)
    sums = [F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(n)] + [F.sum(F.col("t")[i]).alias(f"t{i}") for i in range(m)]
    found = hits.groupBy("row", "paragraph").agg(*sums)
    logits = F.array(*(F.col(f"w{i}") + F.lit(float(model.bias[i])) for i in range(n)))
    found = found.withColumn("logits", logits).withColumn("top", F.array_max("logits"))
    found = found.withColumn("best", F.array_position("logits", F.col("top")).cast("int")).withColumn("score", 1.0 / F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    families = F.array(*(F.lit(c) for c in model.classes))
    overlaps = F.array(*(F.when(F.element_at(families, F.col("best")) == f, F.col(f"t{j}") / len(p)).otherwise(0.0) for j, (f, p) in enumerate(model.cores)))
    found = found.withColumn("overlaps", overlaps).withColumn("overlap", F.array_max("overlaps"))
    found = found.select("row", "paragraph", F.array_position("overlaps", F.col("overlap")).alias("template"), F.element_at(families, F.col("best")).alias("family"), "score", "overlap", "overlaps")
    return found.where((F.col("family") != UNKNOWN) & (F.col("score") >= MIN_SCORE) & (F.col("overlap") >= MIN_OVERLAP))


def _runs(lines: Column, starts: Column, size: int) -> Column:
    """Array of (paragraph: (first, last), line): runs from ``starts`` of two lines or more, with words in each."""
    counts = F.transform(lines, lambda x: F.size(_words(x)))

    def reach(n: Column, s: Column) -> Column:
        """How many lines may follow line ``s``: words between the run's ends are at most ``size``."""
        ahead = F.slice(n, s + 2, size + 2)
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("k"), F.lit(True).alias("on"))

        def step(a: Column, x: Column) -> Column:
            on = a["on"] & (x > 0) & (a["words"] <= size)
            return F.struct(F.when(on, a["words"] + x).otherwise(a["words"]).alias("words"), F.when(on, a["k"] + 1).otherwise(a["k"]).alias("k"), on.alias("on"))

        return F.aggregate(ahead, start, step, lambda a: a["k"])

    def of(n: Column, s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), reach(n, s)), lambda k: (k > 0) & (F.element_at(n, s + 1) > 0))
        return F.transform(ends, lambda k: F.struct(F.struct(s.alias("first"), (s + k).alias("last")).alias("paragraph"), F.array_join(F.slice(lines, s + 1, k + 1), "\n").alias("line")))

    return F.flatten(let(counts, lambda n: F.transform(starts, lambda s: of(n, s))))


def _chosen(found: Column) -> Column:
    """Of (first, last, overlap, ...) in order: of those that share more than an edge line the one with most overlap."""
    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        return (
            F.when((F.size(kept) == 0) | (x["first"] >= last["last"]), F.concat(kept, F.array(x)))
            .when(x["overlap"] > last["overlap"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x)))
            .when((x["overlap"] == last["overlap"]) & (x["last"] - x["first"] < last["last"] - last["first"]), F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x)))
            .otherwise(kept)
        )

    return F.aggregate(found, F.slice(found, 1, 0), step)


def _no_parts(found: Column, near: int) -> Column:
    """Of a text's runs in order those that are not part of another; only ``near`` neighbours can share lines."""
    def better(x: Column, k: Column, y: Column, j: Column) -> Column:
        shares = (y["first"] <= x["last"]) & (x["first"] <= y["last"])
        as_much = F.element_at(y["overlaps"], x["template"].cast("int")) >= x["overlap"]
        mutual = F.element_at(x["overlaps"], y["template"].cast("int")) >= y["overlap"]
        part = as_much & (j != k) & (~mutual | (j < k))
        inside = (y["first"] <= x["first"]) & (x["last"] <= y["last"]) & (y["overlap"] > x["overlap"])
        return shares & F.when(x["family"] == y["family"], part).otherwise(inside)

    def others(k: Column) -> Column:
        first = F.greatest(k - near, F.lit(0))
        return F.transform(F.slice(found, first + 1, 2 * near + 1), lambda y, j: F.struct(y.alias("y"), (first + j).alias("j")))

    return F.filter(found, lambda x, k: ~F.exists(others(k), lambda o: better(x, k, o["y"], o["j"])))


def find_notices(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (row, paragraph, family, score, overlap) of the notices; ``row`` is a hash of id and text, ``paragraph`` the first line."""
    texts = docs.select(F.xxhash64(doc_id, text).alias("row"), F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("lines"))
    pairs = F.arrays_zip(F.col("lines").alias("line"), F.slice("lines", 2, F.size("lines")).alias("after"))
    lines = texts.select("row", F.posexplode(pairs).alias("paragraph", "x")).select("row", "paragraph", F.col("x.line").alias("line"), F.col("x.after").alias("after"))
    table = _weight_table(docs.sparkSession, model)
    known = F.broadcast(table.select("g"))
    inner = _grams(lines).join(known, "g", "left_semi").withColumn("at_end", F.lit(False))
    over = _breaks(lines).join(known, "g", "left_semi").withColumn("at_end", F.lit(True))
    # Written: lines, the choice of texts and the places of runs read it.
    hits = materialize(inner.unionByName(over).dropDuplicates(["row", "paragraph", "g", "at_end"]), "license-pairs")
    single = materialize(_decide(hits.where(~F.col("at_end")).drop("at_end"), table, model), "license-lines")
    whole = single.where("overlap >= 1")
    runs = _wrapped(texts, hits, whole, single.where("overlap < 1"), table, model)
    return whole.select("row", "paragraph", "family", "score", "overlap").unionByName(runs)


def _wrapped(texts: DataFrame, hits: DataFrame, single: DataFrame, partial: DataFrame, table: DataFrame, model: Model) -> DataFrame:
    """Notices that are runs of lines, or lines with a part of a template (``partial``); not over ``single``."""
    m = len(model.cores)
    rest = hits.join(single.select("row", "paragraph"), ["row", "paragraph"], "left_anti")
    sums = rest.select("row", "g").distinct().join(F.broadcast(table), "g").groupBy("row").agg(*(F.sum(F.col("t")[j]).alias(f"t{j}") for j in range(m)))
    enough = F.lit(False)
    for j, (_, p) in enumerate(model.cores):
        enough = enough | (F.col(f"t{j}") / len(p) >= MIN_OVERLAP)
    rows = materialize(sums.where(enough).select("row"), "license-texts")
    starts = rest.join(rows, "row", "left_semi").groupBy("row").agg(F.array_sort(F.collect_set("paragraph")).alias("starts"))
    alone = single.join(rows, "row", "left_semi").groupBy("row").agg(F.collect_set("paragraph").alias("alone"))
    places = materialize(starts.join(alone, "row", "left").withColumn("alone", F.coalesce("alone", F.array().cast("array<int>"))), "license-places")
    # Texts equal in id and text are one row.
    some = texts.join(places, "row").dropDuplicates(["row"])
    some = some.select("row", "starts", F.transform("lines", lambda x, k: F.when(F.array_contains("alone", k), "").otherwise(x)).alias("lines"))
    size = max(len(words_of(t)) for ts in TEMPLATES.values() for t in ts)
    runs = some.select("row", F.explode(let(F.col("lines"), lambda x: _runs(x, F.col("starts"), size))).alias("x")).select("row", F.col("x.paragraph").alias("paragraph"), F.col("x.line").alias("line"))
    found = _decide(_grams(runs).join(F.broadcast(table.select("g")), "g", "left_semi").dropDuplicates(["row", "paragraph", "g"]), table, model)
    ends = F.struct(F.col("paragraph").alias("first"), F.col("paragraph").alias("last")).alias("paragraph")
    found = found.unionByName(partial.select(*(ends if c == "paragraph" else F.col(c) for c in found.columns)))
    # Each template that a run holds: a short one may be part of a long one.
    found = found.select("row", "paragraph", "family", "score", "overlaps", F.posexplode("overlaps").alias("template", "overlap")).withColumn("template", F.col("template") + 1).where(F.col("overlap") >= MIN_OVERLAP)
    each = F.struct(F.col("paragraph.first").alias("first"), F.col("paragraph.last").alias("last"), "overlap", "family", "template", "score", "overlaps")
    chosen = found.groupBy("row", "family", "template").agg(F.array_sort(F.collect_list(each)).alias("found")).select("row", F.explode(_chosen(F.col("found"))).alias("x"))
    every = chosen.groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("found"))
    # A run has at most size + 2 lines; runs of one template share edge lines only.
    return every.select("row", F.explode(_no_parts(F.col("found"), (size + 2) * m)).alias("x")).select("row", F.col("x.first").alias("paragraph"), "x.family", "x.score", "x.overlap")


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns and n_paragraphs, notices (paragraph, family, score, overlap; in order), families (sorted)."""
    notices = find_notices(docs, model, doc_id, text).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("paragraph", "family", "score", "overlap"))).alias("notices"))
    kept = [c for c in docs.columns if c not in ("n_paragraphs", "notices", "families")]
    # Texts stay where they are in size: only hashes and counts are needed beside the notices.
    out = docs.select(*kept, F.xxhash64(doc_id, text).alias("__row"), F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long").alias("n_paragraphs"))
    out = out.join(notices, out["__row"] == notices["row"], "left").drop("__row", "row")
    none = F.array().cast(notices.schema["notices"].dataType)
    return out.withColumn("notices", F.coalesce("notices", none)).withColumn("families", F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"]))))
