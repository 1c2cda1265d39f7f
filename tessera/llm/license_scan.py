"""Licence scans: a trained paragraph classifier, in DataFrame and Spark ML operations only.

A paragraph is a line of a text.  Its lower-cased words' uni- and bigrams are hashed
to 2**BITS places, and a multinomial logistic regression over these sparse vectors gives
each licence family, and the class "unknown", a probability.  It is trained on TEMPLATES
(public licence notices, whole and with their parts) and, for "unknown", on BACKGROUND
sentences and on all of the corpus's own paragraphs that share few words with
any template; together these weigh as much as WEIGHT examples.  Only places that a gram of templates or BACKGROUND has are
learnt, as no other can speak for a family; others have no weight.  The unknown class is calibrated on a third of the background and paragraphs that the fit does
not see: a family counts only if its probability is at least ``LEAST`` and greater than that of all but
``MAY_PASS`` of these.  A predicted family is confirmed by comparison with its templates: of the
best template's word bigrams, at least ``CONFIRMED`` must stand in the paragraph.

A notice may also stand within a long line, or be wrapped over several lines: windows of
WINDOWS words of the whole text, each half over the next and running across line breaks,
are classified like paragraphs.  Every line and window with a word is judged, whatever its words are.  Of the hits of a text, the best counts (confirmed ones
first, then whole lines, then by similarity), then the best of those that share no matched
words with it, and so on.  A window's hit belongs to the line where its match begins.

Few spans of a text can hold a hit: the weights bound what any part of a span may reach (``Scanner.possible``), so the
lines and windows of the others are known to be none without being classified.  The bound loses no hit.

All scoring is one pass over the texts; only hits are shuffled, by text.  The model is of
fixed size.  Training is one pass that writes the paragraphs' features, and then passes over these.

Defined cases: a null, empty or blank text has no paragraphs; a paragraph without words is
unknown; repeated rows give repeated results; of equal probabilities the family first in
alphabetic order counts; very long lines are whole paragraphs and windows too.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import HashingTF, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import stored

BITS = 13
LEAST = 0.5
CONFIRMED = 0.6
#: Share of the held-out background that may pass the calibrated threshold.
MAY_PASS = 0.01
#: Examples that all of the corpus's paragraphs together weigh as much as, at most.
WEIGHT = 400
#: Paragraphs that a task of the fit is worth.
ROWS = 20_000
#: Steps that the calibrated threshold is found in.
STEPS = 10_000
#: Words of the windows; each starts half a window after the one before.
WINDOWS = (16, 32, 64)
#: Words of the spans that are tested before their lines and windows are classified, and words that each shares with the next: half a largest window.
SPAN, OVERLAP = 96, 32
UNKNOWN = "unknown"

#: Licence notices by family.  Fixed public wording.
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Released under the Creative Commons Attribution license CC-BY 4.0", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal public domain dedication.", "SPDX-License-Identifier: CC0-1.0"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released into the public domain under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
}
#: Sentences with words that licences use, which are none.
BACKGROUND = [
    "He lost his driving license after the third offence.", "The software was released in version 3 last week.", "The city granted permission to build along the river.",
    "Copyright law protects authors and their heirs.", "The university published the terms of the programme.", "You may obtain a copy of the book at the library.",
    "The Apache helicopter flew over the field.", "She studied at MIT before she moved to the coast.", "The general public may visit the garden free of charge.",
    "The foundation distributes food without restriction.", "A fishing licence is required in this area.", "Creative work and common sense go together.",
    "The source of the river lies in the mountains.", "All rights reserved.", "Contact us for more information about this product.",
    "The report and the accompanying materials are available on request.", "No part of this text says how it may be used.", "Version 2.0 of the manual is out.",
]


def words_of(paragraph: Column) -> Column:
    """Lower-cased words: runs of letters and digits, with the dots, plus and hyphens inside them."""
    return F.regexp_extract_all(F.lower(paragraph), F.lit(r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"), F.lit(0))


def _pairs_of(words: Column) -> Column:
    """Bigrams."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.coalesce(pairs, F.array().cast("array<string>"))


def grams_of(words: Column) -> Column:
    """Uni- and bigrams."""
    return F.concat(words, _pairs_of(words))


def _hashed(paragraphs: DataFrame) -> DataFrame:
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=1 << BITS, binary=True).transform(paragraphs)


def _featurised(paragraphs: DataFrame) -> DataFrame:
    return _hashed(paragraphs.withColumn("_grams", grams_of(F.col("_words"))))


def paragraphs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, paragraph, _line, _words`` of each line with a word."""
    every = docs.select(F.col(id_col).alias("_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("paragraph", "_line"))
    return every.withColumn("_words", words_of(F.col("_line"))).filter(F.size("_words") > 0)


def _laid_out(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each text once: ``_id``, its words ``_w``, their pairs ``_pairs``, the line of each ``_n``, ``_found``
    (number, first word, size and text of each line with a word), the place in ``_found`` of each word's line ``_k``, and ``_row``, one number for each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    lines = F.transform(F.split("_text", "\n", -1), lambda line, i: F.struct(i.alias("i"), line.alias("line"), words_of(line).alias("ws")))
    rows = rows.select("_id", F.filter(lines, lambda u: F.size(u["ws"]) > 0).alias("_l"))
    rows = rows.withColumn("_w", F.flatten(F.transform("_l", lambda u: u["ws"])))
    per_word = lambda value: F.flatten(F.transform("_l", lambda u, k: F.array_repeat(value(u, k), F.size(u["ws"]))))
    rows = rows.withColumn("_n", per_word(lambda u, k: u["i"])).withColumn("_k", per_word(lambda u, k: k))
    starts = F.filter(F.transform("_k", lambda k, i: F.when((i == 0) | (k != F.get(F.col("_k"), i - 1)), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_found", F.zip_with("_l", starts, lambda u, at: F.struct(u["i"].alias("i"), at.cast("int").alias("begin"), F.size(u["ws"]).alias("size"), u["line"].alias("line"))))
    # the number comes last: filters that follow are not moved below it, where they would cut the texts again
    return rows.select("_id", "_w", "_n", "_k", _pairs_of(F.col("_w")).alias("_pairs"), "_found", F.monotonically_increasing_id().alias("_row"))


def _units(spans: DataFrame) -> DataFrame:
    """The lines ``own`` and the windows that begin from word ``from`` to before ``to``, of spans ``_s``."""
    at, w, n = F.col("_s.at"), F.col("_s.w"), F.col("_s.n")
    lines = F.transform("_s.own", lambda u: F.struct(F.lit(False).alias("_window"), u["begin"].alias("_begin"), F.slice(w, u["begin"] - at + 1, u["size"]).alias("_words"), F.slice(n, u["begin"] - at + 1, u["size"]).alias("_lines"), u["line"].alias("_line")))

    def windows(size: int) -> Column:
        one = lambda i: F.struct(
            F.lit(True).alias("_window"), i.cast("int").alias("_begin"), F.slice(w, i - at + 1, size).alias("_words"), F.slice(n, i - at + 1, size).alias("_lines"), F.lit(None).cast("string").alias("_line"))
        none = F.array().cast("array<int>")
        return F.transform(F.when(F.col("_s.from") < F.col("_s.to"), F.sequence("_s.from", F.col("_s.to") - 1, F.lit(size // 2))).otherwise(none), one)

    return spans.select("_id", "_row", F.explode(F.concat(lines, *[windows(n) for n in WINDOWS])).alias("_u")).select("_id", "_row", "_u.*")


def _span(at: Column, size: Column, own: Column, until: Column) -> Column:
    """What a span holds of its text: its words, their lines and pairs, the lines ``own``; windows begin in it before ``until``."""
    cut = lambda name, n: F.slice(F.col(name), at + 1, n)
    return F.struct(at.alias("at"), cut("_w", size).alias("w"), cut("_n", size).alias("n"), cut("_pairs", F.greatest(size - 1, F.lit(0))).alias("pairs"), own.alias("own"), at.alias("from"), until.alias("to"))


def units_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines and windows of each text that have a word: ``_id, _row`` (one number for each row of ``docs``), ``_words``,
    ``_lines`` (the line of each word), ``_begin`` (the place of the first word in the text), ``_window`` and ``_line`` (null for windows)."""
    rows, n = _laid_out(docs, id_col, text_col), F.size("_w")
    return _units(rows.select("_id", "_row", _span(F.lit(0), n, F.col("_found"), n).alias("_s")))


def _spans(rows: DataFrame) -> DataFrame:
    """Laid out texts in spans ``_s`` of words, each with its own words and the units that it holds: lines ``own``, and windows ``from`` a word to before another.

    A window belongs to the span of SPAN words, each OVERLAP over the next, where it begins, which holds all its words.
    So does a line, or else it is a span of its own.  The lines that begin in a span follow each other, so they are cut out of
    all by the places of its first word and of the next span's; a span carries its own words only, so the work is linear in a text.
    """
    step, n = SPAN - OVERLAP, F.size("_w")
    last = F.greatest(F.lit(0), F.ceil((n - SPAN) / step).cast("int"))
    inside = lambda u: u["begin"] + u["size"] <= F.least(F.floor(u["begin"] / step).cast("int"), F.col("_last")) * step + SPAN
    begun = lambda i: F.when(i <= 0, F.lit(0)).otherwise(F.get(F.col("_k"), i - 1) + 1)  # noqa: E731  lines that begin before word i

    def one(k: Column) -> Column:
        at = k * step
        until = F.when(k == F.col("_last"), F.size("_w")).otherwise(at + step)
        own = F.slice("_found", begun(at) + 1, begun(until) - begun(at))
        return _span(at, F.lit(SPAN), F.filter(own, inside), until)

    alone = F.transform(F.filter("_found", lambda u: ~inside(u)), lambda u: _span(u["begin"], u["size"], F.array(u), u["begin"]))
    rows = rows.withColumn("_last", last).filter(n > 0)
    return rows.select("_id", "_row", F.explode(F.concat(F.transform(F.sequence(F.lit(0), F.col("_last")), one), alone)).alias("_s"))


def _rows(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """A small table of (family, text) from a literal."""
    data = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in pairs])
    return spark.range(1).select(F.explode(data).alias("r")).select("r.*")


def _template_grams() -> dict[str, list[list[str]]]:
    """Word bigrams of the templates, as ``grams_of`` makes them."""
    import re

    out: dict[str, list[list[str]]] = {}
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = re.findall(r"[^\W_]+(?:[.+-][^\W_]+)*", text.lower())
            out.setdefault(family, []).append(sorted({f"{a} {b}" for a, b in zip(words, words[1:])} or set(words)))
    return out


def _model(spark: SparkSession, weights: np.ndarray, bias: np.ndarray) -> LogisticRegressionModel:
    java = spark.sparkContext
    made = java._jvm.org.apache.spark.ml.classification.LogisticRegressionModel("licences", _py2java(java, DenseMatrix(*weights.shape, weights.ravel(order="F"))), _py2java(java, DenseVector(bias)), len(bias), True)
    return LogisticRegressionModel(made)


class Scanner:
    """A trained model and its calibrated threshold."""

    def __init__(self, model: LogisticRegressionModel, families: list[str], threshold: float):
        self.model, self.families, self.threshold = model, families, threshold

    def classified(self, paragraphs: DataFrame) -> DataFrame:
        """Adds ``family`` (or unknown) and ``probability``; needs ``_words``."""
        return self._named(self._scored(paragraphs))

    def known(self, paragraphs: DataFrame) -> DataFrame:
        """Those of a known family, as ``classified`` has them.  The filter names the probabilities once, so they are made once for what it leaves out."""
        best = F.array_max(F.slice("_p", 2, len(self.families)))
        return self._named(self._scored(paragraphs).filter(best >= self.threshold))

    def _scored(self, paragraphs: DataFrame) -> DataFrame:
        return self.model.transform(_featurised(paragraphs)).withColumn("_p", vector_to_array("_probability"))

    def _named(self, got: DataFrame) -> DataFrame:
        best = F.array_max(F.slice("_p", 2, len(self.families)))  # class 0 is unknown
        place = F.array_position(F.slice("_p", 2, len(self.families)), best).cast("int")
        names = F.array(*[F.lit(f) for f in self.families])
        ok = best >= self.threshold
        got = got.withColumn("family", F.when(ok, F.element_at(names, place)).otherwise(F.lit(UNKNOWN)))
        return got.withColumn("probability", F.when(ok, best).otherwise(F.element_at("_p", 1)))

    def possible(self, spans: DataFrame) -> DataFrame:
        """Those of the laid out texts' spans in which some run of words may be of a known family.

        A family with the threshold's probability t has a logit that exceeds unknown's by log(t / (1 - t)) or more.
        The features of a run are among its span's, so what exceeds can't be more than the
        sum of the positive differences of the weights over the span.
        """
        weights, bias = self.model.coefficientMatrix.toArray(), self.model.interceptVector.toArray()
        over = np.maximum(weights[1:] - weights[0], 0.0)
        least = np.log(self.threshold / max(1 - self.threshold, 1e-12)) + bias[0] - bias[1:]
        most = _model(spans.sparkSession, over, -least).setFeaturesCol("_features").setRawPredictionCol("_over").setProbabilityCol("").setPredictionCol("")
        grams = F.concat(F.col("_s.w"), F.col("_s.pairs"))
        found = most.transform(_hashed(spans.withColumn("_grams", grams)))
        return found.filter(F.array_max(vector_to_array("_over")) >= -1e-6).select(*spans.columns)


def _learnable(docs: DataFrame, places: list[int], id_col: str, text_col: str) -> DataFrame:
    """Every paragraph of the corpus that shares at most one gram with the templates: its ``_features`` at ``places``, and ``held_out``.  A written table."""
    own = sorted({g for grams in _template_grams().values() for t in grams for g in t})
    # grams are made within the array of lines: what follows an explode does not cut the text again
    grams = F.transform(F.transform(F.split(F.col(text_col), "\n", -1), words_of), grams_of)
    lines = docs.filter(F.col(id_col).isNotNull()).select(F.explode(F.filter(grams, lambda g: F.size(g) > 0)).alias("_grams"))
    lines = lines.filter(F.size(F.array_distinct(F.filter("_grams", lambda g: g.isin(own)))) <= 1)
    rows = _hashed(lines).withColumnsRenamed({"_features": "_every"})
    rows = VectorSlicer(inputCol="_every", outputCol="_features", indices=places).transform(rows)
    return stored(rows.select("_features", _is_held_out(F.col("_grams")).alias("held_out")), "paragraphs")


def _is_held_out(grams: Column) -> Column:
    return F.pmod(F.xxhash64(grams), F.lit(3)) == 0


def _calibrated(judged: DataFrame) -> float:
    """The least threshold, in steps of 1 / STEPS from LEAST on, that at most MAY_PASS of the probabilities ``_best`` reach."""
    step = F.least(F.floor(F.col("_best") * STEPS), F.lit(STEPS)).cast("int")
    counts = {r.step: r["count"] for r in judged.groupBy(step.alias("step")).count().collect()}  # STEPS + 1 rows at most
    passed, least = 0, STEPS
    while least > LEAST * STEPS and passed + counts.get(least, 0) <= MAY_PASS * sum(counts.values()):
        passed += counts.get(least, 0)
        least -= 1
    return LEAST if least <= LEAST * STEPS else (least + 1) / STEPS


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scanner:
    """Fits the classifier and calibrates its threshold, on all paragraphs; what goes to the driver are the coefficients and counts."""
    spark = docs.sparkSession
    families = sorted(TEMPLATES)
    known = _rows(spark, [(f, t) for f in families for t in TEMPLATES[f]] + [(UNKNOWN, t) for t in BACKGROUND]).withColumn("_words", words_of(F.col("text")))
    half = F.floor(F.size("_words") / 2).cast("int")
    parts = F.when((F.size("_words") > 16) & (F.col("family") != UNKNOWN), F.array("_words", F.slice("_words", 1, half), F.slice("_words", half + 1, half + 1))).otherwise(F.array("_words"))
    known = known.select("family", F.explode(parts).alias("_words"))
    names = F.array(F.lit(UNKNOWN), *[F.lit(f) for f in families])
    held_out = (F.col("family") == UNKNOWN) & _is_held_out(F.col("_grams"))
    known = _featurised(known).select((F.array_position(names, F.col("family")) - 1).cast("double").alias("label"), F.col("_features").alias("_every"), held_out.alias("held_out"))
    places = sorted({int(i) for r in known.select("_every").collect() for i in r[0].indices})
    known = VectorSlicer(inputCol="_every", outputCol="_features", indices=places).transform(known).coalesce(1)
    lines = _learnable(docs, places, id_col, text_col)
    total = lines.count()
    weight = min(1.0, WEIGHT / max(1, total))
    rows = known.select("label", "_features", "held_out", F.lit(1.0).alias("weight")).unionByName(lines.select(F.lit(0.0).alias("label"), "_features", "held_out", F.lit(weight).alias("weight"))).coalesce(1 + total // ROWS)
    learner = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction", family="multinomial", regParam=1e-3, maxIter=60, standardization=False)
    model = learner.fit(rows.filter("not held_out"))
    best = F.array_max(F.slice(vector_to_array("_probability"), 2, len(families)))
    threshold = _calibrated(model.transform(rows.filter("held_out")).select(best.alias("_best")))
    every = np.zeros((len(families) + 1, 1 << BITS))
    every[:, places] = model.coefficientMatrix.toArray()
    model = _model(spark, every, model.interceptVector.toArray()).setFeaturesCol("_features").setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction")
    return Scanner(model, families, threshold)


def _apart(hits: Column) -> Column:
    """Of hits, best first, each that shares no matched words with a better one, nor line and family."""
    clash = lambda x, y: ((x["first"] <= y["last"]) & (y["first"] <= x["last"])) | ((x["paragraph"] == y["paragraph"]) & (x["family"] == y["family"]))
    return F.aggregate(hits, F.slice(hits, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: clash(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice of a known family: id, ``paragraph`` (number from 0 of the line where it begins), ``family``, ``probability``,
    ``similarity`` (share of the best template's bigrams that it holds), ``confirmed`` and ``line`` (or the window's words)."""
    judged = _units(scanner.possible(_spans(_laid_out(docs, id_col, text_col))))
    hits = scanner.known(judged)
    grams = F.create_map(*[x for f, texts in _template_grams().items() for x in (F.lit(f), F.array(*[F.array(*[F.lit(g) for g in t]) for t in texts]))])
    shared = F.array_max(F.transform(F.element_at(grams, F.col("family")), lambda t: F.size(F.array_intersect(t, F.col("_grams"))) / F.size(t)))
    hits = hits.withColumn("similarity", shared).withColumn("confirmed", F.col("similarity") >= CONFIRMED)
    # words of a hit that stand in its family's templates; without any, all of them
    own = F.flatten(F.element_at(grams, F.col("family")))
    two = F.transform(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.when(F.array_contains(own, F.concat_ws(" ", F.get(F.col("_words"), i), F.get(F.col("_words"), i + 1))), i))
    hits = hits.withColumn("_at", F.array_compact(two))
    low, high = F.coalesce(F.array_min("_at"), F.lit(0)), F.coalesce(F.array_max("_at") + 1, F.size("_words") - 1)
    high = F.least(high, F.size("_words") - 1)
    spot = lambda i: F.get(F.col("_lines"), i)
    hit = F.struct(
        (~F.col("confirmed")).alias("open"), F.col("_window").alias("window"), (-F.col("similarity")).alias("less"), (-F.col("probability")).alias("odds"),
        F.col("_begin").alias("begin"), spot(low).alias("paragraph"), F.col("family"), (F.col("_begin") + low).alias("first"), (F.col("_begin") + high).alias("last"), F.coalesce("_line", F.array_join("_words", " ")).alias("line"),
    )
    best = hits.groupBy("_row", F.col("_id")).agg(F.array_sort(F.collect_list(hit)).alias("_h"))
    out = best.select("_id", F.explode(_apart(F.col("_h"))).alias("h"))
    return out.select(F.col("_id").alias(id_col), F.col("h.paragraph").cast("int").alias("paragraph"), "h.family", (-F.col("h.odds")).alias("probability"), (-F.col("h.less")).alias("similarity"), (~F.col("h.open")).alias("confirmed"), "h.line")
