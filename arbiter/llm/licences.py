"""Licence scan: a trained paragraph classifier over sparse word n-grams. DataFrame functions only.

1. Training rows are the statements below: wordings of each licence family, and unknown-class
   sentences that talk about rights without granting a known licence. The later wordings of a
   family and every second unknown sentence are held out for calibration.
2. Features are word pairs and triples of the training wordings that hold a word outside everyday
   speech; a multinomial logistic regression (Spark ML) weighs them: a sparse table
   (n-gram, family, weight) of bounded size.
3. Every paragraph (line, without its comment mark) of every document is read, and so is every
   passage that runs over line breaks: the words of the text, an empty line as a word of its own, are
   cut into windows of 16, 32, ... words that overlap by half. A statement of n words lies whole in one
   of the windows of at least 2 n words, wherever its lines break. A piece without any such word has
   no feature at all, so its class is unknown without further work; the n-grams of the others join
   the weights.
4. Calibration on the held-out wordings fits a temperature and the least probability at which no
   held-out unknown sentence is taken for a licence. Below it the answer is unknown.
5. A prediction is confirmed when the piece holds most word pairs of one template of the family
   (containment), so a high probability alone is not enough. A window counts for the templates of
   its length only, and where no line in it already states the family; overlapping windows of a
   family are one finding, at the line of its first telling word pair.

Defined results: null and empty texts have no paragraph with a licence; paragraphs are counted as
pieces between line feeds; ties between families go to the first by name; an empty table gives an
empty result; extra columns are ignored; rows of a repeated id each get the findings of all of them.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbiter.llm.common import staged

UNKNOWN = "unknown"
#: Share of a template's word pairs that confirms a prediction.
CONFIRM = 0.6
#: What comment lines begin with.
MARK = r"^\s*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--|>+|\||(?i:dnl|rem)(?=\s))\s*"

# Wordings of licence statements by family (SPDX names), and sentences of no family.
STATEMENTS = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
        "Distributed under the terms of the Apache License, Version 2.0.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under the Creative Commons Attribution License.",
        "Available under CC BY 4.0.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY-NC 4.0.",
        "Content is available under the Creative Commons Attribution-NonCommercial License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Available under CC BY-SA 4.0.",
    ],
    "CC0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "Dedicated to the public domain.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU General Public License, version 2.",
        "Licensed under the GNU GPL, version 3 or later.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Released under the GNU Lesser General Public License.",
        "Distributed under the GNU LGPL, version 2.1.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Licensed under the MIT License.",
        "This project is available under the terms of the MIT License.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
        "Distributed under the Mozilla Public License, version 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "No part of this work may be reproduced without written permission of the publisher.",
        "Copyright by the publisher. All rights reserved.",
        "Proprietary and confidential; unauthorized copying of this file is prohibited.",
    ],
    UNKNOWN: [
        "A license is needed to drive a car in this state.",
        "The software was released in the spring of last year.",
        "She obtained permission from the author of the book.",
        "The terms of the agreement are subject to change.",
        "He was licensed to practise law in three states.",
        "The general public was free to attend the session.",
        "Apache helicopters flew over the village at noon.",
        "Students of MIT published a new version of their work.",
        "Attribution of the painting remains under debate.",
        "The conditions of use are explained in the manual.",
        "The foundation published its software in source form.",
        "Copyright law protects works for many decades.",
        "The license plate was found under the bridge.",
        "Creative work is rarely done in common rooms.",
        "Version 3 of the document was sent to the public library.",
        "International rights to the film were sold last week.",
    ],
}
# Everyday words; an n-gram of these alone is no feature.
EVERYDAY = (
    "a all an and any are as at be by can car except file following for found free from has he in is it "
    "last law may new no not of on or over part person rarely she spring state that the their this three to use "
    "used was week were with without work works year you"
).split()


def _words(text):
    return F.filter(F.split(F.lower(text), r"[^a-z0-9+.\-]+|[.\-]+(?![a-z0-9])"), lambda w: w != "")


def _grams(words, n: int):
    """Distinct n-grams, joined by one space; fewer than n words give none."""
    last = F.size(words) - n
    every = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.array_distinct(F.when(last >= 0, every).otherwise(F.array().cast("array<string>")))


def _level(n: int) -> int:
    """Words of the windows that look for a template of n words."""
    return 1 << max(4, (2 * n - 1).bit_length())


def _pieces(text, levels: list[int]):
    """Lines (level 0) and windows over line breaks: (level, start, words, line of each word)."""
    lines = F.transform(F.split(text, "\n"), lambda t: _words(F.regexp_replace(t, MARK, "")))

    # One-element arrays bind the words, so they are found once a text.
    def of_lines(lw):
        whole = F.transform(lw, lambda w, i: F.struct(
            F.lit(0).alias("level"), i.alias("start"), w.alias("words"), F.array(i).alias("at")))
        filled = F.transform(lw, lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(F.lit("\n"))))
        at = F.flatten(F.transform(filled, lambda w, i: F.array_repeat(i, F.size(w))))
        flat = F.struct(F.flatten(filled).alias("words"), at.alias("at"))
        return F.concat(whole, F.flatten(F.transform(F.array(flat), of_words)))

    def windows(d, n):
        starts = F.sequence(F.lit(0), F.size(d["words"]) - 1, F.lit(n // 2))
        return F.transform(starts, lambda i: F.struct(
            F.lit(n).alias("level"), i.alias("start"), F.slice(d["words"], i + 1, n).alias("words"), F.slice(d["at"], i + 1, n).alias("at")))

    def of_words(d):
        every = F.concat(*[windows(d, n) for n in levels])
        return F.filter(every, lambda x: F.element_at(x["at"], 1) < F.element_at(x["at"], -1))

    return F.flatten(F.transform(F.array(lines), of_lines))


def _training(spark: SparkSession) -> DataFrame:
    """(family, held_out, words) of the statements above."""
    rows = [
        {"family": f, "held_out": i % 2 == 1 and f == UNKNOWN or i >= 2 and f != UNKNOWN, "text": t}
        for f, texts in STATEMENTS.items()
        for i, t in enumerate(texts)
    ]
    schema = "array<struct<family string, held_out boolean, text string>>"
    one = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), schema)).alias("r"))
    return one.select("r.family", "r.held_out", _words(F.col("r.text")).alias("words"))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    one = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r"))
    return staged(one.select("r.*"), "model")


def _everyday(gram):
    return F.forall(F.split(gram, " "), lambda w: F.array_contains(F.array(*[F.lit(x) for x in EVERYDAY]), w))


def train(spark: SparkSession, l2: float = 0.002, steps: int = 200) -> dict:
    """Fit and calibrate: weights table, biases, temperature, threshold, telling words."""
    t = _training(spark)
    t = t.withColumn("grams", F.filter(F.concat(_grams(F.col("words"), 2), _grams(F.col("words"), 3)), lambda g: ~_everyday(g)))
    names = sorted(STATEMENTS)
    t = t.withColumn("label", (F.array_position(F.array(*[F.lit(n) for n in names]), F.col("family")) - 1).cast("double"))
    t = staged(t.coalesce(1), "training")
    counts = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=1 << 14).fit(t)
    x = counts.transform(t)
    regression = LogisticRegression(regParam=l2, maxIter=steps, family="multinomial")
    part = regression.fit(x.where("NOT held_out"))
    held = [(r.label, list(r.rawPrediction)) for r in part.transform(x.where("held_out")).select("label", "rawPrediction").collect()]
    temperature, threshold = calibrate(held, names.index(UNKNOWN))
    fit = regression.fit(x)  # calibrated on what the first fit had not seen; all wordings count in the end
    w = fit.coefficientMatrix.toArray()
    rows = [
        {"gram": g, "family": names[c], "weight": float(w[c, i])}
        for i, g in enumerate(counts.vocabulary) for c in range(len(names)) if abs(w[c, i]) > 1e-9
    ]
    words = sorted({p for g in counts.vocabulary for p in g.split(" ")} - set(EVERYDAY))
    return {
        "weights": _table(spark, rows, "gram string, family string, weight double"),
        "bias": dict(zip(names, map(float, fit.interceptVector))),
        "temperature": temperature, "threshold": threshold, "words": words,
    }


def _softmax(raw: list[float], temperature: float) -> list[float]:
    top = max(raw)
    e = [math.exp((z - top) / temperature) for z in raw]
    return [v / sum(e) for v in e]


def calibrate(held: list[tuple[float, list[float]]], unknown: int) -> tuple[float, float]:
    """Temperature of least held-out loss; threshold above every unknown sentence's family probability."""
    def loss(t):
        return -sum(math.log(max(1e-12, _softmax(raw, t)[int(y)])) for y, raw in held)

    temperature = min((2.0 ** (k / 4) for k in range(-12, 13)), key=loss)
    wrong = [max(p for c, p in enumerate(_softmax(raw, temperature)) if c != unknown) for y, raw in held if int(y) == unknown]
    return temperature, min(0.9, max([0.5, *wrong]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confirm: float = CONFIRM) -> DataFrame:
    """Findings: id, paragraph (0-based), family, probability, containment, confirmed."""
    spark = docs.sparkSession
    model = train(spark)
    told = F.array(*[F.lit(w) for w in model["words"]])
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    templates = _training(spark).where(F.col("family") != UNKNOWN).select(
        "family", _grams(F.col("words"), 2).alias("t"), F.size("words").alias("n"))
    levels = sorted({_level(r["n"]) for r in templates.select("n").collect()})
    level = F.create_map(*[F.lit(x) for r in range(1, levels[-1] // 2 + 1) for x in (r, _level(r))])
    templates = templates.select("family", "t", level[F.col("n")].alias("for_level"))
    # Numbered in a step of its own: beside the explode every piece would get another number.
    text = text.where(F.arrays_overlap(_words(F.col("text")), told)).withColumn("row", F.monotonically_increasing_id())
    pieces = text.select("id", "row", F.explode(_pieces(F.col("text"), levels)).alias("p")).select("id", "row", "p.*").where(F.arrays_overlap("words", told))
    pieces = staged(pieces, "pieces")
    key = ["id", "row", "level", "start"]
    both = F.concat(_grams(F.col("words"), 2), _grams(F.col("words"), 3))
    grams = pieces.select(*key, F.explode(both).alias("gram"))
    sums = grams.join(model["weights"], "gram").groupBy(*key, "family").agg(F.sum("weight").alias("z"))
    # A family without a matching n-gram has its bias only.
    names = F.array(*[F.lit(n) for n in sorted(model["bias"])])
    bias = F.create_map(*[x for n, b in model["bias"].items() for x in (F.lit(n), F.lit(b))])
    found = sums.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("family", "z")))).alias("z"))
    raw = F.transform(names, lambda n: F.struct(
        ((bias[n] + F.coalesce(F.col("z")[n], F.lit(0.0))) / model["temperature"]).alias("z"), n.alias("family")))
    top = F.array_max(F.transform("raw", lambda r: r["z"]))
    total = F.aggregate("raw", F.lit(0.0), lambda a, r: a + F.exp(r["z"] - F.col("top")))
    best = F.filter("raw", lambda r: r["z"] == F.col("top"))[0]["family"]
    found = found.withColumn("raw", raw).withColumn("top", top).select(
        *key, best.alias("family"), (F.lit(1.0) / total).alias("probability")
    ).where((F.col("family") != UNKNOWN) & (F.col("probability") >= model["threshold"]))
    both = found.join(pieces, key).withColumn("pairs", _grams(F.col("words"), 2))
    both = both.join(F.broadcast(templates), "family").where((F.col("level") == 0) | (F.col("level") == F.col("for_level")))
    inside = F.size(F.array_intersect("pairs", "t")) / F.greatest(F.size("t"), F.lit(1))
    # The line of the first telling word pair of the template.
    pair = F.transform(F.slice("words", 1, F.size("words") - 1), lambda w, i: F.concat_ws(" ", w, F.col("words")[i + 1]))
    telling = F.filter("t", lambda g: ~_everyday(g))
    begins = F.array_position(F.transform(pair, lambda g: F.array_contains(telling, g)), F.lit(True))
    line = F.when(F.col("level") == 0, F.col("start")).otherwise(F.col("at")[F.greatest(begins - 1, F.lit(0)).cast("int")])
    best = both.select(
        *key, "family", "probability", F.element_at("at", 1).alias("lo"), F.element_at("at", -1).alias("hi"),
        F.struct(inside.alias("containment"), (-line).alias("line")).alias("best"),
    ).groupBy(*key, "family", "probability", "lo", "hi").agg(F.max("best").alias("best"))
    best = staged(best.select(
        "id", "row", "level", "family", "probability", "lo", "hi",
        F.col("best.containment").alias("containment"), (-F.col("best.line")).alias("line"),
    ).where((F.col("level") == 0) | (F.col("containment") >= confirm)), "scanned")
    stated = best.where("level = 0")
    said = stated.where(F.col("containment") >= confirm).select("id", "row", "family", F.col("lo").alias("at"))
    over = best.where("level > 0").join(said, ["id", "row", "family"], "left").groupBy(*best.columns).agg(
        F.coalesce(F.max(F.col("at").between(F.col("lo"), F.col("hi"))), F.lit(False)).alias("said")
    ).where("NOT said")
    # Findings of one family in one text: windows that share a line are one.
    of = Window.partitionBy("id", "row", "family").orderBy("lo", "hi", "level")
    before = F.max("hi").over(of.rowsBetween(Window.unboundedPreceding, -1))
    over = over.withColumn("new", F.coalesce((F.col("lo") > before).cast("int"), F.lit(1)))
    over = over.withColumn("place", F.sum("new").over(of.rowsBetween(Window.unboundedPreceding, 0)))
    wrapped = over.groupBy("id", "row", "family", "place").agg(
        F.max(F.struct("containment", "probability", (-F.col("line")).alias("line"))).alias("b")
    ).select("id", (-F.col("b.line")).alias("paragraph"), "family", "b.probability", "b.containment")
    return stated.select("id", F.col("line").alias("paragraph"), "family", "probability", "containment").union(wrapped).select(
        "id", F.col("paragraph").cast("int").alias("paragraph"), "family", F.round("probability", 6).alias("probability"),
        F.round("containment", 6).alias("containment"), (F.col("containment") >= confirm).alias("confirmed"),
    )


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_paragraphs, n_licences, families (confirmed), paragraphs."""
    found = staged(scan(docs, id_col, text_col).where("confirmed"), "licences")
    per = found.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_licences"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.array_join(F.transform(F.array_sort(F.collect_set("paragraph")), lambda p: p.cast("string")), ",").alias("paragraphs"),
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("id"), (breaks + 1).cast("long").alias("n_paragraphs")).join(
        staged(per, "per-document"), "id", "left"
    ).select(
        "id", "n_paragraphs", F.coalesce("n_licences", F.lit(0)).cast("long").alias("n_licences"),
        F.coalesce("families", F.lit("")).alias("families"), F.coalesce("paragraphs", F.lit("")).alias("paragraphs"),
    )
