"""Operator 5, licence scan by a trained paragraph classifier. DataFrame functions
and Spark ML only.

Every line of every text is a paragraph of its own, and so is every run of lines
with words (a notice that is wrapped; the words rem and dnl at a line's head are
comment marks), see ``wrapped``. Of a paragraph's words (A-Z lowered, runs of ASCII
letters, digits and everything beyond ASCII) and word pairs, those that any licence
sentence below has (``vocabulary``) make a sparse vector, and a multinomial logistic
regression gives the probability of each licence family and of ``unknown``. A family
is predicted where the probability of ``unknown`` leaves at least the calibrated
room: more than all but one in ``FALSE`` of the held-back unknown lines have, at
least 0.3, and no more than even odds (licences that are no template are held back as
unknown, too). A
prediction is confirmed if a template of that family has 0.8 of its five-word
shingles in the paragraph (a shorter template: its whole word sequence), among them
for each similar family one that its templates lack, and no similar template of
another family as much, unless it has all (a sentence that is cut before ``version 3`` is not yet of
a family, and one that goes on ``version 2.1`` is of that version's). A line gives a
row for each confirmed family, or else one for its prediction.

Runs of several lines and lines longer than ``LONG`` words are also read in
overlapping windows of the sizes in ``WINDOWS``, so that any template lies whole
in a window not much longer than itself. Only windows with a word that a template
can't lack are read (``needed``): no other one can be confirmed. A run gives a row
for each family confirmed in its windows but in no line of it; without any
confirmed family, one for its likeliest prediction, if no line has one.

Learning uses the templates, the licences' names in usual sentences (``FRAMES``),
and every line of the corpus that isn't held back (a third is, by hash): as unknown,
or as the family whose template it holds; and the templates put before and after the
beginnings of the unknown ones. Lines with the same vector are one learning row with
their count; all counts together weigh as much as ``LINES`` lines at most.

Defined cases: null and empty texts have one empty paragraph, which is unknown
like any without words; repeated rows are each scanned; ties between families
go to the first in ``FAMILIES``; an empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm.common import packed, stored, table
from sitelens.llm.decontaminate import words

LINES, FALSE, SHINGLE, CONTAINED = 4_000, 1_000, 5, 0.8
BESIDE = 12  # words of a line put beside a template
TASK_ROWS = 50_000  # learning rows of a task, about
#: (words, step) of the windows: a template of up to words - step + 1 words lies whole in one of them.
WINDOWS, LONG = ((12, 6), (24, 12), (80, 40)), 24

#: Sentences of public licences and their usual notices.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Distributed under the Apache 2.0 license",
        "you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, "
        "non-exclusive, no-charge, royalty-free, irrevocable copyright license",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either "
        "version 3 of the License",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "0BSD": [
        "Released under the Zero-Clause BSD License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license",
    ],
    "Zlib": [
        "Released under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty.",
        "In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
        "granted",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Names by which notices call a licence.
NAMES = {
    "MIT": ["MIT license", "MIT"],
    "Apache-2.0": ["Apache 2.0", "Apache License 2.0", "Apache Software License version 2.0"],
    "GPL-3.0": ["GPL version 3", "GPLv3", "GNU GPL 3.0"],
    "GPL-2.0": ["GPL version 2", "GPLv2", "GNU GPL 2.0"],
    "LGPL-3.0": ["LGPL version 3", "LGPLv3", "GNU Lesser GPL 3.0"],
    "LGPL-2.1": ["LGPL version 2.1", "LGPLv2.1", "GNU Lesser GPL 2.1"],
    "AGPL-3.0": ["AGPL version 3", "AGPLv3", "GNU Affero GPL 3.0"],
    "BSD": ["BSD license", "BSD-style license"],
    "BSD-3-Clause": ["BSD 3-clause", "new BSD license", "three-clause BSD license"],
    "BSD-2-Clause": ["BSD 2-clause", "simplified BSD license", "two-clause BSD license"],
    "0BSD": ["0BSD", "zero-clause BSD license"],
    "MPL-2.0": ["MPL 2.0", "Mozilla Public License 2.0"],
    "EPL-2.0": ["EPL 2.0", "Eclipse Public License v2.0"],
    "BSL-1.0": ["Boost license 1.0", "Boost Software License 1.0"],
    "Zlib": ["zlib license", "zlib/libpng license"],
    "CC-BY": ["CC BY", "Creative Commons Attribution 4.0"],
    "CC-BY-SA": ["CC BY-SA", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-NC": ["CC BY-NC", "Creative Commons Attribution-NonCommercial 4.0"],
    "CC0": ["CC0", "Creative Commons Zero"],
    "ISC": ["ISC license", "ISC"],
    "Unlicense": ["Unlicense", "The Unlicense"],
}
#: Sentences that the names are put into, to learn from notices that are no template.
FRAMES = ("This project is available under the {}.", "Distributed under the terms of the {}.", "License: {}",
          "All source files are covered by the {} unless noted otherwise.", "SPDX-License-Identifier: {}")
FAMILIES = [*TEMPLATES, "unknown"]


def templates(spark: SparkSession) -> DataFrame:
    """(template, family, line, ws): a row for each template."""
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    entry = [F.struct(F.lit(i).alias("template"), F.lit(f).alias("family"), F.lit(t).alias("line"))
             for i, (f, t) in enumerate(rows)]
    return spark.range(1).select(F.explode(F.array(*entry)).alias("t")).select("t.*", words(F.col("t.line")).alias("ws"))


def lines(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, place, ws) of every line of (row_id, doc_id, text)."""
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return docs.select("row_id", "doc_id", F.posexplode(split).alias("place", "line")).select(
        "row_id", "doc_id", "place", words(F.col("line")).alias("ws"))


def needed() -> list[str]:
    """Words of which every confirmed paragraph has one: of each template a word
    whose lack takes more shingles away than may be missing."""
    chosen: list[str] = []
    for t in (t for ts in TEMPLATES.values() for t in ts):
        ws = re.findall("[a-z0-9]+", t.lower())
        runs = {tuple(ws[i:i + SHINGLE]) for i in range(max(len(ws) - SHINGLE, 0) + 1)}
        must = [w for w in ws if sum(w not in run for run in runs) < CONTAINED * len(runs)]
        if not set(must) & set(chosen):
            chosen.append(max(must, key=lambda w: (w.startswith("licen"), len(w), w)))
    return chosen


def wrapped(rows: DataFrame) -> DataFrame:
    """(row_id, doc_id, place, last, ws): the windows of each run of lines with
    words that is of several lines or long; place and last are its lines."""
    keys = needed()
    some = rows.where(F.col("text").rlike(f"(?i)(?:{'|'.join(keys)})"))
    split = F.split("text", "\n", -1)
    each = some.select("row_id", "doc_id", F.posexplode(split).alias("place", "line")).select(
        "row_id", "doc_id", "place", words(F.regexp_replace("line", r"(?i)^[^A-Za-z0-9]*(?:rem|dnl)(?=\s)", "")).alias("ws"))
    run = F.sum((F.size("ws") == 0).cast("int")).over(Window.partitionBy("row_id").orderBy("place"))
    runs = (each.withColumn("run", run).where(F.size("ws") > 0).groupBy("row_id", "doc_id", "run")
            .agg(F.array_sort(F.collect_list(F.struct("place", "ws"))).alias("lines"))
            .select("row_id", "doc_id", F.expr("lines[0].place").alias("place"), F.expr("element_at(lines, -1).place").alias("last"),
                    F.flatten("lines.ws").alias("all")))
    cut = [F.expr(f"transform(sequence(0, greatest(size(all) - {w - step} - 1, 0), {step}), i -> slice(all, i + 1, {w}))")
           for w, step in WINDOWS]
    long = runs.where((F.col("last") > F.col("place")) | (F.size("all") > LONG))
    return (long.select("row_id", "doc_id", "place", "last", F.explode(F.array_distinct(F.concat(*cut))).alias("ws"))
            .where(F.arrays_overlap("ws", F.array(*map(F.lit, keys)))))


def shingles(ws: str) -> Column:
    """Hashes of the distinct five-word runs, or of the whole shorter sequence."""
    return F.array_distinct(F.expr(
        f"transform(sequence(0, greatest(size({ws}) - {SHINGLE}, 0)), i -> xxhash64(array_join(slice({ws}, i + 1, {SHINGLE}), ' ')))"))


def contained(paragraphs: DataFrame, known: DataFrame) -> DataFrame:
    """(id, family, part, sure): for rows (id, ws) the largest part of a template of
    the family that they hold, where it is not 0, and the largest of those that tell
    it from each similar family, by a shingle that this one's templates lack (without
    its version number a sentence has none). ``known`` is the fixed table."""
    known = known.select("template", "family", "ws", shingles("ws").alias("s"), F.size("ws").alias("n"))
    short = known.where(F.col("n") < SHINGLE)
    longer = known.where(F.col("n") >= SHINGLE).select("template", "family", F.size("s").alias("of"), F.explode("s").alias("key"))
    number = F.create_map(*[x for i, f in enumerate(TEMPLATES) for x in (F.lit(f), F.lit(1 << i))])
    near = F.create_map(*[x for f, gs in rivals().items() for x in (F.lit(f), F.lit(sum(1 << list(TEMPLATES).index(g) for g in gs)))])
    # which families lack a shingle, a bit for each
    longer = longer.withColumn("beyond", F.bitwise_not(F.bit_or(number[F.col("family")].cast("bigint")).over(Window.partitionBy("key"))))
    have = paragraphs.where(F.size("ws") > 0)
    part = (have.select("id", F.explode(shingles("ws")).alias("key")).join(F.broadcast(longer), "key")
            .groupBy("id", "family", "template", "of").agg(F.count("*").alias("n"), F.bit_or("beyond").alias("beyond"))
            .withColumn("near", near[F.col("family")].cast("bigint"))
            .select("id", "family", (F.col("n") / F.col("of")).alias("part"),
                    F.when(F.col("beyond").bitwiseAND(F.col("near")) == F.col("near"), F.col("n") / F.col("of")).alias("sure")))
    whole = (have.select("id", "ws", F.explode("ws").alias("first"))
             .join(F.broadcast(short.select("family", F.col("ws").alias("all"), F.col("ws")[0].alias("first"))), "first")
             .where(F.expr("exists(sequence(1, size(ws)), i -> slice(ws, i, size(all)) = all)"))
             .select("id", "family", F.lit(1.0).alias("part"), F.lit(1.0).alias("sure")))
    return part.unionByName(whole).groupBy("id", "family").agg(F.max("part").alias("part"), F.max("sure").alias("sure"))


def vocabulary() -> list[str]:
    """The words and word pairs of the templates and of the names in their frames."""
    said = [t for ts in TEMPLATES.values() for t in ts] + [frame.format(name) for names in NAMES.values() for name in names for frame in FRAMES]
    found: dict[str, None] = {}
    for ws in (re.findall("[a-z0-9]+", t.lower()) for t in said):
        found.update(dict.fromkeys([*ws, *map(" ".join, zip(ws, ws[1:]))]))
    return list(found)


def features(rows: DataFrame) -> DataFrame:
    """Adds ``features``, the words and word pairs of ``ws`` that the vocabulary has."""
    single = [w for w in vocabulary() if " " not in w]
    known = rows.withColumn("known", F.transform("ws", lambda w: F.when(w.isin(single), w)))  # its pairs are of its words
    pairs = F.expr("zip_with(slice(known, 1, greatest(size(known) - 1, 0)), slice(known, 2, greatest(size(known) - 1, 0)), "
                   "(a, b) -> concat(a, ' ', b))")
    grams = known.withColumn("grams", F.array_compact(F.concat("known", pairs))).drop("known")
    model = CountVectorizerModel.from_vocabulary(vocabulary(), inputCol="grams", outputCol="features", binary=True)
    return model.transform(grams).drop("grams")


def marked(rows: DataFrame) -> DataFrame:
    """(row_id, doc_id, place, id, features, keyed, beside) of every line: id is its
    words' hash, null without words; keyed are its words if one of them is a
    ``needed`` one, beside those of its first ones that the vocabulary has."""
    single = [w for w in vocabulary() if " " not in w]
    head = F.array_distinct(F.filter(F.slice("ws", 1, BESIDE), lambda w: w.isin(single)))
    keyed = F.arrays_overlap("ws", F.array(*map(F.lit, needed())))
    return features(lines(rows)).select(
        "row_id", "doc_id", "place", F.when(F.size("ws") > 0, F.xxhash64("ws")).alias("id"), "features",
        F.when(keyed, F.col("ws")).alias("keyed"), F.when(~keyed, head).alias("beside"))


def evidence(found: DataFrame, known: DataFrame) -> DataFrame:
    """(features, family, held, n): all lines of ``marked`` with words, those with the
    same vector counted; family by template, else unknown; a third is held back."""
    counts = stored(found.where("id IS NOT NULL").groupBy("features", "keyed", (F.pmod("id", F.lit(3)) == 0).alias("held"))
                    .agg(F.count("*").alias("n")), "vectors").withColumn("id", F.xxhash64("keyed"))
    likely = counts.where("keyed IS NOT NULL").select("id", F.col("keyed").alias("ws")).dropDuplicates(["id"])
    best = contained(likely, known).where(F.col("sure") >= CONTAINED)
    best = best.groupBy("id").agg(F.max_by("family", F.struct("sure", "family")).alias("family"))
    family = F.when(F.col("keyed").isNotNull(), F.col("family"))  # the hash of no words is a number, too
    return counts.join(F.broadcast(best), "id", "left").select("features", F.coalesce(family, F.lit("unknown")).alias("family"), "held", "n")


def learnt(found: DataFrame):
    """(model, least room that a family needs) from all lines of ``marked``."""
    spark = found.sparkSession
    known = templates(spark)
    corpus = stored(evidence(found, known), "corpus")
    total = corpus.agg(F.sum("n")).first()[0] or 0
    share = (F.col("n") * F.lit(min(LINES, total) / max(total, 1))).alias("weight")
    template = F.pmod(F.xxhash64("id"), F.lit(sum(map(len, TEMPLATES.values())))).cast("int").alias("template")
    beside = found.where("id IS NOT NULL AND beside IS NOT NULL").where(F.pmod("id", F.lit(3)) != 0)
    beside = stored(beside.groupBy(template, "beside").agg(F.count("*").alias("n")), "beside")
    tasks = int((corpus.count() + 2 * beside.count()) // TASK_ROWS) + 1
    beside = beside.join(F.broadcast(known.select("template", "family", "ws")), "template")
    said = [F.struct(F.lit(f).alias("family"), F.lit(frame.format(name)).alias("line")) for f, names in NAMES.items()
            for name in names for frame in FRAMES]
    said = spark.range(1).select(F.explode(F.array(*said)).alias("s")).select("s.family", words(F.col("s.line")).alias("ws"))
    rows = (known.select("family", "ws", F.lit(20.0).alias("weight"))
            .unionByName(said.withColumn("weight", F.lit(5.0)))
            .unionByName(beside.select("family", F.concat("ws", "beside").alias("ws"), share))
            .unionByName(beside.select("family", F.concat("beside", "ws").alias("ws"), share))
            .unionByName(spark.range(1).select(F.lit("unknown").alias("family"), F.array().cast("array<string>").alias("ws"),
                                               F.lit(20.0).alias("weight"))))
    rows = features(rows).drop("ws").unionByName(corpus.where("not held").select("features", "family", share))
    label = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")) - 1
    rows = rows.groupBy("features", label.cast("double").alias("label")).agg(F.sum("weight").alias("weight"))
    rows = stored(rows, "learning").coalesce(tasks)
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-3, weightCol="weight").fit(rows)
    held = scored(corpus.where("held and family = 'unknown'"), model)
    held = held.groupBy(F.ceil(F.col("room") * 10_000).alias("room")).agg(F.sum("n").alias("n"))
    at = held.agg(F.percentile("room", 1 - 1 / FALSE, F.col("n"))).first()[0]
    return model, min(0.5, max(0.3, (at or 0.0) / 10_000))


def scored(rows: DataFrame, model) -> DataFrame:
    """Adds guess, the likeliest family, and room, 1 - P(unknown). The generator
    keeps Spark from classifying a line anew for each use of its result."""
    out = model.transform(rows if "features" in rows.columns else features(rows))
    out = out.select(*rows.columns, F.explode(F.array(vector_to_array("probability"))).alias("p"))
    families = F.slice("p", 1, len(FAMILIES) - 1)
    guess = F.element_at(F.array(*map(F.lit, FAMILIES[:-1])), F.array_position(families, F.array_max(families)).cast("int"))
    return out.withColumn("guess", guess).withColumn("room", 1 - F.element_at("p", len(FAMILIES))).drop("p")


def rivals() -> dict[str, list[str]]:
    """For each family the others with a template that shares a shingle with one of its own."""
    def runs(t):
        ws = re.findall("[a-z0-9]+", t.lower())
        return {tuple(ws[i:i + SHINGLE]) for i in range(max(len(ws) - SHINGLE, 0) + 1)}
    have = {f: set().union(*map(runs, ts)) for f, ts in TEMPLATES.items()}
    return {f: [g for g in have if g != f and have[f] & have[g]] for f in have}


def compared(told: DataFrame, every: bool = False) -> DataFrame:
    """Adds part and confirmed to rows with id, ws and guess; with ``every``, also
    rows for the other families that a template shows."""
    parts = contained(told.select("id", "ws"), templates(told.sparkSession)).withColumnRenamed("family", "guess")
    against = F.create_map(*[x for f, gs in rivals().items() for x in (F.lit(f), F.array(*map(F.lit, gs)).cast("array<string>"))])
    other = (parts.select("id", F.explode(against[F.col("guess")]).alias("guess"), "sure")
             .groupBy("id", "guess").agg(F.max("sure").alias("other")))
    told = told.drop("ws")
    if every:
        shown = told.select("id", "guess").unionByName(parts.where(F.col("sure") >= CONTAINED).select("id", "guess")).distinct()
        told = told.drop("guess").join(shown, "id")
    sure = (F.col("sure") >= CONTAINED) & ((F.col("sure") == 1) | F.col("other").isNull() | (F.col("other") < F.col("sure")))
    return (told.join(parts, ["id", "guess"], "left").join(other, ["id", "guess"], "left")
            .withColumn("confirmed", F.coalesce(sure, F.lit(False))).withColumn("part", F.coalesce("part", F.lit(0.0))).drop("sure", "other"))


def scan(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, place, family, room, part, confirmed): a row for every
    line for which a family is predicted, those of wrapped lines at their first
    line, and one with a null place for each document that has none."""
    rows = packed(docs.select("doc_id", "text")).drop("doc")
    model, least = learnt(stored(marked(rows).select("id", "features", "keyed", "beside"), "lines"))
    # the lines are read again, so that neither texts nor words are shuffled or kept, but for those that are told
    told = F.col("room") > least
    found = scored(lines(rows), model).where(told | (F.col("place") == 0)).select(
        "row_id", "doc_id", "place", F.when(told, F.col("ws")).alias("ws"), "guess", "room", told.alias("told"))
    found = stored(found, "predicted")
    told = found.where("told").select("row_id", "doc_id", "place", "ws", "guess", "room")
    told = compared(told.withColumn("id", F.struct("row_id", "place")), every=True)
    best = F.row_number().over(Window.partitionBy("row_id", "place").orderBy(F.desc("confirmed"), F.desc("part"), "guess"))
    told = told.withColumn("best", best).where("confirmed or best = 1")
    columns = ["row_id", "doc_id", "place", F.col("guess").alias("family"), "room", "part", "confirmed"]
    told = stored(told.select(columns), "told")

    pieces = scored(wrapped(rows), model).where(F.col("room") > least)
    pieces = stored(pieces.withColumn("id", F.monotonically_increasing_id()), "windows")
    runs = (compared(pieces, every=True).groupBy("row_id", "doc_id", "place", "last", "guess")
            .agg(F.max("room").alias("room"), F.max("part").alias("part"), F.max("confirmed").alias("confirmed")))
    rank = F.row_number().over(Window.partitionBy("row_id", "place").orderBy(F.desc("confirmed"), F.desc("room"), "guess"))
    runs = runs.withColumn("rank", rank).where("confirmed or rank = 1").alias("r")
    same = told.select("row_id", "place", "family", "confirmed").alias("t")
    covered = F.expr("r.row_id = t.row_id and t.place between r.place and r.last "
                     "and (not r.confirmed or (t.confirmed and t.family = r.guess))")
    told = told.unionByName(runs.join(same, covered, "left_anti").select(columns))

    empty = found.where("place = 0").select("row_id", "doc_id").join(told.select("row_id").distinct(), "row_id", "left_anti")
    none = empty.select("row_id", "doc_id", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("family"),
                        F.lit(None).cast("double").alias("room"), F.lit(None).cast("double").alias("part"), F.lit(False).alias("confirmed"))
    return told.unionByName(none)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_predicted, n_confirmed, families): of each document the lines
    and wrapped runs predicted, those confirmed, and the confirmed families."""
    found = scan(table(spark, sf_dir, "documents"))
    families = F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",")
    return found.groupBy("row_id", "doc_id").agg(
        F.count("place").alias("n_predicted"), F.count_if("confirmed").alias("n_confirmed"), families.alias("families")).drop("row_id")
