import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from sitelens.llm import licenses as L
from tests.llm.test_pipeline import words

SF = "/root/testdata/sf0.01"
KEYS = {"MIT": "released under the mit license", "Apache-2.0": "licensed under the apache license version 2 0",
        "GPL-3.0": "this work is licensed under the gnu general public license version 3", "CC-BY-NC": "licensed under cc by nc 4 0"}


def test_query_finds_every_known_sentence_of_the_whole_table(spark):
    got = {r.doc_id: r for r in L.op5_license_scan(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        lines = [" ".join(words(x)) for x in (d.text or "").split("\n")]
        want = sorted(f for f, key in KEYS.items() if any(re.search(rf"\b{key}\b", x) for x in lines))
        assert got[d.doc_id].families.split(",") == (want or [""]), d.doc_id
        assert got[d.doc_id].n_confirmed <= got[d.doc_id].n_predicted


def test_families_unknowns_and_awkward_rows(spark):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    rows = [(10_000 + i, f"Some words first\n{t}\nand after") for i, t in enumerate(t for ts in L.TEMPLATES.values() for t in ts)]
    families = [f for f, ts in L.TEMPLATES.items() for _ in ts]
    odd = [(20_000, None), (20_001, ""), (20_001, ""), (None, "Released under the MIT License."), (20_002, "licensed " * 3_000),
           (20_003, "THIS WORK is licensed; under the GNU General Public License -- version 3!"),
           (20_004, "The public was licensed to use the version under the software of a general")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in base + rows + odd], "doc_id long, text string, family string")
    got = {}
    for r in L.scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for (i, _), f in zip(rows, families):
        assert f in {r.family for r in got[i] if r.confirmed}, (i, f)
    assert [r.place for r in got[20_000]] == [None] and [r.place for r in got[20_001]] == [None, None]
    assert [(r.family, r.confirmed) for r in got[None]] == [("MIT", True)]
    assert [(r.family, r.confirmed) for r in got[20_003]] == [("GPL-3.0", True)]
    assert not any(r.confirmed for r in got[20_002] + got[20_004])
    assert L.scan(docs.limit(0)).count() == 0


def test_wrapped_and_commented_notices_are_confirmed(spark):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    before = "int main is a plain function that returns nothing of use to any other part of the program".split()
    cases, families = [], []
    for f, ts in L.TEMPLATES.items():
        for t in ts:
            for mark, end in (("", "\n"), ("# ", "\n"), (" * ", "\r\n"), ("REM ", "\n")):
                ws = t.split()
                width = max(1, min(9, len(ws) // 2))
                body = end.join(mark + " ".join(ws[i:i + width]) for i in range(0, len(ws), width))
                cases.append(f"some code{end}{mark}{end}{body}{end}{mark}{end}more code")
                families.append(f)
            cases.append(" ".join(before * 20 + [t] + before * 20))  # one long line
            families.append(f)
            cases.append("\n".join([*(" ".join(before) for _ in range(9)), *textwrap.wrap(t, 40), *(" ".join(before) for _ in range(9))]))
            families.append(f)
    odd = ["This work is licensed under the GNU General Public License, version\n3.", "Released under the\n\nMIT License.",
           "Released under\nthe MIT License.\nLicensed under the\nBSD 3-Clause License."]
    docs = spark.createDataFrame(base + [(10_000 + i, t) for i, t in enumerate(cases + odd)], "doc_id long, text string")
    got = {}
    for r in L.scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    sure = [sorted(r.family for r in got[10_000 + i] if r.confirmed) for i in range(len(cases + odd))]
    missed = [(c, f, x) for c, f, x in zip(cases, families, sure) if x != [f]]
    assert not missed, (len(missed), len(cases), missed[:5])
    assert sure[-3:] == [["GPL-3.0"], [], ["BSD-3-Clause", "MIT"]]


def test_needed_words_are_in_every_confirmed_paragraph():
    keys = set(L.needed())
    assert min(map(len, keys)) >= 7  # none that any text has
    for t in (t for ts in L.TEMPLATES.values() for t in ts):
        assert keys & set(words(t)), t
        assert len(words(t)) + 6 <= max(w - step for w, step in L.WINDOWS)


LGPL = ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
NOTICES = [
    (LGPL.format("2.1"), "LGPL-2.1"), (LGPL.format("3"), "LGPL-3.0"), (LGPL.replace("Lesser ", "").format("2"), "GPL-2.0"),
    (LGPL.replace("Lesser ", "").format("3"), "GPL-3.0"), (LGPL.replace("Lesser", "Affero").format("3"), "AGPL-3.0"),
    ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"), ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
     "damages arising from the use of this software.", "Zlib"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
     "available at https://www.eclipse.org/legal/epl-2.0", "EPL-2.0"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
     "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "Apache-2.0"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "MIT"),
    ("Distributed under the Apache 2.0 license", "Apache-2.0"),
]
#: Not to be confirmed as any version or family.
UNSURE = ["it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version",
          "Licensed under CC BY 2.0.", "This work is licensed under the GNU General Public License, version 4."]
#: Sentences that are neither templates nor learnt ones: not all are found, none as another family.
SAID = {"You can use this code according to the Apache License 2.0 conditions.": "Apache-2.0",
        "The library is published under the MIT license, see the file.": "MIT", "We chose the Mozilla Public License 2.0 for it.": "MPL-2.0",
        "Copying is allowed by the LGPL version 2.1 or later.": "LGPL-2.1"}


def test_versions_and_families_wrapped_and_on_one_line(spark):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    cases = [t for t, _ in NOTICES] + ["\n".join(textwrap.wrap(t, 60)) for t, _ in NOTICES] + UNSURE + list(SAID)
    docs = spark.createDataFrame(base + [(10_000 + i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {}
    for r in L.scan(docs).where("doc_id >= 10000").collect():
        got.setdefault(r.doc_id - 10_000, []).append(r)
    sure = [sorted({r.family for r in got[i] if r.confirmed}) for i in range(len(cases))]
    n = len(NOTICES)
    for i, (t, f) in enumerate(NOTICES * 2):
        assert sure[i] == [f] or sure[i] == [] and i >= n, (i, t, f, sure[i])
    assert sum(x == [f] for x, (_, f) in zip(sure[n:2 * n], NOTICES)) >= n - 1
    assert sure[2 * n:2 * n + len(UNSURE)] == [[]] * len(UNSURE), sure[2 * n:]
    said = [{r.family for r in got[2 * n + len(UNSURE) + i]} for i in range(len(SAID))]
    assert all(x <= {f, None} for x, f in zip(said, SAID.values())) and any(f in x for x, f in zip(said, SAID.values())), said


def test_template_parts_against_plain_comparison(spark):
    pick = random.Random(3)
    ts = [(f, words(t)) for f, x in L.TEMPLATES.items() for t in x]
    cases = []
    for _ in range(150):
        ws = list(pick.choice(ts)[1])
        if pick.random() < 0.7:
            a = pick.randrange(len(ws))
            ws[a:a + pick.randrange(3)] = pick.choices(["version", "2", "3", "license", "odd"], k=pick.randrange(3))
        cases.append(ws + pick.choice(ts)[1][:pick.randrange(9)])

    def runs(ws):
        return {tuple(ws[i:i + 5]) for i in range(max(len(ws) - 5, 0) + 1)}

    near, owned = L.rivals(), {f: set().union(*(runs(ws) for g, ws in ts if g == f)) for f in L.TEMPLATES}
    want = {}
    for i, case in enumerate(cases):
        for f, ws in ts:
            if len(ws) < 5:
                part = sure = float(any(case[k:k + len(ws)] == ws for k in range(len(case))))
            else:
                hit = runs(ws) & runs(case)
                part = len(hit) / len(runs(ws))
                sure = part * all(hit - owned[g] for g in near[f])
            best = want.setdefault((i, f), [0.0, 0.0])
            best[0], best[1] = max(best[0], part), max(best[1], sure)
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, ws array<string>")
    got = {(r.id, r.family): [r.part, r.sure or 0.0] for r in L.contained(frame, L.templates(spark)).collect()}
    assert {k: [pytest.approx(x) for x in v] for k, v in want.items() if v[0]} == got


def test_learning_counts_every_line_of_the_corpus(spark):
    docs = [(i, f"line {i} of a document\n\nan equal line of the software\nLicensed under CC BY 4.0.") for i in range(1_500)]
    rows = spark.createDataFrame(docs, "row_id long, text string").withColumn("doc_id", F.col("row_id"))
    found = L.evidence(L.marked(rows), L.templates(spark)).groupBy("family").agg(F.sum("n").alias("n")).collect()
    assert {r.family: r.n for r in found} == {"unknown": 3_000, "CC-BY": 1_500}
    one = L.marked(rows.limit(1)).orderBy("place").collect()
    assert [r.id is None for r in one] == [False, True, False, False]
    assert [r.beside for r in one[:2]] == [["0", "of", "a"], []] and one[0].keyed is None and "licensed" in one[3].keyed


def test_texts_and_their_words_are_not_shuffled(spark, monkeypatch):
    plans = {}

    def stored(df, name, real=L.stored):
        plans[name] = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return real(df, name)

    monkeypatch.setattr(L, "stored", stored)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more told lines than a broadcast holds
    try:
        docs = [(i, f"line {i} of a document\nReleased under the MIT License.") for i in range(300)]
        found = L.scan(spark.createDataFrame(docs, "doc_id long, text string")).where("confirmed").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.doc_id, r.place, r.family) for r in found) == [(i, 1, "MIT") for i in range(300)]
    moved = [m for plan in plans.values() for m in re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)]
    assert moved and not any(re.search(r"\btext#", m) for m in moved), moved
    assert "Exchange" not in plans["predicted"]


def test_features_are_those_of_all_words_and_pairs(spark):
    vocabulary = L.vocabulary()
    cases = [words(t) for ts in L.TEMPLATES.values() for t in ts] + [[], ["the"], ["of", "odd", "of"], ["the", "the", "the"], ["gnu", "", "general"]]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, ws array<string>")
    got = {r.id: set(map(int, r.features.indices)) for r in L.features(frame).collect()}
    grams = [{*c, *map(" ".join, zip(c, c[1:]))} for c in cases]
    assert got == {i: {k for k, w in enumerate(vocabulary) if w in g} for i, g in enumerate(grams)}
