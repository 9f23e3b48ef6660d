import duckdb
import pytest
from pyspark.sql import functions as F

from sitelens.llm import decontaminate as C
from tests.llm.test_pipeline import words


def brute(docs, items, length=10):
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(length, len(b))
            grams = {tuple(b[k:k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in grams:
                    hit.update(range(k, k + n))
                    found.add("" if item is None else str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (2, LONG[:60]), (10, "the the the the the the the the the the the"), (3, "Élan VITAL été"), (4, ""), (5, None),
         (None, "nobody owns this line of words at all or ever will be"), (1, "a second row of item one with some more words in it")]
DOCS = [LONG, "x " + LONG + " y " + LONG, "the " * 30, "élan vital été", "Élan vital été", None, "", "...", " ".join(LONG.split()[3:14]),
        " ".join(LONG.split()[3:12]), "z. " + ", ".join(LONG.upper().split()) + ("; tail" * 20_000),
        "nobody owns this line of words at all or ever will be", "a second row of item one with some more words in it"]


@pytest.mark.parametrize("short", [None, "the", "one two"])
def test_equals_brute_force(spark, short):
    items = ITEMS + ([(7, short)] if short else [])
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(DOCS)], "row_id long, text string, ws int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.row_id: (r.n_words, r.n_hit, list(r["items"])) for r in C.judged(docs, bench).collect()}
    assert got == brute(enumerate(DOCS), items)


def test_blocks_of_windows_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "row_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(C, "BLOCK", 10)
    got = {r.row_id: (r.n_words, r.n_hit, list(r["items"])) for r in C.judged(docs, bench).collect()}
    assert got == brute(enumerate(DOCS), ITEMS)


def test_empty_tables_and_stage(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(DOCS)], "doc_id long, text string, window string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = C.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i, (_, hit, _) in brute(enumerate(DOCS), ITEMS).items() if not hit]
    assert C.decontaminate(docs.limit(0), bench).count() == 0
    assert C.decontaminate(docs, bench.limit(0)).count() == len(DOCS)


def test_words_of_odd_and_very_long_texts(spark):
    odd = ["".join(map(chr, range(256))), "\x00a\x00B\x7f", "  lead and trail  ", "\u2028Z\u00a0\U0001F600Ÿ-İß", "x\ny\r\nz\t", " ", "", None, "A" * 9, "$1 \\1 {2}"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, text string").select("i", C.words(F.col("text")).alias("ws"))
    assert {r.i: r.ws for r in got.collect()} == {i: words(t) for i, t in enumerate(odd)}
    assert spark.range(1).select(F.size(C.words(F.repeat(F.lit("word, "), 100_000)))).first()[0] == 100_000
