import random
import re
import time
import zlib
from collections import Counter

import pytest

from sitelens.llm import spelling as S


def brute_words(rows):
    """Counts of the words of (doc_id, text) rows, straight from the rule."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = "".join(c for k, c in enumerate(run) if k != h % len(run))
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n):
    """word -> (n, n_near, form, form_n, root) by comparing all pairs."""
    near = {w: [x for x in n if distance_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def found(rows):
    rows = rows.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_variants(brute_words(rows))
    out = S.op13_spelling_variants(spark, sf)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found(out) == want and len(want) > 100


@pytest.mark.parametrize("how", [{}, {"qmax": 6, "frequent": 10**9, "size": 1}, {"frequent": 3, "qmax": 5}])
def test_random_words_against_all_pairs(spark, how):
    pick = random.Random(str(how))
    n = {}
    while len(n) < 400:
        w = "".join(pick.choice("abé") for _ in range(pick.randrange(7, 10)))
        n[w] = pick.choice([2, 3, 30, 400])
    words = spark.createDataFrame(list(n.items()), "word string, n bigint").repartition(3)
    assert found(S.grouped(words, **how)) == brute_variants(n)


def test_long_chain_of_forms(spark):
    """Each form is ten times as frequent as the word before: one root for all."""
    words = ["abcdefghij"[:i] + "z" * (10 - i) for i in range(10)]
    n = {w: 2 * 10**i for i, w in enumerate(words)}
    out = found(S.grouped(spark.createDataFrame(list(n.items()), "word string, n bigint")))
    assert out == brute_variants(n) and {r[-1] for r in out.values()} == {words[-1]}


def test_awkward_rows(spark):
    long_word = "a" * 5_000
    rows = [(1, "Letters letters, LETTERS lettters lettters"), (1, "Letters letters, LETTERS lettters lettters"),
            (None, "letters letters"), (2, None), (3, ""), (4, " ".join(["letters"] * 40)), (5, long_word + " " + long_word),
            (6, "É" + "tranger" + " étranger Étranger étranger"), (7, "x1234567 ab"), (31, "wonderful wonderfull " * 3)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert found(S.spelling_variants(docs)) == brute_variants(brute_words(rows))
    assert S.spelling_variants(docs.limit(0)).count() == 0
    assert S.spelling_variants(docs.where("doc_id = 3")).count() == 0


def test_bound_holds_for_every_edit():
    """Near words share at least all grams but the bound, for any dictionary."""
    pick = random.Random(3)
    words = {"".join(pick.choice("abc") for _ in range(pick.randrange(7, 11))) for _ in range(150)}
    counts = Counter(w[p:p + q] for w in words for q in (2, 3, 4) for p in range(len(w) - q + 1))
    grams = {g: (c, len(g) < 4 and c > 40) for g, c in counts.items()}
    grams = {g: v for g, v in grams.items() if len(g) == 2 or counts[g[:-1]] > 40}
    parts = {w: S.decompose(w, grams) for w in words}
    pairs = [(a, b) for a in words for b in words if a < b and distance_one(a, b)]
    assert pairs
    for a, b in pairs:
        both = Counter(g for _, g, _, _ in parts[a]) & Counter(g for _, g, _, _ in parts[b])
        for w in (a, b):
            assert sum(both.values()) >= len(parts[w]) - S.affected_bound(parts[w], len(w))
        (ca, ga), (cb, gb) = S.signatures(a, parts[a]), S.signatures(b, parts[b])
        assert ca & cb if len(a) == len(b) else (ca & gb if len(a) > len(b) else ga & cb)


def test_linear_in_long_texts():
    began = time.time()
    assert sum(S.lossy_words(1, "somewhat Lengthy words, " * 200_000).values()) == 400_000
    assert time.time() - began < 5
