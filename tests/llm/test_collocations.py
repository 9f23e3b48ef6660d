import random
import re
from collections import Counter

import numpy as np
import pytest

from sitelens.llm import collocations as C


def brute(rows, least, longest, top, share=80):
    """The rows of the result, counted word by word."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        outer = [b for (m, q), b in found.items() if m == lang and len(q) > len(p)
                 and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= share * a for b in outer):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    result, place = [], Counter()
    for lang, score, a, p, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            result.append((lang, place[lang], p.decode(), -a, left, right, n[lang], -score))
    return result


def made(pick, count):
    words = ["a", "B", "b", "Ä", "ä", "c\xa0d", "e\x1cf", "x-y", "9"]
    rows = []
    for _ in range(count):
        text = "".join(pick.choice(words) + pick.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "?!"])
                       for _ in range(pick.randrange(60)))
        rows.append((pick.choice(["en", "en", "de", None, "und"]), text))
    return rows


@pytest.mark.parametrize("least,longest,top,bits", [(3, 4, 2000, 64), (2, 3, 5, 64), (4, 5, 3, 10), (1, 2, 50, 64)])
def test_small_tables_against_counting(spark, least, longest, top, bits):
    rows = made(random.Random(least), 120) + [("en", None), ("en", ""), (None, " .,\n"), ("de", "a b c d e " * 30)]
    rows += [("en", "one hot phrase here. ") for _ in range(60)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "lang string, text string, words string, pos int").repartition(5)
    words, frequent = C.mined(docs, least, longest, bits)
    got = C.ranked(words, C.scored(frequent), top).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, least, longest, top))


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = C.op12_phrase_collocations(spark, sf)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows, 30, 4, 2000))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(docs).count() == 0
    docs = spark.createDataFrame([("en", None), (None, ""), ("en", "alone")], "lang string, text string")
    assert C.collocations(docs, 1).count() == 0


def test_scores_beyond_64_bits(spark):
    n = 3 * 10**18
    one = spark.createDataFrame([(1, n), (2, n + 5)], "w1 long, n long")
    two = spark.createDataFrame([(1, 2, n - 7)], "w1 long, w2 long, n long")
    assert C.scored([one, two]).first().score == 2000000 * (n - 7) // (n + n + 5)


def test_grouping_keeps_keys_apart_that_mix_alike(monkeypatch):
    monkeypatch.setattr(C, "mixed", lambda columns: np.zeros(len(columns[0]), np.uint64))
    a, b = np.array([1, 2, 1, 1]), np.array([5, 5, 5, 6])
    once = C.grouped_keys([([a, b], None)])
    for keys, n, times in ((*once, 1), (*C.grouped_keys([once, ([a, b], None)]), 2)):
        total = Counter()
        for x, y, c in zip(*keys, n):
            total[x, y] += c
        assert total == {(1, 5): 2 * times, (2, 5): times, (1, 6): times}
    assert C.grouped_keys([([a[:0], b[:0]], None)])[1].tolist() == []


def test_only_phrases_of_frequent_hashes_are_counted(spark):
    often, rows = [1, 2, 3, 4], [list(range(100 + 5 * i, 105 + 5 * i)) for i in range(2_000)]
    words = [[*often, 0, *row, 0] for row in rows[:7]] + [[*row, 0] for row in rows[7:]]
    pos = [[i for i, _ in enumerate(w) if 0 not in w[i:i + 3] and i + 3 <= len(w)] for w in words]
    relation = spark.createDataFrame(list(zip(words, pos)), C.RELATION).repartition(3)
    for least, want in ((7, {(1, 2, 3, 4): 7}), (1, Counter(t for w in words for t in zip(w, w[1:], w[2:], w[3:]) if 0 not in t))):
        told = C.frequent_hashes(relation, 4, least)
        got = {tuple(r)[:4]: r.n for r in C.counted(relation, 4, told).collect()}
        assert want.items() <= got.items() and len(got) - len(want) <= 2 * len(rows) // 20 * (least > 1)
