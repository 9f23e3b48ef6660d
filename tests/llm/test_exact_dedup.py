import hashlib
import random
import time

import numpy as np
import pytest

from sitelens.llm import exact_dedup as D


def by_text(rows):
    """doc_id -> (keep_id, size) by plain comparison."""
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    return {k: (max((i for i in v if i is not None), default=None), len(v)) for k, v in texts.items()}


def long_texts():
    pick = random.Random(1)
    base = " ".join(f"w{pick.randrange(5_000)}é" for _ in range(20_000))
    return [base, base + " ", "x" + base, base[:50_000] + "!" + base[50_000:], base, "a" * 100_000, "a" * 100_000, "a" * 99_999,
            "é" * 40_000, "short", "short", "", None, " "]


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_classes_whether_hashes_collide_or_not(spark, bits):
    rows = [(i if i != 9 else None, t) for i, t in enumerate(long_texts())]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, recipe long")
    chunked, found = D.dedup_rows(docs, bits)
    texts = {r.row_id: "".join(r.chunks) if r.chunks is not None else None for r in chunked.collect()}
    want, got = by_text(rows), found.collect()
    assert sorted(map(str, texts.values())) == sorted(str(t) for _, t in rows)  # chunks put together are the text
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size) == want[texts[r.row_id] or ""]
        assert r.text_sha256 == hashlib.sha256((texts[r.row_id] or "").encode()).hexdigest()
    assert sum(r.kept for r in got) == len(want)


def test_cuts_depend_on_the_text_only_and_follow_content():
    texts = [t.encode() for t in long_texts() if t]
    ends = {}
    for order in (texts, texts[::-1]):
        data = np.frombuffer(b"".join(order), np.uint8)
        offsets = np.cumsum([0, *map(len, order)])
        for t, a, e in zip(order, offsets, D.chunk_ends(data, offsets)):
            relative = [int(x - a) for x in e]
            assert ends.setdefault(t, relative) == relative
            pieces = [t[i:j] for i, j in zip([0, *relative], relative)]
            assert b"".join(pieces) == t and all(p.decode() for p in pieces)
            assert max(map(len, pieces)) <= D.MAX_BYTES + 3

    def chunks(t):
        return {t[i:j] for i, j in zip([0, *ends[t]], ends[t])}

    assert len(chunks(texts[0]) & chunks(texts[3])) > 0.8 * len(chunks(texts[0]))  # an edit changes a few chunks


def test_linear_in_long_texts():
    data = np.frombuffer(b"ab cd" * 2_000_000, np.uint8)
    began = time.time()
    D.chunk_ends(data, np.array([0, len(data)]))
    assert time.time() - began < 5


def test_stage_keeps_one_row_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "t", "a"), (1, "t", "a"), (0, "t", "b"), (None, "u", "c")],
                                 "doc_id long, text string, kept string")
    out = D.exact_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.where("doc_id = 1").limit(1).collect() + docs.where("text = 'u'").collect()))
    assert D.exact_dedup(docs.limit(0)).count() == 0
