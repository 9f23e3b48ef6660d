import math
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sitelens.llm import toxicity as T


def plain(scores):
    """All maximal scoring segments by definition: the best one, then the same
    to its left and right."""
    def go(a, b):
        sums = [(sum(scores[i:j]), -(j - i), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
        best = max(sums, default=(0,))
        if best[0] <= 0:
            return []
        i, j = -best[2], best[3]
        return [*go(a, i), (i, j, best[0]), *go(j, b)]
    return go(0, len(scores))


@settings(max_examples=1_000, deadline=None)
@given(st.lists(st.sampled_from([-7, -3, -2, -1, 1, 2, 3, 5, 0.5]), max_size=14))
def test_segments_equal_the_definition(scores):
    got, want = T.segments(np.array(scores, float)), plain(scores)
    # ties may be cut differently; the sums of the segments are the same
    assert math.isclose(sum(s for _, _, s in got), sum(s for _, _, s in want))
    assert all(math.isclose(sum(scores[a:b]), s) and s > 0 for a, b, s in got)
    if len(set(np.cumsum([0, *scores]).tolist())) == len(scores) + 1:
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_segments_are_linear():
    scores = np.tile([1.0, -0.5, -0.6], 200_000)
    assert len(T.segments(scores)) == 200_000
    assert len(T.segments(np.tile([1.0, -0.5], 200_000))) == 1


def test_scores_without_equal_a_model_without_the_text():
    texts = [("you idiot idiots here", 1), ("fine weather here", 0), ("idiot weather", 1), ("here you go fine", 0)] * 3

    def model(rows):
        counts, y = {}, [0, 0]
        for text, toxic in rows:
            for w in set(T.tokens(text)):
                y[toxic] += 1
                for p in T.path(w):
                    a = counts.setdefault(p, [0, 0])
                    a[1 - toxic] += 1
        return T.Model({k: tuple(v) for k, v in counts.items()}, y[1], y[0])

    full, rest = model(texts), model(texts[1:])
    words = T.tokens(texts[0][0])
    rest.drift = 0.0
    assert np.allclose(full.scores_without(words, 1), rest.scores(words))


def test_held_out_quality_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in T.op3_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(got) == docs
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    hit = sum(p and y for p, y in held)
    assert hit / sum(p for p, _ in held) > 0.95 and hit / sum(y for _, y in held) > 0.9


def corpus(spark):
    words = "the weather was fine and they went home to eat some warm bread with butter".split()
    rows = [(i, " ".join(words[(i + k) % 14] for k in range(30)) + (" awfulword nastything" if i % 5 == 0 else ""), "x", i)
            for i in range(300)]
    rows += [(None, "awfulword nastything", "x", 1), (1000, None, "x", 1), (1001, "", "x", 1), (1002, "12 34 !", "x", 1),
             (1003, "awfulword " * 2_000, "x", 1), (1003, "awfulword " * 2_000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted long")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(3, None), (None, 1), (10, 0)],
                                   "doc_id long, toxic int")
    return docs, labels


def test_stage_drops_toxic_rows_and_keeps_the_others(spark):
    docs, labels = corpus(spark)
    left = T.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i in range(300) if i % 5] + [1000, 1001, 1002]


def test_passages_are_spans_of_the_text(spark):
    docs, labels = corpus(spark)
    found = T.scored(docs.select("doc_id", "text").where("doc_id = 5"), T.learnt(docs, labels)).first()
    assert [found.text[p.start:p.end] for p in found.passages] == ["awfulword nastything"]


def test_no_labels_one_class_and_empty_tables(spark):
    docs, labels = corpus(spark)
    none = T.scored(docs.select("doc_id", "text"), T.learnt(docs, labels.limit(0)))
    assert {round(r.score, 6) for r in none.collect()} == {0.0}
    one = T.scored(docs.select("doc_id", "text"), T.learnt(docs, labels.where("toxic = 0 and doc_id is not null")))
    assert {r.predicted for r in one.collect()} == {0}
    assert T.drop_toxic(docs.limit(0), labels).count() == 0


def test_every_repeated_prefix_is_learnt(spark):
    """More clean nodes than any former bound: none of them is left out."""
    texts = [" ".join(f"{a}{b}{c}{d}zz" for c in "abcdefghijklmnopqrst" for d in "abcdefghijklmnopqrst")
             for a in "abcdefghijklmnopq" for b in "abcdefghijklmnopqrst"]
    rows = [(2 * i + j, t + f" extra{chr(97 + j)}") for i, t in enumerate(texts) for j in range(2)]
    docs = spark.createDataFrame(rows + [(9_999, "awful nasty")], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    model = T.learnt(docs, labels)
    counts = {}
    toxic_of = {r.text: r.toxic for r in T.sample(docs, labels, T.SAMPLE).collect()}
    for text, y in toxic_of.items():
        for node in (p for w in set(T.tokens(text)) for p in T.path(w)):
            counts.setdefault(node, [0, 0])[1 - y] += 1
    counts = {p: c for p, c in counts.items() if sum(c) >= T.LEAST}
    assert len(counts) > 100_000 and len(model.keys) == len(counts)
    at = np.searchsorted(model.keys, [T.key(p) for p in counts])
    assert (model.keys[at] == [T.key(p) for p in counts]).all()
    assert model.y[at].tolist() == [y for y, _ in counts.values()]
    assert model.n[at].tolist() == [y + c for y, c in counts.values()]
