import functools
import io
import os
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitelens.llm import token_files as T


def model():
    import public_tokenizers as P
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@functools.cache
def plain_tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(model())
    t.encode_special_tokens = True
    return t


def library(texts):
    """Ids of whole texts straight from the library, with the end id."""
    t = plain_tokenizer()
    return [e.ids + [1] for e in t.encode_batch(texts, add_special_tokens=False)]


def digests(rows):
    """(doc_id, start, n, crc) of (doc_id, ids) rows in the given order."""
    out, start = [], 0
    for i, ids in rows:
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = digests(zip([i for i, _ in rows], library([t for _, t in rows])))
    out = T.op11_token_files(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, out.collect())) == want


def test_many_small_files_hold_the_same(spark, tmp_path):
    rows = [(i % 40 if i % 7 else None, t) for i, t in enumerate(
        ["", None, "x", "İstanbul ΣΑΣ é ́a", "a\x1cb\x85c\xa0d e", "it's I'LL 1234 <|endoftext|> <|startoftext|>",
         "日本語のテキスト🙂🙂", "word " * 5_000, "y" * 30_000, "same", "same"] * 12)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, start string, n_tokens int").repartition(6)
    path = f"file://{tmp_path}/tokens"
    T.write_tokens(docs, path, file_bytes=40_000, block=100)
    assert len([f for f in os.listdir(tmp_path / "tokens/data") if f.endswith(".s8b")]) > 10
    (tmp_path / "tokens/data/part-000000-lost.s8b").write_bytes((tmp_path / "tokens/data" / sorted(
        f for f in os.listdir(tmp_path / "tokens/data") if f.endswith(".s8b"))[0]).read_bytes())  # a lost attempt's file
    got = T.read_tokens(spark, path, ids=True).orderBy("start").collect()
    by_text = dict(zip([t or "" for _, t in rows], library([t or "" for _, t in rows])))
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), by_text[t or ""]) for i, t in rows)
    assert [r.doc_id for r in got] == sorted([i for i, _ in rows], key=lambda i: -1 if i is None else i)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == digests([(r.doc_id, r.ids) for r in got])


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    T.write_tokens(docs, f"{tmp_path}/none")
    assert T.read_tokens(spark, f"{tmp_path}/none").count() == 0
    T.write_tokens(spark.createDataFrame([(5, None)], docs.schema), f"{tmp_path}/one")
    assert list(map(tuple, T.read_tokens(spark, f"{tmp_path}/one").collect())) == digests([(5, [1])])


CODER = T.Tokens(model(), 1)
values = st.one_of(*[st.integers(0, (1 << b) - 1) for b in (1, 3, 8, 15, 16, 20, 31, 60, 64)],
                   st.sampled_from([(1 << 60) - 2, (1 << 60) - 1, 1 << 60, (1 << 64) - 1]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(values.map(lambda v: [v]), st.integers(1, 300).map(lambda n: [0] * n),
                          st.tuples(st.integers(0, 9), st.integers(1, 70)).map(lambda x: [x[0]] * x[1])), max_size=60))
def test_round_trip_of_any_ids(parts):
    ids = np.array([v for p in parts for v in p], np.uint64)
    assert (T.unpack(T.pack(ids), len(ids)) == ids).all()


def greedy(ids):
    """The words by the format's rule, id by id."""
    out, i = [], 0
    while i < len(ids):
        rest = ids[i:] + [0] * 240
        for s, (count, bits) in enumerate(T.LAYOUT):
            if s == 15 and rest[0] >= (1 << 60) - 1:
                out += [15 << 60 | (1 << 60) - 1, rest[0]]
                break
            if all(v < 1 << bits for v in rest[:count]):
                out.append(s << 60 | sum(v << j * bits for j, v in enumerate(rest[:count])))
                break
        i += count
    return out


@pytest.mark.parametrize("seed", range(6))
def test_words_follow_the_rule(seed):
    pick = random.Random(seed)
    ids = [pick.choice([0, 0, 0, 1, 7, 300, 5_000, 40_000, 1 << 29, (1 << 60) - 1, (1 << 64) - 1])
           if pick.random() < 0.5 else pick.randrange(1 << pick.choice([0, 2, 8, 15])) for _ in range(3_000)]
    ids[100:600] = [0] * 500
    assert T.pack(np.array(ids, np.uint64)).tolist() == greedy(ids)


def test_blocks_decode_alone_and_damage_is_seen():
    buffer = io.BytesIO()
    buffer.close, data = lambda: None, None
    w = T.Writer(buffer, 64)
    ids = np.arange(1_000, dtype=np.uint32) * 37
    w.add([(1, 300), (None, 0), (3, 700)], ids)
    w.close()
    data = buffer.getvalue()
    r = T.Reader(data)
    assert r.doc_ids.to_pylist() == [1, None, 3]
    assert [x.tolist() for x in r.documents()] == [ids[:300].tolist(), [], ids[300:].tolist()]
    for b in random.Random(1).sample(range(16), 16):
        assert r.unpacked(b).tolist() == ids[b * 64:(b + 1) * 64].tolist()
    for broken in (data[:-1], data[:40] + b"?" + data[41:], b""):
        with pytest.raises(ValueError):
            T.Reader(broken)


parts = st.sampled_from(["a", "Word", "word", "straße", "e\u0301", "É", "é", "'s", "'", "it's", "!", ",", ".", "?!", "1", "23", " ", "  ", "\n", "\t",
                         "\x1c", "\x85", "\xa0", "\u2028", "Σ", "İ", "K", "ﬁ", "日本", "🙂", "×", "÷", "ß", "ÿ", "<|endoftext|>", "</w>", "\x00"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(parts, max_size=14).map("".join), min_size=1, max_size=5))
def test_ids_by_word_are_the_library_s(texts):
    ids, counts = CODER.coded([t.encode() for t in texts])
    want = library(texts)
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(T, "MEMO", 20)
    pick, coder = random.Random(2), T.Tokens(model(), 1)
    for _ in range(30):
        texts = [" ".join(pick.choice(["the", "of", f"w{pick.randrange(40)}", "x" * pick.randrange(30)]) for _ in range(20))]
        assert coder.coded([t.encode() for t in texts])[0].tolist() == library(texts)[0]


def test_a_tokenizer_that_keeps_white_space():
    import public_tokenizers as P
    from tokenizers import Tokenizer
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    t = Tokenizer.from_str(text)
    t.encode_special_tokens = True
    texts = ["two  spaces\n\nand words, 12", "", "x"]
    ids, counts = T.Tokens(text, 7).coded([x.encode() for x in texts])
    want = [e.ids + [7] for e in t.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_linear_in_long_texts():
    coder = T.Tokens(model(), 1)
    began = time.time()
    ids, counts = coder.coded([b"some words of text, again and again. " * 200_000])
    assert len(ids) == counts[0] and (T.unpack(T.pack(ids), len(ids)) == ids).all()
    assert time.time() - began < 15
