import base64
import hashlib
import random
import time

import public_tokenizers as P
import regex
import tiktoken

from sitelens.llm import bpe


def library():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, " ", "Hello  world's\n\n\tend ", "日本語 ² Ⅷ   x\x1c\x85", "a" * 5_000, "ab" * 700 + "é" * 600,
         " " * 3_000 + "x", "thereonnd anisthe" * 40, "😀👩‍👩‍👧 ''re 12345678901234567890", "a" * 5_000, "<|endoftext|>", "\0\x01"]


def test_ids_and_round_trip_equal_the_library(spark):
    lib = library()
    docs = spark.createDataFrame([(i if i != 5 else None, t, "z") for i, t in enumerate(TEXTS)],
                                 "doc_id long, text string, ids string")
    ids = bpe.encode(docs)
    got = sorted((r.doc_id is None, r.doc_id, r.ids) for r in ids.collect())
    want = sorted((i == 5, i if i != 5 else None, lib.encode_ordinary(t or "")) for i, t in enumerate(TEXTS))
    assert got == want
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids).collect()}
    assert back == {(i if i != 5 else None): (t or "").encode() for i, t in enumerate(TEXTS)}
    found = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for i, t in enumerate(TEXTS):
        want = lib.encode_ordinary(t or "")
        r = found[i if i != 5 else None]
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_heap_and_recursive_query_agree():
    ranks, pattern = bpe.vocabulary()
    c = bpe.Coder(ranks, pattern)
    pieces = [p.encode() for p in ("thereonndanisthe" * 4, "éèçà" * 8, "aaaaaaaaab" * 6, "zqxj" * 15)]
    assert max(map(len, pieces)) <= bpe.LONG
    assert c.encode(pieces) == [bpe.merged(p, c.ranks) for p in pieces]


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_the_library_on_the_whole_table(spark):
    lib = library()
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in bpe.op6_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = lib.encode_ordinary(d.text or "")
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_latin_pattern_is_the_public_one():
    pick, whole = random.Random(4), regex.compile(P.PATTERN).findall
    for a in map(chr, range(256)):
        text = f"x{a}1{a}{a} !{a} {a}'s{a}\n{a}"
        assert bpe.LATIN.findall(text) == whole(text)
    for _ in range(3_000):
        text = "".join(pick.choice(["a", "Z", "é", "1", "²", " ", "  ", "\n", "\xa0", "\x85", "\x1c", "'", "'re", "!", "×", "ª", "_", "\0"])
                       for _ in range(pick.randrange(20)))
        assert bpe.LATIN.findall(text) == whole(text)


def test_cost_against_the_length_of_pieces():
    """As much text in pieces of 10 to 100,000 letters, all different, costs at most
    some times as much as in ordinary words; ids are the library's."""
    ranks, pattern = bpe.vocabulary()
    lib, pick = library(), random.Random(6)
    seconds = {}
    for size in (10, 50, 150, 500, 100_000):
        letters = "".join(pick.choices("etaoinshrdlu", k=200_000))
        text = " ".join(letters[a:a + size] for a in range(0, len(letters), size))
        c = bpe.Coder(ranks, pattern)
        c.coded(["warm up"])
        began = time.time()
        lists, csvs, _ = c.coded([text])
        seconds[size] = time.time() - began
        assert ",".join(csvs[i] for i in lists[0]) == ",".join(map(str, lib.encode_ordinary(text)))
    assert max(seconds.values()) < 8 * seconds[10] + 2, seconds
    han = "".join(chr(pick.randrange(0x4E00, 0x6E00)) + "，" * (i % 30 == 29) for i in range(100_000))
    began = time.time()
    lists, csvs, _ = c.coded([han])
    assert time.time() - began < 12 * seconds[10] + 4
    assert ",".join(csvs[i] for i in lists[0]) == ",".join(map(str, lib.encode_ordinary(han)))


def test_forgotten_pieces_are_encoded_again(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    monkeypatch.setattr(bpe, "PIECE_BYTES", 20)
    lib, c = library(), bpe.Coder(*bpe.vocabulary())
    for text in ("one two threefold fourfold", "fivefoldish one sixfoldish", "two threefold sevenfoldish one") * 3:
        lists, csvs, backs = c.coded([text])
        assert ",".join(csvs[i] for i in lists[0]) == ",".join(map(str, lib.encode_ordinary(text)))
        assert b"".join(backs[i] for i in lists[0]) == text.encode()


def test_batches_of_several_groups(spark):
    """Texts of over a megabyte: several groups to a batch, several batches to a stretch."""
    lib = library()
    texts = [f"word{i % 3} and more " * (60_000 + i) for i in range(14)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_pieces_of_one_query_are_bounded_in_bytes(monkeypatch):
    from sitelens.llm import bpe
    sizes, coder = [], bpe.Coder(*bpe.vocabulary())
    monkeypatch.setattr(bpe, "PIECE_BYTES", 100)
    monkeypatch.setattr(coder, "learn", lambda ps: (sizes.append(sum(len(p.encode()) for p in ps)), coder.memo.update((p, ("", b"")) for p in ps)))
    coder.coded([" ".join(chr(0x4e00 + i) * 10 for i in range(50))])
    assert sum(sizes) > 1_500 and max(sizes) <= 100 + 31
