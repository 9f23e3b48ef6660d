"""Scalar functions and quirks."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens import functions as fn


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_substring_dedupe_quirks(spark):
    got = one(spark, fn.substring_dedupe("v"), ["/ab", "/a", "", "/c", "/ab", "/abc"], "v array<string>")
    assert got == ["/ab", "/c", "/abc"]  # /a is inside /ab; '' is always dropped


def _growing(items):
    text, kept = "", []
    for x in items:
        if x not in text:  # '' is always contained
            text += "\n" + x
            kept.append(x)
    return kept


def test_substring_dedupe_equals_growing_text(spark):
    rnd = random.Random(7)
    lists = [[("".join(rnd.choice("ab/") for _ in range(rnd.randint(0, 4)))) for _ in range(rnd.randint(0, 8))]
             for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<string>")
    got = {r["i"]: r["d"] for r in df.select("i", fn.substring_dedupe("v").alias("d")).collect()}
    for i, v in enumerate(lists):
        assert got[i] == _growing(v), v


def test_split_star(spark):
    assert one(spark, fn.split_star("v"), "a*b**c***") == ["a", "b", "c"]


def test_url_origin_and_absolute(spark):
    rows = [("HTTPS://u@Cdn.Other.org:8080/i", True, "https://Cdn.Other.org"),
            ("mailto:someone", True, "mailto://"),
            ("http://x.example.com/a b", True, "http://x.example.com"),
            ("tel:123", False, None), ("/relative", False, None), ("//host/x", False, None),
            ("#frag", False, None), ("javascript:void(0)", False, None),
            ("http://h:abc/", False, None), ("ftp://files.org", True, "ftp://files.org"),
            ("http://[::1]:8080/x", True, "http://[::1]")]
    df = spark.createDataFrame([(r[0],) for r in rows], "h string")
    got = {r["h"]: (r["ok"], r["o"]) for r in df.select(
        "h", fn.is_absolute_url("h").alias("ok"), fn.url_origin("h").alias("o")).collect()}
    for h, ok, origin in rows:
        assert got[h][0] == ok, h
        if ok:
            assert got[h][1] == origin, h


def test_brand_contains_ignoring_case(spark):
    assert one(spark, fn.is_brand("v", "example.com"), "https://x.EXAMPLE.com.evil.org") is True


def test_page_language(spark):
    pre = "https://www.example.com/"
    cases = {"https://www.example.com/express/x": "en", "https://www.example.com/EXPRESS/x": "en",
             "https://www.example.com/de/express/1": "de", "https://www.example.com/express": None,
             "https://other.org/de/x": None}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    got = {r["u"]: r["l"] for r in df.select("u", fn.page_language("u", pre).alias("l")).collect()}
    assert got == cases


def test_media_ids_jpg_runs_on(spark):
    got = one(spark, fn.media_ids("v"), 'x media_a.jpg y media_b.png media_c.mp4 media_c.mp4')
    assert got == ["a.jpg y media_b", "c"]


def test_join_lines_merges_tokens_and_class_tokens(spark):
    got = one(spark, fn.class_tokens(fn.join_lines("v")), "  list\ncompact  list\tx ")
    assert got == ["listcompact", "list", "x"]


def test_format_epoch_and_bad_values(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert one(spark, fn.format_epoch("v"), "1700000000") == "2023-11-14 22:13:20"
    assert one(spark, fn.format_epoch("v"), "x") is None


def test_join_links(spark):
    assert one(spark, fn.join_links("v"), ["a", "b"], "v array<string>") == "\na\nb"
    assert one(spark, fn.join_links("v"), [], "v array<string>") == ""


def test_primary_block_and_variant(spark):
    vocab = ["list", "cards", "quick-action-card"]
    df = spark.createDataFrame([(["dark", "cards", "list", "wide"],)], "v array<string>")
    r = df.select(fn.primary_block("v", vocab).alias("b"), fn.variant_name("v", vocab).alias("var")).first()
    assert (r["b"], r["var"]) == ("cards", "dark wide")
    r = spark.createDataFrame([([],)], "v array<string>").select(fn.primary_block("v", vocab).alias("b")).first()
    assert r["b"] is None


def test_has_attr_prefix(spark):
    df = spark.createDataFrame([({"classid": "z"},), ({"hreflang": "en"},)], "a map<string,string>")
    got = df.select(fn.has_attr_prefix("a", "class").alias("c"), fn.has_attr_prefix("a", "href").alias("h")).collect()
    assert [(r["c"], r["h"]) for r in got] == [(True, False), (False, True)]


def test_substring_dedupe_of_many_links(spark):
    many = [f"https://www.example.com/d/{i * 7919 % 8000}" for i in range(8_000)]
    odd = ["a\uffffb", "b", "a", "a\uffffb", "\uffff", "c"]
    df = spark.createDataFrame([(0, many), (1, odd), (2, []), (3, ["", "x", ""]), (4, None)], "k int, a array<string>")
    got = {r["k"]: r["o"] for r in df.select("k", fn.substring_dedupe(F.col("a")).alias("o")).collect()}
    text, want = "", []
    for x in many:
        if x not in text:
            want.append(x)
            text += "\n" + x
    assert got == {0: want, 1: ["a\uffffb", "c"], 2: [], 3: ["x"], 4: None}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab/", max_size=7), st.text("aä🙂", max_size=4)), max_size=14))
def test_uncontained_equals_comparing_all_pairs(items):
    want = []
    for i, x in enumerate(items):
        if x and x not in items[:i] and not any(x in y for y in items[:i] if y):
            want.append(x)
    assert fn.uncontained(items) == want


def seconds(run, *args):
    began = time.time()
    run(*args)
    return time.time() - began


def test_uncontained_is_linear_in_the_links():
    small, large = ([f"https://www.example.com/{i % 97}/page-{i * 7919 % 100_003}.html?q={i}" for i in range(n)] for n in (10_000, 100_000))
    assert seconds(fn.uncontained, large) < 20 * max(seconds(fn.uncontained, small), 0.05)
    # each link inside the next, and each inside the one before
    nested = ["a" * i for i in range(1, 1_500)]
    assert fn.uncontained(nested) == nested and fn.uncontained(nested[::-1]) == nested[-1:]
    assert seconds(fn.uncontained, nested) < 10


MEDIA = r"media_(.*?)\.(png|jpeg|mp4)"


def test_media_ids_equal_the_pattern(spark):
    pick = random.Random(5)
    parts = ["media_", "media", "_", ".png", ".jpeg", ".mp4", ".jpg", ".", "a", "b c", "\n", "\r", "\u0085", "\u2028", "\u2029", "é"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(30))) for _ in range(3_000)]
    texts += ["", "media_.png", "media_media_x.png", "media_a.jpg x media_b.png", ".pngmedia_q.mp4"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "k int, v string")
    pattern = F.array_sort(F.array_distinct(F.regexp_extract_all("v", F.lit(MEDIA), 1)))
    rows = df.select("v", fn.media_ids("v").alias("got"), pattern.alias("want")).collect()
    assert all(r.got == r.want for r in rows) and sum(bool(r.got) for r in rows) > 500


def test_media_ids_of_other_prefixes_and_endings(spark):
    df = spark.createDataFrame([("x: a+b.ti+f, x: c.ti+f.gif",)], "v string")
    assert df.select(fn.media_ids("v", "x: ", ("ti+f", "gif"))).first()[0] == ["a+b", "c"]


def test_media_ids_are_linear_in_the_page(spark):
    def run(n):
        page = "".join(f'<img src="/media_{i:06d}.jpg">' for i in range(n))
        df = spark.createDataFrame([(page,), (page + ".png",)], "v string")
        return [len(r[0]) for r in df.select(fn.media_ids("v")).collect()]

    run(1_000)
    assert seconds(lambda: run(100_000)) < 15
    assert run(50_000) == [0, 1]
