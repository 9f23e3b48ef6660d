"""Operator 9, benchmark decontamination by a prefix-filtered set join.

A-Z are lowered and words are runs of ASCII letters, digits and everything
beyond ASCII. A window is 10 consecutive words of an item; an item of fewer, but
not none, is one window. A document word inside any occurrence of a window is
hit.

Windows are seen as sets of word shingles. A document that contains a window
holds all its shingles, so one of them, the rarest by its count over all
documents, is a sufficient prefix. Document shingles are joined with these
prefix shingles only; a candidate must have room for the whole window around
the shingle's place (position and length bounds), and is then compared word by
word. DataFrame functions only. The windows are broadcast in blocks of at most
``BLOCK`` windows, however many there are.

Defined cases: null and empty texts have no words and no hit; an item without
words has no window; rows that repeat an item_id are one item, and rows without
an item_id are one item written as the empty string. Each document row is
judged by itself, repeated or not. Empty tables give no hits or no rows. Other
columns are carried as they are.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import packed, stored, table, unpacked

WINDOW, SHINGLE = 10, 3
BLOCK = 100_000  # windows broadcast together, about 30 MB
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = "".join(c for c in map(chr, range(128)) if not re.match(WORD, c) and c not in UPPER)
END = ""  # follows the words of a text; no word is empty


def words(text: Column) -> Column:
    """The runs of ``WORD``, without a regular expression, which takes several times as long."""
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, UPPER.lower() + " " * len(BETWEEN))
    return F.array_remove(F.split(spaced, " ", -1), "")


def windows(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """(window, item): each distinct window with each item that has it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             words(F.col("text")).alias("ws")).where("size(ws) > 0")
    last = F.greatest(F.size("ws") - length, F.lit(0))
    return (items.select("item", "ws", F.explode(F.sequence(F.lit(0), last)).alias("i"))
            .select(F.expr(f"slice(ws, i + 1, {length})").alias("window"), "item").distinct())


def shingle(ws: str, at: str, size: int) -> Column:
    """Hash of ``size`` words of array ``ws`` from 0-based place ``at``."""
    return F.xxhash64(*[F.expr(f"get({ws}, {at} + {k})") for k in range(size)])


def places(rows: DataFrame, size: int) -> DataFrame:
    """Every place of every document with the shingle that begins there. The
    array goes along by reference within the generated code (it is never empty;
    the outer form keeps Spark from testing that by building it twice)."""
    ws = rows.select("row_id", F.array_append(words(F.col("text")), F.lit(END)).alias("ws"))
    return (ws.select("row_id", "ws", F.posexplode_outer("ws").alias("pos", "word"))
            .withColumn("key", shingle("ws", "pos", size)))


def prefixes(rows: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """(window, n, offset, key): the shingle of each window that is rarest over
    all documents. A window with a shingle that no document has is left out."""
    shingles = (found.select("window").distinct()
                .select("window", F.explode(F.sequence(F.lit(0), F.size("window") - size)).alias("offset"))
                .withColumn("key", shingle("window", "offset", size)))
    keys = stored(shingles.select("key").distinct(), "shingles")
    counts = [places(rows, size).join(F.broadcast(block), "key").groupBy("key").agg(F.count("*").alias("n"))
              for block in blocks(keys, F.col("key"))]
    counts = reduce(DataFrame.unionByName, counts)
    least = (shingles.join(counts, "key", "left").groupBy("window")
             .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "key")).alias("least")))
    return least.where("least.n > 0").select(
        "window", F.size("window").alias("n"), F.col("least.offset").alias("offset"), F.col("least.key").alias("key"))


def blocks(df: DataFrame, key: Column) -> list[DataFrame]:
    """A stored small table in parts of about BLOCK rows."""
    parts = df.count() // BLOCK + 1
    return [df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == p) if parts > 1 else df for p in range(parts)]


def matches(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(row_id, start, n, window): every occurrence of a window; and for each row
    one of the window [END], whose start is the number of words."""
    shortest = found.agg(F.min(F.size("window"))).first()[0]
    size = SHINGLE if shortest is None or shortest >= SHINGLE else 1
    least = prefixes(rows, found, size) if shortest is not None else None
    end = rows.sparkSession.range(1).select(
        F.array(F.lit(END)).alias("window"), F.lit(1).alias("n"), F.lit(0).alias("offset"))
    end = end.withColumn("key", shingle("window", "offset", size))
    least = stored(end if least is None else least.unionByName(end), "prefixes")
    at = places(rows, size)
    out = []
    for block in blocks(least, F.col("key")):
        hit = at.join(F.broadcast(block), "key").where(
            "pos >= offset and pos - offset + n <= size(ws) and slice(ws, pos - offset + 1, n) = window")
        out.append(hit.select("row_id", F.expr("pos - offset").alias("start"), "n", "window"))
    return stored(reduce(DataFrame.unionByName, out), "matches")


def judged(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row_id, n_words, n_hit, items) of every row of (row_id, text)."""
    found = stored(windows(benchmark), "windows")
    at = matches(rows, found)
    is_end = F.col("window") == F.array(F.lit(END))
    total = at.where(is_end).select("row_id", F.col("start").cast("long").alias("n_words"))
    at = at.where(~is_end)
    hit = (at.select("row_id", F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos"))
           .distinct().groupBy("row_id").agg(F.count("*").alias("n_hit")))
    items = (at.select("row_id", "window").distinct().join(found, "window")
             .select("row_id", "item").distinct()
             .groupBy("row_id").agg(F.sort_array(F.collect_list("item")).alias("items")))
    return total.join(hit, "row_id", "left").join(items, "row_id", "left").select(
        "row_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold any window of ``benchmark``."""
    rows = stored(packed(docs), "documents")
    bad = judged(rows.select("row_id", "text"), benchmark).where("n_hit > 0").select("row_id")
    return unpacked(rows.join(bad, "row_id", "left_anti"), docs.columns)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = stored(rows.select("row_id", "doc_id", "text"), "documents")
    found = judged(ids.select("row_id", "text"), table(spark, sf_dir, "benchmark"))
    return ids.select("row_id", "doc_id").join(found, "row_id").select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(
             translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
        translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n,
          array_to_string(list_slice(ws, i, i + least(len(ws), {WINDOW}) - 1), ' ') AS w
        FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
gram AS (SELECT row_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w
         FROM (SELECT row_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
               FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT row_id, gram.i, gram.n, item FROM gram JOIN win USING (n, w)),
pos AS (SELECT row_id, count(DISTINCT p) AS n_hit
        FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT row_id, i, n FROM hit)) GROUP BY 1),
its AS (SELECT row_id, count(DISTINCT item) AS n_items,
               array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (row_id) LEFT JOIN its USING (row_id)
"""
