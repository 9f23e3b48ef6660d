"""Operator 8, exact dedup by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes has a fixed pattern,
so equal texts are cut alike. A chunk is identified by its hash; every distinct
(hash, content) is brought together once, which verifies that a hash stands for
one content, or tells the contents of a shared hash apart. After that only the
ordered lists of identifiers are moved and compared, never the texts.

Defined cases: a null text counts as empty, an empty text has the empty recipe
(all such rows are one group). Of equal texts the row with the largest doc_id
stays, a null doc_id being the smallest; of rows that also share the doc_id just
one stays. An empty table gives an empty table. Other columns are carried as
they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm.common import add_columns, groups, packed, python_ready, stored, table, unpacked, utf8

MIN_BYTES, MAX_BYTES, MEAN_BITS = 256, 16_384, 11  # a chunk is about 2 KiB long
GEAR = np.random.default_rng(8).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j over the last 32 bytes, by doubling."""
    h = GEAR[data]
    for w in (1, 2, 4, 8, 16):
        if len(h) > w:
            h[w:] = h[w:] + (h[:-w] << np.uint32(w))  # the right side is built first
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each text of ``data`` the ends of its chunks. Cuts fall on whole
    characters, and at least MIN_BYTES (over 32) after the last cut, so the hash
    there has only seen this text. Without a cut within MAX_BYTES, one is made
    at the next whole character."""
    base, end = int(offsets[0]), int(offsets[-1])
    part = data[base:end]
    starts = np.ones(len(part) + 1, bool)
    starts[:-1] = (part & 0xC0) != 0x80
    cuts = np.flatnonzero((rolling(part) >> np.uint32(32 - MEAN_BITS)) == 0) + 1
    cuts = cuts[starts[cuts]].tolist()
    out, k = [], 0
    for a, b in zip((offsets[:-1] - base).tolist(), (offsets[1:] - base).tolist(), strict=True):
        ends = []
        while b - a > MIN_BYTES:
            while k < len(cuts) and cuts[k] < a + MIN_BYTES:
                k += 1
            cut = cuts[k] if k < len(cuts) else b
            if cut - a > MAX_BYTES:
                cut = a + MAX_BYTES
                while cut < b and not starts[cut]:
                    cut += 1
            if cut >= b:
                break
            ends.append(cut + base)
            a = cut
        if b > a:
            ends.append(b + base)
        out.append(ends)
    return out


def chunked(rows: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``text`` becomes ``recipe`` (chunk hashes) and ``chunks`` (their contents;
    null for a null text). ``hash_bits`` under 64 makes hashes collide, for tests."""
    mask = (1 << hash_bits) - 1

    def make(batch):
        column = batch.column(batch.schema.get_field_index("text"))
        data, offsets = utf8(column)
        view = memoryview(data)
        hashes, ends, lists = [], [], [0]
        for a, b in groups(offsets):
            start = int(offsets[a])
            for text_ends in chunk_ends(data, offsets[a:b + 1]):
                for e in text_ends:
                    hashes.append((xxhash.xxh3_64_intdigest(view[start:e]) & mask) - (1 << 63 if hash_bits == 64 else 0))
                    ends.append(e)
                    start = e
                lists.append(len(ends))
        cuts = np.array([int(offsets[0]), *ends], np.int64)
        cuts = pa.array(cuts - cuts[0]) if len(cuts) else pa.array([0], pa.int64())
        content = pa.py_buffer(data[int(offsets[0]):int(offsets[-1])].tobytes())
        chunk = pa.LargeStringArray.from_buffers(len(ends), cuts.buffers()[1], content).cast(pa.string())
        lists = pa.array(lists, pa.int32())
        null = pa.array(column.is_null())
        return [pa.ListArray.from_arrays(lists, pa.array(hashes, pa.int64())),
                pa.ListArray.from_arrays(lists, chunk, mask=null)]

    return add_columns(rows, make, "recipe array<bigint>, chunks array<string>", drop=("text",))


def verified(rows: DataFrame) -> DataFrame:
    """(row_id, doc_id, text_sha256, recipe) with verified identifiers.

    Every distinct (hash, content) meets once. Where one hash has several
    contents they are numbered, and the number becomes part of the identifier
    in the recipes that hold that hash.
    """
    light = rows.select("row_id", "doc_id", "text_sha256", "recipe")
    pieces = rows.select(F.explode(F.arrays_zip("recipe", "chunks")).alias("p")).select(
        F.col("p.recipe").alias("h"), F.col("p.chunks").alias("chunk"))
    contents = pieces.groupBy("h", "chunk").agg(F.count("*").alias("n"))
    shared = stored(contents.groupBy("h").agg(F.count("*").alias("contents")).where("contents > 1").select("h"),
                    "shared-hashes")
    if shared.isEmpty():
        return light.withColumn("variants", F.lit(None).cast("array<int>"))
    variants = contents.join(shared, "h", "left_semi").select(
        "h", "chunk", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).alias("variant"))
    told = (rows.select("row_id", F.posexplode(F.arrays_zip("recipe", "chunks")).alias("pos", "p"))
            .select("row_id", "pos", F.col("p.recipe").alias("h"), F.col("p.chunks").alias("chunk"))
            .join(variants, ["h", "chunk"])
            .groupBy("row_id")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "variant"))).alias("told")))
    return light.join(told, "row_id", "left").select(
        *light.columns, F.expr("transform(told, x -> x.variant)").alias("variants"))


def classes(recipes: DataFrame) -> DataFrame:
    """One row per document: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    The lists are pre-aggregated to one row each before the join, so only the
    document side of it can be hot, which AQE splits.
    """
    key = ["recipe", "variants"]
    recipes = recipes.withColumn("variants", F.coalesce("variants", F.array().cast("array<int>")))
    best = recipes.groupBy(*key).agg(
        F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row_id")).alias("best"),
        F.count("*").alias("group_size"))
    return recipes.join(best, key).select(
        "row_id", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256")


def dedup_rows(docs: DataFrame, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(chunked rows, classes) of a table with doc_id and text."""
    python_ready(docs.sparkSession)
    rows = packed(docs).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = stored(chunked(rows, hash_bits), "chunks")
    return rows, classes(verified(rows))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another kept row has."""
    rows, found = dedup_rows(docs)
    rows = rows.join(found.where("not kept").select("row_id"), "row_id", "left_anti")
    return unpacked(rows.withColumn("text", F.array_join("chunks", "")), docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = dedup_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("row_id")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
