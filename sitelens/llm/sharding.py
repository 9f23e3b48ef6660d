"""Operator 7, sharding by a two-pass external shuffle. DataFrame functions only.

Pass one scatters the records over memory-sized buckets: the bucket is a seeded
hash of the record, and each bucket is one partition. Pass two gathers a bucket
(about ``bucket_bytes``), puts it into a fixed order, shuffles it (Spark's
``shuffle`` is a Fisher-Yates shuffle, seeded here with seed + bucket) and writes
it. Buckets in order give every record a global place; shards are equal runs of
places, so their row counts differ by at most one (law ``rows``) and a bucket
falls into one shard or a few.

Identical records that make up over 1 / ``LARGE`` of a bucket together, be they many
or long, are spread by an additional salt, so a
record that fills a third of the table doesn't fill one bucket.

Defined cases: a null text counts as empty (size 1, crc32 0); a null doc_id is a
value like any other; ties and repeated rows each get a place of their own; with
fewer rows than shards some shards are empty; an empty table gives no rows. Other
columns are carried as they are. The same records give the same shards however
the input is partitioned, but for such repeated records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm.common import packed, stored, table

SHARDS, SEED, BUCKET_BYTES, LARGE = 8, 7, 16 << 20, 16
SMALL = 1_000_000  # buckets whose offsets (24 bytes each) may be broadcast


def scattered(rows: DataFrame, bucket_bytes: int, seed: int) -> tuple[DataFrame, int]:
    """Pass one: (bucket, ident, doc_id, text, doc), a partition for each bucket,
    and their number."""
    rows = rows.select(
        F.xxhash64(F.lit(seed), "doc_id", "text", "doc").alias("ident"),
        F.monotonically_increasing_id().alias("place"), "doc_id", "text", "doc")
    by = stored(rows.groupBy("ident").agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(64)).alias("bytes")), "idents")
    total = by.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = int(total // bucket_bytes) + 1
    repeated = by.where((F.col("n") > 1) & (F.col("bytes") * LARGE > bucket_bytes)).select("ident", F.lit(1).alias("often"))
    if not repeated.isEmpty():
        rows = rows.join(repeated, "ident", "left")
        salt = F.when(F.col("often").isNotNull(), F.col("place"))
    else:
        salt = F.lit(None).cast("long")
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "ident", salt), F.lit(buckets)).cast("int")
    return rows.select(bucket.alias("bucket"), "ident", "doc_id", "text", "doc").repartitionById(
        buckets, F.col("bucket")), buckets


def external_shuffle(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES,
                     seed: int = SEED) -> DataFrame:
    """(shard, slot, doc_id, text, doc): every record in its written place;
    ``doc`` is a struct of the other columns."""
    one, buckets = scattered(packed(docs).drop("row_id"), bucket_bytes, seed)
    record = F.struct("ident", "doc_id", "text", "doc")
    two = (one.groupBy("bucket").agg(F.sort_array(F.collect_list(record)).alias("records"))
           .select("bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("place", "r"))
           .select("bucket", "place", "r.doc_id", "r.text", "r.doc"))
    written = stored(two, "buckets")
    sizes = written.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.select(
        "bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
                             F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("total"))
    if buckets <= SMALL:
        before = F.broadcast(before)
    place, total = F.col("before") + F.col("place"), F.col("total")
    shard = F.expr(f"cast(({shards} * (before + place + 1) - 1) div total as int)")
    return (written.join(before, "bucket").withColumn("shard", shard)
            .withColumn("slot", place - F.floor(F.col("shard") * total / shards).cast("long"))
            .select("shard", "slot", "doc_id", "text", "doc"))


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Write the shards as Parquet folders shard=0, 1, ... with column ``slot``."""
    placed = external_shuffle(docs, **how)
    placed.select("shard", "slot", "doc_id", "text", "doc").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = external_shuffle(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
