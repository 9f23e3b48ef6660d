import zlib
from collections import Counter

from pyspark.sql import functions as F

from sitelens.llm import sharding as S


def lawful(rows, shards=8):
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = S.op7_sharding(spark, sf).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    lawful(rows)
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_many_buckets_are_shuffled_and_independent_of_the_partitions(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 20, i) for i in range(2_000)], "doc_id long, text string, shard long")
    places = []
    for parts in (1, 3, 7):
        rows = S.external_shuffle(docs.repartition(parts), bucket_bytes=8_000).collect()
        lawful(rows)
        places.append(sorted((r.doc_id, r.shard, r.slot, r.text, r.doc.shard) for r in rows))
    assert places[0] == places[1] == places[2]
    order = [x[0] for x in sorted(places[0], key=lambda x: x[1:3])]
    # a uniform shuffle leaves about half of the neighbours in ascending order
    assert 0.45 < sum(a < b for a, b in zip(order, order[1:])) / len(order) < 0.55
    other = S.external_shuffle(docs, bucket_bytes=8_000, seed=1).collect()
    assert sorted((r.doc_id, r.shard, r.slot, r.text, r.doc.shard) for r in other) != places[0]


def test_repeated_records_spread_over_the_buckets(spark):
    docs = spark.createDataFrame([(1, "same text " * 10)] * 3_000 + [(i, "x") for i in range(500)], "doc_id long, text string")
    one, buckets = S.scattered(S.packed(docs).drop("row_id"), 10_000, 7)
    sizes = [r["count"] for r in one.groupBy("bucket").count().collect()]
    assert buckets > 20 and max(sizes) < 4 * sum(sizes) / buckets
    lawful(S.external_shuffle(docs, bucket_bytes=10_000).collect())


def test_few_but_long_copies_spread_over_the_buckets(spark):
    docs = spark.createDataFrame([(1, "long text " * 2_000)] * 40 + [(i, "x") for i in range(500)], "doc_id long, text string")
    one, buckets = S.scattered(S.packed(docs).drop("row_id"), 60_000, 7)
    sizes = [r.bytes for r in one.groupBy("bucket").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()]
    assert buckets > 10 and max(sizes) <= 10 * 20_000
    lawful(S.external_shuffle(docs, bucket_bytes=60_000).collect())


def test_nulls_ties_few_rows_empty_table_and_files(spark, tmp_path):
    rows = [(None, None, "a"), (None, "", "a"), (1, "é", None), (1, "é", None), (2, "z" * 100_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    got = S.external_shuffle(docs).collect()
    lawful(got)
    assert sorted(str((r.doc_id, r.text, r.doc.slot)) for r in got) == sorted(map(str, rows))
    assert S.external_shuffle(docs.limit(0)).count() == 0
    S.write_shards(docs, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 5 and set(back.columns) == {"slot", "doc_id", "text", "doc", "shard"}
