"""Operator 11, token ids in Simple-8b word-aligned binary files.

Documents are put in ascending order of doc_id by a range partitioning (of the
texts, before they are tokenised, so no id is shuffled). Each partition streams
its ids into one file, every document followed by the end id.

File format, little endian:

* 8 bytes of ``MAGIC``;
* blocks of ``block`` ids (the last may have fewer), each a run of 64-bit words. A
  word's top four bits select how many ids of how many bits fill the other sixty,
  first id lowest (``LAYOUT``). An id that sixty bits can't hold, or whose sixty
  bits are all ones, is escaped: a word of the last selector with all ones, then
  the raw id as a word. Blocks share no word, so each can be decoded alone;
* the offset of each block in words, and of the end (u64 each);
* for each document its doc_id (i64, 0 if null), whether it is null (u8) and its
  number of ids (u64), column by column;
* six u64: ids, blocks, documents, ids in a block, crc32 of all bytes before the
  blocks' offsets, the offset of the blocks' offsets; then ``MAGIC`` again.

The tasks write the files with pyarrow's file systems (local and mounted folders,
hdfs, s3, gs). A file's name is an attempt's own; only files named in the manifest,
a table that Spark commits, count. So a lost or repeated task leaves at most a file
that no reader looks at.

Defined cases: a null text counts as empty, and an empty text has the end id alone;
null doc_ids come first; rows of one doc_id are ordered by a hash of their text, and
equal rows follow each other in any order; a document is never split over files,
however long; an empty table gives no documents; other columns are not read. The
text of a special token is ordinary text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm.common import groups, python_ready, release, table, utf8
from sitelens.session import checkpoint_dir

END_ID, BLOCK, FILE_BYTES = 1, 1 << 16, 32 << 20  # FILE_BYTES: of text, about a quarter of that in the file
MEMO, POOL = 500_000, 4_000_000  # words, and their ids, that a worker remembers
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")  # as the normaliser does
KIND = np.ones(256, np.uint8)  # 0 white space, 2 a to z, 3 marks that end a word
KIND[list(b" \t\n\x0b\x0c\r")], KIND[97:123], KIND[list(b".,;:!?")] = 0, 2, 3
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")  # lower-case Latin-1 letters
MAGIC = b"S8B\x00TOK1"
# (ids, bits of each) by selector: the fixed layout of Simple-8b
LAYOUT = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12),
          (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([c for c, _ in LAYOUT], np.int64)
MARK = np.uint64((1 << 60) - 1)
LIMITS = np.array(sorted({1 << b for _, b in LAYOUT[:-1]}) + [int(MARK)], np.uint64)  # an id below LIMITS[i] has width class i
CLASS = {b: i for i, b in enumerate(sorted({b for _, b in LAYOUT}))}
SMALL = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)


def fitting(width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(selector, ids it takes) at each place: the one that holds the most ids. The
    widest of so many ids is found from windows half as long."""
    n = len(width)
    chosen, step = np.full(n, 15, np.uint8), np.ones(n, np.uint8)
    window, size = np.append(width, np.zeros(240, np.uint8)), 1
    for s in range(14, -1, -1):
        count, bits = LAYOUT[s]
        while size < count:
            more = min(size, count - size)
            window = np.maximum(window[:-more], window[more:])
            size += more
        fits = window[:n] <= CLASS[bits]
        if not fits.any():
            break  # wider windows of narrower ids don't fit either
        chosen[fits], step[fits] = s, count
    return chosen, step


def pack(ids: np.ndarray) -> np.ndarray:
    """The words of one block. The last word is filled with zeros."""
    n = len(ids)
    ids = np.append(ids.astype(np.uint64), np.zeros(240, np.uint64))
    if n and int(ids.max()) < len(SMALL):
        width = SMALL[ids[:n].astype(np.int64)]
    else:
        width = np.searchsorted(LIMITS, ids[:n], "right").astype(np.uint8)
    chosen, step = fitting(width)
    starts, i, size = [], 0, step.tobytes()
    while i < n:
        starts.append(i)
        i += size[i]
    starts = np.array(starts, np.int64)
    chosen = chosen[starts]
    escaped = (chosen == 15) & (ids[starts] >= MARK)
    at = np.arange(len(starts)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(starts) + int(escaped.sum()), np.uint64)
    for s in np.unique(chosen).tolist():
        count, bits = LAYOUT[s]
        mine = np.flatnonzero(chosen == s)
        first, payload = starts[mine], np.full(len(mine), s << 60, np.uint64)
        for j in range(count if bits else 0):
            payload |= ids[first + j] << np.uint64(j * bits)
        words[at[mine]] = payload
    words[at[escaped]] = MARK | np.uint64(15 << 60)
    words[at[escaped] + 1] = ids[starts[escaped]]
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block, selector by selector."""
    mark = np.flatnonzero(words == MARK | np.uint64(15 << 60))
    raw = np.zeros(len(words) + 1, bool)
    if len(mark):  # in a run of such words every second one is an id that looks like it
        run = np.cumsum(np.append(True, np.diff(mark) > 1)) - 1
        first = mark[np.flatnonzero(np.append(True, np.diff(run) > 0))][run]
        raw[mark[(mark - first) % 2 == 0] + 1] = True
    raw = raw[:-1]
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.where(raw, 0, COUNTS[chosen])
    first = np.cumsum(counts) - counts
    out = np.zeros(n + 240, np.uint64)
    for s in np.unique(chosen[~raw]).tolist():
        count, bits = LAYOUT[s]
        if bits:
            mine = np.flatnonzero((chosen == s) & ~raw)
            value = words[mine]
            for j in range(count):
                out[first[mine] + j] = (value >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    behind = np.flatnonzero(raw)
    out[first[behind - 1]] = words[behind]
    return out[:n]


class Writer:
    """One file, written block by block to ``stream``."""

    def __init__(self, stream, block: int = BLOCK):
        self.stream, self.block = stream, block
        self.held, self.size = [], 0
        self.offsets, self.ids, self.crc = [0], 0, 0
        self.docs: list[tuple[int | None, int]] = []
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.stream.write(data)

    def add(self, docs: list[tuple[int | None, int]], ids: np.ndarray) -> None:
        """(doc_id, number of ids) of some documents and their ids one after another."""
        self.docs += docs
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block * self.block
            for a in range(0, whole, self.block):
                self.pack(ids[a:a + self.block])
            self.held, self.size = [ids[whole:].copy()], len(ids) - whole

    def pack(self, ids: np.ndarray) -> None:
        words = pack(ids)
        self.put(words.astype("<u8").tobytes())
        self.ids += len(ids)
        self.offsets.append(self.offsets[-1] + len(words))

    def close(self) -> None:
        if self.size:
            self.pack(np.concatenate(self.held))
        w = self.stream.write
        w(np.array(self.offsets, "<u8").tobytes())
        w(np.array([i or 0 for i, _ in self.docs], "<i8").tobytes())
        w(np.array([i is None for i, _ in self.docs], np.uint8).tobytes())
        w(np.array([n for _, n in self.docs], "<u8").tobytes())
        w(struct.pack("<6Q", self.ids, len(self.offsets) - 1, len(self.docs), self.block, self.crc,
                      len(MAGIC) + 8 * self.offsets[-1]))
        w(MAGIC)
        self.stream.close()


class Reader:
    """The documents and blocks of one file's bytes."""

    def __init__(self, data: bytes):
        self.data = data
        if len(data) < 64 or data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a whole token file")
        self.ids, blocks, docs, self.block, crc, at = struct.unpack("<6Q", data[-56:-8])
        if zlib.crc32(memoryview(data)[:at]) != crc:
            raise ValueError("damaged token file")
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at)
        at += 8 * (blocks + 1)
        ids, null = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = pa.array(ids, pa.int64(), mask=null == 1)
        self.counts = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)

    def unpacked(self, b: int) -> np.ndarray:
        """The ids of block ``b``."""
        words = np.frombuffer(self.data, "<u8", int(self.offsets[b + 1] - self.offsets[b]), len(MAGIC) + 8 * int(self.offsets[b]))
        return unpack(words, min(self.block, self.ids - b * self.block))

    def documents(self):
        """Each document's ids, in order."""
        rest, b = np.zeros(0, np.uint64), 0
        for n in self.counts.tolist():
            parts, size = [rest], len(rest)
            while size < n:
                parts.append(self.unpacked(b))
                size += len(parts[-1])
                b += 1
            ids = np.concatenate(parts) if len(parts) > 1 else rest
            yield ids[:n]
            rest = ids[n:]


class Tokens:
    """The tokenizer of one worker.

    Where white space only parts words for it (its splitter drops what lies between
    words, and its merges stay within one), texts are cut at ASCII white space and
    before a mark that ends a word, and each distinct part is encoded once. Parts of
    lower-case Latin letters, which its normaliser and splitter leave as they are,
    go to its merges together and are told apart by the tokens that end a word.
    Any other tokenizer encodes whole texts.
    """

    def __init__(self, model: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        self.end_id = end_id
        told = json.loads(model)
        end = told["model"].get("end_of_word_suffix")
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = bool(end) and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        if self.by_word:
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(end)]] = True
        self.clear()

    def clear(self) -> None:
        self.memo = {b" ": 0}  # no word: the end of a document
        self.first, self.sizes, self.seen = np.array([0]), np.array([1]), np.array([2])
        self.pool = np.array([self.end_id], np.uint32)

    def tidy(self) -> None:
        """Forget the words seen once."""
        keep = self.seen > 1
        sizes = self.sizes[keep]
        if len(sizes) > MEMO // 2 or len(self.pool) > POOL:
            return self.clear()
        self.pool = self.pool[ranges(self.first[keep], sizes)]
        self.memo = dict(zip([w for w, k in zip(self.memo, keep.tolist()) if k], range(len(sizes))))
        self.sizes, self.first = sizes, np.cumsum(sizes) - sizes
        self.seen = np.append(2, np.ones(len(sizes) - 1, np.int64))

    def encoded(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(words, ids, number of ids of each): distinct words in a new order."""
        plain, other = [], []
        for w in words:
            (plain if PLAIN.fullmatch(w) else other).append(w)
        lines = [b" ".join(plain[a:a + 200]).decode() for a in range(0, len(plain), 200)]
        ids = [i for e in self.plain.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids]
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)]
        ids += [i for x in rest for i in x]
        return plain + other, np.array(ids, np.uint32), np.append(sizes, np.array([len(x) for x in rest], np.int64))

    def coded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their end ids, number of ids of each text)."""
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            lists = [[*e.ids, self.end_id] for e in found]
            return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists])
        if len(self.memo) > MEMO or len(self.pool) > POOL:
            self.tidy()
        distinct, each, ends = word_parts(texts)
        at = np.array([self.memo.get(w, -1) for w in distinct], np.int64)
        new = [distinct[i] for i in np.flatnonzero(at < 0).tolist()]
        if new:
            new, ids, sizes = self.encoded(new)
            self.first = np.append(self.first, len(self.pool) + np.cumsum(sizes) - sizes)
            self.sizes = np.append(self.sizes, sizes)
            self.seen = np.append(self.seen, np.zeros(len(new), np.int64))
            self.pool = np.append(self.pool, ids)
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
            missing = np.flatnonzero(at < 0)
            at[missing] = [self.memo[distinct[i]] for i in missing.tolist()]
        at = np.insert(at[each], ends, 0)
        self.seen += np.bincount(at, minlength=len(self.seen))
        sizes = self.sizes[at]
        stops = np.cumsum(sizes)[ends + np.arange(len(ends))]
        return self.pool[ranges(self.first[at], sizes)], np.diff(stops, prepend=0)


def word_parts(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct parts, which of them each part is, number of parts up to the end of
    each text). Parts are parted by ASCII white space; a mark at the end of such a
    part, after a letter a to z, is one of its own."""
    raw = np.frombuffer((b"\n".join(texts) + b"\n").translate(LOWER), np.uint8)
    kind = KIND[raw]
    word = kind > 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[1:-1] |= (kind[1:-1] == 3) & (kind[:-2] == 2) & ~word[2:]
    flat = raw[word]
    offsets = np.append(np.flatnonzero(begins[word]), len(flat)).astype(np.int64)
    parts = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
    stops = np.cumsum([len(t) + 1 for t in texts])
    ends = np.searchsorted(np.flatnonzero(begins), stops)
    return parts.dictionary.to_pylist(), parts.indices.to_numpy(), ends


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] of them), first[1], ..."""
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(first - stops + sizes, sizes)


_TOKENS: dict[bytes, Tokens] = {}


def tokens(model: str, end_id: int) -> Tokens:
    """One tokenizer for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hashlib.sha256(f"{end_id} {model}".encode()).digest()
    if key not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[key] = Tokens(model, end_id)
    return _TOKENS[key]


def in_order(docs: DataFrame, file_bytes: int) -> DataFrame:
    """(doc_id, text) in ascending order, in partitions of about ``file_bytes``.
    Rows of one doc_id, and equal rows, may lie in several."""
    size = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32), F.lit(0))).first()[0]
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("h"),
                       F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("row")]
    return rows.repartitionByRange(int(size // file_bytes) + 1, *order).sortWithinPartitions(*order).select("doc_id", "text")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                 file_bytes: int = FILE_BYTES, block: int = BLOCK) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``path``: data files under
    ``data``, the manifest (file, part, ids, docs, bytes) under ``manifest``."""
    import public_tokenizers

    spark = docs.sparkSession
    python_ready(spark)
    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    data = f"{path.rstrip('/')}/data"

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        coder, writer = None, None
        for batch in batches:
            column = batch.column(1)
            raw, offsets = utf8(column)
            view, ids = memoryview(raw), batch.column(0).to_pylist()
            if writer is None:
                coder = tokens(model.value, end_id)
                where, folder = fs.FileSystem.from_uri(data)
                where.create_dir(folder, recursive=True)
                part = TaskContext.get().partitionId()
                name = f"part-{part:06d}-{uuid.uuid4().hex}.s8b"
                writer = Writer(where.open_output_stream(f"{folder}/{name}"), block)
            for a, b in groups(offsets):
                found, counts = coder.coded([bytes(view[offsets[i]:offsets[i + 1]]) for i in range(a, b)])
                writer.add(list(zip(ids[a:b], counts.tolist(), strict=True)), found)
        if writer is not None:
            writer.close()
            where_bytes = where.get_file_info(f"{folder}/{name}").size
            yield pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int64()), "ids": [writer.ids],
                                              "docs": [len(writer.docs)], "bytes": [where_bytes]})
        release()

    manifest = in_order(docs.select("doc_id", "text"), file_bytes).mapInArrow(
        run, "file string, part bigint, ids bigint, docs bigint, bytes bigint")
    manifest.write.parquet(f"{path.rstrip('/')}/manifest")


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array<bigint>]) of every document
    in the files that the manifest names."""
    python_ready(spark)
    names = ["file", "doc_id", "place", "n_tokens", "ids_crc32"] + ["ids"] * ids
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * ids

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = Reader(content.as_buffer())
                crcs, lists = [], []
                for x in reader.documents():
                    crcs.append(zlib.crc32(x.astype("<u4").tobytes()))
                    if ids:
                        lists.append(x.astype(np.int64))
                n = reader.counts
                columns = [pa.array([file] * len(n), pa.string()), reader.doc_ids, pa.array(np.cumsum(n) - n), pa.array(n),
                           pa.array(crcs, pa.int64())] + [pa.array(lists, types[-1])] * ids
                yield pa.RecordBatch.from_arrays(columns, names)
        release()

    root = path.rstrip("/")
    manifest = spark.read.parquet(f"{root}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids)
    found = (spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(f"{root}/data")
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
             .mapInArrow(run, "file string, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids))
    # ids in all files before: first over groups of 1,024 files, then within them
    files = manifest.select("file", "part", "ids", F.expr("part div 1024").alias("g"))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    whole = files.groupBy("g").agg(F.sum("ids").alias("ids")).select(
        "g", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (files.withColumn("inner", F.coalesce(F.sum("ids").over(inner), F.lit(0))).join(whole, "g")
             .select("file", (F.col("base") + F.col("inner")).alias("base")))
    return found.join(bases, "file").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-token-files-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
