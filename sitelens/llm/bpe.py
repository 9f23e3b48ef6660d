"""Operator 6, byte-level BPE encoding and decoding by recursive DuckDB queries.

Each partition splits its texts by the pattern, a stretch of ``HOLD`` bytes of text
at a time, and encodes the distinct pieces of a stretch that it doesn't remember in
one query, since a round of the recursion costs much the same for few pieces as for
many. A piece's bytes become (piece, position, token) rows in an in-process
DuckDB; a recursive query joins neighbours with the merge table and contracts
each piece's leftmost pair of least rank until none is left. Decoding joins the
ids with the vocabulary and puts the bytes together by an ordered aggregation.

As the library does, a piece that is itself in the vocabulary is that token.
Every round passes over all tokens that are left, so the query's cost grows with
the square of a piece's length. Pieces of over ``LONG`` bytes are therefore merged by
the same rule with a heap, n log n; both give the same ids for any piece.

Defined cases: null and empty texts have no ids; any text is whole, however long;
repeated rows are encoded each; an empty table gives no rows. Other columns are
not read. The rank file is read on the driver and sent with the task (its size is
the vocabulary's).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from sitelens.llm.common import add_columns, groups, python_ready, release, table, utf8

LONG, SPAN = 64, 1 << 20  # SPAN: over any position within a piece
HOLD = 8 << 20  # bytes of text whose pieces are encoded together
PIECE_BYTES = 1 << 20  # bytes of pieces encoded by one recursive query
MEMO = 100_000  # pieces used lately that a worker remembers, and as many before them
TOKENS = 1 << 20  # tokens decoded together
# The public pattern for texts of Latin-1 characters, where it needs no Unicode
# classes: these are the letters, numbers and white space below U+0100.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
                   f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")

ENCODE_SQL = f"""
WITH RECURSIVE step(done, k, t) AS (
  SELECT false, k, t FROM start
  UNION ALL
  (WITH live AS (SELECT k, t FROM step WHERE NOT done),
        pairs AS (SELECT k, t, lead(k) OVER (ORDER BY k) AS q, lead(t) OVER (ORDER BY k) AS u FROM live),
        best AS (SELECT k // {SPAN} AS w, min(m::BIGINT * {SPAN} + k % {SPAN}) AS b,
                        arg_min(q, m::BIGINT * {SPAN} + k % {SPAN}) AS q
                 FROM pairs JOIN merges ON t = l AND u = r WHERE k // {SPAN} = q // {SPAN} GROUP BY 1)
   SELECT b IS NULL, k, CASE WHEN k % {SPAN} = b % {SPAN} THEN (b // {SPAN})::INT ELSE t END
   FROM live LEFT JOIN best ON k // {SPAN} = w WHERE b IS NULL OR k <> q))
SELECT k // {SPAN} AS w, t FROM step WHERE done ORDER BY k
"""
DECODE_SQL = """
SELECT w, string_agg(hex, '' ORDER BY pos) AS hex FROM ids JOIN vocabulary USING (t) GROUP BY w
"""


class Numbered(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Coder:
    """Ranks, merge table and vocabulary of one worker."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.findall = regex.compile(pattern).findall
        self.latin = LATIN.findall if pattern == public_pattern() else None
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items()
                  for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        merges = pa.table(np.array(merges, np.int32).reshape(-1, 3).T.tolist(), ["l", "r", "m"])  # noqa: F841
        vocabulary = pa.table({"t": list(self.ranks.values()), "hex": [t.hex() for t in self.ranks]})  # noqa: F841
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self.db.execute("CREATE TABLE merges AS SELECT l::INT AS l, r::INT AS r, m::INT AS m FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT t::INT AS t, hex FROM vocabulary")
        self.memo: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def split(self, text: str) -> list[str]:
        if self.latin:
            try:
                text.encode("latin-1")
                return self.latin(text)
            except UnicodeEncodeError:
                pass
        return self.findall(text)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out = [[self.ranks[p]] if p in self.ranks else merged(p, self.ranks) if len(p) > LONG else [] for p in pieces]
        todo = [i for i, ids in enumerate(out) if not ids and pieces[i]]
        if todo:
            sizes = np.array([len(pieces[i]) for i in todo])
            first = np.cumsum(sizes) - sizes
            place = np.arange(sizes.sum()) - np.repeat(first, sizes)
            tokens = self.byte_id[np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)]
            start = pa.table({"k": np.repeat(np.arange(len(todo)), sizes) * SPAN + place, "t": tokens})  # noqa: F841
            found = self.db.sql(ENCODE_SQL).to_arrow_table()
            w, ids = found["w"].to_numpy(), found["t"].to_numpy()
            ends = np.searchsorted(w, np.arange(len(todo)), "right").tolist()
            ids, a = ids.tolist(), 0
            for i, b in zip(todo, ends, strict=True):
                out[i], a = ids[a:b], b
        return out

    def decode(self, lists: list[list[int]]) -> list[bytes]:
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.array([t for x in lists for t in x], np.int32)
        ids = pa.table({"w": np.repeat(np.arange(len(lists)), sizes), "pos": np.arange(len(flat)), "t": flat})  # noqa: F841
        if not len(flat):
            return [b""] * len(lists)
        out = [b""] * len(lists)
        for w, text in self.db.sql(DECODE_SQL).fetchall():
            out[w] = bytes.fromhex(text)
        return out

    def coded(self, texts: list[str]):
        """(pieces of each text by number, ids of each number as decimal text, bytes
        decoded from them)."""
        numbers = Numbered()
        lists = [array("i", map(numbers.__getitem__, self.split(t))) for t in texts]
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        new, size = [], 0
        for p in numbers:
            if p not in self.memo:
                if p in self.older:
                    self.memo[p] = self.older[p]
                    continue
                new.append(p)
                size += len(p) if p.isascii() else len(p.encode())
                if size > PIECE_BYTES:
                    self.learn(new)
                    new, size = [], 0
        self.learn(new)
        found = [self.memo[p] for p in numbers]
        return lists, [csv for csv, _ in found], [back for _, back in found]

    def learn(self, pieces: list[str]) -> None:
        ids = self.encode([p.encode() for p in pieces])
        self.memo.update(zip(pieces, zip([",".join(map(str, x)) for x in ids], self.decode(ids))))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction for one long piece, with a heap of its pairs."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at each place
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has changed since
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[piece[i:end[i]]] for i in range(n) if alive[i]]


_CODERS: dict[tuple, Coder] = {}


def coder(ranks: bytes, pattern: str) -> Coder:
    """One coder for each worker process."""
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(ranks, pattern)
    return _CODERS[key]


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """(rank file, pattern); by default the many-language vocabulary."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), pattern or public_pattern()


def mapped(docs: DataFrame, schema: str, row, path: str | None, pattern: str | None) -> DataFrame:
    """doc_id and the columns that ``row(csvs, backs)`` gives for each text, from its
    pieces' ids and decoded bytes in order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    python_ready(docs.sparkSession)
    ranks, pattern = vocabulary(path, pattern)
    docs = docs.select("doc_id", "text")
    out = StructType([docs.schema["doc_id"], *_parse_datatype_string(schema).fields])
    fields = list(to_arrow_schema(out))

    def finished(held):
        lists, csvs, backs = coder(ranks, pattern).coded([t or "" for _, texts in held for t in texts.to_pylist()])
        lists = iter(lists)
        for ids, texts in held:
            _, offsets = utf8(texts)
            for a, b in groups(offsets):
                rows = [row([csvs[i] for i in x], [backs[i] for i in x]) for _, x in zip(range(b - a), lists)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), *[pa.array(x, f.type) for x, f in zip(zip(*rows), fields[1:], strict=True)]],
                    [f.name for f in fields])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0), batch.column(1)))
                size += batch.column(1).nbytes
            if size > HOLD:
                yield from finished(held)
                held, size = [], 0
        if held:
            yield from finished(held)
        coder(ranks, pattern).older = {}  # the worker stays for other stages
        release()

    return docs.mapInArrow(run, out)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>)."""

    def ids(csvs, backs):
        return (numbers_of(",".join(csvs)),)

    return mapped(docs, "ids array<int>", ids, path, pattern)


def numbers_of(csv: str) -> np.ndarray:
    return np.fromstring(csv, np.int32, sep=",") if csv else np.zeros(0, np.int32)


def decode(rows: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, decoded binary) of rows with doc_id and ids (null: none)."""
    python_ready(rows.sparkSession)
    ranks, pattern = vocabulary(path, pattern)

    def make(batch):
        lists = batch.column(batch.schema.get_field_index("ids")).to_pylist()
        c, out, a = coder(ranks, pattern), [], 0
        while a < len(lists):
            b, n = a, 0
            while b < len(lists) and (b == a or n + len(lists[b] or ()) <= TOKENS):
                n += len(lists[b] or ())
                b += 1
            out += c.decode([x or [] for x in lists[a:b]])
            a = b
        return [pa.array(out, pa.binary())]

    return add_columns(rows.select("doc_id", "ids"), make, "decoded binary", drop=("ids",))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from
    the ids, piece by piece in order. With ``ids`` also the array of ids."""
    def row(csvs, backs):
        csv = ",".join(csvs)
        decoded = hashlib.sha256(b"".join(backs)).hexdigest()
        out = csv.count(",") + 1 if csv else 0, hashlib.sha256(csv.encode()).hexdigest(), decoded
        return (*out, numbers_of(csv)) if ids else out

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return mapped(docs, schema + ", ids array<int>" * ids, row, path, pattern)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
