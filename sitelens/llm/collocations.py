"""Operator 12, phrase collocations by relational mining of occurrences.

The occurrence relation of length k holds the place of every occurrence of a
frequent phrase of k words. Each stored row of it is a run of pieces: ``words``
(64-bit word keys in order, 0 between pieces) and ``pos`` (the ascending places
in ``words`` where the phrases begin). From one length to the next:

* merge-join by piece and adjacent position: a phrase of k + 1 words begins where
  a frequent phrase of k words begins and another begins at the next place of the
  same piece (one merge of two sorted lists, in the tasks);
* group-count: phrases are counted in the tasks, then summed by Spark; of ``HASHED``
  words and more, only those whose hash is frequent: all are counted by hash first;
* semi-join: the occurrences of frequent phrases are stored, sorted as before, as
  the relation that the next length starts from, without words that none covers.
  The tasks know the frequent phrases from a table of at most ``MOST_BITS`` bits;
  it lets every frequent phrase through and a few others, which the next count
  drops, so the counts are exact at any size.

Scores, the choice of cuts and the drops are exact Spark joins of the counts.
A word key is a seeded hash of language and word. All words are grouped by key,
and if two share one the relation is built again with the next seed.

Defined cases: a null language is ``und``, a null or empty text has no words;
texts without separators are one piece however long; repeated rows count again;
ties in score fall to the smallest cut, in rank to the larger count, then the
smaller phrase in UTF-8 byte order; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm.common import forget, groups, python_ready, release, stored, table, utf8

LEAST, LONGEST, TOP = 30, 4, 2_000
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + SEPARATORS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(SEPARATORS))
HELD = 60_000  # distinct words that a task counts before it hands them on
PLACES = 200_000  # occurrences counted together in a task
TASK_PLACES = 4_000_000  # occurrences of frequent phrases counted by one task, about
RUN_BYTES = 1 << 20  # bytes of text in a run of pieces, or one longer text
MOST_BITS = 1 << 27
HASHED = 4  # words; shorter phrases fill most tasks' counts, and another reading of all places costs more than it saves
MOST_HASHES, BLOCK = 1 << 23, 1 << 14  # counts by hash in a task, and those of a row
RELATION = "words array<bigint>, pos array<int>"


class Words:
    """Word keys and counts of one task, by language."""

    def __init__(self, seed: int, hash_bits: int = 64):
        self.seed, self.hash_bits, self.size = seed, hash_bits, 0
        self.known: dict[str, dict[bytes, int]] = {}
        self.keys: dict[str, list[int]] = {}
        self.counts: dict[str, np.ndarray] = {}

    def coded(self, lang: str, data: bytes) -> np.ndarray:
        """The word keys of texts joined by a separator, 0 after each piece."""
        data = data.translate(PLAIN)
        found = data.split()
        if not found:
            return np.zeros(0, np.int64)
        known, keys = self.known.setdefault(lang, {}), self.keys.setdefault(lang, [])
        head = lang.encode() + b"\0"
        for w in set(found).difference(known):
            known[w] = len(keys)
            keys.append((xxhash.xxh3_64_intdigest(head + w, self.seed) >> (64 - self.hash_bits)) - (1 << self.hash_bits - 1) or 1)
        at = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        before = self.counts.get(lang, np.zeros(0, np.int64))
        counts = np.bincount(at, minlength=len(keys))
        counts[:len(before)] += before
        self.counts[lang] = counts
        self.size = sum(map(len, self.keys.values()))
        # words begin where a byte that isn't white space follows one that is
        raw = np.frombuffer(data, np.uint8)
        word = (raw != 32) & (raw != 10)
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        piece = np.cumsum(raw == 10, dtype=np.int64)[begins]
        later = np.zeros(len(piece), np.int64)
        later[1:] = np.cumsum(piece[1:] != piece[:-1])
        out = np.zeros(len(piece) + int(later[-1]) + 1, np.int64)
        out[np.arange(len(piece)) + later] = np.array(keys, np.int64)[at]
        return out

    def flushed(self):
        """(lang, words, keys, counts) so far, and a fresh start."""
        for lang, known in self.known.items():
            yield lang, [w.decode() for w in known], self.keys[lang], self.counts[lang]
        self.__init__(self.seed, self.hash_bits)


def occurrences(docs: DataFrame, seed: int, hash_bits: int = 64) -> DataFrame:
    """Rows of two kinds: (words) of a run of pieces, and (lang, new, keys, counts)
    with the words that a task has met. Fewer ``hash_bits`` make keys collide, for
    tests."""
    python_ready(docs.sparkSession)
    schema = "words array<bigint>, lang string, new array<string>, keys array<bigint>, counts array<bigint>"
    types = [pa.list_(pa.int64()), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["words", "lang", "new", "keys", "counts"]

    def rows(values):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    def run(batches):
        words = Words(seed, hash_bits)
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            data, offsets = utf8(texts)
            view = memoryview(data)
            for a, b in groups(offsets, RUN_BYTES):
                parts: dict[str, list] = {}
                for i in range(a, b):
                    if offsets[i + 1] > offsets[i]:
                        parts.setdefault(langs[i], []).append(view[offsets[i]:offsets[i + 1]])
                for lang, part in parts.items():
                    coded = words.coded(lang, b"\n".join(part))
                    if len(coded):
                        yield rows((coded, None, None, None, None))
                if words.size > HELD:
                    yield from (rows((None, *x)) for x in words.flushed())
                    release()
        yield from (rows((None, *x)) for x in words.flushed())
        release()

    return docs.select(F.coalesce("lang", F.lit("und")), "text").mapInArrow(run, schema)


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number for each row of word keys."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def frequent_bits(counts: DataFrame, k: int) -> np.ndarray:
    """A bit table with every phrase of ``counts`` (w1, ..., wk) in it: 16 bits to a
    phrase, up to ``MOST_BITS``. Put together by Spark, 8 bytes a row."""
    bits = 1 << 16
    n = counts.count()
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    names = [f"w{i + 1}" for i in range(k)]

    def run(batches):
        for batch in batches:
            at = mixed([c.to_numpy() for c in batch.columns]) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int64)),
                 pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["place", "bits"])

    found = (counts.select(*names).mapInArrow(run, "place bigint, bits bigint")
             .groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow())
    out = np.zeros(bits // 64, np.uint64)
    out[found["place"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def member(bits: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    at = mixed(columns) & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets - offsets[0]


def longer(pos: np.ndarray) -> np.ndarray:
    """Merge-join by adjacent position: the places where one frequent phrase
    begins and another at the next place of the same piece (borders are no place)."""
    return pos[:-1][pos[1:] == pos[:-1] + 1]


def columns_at(words: np.ndarray, pos: np.ndarray, k: int) -> list[np.ndarray]:
    return [words[pos + i] for i in range(k)]


def places(batch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, pos) of a batch of the relation of length ``k``, rows joined."""
    words, ends = flat(batch.column(0))
    if k == 0:  # the stored words themselves: each is a place
        return words, np.flatnonzero(words)
    pos, lists = flat(batch.column(1))
    return words, pos.astype(np.int64) + np.repeat(ends[:-1].astype(np.int64), np.diff(lists))


def grouped_keys(parts: list[tuple[list[np.ndarray], np.ndarray | None]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns with their counts: (columns, counts; None: one each)."""
    columns = [np.concatenate(c) for c in zip(*[c for c, _ in parts])]
    counts = np.concatenate([np.ones(len(c[0]), np.int64) if n is None else n for c, n in parts])
    order = np.argsort(mixed(columns))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(counts[order], first) if len(first) else counts


def frequent_hashes(relation: DataFrame, k: int, least: int) -> np.ndarray:
    """A bit table with every phrase of ``k`` words that ``relation`` has ``least``
    times, and few others: of the hashes that all their phrases have so often together.
    A task's counts go up to ``least``, which tells as much of their sum."""
    total = relation.agg(F.coalesce(F.sum(F.size("pos")), F.lit(0))).first()[0]
    bits = 1 << 16
    while bits < min(total, MOST_HASHES):
        bits *= 2
    block, most = min(BLOCK, bits), min(least, 255)

    def run(batches):
        counts = np.zeros(bits, np.int32)
        for batch in batches:
            words, pos = places(batch, k - 2)
            np.add.at(counts, (mixed(columns_at(words, longer(pos), k)) & np.uint64(bits - 1)).astype(np.int64), 1)
        counts = np.minimum(counts, most).astype(np.uint8)
        rows = [(i // block, counts[i:i + block].tobytes()) for i in range(0, bits, block) if counts[i:i + block].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.binary())],
                                         ["place", "counts"])
        release()

    def summed(batches):
        for batch in batches:
            out = [sum(np.frombuffer(c, np.uint8).astype(np.int64) for c in parts) >= most for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([np.packbits(x, bitorder="little").tobytes() for x in out], pa.binary())], ["place", "bits"])

    tasks = relation.coalesce(int(total // TASK_PLACES) + 1).mapInArrow(run, "place bigint, counts binary")
    found = (tasks.groupBy("place").agg(F.collect_list("counts").alias("counts"))
             .mapInArrow(summed, "place bigint, bits binary").toArrow())
    out = np.zeros((bits // block, block // 8), np.uint8)
    for place, row in zip(found["place"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[place] = np.frombuffer(row, np.uint8)
    return out.reshape(-1).view(np.uint64)


def counted(relation: DataFrame, k: int, bits: np.ndarray | None) -> DataFrame:
    """(w1, ..., wk, n): the phrases of ``k`` words that the frequent ones of
    ``k - 1`` words in ``relation`` make, with their counts in all. For pairs the
    relation is that of the words, of which ``bits`` tells the frequent; from
    ``HASHED`` words on it tells the phrases to count."""
    shared = relation.sparkSession.sparkContext.broadcast(bits)
    names = [f"w{i + 1}" for i in range(k)]

    def run(batches):
        # places are grouped a stretch at a time, and the groups of the stretches
        # together until they are many
        held, size, groups, many = [], 0, [], 0
        for batch in batches:
            words, pos = places(batch, k - 2)
            if k == 2:
                pos = pos[member(shared.value, [words[pos]])]
            pos = longer(pos)
            if k >= HASHED:
                pos = pos[member(shared.value, columns_at(words, pos, k))]
            held.append((columns_at(words, pos, k), None))
            size += len(held[-1][0][0])
            if size > PLACES:
                groups.append(grouped_keys(held))
                many += len(groups[-1][1])
                held, size = [], 0
                release()
                if many > PLACES:
                    groups = [grouped_keys(groups)]
                    many = len(groups[0][1])
                    if many > PLACES // 2:
                        yield out(*groups[0])
                        groups, many = [], 0
        if held or groups:
            yield out(*grouped_keys([*groups, *([grouped_keys(held)] if held else [])]))
        held = groups = words = pos = None
        release()

    def out(keys, n):
        return pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(n)], [*names, "n"])

    schema = ", ".join(f"{w} bigint" for w in names) + ", n bigint"
    if k > 2:  # what is left of a large corpus may be little: few tasks count more of it together
        total = relation.agg(F.coalesce(F.sum(F.size("pos")), F.lit(0))).first()[0]
        relation = relation.coalesce(int(total // TASK_PLACES) + 1)
    return relation.mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def semi_joined(relation: DataFrame, k: int, before: np.ndarray | None, bits: np.ndarray) -> DataFrame:
    """The relation of length ``k`` from that of ``k - 1``: the places of phrases
    that ``bits`` holds, and the words that they cover."""
    shared = relation.sparkSession.sparkContext.broadcast((before, bits))
    names = ["words", "pos"]

    def run(batches):
        earlier, now = shared.value
        for batch in batches:
            out = [[], []]
            for row in range(batch.num_rows):
                words, pos = places(batch.slice(row, 1), k - 2)
                if k == 2:
                    pos = pos[member(earlier, [words[pos]])]
                pos = longer(pos)
                pos = pos[member(now, columns_at(words, pos, k))]
                if not len(pos):
                    continue
                covered = np.zeros(len(words) + 1, bool)
                for i in range(k):
                    covered[pos + i] = True
                covered[1:] |= covered[:-1]  # and the place after, which is a border if no phrase covers it
                keep = np.flatnonzero(covered)
                place = np.cumsum(covered) - 1
                own = np.zeros(len(words) + 1, bool)
                for i in range(k):
                    own[pos + i] = True
                out[0].append(np.where(own[keep], np.append(words, 0)[keep], 0))
                out[1].append(place[pos].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.list_(pa.int32()))], names)
        release()

    return relation.mapInArrow(run, RELATION)


def word_counts(found: DataFrame, name: str) -> DataFrame:
    """(key, lang, word, n) of every word of ``occurrences``."""
    rows = found.where("new IS NOT NULL").select(
        "lang", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("new").alias("word"), F.col("counts").alias("c"))))
    return stored(rows.groupBy("key", "lang", "word").agg(F.sum("c").alias("n")), name)


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, hash_bits: int = 64) -> tuple[DataFrame, list[DataFrame]]:
    """(all words, [frequent phrases of 1, 2, ... words]): the words as (key,
    lang, word, n), the phrases as (w1, ..., wk, n)."""
    seed = 0
    while True:
        found = stored(occurrences(docs, seed, hash_bits), "occurrences")
        words = word_counts(found, "words")
        if words.groupBy("key").count().where("count > 1").isEmpty():
            break
        forget(found)
        forget(words)
        seed += 1
    relation = found.where("words IS NOT NULL").select("words")
    frequent = [words.where(F.col("n") >= least).select(F.col("key").alias("w1"), "n")]
    bits, before, previous = frequent_bits(frequent[0], 1), None, found
    for k in range(2, longest + 1):
        told = bits if k == 2 else frequent_hashes(relation, k, least) if k >= HASHED else None
        frequent.append(stored(counted(relation, k, told).where(F.col("n") >= least), f"phrases-{k}"))
        if k < longest:
            before, bits = bits, frequent_bits(frequent[-1], k)
            relation = stored(semi_joined(relation, k, before if k == 2 else None, bits), f"occurrences-{k}")
            forget(previous)
            previous = relation
    forget(previous)
    return words, frequent


def scored(frequent: list[DataFrame], share: int = 80) -> DataFrame:
    """(phrase array of keys, a, l, r, score) of the candidates that no longer one
    makes up: those with ``100 f(longer) >= share a`` go."""
    def phrases(k):
        return frequent[k - 1].select(F.array(*[f"w{i + 1}" for i in range(k)]).alias("phrase"), F.col("n").alias("f"))

    longest = len(frequent)
    parts = phrases(1)
    candidates = phrases(2)
    for k in range(2, longest):
        parts = parts.unionByName(phrases(k))
        candidates = candidates.unionByName(phrases(k + 1))
    size = F.size("phrase")
    inner = candidates.where(size > 2).select("f", F.explode(F.expr(
        "flatten(transform(sequence(2, size(phrase) - 1), n -> transform(sequence(1, size(phrase) - n + 1), i -> slice(phrase, i, n))))"
    )).alias("phrase")).groupBy("phrase").agg(F.max("f").alias("outer"))
    kept = candidates.join(inner, "phrase", "left").where(
        F.col("outer").isNull() | (F.lit(100) * F.col("outer") < F.lit(share) * F.col("f"))).select("phrase", F.col("f").alias("a"))
    cuts = kept.select("phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "phrase", "a", "k", F.expr("slice(phrase, 1, k)").alias("first"), F.expr("slice(phrase, k + 1, size(phrase) - k)").alias("rest"))
    both = (cuts.join(parts.select(F.col("phrase").alias("first"), F.col("f").alias("l")), "first")
            .join(parts.select(F.col("phrase").alias("rest"), F.col("f").alias("r")), "rest"))
    score = F.expr("cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div cast(l + r as decimal(19,0)) as bigint)")
    return both.withColumn("score", score).groupBy("phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("phrase", "a", "cut.l", "cut.r", "cut.score")


def ranked(words: DataFrame, found: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` of each language.
    Each of 64 parts of a language gives its own first ones, ties and all, before
    a language is ranked as a whole; phrases are spelt out for those alone."""
    sizes = words.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = words.select(F.col("key").alias("head"), "lang")
    found = found.withColumn("head", F.col("phrase")[0]).join(langs, "head")
    order = [F.desc("score"), F.desc("a")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    first = found.withColumn("place", F.rank().over(part)).where(F.col("place") <= top)
    first = first.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top)
    first = stored(first.select("lang", "phrase", "a", "l", "r", "score"), "first")
    spelt = (first.select("phrase", F.posexplode("phrase").alias("i", "key")).join(words.select("key", "word"), "key")
             .groupBy("phrase").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))),
                                                            lambda x: x["word"]), " ").alias("text")))
    whole = Window.partitionBy("lang").orderBy(*order, "text")
    return (first.join(spelt, "phrase").withColumn("rank", F.row_number().over(whole).cast("long"))
            .where(F.col("rank") <= top).join(sizes, "lang")
            .select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", F.col("total").alias("n"), "score"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = 80) -> DataFrame:
    """The first ``top`` phrases of each language of ``docs`` (lang, text)."""
    words, frequent = mined(docs, least, longest)
    return ranked(words, scored(frequent, share), top)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
pieces AS (
  SELECT d, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS i
  FROM (SELECT d, lang, string_split_regex(t, '[.,;:!?\n\x0B\f\r]') AS p FROM docs)),
words AS (
  SELECT d, i, lang, unnest(w) AS w, generate_subscripts(w, 1) AS pos
  FROM (SELECT d, i, lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces)),
grams AS (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
  FROM words WINDOW o AS (PARTITION BY d, i ORDER BY pos)),
phrases AS (
  SELECT lang, [w1] AS p, count(*) AS f FROM grams GROUP BY lang, w1
  UNION ALL SELECT lang, [w1, w2], count(*) FROM grams WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM grams WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM grams WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4),
candidates AS (SELECT lang, p, f AS a FROM phrases WHERE len(p) > 1 AND f >= 30),
inside AS (
  SELECT lang, p[i:i + n - 1] AS p, max(a) AS longer
  FROM candidates, range(1, 4) AS s(i), range(2, 4) AS t(n) WHERE n < len(candidates.p) AND i + n - 1 <= len(candidates.p)
  GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR 100 * longer < 80 * a),
cuts AS (
  SELECT lang, p, a, k, p[1:k] AS first, p[k + 1:len(p)] AS rest FROM kept, range(1, 4) AS s(k) WHERE k < len(p)),
scores AS (
  SELECT cuts.*, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM cuts JOIN phrases x ON x.lang = cuts.lang AND x.p = first JOIN phrases y ON y.lang = cuts.lang AND y.p = rest),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
       array_to_string(p, ' ') AS phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) QUALIFY rank <= 2000
"""
