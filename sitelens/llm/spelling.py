"""Operator 13, spelling variant grouping with a variable-length gram index.

Words are the runs of letters of all texts, counted, at least ``least_chars``
long and seen at least twice. Two words are near at edit distance one. The near
pairs are found through grams of variable length:

* A dictionary of grams is counted over the words. A gram of ``qmin`` letters is
  always in it, a longer one only if the gram that it extends is frequent, that
  is, makes up more than 1 / ``FREQUENT`` of all grams of its length. At each
  place of a word the longest gram is taken that this allows. What is taken there
  depends on the gram's own letters alone, and on the word's end where the end
  stopped it. (Grams inside others are kept: without them a gram would also
  depend on the letters before it.)
* An edit at a place affects the grams over it; all others are in both words,
  equally far from the same end. The most that one edit can affect is the word's
  bound: near words share all but so many of their grams.
* The index lists, for each edit a word can undergo, the word under the rarest
  ``SIGNATURE`` of its unaffected grams. Two near words choose the same there, so
  they meet in a list. Lists are merged by joining them on the key, the number of
  shared grams (as bits, of which an affected gram takes at most one) is held
  against both words' bounds, and edit distance verifies the rest.

A word's form is its near word of largest count, if that is at least ``RATIO``
times its own; roots follow forms to the last, by pointer doubling.

Defined cases: null and empty texts have no words; a null doc_id is written as
empty text in the hash that decides where letters are lost; repeated rows count
again; ties between forms fall to the smallest in code-point order; an empty table
gives no rows; other columns are not read.

Bounds: the dictionary sent to the tasks has at most 90^2 grams of two letters
and, for each length beyond, 90 extensions of at most ``FREQUENT`` frequent grams.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import forget, groups, python_ready, release, stored, table, utf8

LEAST_CHARS, LEAST_SEEN, RATIO, LOSS = 7, 2, 10, 31
QMIN, QMAX, FREQUENT, SIGNATURE = 2, 4, 2_000, 3
SHARED = 56  # bits that stand for the grams of a word, under 64 by six for its bound and two more
HELD = 400_000  # words that a task counts before it hands them on
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lossy_words(doc_id: int | None, text: str, least: int = LEAST_CHARS, loss: int = LOSS) -> Counter:
    """The words of one text with their counts: runs of letters, A-Z lower-cased,
    one letter lost where the hash of document and run says so."""
    runs = Counter(re.findall(rf"[A-Za-zÀ-ÿ]{{{least},}}", text.translate(LOWER)))
    prefix, out = f"{'' if doc_id is None else doc_id}:", Counter()
    for run, n in runs.items():
        h = zlib.crc32((prefix + run).encode())
        if h % loss == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
            if len(run) < least:
                continue
        out[run] += n
    return out


def counted_words(docs: DataFrame, least: int = LEAST_CHARS, loss: int = LOSS) -> DataFrame:
    """(word, n) over the whole table, summed in the tasks before the shuffle."""
    python_ready(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            _, offsets = utf8(texts)
            for a, b in groups(offsets):
                for i, t in zip(ids.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist(), strict=True):
                    if t:
                        held.update(lossy_words(i, t, least, loss))
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()
        release()

    found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, frequent: int = FREQUENT) -> dict[str, tuple[int, bool]]:
    """gram -> (count, whether longer grams replace it), pruned by frequency."""
    size = F.length("word")
    grams = words.select(F.explode(F.flatten(F.transform(
        F.sequence(F.lit(qmin), F.lit(qmax)),
        lambda q: F.transform(F.sequence(F.lit(1), F.greatest(size - q + 1, F.lit(1))),
                              lambda p: F.col("word").substr(p, q.cast("int")))))).alias("gram"))
    counts = stored(grams.groupBy("gram").agg(F.count("*").alias("n")), "grams")
    totals = counts.groupBy(F.length("gram").alias("q")).agg(F.sum("n").alias("total"))
    marked = (counts.withColumn("q", F.length("gram")).join(F.broadcast(totals), "q")
              .withColumn("often", (F.col("n") * frequent > F.col("total")) & (F.col("q") < qmax)))
    marked = stored(marked.select("gram", "q", "n", "often"), "gram-counts")
    kept = marked.where(F.col("q") == qmin)
    level = kept
    for q in range(qmin + 1, qmax + 1):
        parents = level.where("often").select(F.col("gram").alias("parent"))
        level = marked.where(F.col("q") == q).join(parents, F.col("gram").substr(1, q - 1) == F.col("parent"), "left_semi")
        kept = kept.unionByName(level)
    found = {r.gram: (r.n, r.often) for r in kept.toLocalIterator()}
    forget(counts)
    forget(marked)
    return found


def decompose(word: str, grams: dict[str, tuple[int, bool]], qmin: int = QMIN) -> list[tuple[int, str, int, int]]:
    """(place, gram, last letter it depends on, count) at every place. A gram that
    only the word's end stopped depends on the end, the place after the letters."""
    out, n = [], len(word)
    for p in range(n - qmin + 1):
        e = p + qmin
        gram = word[p:e]
        count, longer = grams[gram]
        while longer and e < n:
            e += 1
            gram = word[p:e]
            count, longer = grams[gram]
        out.append((p, gram, n if longer else e - 1, count))
    return out


def affected_bound(parts: list[tuple[int, str, int, int]], n: int) -> int:
    """The most grams that one edit of a word of ``n`` letters can affect."""
    cover = [0] * (n + 2)
    for p, _, last, _ in parts:
        cover[p] += 1
        cover[last + 1] -= 1
    worst = now = 0
    for c in cover[:-1]:
        now += c
        worst = max(worst, now)
    return worst


def signatures(word: str, parts: list[tuple[int, str, int, int]], size: int = SIGNATURE) -> tuple[set[bytes], set[bytes]]:
    """The lists of a word: under each letter's change or loss, and under a letter
    put in at each place. The length in a key is the longer word's."""
    n = len(word)
    rare = sorted((count, gram, p, last) for p, gram, last, count in parts)
    changed, grown = set(), set()
    for own, first, length, keys in ((1, 0, n, changed), (0, 1, n + 1, grown)):
        for i in range(n + first):
            # unaffected: grams that end before place i or begin after the edit
            key = [str(length)]
            for _, gram, p, last in rare:
                if last < i:
                    key.append(f"{gram}{p}")
                elif p >= i + own:
                    key.append(f"{gram}-{n - p}")
                else:
                    continue
                if len(key) > size:
                    break
            keys.add(" ".join(sorted(key)))
    return changed, grown


def gram_index(words: DataFrame, grams: dict[str, tuple[int, bool]], qmin: int = QMIN, size: int = SIGNATURE) -> DataFrame:
    """(key, word, n, meta): one row for each list a word is in. ``meta`` packs a
    bit for each of its grams (by number modulo ``SHARED``), its bound, and whether
    the list is of a letter put in."""
    shared = words.sparkSession.sparkContext.broadcast((grams, {g: i % SHARED for i, g in enumerate(sorted(grams))}))

    def run(batches):
        dictionary, number = shared.value
        for batch in batches:
            keys, at, meta = [], [], []
            for row, word in enumerate(batch.column(0).to_pylist()):
                parts = decompose(word, dictionary, qmin)
                own = 0
                for _, g, _, _ in parts:
                    own |= 1 << number[g]
                own |= min(affected_bound(parts, len(word)), SHARED) << SHARED
                for kind, found in enumerate(signatures(word, parts, size)):
                    keys += [xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in found]
                    meta += [own | kind << 62] * len(found)
                    at += [row] * len(found)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(meta, pa.int64())],
                ["key", "word", "n", "meta"])
        release()

    return words.select("word", "n").mapInArrow(run, "key bigint, word string, n bigint, meta bigint")


def near_pairs(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, frequent: int = FREQUENT,
               size: int = SIGNATURE) -> DataFrame:
    """(word, n, other, other_n): every pair of distinct words at distance one,
    both ways round. ``words`` are distinct (word, n) of at least qmin letters."""
    index = gram_index(words, gram_dictionary(words, qmin, qmax, frequent), qmin, size)
    # one condition over both sides, so that both are the same shuffled lists
    bits, bound = f"({{0}}.meta & {(1 << SHARED) - 1})", f"(({{0}}.meta >> {SHARED}) & 63)"
    need = f"bit_count{bits} - {bound}"
    met = index.alias("a").join(index.alias("b"), F.expr(
        "a.key = b.key AND (a.meta >> 62 < b.meta >> 62 OR (a.meta >> 62 = 0 AND b.meta >> 62 = 0 AND a.word < b.word))"
        f" AND bit_count({bits.format('a')} & {bits.format('b')}) >= greatest({need.format('a')}, {need.format('b')})"
        " AND levenshtein(a.word, b.word, 1) = 1"
        " AND length(a.word) - length(b.word) = (b.meta >> 62)"))
    pairs = met.selectExpr("a.word", "a.n", "b.word AS other", "b.n AS other_n").dropDuplicates(["word", "other"])
    both = F.array(F.struct("word", "n", "other", "other_n"),
                   F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"),
                            F.col("n").alias("other_n")))
    return pairs.select(F.inline(both))


def rooted(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with ``root``, by doubling: a word's target is
    replaced by that target's own target until nothing changes. Forms lead to ever
    larger counts, so there are no circles, and few rounds."""
    step = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not step.where("moved").isEmpty():
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(step.drop("moved").join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(step)
        step = after
    return forms.join(step.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, ratio: int = RATIO, **how) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of ``docs``."""
    words = stored(counted_words(docs).where(F.col("n") >= LEAST_SEEN), "words")
    return grouped(words, ratio, **how)


def grouped(words: DataFrame, ratio: int = RATIO, **how) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct (word, n) rows."""
    # the smallest of (-count, word) is the largest count, then the smallest word
    near = near_pairs(words, **how).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    best = F.when(-F.col("best.minus") >= ratio * F.col("n"), F.col("best"))
    forms = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        best.getField("other").alias("form"), (-best.getField("minus")).alias("form_n")), "forms")
    return rooted(forms)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents")).select(
        "word", "form", "root", "n", "n_near", "form_n")
