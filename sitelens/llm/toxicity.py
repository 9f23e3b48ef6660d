"""Operator 3, toxicity by maximum-scoring segments of token log-odds.

Learning (labelled rows that are not held out, a sample of at most ``SAMPLE`` of
them by hash): each word's toxic and clean documents are counted, once for each
distinct text, and summed over the prefixes of 3 to 9 letters. A node's toxic
share has a Dirichlet prior of strength ``PRIOR`` at its parent's share, so a
rare or unseen word falls back to its beginning, and at last to the whole
sample. Every node of at least ``LEAST`` documents is kept, as a 64-bit hash with
two counts (16 bytes). A token's score is the log-odds of its deepest known node against the
whole sample, less a drift: of ``DRIFTS``, the one under which the sample's rows, each
scored without its own counts, are told apart best (the least drift within one
standard error of that).

Scoring: a linear scan finds all maximal segments of positive score in the token
sequence. The best segment of a clean text of n tokens follows an extreme-value
law, P(S <= x) = exp(-K n exp(-lambda x)), whose K and lambda are fitted by
maximum likelihood to the clean texts of the sample, each scored without its own
counts. A text's segments add up by the sum statistic: the best segment's
lambda S - ln(K n), and for the i-th best what lambda S - ln(K n) + ln i has over
zero, over all of the text's segments. A logistic curve, fitted to the same rows, turns that into the score. A
passage is significant if its own expected number in clean texts is at most
``EXPECTED``.

Defined cases: a null, empty or wordless text has no segment and the lowest
score; rows that repeat a text score alike; without any usable label, or with one
class only, every score is the share of toxic labels (0 without labels); a null
doc_id is not held out and has no label; a doc_id with several labels is toxic if
any of them says so; empty tables give no rows. Other columns are carried as they
are. Neither labels, lang, source nor doc_id enter a score.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import add_columns, packed, python_ready, stored, table, unpacked

SAMPLE = 20_000  # labelled rows learnt from
PRIOR, LEAST = 2.0, 2
DRIFTS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
THRESHOLD, EXPECTED = 0.3, 0.05
SHORTEST, LONGEST = 3, 9
MEMO, TOGETHER = 100_000, 128  # words remembered; texts whose new words are looked up together
TOKEN = re.compile(r"[^\W\d_]+")
END = "$"
DEPTH = LONGEST - SHORTEST + 2  # nodes of a path at most


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def path(word: str) -> list[str]:
    """The word's prefixes, shortest first, then the word itself."""
    return [word[:i] for i in range(SHORTEST, min(len(word), LONGEST) + 1)] + [word + END]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, sum) in order, in linear time
    after the positive places are found (the scan of Ruzzo and Tompa)."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    starts, ends, left, right, back = [], [], [], [], []
    for i, low, high in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        a, b = i, i + 1
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:  # back[j]: the last one before j with a lower left sum
                j = back[j]
            if j < 0 or right[j] >= high:
                break
            a, low = starts[j], left[j]
            for x in (starts, ends, left, right, back):
                del x[j:]
        starts.append(a)
        ends.append(b)
        left.append(low)
        right.append(high)
        back.append(j)
    return [(a, b, r - l) for a, b, l, r in zip(starts, ends, left, right, strict=True)]


def key(node: str) -> int:
    """The first 64 bits of the MD5, as ``KEY`` has them in Spark."""
    return int.from_bytes(hashlib.md5(node.encode()).digest()[:8], "big", signed=True)


def keys_of(nodes: list[str]) -> np.ndarray:
    """The key of each node; equal nodes are hashed once."""
    place: dict[str, int] = {}
    at = [place.setdefault(p, len(place)) for p in nodes]
    md5 = hashlib.md5
    digests = np.frombuffer(b"".join([md5(p.encode()).digest() for p in place]), ">i8")
    return digests[::2].astype(np.int64)[at]


KEY = "cast(conv(substring(md5(cast(node as binary)), 1, 16), 16, -10) as bigint)"


class Model:
    def __init__(self, counts, toxic: int, clean: int):
        """counts: node -> (toxic, clean), or arrays of the nodes' keys, toxic and
        clean; toxic and clean: of all words."""
        if isinstance(counts, dict):
            counts = [key(p) for p in counts], [y for y, _ in counts.values()], [c for _, c in counts.values()]
        keys, y, c = np.asarray(counts[0], np.int64), np.asarray(counts[1], np.int32), np.asarray(counts[2], np.int32)
        order = np.argsort(keys)
        # the last entry stands for every node that isn't known
        self.keys, self.y, self.n = keys[order], np.append(y[order], np.int32(0)), np.append((y + c)[order], np.int32(0))
        self.toxic, self.clean = toxic, clean
        self.base = (toxic + 0.5) / (toxic + clean + 1)
        self.memo: dict[str, float] = {}
        self.chained: dict[str, bytes] = {}
        self.drift, self.rate, self.k = DRIFTS[-1], 1.0, 1.0
        self.slope, self.level = 0.0, 0.0

    def chains(self, words: list[str]) -> np.ndarray:
        """For each word the places of its path's nodes, shortest first."""
        if not words:
            return np.empty((0, DEPTH), np.int32)
        memo = self.chained
        if len(memo) > MEMO:
            memo.clear()
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if new:
            paths = [path(w) for w in new]
            wanted = keys_of([p for nodes in paths for p in nodes])
            at = np.searchsorted(self.keys, wanted)
            known = at < len(self.keys)
            known[known] = self.keys[at[known]] == wanted[known]
            length = np.array([len(nodes) for nodes in paths])
            table = np.full((len(new), DEPTH), len(self.keys), np.int32)
            table[np.arange(DEPTH) < length[:, None]] = np.where(known, at, len(self.keys))
            memo.update(zip(new, map(np.ndarray.tobytes, table), strict=True))
        return np.frombuffer(b"".join([memo[w] for w in words]), np.int32).reshape(-1, DEPTH)

    def scores(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = list(set(words).difference(memo))
        if new:
            at = self.chains(new)
            share = shares(self.y[at], self.n[at], at < len(self.keys), self.base)
            memo.update(zip(new, (log_odds(share) - logit(self.base) - self.drift).tolist(), strict=True))
        return np.array([memo[w] for w in words])

    def scores_without(self, words: list[str], toxic: int) -> np.ndarray:
        """The scores before the drift, had the text itself, with its label, not
        been counted."""
        distinct = list(set(words))
        if not distinct:
            return np.array([])
        at = self.chains(distinct)
        _, place, times = np.unique(at, return_inverse=True, return_counts=True)
        own = np.where(at < len(self.keys), times[place].reshape(at.shape), 0)
        y0, n0 = self.toxic - toxic * len(distinct), self.toxic + self.clean - len(distinct)
        base = (y0 + 0.5) / (n0 + 1)
        share = shares(self.y[at] - toxic * own, self.n[at] - own, at < len(self.keys), base)
        out = dict(zip(distinct, (log_odds(share) - logit(base)).tolist(), strict=True))
        return np.array([out[w] for w in words])

    def evidence(self, n: int, sums: list[float]) -> float:
        return evidence(self.rate, self.k, n, sums)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * clipped(evidence) + self.level, -500), 500)))

    def calibrate(self, law: list[tuple[float, float]], rows: list[tuple[int, list[float]]]) -> None:
        """``law``: (lambda, K) for each drift. ``rows``: (toxic, evidence for each
        drift) of each sampled text."""
        y = np.array([toxic for toxic, _ in rows], float)
        found = []
        for i, ((rate, k), drift) in enumerate(zip(law, DRIFTS, strict=True)):
            x = np.array([clipped(e[i]) for _, e in rows])
            found.append((*logistic(x, y), drift, rate, k))
        best = min(found, key=lambda f: f[0].mean())[0]
        _, self.slope, self.level, self.drift, self.rate, self.k = next(
            f for f in found if (f[0] - best).mean() <= (f[0] - best).std() / math.sqrt(len(y)))


def evidence(rate: float, k: float, n: int, sums: list[float]) -> float:
    """The sum statistic of a text of n tokens and its segments' scores."""
    room = math.log(k * max(n, 1))
    best = sorted(sums, reverse=True) or [0.0]
    return rate * best[0] - room + sum(max(0.0, rate * s - room + math.log(i)) for i, s in enumerate(best[1:], 2))


def extreme_value(clean: list[tuple[int, float]]) -> tuple[float, float]:
    """(lambda, K) by maximum likelihood of (tokens, best segment's sum) of clean
    texts. K has a closed form for each lambda; texts without a segment are
    censored at 0."""
    n, best = np.array(clean, float).T
    n = np.maximum(n, 1)
    some = best > 0

    def fitted(rate):
        k = max(1, some.sum()) / (n * np.exp(-rate * best)).sum()
        gain = (np.log(k * rate * n[some]) - rate * best[some]).sum()
        return float(gain - (k * n * np.exp(-rate * best)).sum()), float(rate), float(k)

    return max(fitted(rate) for rate in np.geomspace(0.05, 20, 200))[1:]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(log losses, slope, level) of a lightly held logistic curve, by Newton
    steps. A falling curve is replaced by the flat one."""
    def loss(w):
        at = design @ w
        return np.logaddexp(0, at) - y * at

    design = np.stack([x, np.ones_like(x)], 1)
    flat = np.array([0.0, logit(y.mean())])
    weights, hold = flat, np.array([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(hold),
                               design.T @ (y - p) - hold * weights)
        weights = weights + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    weights = weights if weights[0] > 0 else flat
    return loss(weights), float(weights[0]), float(weights[1])


def posterior(y: int, n: int, prior: float) -> float:
    return (y + PRIOR * prior) / (n + PRIOR)


def shares(y: np.ndarray, n: np.ndarray, known: np.ndarray, base: float) -> np.ndarray:
    """The toxic share of each row's deepest known node. A node's prior is its
    parent's posterior without the node's own counts."""
    prior, above, beside = np.full(len(y), base), np.zeros(len(y)), np.zeros(len(y))
    begun = np.zeros(len(y), bool)
    for y1, n1, here in zip(y.T, n.T, known.T, strict=True):
        inner = here & begun  # elsewhere the prior stays as it is
        prior = posterior(np.where(inner, above - y1, 0), np.where(inner, beside - n1, 0), prior)
        above, beside, begun = np.where(here, y1, above), np.where(here, n1, beside), begun | here
    return posterior(above, beside, prior)


def log_odds(share: np.ndarray) -> np.ndarray:
    return np.log(share / (1 - share))


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def clipped(evidence: float) -> float:
    return min(max(evidence, -15.0), 25.0)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(text, toxic) of at most ``size`` labelled, not held out documents, by a
    hash of the doc_id; each distinct text once."""
    known = (labels.where("toxic is not null and doc_id is not null").where(~held_out())
             .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size))
    known = stored(known, "labels")  # of a known size
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return stored(one.groupBy("text").agg(F.max("toxic").alias("toxic")), "sample")


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): documents of each label that hold the word."""

    def run(batches):
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (toxic if y else clean).update(set(tokens(text)))
            words = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([
                pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()),
                pa.array([clean[w] for w in words], pa.int64())], ["word", "toxic", "clean"])

    found = rows.select("text", "toxic").mapInArrow(run, "word string, toxic long, clean long")
    return stored(found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words")


def learnt(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    rows = sample(docs, labels, size)
    words = word_counts(rows)
    total = words.agg(F.sum("toxic"), F.sum("clean")).first()
    prefixes = F.expr(f"transform(sequence({SHORTEST}, least(char_length(word), {LONGEST})), i -> substring(word, 1, i))")
    nodes = F.when(F.char_length("word") >= SHORTEST, prefixes).otherwise(F.array().cast("array<string>"))
    nodes = words.select(F.explode(F.concat(nodes, F.array(F.concat("word", F.lit(END))))).alias("node"), "toxic", "clean")
    n = F.col("toxic") + F.col("clean")
    nodes = (nodes.groupBy("node").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(n >= LEAST)
             .select(F.expr(KEY).alias("key"), F.col("toxic").cast("int"), F.col("clean").cast("int"))).toArrow()
    model = Model([nodes[c].to_numpy() for c in ("key", "toxic", "clean")], total[0] or 0, total[1] or 0)
    del nodes

    def run(batches):
        for batch in batches:
            out = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = tokens(text)
                scores = model.scores_without(words, y)
                out.append((y, len(words), [[s for _, _, s in segments(scores - drift)] for drift in DRIFTS]))
            y, n, s = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(n, pa.int64()),
                                              pa.array(s, pa.list_(pa.list_(pa.float64())))], ["toxic", "n", "sums"])

    # every segment of the sample's texts stays in a table; one best for each drift and
    # then one sum for each come to the driver
    seen = stored(rows.select("text", "toxic").mapInArrow(run, "toxic int, n long, sums array<array<double>>"), "segments")
    best = F.transform("sums", lambda s: F.coalesce(F.array_max(s), F.lit(0.0)))
    clean = [(r.n, r.best) for r in seen.where("toxic = 0").select("n", best.alias("best")).collect()]
    toxic = seen.where("toxic <> 0").count()
    if not clean or not toxic:
        model.level = 500.0 if toxic else -500.0
        return model
    law = [extreme_value([(n, b[i]) for n, b in clean]) for i in range(len(DRIFTS))]

    def add(batches):
        for batch in batches:
            found = [[evidence(*at, n, s) for at, s in zip(law, sums, strict=True)]
                     for n, sums in zip(batch.column("n").to_pylist(), batch.column("sums").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])

    added = seen.mapInArrow(add, "toxic int, x array<double>")
    model.calibrate(law, [(r.toxic, r.x) for r in added.collect()])
    return model


PASSAGES = "array<struct<start:int,end:int,score:double,expected:double>>"


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with score, predicted and passages, the significant segments as
    code point spans with their expected number in clean texts."""

    def read(column):
        for a in range(0, len(column), TOGETHER):
            texts = column.slice(a, TOGETHER).to_pylist()
            words = [tokens(text) for text in texts]
            scores = model.scores([w for ws in words for w in ws])
            yield from zip(texts, words, np.split(scores, np.cumsum([len(ws) for ws in words])[:-1]), strict=True)

    def make(batch):
        out = []
        for text, words, scores in read(batch.column(batch.schema.get_field_index("text"))):
            found = segments(scores)
            p = model.probability(model.evidence(len(words), [s for _, _, s in found]))
            told = [(a, b, s, e) for a, b, s in found
                    if (e := model.k * len(words) * math.exp(-model.rate * s)) <= EXPECTED]
            if told:  # lowering may change a text's length: spans are of the text itself
                spans = [m.span() for m in TOKEN.finditer(text if len(text.lower()) == len(text) else text.lower())]
                told = [dict(start=spans[a][0], end=spans[b - 1][1], score=s, expected=e) for a, b, s, e in told]
            out.append((p, int(p >= THRESHOLD), told))
        p, label, told = zip(*out, strict=True)
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
        return [pa.array(p, pa.float64()), pa.array(label, pa.int32()), pa.array(told, pa.list_(kind))]

    return add_columns(rows, make, f"score double, predicted int, passages {PASSAGES}")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted to be toxic."""
    python_ready(docs.sparkSession)
    rows = scored(packed(docs), learnt(docs, labels))
    return unpacked(rows.where("predicted = 0"), docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, learnt(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
