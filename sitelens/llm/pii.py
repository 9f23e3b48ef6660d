"""Operator 4, personal data by bootstrapped contextual extraction.

Base spans (e-mail, IPv4, payment card, phone) come from fixed rules over whole
texts and are the seeds. A pattern is, for one kind, the pair of words before an
identifier, the one word before it, or the one after it. Spark scores the graph of patterns and instances in rounds: a
pattern's confidence is the scored instances it introduces over all its
occurrences in the corpus; an instance's score is 1 - product(1 - confidence)
of its trusted patterns. A trusted pattern (confidence and distinct instances at
least the parameters; a pattern of one word also needs as many different words
beyond it or, after the identifier, before that: else the pair says the same) adds the identifier-like words of the kind's form that
follow it, and those support further patterns in the next round. The rounds end
when no pattern becomes trusted and no confidence moves by more than ``STILL``.

Words here are runs of other than ASCII white space, A-Z lowered, digits as 0.
Candidates are such words with a digit or @ that have the form of a kind and
overlap no base span, without punctuation at their ends, and groups of at most 6
digits with single spaces between them that have such a form together (7 to 19
digits; no group that has a form alone).

Defined cases: null and empty texts have no spans; each row is judged by itself,
repeated rows alike; ties among kinds go by the order email, ip, card, phone; an
empty table gives no rows; other columns are not read. Offsets count code points.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm.common import add_columns, packed, python_ready, stored, table, utf8

KINDS = ("email", "ip", "card", "phone")
SUPPORT, TRUST, ROUNDS = 3, 0.5, None  # None: until nothing changes
STILL = 1e-3  # a smaller move of a confidence is none
BLOCK = 200_000  # contexts sent to the tasks together, about 10 MB

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
#: Digit groups with single spaces between them, from the start of a word.
JOINED = re.compile(r"(?<![^\x20\x09-\x0D])[+(]?[0-9][0-9().-]*+(?:\x20[(]?[0-9][0-9().-]*+)+(?![\w@:/])")
SPACE = re.compile(r"[\x20\x09-\x0D]")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
MARKED = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
PLAIN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
PLAIN_BYTES = bytes(PLAIN.get(i, i) for i in range(256))
#: The form that a discovered identifier of each kind must have.
FORM = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9A-Fa-f]*([.:][0-9A-Fa-f]*){2,}$",
    "card": r"^([0-9][ -]?){12,19}$",
    "phone": r"^[+(]?[0-9][0-9() .-]{5,}[0-9]$",
}
FORMS = [re.compile(f) for f in FORM.values()]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches, found from each @: a match before it must begin at
    the first of the local characters that end there."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not NOT_LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, done := m.end()))
        else:
            done = max(done, at + 1)  # no local part reaches over an @
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    numbers = [m.span() for m in CARD.finditer(text)]
    if numbers:
        out += [("ip", *m.span()) for m in IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for a, b in numbers:
            if b - a >= 16:
                digits = text[a:b].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", a, b))
    elif "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text)]  # only one-digit parts
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def formed(value: str) -> bool:
    return any(f.match(value) for f in FORMS)


class Around:
    """The contexts of spans of a text. What was read for a word is kept for the
    next span in it, so that all spans together take linear time."""

    def __init__(self, text: str):
        self.text, self.left, self.right = text, (0, -1, []), (0, -1, None)

    def before(self, start: int) -> list[str]:
        """The two words before the word that holds ``start``, or fewer."""
        low, high, words = self.left
        if low <= start <= high:
            return words
        text, a, words = self.text, start, []
        while a and text[a - 1] not in BLANK:
            a -= 1
        low = a
        while len(words) < 2:
            while a and text[a - 1] in BLANK:
                a -= 1
            if not a:
                break
            end = a
            while a and text[a - 1] not in BLANK:
                a -= 1
            words.insert(0, text[a:end].translate(PLAIN))
        m = SPACE.search(text, start)
        self.left = low, m.start() if m else len(text), words
        return words

    def after(self, end: int) -> str | None:
        """The word after the one that ends at ``end`` or holds it."""
        low, high, word = self.right
        if low <= end <= high:
            return word
        m = SPACE.search(self.text, end)
        high = m.start() if m else len(self.text)
        m = SOLID.search(self.text, high)
        self.right = end, high, m[0].translate(PLAIN) if m else None
        return self.right[2]

    def contexts(self, start: int, end: int) -> list[tuple[str, str]]:
        """(context, word or words beyond it): "a b" for the pair before, "b" for
        the word before, a tab and the word for that after."""
        words, word = self.before(start), self.after(end)
        pair = " ".join(["", *words][-2:]) if words else ""
        out = [(pair, ""), (words[-1], pair)] if words else []
        return out if word is None else [*out, ("\t" + word, pair)]


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without punctuation at the ends, but for what an identifier may have there."""
    while start < end and not (text[start].isalnum() or text[start] in "+(" or text.startswith("::", start, end)):
        start += 1
    while end > start and not (text[end - 1].isalnum() or text.endswith("::", start, end)):
        end -= 1
    return start, end


def read(text: str):
    """(base spans, seeds as (kind, value, contexts), candidates as (start, end,
    value, contexts))."""
    spans = base_spans(text)
    near = Around(text)
    seeds = [(kind, text[a:b], near.contexts(a, b)) for kind, a, b in spans]
    taken = sorted((a, b) for _, a, b in spans)
    near = Around(text)
    candidates, k, done, joined = [], 0, 0, JOINED.finditer(text)
    run = next(joined, None)
    for m in MARKED.finditer(text):
        if m.end() <= done:
            continue
        start = m.start()
        while start > done and text[start - 1] not in BLANK:
            start -= 1
        while run is not None and run.end() <= start:
            run = next(joined, None)
        word = done = m.end()
        pieces = [trimmed(text, start, word)]
        if run is not None and run.start() == start:
            a, b = trimmed(text, *run.span())
            groups = [re.sub("[^0-9]", "", g) for g in text[a:b].split(" ")]
            if (all(len(g) <= 6 for g in groups) and 7 <= sum(map(len, groups)) <= 19 and formed(text[a:b])
                    and not any(formed(g[slice(*trimmed(g, 0, len(g)))]) for g in text[a:b].split(" "))):
                pieces = [(a, b)]
                done = max(done, run.end())
        for a, b in pieces:
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            free = not (k < len(taken) and taken[k][0] < b)
            if not free and b > word:  # a joined run that meets a base span: its words alone
                done = word
                a, b = trimmed(text, start, word)
                free = not (k < len(taken) and taken[k][0] < b)
            if free and b - a >= 3 and formed(text[a:b]):
                candidates.append((a, b, text[a:b], near.contexts(a, b)))
    return spans, seeds, candidates


SPAN = "array<struct<kind:string,start:int,end:int>>"


def read_rows(rows: DataFrame) -> DataFrame:
    """row_id, doc_id with base, seeds and candidates of the whole text."""

    def make(batch):
        base, seeds, found = [], [], []

        def told(contexts):
            return [dict(context=c, beyond=w) for c, w in contexts]

        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            b, s, c = read(text or "")
            base.append([dict(zip(("kind", "start", "end"), x)) for x in b])
            seeds.append([dict(kind=k, value=v, contexts=told(x)) for k, v, x in s])
            found.append([dict(start=a, end=z, value=v, contexts=told(x)) for a, z, v, x in c])
        text, number = pa.string(), pa.int32()
        contexts = pa.list_(pa.struct([("context", text), ("beyond", text)]))
        return [
            pa.array(base, pa.list_(pa.struct([("kind", text), ("start", number), ("end", number)]))),
            pa.array(seeds, pa.list_(pa.struct([("kind", text), ("value", text), ("contexts", contexts)]))),
            pa.array(found, pa.list_(pa.struct([("start", number), ("end", number), ("value", text), ("contexts", contexts)])))]

    contexts = "contexts:array<struct<context:string,beyond:string>>"
    return add_columns(
        rows, make, f"base {SPAN}, seeds array<struct<kind:string,value:string,{contexts}>>, "
        f"candidates array<struct<start:int,end:int,value:string,{contexts}>>", drop=("text",))


def occurrences(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context, n): how often any word stands at the context, over all texts. Each
    task counts its own texts; the contexts go to the tasks in blocks."""
    contexts = stored(contexts.select("context"), "contexts")
    parts = contexts.count() // BLOCK + 1
    counted = []
    for p in range(parts):
        block = contexts.where(F.pmod(F.xxhash64("context"), F.lit(parts)) == p).collect()
        counted.append(docs.select("text").mapInArrow(counter([r.context for r in block]), "context string, n long"))
    return reduce(DataFrame.unionByName, counted).groupBy("context").agg(F.sum("n").alias("n"))


def counter(contexts: list[str]):
    firsts: dict[bytes, dict[bytes, str]] = {}
    lefts: dict[bytes, str] = {}
    rights: dict[bytes, str] = {}
    for context in contexts:
        first, pair, last = context.encode().rpartition(b" ")
        if context.startswith("\t"):
            rights[last[1:]] = context
        elif pair:
            firsts.setdefault(last, {})[first] = context
        else:
            lefts[last] = context

    def run(batches):
        n: Counter[str] = Counter()
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            data, at = data.tobytes(), offsets.tolist()
            for a, b in zip(at, at[1:]):
                words = data[a:b].translate(PLAIN_BYTES).split()
                if lefts:
                    n.update([lefts[w] for w in words[:-1] if w in lefts])
                if rights:
                    n.update([rights[w] for w in words[1:] if w in rights])
                first = b""
                for last in words[:-1] if firsts else ():
                    if last in firsts and first in firsts[last]:
                        n[firsts[last][first]] += 1
                    first = last
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], ["context", "n"])

    return run


def trusted_patterns(found: DataFrame, docs: DataFrame, support: int, trust: float, rounds: int | None) -> DataFrame:
    """(kind, context) of the patterns trusted after the rounds. Scores only rise
    from round to round, so without a bound they end too."""
    seeds = found.select(F.explode("seeds").alias("s")).select("s.*")
    seeds = seeds.select("kind", "value", F.explode("contexts").alias("c")).select("kind", "value", "c.*")
    seeds = stored(seeds.groupBy("kind", "value", "context", "beyond").agg(F.count("*").alias("times")), "seeds")
    mentions = stored(
        found.select(F.explode("candidates").alias("c")).select("c.value", F.explode("c.contexts").alias("c"))
        .select("value", "c.*").groupBy("value", "context", "beyond").agg(F.count("*").alias("times")), "mentions")
    form = reduce(lambda c, k: c.when((F.col("kind") == k) & F.col("value").rlike(FORM[k]), True), KINDS, F)
    known = seeds.select("kind", "context", "beyond", "value", F.lit(1.0).alias("score"), "times")
    patterns = None
    counts = None
    for _ in itertools.count() if rounds is None else range(rounds):
        sums = known.groupBy("kind", "context").agg(
            F.sum(F.col("score") * F.col("times")).alias("hits"), F.count_distinct("value").alias("values"),
            F.count_distinct("beyond").alias("beyond"))
        varied = F.col("context").contains(" ") | (F.col("beyond") >= support)
        sums = stored(sums.where((F.col("values") >= support) & varied).drop("beyond"), "patterns")
        new = sums.select("context").distinct()
        if counts is not None:
            new = new.join(counts, "context", "left_anti")
        new = stored(new, "new-contexts")
        if not new.isEmpty() or counts is None:
            counted = occurrences(docs, new)
            counts = stored(counted if counts is None else counts.unionByName(counted), "counts")
        confidence = F.col("hits") / (F.col("n") + 1)
        last, patterns = patterns, stored(sums.join(counts, "context").withColumn("confidence", confidence)
                          .where(F.col("confidence") >= trust).select("kind", "context", "confidence"), "trusted")
        if last is not None:
            moved = patterns.join(last.withColumnRenamed("confidence", "last"), ["kind", "context"], "left").where(
                F.col("last").isNull() | (F.col("confidence") - F.col("last") > STILL))
            if moved.isEmpty():
                break
        # an instance of the kind's form scores by all its trusted contexts
        edges = mentions.groupBy("value", "context").agg(F.sum("times").alias("times")).join(patterns, "context").where(form)
        scores = edges.groupBy("kind", "value").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(1 - 1e-9)))))).alias("score"))
        more = mentions.join(scores, "value").select("kind", "context", "beyond", "value", "score", "times")
        known = seeds.select(
            "kind", "context", "beyond", "value", F.lit(1.0).alias("score"), "times").unionByName(more)
        if scores.isEmpty():
            break
    return patterns


def personal_data(docs: DataFrame, support: int = SUPPORT, trust: float = TRUST, rounds: int | None = ROUNDS) -> DataFrame:
    """(row_id, doc_id, base, spans): base spans, and all spans, in order."""
    python_ready(docs.sparkSession)
    rows = packed(docs.select("doc_id", "text")).drop("doc")
    found = stored(read_rows(rows), "spans")
    patterns = trusted_patterns(found, docs, support, trust, rounds)
    rank = F.expr("array_position(array('email', 'ip', 'card', 'phone'), kind)")
    form = reduce(lambda c, k: c.when((F.col("kind") == k) & F.col("value").rlike(FORM[k]), True), KINDS, F)
    added = (found.select("row_id", F.explode("candidates").alias("c")).select("row_id", "c.start", "c.end", "c.value", F.explode("c.contexts.context").alias("context"))
             .join(patterns.select("kind", "context"), "context").where(form)
             .select("row_id", "start", "end", "kind").distinct()
             .withColumn("first", F.min(rank).over(Window.partitionBy("row_id", "start"))).where(rank == F.col("first"))
             .groupBy("row_id").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added")))
    both = F.concat("base", F.coalesce("added", F.array().cast(SPAN)))
    by_kind = F.expr("""array_sort(both, (a, b) -> CASE
        WHEN a.kind <> b.kind THEN cast(array_position(array('email', 'ip', 'card', 'phone'), a.kind)
                                      - array_position(array('email', 'ip', 'card', 'phone'), b.kind) AS int)
        WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1 ELSE 0 END)""")
    return found.join(added, "row_id", "left").withColumn("both", both).select(
        "row_id", "doc_id", "base", by_kind.alias("spans"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))

    def text(spans):
        return F.array_join(F.expr(
            f"transform({spans}, x -> concat(x.kind, ':', cast(x.start as string), ':', cast(x.end as string)))"), ",")

    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
