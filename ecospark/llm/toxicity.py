"""Toxicity by maximum-scoring segments of token log-odds.

A word's log-odds between toxic and other labelled documents are smoothed by a Dirichlet prior:
half a count plus its share of the background. Words whose log-odds are large and exceed
their standard error ``z`` times score; every other word costs a little. One linear scan finds all maximal
segments of a text. Under clean text a segment's score has an extreme-value tail, E = K n exp(-lambda S);
lambda follows from the word frequencies, K from the clean training texts. The tails of a document's
best segments are combined, and a bound on the Bayes factor turns the p-value and the share of
toxic labels into a score from 0 to 1.

Copies of one labelled document would make its rare words look toxic. So a class's count of a word is
bounded by its number of different left neighbours, unless these are too many to tell.

Labels are learnt from a sample of at most about ``max_rows`` labelled documents (a parameter of
labelled(); below it, all). Counts are gathered from all of these by aggregation; the model is the ``max_words``
most significant words (a parameter of the model), so its size is bounded.

Defined cases. Null and empty texts have no words, and the score of no evidence, which is the
share of toxic labels. Without training rows all scores are 0. Null labels are left out of
training; repeated rows count repeatedly, but see above. Extra columns are kept; new columns
replace those of the same name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

WORD = re.compile(r"[^\W\d_]+")
#: Words a task counts before it hands them on.
HELD = 200_000
PASSAGES = "array<struct<start:int,end:int,score:double,p_value:double>>"


@dataclass(frozen=True)
class Model:
    """Scores of the listed words, of all others, the tail's two numbers and the share of toxic labels."""

    words: dict[str, float]
    other: float
    rate: float
    size: float
    prior: float


def word_counts(docs: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(word, toxic, clean): occurrences by class, bounded by the number of left neighbours."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(w, *r) for w, r in held.items()], columns=["word", "toxic", "clean", "left1", "left0"])
            held.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["label"], strict=True):
                previous, k = 0, 0 if toxic else 1
                for word in WORD.findall(text.lower()):
                    row = held.get(word)
                    if row is None:
                        row = held[word] = [0, 0, 0, 0]
                    row[k] += 1
                    row[k + 2] |= 1 << previous
                    previous = zlib.crc32(word.encode()) % 63
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("int").alias("label")).where(
        "text IS NOT NULL AND label IS NOT NULL")
    sums = rows.mapInPandas(gather, "word string, toxic long, clean long, left1 long, left0 long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("left1").alias("left1"), F.bit_or("left0").alias("left0"))

    def bounded(count: str, seen: str) -> Column:
        bits = F.bit_count(seen)  # linear counting: m set places of 63 stand for -63 ln(1 - m / 63) neighbours
        return F.when(bits > 40, F.col(count)).otherwise(F.least(F.col(count), -63 * F.log(1 - bits / 63))).cast("double")

    return sums.select("word", bounded("toxic", "left1").alias("toxic"), bounded("clean", "left0").alias("clean"))


def train(docs: DataFrame, text_col: str = "text", label_col: str = "toxic", z: float = 3.0, least: float = 3.0, prior: float = 500.0,
          density: float = 0.1, max_words: int = 20_000) -> Model:
    """Model from labelled documents. Listed words have log-odds of ``least`` or more; ``density`` is the share of listed words expected in a toxic passage."""
    counts = checkpointed(word_counts(docs, text_col, label_col))
    toxic, clean = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0.0)), F.coalesce(F.sum("clean"), F.lit(0.0))).head()
    total = max(toxic + clean, 1.0)
    both = 0.5 + prior * (F.col("toxic") + F.col("clean")) / total
    a, b = F.col("toxic") + both, F.col("clean") + both
    odds = F.log(a / (toxic + prior + 1 - F.least(a, F.lit(toxic + prior)))) - F.log(b / (clean + prior + 1 - F.least(b, F.lit(clean + prior))))
    listed = counts.where("toxic > 0").select("word", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"),
                                              (b / (clean + prior)).alias("share"))
    top = listed.where((F.col("z") >= z) & (F.col("odds") >= least)).orderBy(F.desc("z"), "word").limit(max_words).collect()
    words = {r["word"]: r["odds"] for r in top}
    inside = min(sum(r["share"] for r in top), 0.5)
    other = math.log((1 - density) / (1 - inside)) if inside < density else -0.01
    low, high = 1e-3, 50.0
    for _ in range(80):  # the positive root of sum p exp(rate s) = 1
        rate = (low + high) / 2
        made = sum(r["share"] * math.exp(min(rate * r["odds"], 700)) for r in top) + (1 - inside) * math.exp(rate * other)
        low, high = (low, rate) if made > 1 else (rate, high)
    rate = low
    rough = Model(words, other, rate, 1.0, 0.0)
    rows = scan(docs.select(text_col, label_col), rough, text_col)
    label = F.col(f"`{label_col}`").cast("int")
    seen = rows.where(F.col(text_col).isNotNull() & label.isNotNull()).agg(
        F.count("*"), F.sum(F.when(label != 0, 1).otherwise(0)),
        F.sum(F.when((label == 0) & (F.col("n_words") > 0), 1).otherwise(0)),
        F.sum(F.when(label == 0, F.col("n_words") * F.exp(-rate * F.col("best"))))).head()
    n, positive, clean_docs, weight = (x or 0 for x in seen)
    return Model(words, other, rate, clean_docs / weight if weight else 1.0, positive / n if n else 0.0)


def segments(at: list[int], gains: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score); only words ``at`` gain.

    A stack holds candidates with the totals before and after them; each remembers the nearest earlier
    one with a lower total before it, so every candidate is passed once.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, before, after, lower
    gained = 0.0
    for k, (i, gain) in enumerate(zip(at, gains, strict=True)):
        before = other * (i - k) + gained
        gained += gain
        first, after = i, before + gain
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((first, i, before, after, j))
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def tail(score: float, n: int, model: Model) -> float:
    """P-value of one segment's score in a clean text of n words."""
    return -math.expm1(-model.size * n * math.exp(-model.rate * score))


def combined(scores: list[float], n: int, model: Model) -> float:
    """P-value of the r best segments together, for the r that tells most; each more halves the odds."""
    best, total = 1.0, 0.0
    for r, score in enumerate(sorted(scores, reverse=True)[:10], 1):
        if r == 1:
            best = tail(score, n, model)
        total += model.rate * score - math.log(max(model.size * n, 1e-12))
        if r > 1 and total > r:
            best = min(best, math.exp(-total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2)))
    return max(best, 1e-300)


def posterior(p: float, prior: float) -> float:
    """Score from a p-value: the Bayes factor is at least -e p ln p."""
    bound = -math.e * p * math.log(p) if p < 1 / math.e else 1.0
    return prior / (prior + (1 - prior) * bound) if prior > 0 else 0.0


def scan(docs: DataFrame, model: Model, text_col: str = "text", level: float = 0.05, threshold: float = 0.3) -> DataFrame:
    """The documents with ``n_words``, ``best`` segment score, ``score``, ``predicted`` and ``passages``.

    A passage is a segment whose own p-value is ``level`` or less; start and end are code points.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(text: str | None) -> tuple:
        known = sent.value
        words = WORD.findall(text.lower()) if text else []
        n = len(words)
        if known.words.keys().isdisjoint(words):
            score = posterior(1.0, known.prior)
            return n, 0.0, score, int(score >= threshold), []
        at = [i for i, w in enumerate(words) if w in known.words]
        found = segments(at, [known.words[words[i]] for i in at], known.other)
        p = combined([s for _, _, s in found], n, known)
        score = posterior(p, known.prior)
        strong = [(a, b, s, t) for a, b, s in found if (t := tail(s, n, known)) <= level]
        marks = []
        if strong:
            # Lower case can change the length of a text, so words are found anew in the text itself.
            places = [m.span() for m in WORD.finditer(text)]
            if len(places) != n:
                places = [m.span() for m in WORD.finditer(text.lower())]
            marks = [{"start": places[a][0], "end": places[b][1], "score": s, "p_value": t} for a, b, s, t in strong]
        return n, max(s for _, _, s in found), score, int(score >= threshold), marks

    new = ["n_words", "best", "score", "predicted", "passages"]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([of(t) for t in batch], columns=new)

    said = F.pandas_udf(run, f"n_words long, best double, score double, predicted int, passages {PASSAGES}")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*new, "_said")]
    return docs.select(*kept, said(F.col(f"`{text_col}`")).alias("_said")).select(*kept, "_said.*")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             max_rows: int = 100_000) -> DataFrame:
    """(text, label) of training documents: those labelled whose crc32(id) mod 4 is not 2.

    Of more than ``max_rows`` labelled ids a sample of about that many is taken, by a hash of the id. The
    sample's ids and labels are a few megabytes and go to the texts, which stay where they are.
    """
    some = checkpointed(labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias(label_col)).where(
        (F.crc32(F.col("_id").cast("string")) % 4 != 2) & F.col(label_col).isNotNull()).distinct())
    share = int(min(1.0, max_rows / max(some.count(), 1)) * (1 << 40))
    sample = some.where(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 40)) < share)
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias(text_col)).join(F.broadcast(sample), "_id").select(
        text_col, label_col)
