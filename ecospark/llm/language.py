"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) those of
its letters, permuted by their place; a document's vector bundles (adds) the vectors of all its
trigrams; a language prototype bundles those of all its training documents. A document gets
the language whose prototype has the largest cosine with it, the first by name among equals.

A bundle is linear in trigram counts, so counts are gathered first and each trigram is bound
once per batch. Prototypes are gathered by summing per-task bundles in Spark: languages x
dimensions numbers reach the driver, whatever the corpus.

Defined cases. A null text, or one without letters, is ``und`` with score 0. Without training
rows every text is ``und``. Case is ignored; runs of anything but letters are one boundary.
Letters are taken modulo 251 code points, so scripts share vectors but not trigrams.
Repeated rows count repeatedly. Extra columns are kept; new columns replace those of the
same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 252
DIMENSIONS = 1024
SEED = 7
PIECE = 1 << 20  # code points that are counted at once


@lru_cache
def slot_of() -> np.ndarray:
    """Code point to letter slot; 0 is no letter."""
    points = np.arange(0x110000)
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(letters, 1 + points % (SLOTS - 1), 0).astype(np.uint8)


@lru_cache
def letters(dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SLOTS, dimensions))


def bind(grams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Vectors of trigrams: the first letter permuted twice, the second once."""
    base = letters(dimensions, seed)
    return (np.roll(base, 2, 1)[grams // (SLOTS * SLOTS)] * np.roll(base, 1, 1)[grams // SLOTS % SLOTS]
            * base[grams % SLOTS])


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Groups of whole texts, or of parts of a long one that overlap so that no trigram is lost.

    Yields the owners and the code points, each part followed by a zero.
    """
    owners: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        # Zeros part the texts, so one inside a text becomes another code point that is no letter.
        text = (text or "").lower().replace("\0", "\1")
        for at in range(0, max(len(text), 1), PIECE):
            # Boundaries that fall on a cut are counted on both sides; all else once.
            part = text[at:at + PIECE + 2]
            owners.append(i)
            parts.append(part if at == 0 else "\1" + part)
            size += len(part) + 1
            if size >= PIECE:
                yield owners, np.frombuffer("\0".join(["", *parts, ""]).encode("utf-32-le", "replace"), np.uint32)
                owners, parts, size = [], [], 0
    if parts:
        yield owners, np.frombuffer("\0".join(["", *parts, ""]).encode("utf-32-le", "replace"), np.uint32)


def trigrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of the parts, and the part of each."""
    part = np.cumsum(points == 0) - 1
    slots = slot_of()[points].astype(np.int32)
    keep = np.ones(len(slots), bool)
    keep[1:] = (slots[1:] != 0) | (slots[:-1] != 0) | (points[1:] == 0)
    slots, part, mark = slots[keep], part[keep], points[keep] == 0
    codes = (slots[:-2] * SLOTS + slots[1:-1]) * SLOTS + slots[2:]
    # A trigram belongs to the part it starts in; it must not run over the next part's mark.
    inside = ~mark[1:-1] & (codes != 0)
    return codes[inside], part[:-2][inside]


def compact(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the index of each code among them."""
    seen = np.zeros(SLOTS**3, bool)
    seen[codes] = True
    grams = np.flatnonzero(seen)
    index = np.empty(SLOTS**3, np.int32)
    index[grams] = np.arange(len(grams), dtype=np.int32)
    return grams, index[codes]


def bundles(texts: list[str | None], dimensions: int, seed: int) -> np.ndarray:
    """One vector per text."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for owners, points in pieces(texts):
        codes, part = trigrams(points)
        if not len(codes):
            continue
        grams, index = compact(codes)
        step = max(1, (8 << 20) // len(grams))  # parts whose counts are held as one dense matrix
        owner = np.asarray(owners)
        ends = np.searchsorted(part, np.arange(0, len(owners) + step, step))
        spans = [slice(a, a + 4096) for a in range(0, len(grams), 4096)]
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            first, rows = k * step, min(step, len(owners) - k * step)
            if rows <= 0 or a == b:
                continue
            counts = np.bincount((part[a:b] - first) * len(grams) + index[a:b], minlength=rows * len(grams))
            counts = counts.reshape(rows, len(grams)).astype(np.float32)
            made = sum(counts[:, s] @ bind(grams[s], dimensions, seed) for s in spans)
            np.add.at(out, owner[first:first + rows], made)
    return out


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", dimensions: int = DIMENSIONS,
        seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from every row with a text and a label."""

    def gather(batches):
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, rows in batch.groupby("lang", sort=False)["text"]:
                held = grams.setdefault(lang, np.zeros(dimensions))
                for _, points in pieces(list(rows)):
                    codes, _ = trigrams(points)
                    if len(codes):
                        found, index = compact(codes)
                        counts = np.bincount(index).astype(np.float32)
                        for a in range(0, len(found), 4096):
                            held += counts[a:a + 4096] @ bind(found[a:a + 4096], dimensions, seed)
        for lang, held in grams.items():
            yield pd.DataFrame({"lang": [lang], "bundle": [held]})

    parts = docs.select(F.col(f"`{label_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL").mapInPandas(gather, "lang string, bundle array<double>")
    sums = parts.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("sum"))
    out: dict[str, np.ndarray] = {}
    for lang, pos, total in sums.collect():
        out.setdefault(lang, np.zeros(dimensions))[pos] = total
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v)) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The documents with ``lang_pred``, ``score`` (cosine, 0 at least) and ``margin`` to the second language."""
    names = np.array([*prototypes, "und"], object)
    table = np.array(list(prototypes.values()), np.float32).T if prototypes else None

    def classify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            n = len(batch)
            best, score, margin = np.full(n, len(names) - 1), np.zeros(n), np.zeros(n)
            for a in range(0, n, 4096 if table is not None else n):
                if table is None:
                    break
                made = bundles(list(batch[a:a + 4096]), table.shape[0], seed)
                size = np.linalg.norm(made, axis=1)
                near = (made @ table) / np.maximum(size, 1e-30)[:, None]
                top = np.sort(near, 1)
                some = size > 0
                rows = slice(a, a + len(made))
                best[rows] = np.where(some, near.argmax(1), len(names) - 1)
                score[rows] = np.where(some, np.clip(top[:, -1], 0, 1), 0)
                margin[rows] = np.where(some, top[:, -1] - (top[:, -2] if top.shape[1] > 1 else 0), 0)
            yield pd.DataFrame({"lang_pred": names[best], "score": score, "margin": margin})

    said = F.pandas_udf(classify, "lang_pred string, score double, margin double")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "margin", "_said")]
    return docs.select(*kept, said(F.col(f"`{text_col}`")).alias("_said")).select(*kept, "_said.*")
