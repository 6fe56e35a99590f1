"""Benchmark decontamination: Wu-Manber search for many test strings over words.

Test strings are all windows of 13 consecutive words of an item, or a shorter item's whole
text. The search looks at blocks of two words: a shift table says how far the next possible
end of a test string lies, so most positions are skipped; where the shift is zero, the block
selects a bucket of test strings, split by their first block, and a direct comparison of all
words confirms an occurrence. Long and short test strings have tables of their own, as the
shortest string bounds all shifts.

The benchmark is taken in blocks of about ``block_bytes`` of text, counted first: a block is what the
driver and a Python worker hold. Every document meets every block in a narrow pass; nothing
is shuffled, so hot sources and copies cost nothing extra.

Defined cases. A null or empty text has no words and no hits, and is not contaminated. Items
without words, and items with a null id, have no windows. Rows that repeat an item id add
their windows to it. Repeated documents repeat. Extra columns are kept; new columns replace
those of the same name.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

WINDOW = 13
# Bytes from 128 up belong to characters beyond ASCII, all of which make words.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SPANS = "array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text; bytes.lower() touches A to Z only."""
    return WORD.findall(text.encode().lower()) if text else []


class Tables:
    """Shift table and buckets of one group of test strings."""

    def __init__(self, strings: dict[tuple[bytes, ...], set[str]]):
        self.shortest = m = min(map(len, strings))
        self.block = b = min(2, m)
        self.far = m - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = defaultdict(lambda: defaultdict(list))
        for words, items in strings.items():
            for last in range(b - 1, m):
                block = words[last - b + 1:last + 1]
                self.shift[block] = min(self.shift.get(block, self.far), m - 1 - last)
            self.buckets[words[m - b:m]][words[:b]].append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(start, end, items) of each occurrence."""
        m, b, far, shift, n = self.shortest, self.block, self.far, self.shift.get, len(words)
        i = m - 1
        while i < n:
            block = tuple(words[i - b + 1:i + 1])
            step = shift(block, far)
            if step:
                i += step
                continue
            start = i - m + 1
            for string, items in self.buckets[block].get(tuple(words[start:start + b]), ()):
                if start + len(string) <= n and tuple(words[start:start + len(string)]) == string:
                    yield start, start + len(string), items
            i += 1


def tables_of(items: list[tuple[str, str]], window: int) -> list[Tables]:
    """Tables of the long and the short test strings of (id, text) items."""
    long, short = defaultdict(set), defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for at in range(len(words) - window + 1):
            long[tuple(words[at:at + window])].add(item)
        if 0 < len(words) < window:
            short[tuple(words)].add(item)
    return [Tables(x) for x in (long, short) if x]


@lru_cache(maxsize=8)
def cached_tables(items: tuple[tuple[str, str], ...], window: int) -> list[Tables]:
    return tables_of(list(items), window)


def runs(mask: bytearray) -> list[dict[str, int]]:
    return [{"start": m.start(), "end": m.end()} for m in re.finditer(b"\x01+", bytes(mask))]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[list[tuple[str, str]]]:
    """The benchmark in blocks; each is fetched alone and bounded by the count before."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text")).where(
        "item IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    count = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    return [[tuple(r) for r in items.where(block == k).orderBy("item", "text").collect()] for k in range(count)]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, block_bytes: int = 8 << 20) -> DataFrame:
    """The documents with ``n_words``, ``hit_spans`` (word numbers, end exclusive) and ``items``, sorted ids as strings."""

    def scanner(block: list[tuple[str, str]]):
        sent = docs.sparkSession.sparkContext.broadcast(tuple(block))

        def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            tables = cached_tables(sent.value, window)
            for texts, spans, items in batches:
                rows = []
                for text, old_spans, old_items in zip(texts, spans, items, strict=True):
                    words = words_of(text)
                    mask, met = None, set(old_items)
                    for table in tables:
                        for start, end, found in table.search(words):
                            mask = mask or bytearray(len(words))
                            mask[start:end] = b"\x01" * (end - start)
                            met |= found
                    if mask:
                        for s in old_spans:
                            mask[s["start"]:s["end"]] = b"\x01" * (s["end"] - s["start"])
                    rows.append((len(words), runs(mask) if mask else list(old_spans), sorted(met)))
                yield pd.DataFrame(rows, columns=["n_words", "hit_spans", "items"])

        return F.pandas_udf(scan, f"n_words long, hit_spans {SPANS}, items array<string>")

    new = ("n_words", "hit_spans", "items")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*new, "_found")]
    out = docs.select(*kept, F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("hit_spans"),
                                      F.array().cast("array<string>").alias("items")).alias("_found"))
    for k, block in enumerate(blocks_of(benchmark, item_col, item_text_col, block_bytes)):
        if k and k % 4 == 0:  # bounds the tables that one worker holds
            out = checkpointed(out)
        out = out.select(*kept, scanner(block)(F.col(f"`{text_col}`"), "_found.hit_spans", "_found.items").alias("_found"))
    return out.select(*kept, "_found.*")


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, **options) -> DataFrame:
    """find_overlaps() with ``n_hit`` and ``contaminated``: one word in ``share`` or more is hit."""
    found = find_overlaps(docs, benchmark, **options)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    names = [c for c in found.columns if c not in ("n_hit", "contaminated")]
    counted = found.select(*[F.col(f"`{c}`") for c in names], hit.alias("n_hit"))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
