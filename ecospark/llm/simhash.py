"""SimHash near-dedup with anchor points from a covering code.

Fingerprints that differ in few bits are linked. Two that differ in at most 4 of 64 bits differ in
at most 1 bit in one of three segments (22, 21 and 21 bits). Per segment, the code words of a covering
code are the anchors: the [15, 11] Hamming code on the first 15 bits, each other bit as it is, so
every value lies within 1 bit of its home anchor. A fingerprint is sent to every anchor within
that radius plus the segment's threshold, 2 bits; a fingerprint at its home anchor is compared with
all that were sent there. Whichever segment differs by at most 1 bit brings a pair together.

Equal fingerprints are one node, by aggregation. An anchor's crowd is cut into pieces of bounded
size, and each pair of pieces is compared on its own; what leaves it is a spanning forest of the
links found, never all pairs. Components of the remaining links come from joins on ids, with
every round written to the checkpoint folder.

Defined cases. A null text, an empty one and one of blanks have fingerprint zero and are linked
like any other. Fewer words than a shingle holds are one shingle. Repeated rows are equal
fingerprints. A component is named after its smallest id; null ids come last, and a component
of null ids alone has no name. Extra columns are kept; new columns replace those of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .graph import components
from .lines import row_key

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
CODED = 15


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits: each is 1 if set in more than half of the hashes of the word shingles."""
    words = WORD.findall(text.encode().lower()) if text else []
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:n - 1]]).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    ends = (ends[shingle - 1:] - 1).tolist()
    for a in range(0, n, 1 << 18):
        part = np.array([digest(joined[s:e], 42) for s, e in zip(starts[a:a + (1 << 18)], ends[a:a + (1 << 18)], strict=True)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((2 * ones > n) @ (1 << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 4) -> DataFrame:
    """The documents with ``fingerprint``, 64 bits as a signed number."""

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).view(np.int64))

    kept = [F.col(f"`{c}`") for c in docs.columns if c != "fingerprint"]
    return docs.select(*kept, F.pandas_udf(scan, "long")(F.col(f"`{text_col}`")).alias("fingerprint"))


def segments_of(bits: int = 64, count: int = 3) -> list[tuple[int, int]]:
    """(first bit, width) of near-equal segments."""
    widths = [bits // count + (i < bits % count) for i in range(count)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def syndrome(value: int) -> int:
    """Of the coded bits: bit i carries the column i + 1."""
    out = 0
    for i in range(CODED):
        if value >> i & 1:
            out ^= i + 1
    return out


def patterns(width: int, radius: int) -> list[list[int]]:
    """Per syndrome, the changes of at most ``radius`` bits that lead to a code word."""
    out: list[list[int]] = [[] for _ in range(CODED + 1)]
    for n in range(radius + 1):
        for bits in combinations(range(width), n):
            change = sum(1 << b for b in bits)
            out[syndrome(change)].append(change)
    return out


def syndrome_of(value: Column) -> Column:
    """syndrome() of a column of longs, by the parity of four masked parts."""
    out = F.lit(0)
    for k in range(4):
        mask = sum(1 << i for i in range(CODED) if (i + 1) >> k & 1)
        out = out + F.shiftleft(F.bit_count(value.bitwiseAND(F.lit(mask))) % 2, k)
    return out


def at_anchors(nodes: DataFrame, most: int, count: int) -> DataFrame:
    """(anchor, fp, home): each fingerprint at all its anchors; ``home`` marks the nearest one.

    The anchor number holds the segment, so anchors of different segments do not meet.
    """
    places = []
    for k, (first, width) in enumerate(segments_of(count=count)):
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        by_syndrome = patterns(width, 1 + most // count)
        rows = ["array(" + ", ".join(f"{c}L" for c in row) + ")" for row in by_syndrome]
        table = F.expr("array(" + ", ".join(rows) + ")")
        home = F.expr("if(_s = 0, 0L, shiftleft(1L, _s - 1))")
        places.append(
            nodes.select("fp", value.alias("_v")).withColumn("_s", syndrome_of(F.col("_v"))).select(
                "fp", "_v", home.alias("_home"), F.explode(F.element_at(table, F.col("_s") + 1)).alias("_change"))
            .select((F.col("_v").bitwiseXOR(F.col("_change")) + F.lit(k << 40)).alias("anchor"), "fp",
                    (F.col("_change") == F.col("_home")).alias("home")))
    out = places[0]
    for more in places[1:]:
        out = out.unionByName(more)
    return out


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of those links (a, b) that join what earlier links have not."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(flat[:len(a)].tolist(), flat[len(a):].tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
    return np.array(keep, int)


def linked(group: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links within groups of equal number (sorted); at least one end is at home."""
    edge = np.flatnonzero(np.diff(group)) + 1
    begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(group)]])
    at = np.searchsorted(begin, np.arange(len(group)), "right") - 1
    rows = np.flatnonzero(home)
    sizes = (end - begin)[at[rows]]
    found_a, found_b = [], []
    ends = np.cumsum(sizes)
    i = 0
    while i < len(rows):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + step, "right")))
        n = sizes[i:j]
        left = np.repeat(rows[i:j], n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at[rows[i:j]]], n)
        near = np.bitwise_count(fp[left] ^ fp[right]) <= most
        near &= fp[left] < fp[right]
        a, b = fp[left[near]], fp[right[near]]
        if len(a):
            keep = forest(a, b)
            found_a.append(a[keep])
            found_b.append(b[keep])
        i = j
    if not found_a:
        none = np.zeros(0, np.uint64)
        return none, none
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    keep = forest(a, b)
    return a[keep], b[keep]


def links(nodes: DataFrame, most: int = 4, segments: int = 3, piece: int = 2048) -> DataFrame:
    """(a, b): links that join all fingerprints within ``most`` bits of one another, of distinct ``fp``.

    An anchor with more rows than ``piece`` is cut by a hash into as many pieces as bring each below
    it, and every two pieces meet once, so the largest comparison is bounded.
    """
    placed = at_anchors(nodes, most, segments)
    crowds = checkpointed(placed.groupBy("anchor").count().where(F.col("count") > piece).select(
        "anchor", F.ceil(F.col("count") / piece).cast("int").alias("pieces")))
    own = F.pmod(F.xxhash64("fp", F.lit("piece")), F.col("pieces")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1),
                         lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    cut = (
        placed.join(crowds, "anchor", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        .withColumn("own", own).select("anchor", "fp", "home", F.explode(others).alias("_p"))
        .select(F.xxhash64("anchor", "_p.i", "_p.j").alias("meeting"), "fp", "home")
    )
    dealt = cut.repartition(F.col("meeting")).sortWithinPartitions("meeting")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(rows: list[pd.DataFrame]) -> pd.DataFrame:
            all_ = pd.concat(rows)
            a, b = linked(all_["meeting"].to_numpy(), all_["fp"].to_numpy().view(np.uint64), all_["home"].to_numpy(bool), most)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        held: list[pd.DataFrame] = []  # rows of the meeting that the last batch ended in
        for batch in batches:
            if not len(batch):
                continue
            last = batch["meeting"] == batch["meeting"].iloc[-1]
            if held and last.all() and held[0]["meeting"].iloc[0] == batch["meeting"].iloc[0]:
                held.append(batch)
                continue
            whole = [*held, batch[~last]]
            held = [batch[last]]
            if sum(map(len, whole)):
                yield flush(whole)
        if held:
            yield flush(held)

    return dealt.mapInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4,
                    segments: int = 3, keep: list[str] | None = None) -> DataFrame:
    """(id, fingerprint, root, component_id): each row's class, and ``keep`` columns besides.

    ``root`` names the class by its smallest fingerprint.
    """
    kept = [id_col, *[c for c in keep or [] if c not in (id_col, "fingerprint", "root", "component_id")]]
    marked = fingerprints(docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("_text")), "_text", shingle)
    marked = marked.drop("_text")
    marked = checkpointed(marked)
    ids = checkpointed(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(F.col(f"`{id_col}`")).alias("least")))
    found = checkpointed(links(ids, most, segments))
    roots = components(found, "a", "b")
    named = ids.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    linked_only = named.join(roots.select("root").distinct(), "root", "left_semi")
    best = linked_only.groupBy("root").agg(F.min("least").alias("named"))
    table = checkpointed(named.join(best, "root", "left").select("fp", "root", F.coalesce("named", "least").alias("component_id")))
    return marked.join(table, marked["fingerprint"] == table["fp"]).drop("fp")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class: the one of the smallest id, among equal ids the one of the smallest text hash."""
    names = docs.columns
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], row_key(id_col, text_col).alias("_row"))
    classes = near_duplicates(keyed, id_col, text_col, keep=["_row"], **options)
    best = classes.groupBy("root").agg(F.min(F.struct(
        F.col(f"`{id_col}`").isNull().alias("late"), F.col(f"`{id_col}`").alias("id"), F.col("_row").alias("row"))).alias("best"))
    stay = checkpointed(best.select(F.col("best.row").alias("_row")))
    return keyed.join(stay, "_row", "left_semi").dropDuplicates(["_row"]).select(*[F.col(f"`{c}`") for c in names])
