"""Hard-negative mining with scores by the method of Four Russians.

Vectors become whole numbers, floor(256 x). A candidate is packed as bit planes: per plane one byte for
every eight dimensions, the last plane being the sign of two's complement. For an anchor, each group of
eight dimensions has a table of its 256 subset sums. A score is the sum over planes of the tables' entries at
the candidate's bytes, shifted by the plane; it is the exact inner product. No product is taken.

Anchors are a stated part of all rows, and all rows are candidates. So anchors and candidates are
cut into blocks of bounded size, every candidate block visits every anchor block by an equi-join
of block numbers, and each meeting hands on its few best rows per anchor. The first pass finds the
positives, the second the negatives whose scores lie in the band that each positive opens.

Defined cases. Rows with a null id or label, a null vector, or a null or non-finite component take no
part. Vectors of different lengths are filled up with zeros. Whole components are bounded by 2 ** 27
in size (x by 524,288), so that sums stay exact. Repeated rows are rows of their own: each is an
anchor, and a positive or negative of others. A positive of a score below zero opens no band. An
anchor without positives and a positive without negatives give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

MOST = 1 << 27
#: Anchors scored at once in a meeting; with the block size it bounds a task's memory.
STEP = 64


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(row, id, label, x): the rows that take part, with whole components."""
    vec = F.transform(F.col(f"`{vec_col}`"), lambda v: v.cast("double"))
    fine = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("vec")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))))
    x = F.transform("vec", lambda v: F.floor(F.least(F.greatest(v * 256, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("long"))
    return fine.select(F.monotonically_increasing_id().alias("row"), "id", "label", x.alias("x"))


def packed(x: np.ndarray, planes: int) -> np.ndarray:
    """Bytes (rows, planes, groups of eight dimensions) of whole numbers in two's complement."""
    bits = (x[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables (anchors, groups, 256): the sums of every subset of eight components."""
    eight = anchors.reshape(len(anchors), -1, 8)
    out = np.zeros((*eight.shape[:2], 1), np.int64)
    for i in range(8):  # each component doubles the table
        out = np.concatenate([out, out + eight[:, :, i:i + 1]], axis=2)
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (anchors, candidates) by lookups, shifts and sums."""
    out = np.zeros((len(tables), len(planes)), np.int64)
    last = planes.shape[1] - 1
    for p in range(last + 1):
        made = np.zeros_like(out)
        for g in range(planes.shape[2]):
            made += tables[:, g, :].take(planes[:, p, g], axis=1)
        if p == last:
            out -= made << p
        else:
            out += made << p
    return out


def first_by_score(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest values, ties to the smaller id."""
    if len(values) > k:
        floor = np.partition(values, len(values) - k)[len(values) - k]
        some = np.flatnonzero(values >= floor)
    else:
        some = np.arange(len(values))
    return some[np.lexsort((ids[some], -values[some]))][:k]


def as_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column filled up with zeros to a width of whole groups of eight."""
    column = column.combine_chunks()
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def as_planes(column: pa.ChunkedArray, planes: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return raw.reshape(len(column), planes, -1)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                   positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95), anchor_block: int = 1024,
                   block: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``; ``label`` an expression on the table's columns. A negative's score
    times 100 lies between the positive's score times the two numbers of ``band``.
    """
    rows = checkpointed(whole_numbers(vectors, id_col, vec_col, label))
    size = rows.agg(F.max(F.size("x")), F.max(F.greatest(F.array_max("x"), -1 - F.array_min("x"))), F.count("*")).head()
    width = -(-max(size[0] or 0, 1) // 8) * 8
    planes = int(size[1] or 0).bit_length() + 1
    blocks = max(1, -(-size[2] // block))
    chosen = rows.where(is_anchor)
    anchor_blocks = max(1, -(-chosen.count() // anchor_block))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = packed(as_matrix(pa.chunked_array([batch["x"]]), width), planes)
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["id"], batch["label"], pa.array([r.tobytes() for r in some], pa.binary())],
                names=["row", "id", "label", "planes"])

    candidates = checkpointed(rows.mapInArrow(pack, "row long, id long, label long, planes binary"))
    candidates = candidates.withColumn("j", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    anchors = chosen.withColumn("i", F.pmod(F.xxhash64("row"), F.lit(anchor_blocks)).cast("int")).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, seen = right["id"].to_numpy(), right["label"].to_numpy(), right["row"].to_numpy()
        bits = as_planes(right["planes"], planes)
        own, own_label = left["row"].to_numpy(), left["label"].to_numpy()
        x = as_matrix(left["x"], width)
        out: list[list] = [[], [], []]
        for a in range(0, len(own), STEP):
            made = scores(subset_sums(x[a:a + STEP]), bits)
            for k in range(len(made)):
                some = np.flatnonzero((labels == own_label[a + k]) & (seen != own[a + k]))
                best = some[first_by_score(made[k, some], ids[some], positives)]
                out[0].append(np.full(len(best), own[a + k]))
                out[1].append(ids[best])
                out[2].append(made[k, best])
        return as_table(out, ["row", "positive_id", "positive_score"])

    def as_table(columns: list[list], names: list[str]) -> pa.Table:
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in columns], names=names)

    met = anchors.groupBy("i", "j").cogroup(candidates.groupBy("i", "j")).applyInArrow(
        best_positives, "row long, positive_id long, positive_score long")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    good = checkpointed(met.withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= positives))
    # At most ``positives`` numbers an anchor.
    bands = good.groupBy("row").agg(F.collect_list(F.struct("nr", "positive_score")).alias("all")).select(
        "row", F.col("all.nr").alias("nrs"), F.col("all.positive_score").alias("floors"))

    def best_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels = right["id"].to_numpy(), right["label"].to_numpy()
        bits = as_planes(right["planes"], planes)
        own, own_label = left["row"].to_numpy(), left["label"].to_numpy()
        nrs, floors = left["nrs"].to_pylist(), left["floors"].to_pylist()
        x = as_matrix(left["x"], width)
        out: list[list] = [[], [], [], []]
        for a in range(0, len(own), STEP):
            made = scores(subset_sums(x[a:a + STEP]), bits)
            for k in range(len(made)):
                other = np.flatnonzero(labels != own_label[a + k])
                values = made[k, other]
                for nr, floor in zip(nrs[a + k], floors[a + k], strict=True):
                    # Whole bounds, so that nothing is multiplied that could overflow.
                    inside = other[(values >= -(-band[0] * floor // 100)) & (values <= band[1] * floor // 100)]
                    best = inside[first_by_score(made[k, inside], ids[inside], negatives)]
                    out[0].append(np.full(len(best), own[a + k]))
                    out[1].append(np.full(len(best), nr))
                    out[2].append(ids[best])
                    out[3].append(made[k, best])
        return as_table(out, ["row", "nr", "negative_id", "negative_score"])

    again = anchors.join(bands, "row").groupBy("i", "j").cogroup(candidates.groupBy("i", "j")).applyInArrow(
        best_negatives, "row long, nr long, negative_id long, negative_score long")
    place = Window.partitionBy("row", "nr").orderBy(F.desc("negative_score"), "negative_id")
    found = again.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
    named = good.join(chosen.select("row", F.col("id").alias("anchor_id")), "row")
    return named.join(found, ["row", "nr"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
