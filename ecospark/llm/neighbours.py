"""Approximate nearest neighbours by cosine: a graph built by NN-descent, searched greedily.

Vectors of one direction (equal once scaled to length one, in single precision) are one node; of each, the
smallest ids that a result can need are kept, so a vector that a third of all rows share is one node with few names.
The graph starts from a few random orders in which near vectors stand together. Each round then joins every node's
neighbours, both ways, with their vectors, compares neighbours of neighbours in a local set, and keeps each node's
best. A node that very many others point to takes part in a bounded number of local sets, chosen by a hash.
Distances are squared differences of the unit vectors, summed in double precision, which tell near copies apart.

A query is one row with a list of bounded length, and starts at its own node. A round opens the best unopened nodes of
every list: only these are joined with their links and, so reached, with vectors. The search ends when the whole list is
open. All of the list is scored again in double precision on the vectors as given.

Everything that grows with the table stays in joins and windows; the driver sees counts.

Defined cases. Vectors that are null, empty, zero, or hold a null or non-finite component take
no part, nor do vectors of another length than the most frequent one. Rows of one id and vector are one; rows of one id
and several vectors are told apart by their vectors. Components near the limits of doubles are scaled by a power
of two first, so nothing overflows. Vectors of one direction but several lengths count as tied: the smallest ids stay.
With fewer candidates than asked for, all are returned. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

BLOCK = 64


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part; vec in double precision, times a power of two."""
    vec = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    fine = vectors.select(F.col(f"`{id_col}`").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & F.coalesce(F.size("vec") > 0, F.lit(False))
        & F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists("vec", lambda x: x != 0))
    sizes = fine.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    most = F.array_max(F.transform("vec", F.abs))
    scale = F.pow(F.lit(2.0), F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), -F.floor(F.log2(most)).cast("double"))))
    scaled = fine.where(F.size("vec") == (sizes[0]["n"] if sizes else 0)).withColumn("scale", scale)
    return scaled.select("id", F.transform("vec", lambda x: x * F.col("scale")).alias("vec"))


def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vec, code) from (id, vec): the unit vector in single precision."""
    for batch in batches:
        if batch.num_rows:
            x = batch["vec"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)  # no negative zero
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["vec"], pa.array([r.tobytes() for r in unit], pa.binary())], names=["id", "vec", "code"])


def classes(rows: DataFrame, names: int) -> DataFrame:
    """(node, code, names): a node for each direction, with its ``names`` smallest ids and their vectors."""
    ranked = rows.withColumn("nr", F.dense_rank().over(Window.partitionBy("code").orderBy("id"))).where(F.col("nr") <= names)
    named = ranked.groupBy("code").agg(F.collect_set(F.struct("id", "vec")).alias("names"))
    return named.select(F.monotonically_increasing_id().alias("node"), "code", "names")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors from their codes, in single precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(np.float32).reshape(len(column), -1)


def apart(x: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of each matrix of a stack."""
    x = x.astype(float)
    size = np.einsum("...ij,...ij->...i", x, x)
    return np.maximum(size[..., :, None] + size[..., None, :] - 2 * (x @ np.swapaxes(x, -1, -2)), 0)


def table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that no group of equal ``key`` crosses, from sorted batches; groups are small."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = pa.concat_tables([held, part]) if held is not None else part
        keys = part[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield part.slice(0, cut).combine_chunks()
        held = part.slice(cut)
    if held is not None:
        yield held.combine_chunks()


EDGES = "src long, dst long, dist float"


def first_graph(nodes: DataFrame, k: int, orders: int, seed: int) -> DataFrame:
    """(src, dst, dist): neighbours within blocks of a few random orders.

    An order sorts by the signs of random projections, then by one more; a range exchange deals it
    out, so no group grows with the data.
    """
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["code"])
            random = np.random.default_rng(seed)
            for tree in range(orders):
                planes = random.standard_normal((x.shape[1], 21))
                made = x.astype(float) @ planes
                key = (made[:, :20] > 0) @ (2.0 ** np.arange(19, -1, -1)) + 1 / (1 + np.exp(-made[:, 20]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), tree, np.int32)), pa.array(key), batch["node"], batch["code"]], names=["tree", "key", "node", "code"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, trees = batch["node"].to_numpy(), batch["tree"].to_numpy()
            for a in range(0, len(ids), BLOCK):
                a = max(0, min(a, len(ids) - BLOCK))  # the last block is as long as the others
                own = ids[a:a + BLOCK]
                dist = apart(matrix(batch["code"].slice(a, BLOCK)))
                dist[trees[a:a + BLOCK, None] != trees[None, a:a + BLOCK]] = np.inf
                np.fill_diagonal(dist, np.inf)
                n = min(k, len(own) - 1)
                if n < 1:
                    continue
                best = np.argpartition(dist, n - 1, 1)[:, :n]
                near = np.take_along_axis(dist, best, 1)
                kept = near < np.inf
                yield table(src=np.repeat(own, kept.sum(1)), dst=own[best][kept], dist=near[kept].astype(np.float32))

    placed = nodes.select("node", "code").mapInArrow(place, "tree int, key double, node long, code binary")
    # Materialised, as a range exchange reads its input twice.
    dealt = checkpointed(placed).repartitionByRange("tree", "key").sortWithinPartitions("tree", "key")
    return dealt.mapInArrow(meet, EDGES)


def best_of(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges of each node, each once."""
    by_src = Window.partitionBy("src").orderBy("dist", "dst")
    once = edges.repartition("src").groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("new").alias("new"))
    return once.withColumn("nr", F.row_number().over(by_src)).where(F.col("nr") <= k).drop("nr")


def both_ways(graph: DataFrame, most: int, turn: int) -> DataFrame:
    """(node, others): ends of edges and of reversed edges, at most ``most`` of the latter per node, by a hash."""
    back = Window.partitionBy("node").orderBy(F.xxhash64("other", F.lit(turn)), "other")
    turned = graph.select(F.col("dst").alias("node"), F.col("src").alias("other"), "new")
    some = turned.withColumn("nr", F.row_number().over(back)).where(F.col("nr") <= most).drop("nr")
    both = graph.select(F.col("src").alias("node"), F.col("dst").alias("other"), "new").unionByName(some)
    once = both.repartition("node").groupBy("node", "other").agg(F.max("new").alias("new"))
    return once.groupBy("node").agg(F.collect_list(F.struct("other", "new")).alias("others"))


def descend(graph: DataFrame, nodes: DataFrame, k: int, turn: int) -> DataFrame:
    """One round: what neighbours of neighbours add to the graph. Pairs of two old neighbours have met before."""
    ceiling = graph.groupBy("src").agg(F.max("dist").alias("ceiling"), F.count("*").alias("n")).select(
        F.col("src").alias("other"), F.when(F.col("n") < k, F.lit(9.0).cast("float")).otherwise(F.col("ceiling")).alias("ceiling"))
    vectors = nodes.select(F.col("node").alias("other"), "code").join(ceiling, "other")
    lively = both_ways(graph, k, turn).where(F.exists("others", lambda o: o["new"]))
    sets = lively.select("node", F.explode("others").alias("o")).select("node", "o.*").join(vectors, "other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "node"):
            sets_, ids, most = part["node"].to_numpy(), part["other"].to_numpy(), part["ceiling"].to_numpy()
            x, fresh = matrix(part["code"]), part["new"].to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(np.diff(sets_)) + 1, [len(sets_)]])
            for a in range(0, len(edge) - 1, 256):
                some = edge[a:a + 257]
                sizes = np.diff(some)
                at = np.minimum(some[:-1, None] + np.arange(sizes.max()), some[1:, None] - 1)
                inside = np.arange(sizes.max()) < sizes[:, None]
                dist = apart(x[at]).astype(np.float32)
                young = fresh[at]
                better = (dist < most[at][:, :, None]) & (young[:, :, None] | young[:, None, :])
                better &= inside[:, :, None] & inside[:, None, :]
                better[:, np.arange(sizes.max()), np.arange(sizes.max())] = False
                g, i, j = np.nonzero(better)
                yield table(src=ids[at[g, i]], dst=ids[at[g, j]], dist=dist[g, i, j])

    found = sets.select("node", "other", "new", "ceiling", "code").repartition("node").sortWithinPartitions("node").mapInArrow(compare, EDGES)
    old = graph.select("src", "dst", "dist", F.lit(False).alias("new"))
    return best_of(old.unionByName(found.withColumn("new", F.lit(True))), k)


class Index:
    """``rows`` (id, vec, code), ``nodes`` (node, code, names), ``links`` (node, others); results of up to ``most`` rows."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, links: DataFrame, most: int):
        self.rows, self.nodes, self.links, self.most = rows, nodes, links, most


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 24, orders: int = 4,
          most_rounds: int = 10, still: float = 0.02, most: int = 5, seed: int = 11) -> Index:
    """Index all rows for results of up to ``most`` rows; rounds end when less than a share ``still`` of all edges changes."""
    rows = checkpointed(valid(vectors, id_col, vec_col).mapInArrow(codes, "id long, vec array<double>, code binary"))
    nodes = checkpointed(classes(rows, most + 1))
    graph = checkpointed(best_of(first_graph(nodes, k, orders, seed).withColumn("new", F.lit(True)), k))
    for turn in range(most_rounds):
        graph = checkpointed(descend(graph, nodes, k, turn))
        edges, changed = graph.agg(F.count("*"), F.count_if("new")).first()
        if changed <= still * edges:
            break
    links = checkpointed(both_ways(graph, k, -1).select("node", F.col("others.other").alias("others")))
    return Index(rows, nodes, links, most)


STATE = "query long, code binary, ids array<long>, dists array<float>, opened array<boolean>"


def search(index: Index, queries: DataFrame, beam: int = 200, width: int = 64) -> DataFrame:
    """``STATE`` rows: each query's list of its best ``beam`` nodes.

    ``queries`` has (query, code), where a query is a node. A round opens the best ``width`` unopened nodes of each list.
    """
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The list of each query, which comes first in its group, with the nodes just reached."""
        for part in whole_groups(batches, "query"):
            asked, nodes, x = part["query"].to_numpy(), part["node"].to_numpy(zero_copy_only=False), matrix(part["code"])
            edge = np.concatenate([[0], np.flatnonzero(np.diff(asked)) + 1, [len(asked)]])
            first = part.take(pa.array(edge[:-1]))
            made = []
            for g, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
                ids = np.array(first["ids"][g].as_py(), np.int64)
                dists = np.array(first["dists"][g].as_py(), np.float32)
                opened = np.array(first["opened"][g].as_py(), bool)
                opened[np.flatnonzero(~opened)[:width]] = True
                gap = x[a + 1:b].astype(float) - x[a]
                ids = np.concatenate([ids, nodes[a + 1:b].astype(np.int64)])
                dists = np.concatenate([dists, np.einsum("ij,ij->i", gap, gap).astype(np.float32)])
                opened = np.concatenate([opened, np.zeros(b - a - 1, bool)])
                best = np.lexsort((ids, dists))[:beam]
                made.append((ids[best], dists[best], opened[best]))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(m[0]) for m in made])]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([m[i] for m in made]))) for i in range(3)]
            plain = [first[c].combine_chunks() for c in ("query", "code")]
            yield pa.RecordBatch.from_arrays([*plain, *lists], names=["query", "code", "ids", "dists", "opened"])

    state = checkpointed(queries.select(
        "query", "code", F.array("query").alias("ids"), F.array(F.lit(0.0).cast("float")).alias("dists"), F.array(F.lit(False)).alias("opened")))
    closed = F.filter(F.arrays_zip("ids", "opened"), lambda z: ~z["opened"])
    while state.where(F.exists("opened", lambda o: ~o)).limit(1).count():
        front = state.select("query", F.explode(F.slice(closed, 1, width)["ids"]).alias("node"))
        near = front.join(index.links, "node").groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
        fresh = near.join(state.select("query", "ids"), "query").select("query", F.explode(F.array_except("others", "ids")).alias("node"))
        reached = fresh.join(index.nodes.select("node", "code"), "node")
        both = state.withColumn("node", F.lit(None).cast("long")).unionByName(reached, allowMissingColumns=True)
        state = checkpointed(both.repartition("query").sortWithinPartitions("query", F.asc_nulls_first("node")).mapInArrow(merge, STATE))
    return state


def nearest_to_rows(index: Index, which: Column, k: int = 5, beam: int = 200) -> DataFrame:
    """(query, rank, id, score): the k nearest rows of the indexed rows that ``which`` (on ``id``) picks.

    A query starts at its own node and never finds itself; rows of one direction walk once.
    """
    if k > index.most:
        raise ValueError(f"the index is built for {index.most} results")
    asked = index.rows.where(which).distinct().join(index.nodes.select("node", "code"), "code")
    own = checkpointed(asked.select(F.col("id").alias("query"), F.col("node").alias("start"), F.col("vec").alias("wanted"), "code"))
    found = search(index, own.select(F.col("start").alias("query"), "code").distinct(), beam)
    dot = F.aggregate(F.zip_with("vec", "wanted", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)

    def size(name: str) -> Column:
        return F.sqrt(F.aggregate(name, F.lit(0.0), lambda a, x: a + x * x))

    listed = own.drop("code").join(found.select(F.col("query").alias("start"), "ids"), "start").select("query", "wanted", F.explode("ids").alias("node"))
    pairs = listed.join(index.nodes.select("node", "names"), "node").select("query", "wanted", F.explode("names").alias("name"))
    pairs = pairs.select("query", "wanted", "name.*").where(F.col("id") != F.col("query"))
    scored = pairs.select("query", "id", (dot / (size("vec") * size("wanted"))).alias("score"))
    once = scored.groupBy("query", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")
