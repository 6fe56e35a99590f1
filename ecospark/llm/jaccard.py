"""N-gram Jaccard join over a token-group matrix.

A document is its set of word shingles, each a 64-bit token. Equal sets are one node. Two sets of
Jaccard similarity t or more share at least ceil(t n) tokens, so by the order of the tokens they
share at least l(n) of their first n - ceil(t n) + l(n) ones.

1. Tokens that a single node holds bring no overlap. Nodes with too few others leave: first by the
   columns of that prefix, laid out for all nodes in one exchange, then by whole sets, laid out for
   the nodes that stayed. Texts that merely share a passage go here. No link is lost.
2. A token names some of its nodes as pivots, and a node is compared with those that most of its
   tokens name. Linked nodes form partitions of similar documents. A few rounds of this join
   most of what belongs together, in time linear in the size of a partition.
3. Nodes that can still have links beyond their partition are dealt to groups of similar ones, of
   bounded size. A group's row of the matrix is the union of its members' tokens. Groups meet where a
   member of each holds the same one of its rarest tokens; then the overlap of every member with the
   other group's union bounds its similarity to all that are in there.
4. Only groups whose bound reaches the threshold are opened, and only for the members that reach
   it, which are compared on whole sets. Links join partitions into components.

Links within a partition are not all listed: a component is what they are needed for. A group
of near copies with a third of all rows is one partition after step 2 and costs no pairs.
A set that is wanted by many (a pivot) is dealt to as many pieces as its visitors need.

Defined cases. A null, an empty and a blank text have no shingles and are linked with nothing.
Texts with fewer words than a shingle are one shingle. Repeated rows and texts of equal sets are
linked. A component is named after its smallest id; rows without an id are named only by
others. Shingles are told apart by 64 bits, sets by 128. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed, drop_path, scratch_path
from .graph import components
from .simhash import forest

#: Words whose hashes a task keeps at once.
HELD = 100_000
#: Texts that a task holds at once besides the batch they come in.
TEXTS = 256
#: Rows and columns of a piece of an opened pair of groups, and tokens that it is compared on at once.
TILE, TOKENS = 512, 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words, each computed once while it is held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct tokens of a text."""
    words = text.encode().lower().split() if text else []  # bytes split at the six ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 8)], np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    made = _mixed(each[:n])
    for i in range(1, size):
        made = _mixed(made * _ODD + each[i:i + n])
    return np.unique(made)


def needed(n, share: tuple[int, int]):
    """Least overlap of a set of n with any partner, for columns as well as numbers."""
    up = share[0] * n + (share[1] - 1)
    return F.floor(up / share[1]) if isinstance(n, Column) else up // share[1]


def margin(n):
    """How many tokens beyond the plain prefix are laid out."""
    return 1 + (F.floor(n / 8) if isinstance(n, Column) else n // 8)


def laid_out(n, share: tuple[int, int]):
    """Number of a set's first tokens in the matrix."""
    return n - needed(n, share) + margin(n)


def least_shared(n, share: tuple[int, int]):
    """How many of its laid-out tokens a set shares with any partner."""
    return margin(needed(n, share))


def lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def sets_of(text: Column, size: int, share: tuple[int, int] | None) -> Column:
    """Struct of n, key (128 bits of the set) and tokens: those laid out, or all if ``share`` is None."""

    def scan(texts: pa.Array) -> pa.Array:
        known = _Hashes()
        keys, counts, parts = [], [], []
        for first in range(0, len(texts), TEXTS):
            for text in texts.slice(first, TEXTS).to_pylist():
                tokens = shingle_set(text, size, known)
                keys.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                counts.append(len(tokens))
                # A copy, so that what is not laid out is not held.
                parts.append(tokens if share is None or not len(tokens) else tokens[:laid_out(len(tokens), share)].copy())
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), lists(parts)], ["n", "key", "tokens"])

    return F.arrow_udf(scan, "struct<n:long,key:binary,tokens:array<long>>")(text)


def verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int], piece: int = 256) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough.

    A ``b`` with more than ``piece`` visitors is dealt to several pieces.
    """
    pairs = checkpointed(pairs)
    crowd = pairs.groupBy("b").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"))
    # Every row of ``crowd`` brings one set, repeated once per ``piece`` of its visitors.
    held = crowd.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b").select(
        "b", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "nb", "tb")
    guests = pairs.join(crowd, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("pieces")).cast("int").alias("piece"))
    guests = guests.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")
    met = guests.join(held, ["b", "piece"]).where(
        (F.col("na") * share[1] >= F.col("nb") * share[0]) & (F.col("nb") * share[1] >= F.col("na") * share[0]))
    both = F.size(F.array_intersect("ta", "tb")).cast("long")
    return met.where(both * (share[0] + share[1]) >= (F.col("na") + F.col("nb")) * share[0]).select("a", "b")


def most_named(pivots: Column, most: int = 2) -> Column:
    """The ``most`` values that occur most often in a list, as a list."""

    def choose(lists_: pa.Array) -> pa.Array:
        flat = lists_.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum([0, *pc.list_value_length(lists_).to_pylist()])
        out = []
        for i in range(len(lists_)):
            who, times = np.unique(flat[ends[i]:ends[i + 1]], return_counts=True)
            out.append(who[np.argsort(-times, kind="stable")[:most]].astype(np.int64).view(np.uint64))
        return lists(out)

    return F.arrow_udf(choose, "array<long>")(pivots)


def shared_tokens(rows: DataFrame, mark: str, turn: int) -> DataFrame:
    """Rows (token, node, mark) whose token stands under two values of ``mark`` or more, with its count ``df``.

    Every fourth token names pivots: its smallest mark, its largest one, and a node by a hash.
    """
    of = "over (partition by token)"
    counted = rows.selectExpr("*", f"count(*) {of} AS df", f"min({mark}) {of} AS lo", f"max({mark}) {of} AS hi",
                              f"min_by(node, xxhash64(node, {turn})) {of} AS other").where("lo < hi")
    names = F.when(F.pmod("token", F.lit(4)) == turn % 4, F.array("lo", "hi", "other"))
    return counted.withColumn("named", names).drop("lo", "hi", "other")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                      share: tuple[int, int] = (85, 100), group: int = 1 << 17, rounds: int = 4, still: float = 0.9) -> DataFrame:
    """(id, n_shingles, component_id) of every row; ``share`` is the least similarity as a fraction.

    A group holds about ``group`` tokens. Partitions are formed in ``rounds`` rounds at most, fewer if one leaves more
    than a part ``still`` of the nodes in question; what stays apart is left to the matrix, so they change the cost, not the result.
    """
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    wide = scratch_path(docs.sparkSession, "table")
    scanned = checkpointed(docs.select(id_.alias("id"), sets_of(text, shingle, share).alias("s")).select(
        F.monotonically_increasing_id().alias("row"), "id", "s.*"), wide)
    # Written once, so the row numbers are fixed; the smallest row of a set is its node.
    marked = checkpointed(scanned.drop("tokens"))
    reps = checkpointed(marked.where("n > 0").groupBy("key").agg(
        F.min("row").alias("node"), F.min("id").alias("least"), F.first("n").alias("n")))
    laid = first_copies(scanned, marked, reps).select(F.explode("tokens").alias("token"), F.col("row").alias("node"))
    met = shared_tokens(laid, "node", 0).groupBy("node").agg(F.count("*").alias("met"))
    near = checkpointed(met.join(reps, "node").where(F.col("met") >= least_shared(F.col("n"), share)).select("node", "n", "key", "least"))
    drop_path(docs.sparkSession, wide)  # the largest table; no later step reads the laid-out tokens
    sets = whole_sets(docs, near, id_, text, shingle)
    left = in_question(near, None, sets, share, 0)
    many, links, parts = left.count(), None, None
    for turn in range(1, rounds + 1):
        asked = left.select(F.col("node").alias("a"), F.col("n").alias("na"), F.explode("pivots").alias("b")).where("a <> b")
        # Sizes are compared before any set is sent.
        fit = asked.join(near.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b").where(
            (F.col("na") * share[1] >= F.col("nb") * share[0]) & (F.col("nb") * share[1] >= F.col("na") * share[0]))
        found = checkpointed(verified(fit.select("a", "b"), sets, share))
        links = found if links is None else links.unionByName(found)
        parts = checkpointed(components(links))
        left = in_question(left, parts, sets, share, turn)
        before, many = many, left.count()
        if many > still * before:
            break
    links = links.unionByName(opened(left, parts, sets, share, group))
    roots = checkpointed(components(links))
    named = reps.select("key", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = named.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("name"))
    names = named.join(linked, "root", "left").select("key", F.coalesce("name", "least").alias("component_id"))
    found = marked.where("n > 0").select("id", "n", "key").join(names, "key").select("id", "n", "component_id")
    empty = marked.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(empty).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def first_copies(scanned: DataFrame, marked: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of ``scanned`` without further copies of a set.

    The copies are listed, not the nodes: the list is shorter, and while it is small the tokens are not exchanged for it.
    """
    copies = marked.where("n > 0").select("row", "key").join(reps.select("key", "node"), "key").where("row <> node").select("row")
    return scanned.join(checkpointed(copies), "row", "left_anti")


def whole_sets(docs: DataFrame, near: DataFrame, id_: Column, text: Column, shingle: int) -> DataFrame:
    """(node, n, tokens) with all tokens of the nodes that stayed, from the texts once more."""
    ids = checkpointed(near.select("least").distinct())
    some = docs.select(id_.alias("id"), text.alias("text")).join(ids, F.col("id").eqNullSafe(F.col("least")), "left_semi")
    # A key that may be null makes Spark infer a filter on it, and so scan all texts before the semi join.
    made = some.select(sets_of(F.col("text"), shingle, None).alias("s")).select(
        F.coalesce("s.key", F.lit(b"")).alias("key"), "s.n", "s.tokens")
    # By key, as the join has dealt them, so the sets are not exchanged once more.
    return checkpointed(made.join(near.select("key", "node"), "key").dropDuplicates(["key"]).select("node", "n", "tokens"))


def token_rows(left: DataFrame, parts: DataFrame | None, sets: DataFrame) -> DataFrame:
    """(token, node, n, part) of the nodes of ``left``; without ``parts`` each node is a part of its own."""
    placed = left.select("node", "n")
    if parts is None:
        placed = placed.withColumn("part", F.col("node"))
    else:
        placed = placed.join(parts, "node", "left").select("node", "n", F.coalesce("root", "node").alias("part"))
    return placed.join(sets.select("node", "tokens"), "node").select(F.explode("tokens").alias("token"), "node", "n", "part")


def in_question(left: DataFrame, parts: DataFrame | None, sets: DataFrame, share: tuple[int, int], turn: int) -> DataFrame:
    """(node, n, pivots): nodes that share enough tokens with other parts, and whom these tokens name."""
    met = shared_tokens(token_rows(left, parts, sets), "part", turn).groupBy("node").agg(
        F.first("n").alias("n"), F.count("*").alias("met"), F.flatten(F.collect_list("named")).alias("named"))
    stay = met.where(F.col("met") >= needed(F.col("n"), share))
    return checkpointed(stay.select("node", "n", most_named(F.col("named")).alias("pivots")))


def overlaps(a: tuple, b: tuple, common: int) -> np.ndarray:
    """Numbers of shared tokens of two pieces, each given by its group's rows (sorted), their tokens, its first row and the group's size."""
    sides = []
    for row, at, first, n in (a, b):
        piece = slice(*np.searchsorted(row, [first, first + TILE]))
        sides.append((row[piece] - first, at[piece], min(TILE, n - first)))
    both = np.zeros((sides[0][2], sides[1][2]), np.float32)
    for start in range(0, common, TOKENS):
        dense = []
        for row, at, n in sides:
            some = (at >= start) & (at < start + TOKENS)
            cells = np.zeros((n, TOKENS), np.float32)
            cells[row[some], at[some] - start] = 1
            dense.append(cells)
        both += dense[0] @ dense[1].T
    return both.astype(np.int64)


def opened(left: DataFrame, parts: DataFrame, sets: DataFrame, share: tuple[int, int], group: int) -> DataFrame:
    """Links (a, b) that join nodes of different partitions, through the token-group matrix."""
    label = left.select("node", F.coalesce(F.get("pivots", F.lit(0)), F.col("node")).alias("label"))
    cross = shared_tokens(token_rows(left, parts, sets), "part", 0).groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"), F.first("n").alias("n"), F.first("part").alias("part"))
    bound = needed(F.col("n"), share).cast("int")
    last = cross.where(F.size("held") >= bound).join(label, "node").select(
        "node", "n", "part", "label", F.col("held.token").alias("tokens"),
        # Rarest first; a node shares one of these with every partner.
        F.slice("held.token", F.lit(1), F.size("held") - bound + 1).alias("rare"))
    last = checkpointed(last)
    sizes = last.groupBy("label").agg(F.ceil(F.sum("n") / group).cast("int").alias("pieces"))
    member = checkpointed(last.join(sizes, "label").withColumn(
        "group", F.xxhash64("label", F.pmod(F.xxhash64("node"), F.col("pieces")))).drop("label", "pieces"))
    matrix = checkpointed(member.select(F.explode("rare").alias("token"), "group").distinct())
    met = matrix.join(matrix.withColumnRenamed("group", "other"), "token").where("group <= other").select("group", "other").distinct()
    met = checkpointed(met)
    held = ["node", "n", "part", "tokens"]
    one = member.select("group", *held).join(met, "group").select("group", "other", *held)
    # Names of its own, as both sides come from one table.
    two = member.select(F.col("group").alias("other"), *[F.col(c).alias(f"{c}_b") for c in held]).join(
        met, "other").selectExpr("group AS group_b", "other AS other_b", *[f"{c}_b" for c in held])

    def open_groups(a: pa.Table, b: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        b = b.rename_columns(a.column_names)
        union_a, union_b = (np.unique(t["tokens"].combine_chunks().flatten().to_numpy()) for t in (a, b))
        common = np.intersect1d(union_a, union_b, assume_unique=True)
        sides = []
        for t in (a, b):
            held = t["tokens"].combine_chunks()
            row = np.repeat(np.arange(len(t)), pc.list_value_length(held).to_numpy())
            flat = held.flatten().to_numpy()
            at = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
            inside = common[at] == flat if len(common) else np.zeros(len(flat), bool)
            row, at = row[inside], at[inside]
            n = t["n"].to_numpy()
            fits = np.bincount(row, minlength=len(t)) >= needed(n, share)
            if not fits.any():
                return none
            place = np.cumsum(fits) - 1
            sides.append((place[row[fits[row]]], at[fits[row]], n[fits], t["node"].to_numpy()[fits], t["part"].to_numpy()[fits]))
        (row_a, at_a, na, node_a, part_a), (row_b, at_b, nb, node_b, part_b) = sides
        found = np.zeros((2, 0), np.int64)
        for top in range(0, len(na), TILE):
            for side in range(0, len(nb), TILE):
                both = overlaps((row_a, at_a, top, len(na)), (row_b, at_b, side, len(nb)), len(common))
                one, two = slice(top, top + TILE), slice(side, side + TILE)
                close = both * (share[0] + share[1]) >= (na[one, None] + nb[None, two]) * share[0]
                i, j = np.nonzero(close & (part_a[one, None] != part_b[None, two]))
                found = np.hstack([found, [node_a[one][i], node_b[two][j]]])
                # Only links that join something are kept, so near copies do not pile up.
                found = found[:, forest(*found)]
        return pa.table({"a": pa.array(found[0]), "b": pa.array(found[1])})

    return one.groupBy("group", "other").cogroup(two.groupBy("group_b", "other_b")).applyInArrow(open_groups, "a long, b long")
