"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's documents, in the order of a hash, form blocks of equal size. Block j (from 1) of a
source of weight w is released at slot floor((j - 1) / w) and due by slot ceil(j / w); in every slot
the released block with the earliest deadline goes next, so every source's count stays within one
block of its target at every slot. Weights are whole numbers over their sum, so releases and deadlines are
exact, and there is no period.

The schedule is laid out by ranges of slots, all at once. A range begins with a guess of its sources'
counts: each is floor(w t) or one more, and those due first are the ones ahead. Where the range before ends
with other counts, the range is laid out again from these, until all agree. The result is that of one run
over all slots, since every round settles one more range at least, and runs that
begin apart soon agree.

Documents are numbered within their source in two levels: counts per (source, hash range) give
offsets, and rows are ranked within one range only, so a source with a third of all rows is
spread over many tasks, and so are rows of one id.

Defined cases. A null source is a source of its own. Sources without a weight, or with one of zero
or less, are never scheduled, but their rows are kept: their slot and position are null. Weights are taken
to 31 bits of the largest one, at least 1. Rows of equal id and text are interchangeable. An empty table gives no
rows. The slots of a source that has ended stay empty, so the others keep their proportions; the last slot
is the largest quotient of blocks and weight. New columns replace those of the same name, whatever its case; other
extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

FINE = 1 << 31


def named(source: Column) -> Column:
    """A source's key: never null, in the order of the names, null first."""
    return F.when(source.isNull(), F.lit("!")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def whole_weights(weights: DataFrame, source_col: str = "source", weight_col: str = "weight") -> DataFrame:
    """(source, share): the weights as whole numbers; one row per source, null first."""
    good = weights.where(F.col(weight_col) > 0).groupBy(F.col(source_col).alias("source")).agg(F.sum(weight_col).alias("weight"))
    return good.crossJoin(F.broadcast(good.agg(F.max("weight").alias("most")))).select(
        "source", F.ceil(F.col("weight") / F.col("most") * F.lit(float(FINE))).cast("long").alias("share"))


def schedule(shares: DataFrame, blocks: DataFrame, length: int = 1000) -> DataFrame:
    """(source, nr, slot): the slot of each of the first blocks of every source, by earliest deadline first.

    ``shares`` has (source, share), ``blocks`` (source, blocks). Slots run up to the last that a block needs. Among equal
    deadlines the source that comes first by name goes.
    """
    known = shares.join(blocks, shares["source"].eqNullSafe(blocks["source"])).select(shares["source"], "share", "blocks")
    # One row, as long as the list of sources.
    everything = checkpointed(shares.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "share"))).alias("all"), F.sum("share").alias("total")))
    total = everything.head()["total"]
    if total is None:
        return shares.select("source", F.lit(0).cast("long").alias("nr"), F.lit(0).cast("long").alias("slot")).limit(0)
    last = known.agg(F.max(F.expr(f"(blocks * {total}L + share - 1) div share"))).head()[0] or 0
    ranges = -(-last // length)
    first = shares.sparkSession.range(ranges).select(F.col("id").alias("r"), (F.col("id") * length).alias("t")).crossJoin(F.broadcast(everything))
    floors = f"transform(all, s -> t * s.share div {total}L)"
    # Those ahead at the start of a range: of the sources with a block under way, the first ones by deadline.
    due_first = (f"slice(array_sort(filter(transform(all, (s, i) -> named_struct('due', ((done[i] + 1) * {total}L + s.share - 1) div s.share, 'i', i, "
                 f"'part', t * s.share % {total}L)), x -> x.part > 0)), 1, cast(t - aggregate(done, 0L, (a, x) -> a + x) as int))")
    guess = first.withColumn("done", F.expr(floors)).withColumn("ahead", F.expr(f"transform({due_first}, x -> x.i)")).withColumn(
        "begin", F.expr("transform(done, (d, i) -> if(array_contains(ahead, i), d + 1, d))")).select("r", "t", "all", "begin")
    step = (f"transform(array(array_min(filter(transform(all, (s, i) -> if(acc.done[i] * {total}L div s.share <= slot, named_struct("
            f"'due', ((acc.done[i] + 1) * {total}L + s.share - 1) div s.share, 'i', i), null)), x -> x is not null))), "
            "p -> named_struct('done', transform(acc.done, (d, i) -> if(i = p.i, d + 1, d)), "
            "'out', concat(acc.out, array(named_struct('i', p.i, 'nr', acc.done[p.i])))))[0]")
    laid = F.expr(f"aggregate(sequence(t, t + {length - 1}), named_struct('done', begin, 'out', cast(array() as array<struct<i:int,nr:bigint>>)), (acc, slot) -> {step})")

    def lay(rows: DataFrame) -> DataFrame:
        made = rows.repartition("r").withColumn("_made", laid)
        return made.select("r", "t", "all", "begin", F.col("_made.done").alias("end"), F.col("_made.out").alias("out"))

    plan = checkpointed(lay(guess))
    while True:
        ends = plan.select((F.col("r") + 1).alias("r"), F.col("end").alias("right"))
        wrong = checkpointed(plan.select("r", "t", "all", "begin").join(ends, "r").where("begin <> right").select("r", "t", "all", F.col("right").alias("begin")))
        if wrong.isEmpty():
            break
        plan = checkpointed(plan.join(wrong.select("r"), "r", "left_anti").unionByName(lay(wrong)))
    slots = plan.select("all", "t", F.posexplode("out").alias("at", "x")).select(
        F.expr("all[x.i].source").alias("source"), F.col("x.nr").alias("nr"), (F.col("t") + F.col("at")).alias("slot"))
    return slots.join(F.broadcast(known.select(F.col("source").alias("_s"), "blocks")), F.col("source").eqNullSafe(F.col("_s"))).where(
        "nr < blocks").select("source", "nr", "slot")


def mix(docs: DataFrame, weights: DataFrame, block: int = 8, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", rows_per_range: int = 2000, length: int = 1000) -> DataFrame:
    """The documents with ``block_nr``, ``slot`` and ``mix_position``; to be read in the order of ``mix_position``.

    ``weights`` has columns (source, weight). ``rows_per_range`` sets the number of hash ranges by the row count,
    ``length`` the slots that are laid out in one piece.
    """
    new = ("block_nr", "slot", "mix_position")
    names = [c for c in docs.columns if c.lower() not in new]
    share = checkpointed(whole_weights(weights.select(weights.columns[0], weights.columns[1]).toDF("source", "weight")))
    ranges = max(1, -(-docs.count() // rows_per_range))
    # All columns travel in one struct, so that no name can clash.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), named(F.col(f"`{source_col}`")).alias("key"), F.md5(F.concat(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(" "), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))).alias("hash"))
    # Ranges of the hash in its own order, so that the order within a source does not depend on their number.
    range_ = F.floor(F.conv(F.substr("hash", F.lit(1), F.lit(8)), 16, 10).cast("double") * ranges / 2.0**32).cast("int")
    keyed = held.withColumn("range", range_)
    counts = checkpointed(keyed.groupBy("key", "range").count())
    sizes = counts.groupBy("key").agg(F.ceil(F.sum("count") / block).cast("long").alias("blocks"))
    plan = schedule(share.select(named(F.col("source")).alias("source"), "share"), sizes.withColumnRenamed("key", "source"), length)
    plan = plan.select(F.col("source").alias("key"), F.col("nr").alias("block_nr"), "slot")
    before = counts.selectExpr("key", "range", "sum(count) over (partition by key order by range) - count as before")
    numbered = keyed.withColumn("nr", F.expr("row_number() over (partition by key, range order by hash)"))
    # The join is on the window's keys, so the documents are not dealt anew.
    placed = numbered.join(before, ["key", "range"]).withColumn("nr", F.col("before") + F.col("nr") - 1)
    met = placed.withColumn("block_nr", F.expr(f"nr div {block}")).join(plan, ["key", "block_nr"], "left")
    return met.select(*[F.col("row").getField(c).alias(c) for c in names], "block_nr", "slot",
                      (F.col("slot") * block + F.col("nr") % block).alias("mix_position"))


def tempered_weights(docs: DataFrame, source_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """(source, weight): the square root of each source's size, which evens sources out without equalising them."""
    return docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(
        F.sqrt(F.sum(F.coalesce(F.col(f"`{size_col}`"), F.lit(0)))).alias("weight"))
