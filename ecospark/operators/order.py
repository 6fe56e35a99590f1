"""Global order without a global sort task: ranks, dense numbering, exact quantiles.

For ranks, rows are split into value buckets of about equal size. Bucket counts (a small table) give
each bucket its offset, and only rows of one bucket meet in one task. The bucket edges are
the only thing that reaches the driver. A value that fills a large share of the table is
cut further by a hash of the row key. Quantiles come from counts by the leading bits of the
values, bucket by bucket, and bring nothing to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from ..sources.tables import checkpointed
from .joins import join_nullsafe



def bucket_number(rows: int) -> int:
    """Buckets of about a million rows, within what the driver should hold as edges."""
    return min(max(rows // 1_000_000, 64), 10_000)


def bucket_edges(df: DataFrame, cols: Sequence[str], buckets: int) -> list[list[float]]:
    """Approximate quantiles of each column as strictly increasing split points."""
    probs = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(list(cols), probs, 1.0 / (2 * buckets))
    out = []
    for points in found:
        inner = sorted(set(points)) or [0.0]
        out.append([float("-inf"), *inner, float("inf")])
    return out


def with_buckets(
    df: DataFrame, cols: Sequence[str], buckets: int
) -> tuple[DataFrame, list[list[float]]]:
    """Add ``_b_<col>``, the number of the value bucket, for each column."""
    edges = bucket_edges(df, cols, buckets)
    binned = Bucketizer(
        inputCols=list(cols), outputCols=[f"_b_{c}" for c in cols],
        splitsArray=edges, handleInvalid="keep",
    ).transform(df)
    return binned, edges


def before(order: Sequence[str | Column], by: Sequence[str] = ()) -> Window:
    """Window over everything that sorts before the current row."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def global_rank(
    df: DataFrame, value: str, key: Column, name: str = "rank", buckets: int | None = None
) -> DataFrame:
    """Number the rows 1..n by value, equal values in the order of the hash of their key."""
    rows = df.where(q(value).isNotNull()).withColumns({"_h": F.md5(key.cast("string")), "_v": q(value).cast("double")})
    n = df.count()
    buckets = buckets or bucket_number(n)
    rows, edges = with_buckets(rows, ["_v"], buckets)
    spark = df.sparkSession
    lows = spark.createDataFrame([(float(i), e) for i, e in enumerate(edges[0])], "_b__v double, _low double")
    # A value that fills more than two buckets is the lowest of its own; it is cut by leading
    # hash digits into pieces of at most that many rows. One row per bucket at most.
    most = max(2 * n // buckets, 1)
    edge_rows = rows.join(F.broadcast(lows), "_b__v").where(F.col("_v") == F.col("_low")).groupBy("_b__v").agg(F.count("*").alias("_n"), F.first("_low").alias("_low"))
    heavy = checkpointed(edge_rows.where(F.col("_n") > most).select(
        "_b__v", "_low", F.ceil(F.log(F.col("_n") / most) / F.log(F.lit(16.0))).cast("int").alias("_digits")))
    rows = rows.join(F.broadcast(heavy), "_b__v", "left").withColumn(
        "_sub", F.when(F.col("_v") == F.col("_low"), F.substring(F.col("_h"), F.lit(1), F.col("_digits"))).otherwise(F.lit("~"))
    ).drop("_low", "_digits")
    bucket = ["_b__v", "_sub"]
    counts = rows.groupBy(*bucket).agg(F.count("*").alias("_n"))
    # A value of _n rows makes 16 _n / most pieces at most, so there are 17 times as many rows as buckets.
    offsets = counts.select(
        *bucket, F.coalesce(F.sum("_n").over(before(bucket)), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*bucket).orderBy("_v", "_h")
    return (
        rows.join(F.broadcast(offsets), bucket)
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .drop(*bucket, "_offset", "_h", "_v")
    )


def dense_index(df: DataFrame, key: str, name: str = "idx", digits: int = 3) -> DataFrame:
    """The distinct keys numbered 0..n-1 in the order of their md5."""
    keys = (
        df.select(key).where(F.col(key).isNotNull()).distinct()
        .withColumn("_h", F.md5(F.col(key).cast("string")))
        .withColumn("_b", F.substring("_h", 1, digits))
    )
    counts = keys.groupBy("_b").agg(F.count("*").alias("_n"))
    # At most 16 ** digits rows.
    offsets = counts.select(
        "_b", F.coalesce(F.sum("_n").over(before(["_b"])), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_b").orderBy("_h", key)
    return (
        keys.join(F.broadcast(offsets), "_b")
        .select(key, (F.col("_offset") + F.row_number().over(inside) - 1).alias(name))
    )


def order_key(value: Column) -> Column:
    """A long in the order of a double: exponent and fraction as whole numbers, with the sign.

    Both zeros are equal; infinities come beyond all numbers and NaN last.
    """
    size, one = F.abs(value), float(1 << 52)
    near = F.floor(F.log2(size))
    power = F.pow(F.lit(2.0), near)
    # The logarithm can be off by one next to a power of two.
    exponent = near + (size >= power * 2).cast("long") - (size < power).cast("long")
    fraction = (size / F.pow(F.lit(2.0), exponent) - 1) * one
    whole = (exponent + 1023) * F.lit(1 << 52) + fraction.cast("long")
    half = F.lit(2.0**537)  # numbers below the normal ones are whole multiples of 2 ** -1074
    key = (
        F.when(F.isnan(value), F.lit((2047 << 52) + 1))
        .when(size == float("inf"), F.lit(2047 << 52))
        .when(size < 2.0**-1022, (size * half * half).cast("long"))
        .otherwise(whole)
    )
    return F.when(value < 0, -key).otherwise(key)


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    buckets: int | None = None,
    piece: int = 1_000_000,
) -> DataFrame:
    """Exact interpolated quantiles: ``*by, variable, n, quantiles`` (an array like ``probs``).

    Radix selection: one pass counts the values by the leading bits of their order key; then only
    buckets that hold a wanted rank go on, cut by further bits while one holds more than ``piece``
    rows of different values (or the n-th part of all rows, for n ``buckets``). Counts are
    reduced within tasks, so a value that fills a table is one row; no more than the counts of
    one bucket meet in a window. A group without values has n = 0 and no quantiles.
    """
    by = list(by)
    group = [*by, "variable"]
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), q(c).cast("double").alias("value")) for c in cols])
    long = df.select(*by, F.explode(pairs).alias("_c")).select(*by, "_c.*").where(F.col("value").isNotNull())
    long = long.withColumn("_key", order_key(F.col("value")))
    shift = 44

    def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys, F.shiftright("_key", shift).alias("bucket")).agg(
            F.count("*").alias("cnt"), (F.max("_key") > F.min("_key")).alias("mixed"))

    def holding(spans: DataFrame) -> DataFrame:
        """Buckets that hold a wanted rank, once for each of its probabilities."""
        return checkpointed(
            spans.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
            .withColumn("_h", (F.col("n") - 1) * F.col("_p"))
            .withColumn("_lo", F.floor("_h")).withColumn("_hi", F.ceil("_h"))
            .where((F.col("first") <= F.col("_hi")) & (F.col("_lo") < F.col("first") + F.col("cnt"))))

    spans = counted(long, group).select(
        *group, "bucket", "cnt", "mixed", F.coalesce(F.sum("cnt").over(before(["bucket"], group)), F.lit(0)).alias("first"),
        F.sum("cnt").over(Window.partitionBy(*group)).alias("n"))
    wanted = holding(spans)
    if buckets:
        piece = max((wanted.agg(F.max("n")).head()[0] or 0) // buckets, 1)
    while shift > 0 and wanted.where("mixed").where(F.col("cnt") > piece).limit(1).count():
        old, shift = shift, shift - 11
        held = wanted.select(*group, F.col("bucket").alias("_old"), F.col("first").alias("_before"), "n").distinct()
        inside = join_nullsafe(long.withColumn("_old", F.shiftright("_key", old)), held, [*group, "_old"], "inner")
        finer = counted(inside, [*group, "_old", "_before", "n"])
        start = F.coalesce(F.sum("cnt").over(before(["bucket"], [*group, "_old"])), F.lit(0))
        wanted = holding(finer.select(*group, "bucket", "cnt", "mixed", (F.col("_before") + start).alias("first"), "n"))
    found = _of_buckets(long.withColumn("bucket", F.shiftright("_key", shift)), wanted, group)
    value = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_h") - F.col("_lo"))
    per_prob = [
        F.max(F.when(F.col("_p") == float(p), F.col("_q"))).alias(f"_q{i}")
        for i, p in enumerate(probs)
    ]
    known = (
        found.withColumn("_q", F.when(F.col("_vlo") == F.col("_vhi"), F.col("_vlo")).otherwise(value)).groupBy(*group, "n").agg(*per_prob)
        .select(*group, "n", F.array(*[F.col(f"_q{i}") for i in range(len(probs))]).alias("quantiles"))
    )
    names = F.explode(F.array(*[F.lit(c) for c in cols])).alias("variable")
    groups = df.select(*by).distinct().select(*by, names) if by else df.sparkSession.range(1).select(names)
    full = join_nullsafe(groups, known, group, "left")
    return full.select(*group, F.coalesce("n", F.lit(0).cast("long")).alias("n"), "quantiles")


def _of_buckets(long: DataFrame, wanted: DataFrame, group: list[str]) -> DataFrame:
    """``*group, n, _p, _h, _lo, _vlo, _vhi``: the values at the two ranks around each wanted place."""
    held = wanted.select(*group, "bucket", "first").distinct()
    candidates = (
        join_nullsafe(long, held, [*group, "bucket"], "inner")
        .groupBy(*group, "bucket", "first", "value").agg(F.count("*").alias("cnt"))
    )
    ranked = candidates.select(
        *group, "bucket", "value", "cnt",
        (F.col("first") + F.coalesce(
            F.sum("cnt").over(before(["value"], [*group, "bucket"])), F.lit(0)
        )).alias("start"),
    )
    targets = wanted.select(*group, "bucket", "n", "_p", "_h", "_lo", "_hi")
    hits = join_nullsafe(ranked, targets, [*group, "bucket"], "inner")
    end = F.col("start") + F.col("cnt")
    holds = lambda rank: (F.col("start") <= F.col(rank)) & (F.col(rank) < end)
    return hits.groupBy(*group, "n", "_p", "_h", "_lo").agg(
        F.max(F.when(holds("_lo"), F.col("value"))).alias("_vlo"),
        F.max(F.when(holds("_hi"), F.col("value"))).alias("_vhi"),
    )
