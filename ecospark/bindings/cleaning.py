"""Sources, projections, filters, joins and reshaping on the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators import clean, joins, reshape
from ..schemas import struct
from ..sources import tables as io
from ..functions.columns import rounded
from .registry import query

EVENT_TYPES = ["click", "purchase", "refund", "signup", "view"]


@query("projection_basics", """
    select p_retailprice, p_partkey, replace(p_name, 'part', 'taxon') as taxon, p_brand as genus, p_size,
           p_retailprice * 1000 as price_milli from part""")
def projection_basics(t):
    part = t.part.select("*", F.regexp_replace("p_name", "part", "taxon").alias("taxon"))
    renamed = clean.rename(part, {"p_brand": "genus"})
    kept = clean.select_cols(renamed, drop=["p_type", "p_name"], first=["p_retailprice"])
    # The numeric columns lead; the text columns follow by position.
    numbers = [c for c in C.numeric_columns(kept)]
    texts = [i for i, c in enumerate(kept.columns, 1) if c not in numbers]
    both = clean.select_pos(kept, [kept.columns.index(n) + 1 for n in numbers] + texts)
    return clean.convert_units(
        both.withColumn("price_milli", F.col("p_retailprice")), {"price_milli": 1000.0}
    )


@query("biovolume_units", """
    select l_suppkey, round(sum(l_quantity * l_extendedprice / 1e6), 6) as biovolume, round(sum(l_quantity * 0.012), 4) as mg,
           round(sum((coalesce(nullif(l_tax, 0), 0) + coalesce(nullif(l_discount, 0), 0))
               / nullif((l_tax <> 0)::int + (l_discount <> 0)::int, 0)), 4) as row_means
    from lineitem group by 1""")
def biovolume_units(t):
    rows = t.lineitem.select(
        "l_suppkey", C.biovolume(F.col("l_quantity"), F.col("l_extendedprice")).alias("b"),
        F.col("l_quantity").alias("q"),
        F.nullif("l_tax", F.lit(0.0)).alias("up"), F.nullif("l_discount", F.lit(0.0)).alias("bottom"),
    )
    rows = clean.convert_units(rows, {"q": 0.012}).withColumn("m", C.row_mean(["up", "bottom"]))
    return rows.groupBy("l_suppkey").agg(
        rounded(F.sum("b")).alias("biovolume"), rounded(F.sum("q"), 4).alias("mg"), rounded(F.sum("m"), 4).alias("row_means")
    )


@query("row_functions", """
    select o_orderkey, o_totalprice + 0 as total, (o_totalprice > 0)::bigint + (o_custkey > 0)::bigint as positives,
           round(case when o_totalprice > 0 then ln(o_totalprice) end, 6) as log_price,
           cast(floor(o_totalprice / 10000.0) + 1 as int) as bin from orders""")
def row_functions(t):
    return t.orders.select(
        "o_orderkey", C.row_sum(["o_totalprice"]).alias("total"),
        C.row_count_positive(["o_totalprice", "o_custkey"]).alias("positives"),
        rounded(C.safe_ln(F.col("o_totalprice"))).alias("log_price"),
        C.floor_bin(F.col("o_totalprice"), 10000).alias("bin"),
    )


@query("decimal_comma", "select l_orderkey, l_linenumber, l_partkey, l_extendedprice as price from lineitem")
def decimal_comma(t):
    text = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.regexp_replace(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), "\\.", ",").alias("price"),
    )
    return clean.to_double(text, ["price"])


@query("date_parts", """
    select o_orderkey, cast(o_orderdate as date) as d, cast(dayofyear(o_orderdate) as int) as doy,
           cast(year(o_orderdate) as int) as yr, o_custkey || '_' || dayofyear(o_orderdate) as sample from orders""")
def date_parts(t):
    return t.orders.select(
        "o_orderkey", F.to_date("o_orderdate").alias("d"), C.day_of_year("o_orderdate").alias("doy"),
        F.year("o_orderdate").alias("yr"), C.paste_key("o_custkey", C.day_of_year("o_orderdate")).alias("sample"),
    )


@query("recode_labels", """
    select o_orderkey, case o_orderstatus when 'F' then 'Finished' when 'O' then 'Open' else o_orderstatus end as status,
           case when o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')
                then 'Mixotroph' else 'Autotroph' end as strat from orders""")
def recode_labels(t):
    members = t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey").distinct()
    tagged = clean.tag_trait(t.orders, members, "o_custkey")
    status = C.recode(F.col("o_orderstatus"), {"F": "Finished", "O": "Open"})
    return tagged.select("o_orderkey", status.alias("status"), "strat")


@query("filters", """
    select l_orderkey, l_partkey, l_suppkey, l_quantity, nullif(l_discount, 0) as d from lineitem
    where l_quantity > 10 and l_linestatus <> 'F' and l_returnflag = 'N'
      and (nullif(l_discount, 0) is null or nullif(l_discount, 0) <> 0.1)""")
def filters(t):
    rows = t.lineitem.where((F.col("l_quantity") > 10) & (F.col("l_linestatus") != "F"))
    rows = clean.filter_stratum(rows, "l_returnflag", "N")
    rows = clean.exclude_value(rows.withColumn("d", F.nullif("l_discount", F.lit(0.0))), "d", 0.1)
    drops = {"long": ["l_tax", "l_shipdate", "l_extendedprice", "l_discount", "l_linenumber", "l_returnflag", "l_linestatus"]}
    return clean.drop_by_dataset(rows, "long", drops).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "d")


def _holes(t):
    return t.lineitem.select(
        "l_orderkey", "l_quantity", F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
    )


HOLES = "(select l_orderkey, l_quantity, nullif(l_tax, 0) as tax, nullif(l_discount, 0) as discount from lineitem)"


@query("complete_rows", f"""
    select 'complete' as step, count(*) as n, round(sum(tax), 2) as s from {HOLES} where tax is not null and discount is not null
    union all select 'required', count(*), round(sum(tax), 2) from {HOLES} where tax is not null
    union all select 'paired', count(*), round(sum(tax), 2) from {HOLES} where tax is not null
    union all select 'target', count(*), round(sum(o_totalprice), 2) from {HOLES} join orders on l_orderkey = o_orderkey where tax is not null
    union all select 'filled', count(*), round(sum(coalesce(tax, 0.5)), 2) from {HOLES}""")
def complete_rows(t):
    rows = _holes(t)
    keyed = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    features = rows.select("l_orderkey", "tax")
    pairs = clean.complete_cases(features, keyed, "l_orderkey")
    steps = {
        "complete": clean.drop_incomplete(rows),
        "required": clean.require(rows, ["tax"]),
        "paired": pairs,
        "target": pairs.select(F.col("o_totalprice").alias("tax")),
        "filled": clean.fill_null(rows, {"tax": 0.5}),
    }
    tagged = [df.select(F.lit(s).alias("step"), "tax") for s, df in steps.items()]
    whole = tagged[0]
    for df in tagged[1:]:
        whole = whole.unionByName(df)
    return whole.groupBy("step").agg(F.count("*").alias("n"), rounded(F.sum("tax"), 2).alias("s"))


@query("nan_to_null", """
    select l_suppkey, count(nullif(l_tax, 0)) as n from lineitem group by 1""")
def nan_to_null(t):
    nans = t.lineitem.select("l_suppkey", F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax"))
    return clean.nan_to_null(nans).groupBy("l_suppkey").agg(F.count("tax").alias("n"))


@query("null_profile", f"""
    select 'l_orderkey' as variable, count(*) - count(l_orderkey) as nulls from {HOLES}
    union all select 'l_quantity', count(*) - count(l_quantity) from {HOLES}
    union all select 'tax', count(*) - count(tax) from {HOLES}
    union all select 'discount', count(*) - count(discount) from {HOLES}""")
def null_profile(t):
    return clean.null_profile(_holes(t))


@query("row_loss", f"""
    select 'na.omit' as step, count(*) as rows_before,
        count(*) filter (tax is not null and discount is not null) as rows_after,
        count(*) - count(*) filter (tax is not null and discount is not null) as rows_lost from {HOLES}""")
def row_loss(t):
    return clean.row_loss(_holes(t), "na.omit")


PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("column_profile", " union all ".join(f"""
    select '{c}' as variable, min({c}) as min, round(quantile_cont({c}, 0.25), 4) as q1, round(median({c}), 4) as median,
        round(avg({c}), 4) as mean, round(quantile_cont({c}, 0.75), 4) as q3, max({c}) as max,
        count(*) - count({c}) as nulls from lineitem""" for c in PROFILED))
def column_profile(t):
    df = clean.column_profile(t.lineitem, PROFILED)
    return df.select("variable", "min", *[rounded(F.col(c), 4).alias(c) for c in ("q1", "median", "mean", "q3")], "max", "nulls")


@query("impute_median", """
    with m as (select median(nullif(value, 0)) filter (event_type <> 'view') as m from events)
    select event_id, coalesce(case when event_type <> 'view' then value end, m) as value from events, m""")
def impute_median(t):
    holes = t.events.select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return clean.impute_median(holes, ["value"])


def interpolated(axis: str) -> str:
    return f"""
    with e as (select event_id, {axis} as doy, case when event_type = 'click' and value > 230 then value end as v from events),
    a as (select doy, avg(v) as v from e group by 1),
    w as (select doy, v,
        last_value(case when v is not null then doy end ignore nulls) over (order by doy rows unbounded preceding) as x0,
        last_value(v ignore nulls) over (order by doy rows unbounded preceding) as y0,
        first_value(case when v is not null then doy end ignore nulls) over (order by doy rows between current row and unbounded following) as x1,
        first_value(v ignore nulls) over (order by doy rows between current row and unbounded following) as y1 from a)
    select event_id, e.doy, round(case when x0 = x1 then y0 else y0 + (y1 - y0) * (e.doy - x0) / nullif(x1 - x0, 0) end, 6) as v
    from e join w on e.doy = w.doy"""


def known_clicks(t, axis):
    return t.events.select(
        "event_id", axis.alias("doy"),
        F.when((F.col("event_type") == "click") & (F.col("value") > 230), F.col("value")).alias("v"),
    )


@query("interpolate_doy", interpolated("cast(dayofyear(ts) as int)"))
def interpolate_doy(t):
    rows = known_clicks(t, F.dayofyear("ts"))
    return clean.interpolate(rows, "doy", ["v"]).withColumn("v", rounded(F.col("v")))


@query("interpolate_seconds", interpolated("cast(floor(epoch(ts)) as bigint)"))
def interpolate_seconds(t):
    """The same on an axis of seconds since 1970."""
    days = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    rows = known_clicks(t, days * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts"))
    return clean.interpolate(rows, "doy", ["v"]).withColumn("v", rounded(F.col("v")))


@query("interpolate_fraction", interpolated("cast(dayofyear(ts) as double) / 366"))
def interpolate_fraction(t):
    """The same on an axis from 0 to 1."""
    rows = known_clicks(t, F.dayofyear("ts").cast("double") / 366)
    return clean.interpolate(rows, "doy", ["v"]).withColumn("v", rounded(F.col("v")))


@query("semi_sites", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def semi_sites(t):
    large = t.orders.where(F.col("o_totalprice") > 300000).withColumnRenamed("o_custkey", "c_custkey")
    return joins.keep_sites(t.customer, large, "c_custkey").select("c_custkey", "c_name")


@query("common_keys", """
    select l_orderkey from lineitem where l_shipdate < timestamp '1998-01-01' intersect
    select l_orderkey from lineitem where l_shipdate >= timestamp '1998-01-01'""")
def common_keys(t):
    shipped = F.col("l_shipdate")
    early = t.lineitem.where(shipped < F.lit("1998-01-01").cast("timestamp_ntz"))
    late = t.lineitem.where(shipped >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return joins.common_keys(early, late, "l_orderkey")


@query("first_per_key", """
    select o_custkey, d, o_orderkey, o_totalprice from (
        select o_custkey, cast(o_orderdate as date) as d, o_orderkey, o_totalprice,
            row_number() over (partition by o_custkey, cast(o_orderdate as date) order by o_orderkey) as rn from orders) where rn = 1""")
def first_per_key(t):
    rows = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderkey", "o_totalprice")
    return clean.first_per_key(rows, ["o_custkey", "d"], ["o_orderkey"])


@query("multiway_site_table", """
    select s_suppkey, s_name, n_name, r_name, n, q from supplier
    left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey
    left join (select l_suppkey, count(*) as n from lineitem group by 1) a on s_suppkey = a.l_suppkey
    left join (select l_suppkey, sum(l_quantity) as q from lineitem group by 1 having count(*) % 2 = 0) b on s_suppkey = b.l_suppkey""")
def multiway_site_table(t):
    nation = t.nation.withColumnsRenamed({"n_nationkey": "s_nationkey"})
    region = t.region.withColumnsRenamed({"r_regionkey": "n_regionkey"})
    sites = joins.attach(joins.attach(t.supplier, nation, "s_nationkey"), region, "n_regionkey")
    lines = t.lineitem.withColumnRenamed("l_suppkey", "s_suppkey")
    counts = lines.groupBy("s_suppkey").agg(F.count("*").alias("n"))
    even = lines.groupBy("s_suppkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("_n")).where("_n % 2 = 0").drop("_n")
    return joins.attach_all([sites, counts, even], "s_suppkey").select("s_suppkey", "s_name", "n_name", "r_name", "n", "q")


@query("outer_merge", """
    select coalesce(a.k, b.k) as k, a.n as returned, b.n as kept from
    (select l_orderkey as k, count(*) as n from lineitem where l_returnflag = 'R' group by 1) a full outer join
    (select l_orderkey as k, count(*) as n from lineitem where l_returnflag <> 'R' group by 1) b on a.k = b.k""")
def outer_merge(t):
    def counts(which, name):
        return t.lineitem.where(which).groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias(name))

    returned = F.col("l_returnflag") == "R"
    return joins.outer_merge(counts(returned, "returned"), counts(~returned, "kept"), "k")


@query("feature_table", """
    select l_orderkey, n, q, o_totalprice as target from
    (select l_orderkey, count(*) as n, sum(l_quantity) as q from lineitem group by 1) join orders on l_orderkey = o_orderkey""")
def feature_table(t):
    features = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    target = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("target"))
    return joins.bind_by_key(features, target, "l_orderkey")


@query("long_to_wide", "select user_id, " + ", ".join(
    f"round(coalesce(sum(value) filter (event_type = '{e}'), 0), 2) as {e}" for e in EVENT_TYPES) + " from events group by 1")
def long_to_wide(t):
    wide = reshape.to_wide(t.events, "user_id", "event_type", "value", EVENT_TYPES)
    return wide.select("user_id", *[rounded(F.col(e), 2).alias(e) for e in EVENT_TYPES])


@query("wide_to_long", " union all ".join(
    f"select user_id, '{e}' as taxon, round(coalesce(sum(value) filter (event_type = '{e}'), 0), 2) as value from events group by 1"
    for e in EVENT_TYPES))
def wide_to_long(t):
    wide = reshape.to_wide(t.events, "user_id", "event_type", "value", EVENT_TYPES)
    return reshape.to_long(wide, ["user_id"]).withColumn("value", rounded(F.col("value"), 2))


@query("pivot_mean", "select user_id, " + ", ".join(
    f"round(case when count(*) filter (event_type = '{e}' and value > 300) = 0 then avg(value) filter (event_type = '{e}') end, 6) as {e}"
    for e in EVENT_TYPES) + " from events group by 1")
def pivot_mean(t):
    holes = t.events.withColumn("value", F.when(F.col("value") <= 300, F.col("value")))
    wide = reshape.pivot_mean(holes, ["user_id"], "event_type", "value", EVENT_TYPES)
    return wide.select("user_id", *[rounded(F.col(e)).alias(e) for e in EVENT_TYPES])


@query("merge_synonyms", """
    select l_suppkey, regexp_replace(p_brand, '\\d$', '') as p_brand,
        case when count(l_quantity) = count(*) then sum(l_quantity) end as l_quantity
    from (select l_suppkey, p_brand, case when l_partkey = 7 then null else l_quantity end as l_quantity
          from lineitem join part on l_partkey = p_partkey) group by all""")
def merge_synonyms(t):
    holes = t.lines.withColumn("l_quantity", F.when(F.col("l_partkey") != 7, F.col("l_quantity")))
    return clean.merge_synonyms(holes, "l_suppkey", "p_brand", "l_quantity", pattern=r"\d$")


@query("csv_roundtrip", """
    select s_suppkey, s_name, s_nationkey, case when s_acctbal < 0 then null else s_acctbal end as s_acctbal from supplier""")
def csv_roundtrip(t):
    path = io.scratch_path(t.spark, "csv")
    rows = t.supplier.select(
        F.monotonically_increasing_id().alias("row_name"), "s_suppkey", "s_name", "s_nationkey",
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("s_acctbal"),
    )
    io.write_table(rows, path, "csv")
    schema = struct(
        row_name=T.LongType(), s_suppkey=T.LongType(), s_name=T.StringType(), s_nationkey=T.IntegerType(), s_acctbal=T.DoubleType()
    )
    return io.drop_index(io.read_table(t.spark, path, schema))


@query("decimal_comma_csv", "select s_suppkey, s_name, s_acctbal from supplier")
def decimal_comma_csv(t):
    path = io.scratch_path(t.spark, "dec")
    comma = F.regexp_replace(F.col("s_acctbal").cast("decimal(18,2)").cast("string"), "\\.", ",")
    t.supplier.select("s_suppkey", "s_name", comma.alias("s_acctbal")).write.csv(path, sep=";", header=True)
    return io.read_decimal_comma(t.spark, path, struct(s_suppkey=T.LongType(), s_name=T.StringType(), s_acctbal=T.DoubleType()))


@query("partitioned_write", "select p_type, p_brand, count(*) as n from part group by all")
def partitioned_write(t):
    path = io.scratch_path(t.spark, "parts")
    io.write_partitioned(t.part.groupBy("p_type", "p_brand").agg(F.count("*").alias("n")), path, ["p_type"])
    schema = struct(p_brand=T.StringType(), n=T.LongType(), p_type=T.StringType())
    return t.spark.read.schema(schema).parquet(path).select("p_type", "p_brand", "n")


@query("promote_header", """
    select cast(s_nationkey as varchar) as lake_id, round(sum(s_acctbal), 4) as "Daphnia", round(sum(s_acctbal) / 2, 4) as "Daphnia.1",
        cast(count(*) as double) as "Alona" from supplier group by 1""")
def promote_header(t):
    path = io.scratch_path(t.spark, "banner")
    comma = lambda c: F.regexp_replace(c.cast("decimal(20,4)").cast("string"), "\\.", ",")
    # One text file of three banner rows and a row per nation, so at most 28 rows.
    banner = t.spark.createDataFrame(
        [(0, "1;ALL;Daphnia.pulex;Daphnia.magna;Alona.sp"), (1, "2;site;um3;um3;um3"), (2, "3;;;;")], "o int, value string"
    )
    sums = t.supplier.groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("b"), F.count("*").cast("string").alias("n"))
    body = sums.select(
        F.lit(3).alias("o"), F.concat_ws(";", F.lit("x"), F.col("s_nationkey").cast("string"), comma(F.col("b")), comma(F.col("b") / 2), "n").alias("value")
    )
    banner.unionByName(body).repartitionByRange(1, "o").sortWithinPartitions("o").select("value").write.text(path)
    return io.promote_header(t.spark, path, "lake_id")


@query("merge_synonym_columns", """
    with y as (select l_orderkey, regexp_replace(p_type, '^(LARGE|MEDIUM)$', 'LARGE') as g, sum(l_quantity) as v from lineitem join part on l_partkey = p_partkey group by all)
    select l_orderkey, """ + ", ".join(f"coalesce(sum(v) filter (g = '{g}'), 0) as \"{g}\"" for g in ("ECONOMY", "LARGE", "PROMO", "SMALL", "STANDARD")) + """
    from y group by 1""")
def merge_synonym_columns(t):
    wide = reshape.to_wide(t.lines, "l_orderkey", "p_type", "l_quantity", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])
    return clean.merge_synonym_columns(wide.withColumnRenamed("MEDIUM", "LARGE.1"), "l_orderkey")
