"""Composition and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import floor_bin, hash_fraction, percent, rounded
from ..operators import clean, compose, stats
from .registry import mixo, out, query

RANKS = ["p_brand", "p_type", "p_size"]


@query("mode_by", """
    select l_partkey, l_returnflag as mode, n from (
        select l_partkey, l_returnflag, count(*) as n, row_number() over (partition by l_partkey order by count(*) desc, l_returnflag) as rn
        from lineitem group by 1, 2) where rn = 1""")
def mode_by(t):
    return compose.mode_by(t.lineitem, "l_partkey", "l_returnflag")


@query("crosstab", """
    select coalesce(cast(nullif(quality, 0) as varchar), '<NA>') as quality, coalesce(cast(toxic as varchar), '<NA>') as toxic, count(*) as n
    from labels group by 1, 2""")
def crosstab(t):
    return compose.crosstab(t.labels.withColumn("quality", F.nullif("quality", F.lit(0))), "quality", "toxic")


@query("disagreements", """
    with m as (select l_partkey, l_returnflag as mode from (
        select l_partkey, l_returnflag, row_number() over (partition by l_partkey order by count(*) desc, l_returnflag) as rn
        from lineitem group by 1, 2) where rn = 1)
    select p_partkey, declared, mode from (select p_partkey, case when p_size > 40 then null when p_size > 20 then 'A' else 'N' end as declared from part)
    join m on p_partkey = l_partkey where declared is not null and mode is not null and declared <> mode""")
def disagreements(t):
    declared = F.when(F.col("p_size") > 40, None).when(F.col("p_size") > 20, "A").otherwise("N")
    modal = compose.mode_by(t.lineitem.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "l_returnflag")
    both = t.part.select("p_partkey", declared.alias("declared")).join(modal, "p_partkey")
    return clean.disagreements(both, "declared", "mode").select("p_partkey", "declared", "mode")


LUMP = """
    with c as (select p_size, count(*) as n from lineitem join part on l_partkey = p_partkey where p_size <> 3 group by 1),
    r as (select p_size, rank() over (order by n desc) as r from c)
    select case when p.p_size = 3 then null when r.r <= 15 or (select count(*) from r where r > 15) <= 1
                then cast(p.p_size as varchar) else 'Other' end as lumped, count(*) as n
    from lineitem join part p on l_partkey = p_partkey left join r on p.p_size = r.p_size group by 1"""


@query("lump_top_n", LUMP)
def lump_top_n(t):
    holes = t.lines.withColumn("p_size", F.nullif("p_size", F.lit(3)))
    return compose.lump_top_n(holes, "p_size").groupBy("lumped").agg(F.count("*").alias("n"))


def binned_lines(t):
    """Lines with the prevalence bin of their order; some prevalences are missing."""
    prev = t.lines.groupBy("l_orderkey").agg(
        percent(F.sum(F.when(mixo(), F.col("l_quantity")).otherwise(0.0)), F.sum("l_quantity")).alias("prev")
    ).withColumn("prev", F.when(F.col("l_orderkey") > 5, F.col("prev")))
    return t.lines.join(prev, "l_orderkey")


BINNED = """
    prev as (select l_orderkey, case when l_orderkey > 5 then 100 * sum(case when p_type in ('PROMO','SMALL') then l_quantity else 0 end) / sum(l_quantity) end as prev
             from lineitem join part on l_partkey = p_partkey group by 1),
    d as (select cast(floor(prev / 10) + 1 as int) as bin, l_quantity, p_brand, p_type, cast(p_size as varchar) as p_size
          from lineitem join part on l_partkey = p_partkey join prev using (l_orderkey))"""
LONG_RANKS = """
    long as (select bin, l_quantity, 'p_brand' as rank, p_brand as taxon from d union all select bin, l_quantity, 'p_type', p_type from d
             union all select bin, l_quantity, 'p_size', p_size from d)"""
COMPOSED = f"""
    with {BINNED}, {LONG_RANKS},
    c as (select rank, taxon, count(*) as n from long group by all),
    r as (select rank, taxon, rank() over (partition by rank order by n desc) as r from c),
    k as (select rank, taxon from r where r <= 15 or (select count(*) from r r2 where r2.rank = r.rank and r2.r > 15) <= 1),
    tab as (select l.rank, bin, case when k.taxon is not null then l.taxon else 'Other' end as taxon, count(*) as freq, sum(l_quantity) as abundance
            from long l left join k on l.rank = k.rank and l.taxon = k.taxon group by all)
    select rank, bin, taxon, freq, abundance,
        round(case when bin is null then 100 else 100 * freq / sum(freq) over (partition by rank, bin) end, 6) as percent_freq,
        round(case when bin is null then 100 else 100 * abundance / sum(abundance) over (partition by rank, bin) end, 6) as percent_abundance
    from tab"""


def composed(t):
    df = compose.composition_all_ranks(binned_lines(t), floor_bin(F.col("prev"), 10), RANKS, "l_quantity")
    return out(df, ["rank", "bin", "taxon", "freq", "abundance"], ["percent_freq", "percent_abundance"])


@query("composition_all_ranks", COMPOSED)
def composition_all_ranks(t):
    return composed(t)


@query("composition_bins", f"select bin, taxon, freq, abundance, percent_freq, percent_abundance from ({COMPOSED}) where rank = 'p_brand'")
def composition_bins(t):
    df = compose.composition(binned_lines(t), floor_bin(F.col("prev"), 10), "p_brand", "l_quantity")
    return out(df, ["bin", "taxon", "freq", "abundance"], ["percent_freq", "percent_abundance"])


@query("richness_bins", f"with {BINNED}, {LONG_RANKS} select rank, bin, count(distinct taxon) as richness from long group by all")
def richness_bins(t):
    return compose.richness_bins(binned_lines(t), floor_bin(F.col("prev"), 10), RANKS, "l_quantity")


CUT = """
    with b as (select min({x}) as lo, max({x}) as hi, (max({x}) - min({x})) / {k} as w from {t}),
    c as (select e.*, cast(least(greatest(ceil(({x} - lo) / w), 1), {k}) as int) as bin, lo, w from {t} e, b)"""


@query("binned_curve", CUT.format(x="value", k=20, t="events") + """
    select bin, round(avg(value), 6) as x_mean, round(avg(user_id), 6) as y_mean, round(stddev_samp(user_id) / sqrt(count(*)), 6) as y_sem,
        round(avg(user_id) - 1.96 * stddev_samp(user_id) / sqrt(count(*)), 6) as ci95_lo,
        round(avg(user_id) + 1.96 * stddev_samp(user_id) / sqrt(count(*)), 6) as ci95_hi
    from c group by bin having count(*) > 1""")
def binned_curve(t):
    df = stats.binned_curve(t.events, "value", "user_id")
    return out(df, ["bin"], ["x_mean", "y_mean", "y_sem", "ci95_lo", "ci95_hi"])


@query("histogram", CUT.format(x="l_extendedprice", k=50, t="lineitem") + """
    select bin, round(any_value(lo + w * (bin - 1)), 6) as lo, round(any_value(lo + w * bin), 6) as hi, count(*) as n from c group by bin""")
def histogram(t):
    df = stats.histogram(t.lineitem, "l_extendedprice")
    return df.select("bin", rounded(F.col("lo")).alias("lo"), rounded(F.col("hi")).alias("hi"), "n")


@query("box_stats", """
    select o_orderpriority, min(o_totalprice) as min, round(quantile_cont(o_totalprice, 0.25), 4) as q1, round(median(o_totalprice), 4) as median,
        round(quantile_cont(o_totalprice, 0.75), 4) as q3, max(o_totalprice) as max, count(*) as n from orders group by 1""")
def box_stats(t):
    df = stats.box_stats(t.orders, "o_orderpriority", "o_totalprice")
    return df.select("o_orderpriority", "min", *[rounded(F.col(c), 4).alias(c) for c in ("q1", "median", "q3")], "max", "n")


@query("quantile_class", """
    with q as (select quantile_cont(o_totalprice, 0.25) as a, median(o_totalprice) as b, quantile_cont(o_totalprice, 0.75) as c from orders)
    select o_orderkey, 1 + (o_totalprice > a)::int + (o_totalprice > b)::int + (o_totalprice > c)::int as quantile_class from orders, q""")
def quantile_class(t):
    return stats.quantile_class(t.orders, "o_totalprice").select("o_orderkey", "quantile_class")


LINE = "(select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a from lineitem)"


def fitted(t):
    """Lines with the least-squares prediction of the price and its residual."""
    line = t.lineitem.agg(
        F.regr_slope("l_extendedprice", "l_quantity").alias("b"), F.regr_intercept("l_extendedprice", "l_quantity").alias("a")
    ).select(F.struct("a", "b")).scalar()
    rows = t.lineitem.withColumn("_l", line)
    rows = rows.withColumn("yhat", F.col("_l.a") + F.col("_l.b") * F.col("l_quantity")).drop("_l")
    return stats.residuals(rows, "l_extendedprice", "yhat")


@query("linear_fit", " union all ".join(f"""
    select '{y}' as variable, count(*) as n, round(regr_slope({y}, l_quantity), 6) as slope,
        round(regr_intercept({y}, l_quantity), 6) as intercept, round(regr_r2({y}, l_quantity), 6) as r2 from lineitem"""
    for y in ("l_extendedprice", "l_discount")))
def linear_fit(t):
    df = stats.linear_fit(t.lineitem, "l_quantity", ["l_extendedprice", "l_discount"])
    return out(df, ["variable", "n"], ["slope", "intercept", "r2"])


@query("residuals", f"""
    select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice - (a + b * l_quantity), 4) as residual from lineitem, {LINE}""")
def residuals(t):
    return fitted(t).select("l_orderkey", "l_linenumber", "l_partkey", rounded(F.col("residual"), 4).alias("residual"))


METRICS_SQL = """count(*) as n, round(avg(e * e), 4) as mse, round(avg(abs(e)), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse,
    round(1 - avg(e * e) / var_pop(y), 6) as r2,
    round(1 - (avg(e * e) / var_pop(y)) * (count(*) - 1) / (count(*) - 2), 6) as r2_adj"""


@query("regression_metrics", f"""
    select {METRICS_SQL} from (select l_extendedprice as y, l_extendedprice - (a + b * l_quantity) as e from lineitem, {LINE})""")
def regression_metrics(t):
    df = stats.regression_metrics(fitted(t), "l_extendedprice", "yhat", 1)
    return df.select("n", rounded(F.col("mse"), 4).alias("mse"), *[rounded(F.col(c)).alias(c) for c in ("mae", "rmse", "r2", "r2_adj")])


@query("compare_models", f"""
    select 'line' as model, {METRICS_SQL} from (select l_extendedprice as y, l_extendedprice - (a + b * l_quantity) as e from lineitem, {LINE})
    union all select 'rule', {METRICS_SQL} from (select l_extendedprice as y, l_extendedprice - 2000 * l_quantity as e from lineitem)""")
def compare_models(t):
    rows = fitted(t).withColumnRenamed("yhat", "line").withColumn("rule", F.lit(2000.0) * F.col("l_quantity"))
    df = stats.compare_models(rows, "l_extendedprice", ["line", "rule"], 1)
    return df.select("model", "n", rounded(F.col("mse"), 4).alias("mse"), *[rounded(F.col(c)).alias(c) for c in ("mae", "rmse", "r2", "r2_adj")])


KEYED = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice"


@query("split_sizes", """
    select case when ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::bigint / 4294967296.0 < 0.2 then 'test' else 'train' end as split,
        count(*) as n, round(var_pop(o_totalprice), 2) as variance from orders group by 1""")
def split_sizes(t):
    part = F.when(hash_fraction(F.col("o_orderkey"), 42) < 0.2, "test").otherwise("train")
    df = stats.target_variance(t.orders.withColumn("split", part), "o_totalprice", "split")
    return df.select("split", "n", rounded(F.col("variance"), 2).alias("variance"))


@query("step_curve", """
    select row_number() over (order by o_totalprice, md5(cast(o_orderkey as varchar))) as position, o_totalprice, o_custkey from orders""")
def step_curve(t):
    return stats.step_curve(t.orders, "o_totalprice", "o_custkey", F.col("o_orderkey"))


@query("qq_pairs", """
    with r as (select o_totalprice, row_number() over (order by o_totalprice, md5(cast(o_orderkey as varchar))) as rank, count(*) over () as n from orders),
    p as (select *, rank / (n + 1.0)::double as p from r),
    z as (select *, p - 0.5 as q, (p - 0.5) * (p - 0.5) as s, sqrt(-2 * ln(p)) as lo, sqrt(-2 * ln(1 - p)) as hi from p)
    select rank, o_totalprice as sample, round(case
        when p < 0.02425 then (((((-7.784894002430293e-03*lo - 3.223964580411365e-01)*lo - 2.400758277161838e+00)*lo - 2.549732539343734e+00)*lo + 4.374664141464968e+00)*lo + 2.938163982698783e+00)
            / ((((7.784695709041462e-03*lo + 3.224671290700398e-01)*lo + 2.445134137142996e+00)*lo + 3.754408661907416e+00)*lo + 1)
        when p > 1 - 0.02425 then -(((((-7.784894002430293e-03*hi - 3.223964580411365e-01)*hi - 2.400758277161838e+00)*hi - 2.549732539343734e+00)*hi + 4.374664141464968e+00)*hi + 2.938163982698783e+00)
            / ((((7.784695709041462e-03*hi + 3.224671290700398e-01)*hi + 2.445134137142996e+00)*hi + 3.754408661907416e+00)*hi + 1)
        else q * (((((-3.969683028665376e+01*s + 2.209460984245205e+02)*s - 2.759285104469687e+02)*s + 1.383577518672690e+02)*s - 3.066479806614716e+01)*s + 2.506628277459239e+00)
            / (((((-5.447609879822406e+01*s + 1.615858368580409e+02)*s - 1.556989798598866e+02)*s + 6.680131188771972e+01)*s - 1.328068155288572e+01)*s + 1) end, 6) + 0.0 as theoretical
    from z""")
def qq_pairs(t):
    df = stats.qq_pairs(t.orders, "o_totalprice", F.col("o_orderkey"))
    return df.select("rank", "sample", rounded(F.col("theoretical")).alias("theoretical"))
