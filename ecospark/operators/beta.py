"""Beta diversity on sparse cells.

Only positive (site, taxon) cells are stored. With h the Hellinger value, n the number of
sites and m_j the taxon mean over all sites, absent cells contribute through sums alone:
SS_j = sum h^2 - (sum h)^2 / n per taxon and SS_i = sum(h^2 - 2 h m_j) + sum m_j^2 per site.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import positive, q, ratio, safe_ln
from ..sources.tables import checkpointed
from .joins import attach, broadcast_if_small, join_nullsafe
from .order import dense_index


def hellinger(df: DataFrame, site: str, taxon: str, value: str, unique_cells: bool = False) -> DataFrame:
    """Square root of the share of each taxon in its site: ``site, taxon, h``.

    Duplicate rows of a cell are summed, unless cells are known to be unique. A site without any positive value stays, as one
    or more cells of value 0, because it counts among the sites.
    """
    x = F.when(positive(q(value)), q(value).cast("double"))
    if unique_cells:
        cells = df.select(site, taxon, F.coalesce(x, F.lit(0.0)).alias("_y"))
    else:
        cells = df.groupBy(site, taxon).agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("_y"))
    totals = cells.groupBy(site).agg(F.sum("_y").alias("_total"))
    h = F.coalesce(F.sqrt(ratio(F.col("_y"), F.col("_total"))), F.lit(0.0))
    return cells.join(totals, site).select(site, taxon, h.alias("h"))


@dataclass(frozen=True)
class BetaTable:
    """A Hellinger table read several times: its cells and taxa are materialised once.

    ``cells`` holds ``site, taxon, h`` and ``taxa`` the mean of each taxon over all sites
    and its sum of squares; the three numbers are the number of sites, the total sum of
    squares and the sum of the squared means.
    """

    site: str
    taxon: str
    cells: DataFrame
    taxa: DataFrame
    n_sites: int
    ss_total: float
    mean_ss: float

    @classmethod
    def build(cls, df: DataFrame, site: str, taxon: str, value: str, unique_cells: bool = False) -> BetaTable:
        cells = checkpointed(hellinger(df, site, taxon, value, unique_cells))
        n = cells.select(site).distinct().count()
        s, s2 = F.sum("h"), F.sum(F.col("h") * F.col("h"))
        taxa = checkpointed(cells.groupBy(taxon).agg((s / F.lit(float(n))).alias("mean"), (s2 - s * s / F.lit(float(n))).alias("ss")))
        row = taxa.agg(F.sum("ss"), F.sum(F.col("mean") * F.col("mean"))).head()
        return cls(site, taxon, cells, taxa, n, row[0] or 0.0, row[1] or 0.0)

    def with_means(self) -> DataFrame:
        """Cells with ``part``, what each adds to the sum of squares of its site."""
        means = broadcast_if_small(self.taxa.select(self.taxon, "mean"))
        part = F.col("h") * (F.col("h") - F.lit(2.0) * F.coalesce("mean", F.lit(0.0)))
        return join_nullsafe(self.cells, means, [self.taxon]).select(self.site, self.taxon, "h", part.alias("part"))

    def share(self, part: Column) -> Column:
        """Share of a site in the total from its summed parts."""
        return ratio(part + F.lit(self.mean_ss), F.lit(self.ss_total))


def beta_total(df: DataFrame, site: str, taxon: str, value: str) -> DataFrame:
    """Total sum of squares and total beta diversity: one row."""
    t = BetaTable.build(df, site, taxon, value)
    bd = t.ss_total / (t.n_sites - 1) if t.n_sites > 1 else None
    return df.sparkSession.createDataFrame(
        [(t.n_sites, float(t.ss_total), bd)], "n_sites bigint, ss_total double, bd_total double"
    )


def scbd(df: DataFrame, site: str, taxon: str, value: str) -> DataFrame:
    """Share of each taxon in the total beta diversity: ``taxon, scbd``."""
    t = BetaTable.build(df, site, taxon, value)
    return t.taxa.select(taxon, ratio(F.col("ss"), F.lit(t.ss_total)).alias("scbd"))


def lcbd(
    df: DataFrame, site: str, taxon: str, value: str, where: Column | None = None, suffix: str = "",
    unique_cells: bool = False,
) -> DataFrame:
    """Share of each site in the total beta diversity and its log: ``site, lcbd, log_lcbd``.

    ``where`` restricts the table first (corrected beta diversity).
    """
    t = BetaTable.build(df if where is None else df.where(where), site, taxon, value, unique_cells)
    out = t.with_means().groupBy(site).agg(t.share(F.sum("part")).alias("_l"))
    return out.select(
        site, F.col("_l").alias(f"lcbd{suffix}"), safe_ln(F.col("_l")).alias(f"log_lcbd{suffix}")
    )


def sample_sums(df: DataFrame, sample: Column, taxon: str, value: str) -> DataFrame:
    """Summed value per composite sample key and taxon: ``sample, taxon, value``."""
    return df.groupBy(sample.alias("sample"), taxon).agg(F.sum(q(value)).alias(value))


# Fixed value: the modulus of the mixing function, the largest prime below 2**31.
_PRIME = (1 << 31) - 1


def shuffle_keys(*parts: Column) -> list[Column]:
    """Four round keys from the md5 of the parts of a name."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts]))
    return [F.conv(F.substring(digest, 1 + 8 * r, 8), 16, 10).cast("long") for r in range(4)]


def shuffled_index(index: Column, keys: Sequence[Column], n: Column) -> Column:
    """Where a keyed bijection of 0..n-1 sends an index.

    Four rounds on a grid of a * b >= n cells, each adding a keyed mix of one half to the
    other. A result outside the range is mapped again until it is inside, which a bijection
    always reaches; the grid has at most about sqrt(n) spare cells, so repeats are few.
    """

    @F.pandas_udf("long")
    def send(i: pd.Series, k0: pd.Series, k1: pd.Series, k2: pd.Series, k3: pd.Series, size: pd.Series) -> pd.Series:
        count = size.to_numpy(np.int64)
        a = np.ceil(np.sqrt(count)).astype(np.int64)
        b = -(-count // a)
        key = [k.to_numpy(np.int64) for k in (k0, k1, k2, k3)]
        out = i.to_numpy(np.int64).copy()

        def mix(half, r, at):
            x = (half + key[r][at]) % _PRIME
            return x * x % _PRIME + x * 1103515245 % _PRIME

        todo = np.arange(len(out))
        while len(todo):
            left, right = out[todo] // b[todo], out[todo] % b[todo]
            for r in (0, 2):
                left = (left + mix(right, r, todo)) % a[todo]
                right = (right + mix(left, r + 1, todo)) % b[todo]
            out[todo] = left * b[todo] + right
            todo = todo[out[todo] >= count[todo]]
        return pd.Series(out)

    return send(index, *keys, n)


def lcbd_permutation(
    df: DataFrame, site: str, taxon: str, value: str, nperm: int = 99, seed: int = 1, plus_one: bool = True
) -> DataFrame:
    """Permutation test of LCBD: ``site, lcbd, pval``.

    Each taxon column is shuffled over the sites on its own. Column means and the total sum
    of squares do not change under a shuffle, so only the positive cells move: each goes to
    the site a keyed bijection assigns to it, and absent cells are never listed. The result
    depends on the seed and the keys, not on the partitioning.
    """
    t = BetaTable.build(df, site, taxon, value)
    n, sites = t.n_sites, dense_index(t.cells, site)
    cells = t.with_means().join(sites, site)
    observed = cells.groupBy(site, "idx").agg(F.round(t.share(F.sum("part")), 12).alias("lcbd"))
    moved = cells.where(F.col("h") > 0).select(
        F.explode(F.sequence(F.lit(1), F.lit(nperm))).alias("perm"), F.col(taxon).alias("_taxon"), "idx",
        F.col("part").alias("_d"),
    )
    keys = shuffle_keys(F.lit(seed), F.col("perm"), F.col("_taxon"))
    target = moved.select("perm", shuffled_index(F.col("idx"), keys, F.lit(n)).alias("idx"), "_d")
    shuffled = target.groupBy("idx", "perm").agg(F.round(t.share(F.sum("_d")), 12).alias("_l"))
    compared = shuffled.join(observed, "idx").select("idx", (F.col("_l") >= F.col("lcbd")).alias("_ge"))
    counts = compared.groupBy("idx").agg(F.count_if("_ge").alias("_hits"), F.count("*").alias("_seen"))
    # A site that received no positive cell in a shuffle has the share of an empty site.
    empty = (F.round(t.share(F.lit(0.0)), 12) >= F.col("lcbd")).cast("int")
    hits = F.coalesce(F.col("_hits"), F.lit(0)) + empty * (F.lit(nperm) - F.coalesce(F.col("_seen"), F.lit(0)))
    one = 1 if plus_one else 0
    return attach(observed, counts, "idx").select(
        site, "lcbd", ((hits + one) / F.lit(float(nperm + one))).alias("pval")
    )


def _gram(x: DataFrame, cols: Sequence[str], means: Sequence[float]) -> np.ndarray:
    """Centred cross-products of the predictors: q * q numbers from one aggregation."""
    centred = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, means)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = x.agg(*[F.sum(centred[i] * centred[j]).alias(f"g{i}_{j}") for i, j in pairs]).head()
    gram = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"]
    return gram


def varpart(
    response: DataFrame, predictors: DataFrame, site: str, taxon: str,
    first: Sequence[str], second: Sequence[str],
) -> DataFrame:
    """Variation partitioning of a Hellinger table between two predictor sets.

    ``response`` holds ``site, taxon, h``. All tables are aligned on the common sites.
    R2 of a predictor set is tr(C' G^-1 C) / tr(Y'Y) with G = X'X and C = X'Y, so the
    driver inverts a matrix as large as the predictor list and the taxa stay distributed.
    Returns the adjusted fractions ``a, b, c, d``.
    """
    cols = [*first, *second]
    response = checkpointed(response)
    x = predictors.select(site, *[F.col(c).cast("double").alias(c) for c in cols]).dropna("any")
    x = checkpointed(x.join(response.select(site), site, "left_semi"))
    h = response.join(x, site)
    head = x.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols]).head()
    n, means = head["n"], [head[c] for c in cols]
    gram = _gram(x, cols, means)
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    sets = {"first": range(len(first)), "second": range(len(first), len(cols)), "both": range(len(cols))}
    sums = h.groupBy(taxon).agg(
        F.sum("h").alias("_s"), F.sum(F.col("h") * F.col("h")).alias("_s2"),
        *[F.sum(F.col("h") * (F.col(c) - F.lit(float(m)))).alias(f"_c{i}")
          for i, (c, m) in enumerate(zip(cols, means))],
    )
    explained, rank = {}, {}
    for name, idx in sets.items():
        idx = list(idx)
        corr = gram[np.ix_(idx, idx)] / np.outer(scale[idx], scale[idx])
        rank[name] = int(np.linalg.matrix_rank(corr, tol=1e-10, hermitian=True))
        inverse = np.linalg.pinv(corr, rcond=1e-10, hermitian=True)
        inverse /= np.outer(scale[idx], scale[idx])
        terms = [
            F.lit(float(inverse[a, b])) * F.col(f"_c{i}") * F.col(f"_c{j}")
            for a, i in enumerate(idx) for b, j in enumerate(idx)
        ]
        explained[name] = F.sum(sum(terms[1:], terms[0])).alias(name)
    total = F.sum(F.col("_s2") - F.col("_s") * F.col("_s") / F.lit(float(n))).alias("total")
    fit = sums.agg(*explained.values(), total)

    def adjusted(name: str) -> Column:
        r2 = ratio(F.col(name), F.col("total"))
        return F.lit(1.0) - (F.lit(1.0) - r2) * F.lit((n - 1) / (n - rank[name] - 1) if n > rank[name] + 1 else None).cast("double")

    x1, x2, both = adjusted("first"), adjusted("second"), adjusted("both")
    return fit.select(
        (both - x2).alias("a"), (x1 + x2 - both).alias("b"), (both - x1).alias("c"), (F.lit(1.0) - both).alias("d")
    ).unpivot([], ["a", "b", "c", "d"], "fraction", "adj_r2")
