"""Normal, chi-square and binomial tails, proportion intervals and tests.

Spark has no error function, so the tails are small vectorised UDFs. They run on
result rows (one per group or series), never on the fact rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import ALPHA

__all__ = ["z_quantile", "two_sided_p", "chi2_1_tail", "binomial_p", "wilson", "prop_z",
           "mk_min_p", "bh_fdr", "student_t_p", "mann_whitney_exact_p"]

_erfc = np.vectorize(math.erfc, otypes=[float])


def z_quantile(alpha: float = ALPHA) -> float:
    """Exact two-sided normal quantile (1.959964 for 5%)."""
    return NormalDist().inv_cdf(1 - alpha / 2)


@F.pandas_udf(T.DoubleType())
def _erfc_udf(x: pd.Series) -> pd.Series:
    return pd.Series(_erfc(x.to_numpy(dtype=float)), index=x.index) if len(x) else x.astype(float)


@F.pandas_udf(T.DoubleType())
def _binomial_udf(k: pd.Series, n: pd.Series) -> pd.Series:
    def tail(a, m):
        a, m = int(a), int(m)
        if m <= 0:
            return None
        a = min(a, m - a)
        return min(1.0, 2 * sum(math.comb(m, i) for i in range(a + 1)) / 2 ** m)
    return pd.Series([tail(a, m) if pd.notna(a) and pd.notna(m) else None for a, m in zip(k, n)],
                     dtype=float)


def _incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, from the end where that converges fast."""
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) + lgamma(p + q) - lgamma(p) - lgamma(q)) / p
    c, d = np.ones_like(z), 1 / (1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 400):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return np.where(flip, 1 - front * h, front * h)


@F.pandas_udf(T.DoubleType())
def _student_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    if not len(t):
        return t.astype(float)
    t, n = t.to_numpy(dtype=float), df.to_numpy(dtype=float)
    return pd.Series(np.where(np.isinf(t), 0.0, _incomplete_beta(n / 2, 0.5, n / (n + np.where(np.isinf(t), 0.0, t) ** 2))))


@F.pandas_udf(T.DoubleType())
def _exact_u_udf(u: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    def tail(u, n, m):
        if pd.isna(u) or pd.isna(n) or pd.isna(m):
            return None
        n, m = int(n), int(m)
        # ways[j][s]: choices of j among the ranks so far with s pairs won; sizes are small where this is asked for
        ways = np.zeros((n + 1, n * m + 1))
        ways[0, 0] = 1
        for rank in range(n + m):
            for j in range(min(n, rank + 1), 0, -1):
                won = rank - (j - 1)   # of the other group below this rank
                if won <= m:
                    ways[j, won:] += ways[j - 1, :n * m + 1 - won]
        p = ways[n] / ways[n].sum()
        top = math.ceil(max(u, n * m - u))
        return min(1.0, 2 * float(p[top:].sum()))
    return pd.Series([tail(*x) for x in zip(u, n, m)], dtype=float)


def _nullable(value: Column, out: Column) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value), out)


def two_sided_p(z: Column) -> Column:
    z = z.cast("double")
    return _nullable(z, _erfc_udf(F.coalesce(F.abs(z), F.lit(0.0)) / math.sqrt(2.0)))


def student_t_p(t: Column, freedom: Column) -> Column:
    """Two-sided p of Student's t with ``freedom`` degrees; NULL where t is or there are none. For result rows."""
    t, n = t.cast("double"), freedom.cast("double")
    known = t.isNotNull() & ~F.isnan(t) & (n > 0)
    return F.when(known, _student_udf(F.when(known, t).otherwise(0.0), F.when(known, n).otherwise(1.0)))


def mann_whitney_exact_p(u: Column, n: Column, m: Column) -> Column:
    """Exact two-sided p of the U statistic of groups of n and m values without ties. For result rows of small groups."""
    return F.when((n > 0) & (m > 0), _exact_u_udf(u.cast("double"), n.cast("long"), m.cast("long")))


def chi2_1_tail(x: Column) -> Column:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    x = x.cast("double")
    return _nullable(x, _erfc_udf(F.sqrt(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)) / 2)))


def binomial_p(k: Column, n: Column) -> Column:
    """Exact two-sided binomial p at 0.5 for k successes of n; NULL when n is 0."""
    return F.when(n > 0, _binomial_udf(k.cast("long"), n.cast("long")))


def wilson(k: Column, n: Column, alpha: float = ALPHA) -> tuple[Column, Column]:
    z = z_quantile(alpha)
    n = F.when(n > 0, n.cast("double"))
    p = k.cast("double") / n
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return mid - half, mid + half


def prop_z(k: Column, n: Column, p0: Column) -> Column:
    """z of one observed proportion against a known one; NULL when undefined."""
    n = F.when((n > 0) & (p0 > 0) & (p0 < 1), n.cast("double"))
    return (k.cast("double") / n - p0) / F.sqrt(p0 * (1 - p0) / n)


def mk_min_p(n: Column) -> Column:
    """Smallest two-sided p a fully monotone tie-free series of n points can reach."""
    n = F.when(n >= 4, n.cast("double"))
    z = (n * (n - 1) / 2 - 1) / F.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    return two_sided_p(z)


def bh_fdr(df: DataFrame, p: str, family: list[str], out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q per family. Rows with NULL p take no part and get NULL.

    Meant for result rows, one per tested dimension value of a family.
    """
    tested = F.col(p).isNotNull()
    fam = [F.col(c) for c in family] + [tested]
    asc = Window.partitionBy(*fam).orderBy(F.col(p))
    size = F.count(F.lit(1)).over(Window.partitionBy(*fam))
    raw = df.withColumn("_q", F.when(tested, F.col(p) * size / F.row_number().over(asc)))
    tail = asc.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    q = F.least(F.greatest(F.min("_q").over(tail), F.lit(0.0)), F.lit(1.0))
    return raw.withColumn(out, F.when(tested, q)).drop("_q")
