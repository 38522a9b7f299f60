"""phi_k association matrix over mixed categorical / interval columns (K1-K3).

Method (Baak, Koopman, Snoek, Klous, arXiv:1811.11440):

1. interval columns are cut into equal-width bins over [min, max];
2. per column pair, a contingency table over rows where both are non-null;
3. Pearson chi2 against independence; with observed marginals this is
   ``sum(o^2 * N / (row * col)) - N`` over the observed cells only;
4. noise pedestal ``(r-1)(k-1)`` minus cells with zero expectation, floored
   at 0; chi2 at or below it gives 0;
5. chi2_max = N * min(r-1, k-1); chi2 at or above it gives 1;
6. otherwise solve ``ped + (chi2_max - ped) * X(rho) / X(1) = chi2`` for rho,
   X being the chi2-like distance between a bivariate normal with
   correlation rho and the independent one on an r x k grid over [-5, 5]^2.

Steps 1-2 are Spark aggregates: rows are first counted per combination of
all binned columns (partial aggregation), the column pairs are exploded from
those combinations and aggregated again, so each shuffle carries at most
(number of category combinations) rows per task whatever the data size.
Steps 3-5 are aggregates too (marginals joined back to the cells, sums per
pair), so no pair's table is gathered into one task; only the root search
of step 6 - one scalar per column pair, no row data - runs in a vectorised
pandas UDF.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import add_equal_width_bin, round_half_even

# 64-point Gauss-Legendre rule on [-1, 1] (computed, not tabulated).
_GL_X, _GL_W = np.polynomial.legendre.leggauss(64)


#: bins of an interval column that nobody has chosen
DEFAULT_BINS = 10


def inferred_interval_bins(df: DataFrame, columns: Sequence[str], bins: int = DEFAULT_BINS) -> dict[str, int]:
    """Interval columns among ``columns``: numbers (no booleans) with more distinct values than ``bins`` (K2).

    One pass estimates the distinct values of all numeric columns; only where
    the estimate is small are they counted exactly, in sets of that size.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in columns if isinstance(kinds[c], T.NumericType)]
    if not numeric:
        return {}
    estimates = dict(zip(numeric, df.agg(*[F.approx_count_distinct(c) for c in numeric]).first()))
    few = [c for c in numeric if estimates[c] <= 4 * bins]
    exact = dict(zip(few, df.agg(*[F.size(F.collect_set(c)) for c in few]).first())) if few else {}
    return {c: bins for c in numeric if exact.get(c, estimates[c]) > bins}


def binned_columns(df: DataFrame, columns: Sequence[str],
                   interval_bins: Mapping[str, int] | None = None) -> DataFrame:
    """Columns as category labels: interval columns as their 0-based
    equal-width bin, the others as strings; nulls stay null. Without
    ``interval_bins`` they are inferred; ``{}`` means none."""
    interval_bins = inferred_interval_bins(df, columns) if interval_bins is None else dict(interval_bins)
    out = []
    if interval_bins:
        # one aggregate, read through one scalar subquery
        bounds = df.agg(F.struct(*[
            F.struct(F.min(F.col(c).cast("double")).alias("lo"),
                     F.max(F.col(c).cast("double")).alias("hi")).alias(c)
            for c in interval_bins]).alias("b")).scalar()
    for c in interval_bins:
        df = add_equal_width_bin(df, c, bounds[c]["lo"], bounds[c]["hi"],
                                 interval_bins[c], f"__bin_{c}")
    for c in columns:
        if c in interval_bins:
            out.append(F.col(f"__bin_{c}").cast("string").alias(c))
        else:
            out.append(F.col(c).cast("string").alias(c))
    return df.select(*out)


def contingency(binned: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long contingency tables of every unordered column pair:
    ``(var_x, var_y, val_x, val_y, n)``, rows with a null in the pair dropped.

    The rows are first counted per combination of all
    binned columns (partial aggregation: each task ships at most one row per
    combination it saw), and the pairs are exploded from those combinations,
    so the per-row work is one hash update instead of one per column pair.
    """
    cols = list(columns)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    src = binned.groupBy(*cols).agg(F.count(F.lit(1)).alias("__w"))
    cells = F.array(*[
        F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"),
                 F.col(a).alias("val_x"), F.col(b).alias("val_y"), F.col("__w").alias("w"))
        for a, b in pairs])
    return (src.select(F.inline(cells))
               .where(F.col("val_x").isNotNull() & F.col("val_y").isNotNull())
               .groupBy("var_x", "var_y", "val_x", "val_y")
               .agg(F.sum("w").cast("long").alias("n")))


def pair_chi2(cells: DataFrame, digits: int = 6, materialize: bool = True) -> DataFrame:
    """Per pair: N, r, k, Pearson chi2, pedestal and chi2_max (steps 2-5),
    all as aggregates: no pair's table is ever gathered into one task.

    Row and column marginals are grouped sums joined back to the cells;
    per-pair totals and category counts have one row per column pair (at
    most columns^2 rows, so they are broadcast).
    """
    pk = ["var_x", "var_y"]
    if materialize:
        # the cell table feeds four branches: compute it once (reliable checkpoint)
        cells = cells.checkpoint(eager=True)
    nx = cells.groupBy(*pk, "val_x").agg(F.sum("n").alias("nx"))
    ny = cells.groupBy(*pk, "val_y").agg(F.sum("n").alias("ny"))
    per_pair = (nx.groupBy(*pk).agg(F.sum("nx").alias("tot"), F.count(F.lit(1)).alias("r"))
                  .join(ny.groupBy(*pk).agg(F.count(F.lit(1)).alias("k")), pk))
    j = (cells.join(nx, [*pk, "val_x"]).join(ny, [*pk, "val_y"])
              .join(F.broadcast(per_pair.select(*pk, "tot")), pk))
    s = j.groupBy(*pk).agg(F.sum(F.col("n").cast("double") * F.col("n") * F.col("tot")
                                 / (F.col("nx").cast("double") * F.col("ny"))).alias("s"))
    per = s.join(F.broadcast(per_pair), pk)
    chi2 = F.col("s") - F.col("tot")
    ped = F.greatest((F.col("r") - 1) * (F.col("k") - 1), F.lit(0))
    return per.select(*pk, F.col("tot").cast("long").alias("n"), F.col("r").cast("long"),
                      F.col("k").cast("long"),
                      round_half_even(chi2, digits).alias("chi2"),
                      ped.cast("long").alias("pedestal"),
                      (F.col("tot") * (F.least(F.col("r"), F.col("k")) - 1)).cast("long").alias("chi2_max"))


def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.vectorize(math.erf)(x / math.sqrt(2.0)))


def _bvn_cdf(h: np.ndarray, k: np.ndarray, rho: float) -> np.ndarray:
    """Standard bivariate normal CDF on the grid h x k.

    Phi2 = Phi(h)Phi(k) + 1/(2 pi) * int_0^asin(rho) exp(-(h^2 - 2hk sin t + k^2) / (2 cos^2 t)) dt
    (Plackett's identity with t = asin(s), which makes the integrand smooth).
    Near rho = 1 the integral runs from there to pi/2 instead and is taken from
    the limit min(Phi(h), Phi(k)). One grid is held at a time.
    """
    ph, pk = _phi(h), _phi(k)
    high = rho > 0.9
    start, end = (math.asin(min(rho, 1.0)), math.pi / 2) if high else (0.0, math.asin(rho))
    squares, product = h[:, None] ** 2 + k[None, :] ** 2, 2.0 * np.outer(h, k)
    area = np.zeros((len(h), len(k)))
    if end > start:
        for x, w in zip(_GL_X, _GL_W):
            t = start + 0.5 * (end - start) * (x + 1.0)
            area += 0.5 * (end - start) * w * np.exp(-(squares - product * math.sin(t)) / (2.0 * math.cos(t) ** 2))
    area /= 2.0 * math.pi
    return np.minimum.outer(ph, pk) - area if high else np.outer(ph, pk) + area


def _cell_probs(r: int, k: int, rho: float) -> np.ndarray:
    h = np.linspace(-5.0, 5.0, r + 1)
    kk = np.linspace(-5.0, 5.0, k + 1)
    cdf = _bvn_cdf(h, kk, rho)
    return cdf[1:, 1:] - cdf[:-1, 1:] - cdf[1:, :-1] + cdf[:-1, :-1]


def phik_from_chi2(chi2: float, n: float, r: int, k: int, pedestal: float,
                   tol: float = 1e-10) -> float | None:
    """Step 6: correlation of the bivariate normal that reproduces ``chi2``."""
    if r < 2 or k < 2 or n <= 0:
        return None
    chi2_max = n * (min(r, k) - 1)
    if chi2 >= chi2_max:
        return 1.0
    ped = max(pedestal, 0.0)
    if chi2 <= ped:
        return 0.0
    p0 = _cell_probs(r, k, 0.0)
    dist = lambda rho: float((((_cell_probs(r, k, rho) - p0) ** 2) / p0).sum())
    x1 = dist(1.0)
    if x1 <= 0:
        return None
    target = (chi2 - ped) / (chi2_max - ped) * x1
    lo, hi = 0.0, 1.0
    while hi - lo > tol:
        mid = 0.5 * (lo + hi)
        if dist(mid) < target:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def _round_half_even(x: float, digits: int) -> float:
    scale = float(10 ** digits)
    return float(np.rint(x * scale) / scale)


@F.pandas_udf(T.DoubleType())
def _phik_udf(chi2: pd.Series, n: pd.Series, r: pd.Series, k: pd.Series,
              ped: pd.Series) -> pd.Series:
    out = []
    for a, b, c, d, e in zip(chi2, n, r, k, ped):
        rho = phik_from_chi2(float(a), float(b), int(c), int(d), float(e))
        out.append(None if rho is None else _round_half_even(rho, 6))
    return pd.Series(out, dtype="float64")


def phik_pairs(df: DataFrame, columns: Sequence[str],
               interval_bins: Mapping[str, int] | None = None, digits: int = 6) -> DataFrame:
    """phi_k of every unordered column pair with its chi2 statistics."""
    binned = binned_columns(df, columns, interval_bins)
    stats = pair_chi2(contingency(binned, columns), digits)
    # one row per column pair: the root search is the only Python step
    return stats.withColumn("phik", _phik_udf("chi2", "n", "r", "k", "pedestal"))


def phik_matrix(df: DataFrame, columns: Sequence[str],
                interval_bins: Mapping[str, int] | None = None, digits: int = 6) -> DataFrame:
    """Long symmetric matrix ``(var_x, var_y, phik)`` with 1 on the diagonal;
    null where a pair has fewer than two categories on a side (constant
    column, or constant after dropping nulls)."""
    cols = list(columns)
    pairs = phik_pairs(df, cols, interval_bins, digits).select("var_x", "var_y", "phik")
    spark = df.sparkSession
    names = spark.createDataFrame([(c, c) for c in cols], "var_x string, var_y string")
    all_pairs = spark.createDataFrame(
        [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]], "var_x string, var_y string")
    upper = all_pairs.join(pairs, ["var_x", "var_y"], "left")  # pairs without data -> null
    lower = upper.select(F.col("var_y").alias("var_x"), F.col("var_x").alias("var_y"), "phik")
    diag = names.select("var_x", "var_y", F.lit(1.0).alias("phik"))
    return upper.unionByName(lower).unionByName(diag)
