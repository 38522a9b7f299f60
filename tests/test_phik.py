"""phi_k: solver properties and the Spark pipeline invariants."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from cohortlens.operators import phik
from cohortlens.plans import queries as Q


def _chi2(table):
    t = np.asarray(table, dtype=float)
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    return float(((t - e) ** 2 / e).sum()), float(t.sum())


def test_solver_limits():
    chi2, n = _chi2([[50, 0], [0, 50]])
    assert phik.phik_from_chi2(chi2, n, 2, 2, 1) == 1.0
    chi2, n = _chi2([[25, 25], [25, 25]])
    assert phik.phik_from_chi2(chi2, n, 2, 2, 1) == 0.0
    chi2, n = _chi2([[40, 10], [10, 40]])
    assert phik.phik_from_chi2(chi2, n, 2, 2, 1) == pytest.approx(0.804, abs=2e-3)
    assert phik.phik_from_chi2(3.0, 10, 1, 3, 0) is None


def test_distance_increases_with_rho():
    p0 = phik._cell_probs(4, 5, 0.0)
    d = [float((((phik._cell_probs(4, 5, r) - p0) ** 2) / p0).sum()) for r in (0.0, 0.3, 0.6, 0.9, 1.0)]
    assert d[0] == pytest.approx(0.0, abs=1e-15) and all(a < b for a, b in zip(d, d[1:]))


def test_correlation_one_is_the_analytic_limit():
    for r, k in ((20, 21), (100, 97)):
        h, g = np.linspace(-5, 5, r + 1), np.linspace(-5, 5, k + 1)
        assert np.array_equal(phik._bvn_cdf(h, g, 1.0), np.minimum.outer(phik._phi(h), phik._phi(g)))
        for rho in (0.5, 0.9, 0.900001, 0.99, 1.0):
            assert phik._cell_probs(r, k, rho).min() > -1e-12
    h = np.linspace(-5, 5, 12)
    assert np.allclose(phik._bvn_cdf(h, h, 0.9), phik._bvn_cdf(h, h, 0.9 + 1e-12), atol=1e-11)


def test_independent_and_bijective_columns(spark):
    rows = [(str(i % 3), str(i % 3), str(i % 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    m = {(r.var_x, r.var_y): r.phik for r in phik.phik_matrix(df, ["a", "b", "c"]).collect()}
    assert m[("a", "b")] == 1.0 and m[("b", "a")] == 1.0
    assert m[("a", "c")] == 0.0
    assert m[("a", "a")] == 1.0


def test_constant_column_gives_null(spark):
    df = spark.createDataFrame([("x", str(i % 2)) for i in range(10)], "a string, b string")
    m = {(r.var_x, r.var_y): r.phik for r in phik.phik_matrix(df, ["a", "b"]).collect()}
    assert m[("a", "b")] is None


def test_matrix_symmetric_in_range_and_counts_consistent(spark):
    m = Q.QUERIES["phik_matrix"](spark, SF_SMALL).collect()
    vals = {(r.var_x, r.var_y): r.phik for r in m}
    n = len(Q.PHIK_K1_COLUMNS)
    assert len(vals) == n * n
    for (a, b), v in vals.items():
        assert vals[(b, a)] == v
        assert v is None or 0.0 <= v <= 1.0
    cells = Q.QUERIES["phik_contingency"](spark, SF_SMALL)
    per_pair = cells.groupBy("var_x", "var_y").agg(F.sum("n").alias("n")).collect()
    prof = Q.QUERIES["profile_outlier_cut"](spark, SF_SMALL)
    users = prof.count()
    with_region = prof.where("first_order_region IS NOT NULL").count()
    for r in per_pair:  # only the region can be null among the K1 columns
        region = "first_order_region" in (r.var_x, r.var_y)
        assert r.n == (with_region if region else users)


@pytest.mark.parametrize("table", [[[40, 10], [10, 40]], [[30, 20], [12, 38]], [[5, 1], [2, 9]]])
def test_two_by_two_matches_closed_form(table):
    # On a 2x2 grid split at 0 the cell masses are orthant probabilities,
    # 1/4 + asin(rho) / (2 pi), so X(rho) / X(1) = (2 asin(rho) / pi)^2 and
    # rho = sin(pi / 2 * sqrt((chi2 - ped) / (chi2_max - ped))).
    import math
    chi2, n = _chi2(table)
    ped, chi2_max = 1.0, n * 1.0
    expected = math.sin(math.pi / 2 * math.sqrt((chi2 - ped) / (chi2_max - ped)))
    assert phik.phik_from_chi2(chi2, n, 2, 2, ped) == pytest.approx(expected, abs=1e-5)
