"""The exact quantile search against Spark's percentile and brute force."""

from __future__ import annotations

import math
import random

import pytest
from conftest import SF_MID
from pyspark.sql import functions as F

from cohortlens.operators import quantile
from cohortlens.operators.describe import box_stats, describe
from cohortlens.operators.quantile import exact_quantiles, outlier_cut, outlier_volume
from cohortlens.plans.pipeline import Study

QS = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]


def percentile(df, column, q):
    return df.agg(F.percentile(F.col(column).cast("double"), F.lit(q))).first()[0]


# a small accuracy forces several rounds on small data; the path is the same
@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_equals_percentile(spark, accuracy):
    fx = Study.from_fixtures(spark, SF_MID).fx_core
    targets = [(c, q) for c in ("revenue_rub", "order_id", "tickets_count") for q in QS]
    got = exact_quantiles(fx, targets, accuracy)
    for c, q in targets:
        assert got[(c, q)] == percentile(fx, c, q)


@pytest.mark.parametrize("accuracy", [10_000, 10])
def test_heavy_duplicates(spark, accuracy):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(7.0))
                                    .otherwise(F.col("id").cast("double") / 10).alias("x"))
    got = exact_quantiles(df, [("x", q) for q in (0.1, 0.33, 0.5, 0.9, 0.999)], accuracy)
    for (_, q), v in got.items():
        assert v == percentile(df, "x", q)


@pytest.mark.parametrize("accuracy", [10_000, 4])
def test_two_values_at_the_border(spark, accuracy):
    df = spark.range(2000).selectExpr("if(id < 1000, 1.0, 2.0) as x")
    assert exact_quantiles(df, [("x", 0.5)], accuracy)[("x", 0.5)] == 1.5


@pytest.mark.parametrize("accuracy", [10_000, 4])
def test_infinities_nan_and_nulls(spark, accuracy):
    vals = [float(v) for v in range(50)] + [math.inf, -math.inf, math.nan, None, 5e-324, -5e-324]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, [("x", q) for q in QS], accuracy)
    rest = sorted(v for v in vals if v is not None and not math.isnan(v))
    assert got[("x", 0.0)] == -math.inf and got[("x", 1.0)] == math.inf
    assert got[("x", 0.5)] == (rest[(len(rest) - 1) // 2] + rest[len(rest) // 2]) / 2
    none = spark.createDataFrame([(math.nan,), (None,)], "x double")
    assert exact_quantiles(none, [("x", 0.5)]) == {("x", 0.5): None}
    assert outlier_cut(none, "x").count() == 0


def test_random_data(spark):
    rnd = random.Random(7)
    for _ in range(4):
        vals = sorted(float(rnd.choice([rnd.randint(0, 50), rnd.random() * 1000, 3.5])) for _ in range(rnd.randint(20, 400)))
        df = spark.createDataFrame([(v,) for v in vals], "x double")
        for (_, q), v in exact_quantiles(df, [("x", q) for q in QS], 8).items():
            pos = (len(vals) - 1) * q
            lo, hi = vals[math.floor(pos)], vals[math.ceil(pos)]
            assert v == pytest.approx(lo + (hi - lo) * (pos - math.floor(pos)), rel=1e-12, abs=1e-12)


def test_revenue_cut(spark):
    assert outlier_cut(Study.from_fixtures(spark, SF_MID).fx_core, "revenue_rub").count() == 4831


@pytest.fixture
def passes(monkeypatch):
    """Plans of the passes that a search makes."""
    seen = []
    kept = quantile._pass

    def counted(stored, aggregates):
        seen.append(stored.agg(*aggregates)._jdf.queryExecution().optimizedPlan().toString())
        return kept(stored, aggregates)

    monkeypatch.setattr(quantile, "_pass", counted)
    return seen


def test_joins_run_once(spark, passes):
    """Two passes over the stored columns, whatever lies below them."""
    fx = Study.from_fixtures(spark, SF_MID).fx_core
    runs = [lambda: outlier_cut(fx, "revenue_rub"), lambda: outlier_volume(fx, "revenue_rub"),
            lambda: describe(fx), lambda: box_stats(fx, "revenue_rub")]
    for run in runs:
        passes.clear()
        run()
        assert len(passes) == 2
        assert all("Join" not in p and "Relation" in p for p in passes)
    final = outlier_volume(fx, "revenue_rub")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in final


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 999, 20_001, 300_000])
def test_two_passes_at_any_size(spark, passes, n):
    df = spark.range(n).selectExpr("cast((id * 7919) % 1000003 as double) as x")
    got = exact_quantiles(df, [("x", q) for q in QS])
    assert len(passes) == 2
    for (_, q), v in got.items():
        assert v == percentile(df, "x", q)


def test_more_rounds_without_lists(spark, passes, monkeypatch):
    """Beyond what a pass may list, the next round looks between two ends."""
    monkeypatch.setattr(quantile, "LISTED", 0)
    df = spark.range(50_000).selectExpr("cast((id * 7919) % 1000003 as double) as x")
    got = exact_quantiles(df, [("x", q) for q in (0.25, 0.99)], 100)
    assert len(passes) > 2
    for (_, q), v in got.items():
        assert v == percentile(df, "x", q)
