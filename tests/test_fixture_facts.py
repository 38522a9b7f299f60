"""Anchors from FIXTURES.md (computed there with DuckDB on the same mapping)."""

from __future__ import annotations

from conftest import SF_MID, SF_SMALL
from pyspark.sql import functions as F

from cohortlens.plans.pipeline import Study


def _groups(profile):
    return {r["g"]: r["count"] for r in profile.groupBy(
        F.when(F.col("total_orders_cnt") == 1, "1")
         .when(F.col("total_orders_cnt") < 5, "2-4").otherwise("5+").alias("g")).count().collect()}


def test_sf001_anchors(spark):
    st = Study.from_fixtures(spark, SF_MID)
    assert st.extract_core.count() == 4915
    assert st.fx_core.where(F.col("revenue_rub").isNull()).count() == 35
    assert st.clean.count() == 4831
    assert st.profile.count() == 1433
    assert _groups(st.profile) == {"1": 194, "2-4": 905, "5+": 334}
    assert st.profile_f.count() == 1424
    assert st.tables.rates.count() == 2353


def test_sf0001_anchors(spark):
    st = Study.from_fixtures(spark, SF_SMALL)
    assert st.extract_core.count() == 463
    assert st.extract_core.where(F.col("region_name").isNull()).count() == 380
    assert st.clean.count() == 457
    assert st.profile.count() == 143
    assert _groups(st.profile) == {"1": 25, "2-4": 87, "5+": 31}
    assert st.profile_f.count() == 142


def test_dimension_keys_unique(spark):
    Study.from_fixtures(spark, SF_SMALL).validate()
