"""Hand-made edge cases (FIXTURES.md §3) on tiny in-memory frames."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortlens import schemas
from cohortlens.functions import round_half_even, whole_days
from cohortlens.operators import buckets, describe, segments
from cohortlens.operators.fx import fx_normalise
from cohortlens.operators.profile import customer_profile
from cohortlens.operators.quantile import outlier_cut

T0 = dt.datetime(2024, 1, 1, 10, 0)  # a Monday

CLEAN_SCHEMA = ("user_id string, order_id long, order_ts timestamp_ntz, revenue_rub decimal(24,6), "
                "tickets_count int, device_type_canonical string, region_name string, "
                "service_name string, event_type_main string")


def clean_df(spark, rows):
    return spark.createDataFrame(rows, CLEAN_SCHEMA)


def o(user, oid, ts, dev="mobile", region="R1", svc="S1", genre="G1", rev="100", tk=2):
    return (user, oid, ts, Decimal(rev), tk, dev, region, svc, genre)


def test_first_order_ties_take_independent_minima(spark):
    rows = [o("u1", 1, T0, dev="mobile", genre="concert", region=None),
            o("u1", 2, T0, dev="desktop", genre="ballet", region="R9"),
            o("u1", 3, T0 + dt.timedelta(days=3), dev="desktop", genre="aaa", region="A")]
    p = customer_profile(clean_df(spark, rows)).collect()[0]
    assert p.first_order_device == "desktop"     # min of mobile/desktop
    assert p.first_event_type == "ballet"        # min of concert/ballet
    assert p.first_order_region == "R9"          # null skipped
    assert p.total_orders_cnt == 3 and p.is_two and not p.is_five
    assert p.date_difference_d == pytest.approx((0 + 3) / 2)


def test_gap_counts_whole_24h_days(spark):
    rows = [o("u2", 1, dt.datetime(2024, 1, 1, 23, 0)), o("u2", 2, dt.datetime(2024, 1, 2, 1, 0)),
            o("u3", 3, T0)]
    prof = {r.user_id: r for r in customer_profile(clean_df(spark, rows)).collect()}
    assert prof["u2"].date_difference_d == 0.0
    assert prof["u3"].date_difference_d is None
    assert not prof["u3"].is_two and not prof["u3"].is_five


def test_whole_days_vs_datediff(spark):
    r = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1))],
                              "a timestamp_ntz, b timestamp_ntz")
    got = r.select(whole_days("a", "b").alias("w"), F.datediff("b", "a").alias("d")).collect()[0]
    assert (got.w, got.d) == (0, 1)


def test_null_user_excluded(spark):
    rows = [o(None, 1, T0), o("u1", 2, T0)]
    assert [r.user_id for r in customer_profile(clean_df(spark, rows)).collect()] == ["u1"]


def test_fx_missing_rate_third_currency_and_strict(spark):
    day = dt.datetime(2024, 1, 1)
    orders = spark.createDataFrame(
        [(1, day, "kzt", Decimal("200.00")), (2, day + dt.timedelta(days=1), "kzt", Decimal("200.00")),
         (3, day, "usd", Decimal("5.00")), (4, day, "rub", Decimal("7.00"))],
        "order_id long, order_dt timestamp_ntz, currency_code string, revenue decimal(18,2)")
    rates = spark.createDataFrame([(day, 100, Decimal("19.500000"), "kzt")], schemas.RATES)
    got = {r.order_id: r.revenue_rub for r in fx_normalise(orders, rates).collect()}
    assert got == {1: Decimal("39.000000"), 2: None, 3: Decimal("5.000000"), 4: Decimal("7.000000")}
    strict = {r.order_id: r.revenue_rub for r in fx_normalise(orders, rates, strict=True).collect()}
    assert strict[3] is None and strict[4] == Decimal("7.000000")
    # the null (no rate) is dropped by the cut
    cut = outlier_cut(fx_normalise(orders, rates), "revenue_rub", 1.0)
    assert sorted(r.order_id for r in cut.collect()) == [1, 3, 4]


def test_duplicate_rates_fail_validation(spark):
    day = dt.datetime(2024, 1, 1)
    rates = spark.createDataFrame([(day, 100, Decimal("1"), "kzt"), (day, 100, Decimal("2"), "kzt")],
                                  schemas.RATES)
    orders = spark.createDataFrame([(1, day, "kzt", Decimal("1.00"))],
                                   "order_id long, order_dt timestamp_ntz, currency_code string, revenue decimal(18,2)")
    with pytest.raises(schemas.ValidationError):
        fx_normalise(orders, rates, validate=True)
    ev = spark.createDataFrame([("e1", "x"), ("e1", "y")], "event_id string, n string")
    with pytest.raises(schemas.ValidationError):
        schemas.assert_unique(ev, ["event_id"], "events")


def _profile(spark, rows):
    return spark.createDataFrame(rows, "user_id string, avg_cnt_per_order double, total_orders_cnt long, "
                                       "min_order_ts timestamp_ntz, is_two boolean, is_five boolean, "
                                       "first_event_type string, date_difference_d double")


def test_ticket_and_order_bucket_edges(spark):
    vals = [1.99, 2.0, 3.0, 5.0, 11.99, 12.0]
    p = _profile(spark, [(f"u{i}", v, 1, T0, False, False, "g", None) for i, v in enumerate(vals)])
    got = [r.cnt_tickets_cat for r in buckets.with_ticket_bucket(p).orderBy("avg_cnt_per_order").collect()]
    assert got == ["1-2", "2-3", "3-5", "5+", "5+", None]
    opened = buckets.with_ticket_bucket(p, open_top=True).where("avg_cnt_per_order = 12").collect()[0]
    assert opened.cnt_tickets_cat == "5+"
    counts = [1, 2, 4, 5, 152, 153]
    q = _profile(spark, [(f"u{i}", 1.0, c, T0, c >= 2, c >= 5, "g", None) for i, c in enumerate(counts)])
    got = [r.cnt_tickets_cat_v2 for r in buckets.with_order_bucket(q).orderBy("total_orders_cnt").collect()]
    assert got == ["1", "2-4", "2-4", "5+", "5+", None]


def test_empty_ticket_bucket_listed_and_share_denominator(spark):
    p = _profile(spark, [("a", 1.0, 1, T0, False, False, "g", None),
                         ("b", 12.5, 1, T0, False, False, "g", None)])
    got = {r.cnt_tickets_cat: (r.cnt, r.share) for r in buckets.tickets_bucket_stats(p).collect()}
    assert got == {"1-2": (1, 50.0), "2-3": (0, 0.0), "3-5": (0, 0.0), "5+": (0, 0.0)}


def test_weekday_monday_zero_sunday_six_and_null_share(spark):
    sunday = dt.datetime(2024, 1, 7, 12)
    p = _profile(spark, [("a", 1.0, 2, T0, True, False, "g", 1.0),
                         ("b", 1.0, 1, sunday, False, False, "g", None)])
    got = {r.day_of_week: (r.cnt, r.share) for r in buckets.weekday_return(p).collect()}
    assert got == {0: (1, 100.0), 6: (1, None)}


def test_segment_without_returner_is_absent(spark):
    p = _profile(spark, [("a", 1.0, 2, T0, True, False, "g1", 1.0),
                         ("b", 1.0, 1, T0, False, False, "g2", None),
                         ("c", 1.0, 1, T0, False, False, None, None)])
    rep = {r.first_event_type: r for r in segments.segment_return(p, "first_event_type").collect()}
    assert set(rep) == {"g1"}
    full = {r.first_event_type for r in segments.segment_return(p, "first_event_type", include_zero=True).collect()}
    assert full == {"g1", "g2"}
    share = {r.first_event_type: r.share for r in segments.segment_share(p, "first_event_type").collect()}
    assert share["g1"] == pytest.approx(100 / 3)  # null-segment users count in the denominator


def test_half_even_rounding(spark):
    r = spark.createDataFrame([(0.125, 1.005)], "a double, b double").select(
        round_half_even("a", 2).alias("a"), round_half_even("b", 2).alias("b")).collect()[0]
    assert (r.a, r.b) == (0.12, 1.0)


def test_constant_column_histogram_single_bin(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    rows = describe.histogram(df, "x", 10).collect()
    assert [(r.bin, r.cnt) for r in rows] == [(0, 2)]


def test_histogram_counts_sum_and_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "x double")
    rows = sorted(describe.histogram(df, "x", 5).collect(), key=lambda r: r.bin)
    assert [r.cnt for r in rows] == [2, 2, 2, 2, 3]   # last bin closed
    assert rows[0].bin_lo == 0.0 and rows[-1].bin_hi == 10.0


def test_box_stats(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    r = describe.box_stats(df, "x").collect()[0]
    assert (r.q1, r.median, r.q3) == (2.0, 3.0, 4.0)
    assert (r.whisker_lo, r.whisker_hi, r.outliers_high, r.outliers_low) == (1.0, 4.0, 1, 0)


def test_report_orders(spark):
    p = _profile(spark, [("a", 1.0, 2, T0, True, False, "g1", 1.0), ("b", 1.0, 1, T0, False, False, "g2", None),
                         ("c", 1.0, 2, T0, True, False, "g2", 1.0), ("d", 1.0, 2, T0, True, False, "g3", 1.0)])
    assert [r.first_event_type for r in segments.segment_share(p, "first_event_type").collect()] == ["g2", "g1", "g3"]
    assert [r.first_event_type for r in segments.segment_return(p, "first_event_type").collect()] == ["g3", "g2", "g1"]
    by_rate = segments.segment_return(p, "first_event_type", sort_by="is_two_share").collect()
    assert [r.first_event_type for r in by_rate] == ["g1", "g3", "g2"]
    chart = segments.chart_frame(segments.segment_return(p, "first_event_type"), "first_event_type").collect()
    assert [r.first_event_type for r in chart] == ["g2", "g1", "g3"]


def test_user_without_ticket_counts_and_empty_inputs(spark):
    rows = [("u1", 1, T0, Decimal("10"), None, "mobile", "R", "S", "G")]
    p = customer_profile(clean_df(spark, rows)).collect()[0]
    assert p.avg_cnt_per_order is None and p.avg_revenue_rub == 10.0
    empty = customer_profile(clean_df(spark, []))
    assert segments.profile_summary(empty).collect()[0].total_users_cnt == 0
    assert {r.cnt for r in buckets.tickets_bucket_stats(empty).collect()} == {0}
