"""Plan shape: pushdown, pruning, exchanges, no row-at-a-time Python."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from conftest import SF_MID, SF_SMALL

from cohortlens.operators import buckets, segments
from cohortlens.operators import profile as profiles
from cohortlens.operators.fx import fx_normalise
from cohortlens.plans.pipeline import Study
from cohortlens.plans.queries import FILE_REPORTS, REPORTS
from cohortlens.plans.report_pack import run_reports
from cohortlens.schemas import ORDER_BUCKET_LABELS, TICKET_BUCKET_LABELS


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_genre_filter_pushed_to_scan_and_event_join_inner(spark):
    st = Study.from_fixtures(spark, SF_MID)
    p = plan(st.extract_core)
    assert "Not(EqualTo(p_type,PROMO))" in p
    opt = st.extract_core._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in opt and "Join LeftOuter" in opt


def test_scan_prunes_columns(spark):
    st = Study.from_fixtures(spark, SF_MID)
    p = plan(st.extract_core)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint>" in p


def test_gaps_and_profile_stay_in_the_jvm(spark):
    st = Study.from_fixtures(spark, SF_MID)
    for df in (st.profile, st.extract):
        p = plan(df)
        assert "MapInPandas" not in p and "EvalPython" not in p


def test_profile_hashes_and_does_not_sort_orders(spark):
    st = Study.from_fixtures(spark, SF_MID)
    for df in (st.profile, REPORTS["first_order_attrs"](st)):
        p = plan(df)
        assert "SortAggregate" not in p and "ObjectHashAggregate" not in p and "HashAggregate" in p
    # the windows over (user, hour) and user sort aggregated rows only
    assert "Sort " not in plan(REPORTS["first_order_attrs"](st))


def test_ranked_first_attributes_equal_structs(spark, monkeypatch):
    """Ties, nulls, rows without a time, times before 1970, more values than are ranked."""
    t = [dt.datetime(1969, 5, 1, 3), dt.datetime(1969, 5, 1, 3, 0, 0, 1), dt.datetime(2024, 1, 1, 10), None]
    rows = [(u, t[(u * 7 + k * 3) % 4 if u % 5 else 3], k, *[None if (u + k + j) % 3 == 0 else f"v{(u * k * (j + 3)) % 11}" for j in range(4)],
             Decimal("1.5"), 2) for u in range(1, 60) for k in range(u % 6 + 1)]
    rows.append((None, t[2], 1, "a", "b", "c", "d", Decimal("1"), 1))
    df = spark.createDataFrame(rows, "user_id bigint, order_ts timestamp_ntz, order_id bigint, device_type_canonical string, "
                                     "region_name string, service_name string, event_type_main string, "
                                     "revenue_rub decimal(24,6), tickets_count int")
    ranked = [profiles.customer_profile(df), profiles.first_order_attrs(df)]
    monkeypatch.setattr(profiles, "attribute_ranks", lambda values: None)
    structs = [profiles.customer_profile(df), profiles.first_order_attrs(df)]
    for a, b in zip(ranked, structs):
        assert a.schema == b.schema and a.count() == b.count() == 59 and a.exceptAll(b).isEmpty()
    monkeypatch.undo()
    assert profiles.attribute_ranks({"service_name": df}, limit=3) is None
    wide = profiles.attribute_ranks({"service_name": df, "region_name": df})
    assert [r.value for r in wide.where("attr = 'region_name'").orderBy("rank").collect()] == sorted(
        {r[4] for r in rows if r[4]})


def test_orders_are_not_shuffled_by_day_for_the_rates(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        st = Study.from_fixtures(spark, SF_MID)
        assert not any("hashpartitioning(order_dt" in line or "hashpartitioning(created_dt" in line
                       for line in plan(st.fx_core).splitlines())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rates_beyond_the_broadcast_bound_give_the_same_rows(spark):
    st = Study.from_fixtures(spark, SF_MID)
    few = fx_normalise(st.extract_core, st.tables.rates)
    many = fx_normalise(st.extract_core, st.tables.rates, broadcast_rows=0)
    assert few.count() == many.count()
    assert few.exceptAll(many).isEmpty()


def test_reports_come_ordered(spark):
    st = Study.from_fixtures(spark, SF_MID, materialize="checkpoint", purchases_mode=False)
    assert [r[0] for r in buckets.tickets_bucket_stats(st.profile_f).collect()] == TICKET_BUCKET_LABELS
    assert [r[0] for r in buckets.order_bucket_counts(st.profile_f).collect()] == ORDER_BUCKET_LABELS
    assert [r.day_of_week for r in buckets.weekday_return(st.profile_f).collect()] == list(range(7))
    values = [r[0] for r in buckets.bucket_values(st.profile_f).collect()]
    assert values == sorted(values) and values[0] == 5
    shares = [r.is_two_share for r in REPORTS["chart_return_region"](st).collect()]
    assert shares == sorted(shares) and len(shares) > 5


CUBE_REPORTS = [n for n in REPORTS if n.startswith(("segment_", "chart_", "region_", "service_", "tickets_bucket_", "weekday_", "gap_",
                                                    "order_bucket", "bucket_", "unbucketed")) and n != "segment_cube"]


def test_reports_from_one_cube(spark):
    """Every segment and bucket report from the cube equals its own query, and none of them reads the profile."""
    own = Study.from_fixtures(spark, SF_MID, materialize="checkpoint", purchases_mode=False)
    shared = Study(spark, own.tables, own.params, "checkpoint", own.source_dir, cube=True)
    shared.profile_f = own.profile_f
    cube = shared.segments.cube
    assert "Expand" in plan(segments.segment_cube(own.profile_f)) and plan(segments.segment_cube(own.profile_f)).count("Scan ExistingRDD") == 1
    assert len(CUBE_REPORTS) == 30
    shared.profile_f = None
    for name in CUBE_REPORTS:
        a, b = REPORTS[name](own), REPORTS[name](shared)
        assert a.schema.simpleString() == b.schema.simpleString(), name
        assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()], name
    assert cube.where("segment = 'all_users'").count() == 1


def test_counts_of_odd_profiles(spark):
    """No users, and users without a segment, a first time or a bucket."""
    st = Study.from_fixtures(spark, SF_SMALL)
    row = (("u1", None, None, None, None, None, None, 200, 1.0, 20.0, None, True, True),)
    for rows in ((), row):
        profile = spark.createDataFrame(rows, st.profile.schema)
        cube = segments.CubeCounts(segments.segment_cube(profile))
        for source in (profile, cube):
            assert segments.segment_share(source, "first_order_region").count() == 0
            assert buckets.weekday_return(source).count() == 0
            assert [tuple(r) for r in buckets.tickets_bucket_stats(source).collect()] == [
                (x, 0.0 if rows else None, 0) for x in TICKET_BUCKET_LABELS]
            assert tuple(buckets.unbucketed_users(source).first()) == ((1, 1, 1) if rows else (0, 0, 0))


def test_report_pack_without_a_folder(spark, tmp_path):
    st = Study.from_fixtures(spark, SF_SMALL, materialize="checkpoint")
    st.source_dir = None
    names = run_reports(st, str(tmp_path), names=["user_count"])
    assert set(names) == {"user_count"} and "events_gap_stats" in FILE_REPORTS
