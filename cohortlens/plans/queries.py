"""

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the
driver's parquet tables mapped onto the study's schema (FIXTURES.md §2);
building one runs the quantile rounds and checkpoints its study needs. Every query reads the whole tables. Column names equal the aliases of the
matching SQL in ``cohortlens.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import round_half_even
from ..operators import buckets, describe, phik, quality, segments, user_counts
from ..operators.fx import fx_normalise
from ..operators.profile import customer_lifetime, customer_profile, first_order_attrs, order_gap_mean, user_count
from ..operators.quantile import outlier_volume
from ..operators.sequence import gap_stats
from ..session import checkpoint_dir
from ..sources import store
from ..sources.readers import read_rates_csv, table_overview
from .pipeline import Study

Query = Callable[[SparkSession, str], DataFrame]
Report = Callable[["Study"], DataFrame]

# The segment keys of the four reports.
SEGMENTS = {
    "event": "first_event_type",
    "device": "first_order_device",
    "region": "first_order_region",
    "service": "first_service_name",
}

# The phi_k column sets of the study (K1, K2).
PHIK_K1_COLUMNS = ["first_order_device", "first_order_region", "first_service_name",
                   "first_event_type", "total_orders_cnt", "is_two", "is_five",
                   "cnt_tickets_cat", "day_of_week"]
PHIK_K1_BINS = {"total_orders_cnt": 3}
PHIK_K2_COLUMNS = ["first_order_device", "first_order_region", "first_service_name",
                   "first_event_type", "cnt_tickets_cat_v2", "is_two", "is_five",
                   "day_of_week", "avg_cnt_per_order", "date_difference_d"]
# what the call without arguments should infer; the SQL bins these
PHIK_K2_BINS = {"day_of_week": 10, "avg_cnt_per_order": 10, "date_difference_d": 10}

# The two genres compared in the hypothesis check.
COMPARE_GENRES = ("LARGE", "SMALL")


def _study(spark: SparkSession, sf_dir: str) -> Study:
    # The profile, which several branches of a report read, is written once to
    # the shared checkpoint folder. Nothing stays in executor storage, so no
    # query finds what another one left behind.
    return Study.from_fixtures(spark, sf_dir, materialize="checkpoint", purchases_mode=False)


def _phik_frame(study: Study) -> DataFrame:
    p = buckets.with_weekday(buckets.with_order_bucket(buckets.with_ticket_bucket(study.profile_f)))
    return p


# --- sources, extract, cleaning ---------------------------------------------------------

def r_extract_purchases(st: Study) -> DataFrame:
    return st.extract


def r_table_overview(st: Study) -> DataFrame:
    return table_overview(st.extract)


def r_typed_purchases(st: Study) -> DataFrame:
    return st.purchases_rub


def r_fx_normalise(st: Study) -> DataFrame:
    return st.fx_core.select("order_id", "order_dt", "currency_code",
                                            "revenue", "revenue_rub")


def r_fx_from_rates_csv(st: Study) -> DataFrame:
    """The rates table written as CSV into the shared folder and read back."""
    path = f"{checkpoint_dir(st.spark).rstrip('/')}/rates-csv-{uuid.uuid4().hex}"
    (st.tables.rates.select("cdx", "curs", "nominal", F.date_format("data", "yyyy-MM-dd").alias("data"))
     .write.option("header", True).csv(path))
    return (fx_normalise(st.extract_core, read_rates_csv(st.spark, path), strict=st.params.strict_fx)
            .select("order_id", "order_dt", "currency_code", "revenue", "revenue_rub"))


def r_outlier_cut(st: Study) -> DataFrame:
    return st.clean


def r_outlier_volume(st: Study) -> DataFrame:
    return outlier_volume(st.fx_core, "revenue_rub", 0.99)


def r_outlier_volume_95(st: Study) -> DataFrame:
    return outlier_volume(st.fx_core, "revenue_rub", 0.95)


def r_user_count(st: Study) -> DataFrame:
    return user_count(st.clean)


def r_monthly_users(st: Study) -> DataFrame:
    ids = st.clean.select(F.col("user_id").cast("bigint").alias("user_id"), "order_ts")
    return user_counts.monthly_users(user_counts.monthly_bitmaps(ids))


def r_days_since_prev(st: Study) -> DataFrame:
    return st.extract.select("user_id", "order_id", "order_dt", "days_since_prev")


# --- profile ------------------------------------------------------------------------------

def r_customer_profile(st: Study) -> DataFrame:
    return st.profile


def r_profile_from_store(st: Study) -> DataFrame:
    """The profile from a store of the cleaned purchases, co-partitioned by user."""
    name = uuid.uuid4().hex
    # the rows before the cut, about 1 % more than the store's
    buckets = store.buckets_for(st.revenue_numbers.count())
    store.write_user_store(st.clean, name, f"{checkpoint_dir(st.spark).rstrip('/')}/user-store-{name}", buckets)
    return customer_profile(store.read_user_store(st.spark, name), values=st.attribute_values)


def r_first_order_attrs(st: Study) -> DataFrame:
    return first_order_attrs(st.clean, values=st.attribute_values)


def r_order_gap_mean(st: Study) -> DataFrame:
    return order_gap_mean(st.clean)


def r_events_gap_stats(st: Study) -> DataFrame:
    ev = st.spark.read.parquet(f"{st.source_dir.rstrip('/')}/events.parquet")
    return gap_stats(ev, "user_id", "ts")


def r_profile_summary(st: Study) -> DataFrame:
    return segments.profile_summary(st.profile)


def r_describe_orders(st: Study) -> DataFrame:
    return describe.describe(st.purchases_rub)


def r_describe_profile(st: Study) -> DataFrame:
    return describe.describe(st.profile,
                             ["total_orders_cnt", "avg_cnt_per_order", "date_difference_d"])


def r_profile_outlier_cut(st: Study) -> DataFrame:
    return st.profile_f


def r_profile_outlier_volume(st: Study) -> DataFrame:
    return outlier_volume(st.profile, "total_orders_cnt", 0.99)


def r_customer_lifetime(st: Study) -> DataFrame:
    return customer_lifetime(st.profile)


# --- segment reports ------------------------------------------------------------------------

def _share(key):
    return lambda st: segments.segment_share(st.segments, key)


# The order each return report is read in (region by size, service by rate).
RETURN_ORDER = {"first_event_type": "key", "first_order_device": "key",
                "first_order_region": "users_cnt", "first_service_name": "is_two_share"}


def _ret(key):
    return lambda st: segments.segment_return(st.segments, key, sort_by=RETURN_ORDER[key])


def _chart(key):
    return lambda st: segments.chart_frame(segments.segment_return(st.segments, key, sort_by=None), key)


#: smallest segment that the reduced return report shows
MIN_SEGMENT_USERS = 30


def r_segment_return_region_min(st: Study) -> DataFrame:
    return segments.segment_return(st.segments, SEGMENTS["region"], min_users=MIN_SEGMENT_USERS)


def r_segment_share_region_top(st: Study) -> DataFrame:
    rep = segments.segment_share(st.segments, SEGMENTS["region"])
    return segments.top_segments(rep, SEGMENTS["region"], "users_cnt", 10)


def r_segment_share_service_top(st: Study) -> DataFrame:
    rep = segments.segment_share(st.segments, SEGMENTS["service"])
    return segments.top_segments(rep, SEGMENTS["service"], "users_cnt", 10)


def r_segment_return_region_top(st: Study) -> DataFrame:
    rep = segments.segment_return(st.segments, SEGMENTS["region"])
    return segments.top_segments(rep, SEGMENTS["region"], "users_cnt", 15)


def r_region_top10(st: Study) -> DataFrame:
    rep = segments.segment_return(st.segments, SEGMENTS["region"])
    return segments.top_segments(rep, SEGMENTS["region"], "users_cnt", 10) \
                   .select("first_order_region", "is_two_share")


def r_region_tail_mean(st: Study) -> DataFrame:
    rep = segments.segment_return(st.segments, SEGMENTS["region"])
    tail = segments.tail_segments(rep, SEGMENTS["region"], "users_cnt", 10)
    return segments.mean_of(tail, "is_two_share", "mean_is_two_share")


def r_service_top(st: Study) -> DataFrame:
    rep = segments.segment_return(st.segments, SEGMENTS["service"])
    return segments.top_segments(rep, SEGMENTS["service"], "is_two_share", 10)


def r_service_top_mean(st: Study) -> DataFrame:
    top = r_service_top(st)
    return segments.mean_of(top, "is_two_share", "mean_is_two_share")


def r_segment_lift(st: Study) -> DataFrame:
    return segments.segment_lift(st.segments, SEGMENTS["event"])


def r_segment_compare(st: Study) -> DataFrame:
    return segments.segment_compare(st.segments, SEGMENTS["event"], *COMPARE_GENRES)


def r_service_top_by_users(st: Study) -> DataFrame:
    rep = segments.segment_return(st.segments, SEGMENTS["service"])
    return segments.top_segments(rep, SEGMENTS["service"], "users_cnt", 10)


# --- buckets and retention ------------------------------------------------------------------

def r_tickets_bucket(st: Study) -> DataFrame:
    return buckets.with_ticket_bucket(st.profile_f) \
                  .select("user_id", "avg_cnt_per_order", "cnt_tickets_cat")


def r_tickets_bucket_stats(st: Study) -> DataFrame:
    return buckets.tickets_bucket_stats(st.segments)


def r_tickets_bucket_return(st: Study) -> DataFrame:
    return buckets.tickets_bucket_return(st.segments)


def r_weekday_return(st: Study) -> DataFrame:
    return buckets.weekday_return(st.segments)


def r_gap_by_loyalty(st: Study) -> DataFrame:
    return buckets.gap_by_loyalty(st.segments)


def r_order_bucket_counts(st: Study) -> DataFrame:
    return buckets.order_bucket_counts(st.segments)


def r_bucket_values(st: Study) -> DataFrame:
    return buckets.bucket_values(st.segments)


def r_unbucketed_users(st: Study) -> DataFrame:
    return buckets.unbucketed_users(st.segments)


def r_segment_cube(st: Study) -> DataFrame:
    mean = round_half_even(F.try_divide(F.col("gap_sum"), F.col("gap_cnt")), 6).alias("mean_gap_d")
    return segments.segment_cube(st.profile_f).select("segment", "value", "users_cnt", "returners_cnt", "five_cnt", mean)


# --- distributions --------------------------------------------------------------------------

def r_tickets_histogram(st: Study) -> DataFrame:
    return describe.histogram(st.fx_core, "tickets_count", 100)


def r_revenue_box(st: Study) -> DataFrame:
    return describe.box_stats(st.fx_core, "revenue_rub")


def r_revenue_histogram(st: Study) -> DataFrame:
    return describe.revenue_histogram(st.profile_f)


def r_revenue_histogram_shared(st: Study) -> DataFrame:
    return describe.revenue_histogram(st.profile_f, shared_bins=True, density=True)


# --- phi_k ----------------------------------------------------------------------------------

def r_phik_contingency(st: Study) -> DataFrame:
    p = _phik_frame(st)
    return phik.contingency(phik.binned_columns(p, PHIK_K1_COLUMNS, PHIK_K1_BINS), PHIK_K1_COLUMNS)


def r_phik_chi2(st: Study) -> DataFrame:
    p = _phik_frame(st)
    cells = phik.contingency(phik.binned_columns(p, PHIK_K1_COLUMNS, PHIK_K1_BINS), PHIK_K1_COLUMNS)
    return phik.pair_chi2(cells)


def r_phik_chi2_default(st: Study) -> DataFrame:
    p = _phik_frame(st)
    cells = phik.contingency(phik.binned_columns(p, PHIK_K2_COLUMNS), PHIK_K2_COLUMNS)
    return phik.pair_chi2(cells)


def r_phik_matrix(st: Study) -> DataFrame:
    return phik.phik_matrix(_phik_frame(st), PHIK_K1_COLUMNS, PHIK_K1_BINS)


def r_phik_matrix_default(st: Study) -> DataFrame:
    return phik.phik_matrix(_phik_frame(st), PHIK_K2_COLUMNS)


def r_phik_target(st: Study) -> DataFrame:
    return r_phik_matrix(st).where(F.col("var_y") == "total_orders_cnt") \
                                   .select(F.col("var_x").alias("variable"), "phik")


# --- data quality (brief) -------------------------------------------------------------------

def r_null_profile(st: Study) -> DataFrame:
    return quality.null_profile(st.purchases_rub)


def r_category_profile(st: Study) -> DataFrame:
    return quality.category_profile(st.fx_core,
                                    ["device_type_canonical", "currency_code", "event_type_main",
                                     "service_name", "region_name"])


def r_duplicate_orders(st: Study) -> DataFrame:
    return quality.duplicate_rows(st.fx_core, ["order_id"])


def r_duplicate_region_days(st: Study) -> DataFrame:
    return quality.duplicate_rows(st.fx_core, ["region_name", "order_dt"])


def r_duplicate_purchases(st: Study) -> DataFrame:
    """Whole purchases that occur twice, in all purchases and every tenth of them once more."""
    return quality.duplicate_rows(st.fx_core.unionByName(st.fx_core.where("order_id % 10 = 0")))


#: columns, values a column, and share of the rows that a frequent value exceeds
FREQUENT_COLUMNS = ["device_type_canonical", "currency_code", "event_type_main", "service_name", "region_name", "event_name"]
FREQUENT_VALUES, FREQUENT_SHARE = 10, 0.001


def r_frequent_values(st: Study) -> DataFrame:
    return quality.frequent_values(st.fx_core, FREQUENT_COLUMNS, FREQUENT_VALUES, FREQUENT_SHARE)


REPORTS: dict[str, Report] = {
    "extract_purchases": r_extract_purchases,
    "table_overview": r_table_overview,
    "typed_purchases": r_typed_purchases,
    "fx_normalise": r_fx_normalise,
    "fx_from_rates_csv": r_fx_from_rates_csv,
    "outlier_cut": r_outlier_cut,
    "outlier_volume": r_outlier_volume,
    "outlier_volume_95": r_outlier_volume_95,
    "user_count": r_user_count,
    "monthly_users": r_monthly_users,
    "days_since_prev": r_days_since_prev,
    "customer_profile": r_customer_profile,
    "profile_from_store": r_profile_from_store,
    "first_order_attrs": r_first_order_attrs,
    "order_gap_mean": r_order_gap_mean,
    "events_gap_stats": r_events_gap_stats,
    "profile_summary": r_profile_summary,
    "describe_orders": r_describe_orders,
    "describe_profile": r_describe_profile,
    "profile_outlier_cut": r_profile_outlier_cut,
    "profile_outlier_volume": r_profile_outlier_volume,
    "customer_lifetime": r_customer_lifetime,
    **{f"segment_share_{k}": _share(v) for k, v in SEGMENTS.items()},
    "segment_share_region_top": r_segment_share_region_top,
    "segment_share_service_top": r_segment_share_service_top,
    **{f"segment_return_{k}": _ret(v) for k, v in SEGMENTS.items()},
    **{f"chart_return_{k}": _chart(v) for k, v in SEGMENTS.items()},
    "segment_return_region_min": r_segment_return_region_min,
    "segment_return_region_top": r_segment_return_region_top,
    "region_top10": r_region_top10,
    "region_tail_mean": r_region_tail_mean,
    "service_top": r_service_top,
    "service_top_mean": r_service_top_mean,
    "service_top_by_users": r_service_top_by_users,
    "segment_lift": r_segment_lift,
    "segment_compare": r_segment_compare,
    "tickets_bucket": r_tickets_bucket,
    "tickets_bucket_stats": r_tickets_bucket_stats,
    "tickets_bucket_return": r_tickets_bucket_return,
    "weekday_return": r_weekday_return,
    "gap_by_loyalty": r_gap_by_loyalty,
    "order_bucket_counts": r_order_bucket_counts,
    "bucket_values": r_bucket_values,
    "unbucketed_users": r_unbucketed_users,
    "segment_cube": r_segment_cube,
    "tickets_histogram": r_tickets_histogram,
    "revenue_box": r_revenue_box,
    "revenue_histogram": r_revenue_histogram,
    "revenue_histogram_shared": r_revenue_histogram_shared,
    "phik_contingency": r_phik_contingency,
    "phik_chi2": r_phik_chi2,
    "phik_chi2_default": r_phik_chi2_default,
    "phik_matrix": r_phik_matrix,
    "phik_matrix_default": r_phik_matrix_default,
    "phik_target": r_phik_target,
    "null_profile": r_null_profile,
    "category_profile": r_category_profile,
    "duplicate_orders": r_duplicate_orders,
    "duplicate_region_days": r_duplicate_region_days,
    "duplicate_purchases": r_duplicate_purchases,
    "frequent_values": r_frequent_values,
}


#: reports that read a raw table of the study's folder beside its purchases
FILE_REPORTS = {"events_gap_stats"}


def _bind(report: Report) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(_study(spark, sf_dir))
    run.__name__ = getattr(report, "__name__", "report")
    return run


# One query per report, each building its own study from the raw tables.
QUERIES: dict[str, Query] = {name: _bind(fn) for name, fn in REPORTS.items()}
