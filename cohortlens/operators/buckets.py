"""Buckets and retention reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import left_closed_bucket, round_half_even, weekday_monday0
from .segments import Counted, ProfileCounts, counts_of


def with_ticket_bucket(profile: DataFrame, edges: Sequence[float] = tuple(schemas.TICKET_BUCKET_EDGES),
                       labels: Sequence[str] = tuple(schemas.TICKET_BUCKET_LABELS),
                       open_top: bool = False, out: str = "cnt_tickets_cat") -> DataFrame:
    """Average tickets per order cut into left-closed bins (C6); 12+ gets no
    label unless ``open_top`` (Q7)."""
    return profile.withColumn(out, left_closed_bucket("avg_cnt_per_order", edges, labels, open_top))


def with_order_bucket(profile: DataFrame, edges: Sequence[float] = tuple(schemas.ORDER_BUCKET_EDGES),
                      labels: Sequence[str] = tuple(schemas.ORDER_BUCKET_LABELS),
                      open_top: bool = False, out: str = "cnt_tickets_cat_v2") -> DataFrame:
    """Order count cut into ``1 / 2-4 / 5+``."""
    return profile.withColumn(out, left_closed_bucket("total_orders_cnt", edges, labels, open_top))


def with_weekday(profile: DataFrame, ts: str = "min_order_ts", out: str = "day_of_week") -> DataFrame:
    """Weekday of the first order, Monday = 0."""
    return profile.withColumn(out, weekday_monday0(ts))


def _labelled(counts: ProfileCounts, bucket: str, labels: Sequence[str]) -> DataFrame:
    """Counts of every label (0 for empty buckets, Q11) with its place."""
    dim = schemas.label_dimension(counts.spark, bucket, labels)  # tiny and fixed
    zero = [F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in ("users_cnt", "returners_cnt")]
    return dim.join(counts.by(bucket), on=bucket, how="left").select(bucket, f"{bucket}_ord", *zero)


def tickets_bucket_stats(profile_f: Counted, share_digits: int = 2) -> DataFrame:
    """Ticket buckets: count of users, and the share of *all* users,
    unbucketed ones included (Q17), as a fraction rounded half-even to
    ``share_digits`` and times 100 (R5)."""
    counts = counts_of(profile_f)
    bucket = "cnt_tickets_cat"
    share = round_half_even(F.try_divide(F.col("users_cnt").cast("double"), counts.total("users_cnt")), share_digits)
    return (_labelled(counts, bucket, schemas.TICKET_BUCKET_LABELS).orderBy(f"{bucket}_ord")
            .select(bucket, (share * F.lit(100.0)).alias("share"), F.col("users_cnt").alias("cnt")))


def order_bucket_counts(profile_f: Counted) -> DataFrame:
    """Users per order-count bucket ``1 / 2-4 / 5+``."""
    bucket = "cnt_tickets_cat_v2"
    return (_labelled(counts_of(profile_f), bucket, schemas.ORDER_BUCKET_LABELS).orderBy(f"{bucket}_ord")
            .select(bucket, F.col("users_cnt").alias("cnt")))


def bucket_values(profile_f: Counted, label: str = "5+") -> DataFrame:
    """Distinct order counts that fall into one order bucket, ascending."""
    values = with_order_bucket(counts_of(profile_f).by("total_orders_cnt"))
    return (values.where(F.col("cnt_tickets_cat_v2") == label)
            .select("total_orders_cnt").orderBy("total_orders_cnt"))


def unbucketed_users(profile_f: Counted) -> DataFrame:
    """Users in all and those that the finite bins leave without a ticket or an order bucket (Q7)."""
    counts = counts_of(profile_f)
    row = [counts.total("users_cnt").cast("long").alias("users_cnt")]
    for bucket, name in (("cnt_tickets_cat", "no_ticket_bucket"), ("cnt_tickets_cat_v2", "no_order_bucket")):
        inside = counts.by(bucket).agg(F.coalesce(F.sum("users_cnt"), F.lit(0)).alias("n")).scalar()
        row.append((counts.total("users_cnt") - inside).cast("long").alias(name))
    return counts.spark.range(1).select(*row)


def weekday_return(profile_f: Counted) -> DataFrame:
    """Users per first-order weekday and the share of them with 2+ orders in %
    (2 dp); null for a weekday without any returner, as in the study (R6, Q10).
    Users without a first time have no weekday and no row."""
    share = round_half_even(F.col("returners_cnt").cast("double") / F.col("users_cnt") * F.lit(100.0), 2)
    return counts_of(profile_f).by("day_of_week").select(
        "day_of_week", F.col("users_cnt").cast("long").alias("cnt"),
        F.when(F.col("returners_cnt") > 0, share).alias("share")).orderBy("day_of_week")


def gap_by_loyalty(profile_f: Counted) -> DataFrame:
    """Mean of the users' mean order gap among users with 2+ orders, split by
    5+ orders (R7)."""
    return counts_of(profile_f).by("loyalty").select(
        F.col("loyalty").alias("is_five"),
        round_half_even(F.try_divide(F.col("gap_sum"), F.col("gap_cnt")), 6).alias("mean_gap_d"),
        F.col("users_cnt").cast("long").alias("users_cnt")).orderBy("is_five")


def tickets_bucket_return(profile_f: Counted) -> DataFrame:
    """Return rate (share with 2+ orders, %) per ticket bucket."""
    bucket = "cnt_tickets_cat"
    rate = round_half_even(F.col("returners_cnt").cast("double") / F.col("users_cnt") * F.lit(100.0), 2)
    return (_labelled(counts_of(profile_f), bucket, schemas.TICKET_BUCKET_LABELS).orderBy(f"{bucket}_ord")
            .select(bucket, "users_cnt", "returners_cnt", F.when(F.col("users_cnt") > 0, rate).alias("is_two_share")))
