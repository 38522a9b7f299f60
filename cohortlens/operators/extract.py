"""Conformed purchase extract.

The study's single SQL statement, re-expressed as DataFrame joins over the
four base tables. Dimension joins carry no broadcast hint: the planner
broadcasts a side when its measured size is under the broadcast threshold
(and AQE re-plans at runtime from actual shuffle sizes), otherwise it falls
back to a sort-merge join, with AQE splitting skewed event keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import whole_days
from .sequence import neighbor_time

# Fixed value: the genre the study leaves out (film).
STUDY_EXCLUDED_GENRE = "фильм"

EXTRACT_COLUMNS = [
    "user_id", "device_type_canonical", "order_id", "order_dt", "order_ts",
    "currency_code", "revenue", "tickets_count", "days_since_prev", "event_id",
    "event_name", "event_type_main", "service_name", "region_name", "city_name",
]


def extract_purchases(purchases: DataFrame, events: DataFrame, city: DataFrame,
                      regions: DataFrame, devices: Sequence[str] = tuple(schemas.DEVICES),
                      exclude_genre: str | None = STUDY_EXCLUDED_GENRE,
                      with_days_since_prev: bool = True) -> DataFrame:
    """purchases ⟕ events ⟕ city ⟕ regions, filtered to ``devices`` and genres
    other than ``exclude_genre``.

    The genre predicate drops purchases whose event is unknown (null is not
    ``!=`` anything), so Catalyst turns the event join into an inner join
    (Q1); city and region stay outer. ``days_since_prev`` is the whole-day
    gap to the same user's previous order day *after* the filter (W1), with
    ``order_id`` as tiebreak on equal days (Q2).
    """
    ev = events.select("event_id", "event_name_code", "event_type_main", "city_id")
    joined = (purchases
              .join(ev, on="event_id", how="left")
              .join(city.select("city_id", "city_name", "region_id"), on="city_id", how="left")
              .join(regions.select("region_id", "region_name"), on="region_id", how="left"))
    cond = F.col("device_type_canonical").isin(list(devices))
    if exclude_genre is not None:
        cond = cond & (F.col("event_type_main") != F.lit(exclude_genre))
    out = joined.where(cond).select(
        "user_id", "device_type_canonical", "order_id",
        F.col("created_dt_msk").alias("order_dt"),
        F.col("created_ts_msk").alias("order_ts"),
        "currency_code", "revenue", "tickets_count", "event_id",
        F.col("event_name_code").alias("event_name"),
        "event_type_main", "service_name", "region_name", "city_name",
    )
    if not with_days_since_prev:
        return out
    return add_days_since_prev(out)


def add_days_since_prev(df: DataFrame) -> DataFrame:
    """``days_since_prev``: whole days since the same user's previous order
    day, ``order_id`` breaking ties on one day (W1, Q2). Rows must be the
    filtered extract (the SQL window runs after WHERE); columns after it
    may have been added."""
    cols = [c for c in EXTRACT_COLUMNS if c in df.columns or c == "days_since_prev"]
    cols += [c for c in df.columns if c not in cols]
    out = neighbor_time(df, "user_id", "order_dt", "order_id", direction="prev", out="__prev_order_dt", grain="day")
    return (out.withColumn("days_since_prev", whole_days("__prev_order_dt", "order_dt"))
               .select(*cols))


# Columns cast to string by the study before analysis (P5).
STRING_COLUMNS = ["user_id", "device_type_canonical", "currency_code", "event_name",
                  "event_type_main", "service_name", "region_name", "city_name"]


def typed_purchases(df: DataFrame) -> DataFrame:
    """Explicit analysis types (P5, P6): categorical columns as strings, money
    as decimals (exact, order-independent sums; Q8), day gaps as int."""
    casts = {c: F.col(c).cast("string") for c in STRING_COLUMNS if c in df.columns}
    if "revenue" in df.columns:
        casts["revenue"] = F.col("revenue").cast("decimal(18,2)")
    if "revenue_rub" in df.columns:
        casts["revenue_rub"] = F.col("revenue_rub").cast(schemas.REVENUE_RUB_TYPE)
    if "days_since_prev" in df.columns:
        casts["days_since_prev"] = F.col("days_since_prev").cast("int")
    return df.withColumns(casts)
