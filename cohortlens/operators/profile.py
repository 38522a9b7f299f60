"""Customer profile (A1-A6, W2, P11, P13, B9): one row per user, one scan.

The study builds the profile with ten group-and-merge steps and a final
de-duplication. Here every column travels as a partial aggregate through the
gap operator's steps (user and time, user and hour, user), so the orders are
read once and a user holding a large share of them is never in one task.

First-order attributes are the smallest values at the earliest time. Their
values are ranked once in a small dictionary, and time and rank become one
decimal, whose ``min`` is a fixed-width buffer that a hash aggregate updates in
place (a string or struct buffer would make Spark sort all orders); the names
are looked up again per user.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import whole_days
from ..session import write_shared
from .sequence import gap_stats

#: attribute values in all that are ranked and broadcast; more take the ``min(struct)`` form
RANK_LIMIT = 100_000
_RANKS = 1_000_000  # ranks of one time lie below this


def _first(ts: str, value: str) -> Column:
    """Earliest row, known values before null ones, then by value; see :func:`first_value_min`."""
    return F.min(F.when(F.col(ts).isNotNull(), F.struct(F.col(ts), F.col(value).isNull(), F.col(value))))


def first_value_min(ts: str, value: str) -> Column:
    """Smallest non-null ``value`` among the rows with the earliest ``ts`` (A2, Q3).

    ``min(struct(ts, isNull, value))`` orders by time first, then puts non-null
    values before nulls, then by value. A user whose earliest rows all have a
    null value gets null; rows without a time are never the first.
    """
    return _first(ts, value)[value]


FIRST_ATTRS = {
    "first_order_device": "device_type_canonical",
    "first_order_region": "region_name",
    "first_service_name": "service_name",
    "first_event_type": "event_type_main",
}


def attribute_ranks(values: Mapping[str, DataFrame], limit: int = RANK_LIMIT) -> DataFrame | None:
    """``attr, value, rank`` (from 1, in string order) of the attributes' values.

    ``values`` names for each attribute a frame with a column of that name; a
    frame may hold more values than occur. The distinct values are written
    once; if there are more than ``limit``, the result is None.
    """
    frames: dict[int, tuple[DataFrame, list[str]]] = {}
    for attr, df in values.items():
        frames.setdefault(id(df), (df, []))[1].append(attr)
    cells = None
    for df, attrs in frames.values():
        pairs = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attrs])
        part = df.select(F.inline(pairs)).where("value is not null").distinct()
        cells = part if cells is None else cells.unionByName(part)
    known = write_shared(cells, "attribute-values")
    if known.count() > limit:
        return None
    return write_shared(known.withColumn("rank", F.row_number().over(Window.partitionBy("attr").orderBy("value"))),
                        "attribute-ranks")


class _Attributes:
    """First-order attributes as mergeable columns: ranked if the values are few, structs otherwise."""

    def __init__(self, df: DataFrame, ts: str, values: Mapping[str, DataFrame] | None):
        self.ts = ts
        self.ranks = attribute_ranks(values or {src: df for src in FIRST_ATTRS.values()})
        self.df = df
        if self.ranks is not None:
            for src in FIRST_ATTRS.values():
                self.df = self.df.join(self._side(src), F.col(src).cast("string") == F.col(f"__v_{src}"), "left").drop(f"__v_{src}")

    def _side(self, src: str) -> DataFrame:
        # at most RANK_LIMIT rows, counted
        return F.broadcast(self.ranks.where(F.col("attr") == src).select(F.col("value").alias(f"__v_{src}"),
                                                                         F.col("rank").alias(f"__r_{src}")))

    def aggregates(self) -> dict[str, Column]:
        if self.ranks is None:
            return {dst: _first(self.ts, src) for dst, src in FIRST_ATTRS.items()}
        micros = F.unix_micros(F.col(self.ts).cast("timestamp")).cast("decimal(19,0)")
        return {dst: F.min(micros * F.lit(_RANKS).cast("decimal(7,0)")
                           + F.coalesce(f"__r_{src}", F.lit(_RANKS - 1)).cast("decimal(7,0)")) for dst, src in FIRST_ATTRS.items()}

    def named(self, out: DataFrame) -> DataFrame:
        """The aggregates of ``out`` replaced by the values."""
        if self.ranks is None:
            return out.withColumns({dst: F.col(dst)[src].cast("string") for dst, src in FIRST_ATTRS.items()})
        for dst, src in FIRST_ATTRS.items():
            rank = F.pmod(F.col(dst), F.lit(_RANKS).cast("decimal(7,0)")).cast("int")
            out = out.withColumn(dst, rank).join(self._side(src), F.col(dst) == F.col(f"__r_{src}"), "left")
            out = out.withColumn(dst, F.col(f"__v_{src}")).drop(f"__v_{src}", f"__r_{src}")
        return out


def customer_profile(clean: DataFrame, user: str = "user_id", ts: str = "order_ts", order_id: str = "order_id",
                     values: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Profile of every user of the cleaned purchases (§2.9).

    Null users are dropped (Q16). ``avg_revenue_rub`` is the revenue sum over
    the order count, ``avg_cnt_per_order`` the mean ticket count,
    ``date_difference_d`` the mean whole-day gap between consecutive orders
    (null with one order). ``values`` are frames that hold the attributes'
    values (see :func:`attribute_ranks`), by default ``clean`` itself; a value
    that they lack counts as null.
    """
    first = _Attributes(clean, ts, values)
    carry = [
        ("min_order_ts", F.min(ts), F.min),
        ("max_order_ts", F.max(ts), F.max),
        *[(dst, rows, F.min) for dst, rows in first.aggregates().items()],
        ("total_orders_cnt", F.count(order_id), F.sum),
        ("__rev_sum", F.sum("revenue_rub"), F.sum),
        ("__tk_sum", F.sum("tickets_count"), F.sum),
        ("__tk_cnt", F.count("tickets_count"), F.sum),
    ]
    return first.named(gap_stats(first.df, user, ts, carry)).select(
        user, "min_order_ts", "max_order_ts", *FIRST_ATTRS,
        F.col("total_orders_cnt").cast("long"),
        # try_divide: null instead of an ANSI error when a user has no values
        F.try_divide(F.col("__rev_sum").cast("double"), F.col("total_orders_cnt")).alias("avg_revenue_rub"),
        F.try_divide(F.col("__tk_sum").cast("double"), F.col("__tk_cnt")).alias("avg_cnt_per_order"),
        F.try_divide(F.col("gap_sum").cast("double"), F.col("gap_cnt")).alias("date_difference_d"),
        (F.col("total_orders_cnt") >= 2).alias("is_two"),
        (F.col("total_orders_cnt") >= 5).alias("is_five"),
    )


def order_gap_mean(clean: DataFrame, user: str = "user_id", ts: str = "order_ts") -> DataFrame:
    """Per user with at least two orders: mean whole-day gap (W2 + P13 + A5)."""
    return gap_stats(clean, user, ts).where(F.col("gap_cnt") > 0).select(
        user, (F.col("gap_sum").cast("double") / F.col("gap_cnt")).alias("date_difference_d"),
        F.col("gap_cnt").cast("long").alias("gaps_cnt"))


def first_order_attrs(clean: DataFrame, user: str = "user_id", ts: str = "order_ts",
                      values: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """First-order device, region, service and genre per user (A2); ``values`` as in :func:`customer_profile`."""
    first = _Attributes(clean, ts, values)
    rows = first.df.where(F.col(user).isNotNull()).groupBy(user).agg(
        F.min(ts).alias("min_order_ts"), *[a.alias(dst) for dst, a in first.aggregates().items()])
    return first.named(rows).select(user, "min_order_ts", *FIRST_ATTRS)


def customer_lifetime(profile: DataFrame) -> DataFrame:
    """Whole days from the first to the last order per user."""
    return profile.select("user_id", "total_orders_cnt",
                          whole_days("min_order_ts", "max_order_ts").alias("lifetime_d"))


def user_count(df: DataFrame, user: str = "user_id") -> DataFrame:
    """Exact number of distinct users."""
    return df.agg(F.count_distinct(user).cast("long").alias("users_cnt"))
