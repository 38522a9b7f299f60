"""Segment reports over profiles.

Every report is one aggregate over the profile (one row per user), so the
shuffle carries at most one partial row per segment and map task. Shares
need the total user count: it comes from a scalar subquery (one more small
aggregate), never from a driver round trip.

Reports over the same profile can share one scan: :func:`segment_cube` counts
all segment keys by grouping sets, and every report takes its counts from a
``CubeCounts`` as well as from the profile itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import left_closed_bucket, round_half_even, weekday_monday0

#: the segment keys of the reports; the last six are derived from the profile
CUBE_KEYS = {
    "first_event_type": "string", "first_order_device": "string", "first_order_region": "string",
    "first_service_name": "string", "day_of_week": "int", "cnt_tickets_cat": "string",
    "cnt_tickets_cat_v2": "string", "loyalty": "boolean", "total_orders_cnt": "bigint", "all_users": "boolean",
}


def with_segment_keys(profile: DataFrame) -> DataFrame:
    """The profile with weekday, ticket and order bucket of each user (C3, C6, C7), and among users
    with 2+ orders whether they have 5+ (``loyalty``)."""
    return profile.withColumns({
        "day_of_week": weekday_monday0("min_order_ts"),
        "cnt_tickets_cat": left_closed_bucket("avg_cnt_per_order", schemas.TICKET_BUCKET_EDGES, schemas.TICKET_BUCKET_LABELS),
        "cnt_tickets_cat_v2": left_closed_bucket("total_orders_cnt", schemas.ORDER_BUCKET_EDGES, schemas.ORDER_BUCKET_LABELS),
        "loyalty": F.when(F.col("is_two"), F.col("is_five")),
        "all_users": F.lit(True),
    })


def _measures() -> list[Column]:
    return [F.count("user_id").alias("users_cnt"), F.count_if(F.col("is_two")).alias("returners_cnt"),
            F.count_if(F.col("is_five")).alias("five_cnt"), F.sum("date_difference_d").alias("gap_sum"),
            F.count("date_difference_d").alias("gap_cnt")]


def segment_cube(profile: DataFrame, keys: tuple[str, ...] = tuple(CUBE_KEYS)) -> DataFrame:
    """``segment, value, users_cnt, returners_cnt, five_cnt, gap_sum, gap_cnt`` for every value of every key.

    One scan and one exchange by grouping sets, a row per (key, value); a null
    value is the users without that key. ``all_users`` is the whole profile.
    """
    keyed = with_segment_keys(profile)
    # grouped copies: a measure over a column that is also a key would see the emptied key
    named = keyed.select("user_id", "is_two", "is_five", "date_difference_d",
                         *[F.col(k).cast("string").alias(f"k_{k}") for k in keys])
    cols = [F.col(f"k_{k}") for k in keys]
    segment = F.coalesce(*[F.when(F.grouping(f"k_{k}") == 0, F.lit(k)) for k in keys])
    grouped = named.groupingSets([[c] for c in cols], *cols).agg(segment.alias("segment"), *_measures())
    value = F.coalesce(*[F.when(F.col("segment") == k, F.col(f"k_{k}")) for k in keys])
    return grouped.select("segment", value.alias("value"), "users_cnt", "returners_cnt", "five_cnt", "gap_sum", "gap_cnt")


class ProfileCounts:
    """Counts per segment by an aggregate over the profile each."""

    def __init__(self, profile: DataFrame):
        self.profile = profile
        self.spark = profile.sparkSession

    def by(self, key: str) -> DataFrame:
        """``key`` and the measures of :func:`segment_cube` per non-null value (Q16)."""
        return with_segment_keys(self.profile).where(F.col(key).isNotNull()).groupBy(key).agg(*_measures())

    def total(self, measure: str) -> Column:
        """A measure over all users, as a scalar."""
        return self.profile.agg(*_measures()).select(measure).scalar()


class CubeCounts(ProfileCounts):
    """The same counts read from a (stored) segment cube."""

    def __init__(self, cube: DataFrame):
        self.cube = cube
        self.spark = cube.sparkSession

    def by(self, key: str) -> DataFrame:
        rows = self.cube.where((F.col("segment") == key) & F.col("value").isNotNull())
        return rows.withColumn(key, F.col("value").cast(CUBE_KEYS[key])).drop("segment", "value")

    def total(self, measure: str) -> Column:
        return self.cube.where("segment = 'all_users'").agg(F.coalesce(F.max(measure), F.lit(0)).alias(measure)).scalar()


Counted = DataFrame | ProfileCounts


def counts_of(source: Counted) -> ProfileCounts:
    """Counts of a profile, or the counts given."""
    return ProfileCounts(source) if isinstance(source, DataFrame) else source


def profile_summary(profile: DataFrame, resolution: int = 1) -> DataFrame:
    """Users, mean of per-user average revenue (1 dp), and the share of users
    with 2+ and 5+ orders (R1, A8). The shares are rounded as a fraction to
    ``resolution`` digits and then multiplied by 100, as the study does (Q9);
    ``mean_user_avg_revenue`` is a mean of user means (Q18)."""
    agg = profile.agg(
        F.count("user_id").alias("total_users_cnt"),
        F.avg("avg_revenue_rub").alias("__mean_rev"),
        F.count_if(F.col("is_two")).alias("__two"),
        F.count_if(F.col("is_five")).alias("__five"),
    )
    share = lambda c: round_half_even(F.try_divide(F.col(c).cast("double"), F.col("total_users_cnt")),
                                      resolution) * F.lit(100.0)
    return agg.select(
        F.col("total_users_cnt").cast("long"),
        round_half_even("__mean_rev", 1).alias("mean_user_avg_revenue"),
        share("__two").alias("share_2_plus_orders"),
        share("__five").alias("share_5_plus_orders"),
    )


def segment_share(profile: Counted, key: str, ordered: bool = True) -> DataFrame:
    """Users per segment and their share of all users in % (R2, A11), largest
    segment first with the key as tiebreak (O2, Q12).

    Users whose segment is null are not a segment (Q16) but count in the
    denominator, as in the study.
    """
    counts = counts_of(profile)
    share = F.col("users_cnt").cast("double") / counts.total("users_cnt") * F.lit(100.0)
    rep = counts.by(key).select(key, F.col("users_cnt").cast("long"), share.alias("share"))
    return rep.orderBy(F.col("users_cnt").desc(), F.col(key).asc()) if ordered else rep


#: flags of the profile and the measure that counts them
_FLAGS = {"is_two": "returners_cnt", "is_five": "five_cnt"}


def segment_return(profile: Counted, key: str, flag: str = "is_two",
                   include_zero: bool = False, min_users: int = 0,
                   sort_by: str | None = "key") -> DataFrame:
    """Per segment: users with ``flag`` (returners), all users, and the
    returners' share in % rounded half-even to 2 dp (R3, A12, J5).

    The study drops segments without any returner (Q10); ``include_zero``
    keeps them with 0. ``min_users`` hides segments smaller than that (B5).
    ``sort_by`` orders the report descending by ``"key"``, ``"users_cnt"`` or
    ``"is_two_share"`` (key as tiebreak; O2), or not at all with ``None``.
    """
    rep = counts_of(profile).by(key).select(key, F.col(_FLAGS[flag]).alias("returners_cnt"), "users_cnt")
    if not include_zero:
        rep = rep.where(F.col("returners_cnt") > 0)
    if min_users:
        rep = rep.where(F.col("users_cnt") >= min_users)
    rep = rep.select(
        key, F.col("returners_cnt").cast("long"), F.col("users_cnt").cast("long"),
        round_half_even(F.col("returners_cnt").cast("double") / F.col("users_cnt") * F.lit(100.0), 2)
         .alias("is_two_share"),
    )
    if sort_by is None:
        return rep
    if sort_by == "key":
        return rep.orderBy(F.col(key).desc())
    return rep.orderBy(F.col(sort_by).desc(), F.col(key).asc())


def chart_frame(report: DataFrame, key: str, value: str = "is_two_share") -> DataFrame:
    """The two columns a bar chart of a report needs, ascending by value (O3, H4)."""
    return report.select(key, value).orderBy(F.col(value).asc(), F.col(key).asc())


def top_segments(report: DataFrame, key: str, by: str, n: int, ascending: bool = False) -> DataFrame:
    """The first ``n`` segments by ``by`` with the segment key as tiebreak.

    Planned as TakeOrderedAndProject: each task keeps its own top n, so only
    n rows per task reach the final merge.
    """
    order = F.col(by).asc() if ascending else F.col(by).desc()
    tiebreak = F.col(key).desc() if ascending else F.col(key).asc()
    return report.orderBy(order, tiebreak).limit(n)


def tail_segments(report: DataFrame, key: str, by: str, n: int) -> DataFrame:
    """The last ``n`` rows of the report sorted by ``by`` descending."""
    return top_segments(report, key, by, n, ascending=True)


def mean_of(df: DataFrame, column: str, alias: str, digits: int = 6) -> DataFrame:
    """Unweighted mean of a column of a (small) report."""
    return df.agg(round_half_even(F.avg(column), digits).alias(alias))


def segment_lift(profile: Counted, key: str, flag: str = "is_two") -> DataFrame:
    """Segment return rate minus the overall rate, in percentage points."""
    counts = counts_of(profile)
    overall = F.try_divide(counts.total(_FLAGS[flag]).cast("double"), counts.total("users_cnt")) * F.lit(100.0)
    rep = segment_return(counts, key, flag, include_zero=True)
    rate = F.col("returners_cnt").cast("double") / F.col("users_cnt") * F.lit(100.0)
    return rep.select(key, "returners_cnt", "users_cnt",
                      round_half_even(rate, 6).alias("return_rate"),
                      round_half_even(overall, 6).alias("overall_rate"),
                      round_half_even(rate - overall, 6).alias("lift_pp"))


def segment_compare(profile: Counted, key: str, a: str, b: str, flag: str = "is_two") -> DataFrame:
    """Return rates of two segments and their difference in points."""
    rates = counts_of(profile).by(key).where(F.col(key).isin(a, b)).select(
        key, F.col(_FLAGS[flag]).alias("r"), F.col("users_cnt").alias("n"))
    pick = lambda seg, c: F.max(F.when(F.col(key) == seg, F.col(c)))
    one = rates.agg(pick(a, "r").alias("ra"), pick(a, "n").alias("na"),
                    pick(b, "r").alias("rb"), pick(b, "n").alias("nb"))
    ra = F.col("ra").cast("double") / F.col("na") * F.lit(100.0)
    rb = F.col("rb").cast("double") / F.col("nb") * F.lit(100.0)
    return one.select(
        F.lit(a).alias("segment_a"), F.lit(b).alias("segment_b"),
        F.col("na").cast("long").alias("users_a"), F.col("nb").cast("long").alias("users_b"),
        round_half_even(ra, 6).alias("rate_a"), round_half_even(rb, 6).alias("rate_b"),
        round_half_even(ra - rb, 6).alias("diff_pp"),
    )
