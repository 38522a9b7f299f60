"""Distribution summaries (A10, H1-H3, B7): the data behind each chart.

Descriptive and box statistics read the wanted columns as stored doubles
(:func:`.quantile.stored_columns`), so what lies below runs once; histograms are
one min/max aggregate (read through a scalar subquery or a per-group join of
a tiny frame) plus one grouped count. Empty bins are listed with 0 by
joining a generated bin index (n rows per group) - no row-level data leaves
the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import add_equal_width_bin, bin_edge, round_half_even
from .quantile import exact_quantiles, stored_columns

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


QUARTILES = (0.25, 0.5, 0.75)


def quartiles(numbers: DataFrame, cols: list[str]) -> dict[str, Column]:
    """Exact quartiles per stored column as an array of literals, all columns in the same passes."""
    found = exact_quantiles(numbers, [(c, q) for c in cols for q in QUARTILES], stored=True)
    return {c: F.array(*[F.lit(found[(c, q)]).cast("double") for q in QUARTILES]) for c in cols}


def describe(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """count, mean, sample std, min, exact 25/50/75 % (linear interpolation)
    and max per numeric column, one row per column (A10). Unlike
    ``DataFrame.summary`` the percentiles are exact and come from
    bounded passes shared by all columns (``exact_quantiles``)."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    numbers = stored_columns(df, cols)
    qexpr = quartiles(numbers, cols)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"),
                 F.first(qexpr[c]).alias(f"q{i}"),
                 F.max(x).alias(f"hi{i}")]
    one = numbers.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").cast("long").alias("count"),
                 F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                 F.col(f"lo{i}").alias("min"), F.col(f"q{i}")[0].alias("p25"),
                 F.col(f"q{i}")[1].alias("p50"), F.col(f"q{i}")[2].alias("p75"),
                 F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(cols)])
    long = one.select(F.inline(rows))
    return long.select("column_name", "count",
                       *[round_half_even(c, digits).alias(c)
                         for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


def histogram(df: DataFrame, column: str, bins: int, group: str | None = None,
              shared_bins: bool = False, density: bool = False, digits: int = 6,
              groups_bounded: bool = False) -> DataFrame:
    """Equal-width histogram of ``column`` with ``bins`` bins over [min, max]
    (last bin closed), per ``group`` if given (H1, H3).

    Each group gets its own edges unless ``shared_bins`` (B7); ``density``
    adds count / (group total x bin width). A constant column gives one bin.
    Output: [group,] bin (0-based), bin_lo, bin_hi, cnt [, density].

    ``groups_bounded=True`` states that the group column takes a small fixed
    set of values (e.g. the four loyalty groups): the per-group bounds are
    then broadcast. Otherwise the planner / AQE picks the join by size.
    """
    x = F.col(column).cast("double")
    data = df.where(x.isNotNull())
    keys = [group] if group else []
    if keys and not shared_bins:
        bounds = data.groupBy(*keys).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"),
                                         F.count(x).alias("__n"))
        # one row per group: joined on the group key (small side, planner broadcasts by size)
        side = bounds.select(*keys, "__lo", "__hi")
        binned = data.join(F.broadcast(side) if groups_bounded else side, on=keys)
    else:
        allb = data.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
        lo, hi = allb.select("lo").scalar(), allb.select("hi").scalar()
        binned = data.withColumn("__lo", lo).withColumn("__hi", hi)
        bounds = (data.groupBy(*keys).agg(F.count(x).alias("__n"))
                      .withColumn("__lo", lo).withColumn("__hi", hi))
    counts = (add_equal_width_bin(binned, x, "__lo", "__hi", bins, "bin")
                    .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("cnt")))
    nbins = F.when(F.col("__hi") == F.col("__lo"), F.lit(1)).otherwise(F.lit(bins))
    grid = bounds.select(*keys, "__lo", "__hi", "__n",
                         F.explode(F.sequence(F.lit(0), nbins - 1)).alias("bin"))
    out = grid.join(counts, on=[*keys, "bin"], how="left")
    lo_e = bin_edge("__lo", "__hi", bins, F.col("bin"))
    hi_e = F.when(F.col("bin") == nbins - 1, F.col("__hi")) \
            .otherwise(bin_edge("__lo", "__hi", bins, F.col("bin") + 1))
    cnt = F.coalesce(F.col("cnt"), F.lit(0)).cast("long")
    cols = [*keys, F.col("bin").cast("int").alias("bin"),
            round_half_even(lo_e, digits).alias("bin_lo"),
            round_half_even(hi_e, digits).alias("bin_hi"), cnt.alias("cnt")]
    if density:
        width = F.when(hi_e > lo_e, hi_e - lo_e).otherwise(F.lit(1.0))
        cols.append(round_half_even(F.try_divide(cnt.cast("double"), F.col("__n") * width), 12).alias("density"))
    return out.select(*cols)


# The four loyalty groups of the revenue histograms (H3).
LOYALTY_GROUPS = {
    "2_plus": "is_two",
    "1": "NOT is_two",
    "2_4": "is_two AND NOT is_five",
    "5_plus": "is_five",
}


def loyalty_groups(profile: DataFrame, out: str = "grp") -> DataFrame:
    """Rows repeated once per loyalty group they belong to (groups overlap)."""
    labels = F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in LOYALTY_GROUPS.items()])
    return (profile.withColumn(out, F.explode(labels)).where(F.col(out).isNotNull()))


def revenue_histogram(profile_f: DataFrame, bins: int = 70, shared_bins: bool = False,
                      density: bool = False) -> DataFrame:
    """70-bin histograms of average revenue for the four loyalty groups (H3)."""
    g = loyalty_groups(profile_f.select("user_id", "avg_revenue_rub", "is_two", "is_five"))
    return histogram(g, "avg_revenue_rub", bins, group="grp", shared_bins=shared_bins,
                     density=density, groups_bounded=True)


def box_stats(df: DataFrame, column: str, whisker: float = 1.5, digits: int = 6) -> DataFrame:
    """Box-plot numbers (H2): quartiles (exact, linear), whiskers at the most
    extreme points within ``whisker`` x IQR of the box, and outlier counts."""
    x = F.col(column)
    data = stored_columns(df, [column])
    qs = quartiles(data, [column])[column]
    q1, med, q3 = qs[0], qs[1], qs[2]
    iqr = q3 - q1
    lo_f, hi_f = q1 - F.lit(whisker) * iqr, q3 + F.lit(whisker) * iqr
    res = data.agg(
        F.count(x).alias("n"),
        F.min(F.when(x >= lo_f, x)).alias("whisker_lo"),
        F.max(F.when(x <= hi_f, x)).alias("whisker_hi"),
        F.count_if(x < lo_f).alias("outliers_low"),
        F.count_if(x > hi_f).alias("outliers_high"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )
    return res.select(
        F.col("n").cast("long"),
        *[round_half_even(c, digits).alias(a) for c, a in
          [(q1, "q1"), (med, "median"), (q3, "q3"), (iqr, "iqr")]],
        round_half_even("whisker_lo", digits).alias("whisker_lo"),
        round_half_even("whisker_hi", digits).alias("whisker_hi"),
        F.col("outliers_low").cast("long"), F.col("outliers_high").cast("long"),
        round_half_even("min", digits).alias("min"), round_half_even("max", digits).alias("max"),
    )
