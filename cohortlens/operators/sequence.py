"""Time of the previous / next row of the same key, and the gaps between them.

``Window.partitionBy(key)`` puts every row of one key into one task, so a key
holding a third of the data would be processed by a single core. Here the
built-in windows run in three steps, none of which gathers a key:

1. rows of one ``(key, time)`` are aggregated (map-side first), since rows at
   one time are 0 apart;
2. a window over ``(key, hour)`` finds the neighbouring time inside the hour:
   at most the distinct times of one key in one hour;
3. one row per ``(key, hour)`` with its first and last time goes to a window
   over ``key``, which joins the hours up: at most the hours of the calendar
   (about 9,000 a year), however many rows a key has.

Where the times are whole days, the aggregated times of a key are few already
(about 366 a year); ``grain="day"`` then leaves the hours out and takes one
window over the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import whole_days

_BUCKET, _COUNT, _GAP = "__seq_hour", "__seq_n", "__seq_gap"


#: parts into which rows without a key or time are dealt for the join back
_KEYLESS_PARTS = 1024


def neighbor_time(df: DataFrame, key: str, ts: str, tiebreak: str, direction: str = "next",
                  out: str | None = None, grain: str = "hour") -> DataFrame:
    """Add ``out``: ``ts`` of the next (or previous) row with the same ``key`` in
    ``(ts, tiebreak)`` order; null for the last (first) row of a key.

    ``(ts, tiebreak)`` must be unique within a key and ``tiebreak`` not null.
    Rows with a null key or time are kept and have no neighbour; they are dealt
    evenly over the tasks of the join. ``grain="day"`` says that the times are
    whole days; any other time then still gives the same rows, only its
    window holds all distinct times of a key.
    """
    if direction not in ("next", "prev"):
        raise ValueError("direction must be 'next' or 'prev'")
    if grain not in ("hour", "day"):
        raise ValueError("grain must be 'hour' or 'day'")
    ahead = direction == "next"
    out = out or f"{direction}_{ts}"
    shift = F.lead if ahead else F.lag
    edge_id = (F.max if ahead else F.min)(tiebreak)
    edge_ts = (F.min if ahead else F.max)("__seq_ts")
    times = (df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
             .groupBy(F.col(key).alias("__seq_key"), F.col(ts).alias("__seq_ts"))
             .agg(edge_id.alias("__seq_id")))
    if grain == "day":
        by_key = Window.partitionBy("__seq_key").orderBy("__seq_ts")
        known = times.withColumn("__seq_nb", shift("__seq_ts").over(by_key))
    else:
        times = times.withColumn(_BUCKET, F.date_trunc("hour", "__seq_ts"))
        inside = Window.partitionBy("__seq_key", _BUCKET).orderBy("__seq_ts")
        across = Window.partitionBy("__seq_key").orderBy(_BUCKET)
        hours = (times.groupBy("__seq_key", _BUCKET).agg(edge_ts.alias("__seq_edge"))
                 .withColumn("__seq_beyond", shift("__seq_edge").over(across)).drop("__seq_edge"))
        known = (times.withColumn("__seq_near", shift("__seq_ts").over(inside))
                 .join(hours, ["__seq_key", _BUCKET])
                 .select("__seq_key", "__seq_ts", "__seq_id",
                         F.coalesce("__seq_near", "__seq_beyond").alias("__seq_nb")))
    # a null key or time meets nothing; its rows get parts of their own, or one task would hold them all
    keyless = F.col(key).isNull() | F.col(ts).isNull()
    dealt = df.withColumn("__seq_part", F.when(keyless, F.pmod(F.xxhash64(tiebreak), F.lit(_KEYLESS_PARTS)) + 1).otherwise(F.lit(0)))
    # always 0, but not a constant, which would be folded out of the join keys
    known = known.withColumn("__seq_here", F.pmod(F.xxhash64("__seq_key"), F.lit(1)))
    return (dealt.join(known, (dealt[key] == known["__seq_key"]) & (dealt[ts] == known["__seq_ts"])
                       & (dealt["__seq_part"] == known["__seq_here"]), "left")
            .withColumn(out, F.when(F.col(tiebreak) == F.col("__seq_id"), F.col("__seq_nb"))
                        .otherwise(F.col("__seq_ts")))
            .select(*df.columns, out))


#: name, aggregate over the rows, aggregate that merges partial results of that name
Carried = tuple[str, Column, Callable[[str], Column]]


def gap_stats(df: DataFrame, key: str, ts: str, carry: Sequence[Carried] = ()) -> DataFrame:
    """Per key: ``gap_sum`` and ``gap_cnt`` of the whole-day gaps between
    consecutive rows in time order, and the ``carry`` aggregates over the same
    rows. Null keys are left out; a row without a time has no gap."""
    merged = [merge(name).alias(name) for name, _, merge in carry]
    times = (df.where(F.col(key).isNotNull()).groupBy(key, ts)
             .agg(F.count(F.lit(1)).alias(_COUNT), *[rows.alias(name) for name, rows, _ in carry])
             .withColumn(_BUCKET, F.date_trunc("hour", F.col(ts))))
    inside = Window.partitionBy(key, _BUCKET).orderBy(ts)
    across = Window.partitionBy(key).orderBy(_BUCKET)
    hours = (times.withColumn(_GAP, whole_days(F.lag(ts).over(inside), ts).cast("long"))
             .groupBy(key, _BUCKET)
             .agg(F.sum(_GAP).alias("__seq_sum"),
                  (F.count(_GAP) + F.coalesce(F.sum(F.when(F.col(ts).isNotNull(), F.col(_COUNT) - 1)), F.lit(0)))
                  .alias("__seq_cnt"),
                  F.min(ts).alias("__seq_first"), F.max(ts).alias("__seq_last"), *merged))
    return (hours.withColumn(_GAP, whole_days(F.lag("__seq_last").over(across), "__seq_first").cast("long"))
            .groupBy(key)
            .agg((F.coalesce(F.sum("__seq_sum"), F.lit(0)) + F.coalesce(F.sum(_GAP), F.lit(0))).alias("gap_sum"),
                 (F.sum("__seq_cnt") + F.count(_GAP)).alias("gap_cnt"), *merged))
