"""The skew-safe gap operators agree with a plain window, also when one key
holds a third of all rows."""

from __future__ import annotations

import datetime as dt

from conftest import SF_MID
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators.sequence import gap_stats, neighbor_time


def skewed_events(spark):
    ev = spark.read.parquet(f"{SF_MID}/events.parquet").select("user_id", "ts", "event_id")
    # one user receives every third event (a third of all rows)
    return ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1))
                                    .otherwise(F.col("user_id")))


def plain(df, direction):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fn = F.lead if direction == "next" else F.lag
    return df.withColumn("nb", F.when(F.col("user_id").isNotNull(), fn("ts").over(w)))


def check(df, direction):
    for grain in ("hour", "day"):
        a, b = neighbor_time(df, "user_id", "ts", "event_id", direction, "nb", grain), plain(df, direction)
        assert a.columns == b.columns
        assert a.count() == b.count() == df.count()
        assert a.exceptAll(b).isEmpty()


def test_neighbor_time_matches_window(spark):
    for direction in ("next", "prev"):
        check(skewed_events(spark), direction)


def test_neighbor_time_with_many_rows_at_one_time(spark):
    ev = skewed_events(spark).withColumn("ts", F.date_trunc("day", "ts"))
    for direction in ("next", "prev"):
        check(ev, direction)


def test_null_keys_and_times(spark):
    t = dt.datetime(2024, 1, 1, 10, 30)
    rows = [(1, t, 1), (1, t, 2), (1, t + dt.timedelta(hours=30), 3), (None, t, 4), (None, t, 5), (2, t, 6)]
    df = spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz, event_id bigint")
    for direction in ("next", "prev"):
        check(df, direction)
    timeless = df.unionByName(spark.createDataFrame([(1, None, 7), (3, None, 8)], df.schema))
    got = {r.event_id: r.nb for r in neighbor_time(timeless, "user_id", "ts", "event_id", "prev", "nb").collect()}
    assert got[7] is None and got[8] is None and got[1] is None and got[2] == t and got[3] == t
    stats = {r.user_id: (r.gap_sum, r.gap_cnt) for r in gap_stats(timeless, "user_id", "ts").collect()}
    assert stats == {1: (1, 2), 2: (0, 0), 3: (0, 0)}
    assert neighbor_time(df.limit(0), "user_id", "ts", "event_id").count() == 0
    assert gap_stats(df.limit(0), "user_id", "ts").count() == 0


def test_gap_stats_matches_window(spark):
    ev = skewed_events(spark)
    for df in (ev, ev.withColumn("ts", F.date_trunc("day", "ts"))):
        got = {r.user_id: (r.gap_sum, r.gap_cnt) for r in gap_stats(df, "user_id", "ts").collect()}
        exp = {r.user_id: (r.s or 0, r.c) for r in
               plain(df, "next").groupBy("user_id")
               .agg(F.sum(F.extract(F.lit("DAY"), F.col("nb") - F.col("ts"))).alias("s"),
                    F.count("nb").alias("c")).collect()}
        assert got == exp
        assert got[-1][1] == ev.where("user_id = -1").count() - 1


def test_day_keys_take_fewer_exchanges(spark):
    days = skewed_events(spark).withColumn("ts", F.date_trunc("day", "ts"))
    plans = [neighbor_time(days, "user_id", "ts", "event_id", "prev", "nb", grain)._jdf.queryExecution().executedPlan()
             .toString().count("Exchange hashpartitioning") for grain in ("hour", "day")]
    assert plans[1] < plans[0]


def test_rows_without_a_key_are_spread(spark):
    """A third of the rows has no user: no task of the join gets many of them."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ev = skewed_events(spark).withColumn("user_id", F.when(F.col("user_id") >= 0, F.col("user_id")))
        ev = ev.withColumn("ts", F.when(F.col("event_id") % 2 == 0, F.date_trunc("year", "ts")).otherwise(F.date_trunc("day", "ts")))
        out = neighbor_time(ev, "user_id", "ts", "event_id", "prev", "nb", "day")
        sizes = [r.n for r in out.groupBy(F.spark_partition_id())
                 .agg(F.count_if(F.col("user_id").isNull()).alias("n"), F.count("nb")).collect()]
        nulls = ev.where("user_id is null").count()
        assert nulls > ev.count() / 4 and sum(sizes) == nulls and max(sizes) < 2 * nulls / 8
        check(ev, "prev")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
