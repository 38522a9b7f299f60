"""Whole-row duplicates, frequent values and mergeable user counts against brute force."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from cohortlens.operators import phik, quality, user_counts

ROWS = "a int, b string, c double, d array<int>"


def odd_rows():
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2, None]), rnd.choice(["x", "", None]), rnd.choice([0.0, 1.5, None]), rnd.choice([[1], [], None]))
            for _ in range(200)]
    return rows + [(7, "one", 1.0, [1])] + [(8, "many", 2.0, [2])] * 100


def duplicates(rows):
    key = [(a, b, c, None if d is None else tuple(d)) for a, b, c, d in rows]
    return {(*k, n) for k, n in Counter(key).items() if n > 1}


def got(df):
    return {(r[0], r[1], r[2], None if r[3] is None else tuple(r[3]), r[4]) for r in df.collect()}


def test_duplicate_rows_in_two_stages(spark, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame(rows, ROWS)
    assert got(quality.duplicate_rows(df)) == duplicates(rows)
    # whatever the hashes collide on, rows are compared in full
    monkeypatch.setattr(quality, "_row_hash", lambda d: [F.coalesce(F.col("a"), F.lit(0)).cast("long"), F.lit(0).cast("long")])
    assert got(quality.duplicate_rows(df)) == duplicates(rows)
    monkeypatch.undo()
    assert quality.duplicate_rows(df.limit(0)).count() == 0
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "x double")
    assert sorted(r["n_rows"] for r in quality.duplicate_rows(zeros).collect()) == [2, 2]


def test_duplicate_rows_shuffle_hashes_first(spark):
    plan = quality.duplicate_rows(spark.range(10).selectExpr("id", "repeat('x', 1000) as wide")
                                  .repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "hashpartitioning(__h1" in plan


def brute_frequent(values, n, support):
    counts = Counter(values)
    common = sorted(((v, k) for v, k in counts.items() if k > len(values) * support), key=lambda x: (-x[1], x[0] or "", x[0] is not None))
    kept = common[:n]
    rest = len(values) - sum(k for _, k in kept)
    return [(v, k, i, False) for i, (v, k) in enumerate(kept, 1)] + ([(None, rest, 0, True)] if rest else [])


def test_frequent_values(spark):
    rnd = random.Random(8)
    skewed = [rnd.choice(["hot"] * 40 + ["warm"] * 10 + [None] * 10 + ["", "Other "] * 5 + [f"v{i}" for i in range(60)]) for _ in range(4000)]
    flat = [f"id{i}" for i in range(4000)]
    df = spark.createDataFrame(list(zip(skewed, flat)), "s string, f string").repartition(7)
    for n, support in ((3, 0.01), (50, 0.01), (5, 0.0003)):
        rows = quality.frequent_values(df, ["s", "f"], n, support).collect()
        for c, values in (("s", skewed), ("f", flat)):
            mine = sorted(((r["value"], r["cnt"], r["place"], r["is_rest"]) for r in rows if r["column_name"] == c), key=lambda x: (x[3], x[2]))
            assert mine == brute_frequent(values, n, support), (c, n, support)
        assert len(rows) <= 2 * (n + 1)
    flagged = {r["value"] for r in quality.frequent_values(df, ["s"], 50, 0.01).collect() if r["is_sentinel"]}
    assert flagged == {None, "Other "}
    assert quality.frequent_values(df.limit(0), ["s", "f"]).count() == 0


def test_monthly_users(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, 0, -5, 1, 32_768, 32_769, 70_000, *range(40)]), dt.datetime(2024, rnd.randint(1, 9), 3)) for _ in range(300)]
    rows += [(5, None), (9_999_999_999, dt.datetime(2023, 1, 1))]
    df = spark.createDataFrame(rows, "user_id bigint, order_ts timestamp_ntz")
    by_month = {}
    for u, t in rows:
        if u is not None and t is not None:
            by_month.setdefault(t.strftime("%Y-%m"), set()).add(u)
    seen, expected = set(), []
    for m in sorted(by_month):
        new = by_month[m] - seen
        seen |= by_month[m]
        expected.append((m, len(by_month[m]), len(new), len(seen)))
    maps = user_counts.monthly_bitmaps(df)
    assert sorted(tuple(r) for r in user_counts.monthly_users(maps).collect()) == expected
    for a, b in (("2024-02", "2024-05"), ("2023-01", "2024-12"), ("2030-01", "2030-02")):
        want = len(set().union(*[s for m, s in by_month.items() if a <= m <= b]))
        assert user_counts.users_of(maps, a, b).first()[0] == want
    assert user_counts.monthly_users(user_counts.monthly_bitmaps(df.limit(0))).count() == 0


def test_sketches_stay_within_their_error(spark):
    df = spark.range(200_000).selectExpr("concat('u', id % 60000) as user_id",
                                         "timestamp_ntz'2024-01-01' + make_interval(0, cast(id % 12 as int)) as order_ts")
    months = user_counts.monthly_sketches(df)
    assert months.count() == 12
    for a, b in (("2024-01", "2024-12"), ("2024-03", "2024-04")):
        exact = df.where(F.date_format("order_ts", "yyyy-MM").between(a, b)).select("user_id").distinct().count()
        estimate = user_counts.estimated_users_of(months, a, b).first()[0]
        assert abs(estimate - exact) < 4 * 1.04 / 2 ** (user_counts.LG_K / 2) * exact


def test_interval_columns_are_inferred(spark):
    df = spark.range(500).selectExpr("cast(id % 7 as int) as few", "cast(id % 11 as smallint) as more", "id * 0.5 as many",
                                     "id % 2 = 0 as flag", "cast(id as string) as text", "cast(null as int) as none")
    assert phik.inferred_interval_bins(df, df.columns) == {"more": 10, "many": 10}
    assert phik.inferred_interval_bins(df, ["flag", "text"]) == {}
    assert phik.binned_columns(df, ["many"], {}).distinct().count() == 500
    assert phik.binned_columns(df, ["many"]).distinct().count() == 10
