"""The co-partitioned store and planned JDBC splits."""

from __future__ import annotations

import math
import re
import uuid

import pytest
from conftest import SF_MID, SF_SMALL
from pyspark.sql import functions as F

from cohortlens.operators.profile import customer_profile, order_gap_mean
from cohortlens.plans.pipeline import Study
from cohortlens.plans.queries import QUERIES
from cohortlens.session import write_shared
from cohortlens.sources import readers, store


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def named(spark):
    name = uuid.uuid4().hex
    yield name
    store.drop_user_store(spark, name)
    assert not spark.catalog.tableExists(store.store_name(name))


def test_no_exchange_by_user_over_the_store(spark, named, tmp_path):
    st = Study.from_fixtures(spark, SF_MID)
    store.write_user_store(st.clean, named, str(tmp_path / "s"), 4)
    assert not store.is_hot(spark, named)
    rows = store.read_user_store(spark, named)
    assert rows.columns == st.clean.columns and rows.exceptAll(st.clean).isEmpty() and rows.count() == 4831
    for build in (lambda d: customer_profile(d, values=st.attribute_values), order_gap_mean):
        own = build(rows)
        assert "hashpartitioning(user_id" not in plan(own) and "hashpartitioning(user_id" in plan(build(st.clean))
        assert own.exceptAll(build(st.clean)).isEmpty() and own.count() == build(st.clean).count()


def test_months_are_overwritten_alone(spark, named, tmp_path):
    clean = Study.from_fixtures(spark, SF_SMALL).clean
    month = F.date_format("order_ts", "yyyy-MM")
    store.write_user_store(clean, named, str(tmp_path / "s"), 2)
    one = clean.agg(F.min(month)).first()[0]
    for _ in range(2):  # writing a month again changes nothing
        store.write_user_store(clean.where(month == one), named, str(tmp_path / "s"), 2)
        rows = store.read_user_store(spark, named)
        assert rows.count() == clean.count() and rows.exceptAll(clean).isEmpty()
    store.write_user_store(clean.where(month == one).limit(1), named, str(tmp_path / "s"), 2)
    assert store.read_user_store(spark, named).where(month == one).count() == 1
    assert store.read_user_store(spark, named).count() == clean.where(month != one).count() + 1


def test_a_hot_user_is_read_as_plain_files(spark, named, tmp_path):
    clean = Study.from_fixtures(spark, SF_MID).clean
    # one user holds a third; some rows have no user or no time
    odd = clean.withColumn("user_id", F.when(F.col("order_id") % 3 == 0, F.lit("hot")).when(F.col("order_id") % 50 == 1, F.lit(None))
                           .otherwise(F.col("user_id"))).withColumn("order_ts", F.when(F.col("order_id") % 70 != 2, F.col("order_ts")))
    store.write_user_store(odd, named, str(tmp_path / "s"), 32)
    assert store.is_hot(spark, named)
    rows = store.read_user_store(spark, named)
    assert rows.count() == odd.count() and rows.exceptAll(odd).isEmpty()
    gaps = order_gap_mean(rows)
    assert "hashpartitioning(user_id" in plan(gaps) and gaps.exceptAll(order_gap_mean(odd)).isEmpty()


@pytest.fixture
def tables(spark, tmp_path):
    """3,000 orders of 300 customers over 700 days, some without a customer or a total."""
    d = tmp_path / "tables"
    frames = {
        "orders": spark.range(3000).selectExpr(
            "id AS o_orderkey", "if(id % 97 = 5, null, id * 7 % 300) AS o_custkey", "if(id % 5 = 0, 'P', 'O') AS o_orderstatus",
            "if(id % 89 = 3, null, double(id * 31 % 1009)) AS o_totalprice",
            "cast(date_add(date'1995-01-01', int(id * 13 % 700)) AS timestamp_ntz) AS o_orderdate",
            "element_at(array('1-URGENT', '2-HIGH', '5-LOW'), int(id % 3) + 1) AS o_orderpriority"),
        "lineitem": spark.range(6000).selectExpr("id DIV 2 AS l_orderkey", "id * 11 % 40 AS l_partkey", "id * 3 % 30 AS l_suppkey"),
        "part": spark.range(40).selectExpr("id AS p_partkey", "concat('n', id) AS p_name", "int(id % 20) + 1 AS p_size",
                                           "if(id % 4 = 0, 'PROMO', concat('t', id % 3)) AS p_type"),
        "supplier": spark.range(30).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name", "int(id % 5) AS s_nationkey"),
        "nation": spark.range(5).selectExpr("int(id) AS n_nationkey", "concat('r', id) AS n_name"),
    }
    for name, df in frames.items():
        df.coalesce(1).write.parquet(str(d / f"{name}.parquet"))
    return str(d)


def test_buckets_follow_the_rows(spark, tables, monkeypatch):
    plain = sorted(map(repr, QUERIES["customer_profile"](spark, tables).collect()))
    rows = Study.from_fixtures(spark, tables).fx_core.count()
    for most in (100, 10 * rows):
        monkeypatch.setattr(store, "BUCKET_ROWS", most, raising=False)
        own = QUERIES["profile_from_store"](spark, tables)
        text = plan(own)
        assert "hashpartitioning(user_id" not in text
        assert {int(n) for n in re.findall(r"SelectedBucketsCount: \d+ out of (\d+)", text)} == {max(4, math.ceil(rows / most))}
        assert len(plain) > 100 and sorted(map(repr, own.collect())) == plain
    assert rows > 1000 and (store.buckets_for(0), store.buckets_for(10**12)) == (4, 100_000)


def test_buckets_that_later_months_fill_are_read_as_plain_files(spark, tables, named, tmp_path, monkeypatch):
    clean = write_shared(Study.from_fixtures(spark, tables).clean, "clean")
    early = F.coalesce(F.col("order_ts") < F.lit("1995-03-01").cast("timestamp_ntz"), F.lit(False))
    monkeypatch.setattr(store, "BUCKET_ROWS", 60, raising=False)
    store.write_user_store(clean.where(early), named, str(tmp_path / "s"), 4)
    assert "hashpartitioning(user_id" not in plan(order_gap_mean(store.read_user_store(spark, named)))
    store.write_user_store(clean.where(~early), named, str(tmp_path / "s"), 4)
    rows = store.read_user_store(spark, named)
    assert not store.is_hot(spark, named) and rows.count() == clean.count() and rows.exceptAll(clean).isEmpty()
    gaps = order_gap_mean(rows)
    assert "hashpartitioning(user_id" in plan(gaps) and gaps.exceptAll(order_gap_mean(clean)).isEmpty()


# --- JDBC splits (no database: the questions asked are the test) --------------

def test_hash_predicates_cover_every_row(spark):
    split = readers.Split("event_id", 5, by_hash=True, bucket_sql="pmod(hash({column}), {parts})")
    parts = split.predicates()
    assert len(parts) == 5 and parts[0].endswith("OR event_id IS NULL") and "OR" not in "".join(parts[1:])
    rows = spark.range(1000).selectExpr("if(id % 9 = 0, null, concat('e', id)) as event_id")
    assert sum(rows.where(p).count() for p in parts) == 1000
    assert readers.Split("k", 3, by_hash=True).predicates()[2] == \
        "(k IS NOT NULL AND mod(hashtext(cast(k as text)) & 2147483647, 3) = 2)"


def test_bounds_are_asked_once_and_cover_the_column(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(readers, "_ask", lambda s, o, q: asked.append(q) or (3, 99))
    s = readers.planned_split(spark, "public.purchases", {}, readers.Split("order_id", 8))
    assert (s.lower, s.upper, s.parts) == (3, 100, 8)
    assert asked == ["SELECT min(order_id) AS lo, max(order_id) AS hi FROM public.purchases"]
    assert readers.planned_split(spark, "t", {}, readers.Split("k", lower=1, upper=5)).upper == 5 and len(asked) == 1
    monkeypatch.setattr(readers, "_ask", lambda s, o, q: (None, None))
    assert readers.planned_split(spark, "t", {}, readers.Split("k")).upper == 1


def test_large_tables_are_never_read_by_one_task(spark, monkeypatch):
    with pytest.raises(ValueError, match="public.purchases is read by many tasks"):
        readers.snowflake_from_jdbc(spark, {"url": "jdbc:none"}, "x.csv", purchases=None)
    calls = []
    monkeypatch.setattr(readers, "_ask", lambda s, o, q: (1, 10))
    monkeypatch.setattr(readers, "read_rates_csv", lambda s, p: None)

    def table(s, t, o, column=None, lower=None, upper=None, parts=64):
        calls.append((t, column, lower, upper, parts))
        return spark.createDataFrame([], {"public.purchases": readers.schemas.PURCHASES, "public.city": readers.schemas.CITY,
                                          "public.regions": readers.schemas.REGIONS}[t])

    def predicates(s, t, o, ps):
        calls.append((t, len(ps)))
        return spark.createDataFrame([], readers.schemas.EVENTS)

    monkeypatch.setattr(readers, "read_jdbc_table", table)
    monkeypatch.setattr(readers, "read_jdbc_predicates", predicates)
    readers.snowflake_from_jdbc(spark, {"url": "jdbc:none"}, "x.csv")
    assert calls == [("public.purchases", "order_id", 1, 11, 64), ("public.events", 64), ("public.city", None, None, None, 64),
                     ("public.regions", None, None, None, 64)]
