"""Conformed purchase tables built from the driver's TPC-H-like parquet files.

The mapping (FIXTURES.md §2) turns orders + line items into purchases, parts
into events, suppliers into cities, nations into regions, and derives a daily
rate table from the order dates. The same mapping is written as SQL in
``cohortlens.plans.oracle`` for the DuckDB cross-check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

# Fixed values of the mapping (FIXTURES.md §2).
MOBILE_PRIORITY = "1-URGENT"
DESKTOP_PRIORITY = "2-HIGH"
KZT_STATUS = "P"
EXCLUDED_GENRE = "PROMO"
SERVICE_PREFIX = "SVC_"
SERVICE_MODULUS = 20
RATE_GAP_MODULUS = 50  # days whose day-of-year is a multiple of this have no rate
RATE_BASE = 15.0
RATE_STEP = 0.5
RATE_CYCLE = 7
RATE_NOMINAL = 100


@dataclass
class Snowflake:
    """The four base tables of the purchase snowflake plus the rate table."""

    purchases: DataFrame
    events: DataFrame
    city: DataFrame
    regions: DataFrame
    rates: DataFrame


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def purchases_from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One purchase per order; ticket count, event and service from its lines.

    Line items are aggregated per order before the join (partial aggregation
    on the map side), then joined to orders on the order key.
    """
    li = (lineitem.groupBy("l_orderkey")
                  .agg(F.count(F.lit(1)).alias("n_lines"),
                       F.min("l_partkey").alias("min_partkey"),
                       F.min("l_suppkey").alias("min_suppkey")))
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                      "o_orderdate", "o_orderpriority")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    return (o.join(li, o.o_orderkey == li.l_orderkey, "left")
             .select(
                 F.col("o_custkey").alias("user_id"),
                 F.when(F.col("o_orderpriority") == MOBILE_PRIORITY, "mobile")
                  .when(F.col("o_orderpriority") == DESKTOP_PRIORITY, "desktop")
                  .otherwise("other").alias("device_type_canonical"),
                 F.col("o_orderkey").alias("order_id"),
                 day.alias("created_dt_msk"),
                 day.alias("created_ts_msk"),
                 F.when(F.col("o_orderstatus") == KZT_STATUS, "kzt").otherwise("rub")
                  .alias("currency_code"),
                 F.col("o_totalprice").cast("decimal(18,2)").alias("revenue"),
                 F.col("n_lines").cast("int").alias("tickets_count"),
                 F.concat(F.lit(SERVICE_PREFIX),
                          (F.col("min_suppkey") % SERVICE_MODULUS).cast("string"))
                  .alias("service_name"),
                 F.col("min_partkey").alias("event_id"),
             ))


def events_from_part(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("event_id"),
        F.col("p_name").alias("event_name_code"),
        F.col("p_type").alias("event_type_main"),
        F.col("p_size").cast("long").alias("city_id"),
    )


def city_from_supplier(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        F.col("s_suppkey").alias("city_id"),
        F.col("s_name").alias("city_name"),
        F.col("s_nationkey").cast("long").alias("region_id"),
    )


def regions_from_nation(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").cast("long").alias("region_id"),
        F.col("n_name").alias("region_name"),
    )


def rates_from_orders(orders: DataFrame) -> DataFrame:
    """One `kzt` rate per order day, with a gap every RATE_GAP_MODULUS days of the year."""
    day = F.col("o_orderdate").cast("timestamp_ntz")
    return (orders.select(day.alias("data"))
                  .where((F.dayofyear("data") % RATE_GAP_MODULUS) != 0)
                  .distinct()
                  .select(
                      "data",
                      F.lit(RATE_NOMINAL).cast("int").alias("nominal"),
                      (F.lit(RATE_BASE) + (F.dayofyear("data") % RATE_CYCLE) * F.lit(RATE_STEP))
                       .cast(schemas.RATES["curs"].dataType).alias("curs"),
                      F.lit("kzt").alias("cdx"),
                  ))


def load_snowflake(spark: SparkSession, sf_dir: str) -> Snowflake:
    orders = _read(spark, sf_dir, "orders")
    return Snowflake(
        purchases=purchases_from_orders(orders, _read(spark, sf_dir, "lineitem")),
        events=events_from_part(_read(spark, sf_dir, "part")),
        city=city_from_supplier(_read(spark, sf_dir, "supplier")),
        regions=regions_from_nation(_read(spark, sf_dir, "nation")),
        rates=rates_from_orders(orders),
    )
