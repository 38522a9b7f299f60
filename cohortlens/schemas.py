"""Declared schemas, label dimensions and load-time validation (§1.2, §1.3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Base tables of the purchase snowflake. Key columns are strings in the source
# database; the fixtures use integer keys, so readers cast only when asked.
PURCHASES = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("device_type_canonical", T.StringType()),
    T.StructField("order_id", T.LongType()),
    T.StructField("created_dt_msk", T.TimestampNTZType()),
    T.StructField("created_ts_msk", T.TimestampNTZType()),
    T.StructField("currency_code", T.StringType()),
    T.StructField("revenue", T.DecimalType(18, 2)),
    T.StructField("tickets_count", T.IntegerType()),
    T.StructField("service_name", T.StringType()),
    T.StructField("event_id", T.StringType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_name_code", T.StringType()),
    T.StructField("event_type_main", T.StringType()),
    T.StructField("city_id", T.LongType()),
])

CITY = T.StructType([
    T.StructField("city_id", T.LongType()),
    T.StructField("city_name", T.StringType()),
    T.StructField("region_id", T.LongType()),
])

REGIONS = T.StructType([
    T.StructField("region_id", T.LongType()),
    T.StructField("region_name", T.StringType()),
])

# Daily exchange rates: rubles per `nominal` units of currency `cdx` on day `data`.
RATES = T.StructType([
    T.StructField("data", T.TimestampNTZType()),
    T.StructField("nominal", T.IntegerType()),
    T.StructField("curs", T.DecimalType(18, 6)),
    T.StructField("cdx", T.StringType()),
])

REVENUE_RUB_TYPE = T.DecimalType(24, 6)

# The ticket-bucket cut of the study (left-closed bins).
TICKET_BUCKET_EDGES = [0, 2, 3, 5, 12]
TICKET_BUCKET_LABELS = ["1-2", "2-3", "3-5", "5+"]
# The order-count cut of the study (left-closed bins).
ORDER_BUCKET_EDGES = [0, 2, 5, 153]
ORDER_BUCKET_LABELS = ["1", "2-4", "5+"]
# Devices kept by the extract.
DEVICES = ["mobile", "desktop"]

class ValidationError(ValueError):
    pass


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once (distributed; partial aggregation)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
              .filter(F.col("n_rows") > 1))


def assert_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> None:
    """Fail when a dimension key repeats: a repeated key silently multiplies
    fact rows in the left joins (§1.2). Runs one aggregate and fetches at
    most one offending key."""
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ValidationError(f"{name}: key {list(keys)} not unique, e.g. {bad[0].asDict()}")


def label_dimension(spark: SparkSession, column: str, labels: Sequence[str]) -> DataFrame:
    """Small fixed frame of bucket labels with their ordinal (for empty groups, Q11)."""
    return spark.createDataFrame(
        [(lab, i) for i, lab in enumerate(labels)],
        T.StructType([T.StructField(column, T.StringType(), False),
                      T.StructField(f"{column}_ord", T.IntegerType(), False)]),
    )
