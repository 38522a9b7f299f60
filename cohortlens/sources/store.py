"""Purchases kept co-partitioned by user (S5 with W1, W2, §2.9).

The store is a Parquet table, partitioned by the month of the order and
bucketed by the user. Hash partitioning by the user satisfies every step of
the gap and profile operators, so over the store they run without an exchange
by user. Months are overwritten whole: writing one again replaces it.

One task reads a bucket and holds its rows in several operators, so the number
of buckets follows the rows (:func:`buckets_for`). It is fixed with the first
write, though, and later months add rows; and one user with a large part of
the orders would make one bucket hot. The rows of the fullest bucket and of
the largest user are measured when the store is written. Beyond
``FULL_FACTOR`` times ``BUCKET_ROWS``, or ``HOT_FACTOR`` times a bucket's
share, the store is read as plain files, and the operators deal its rows by
user and time as they do for any table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "order_month"
#: rows of a bucket; a task of the profile took 868 MB for 242,000 rows, 1,833 MB for 724,000
BUCKET_ROWS = 250_000
LEAST_BUCKETS = 4
MOST_BUCKETS = 100_000  # Spark's own limit; more rows than fit make the buckets full
FULL_FACTOR = 2
HOT_FACTOR = 4
_PREFIX = "cohortlens_store_"
_ROWS, _LARGEST, _FULLEST = "cohortlens.rows", "cohortlens.largest_user_rows", "cohortlens.fullest_bucket_rows"


def store_name(name: str) -> str:
    return f"{_PREFIX}{name}"


def buckets_for(rows: int) -> int:
    """Buckets of a store that will hold so many rows."""
    return min(max(math.ceil(rows / BUCKET_ROWS), LEAST_BUCKETS), MOST_BUCKETS)


def write_user_store(df: DataFrame, name: str, path: str, buckets: int, user: str = "user_id", ts: str = "order_ts") -> None:
    """Write ``df`` into the store ``name`` at ``path``; its months replace those that the store holds.

    Rows without a user are kept in one bucket (no operator reads them there);
    rows without a time are the month ``null``. A bucket of a month is one
    file, written by one task and sorted by user and time.
    """
    spark, table = df.sparkSession, store_name(name)
    rows = df.withColumn(MONTH, F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("null")))
    # the bucket is Spark's own: hash of the user modulo the buckets
    dealt = rows.repartition(F.pmod(F.hash(user), F.lit(buckets)), MONTH)
    if not spark.catalog.tableExists(table):
        (dealt.write.partitionBy(MONTH).bucketBy(buckets, user).sortBy(user, ts).option("path", path)
         .format("parquet").saveAsTable(table))
    else:
        key = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(key)
        spark.conf.set(key, "dynamic")
        try:
            dealt.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
        finally:
            spark.conf.set(key, before)
    kept = _buckets(spark, table)  # those of the first write
    per_user = spark.table(table).where(F.col(user).isNotNull()).groupBy(user).agg(F.count("*").alias("n"))
    per_bucket = per_user.groupBy(F.pmod(F.hash(user), F.lit(kept))).agg(F.sum("n").alias("n"), F.max("n").alias("largest"))
    said = per_bucket.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.max("largest"), F.max("n"))]).first()
    properties = ", ".join(f"'{k}' = '{v}'" for k, v in zip((_ROWS, _LARGEST, _FULLEST), said))
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({properties})")


def _described(spark: SparkSession, table: str) -> dict[str, str]:
    return {r["col_name"].strip(): (r["data_type"] or "").strip() for r in spark.sql(f"DESCRIBE FORMATTED {table}").collect()}


def _buckets(spark: SparkSession, table: str) -> int:
    return int(_described(spark, table)["Num Buckets"])


def _measured(spark: SparkSession, table: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def is_hot(spark: SparkSession, name: str) -> bool:
    """Whether one user's rows outweigh a bucket's share by ``HOT_FACTOR``."""
    table = store_name(name)
    said = _measured(spark, table)
    return int(said[_LARGEST]) > HOT_FACTOR * max(1, int(said[_ROWS]) / _buckets(spark, table))


def is_full(spark: SparkSession, name: str) -> bool:
    """Whether the fullest bucket holds more than ``FULL_FACTOR`` times ``BUCKET_ROWS``."""
    said = _measured(spark, store_name(name))
    # a store written before buckets were measured counts as one bucket
    return int(said.get(_FULLEST, said[_ROWS])) > FULL_FACTOR * BUCKET_ROWS


def read_user_store(spark: SparkSession, name: str) -> DataFrame:
    """The store's rows without the month column; co-partitioned by user unless one user is hot or a bucket full."""
    table = store_name(name)
    rows = spark.table(table)
    if is_hot(spark, name) or is_full(spark, name):
        rows = spark.read.schema(rows.schema).parquet(_described(spark, table)["Location"])
    return rows.drop(MONTH)


def drop_user_store(spark: SparkSession, name: str) -> None:
    """Forget the store; its files stay where they are."""
    spark.sql(f"DROP TABLE IF EXISTS {store_name(name)}")
