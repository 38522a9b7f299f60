"""Sources (S1-S4): JDBC base tables, the rates CSV, Parquet, table overview.

Nothing is fetched through the driver: every reader returns a lazy
DataFrame. JDBC reads are split on a numeric column so that the database is
read by many tasks in parallel; credentials come from the caller (or the
environment), never from code.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def jdbc_options(url: str | None = None, user: str | None = None,
                 password: str | None = None, **extra: str) -> dict[str, str]:
    """Connection options (S1). Missing values are taken from the
    ``COHORTLENS_JDBC_URL`` / ``_USER`` / ``_PASSWORD`` environment variables."""
    opts = {
        "url": url or os.environ.get("COHORTLENS_JDBC_URL", ""),
        "user": user or os.environ.get("COHORTLENS_JDBC_USER", ""),
        "password": password or os.environ.get("COHORTLENS_JDBC_PASSWORD", ""),
        "driver": extra.pop("driver", "org.postgresql.Driver"),
        "fetchsize": extra.pop("fetchsize", "10000"),
    }
    opts.update(extra)
    return {k: v for k, v in opts.items() if v != ""}


@dataclass(frozen=True)
class Split:
    """How a table is read by many tasks: ranges of a numeric column or hash buckets of any column."""

    column: str
    parts: int = 64
    lower: int | None = None   # bounds of a numeric column; asked from the database if missing
    upper: int | None = None
    by_hash: bool = False
    #: bucket of a row, from 0, in the database's SQL
    bucket_sql: str = "mod(hashtext(cast({column} as text)) & 2147483647, {parts})"

    def predicates(self) -> list[str]:
        """One WHERE clause per task; every row meets exactly one, a null column the first."""
        bucket = self.bucket_sql.format(column=self.column, parts=self.parts)
        return [f"({self.column} IS NOT NULL AND {bucket} = {i})" + (f" OR {self.column} IS NULL" if i == 0 else "")
                for i in range(self.parts)]


def read_jdbc_table(spark: SparkSession, table: str, options: Mapping[str, str],
                    partition_column: str | None = None, lower_bound: int | None = None,
                    upper_bound: int | None = None, num_partitions: int = 64) -> DataFrame:
    """Read one base table (S2). Joins and filters happen in Spark, so only
    projected columns and pushed predicates travel over the wire.

    With ``partition_column`` the read is split into ``num_partitions``
    range queries; without it the table is read by a single task, which is
    only acceptable for small dimension tables.
    """
    return _reader(spark, table, options, partition_column, lower_bound, upper_bound, num_partitions).load()


def _reader(spark: SparkSession, table: str, options: Mapping[str, str], partition_column: str | None,
            lower_bound: int | None, upper_bound: int | None, num_partitions: int):
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition_column is not None:
        if lower_bound is None or upper_bound is None:
            raise ValueError("lower_bound and upper_bound are required with partition_column")
        reader = (reader.option("partitionColumn", partition_column)
                        .option("lowerBound", str(lower_bound))
                        .option("upperBound", str(upper_bound))
                        .option("numPartitions", str(num_partitions)))
    return reader


def read_jdbc_predicates(spark: SparkSession, table: str, options: Mapping[str, str],
                         predicates: list[str]) -> DataFrame:
    """Read a table with one task per WHERE predicate (for string keys, e.g.
    hash buckets of ``event_id``)."""
    props = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], table, predicates=predicates, properties=props)


def bounds_query(table: str, column: str) -> str:
    """The smallest and largest value of a column, found by the database (an index look-up for a key)."""
    return f"SELECT min({column}) AS lo, max({column}) AS hi FROM {table}"


def _ask(spark: SparkSession, options: Mapping[str, str], query: str) -> tuple:
    return tuple(spark.read.format("jdbc").options(**options).option("query", query).load().first())


def planned_split(spark: SparkSession, table: str, options: Mapping[str, str], split: Split) -> Split:
    """``split`` with the bounds of its column, asked from the database where they are missing.

    The upper bound is one above the largest value, so the last range is no
    longer than the others. An empty table gets the bounds 0 and 1.
    """
    if split.by_hash or (split.lower is not None and split.upper is not None):
        return split
    lo, hi = _ask(spark, options, bounds_query(table, split.column))
    lo, hi = (0, 0) if lo is None else (lo, hi)
    return replace(split, lower=int(lo) if split.lower is None else split.lower,
                   upper=int(hi) + 1 if split.upper is None else split.upper)


def read_jdbc_split(spark: SparkSession, table: str, options: Mapping[str, str], split: Split | None) -> DataFrame:
    """Read a large table by many tasks. Without a split it is an error: one task would read it all."""
    if split is None:
        raise ValueError(f"{table} is read by many tasks: name a Split (a numeric key, or by_hash for any other)")
    if split.by_hash:
        return read_jdbc_predicates(spark, table, options, split.predicates())
    s = planned_split(spark, table, options, split)
    return read_jdbc_table(spark, table, options, s.column, s.lower, s.upper, s.parts)


def snowflake_from_jdbc(spark: SparkSession, options: Mapping[str, str], rates_csv: str,
                        schema: str = "public", purchases: Split | None = Split("order_id"),
                        events: Split | None = Split("event_id", by_hash=True)):
    """The study's four base tables over JDBC plus the rates CSV.

    Purchases are read in ranges of ``order_id`` (bounds asked from the
    database if the split has none), events in hash buckets of ``event_id``;
    ``None`` for either is an error. City and regions are small dimensions
    read by one task each. Only the columns the extract uses are selected, so
    the database ships nothing else. Keys are checked for uniqueness later
    with ``schemas.assert_unique`` if the caller wants it.
    """
    from .fixtures import Snowflake

    return Snowflake(
        purchases=read_jdbc_split(spark, f"{schema}.purchases", options, purchases).select(*[f.name for f in schemas.PURCHASES]),
        events=read_jdbc_split(spark, f"{schema}.events", options, events).select(*[f.name for f in schemas.EVENTS]),
        city=read_jdbc_table(spark, f"{schema}.city", options).select(*[f.name for f in schemas.CITY]),
        regions=read_jdbc_table(spark, f"{schema}.regions", options).select(
            *[f.name for f in schemas.REGIONS]),
        rates=read_rates_csv(spark, rates_csv),
    )


def read_rates_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily exchange rates from CSV.

    The header names the columns: ``data, nominal, curs, cdx`` in any order,
    others are ignored, a missing one is an error.
    """
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    missing = {f.name for f in schemas.RATES} - set(raw.columns)
    if missing:
        raise ValueError(f"rates file {path} has no column {', '.join(sorted(missing))}")
    return raw.select(
        F.to_timestamp_ntz(F.col("data")).alias("data"),
        F.col("nominal").cast("int").alias("nominal"),
        F.col("curs").cast(schemas.RATES["curs"].dataType).alias("curs"),
        F.col("cdx").alias("cdx"),
    )


def table_overview(df: DataFrame) -> DataFrame:
    """Per column: position, name, type, non-null count, and the row count.

    One aggregate pass computes every count; the result is unpivoted with
    ``inline`` so it has one row per column.
    """
    fields = df.schema.fields
    counted = df.toDF(*[f"__c{i}" for i in range(len(fields))]).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(f"__c{i}").alias(f"__nn{i}") for i in range(len(fields))])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                              F.lit(f.dataType.simpleString()).alias("data_type"),
                              F.col(f"__nn{i}").alias("non_null_cnt"))
                     for i, f in enumerate(fields)])
    return counted.select(F.inline(rows), F.col("__rows").alias("row_cnt")).select(
        F.col("position").cast("int"), "column_name", "data_type",
        F.col("non_null_cnt").cast("long"), F.col("row_cnt").cast("long"),
    )
