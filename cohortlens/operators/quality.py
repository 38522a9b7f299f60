"""Data-quality checks named in the study's brief."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import round_half_even

# Labels meaning "no information" in the study's categories.
DEFAULT_SENTINELS = ("другое", "нет данных", "unknown", "other")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column: count and share in % (B1). One pass."""
    cols = list(columns) if columns is not None else df.columns
    one = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"__m{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"),
                              F.col(f"__m{i}").cast("long").alias("null_cnt"))
                     for i, c in enumerate(cols)])
    return one.select("__rows", F.inline(rows)).select(
        "column_name", "null_cnt", F.col("__rows").cast("long").alias("row_cnt"),
        round_half_even(F.try_divide(F.col("null_cnt").cast("double"), F.col("__rows")) * F.lit(100.0), 6)
         .alias("null_pct"))


def category_profile(df: DataFrame, columns: Sequence[str] | None = None,
                     sentinels: Sequence[str] = DEFAULT_SENTINELS) -> DataFrame:
    """Rows per value of every string column, flagging sentinel values such as
    "other" / "no information" (B2). Columns are unpivoted per row and counted
    with partial aggregation (one exchange)."""
    cols = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))
                      for c in cols])
    counts = (df.select(F.inline(cells))
                .groupBy("column_name", "value").agg(F.count(F.lit(1)).cast("long").alias("cnt")))
    lowered = [s.lower() for s in sentinels]
    return counts.select(
        "column_name", "value", "cnt",
        (F.col("value").isNull() | F.lower(F.trim(F.col("value"))).isin(lowered)).alias("is_sentinel"))


def frequent_values(df: DataFrame, columns: Sequence[str], n: int = 20, support: float = 0.001,
                    sentinels: Sequence[str] = DEFAULT_SENTINELS) -> DataFrame:
    """``column_name, value, cnt, place, is_rest, is_sentinel``: per column the ``n`` commonest of the values
    that more than ``support`` of the rows hold, with exact counts, and one row for all others (B2).

    Heavy-hitter summaries of each task (``freqItems``, at most 1 / support
    counters a column) are merged to candidates, among which every such value
    is; a second pass counts the candidates and puts all other values into the
    rest row (place 0, null value, absent without such rows). The result has at
    most (n + 1) rows a column, whatever the columns hold. Null is a value like
    any other; equal counts are placed by value. ``support`` is 0.0003 at least.
    """
    cols = list(columns)
    if support < 3e-4:
        raise ValueError("support must be 0.0003 at least")
    # a third of the share: the summaries keep what is commoner than that for certain
    text = df.select(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("0")).alias(c) for c in cols])
    found = text.stat.freqItems(cols, max(support / 3, 1e-4))
    per_column = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_freqItems").alias("texts")) for c in cols])
    candidates = found.select(F.inline(per_column)).select("column_name", F.explode("texts").alias("text"))
    cells = text.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("text")) for c in cols])))
    # at most 3 / support rows a column
    known = F.broadcast(candidates.select("column_name", F.col("text").alias("candidate")))
    counted = (cells.join(known, (cells["column_name"] == known["column_name"]) & (cells["text"] == known["candidate"]), "left")
               .groupBy(cells["column_name"], "candidate").agg(F.count(F.lit(1)).alias("cnt")))
    share = F.col("cnt") > F.sum("cnt").over(Window.partitionBy("column_name")) * F.lit(support)
    ranked = counted.withColumn("common", F.col("candidate").isNotNull() & share).withColumn(
        "place", F.row_number().over(Window.partitionBy("column_name", "common").orderBy(
            F.desc("cnt"), F.expr("substring(candidate, 2)"), "candidate")))
    kept = F.col("common") & (F.col("place") <= n)
    value = F.when(kept & F.col("candidate").startswith("="), F.expr("substring(candidate, 2)"))
    lowered = [s.lower() for s in sentinels]
    return (ranked.groupBy("column_name", (~kept).alias("is_rest"), value.alias("value"),
                           F.when(kept, F.col("place")).otherwise(0).alias("place"))
            .agg(F.sum("cnt").cast("long").alias("cnt"))
            .select("column_name", "value", "cnt", F.col("place").cast("int").alias("place"), "is_rest",
                    (~F.col("is_rest") & (F.col("value").isNull() | F.lower(F.trim(F.col("value"))).isin(lowered)))
                    .alias("is_sentinel")))


_ATOMIC = (T.StringType, T.BinaryType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _row_hash(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of the atomic columns; equal rows have equal ones."""
    parts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, _ATOMIC):
            x = F.col(f.name)
            # -0.0 equals 0.0
            parts.append(x + F.lit(0.0).cast(f.dataType) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else x)
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def duplicate_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Key values (all columns by default) that occur more than once, with
    their multiplicity (B3).

    Whole rows are compared in two stages: first 128-bit row hashes are
    counted, so 16 bytes a row are shuffled instead of the row; then only the
    rows whose hash came up twice are compared in full. Colliding hashes cost
    a comparison and change nothing.
    """
    if keys is not None:
        return (df.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
                  .where(F.col("n_rows") > 1))
    first, second = _row_hash(df)
    hashed = df.withColumns({"__h1": first, "__h2": second})
    twice = (hashed.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
             .select(F.col("__h1").alias("__t1"), F.col("__h2").alias("__t2")))
    suspects = hashed.join(twice, (F.col("__h1") == F.col("__t1")) & (F.col("__h2") == F.col("__t2")), "left_semi")
    return (suspects.select(*df.columns).groupBy(*df.columns).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
            .where(F.col("n_rows") > 1))
