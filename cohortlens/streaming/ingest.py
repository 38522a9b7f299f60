"""Incremental ingestion of purchases with Structured Streaming.

The study is a batch analysis and has no streaming operator. What streams
in practice is the purchase fact table; its conforming steps are stateless
per row (dimension joins, the device / genre filter, currency conversion),
so the same operators run unchanged on each micro-batch and append to a
table that the batch reports read. The order-dependent and whole-population
steps (gaps, percentile cuts, profiles) stay batch jobs over that table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.extract import STUDY_EXCLUDED_GENRE, extract_purchases, typed_purchases
from ..operators.fx import fx_normalise
from ..sources.fixtures import Snowflake


def read_purchase_stream(spark: SparkSession, path: str, schema: StructType,
                         max_files_per_trigger: int = 64) -> DataFrame:
    """Purchases arriving as parquet files in ``path`` (declared schema, no inference)."""
    return (spark.readStream.schema(schema)
                 .option("maxFilesPerTrigger", max_files_per_trigger)
                 .parquet(path))


def append_conformed(purchases: DataFrame, tables: Callable[[], Snowflake], table_path: str,
                     checkpoint_path: str, exclude_genre: str | None = STUDY_EXCLUDED_GENRE,
                     available_now: bool = False) -> StreamingQuery:
    """Join, filter and convert each micro-batch and append it to a Parquet table.

    ``tables`` is called for every batch, so dimension rows and rates that
    arrived since the last one are seen. A batch is written to its own folder
    ``batch_id=N`` (months inside), which a repeated batch overwrites.
    ``checkpoint_path`` keeps the stream's offsets (a shared folder on a cluster).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        t = tables()
        conformed = extract_purchases(batch, t.events, t.city, t.regions, exclude_genre=exclude_genre,
                                      with_days_since_prev=False)
        (typed_purchases(fx_normalise(conformed, t.rates))
         .withColumn("order_month", F.date_format("order_dt", "yyyy-MM"))
         .write.mode("overwrite").partitionBy("order_month")
         .parquet(f"{table_path.rstrip('/')}/batch_id={batch_id}"))

    writer = purchases.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
