"""Currency normalisation.

Revenue in another currency is converted with the rate of the order day:
``revenue * curs / nominal``. The rate table has one row per (day, currency).
It is written once, counted, and broadcast up to ``BROADCAST_ROWS`` rows, so the
orders are not shuffled by day. A larger table is joined by a shuffle whose
keys are salted, because busy days are hot and orders that need no rate would
all meet on one of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..schemas import assert_unique

#: rates (about 60 bytes each) that are broadcast; 500,000 are 1,300 years of one currency
BROADCAST_ROWS = 500_000
SALTS = 64


def fx_normalise(df: DataFrame, rates: DataFrame, converted: Sequence[str] = ("kzt",),
                 base_currency: str = "rub", strict: bool = False,
                 day_col: str = "order_dt", validate: bool = False,
                 broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``revenue_rub`` (decimal(24,6)).

    * currency in ``converted``: converted with that day's rate, null when the
      day has no rate (Q14);
    * otherwise: passed through unchanged (the study's behaviour, Q15), or
      null when ``strict`` and the currency is not ``base_currency``.

    ``validate=True`` first checks that ``(data, cdx)`` is unique (a repeated
    rate would duplicate orders).
    """
    if validate:
        assert_unique(rates, ["data", "cdx"], "rates")
    r = rates.select(F.col("data").alias("__fx_day"), F.col("cdx").alias("__fx_cur"),
                     F.col("nominal").alias("__fx_nominal"), F.col("curs").alias("__fx_curs"))
    r = r.where(F.col("__fx_cur").isin(list(converted))).checkpoint(eager=True)
    same = (F.col(day_col) == F.col("__fx_day")) & (F.col("currency_code") == F.col("__fx_cur"))
    if r.count() <= broadcast_rows:
        joined = df.join(F.broadcast(r), same, "left")
    else:
        salted = r.withColumn("__fx_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        row_salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
        joined = (df.withColumn("__fx_row", row_salt)
                  .join(salted, same & (F.col("__fx_row") == F.col("__fx_salt")), "left")
                  .drop("__fx_salt", "__fx_row"))
    converted_value = ((F.col("revenue") * F.col("__fx_curs")).cast("double")
                       / F.col("__fx_nominal")).cast(schemas.REVENUE_RUB_TYPE)
    passthrough = F.col("revenue").cast(schemas.REVENUE_RUB_TYPE)
    if strict:
        passthrough = F.when(F.col("currency_code") == F.lit(base_currency), passthrough)
    revenue_rub = (F.when(F.col("currency_code").isin(list(converted)), converted_value)
                    .otherwise(passthrough))
    return (joined.withColumn("revenue_rub", revenue_rub)
                  .drop("__fx_day", "__fx_cur", "__fx_nominal", "__fx_curs"))
