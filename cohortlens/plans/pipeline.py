"""The study as one plan: extract -> FX -> revenue cut -> profile -> cut.

Every stage is a DataFrame built from the previous one. Building the cuts runs
the quantile rounds, building the FX step writes the rates, and kept tables
are written when first asked for. ``materialize="checkpoint"`` writes the cleaned
purchases and the profile to the session's checkpoint folder
(``spark.checkpoint.dir``, a shared path on a cluster), so that the many
reports over them read a stored table instead of recomputing the joins, and
lost executors only recompute from there. ``materialize="parquet"`` writes
them as parquet tables in that folder instead (one write job; later reads
prune columns and push filters - the better choice for many narrow reports
over a wide table at scale, slower on small data).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators.extract import STUDY_EXCLUDED_GENRE, add_days_since_prev, extract_purchases, typed_purchases
from ..operators.fx import fx_normalise
from ..operators.profile import customer_profile
from ..operators.quantile import outlier_cut, stored_columns
from ..operators.segments import CubeCounts, ProfileCounts, segment_cube
from ..schemas import assert_unique
from ..session import checkpoint_dir, prepare, write_shared
from ..sources.fixtures import EXCLUDED_GENRE, Snowflake, load_snowflake


@dataclass
class StudyParams:
    revenue_q: float = 0.99          # B11: percentile of the revenue cut
    orders_q: float = 0.99           # percentile of the profile cut
    exclude_genre: str | None = STUDY_EXCLUDED_GENRE
    strict_fx: bool = False


@dataclass
class Study:
    spark: SparkSession
    tables: Snowflake
    params: StudyParams = field(default_factory=StudyParams)
    materialize: bool | str = False  # False, "checkpoint" (True) or "parquet"
    source_dir: str | None = None    # folder of the raw tables, when read from files
    purchases_mode: str | None = None  # override of `materialize` for the cleaned purchases
    profile_mode: str | None = None    # override of `materialize` for the profile
    cube: bool = False               # reports read one segment cube instead of the profile each

    @classmethod
    def from_fixtures(cls, spark: SparkSession, sf_dir: str, **kw) -> Study:
        prepare(spark)
        kw.setdefault("params", StudyParams(exclude_genre=EXCLUDED_GENRE))  # the fixtures' own genre
        return cls(spark, load_snowflake(spark, sf_dir), source_dir=sf_dir, **kw)

    def validate(self) -> Study:
        """Fail if a dimension key or a (day, currency) rate repeats: a repeated
        key would silently multiply purchases in the left joins (§1.2). One
        small aggregate per table; at most one offending key is fetched."""
        t = self.tables
        assert_unique(t.events, ["event_id"], "events")
        assert_unique(t.city, ["city_id"], "city")
        assert_unique(t.regions, ["region_id"], "regions")
        assert_unique(t.rates, ["data", "cdx"], "rates")
        return self

    def _keep(self, df: DataFrame, name: str = "table", mode: str | bool | None = None) -> DataFrame:
        mode = self.materialize if mode is None else mode
        if not self.materialize:
            return df
        if mode == "parquet":
            # A written table in the shared checkpoint folder: one job to write,
            # and later reads prune columns and push filters into the scan.
            path = f"{checkpoint_dir(self.spark).rstrip('/')}/cohortlens-{uuid.uuid4().hex}/{name}"
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)
        if mode in (True, "checkpoint"):
            # Reliable checkpoint: written to spark.checkpoint.dir, cuts the lineage.
            return df.checkpoint(eager=True)
        return df

    @cached_property
    def extract_core(self) -> DataFrame:
        """The filtered, joined purchases without ``days_since_prev``."""
        t = self.tables
        return extract_purchases(t.purchases, t.events, t.city, t.regions,
                                 exclude_genre=self.params.exclude_genre,
                                 with_days_since_prev=False)

    @cached_property
    def extract(self) -> DataFrame:
        """The study's SQL extract, ``days_since_prev`` included."""
        return add_days_since_prev(self.extract_core)

    @cached_property
    def fx_core(self) -> DataFrame:
        fx = fx_normalise(self.extract_core, self.tables.rates, strict=self.params.strict_fx)
        return self._keep(typed_purchases(fx), "purchases_rub", self.purchases_mode)

    @cached_property
    def purchases_rub(self) -> DataFrame:
        """Extract with ``revenue_rub``, before the cut, analysis types (the
        study's ``merged_df``)."""
        return typed_purchases(add_days_since_prev(self.fx_core))

    @cached_property
    def revenue_numbers(self) -> DataFrame:
        """``revenue_rub`` of every purchase as stored numbers; counting its rows runs no join."""
        return stored_columns(self.fx_core, ["revenue_rub"])

    @cached_property
    def clean(self) -> DataFrame:
        """Purchases with ``revenue_rub`` at or below its ``revenue_q`` quantile.
        ``days_since_prev`` is not carried: nothing after the cut uses it."""
        return outlier_cut(self.fx_core, "revenue_rub", self.params.revenue_q, self.revenue_numbers)

    @cached_property
    def profile(self) -> DataFrame:
        """Profile over the cleaned purchases (uncut)."""
        return self._keep(customer_profile(self.clean, values=self.attribute_values), "profile", self.profile_mode)

    @cached_property
    def segments(self) -> DataFrame | ProfileCounts:
        """What the segment and bucket reports count: the cut profile, or with
        ``cube`` its stored segment cube, one scan of the profile for all of them."""
        if not self.cube:
            return self.profile_f
        return CubeCounts(write_shared(segment_cube(self.profile_f), "segment-cube"))

    @property
    def attribute_values(self) -> dict[str, DataFrame]:
        """Where the values of the first-order attributes are read, without the joins of the extract."""
        t = self.tables
        kinds = t.purchases.select("device_type_canonical", "service_name")
        return {"device_type_canonical": kinds, "service_name": kinds, "region_name": t.regions,
                "event_type_main": t.events}

    @cached_property
    def profile_f(self) -> DataFrame:
        """Profile cut at the ``orders_q`` percentile of ``total_orders_cnt``."""
        return outlier_cut(self.profile, "total_orders_cnt", self.params.orders_q)
