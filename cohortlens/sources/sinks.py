"""Sinks (S5). The study only displays results; reports here are DataFrames
that callers write where they need them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Write a result as a (partitioned) table; readers then prune partitions
    and push filters into the scan."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
