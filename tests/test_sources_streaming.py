"""CSV rates reader, table sink and the streaming ingest path."""

from __future__ import annotations

import os
import tempfile

from conftest import SF_SMALL
from pyspark.sql import functions as F

from cohortlens.plans.pipeline import Study
from cohortlens.sources.readers import read_rates_csv, table_overview
from cohortlens.sources.sinks import write_table
from cohortlens.sources.fixtures import EXCLUDED_GENRE
from cohortlens.streaming import append_conformed, read_purchase_stream


def test_rates_csv_roundtrip(spark):
    st = Study.from_fixtures(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="cl-csv-", dir="/tmp")
    st.tables.rates.select(F.date_format("data", "yyyy-MM-dd").alias("data"), "nominal",
                           F.col("curs").cast("string").alias("curs"), "cdx") \
        .write.option("header", True).mode("overwrite").csv(os.path.join(d, "rates"))
    back = read_rates_csv(spark, os.path.join(d, "rates"))
    assert back.schema.simpleString() == "struct<data:timestamp_ntz,nominal:int,curs:decimal(18,6),cdx:string>"
    assert back.exceptAll(st.tables.rates).count() == 0
    assert back.count() == st.tables.rates.count()


def test_table_overview_counts(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    got = {r.column_name: (r.non_null_cnt, r.row_cnt) for r in table_overview(df).collect()}
    assert got == {"a": (2, 2), "b": (1, 2)}


def test_stream_ingest_matches_batch(spark):
    st = Study.from_fixtures(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="cl-stream-", dir="/tmp")
    src, table, ckpt = (os.path.join(d, x) for x in ("in", "table", "ckpt"))
    st.tables.purchases.repartition(3).write.parquet(src)
    stream = read_purchase_stream(spark, src, st.tables.purchases.schema, max_files_per_trigger=1)
    calls = []
    q = append_conformed(stream, lambda: calls.append(1) or st.tables, table, ckpt,
                         exclude_genre=EXCLUDED_GENRE, available_now=True)
    q.awaitTermination(300)
    assert len(calls) == 3  # the dimension tables are asked for with every batch
    got = spark.read.parquet(table).drop("order_month", "batch_id")
    exp = st.fx_core
    assert got.count() == exp.count()
    assert got.select(exp.columns).exceptAll(exp).count() == 0
    write_table(got.limit(5), os.path.join(d, "out"), partition_by=["currency_code"])
    assert spark.read.parquet(os.path.join(d, "out")).count() == 5


def test_report_pack_writes_every_report(spark):
    from cohortlens.plans.queries import REPORTS
    from cohortlens.plans.report_pack import run_study_from_files
    d = tempfile.mkdtemp(prefix="cl-pack-", dir="/tmp")
    times = run_study_from_files(spark, SF_SMALL, d)
    assert set(times) == set(REPORTS) | {"__materialize"}
    assert spark.read.parquet(os.path.join(d, "segment_return_event")).count() >= 1


def test_rates_csv_binds_by_name(spark, tmp_path):
    import datetime

    import pytest

    from cohortlens.sources.readers import read_rates_csv
    (tmp_path / "a.csv").write_text("note,data,curs,nominal,cdx\nx,2024-01-01,15,100,kzt\n")
    row = read_rates_csv(spark, str(tmp_path / "a.csv")).first()
    assert row["nominal"] == 100 and float(row["curs"]) == 15 and row["cdx"] == "kzt"
    assert row["data"] == datetime.datetime(2024, 1, 1)
    (tmp_path / "b.csv").write_text("data,curs,cdx\n2024-01-01,15,kzt\n")
    with pytest.raises(ValueError, match="nominal"):
        read_rates_csv(spark, str(tmp_path / "b.csv"))


def test_queries_leave_nothing_persisted(spark):
    from conftest import SF_SMALL

    from cohortlens.plans.queries import QUERIES
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for name in ("outlier_volume", "segment_return_event"):
        df = QUERIES[name](spark, SF_SMALL)
        df.collect()
        assert "InMemoryTableScan" not in df._jdf.queryExecution().toString()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
