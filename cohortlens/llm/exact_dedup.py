"""Exact dedup by content sort.

The normalised texts are range-partitioned by sampled splitters and sorted
externally, so equal texts stand next to each other; one streaming pass over
each sorted range compares neighbours in full. The splitter key ends in the
document id, so a group of copies that holds a third of all rows is cut over
as many ranges as its size asks for; only the first and last run of a range
can continue in another range, and those (two rows per range at most) are
merged by the digest of the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, materialise, row_slices

SCHEMA = ("doc_id bigint, text_sha256 string, range_keep bigint, range_size bigint, "
          "range_id int, run int, edge boolean")


def _scan_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted range.

    Held at a time: one text and the ids of its run inside this range.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    run, ids, last = 0, [], None
    done: list[tuple] = []
    held = 0

    def rows(edge: bool) -> tuple:
        known = [i for i in ids if i is not None]
        return (ids, hashlib.sha256(last.encode()).hexdigest(), max(known) if known else None, len(ids), run, edge)

    def batch(items: list[tuple]) -> pa.RecordBatch:
        n = [len(x[0]) for x in items]

        def per_row(k, kind):
            return pa.array([x[k] for x in items], kind).take(pa.array(np.repeat(np.arange(len(items)), n)))

        total = sum(n)
        return pa.RecordBatch.from_arrays(
            [pa.array([i for x in items for i in x[0]], pa.int64()), per_row(1, pa.string()), per_row(2, pa.int64()),
             per_row(3, pa.int64()), pa.array(np.full(total, part, np.int32)), per_row(4, pa.int32()),
             per_row(5, pa.bool_())],
            names=["doc_id", "text_sha256", "range_keep", "range_size", "range_id", "run", "edge"])

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if last is not None and text != last:
                done.append(rows(run == 0))
                held += len(ids)
                run, ids = run + 1, []
                if held > 20_000:
                    yield batch(done)
                    done, held = [], 0
            last = text
            ids.append(doc_id)
    if ids:
        done.append(rows(True))
    if done:
        yield batch(done)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 ranges: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty. The row with the largest id stays. Repeated rows with that same
    id all carry ``kept``; a null id is never kept unless its whole group has
    no id. Extra columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    norm = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    key = [F.substring("norm", 1, 32).alias("head"), F.xxhash64("norm").alias("h")]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["head", "h", "norm", F.col("doc_id").desc()]
    ordered = (norm.select("doc_id", "norm", *key)
               .repartitionByRange(n, "head", "h", F.col("doc_id").desc())
               .sortWithinPartitions(*order).select("doc_id", "norm"))
    runs = materialise(ordered.mapInArrow(_scan_range, SCHEMA), "content-sort")
    edges = runs.where("edge").select("range_id", "run", "text_sha256", "range_keep", "range_size").distinct()
    # at most two rows per range, whatever the number of documents
    merged = edges.groupBy("text_sha256").agg(F.max("range_keep").alias("all_keep"),
                                              F.sum("range_size").alias("all_size"))
    joined = runs.join(F.broadcast(merged.withColumn("edge", F.lit(True))), ["text_sha256", "edge"], "left")
    keep = F.coalesce("all_keep", "range_keep")
    return joined.select("doc_id", keep.alias("keep_id"),
                         F.coalesce("all_size", "range_size").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def _first_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run of equal texts in one sorted range, with its whole columns.

    The range's first and last run may go on in another one: those carry the
    digest of their text. Held at a time: the last text, and one open row.
    """
    from pyspark import TaskContext

    part, last, run, open_row = TaskContext.get().partitionId(), None, -1, None

    def made(rows: pa.RecordBatch, sha: list, runs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(sha, pa.string()), pa.array([part] * len(sha), pa.int32()), pa.array(runs, pa.int64())],
            names=["row", "sha", "range_id", "run"])

    def digest(norm: bytes) -> str:
        return hashlib.sha256(norm).hexdigest()

    for b in batches:
        for i, j in row_slices(b.column(1)):
            starts = []
            for k, raw in enumerate(pc.cast(b.column(1).slice(i, j - i), pa.binary()).to_pylist()):
                norm = raw.lower()  # of bytes: A-Z only
                if norm != last:
                    starts.append((k, norm))
                    last = norm
            if not starts:
                continue
            if open_row is not None:  # another run follows, so its run ends here
                yield made(open_row[0], [digest(open_row[1]) if run == 0 else None], [run])
            rows = b.slice(i, j - i).take(pa.array([k for k, _ in starts]))
            inner = len(starts) - 1
            if inner:
                yield made(rows.slice(0, inner), [digest(n) if run + 1 + x == 0 else None for x, (_, n) in enumerate(starts[:-1])],
                           list(range(run + 1, run + 1 + inner)))
            run += len(starts)
            open_row = (pa.RecordBatch.from_arrays([c.take(pa.array([inner])) for c in rows.columns], schema=rows.schema), starts[-1][1])
    if open_row is not None:
        yield made(open_row[0], [digest(open_row[1])], [run])


def drop_exact_copies(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row of each set of equal texts: that with the largest id, with all its columns.

    The rows themselves go through the content sort, so each is shuffled once.
    A null text counts as empty, a null id is the smallest; of rows with equal
    texts and the same id any one stays. Columns may have any name.
    """
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ident, text = F.col("row")["doc_id"], F.coalesce(F.col("row")["text"], F.lit(""))
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    keyed = packed.select("row", F.substring(ascii_lower(text), 1, 32).alias("head"), F.xxhash64(ascii_lower(text)).alias("h"))
    # the whole text is compared only where head and hash are equal
    ordered = (keyed.repartitionByRange(n, "head", "h", ident.desc())
               .sortWithinPartitions("head", "h", ascii_lower(text), ident.desc()).select("row", text.alias("text")))
    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), T.StructField("sha", T.StringType()),
                           T.StructField("range_id", T.IntegerType()), T.StructField("run", T.LongType())])
    runs = materialise(ordered.mapInArrow(_first_of_runs, schema), "content-runs")
    # at most two rows per range, whatever the number of documents
    edges = runs.where("sha is not null").select("sha", "range_id", "run", ident.alias("id"))
    place = Window.partitionBy("sha").orderBy(F.desc_nulls_last("id"), "range_id", "run")
    over = edges.withColumn("place", F.row_number().over(place)).where("place > 1").select("range_id", "run")
    return runs.join(F.broadcast(over), ["range_id", "run"], "left_anti").select("row.*")
