"""Helpers shared by the document operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage in files that every executor sees, so a lost executor
    costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The ``documents`` table, pruned to ``columns``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*columns)


def row_slices(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` text bytes each (a longer row stands alone)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def ascii_lower(column):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashed_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` of the distinct ``rows(doc_id, key)`` per key: those with the smallest hashes of the id.

    Hashes are first counted by their bit length, so that only the rows up to
    the length at which a key has ``n`` (about ``2 n`` at most) are ranked, not
    all rows of a key. One row per key is broadcast; a caller's model holds
    more than that for each key. The sample does not depend on the partitioning.
    """
    rows = rows.select("doc_id", key).distinct().withColumn("_hash", F.xxhash64("doc_id"))
    # the signed order as an unsigned one: low values have few bits
    rows = rows.withColumn("_bits", F.length(F.bin(F.col("_hash").bitwiseXOR(F.lit(-(1 << 63))))))
    upto = Window.partitionBy(key).orderBy("_bits")  # at most 64 rows per key
    levels = rows.groupBy(key, "_bits").count().withColumn("_upto", F.sum("count").over(upto))
    limits = levels.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("_upto") >= n, F.col("_bits"))), F.lit(64)).alias("_most"))
    near = rows.join(F.broadcast(limits), key).where("_bits <= _most")
    place = Window.partitionBy(key).orderBy("_hash", "doc_id")
    return near.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= n).select("doc_id", key)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the undirected ``edges(a, b)``; root is the smallest node.

    Alternates the large-star and small-star steps. Each step keeps one row
    per edge and reads only the minimum of a neighbourhood (a partially
    aggregated ``min``), so a hub never gathers its neighbours in one place;
    each round is written to the shared folder. Nodes without an edge are not
    returned; an edge from a node to itself or with a null end is ignored.
    """
    current = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    state = _edge_state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = linked.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        current = materialise(small, "cc")
        previous, state = state, _edge_state(current)
        if state == previous:
            break
    roots = current.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    tops = roots.select(F.col("root").alias("node"), "root").distinct()
    return roots.unionByName(tops)


def _edge_state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return int(row[0]), row[1]
