"""Document fingerprints: a quartile bucket digest.

Hashed byte triplets are counted in 256 buckets; the digest holds two bits
per bucket (which quartile of the counts it reaches), the length class and a
check byte. Digests are compared by a bounded difference score.

For the neighbour comparison the documents are cut into id ranges whose upper
ends are ids of the table; a document that ends a range is sent to the range
above as well, so each range holds its own documents and the one that follows
them, and the texts are shuffled once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
#: difference of two 2-bit codes; opposite quartiles count double
_STEP = np.array([[abs(a - b) if abs(a - b) < 3 else 6 for b in range(4)] for a in range(4)], np.int64)
LENGTH_WEIGHT, LENGTH_CAP, CHECK_WEIGHT = 12, 8, 1
SCALE = BUCKETS * 2  # a difference of this much or more is no likeness


def digest(data: bytes) -> str:
    """Hex digest: length class, check byte, 64 bytes of quartile codes."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(b) - 2, 0), 1 << 20):
        s = b[at:at + (1 << 20) + 2]
        h = s[:-2] * np.uint32(0x9E3779B1) + s[1:-1] * np.uint32(0x85EBCA6B) + s[2:] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    ranked = np.sort(counts)
    limits = ranked[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > limits[None, :]).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    size = min(255, int(math.log2(len(data) + 1) * 8))
    check = hashlib.sha256(data).digest()[0]
    return bytes([size, check]).hex() + packed.tobytes().hex()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from a difference of ``SCALE`` on."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    shifts = np.array([6, 4, 2, 0], np.uint8)
    cx, cy = (x[2:, None] >> shifts) & 3, (y[2:, None] >> shifts) & 3
    difference = int(_STEP[cx, cy].sum())
    apart = abs(int(x[0]) - int(y[0]))
    difference += min(apart, LENGTH_CAP) * LENGTH_WEIGHT // LENGTH_CAP + CHECK_WEIGHT * (x[1] != y[1])
    return 1.0 - min(difference, SCALE) / SCALE


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` per row, without a shuffle; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [digest((t.as_py() or "").encode()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fingerprint string")


SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, descending; the follower of the last document comes behind it with ``own`` false."""

    def row(doc_id, text, mark, follower, follower_mark) -> tuple:
        cut = len(text) // 3
        edited = text[:len(text) - cut] + follower[:cut]
        data = edited.encode()
        edited_mark = digest(data)
        return (doc_id, len(text), hashlib.sha256(data).hexdigest(), mark, edited_mark,
                likeness(mark, edited_mark), likeness(mark, follower_mark))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                          names=[f.split()[0] for f in SCHEMA.split(", ")])

    held, rows, closed = None, [], False
    for b in batches:
        for doc_id, text, own in zip(*(b.column(k) for k in range(3))):
            if closed:
                continue
            text = text.as_py()
            mark = digest(text.encode())
            if held is not None:
                rows.append(row(*held, text, mark))
            held = (doc_id.as_py(), text, mark)
            closed = not own.as_py()  # only the first follower counts
            if len(rows) >= 2_000:
                yield batch(rows)
                rows = []
    if rows:
        yield batch(rows)


def _ends_below(x: Column, ends: list[int]) -> Column:
    """How many of the sorted ``ends`` are smaller, by halving (a range count of thousands stays cheap per row)."""
    array = F.lit(ends)
    whole = F.struct(F.lit(0).alias("lo"), F.lit(len(ends)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        smaller = F.get(array, middle) < x
        return F.struct(F.when(smaller & (s["lo"] < s["hi"]), middle + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(smaller | (s["lo"] >= s["hi"]), s["hi"]).otherwise(middle).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(ends).bit_length())), whole, halve, lambda s: s["lo"])


def compare_with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row.

    The next document is the following row in descending ``doc_id`` (nulls
    last, repeated ids by descending text); after the last comes the first. A
    single row is its own next. A null or empty text counts as empty. Extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # at most n - 1 ids of the table, and one row count
    steps = [i / n for i in range(1, n)] or [0.5]
    found = docs.select(F.percentile_approx(F.col("doc_id").cast("bigint"), steps, 10_000).alias("cuts"),
                        F.max(F.col("doc_id").cast("bigint")).alias("top"),
                        F.min(F.col("doc_id").cast("bigint")).alias("low"),
                        F.sum(F.col("doc_id").isNull().cast("int")).alias("nulls")).first()
    cuts = sorted(set(found["cuts"] or ()) - {found["top"]})
    # range k holds ids up to cuts[k]; the last one the rest; nulls go to -1
    def place(x):
        if not cuts:
            return F.when(x.isNull(), -1).otherwise(0)
        return F.when(x.isNull(), -1).otherwise(_ends_below(x, cuts))

    own = place(F.col("doc_id"))
    last = -1 if found["nulls"] else 0
    # the head of a range follows the range above; the head of all follows the last range
    ends = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    if found["nulls"] and found["top"] is not None:
        # the lowest range is followed by the nulls, those by the head of all
        above_of_nulls = F.when(F.col("doc_id").isNull(), 0)
    else:
        above_of_nulls = F.lit(None).cast("int")
    is_top = F.col("doc_id").eqNullSafe(F.lit(found["top"]).cast("bigint"))
    copies = F.array_compact(F.array(
        F.struct(own.alias("range"), F.lit(True).alias("own")),
        F.when(ends, F.struct((own + 1).alias("range"), F.lit(False).alias("own"))),
        F.when(above_of_nulls.isNotNull(), F.struct(above_of_nulls.alias("range"), F.lit(False).alias("own"))),
        F.when(is_top, F.struct(F.lit(last).alias("range"), F.lit(False).alias("own")))))
    dealt = rows.withColumn("copy", F.explode(copies)).select("doc_id", "text", "copy.range", "copy.own")
    # in one range all followers are lower than its own rows, save the head of all behind the last range
    ordered = (dealt.repartitionById(len(cuts) + 2, F.col("range") + 1)
               .sortWithinPartitions(F.col("own").desc(), F.col("doc_id").desc_nulls_last(), F.col("text").desc()))
    return ordered.select("doc_id", "text", "own").mapInArrow(_compare, SCHEMA)
