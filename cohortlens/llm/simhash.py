"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 3 or less differ by at most one bit in one of
their 32-bit halves. Each fingerprint therefore emits, for either half, the
variants within half of that radius: itself, and (only when the half has an
even number of ones, since the ends of a one-bit step differ in parity) its
32 one-bit flips. Colliding pairs are deduplicated and verified at the full
width, inside buckets of at most ``bucket_rows`` distinct fingerprints.

Members of a larger bucket take the other, exact way, which has no buckets to
compare within: they emit their full 64-bit balls (radius 1, and radius 2 for
even fingerprints), and two fingerprints whose balls meet are linked by their
construction. At most 2,081 fingerprints lie within radius 2 of a variant, so
a group stays bounded whatever the input; the links of a variant form a star.

Only distinct fingerprints travel, so a group of copies counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise

SEED = 42
RADIUS = 3  # the two meeting radii below (1 and 2, or one half-width bit) are made for it


def fingerprint(text: str | None, width: int) -> int:
    """Unsigned 64-bit SimHash over ``width``-word shingles, repeats included.

    A-Z are lower-cased; fewer words than ``width`` make one shingle; no word
    (empty or null text) gives zero.
    """
    words = (text or "").encode().lower().split()  # splits on exactly x20 and x09-x0D
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        octets = hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text",
                 keep: str | None = None) -> DataFrame:
    """``doc_id, fp`` per row, fp the fingerprint as a signed long; ``keep`` names a string column to carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]],
                                             names=["doc_id", "fp", *([keep] if keep else [])])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *([keep] if keep else []))
    return source.mapInArrow(run, "doc_id bigint, fp bigint" + (f", {keep} string" if keep else ""))


def _ball(value: Column, bits: int, flip_if: Column) -> Column:
    """``value`` and, where ``flip_if``, its ``bits`` one-bit flips."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)),
                        lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    return F.when(flip_if, F.concat(F.array(value), flips)).otherwise(F.array(value))


def _half_variants(distinct: DataFrame) -> DataFrame:
    """``key, fp``: the variants of either half; the key carries which half it is."""
    high = F.shiftrightunsigned("fp", 32)
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))

    def side(half: Column, tag: int) -> Column:
        balls = _ball(half, 32, F.bit_count(half) % 2 == 0)
        return F.transform(balls, lambda v: v + F.lit(tag << 32))

    return distinct.select("fp", F.explode(F.concat(side(high, 0), side(low, 1))).alias("key"))


def _spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Verified links that span every component of one bounded bucket."""
    x = np.sort(fps).view(np.uint64)
    label = np.arange(len(x))
    near = [np.bitwise_count(x[at:at + 256, None] ^ x[None, :]) <= radius for at in range(0, len(x), 256)]
    while True:
        low = np.concatenate([np.where(m, label[None, :], len(x)).min(axis=1) for m in near])
        low = label[low]
        if (low == label).all():
            break
        label = low
    mine = np.flatnonzero(label != np.arange(len(x)))
    return list(zip(x[mine].view(np.int64).tolist(), x[label[mine]].view(np.int64).tolist()))


def _bucket_links(distinct: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """Links found in the half-width buckets of at most ``bucket_rows`` fingerprints."""
    variants = _half_variants(distinct)
    sizes = variants.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, bucket_rows))
    buckets = variants.join(sizes.select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("fps"))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            links = {p for fps in f["fps"] for p in _spanning_links(np.asarray(fps, np.int64), radius)}
            yield pd.DataFrame(sorted(links), columns=["a", "b"], dtype="int64")

    return buckets.select("fps").mapInPandas(verify, "a bigint, b bigint").distinct()


def _ball_links(distinct: DataFrame, bucket_rows: int) -> DataFrame:
    """Links among members of larger buckets, by meeting 64-bit balls."""
    variants = _half_variants(distinct)
    large = variants.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
    members = materialise(variants.join(large.select("key"), "key").select("fp").distinct(), "large-buckets")

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
        i, j = np.triu_indices(64, 1)
        two = one[i] ^ one[j]
        for f in frames:
            for at in range(0, len(f), 256):
                x = f["fp"].to_numpy()[at:at + 256].view(np.uint64)
                even = x[np.bitwise_count(x) % 2 == 0]
                near = np.concatenate([x[:, None], x[:, None] ^ one[None, :]], axis=1)
                far = even[:, None] ^ two[None, :]
                yield pd.DataFrame({
                    "v": np.concatenate([near.ravel(), far.ravel()]).view(np.int64),
                    "fp": np.concatenate([np.repeat(x, 65), np.repeat(even, len(two))]).view(np.int64),
                    "near": np.repeat([True, False], [near.size, far.size])})

    met = members.mapInPandas(emit, "v bigint, fp bigint, near boolean").groupBy("v").agg(
        F.min(F.when(F.col("near"), F.col("fp"))).alias("b"),
        F.count("*").alias("n"), F.collect_list("fp").alias("fps"))
    # a radius-1 member stands within 3 bits of everything that met it here
    return (met.where("n > 1 and b is not null").select(F.explode("fps").alias("a"), "b")
            .where("a <> b").distinct())


def near_duplicate_components(docs: DataFrame, width: int = 3, radius: int = RADIUS, bucket_rows: int = 4096,
                              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Fingerprints link at ``radius`` (3 at most) or fewer differing bits;
    ``component_id`` is the smallest non-null id that links reach, the row
    itself included (null only if no member has an id). Null and empty texts
    have fingerprint zero and link like any other. Repeated rows each get
    their row; extra columns are ignored; an empty table gives an empty result.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be 0 to {RADIUS}")
    fps = materialise(fingerprints(docs, width, id_col, text_col), "simhash")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    rooted = _rooted(distinct, radius, bucket_rows)
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _rooted(distinct: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """``distinct(fp, ...)`` with the ``root`` of each fingerprint's component."""
    links = _bucket_links(distinct, radius, bucket_rows)
    if radius == RADIUS:
        links = links.unionByName(_ball_links(distinct, bucket_rows))
    elif radius:
        met = _ball_links(distinct, bucket_rows)
        links = links.unionByName(met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    components = connected_components(links)
    return distinct.join(components, distinct.fp == components.node, "left").select(
        *distinct.columns, F.coalesce("root", "fp").alias("root"))


def drop_near_copies(docs: DataFrame, width: int = 3, radius: int = RADIUS, bucket_rows: int = 4096) -> DataFrame:
    """One row of each component of near copies, with all its columns.

    It is the one with the smallest id (rows without an id only stand for
    components without any), of several texts under that id the one with the
    smallest digest, and of repeated rows any one. Rows are decided by
    component, id and text, so null and repeated ids keep no near copy.
    Columns may have any name.
    """
    text = F.coalesce(F.col("row")["text"], F.lit(""))
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    named = packed.select(F.col("row")["doc_id"].alias("id"), F.sha2(text, 256).alias("sha"), text.alias("text"))
    # the digest takes the id's place through the fingerprints: equal texts have equal ones
    tagged = materialise(fingerprints(named.select("id", "sha", "text"), width, "id", "text", keep="sha"), "simhash")
    firsts = tagged.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = materialise(_rooted(materialise(firsts, "simhash-distinct"), radius, bucket_rows).select("fp", "first", "root"), "simhash-roots")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("low"))
    rows = tagged.join(rooted.select("fp", "root").join(lowest, "root"), "fp")
    stands = rows.where(F.col("doc_id").eqNullSafe(F.col("low"))).groupBy("root").agg(
        F.min("low").alias("stay_id"), F.min("sha").alias("stay_sha"))
    keyed = packed.select("row", F.col("row")["doc_id"].alias("id"), F.sha2(text, 256).alias("sha"))
    kept = keyed.join(stands.select("stay_id", "stay_sha"),
                      F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("sha") == F.col("stay_sha")), "left_semi")
    return kept.dropDuplicates(["id", "sha"]).select("row.*")
