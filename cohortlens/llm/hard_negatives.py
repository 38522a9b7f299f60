"""Hard-negative mining with rotated one-bit codes.

Integer vectors are rotated (random signs and Walsh-Hadamard transforms, an
orthogonal map) and coded by the signs of the rotated components: ``LEVELS``
codes, each for what the codes before it leave, with the alignment of code and
vector stored beside it and the norm of the last residual. A query's rotated
components are cut into ``PLANES`` bit planes, so its product with a code is a
weighted sum of popcounts. The true score lies within the Cauchy-Schwarz bound
of the residuals around that estimate, always; a candidate whose interval
cannot reach the best scores found so far is dropped, and every other one is
scored in integers. Results are therefore exact.

Anchors and rows meet in cells of a grid (a stated query set against all rows,
in blocks): a cell holds about ``CELL_ROWS`` rows and ``CELL_ANCHORS`` anchors,
whatever the labels, so no label or repeated vector makes a hot task. A cell
returns its best few per anchor, and Spark ranks them over the cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

LEVELS = 4
PLANES = 6
CELL_ROWS = 4096
CELL_ANCHORS = 2048
CHUNK = (128, 1024)  # anchors and rows of one array step
SEED = 20_011
LOW_PERCENT, HIGH_PERCENT = 50, 95
NEVER = 1 << 62

CODED = ("row_key bigint, vec_id bigint, label bigint, anchor boolean, ints binary, codes binary, aligns binary, "
         "coded_norm double, rest double")
FOUND = "anchor_key bigint, place int, row_key bigint, vec_id bigint, score bigint"

NOTHING = pa.table({n: pa.array([], pa.int32() if n == "place" else pa.int64())
                    for n in ("anchor_key", "place", "row_key", "vec_id", "score")})


class Rotation:
    """An orthogonal map of ``dim`` components into the next power of two (64 at least)."""

    def __init__(self, dim: int):
        self.width = max(64, 1 << max(0, dim - 1).bit_length())
        self.signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (2, self.width))

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        out[:, :vectors.shape[1]] = vectors
        for signs in self.signs:
            out *= signs
            h = 1
            while h < self.width:
                out = out.reshape(len(vectors), -1, 2, h)
                out = np.concatenate([out[:, :, :1] + out[:, :, 1:], out[:, :, :1] - out[:, :, 1:]], axis=2)
                h *= 2
            out = out.reshape(len(vectors), self.width) / math.sqrt(self.width)
        return out


def words(bits: np.ndarray) -> np.ndarray:
    """Bits of the last axis packed into unsigned 64-bit words."""
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def sign_codes(rotated: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes ``(n, levels, words)``, alignments ``(n, levels)``, norm of the coded part, norm of the residual.

    The alignment of a level is the mean absolute residual, the multiple of
    the sign vector that lies nearest to it.
    """
    left = rotated.copy()
    codes, aligns = [], []
    for _ in range(levels):
        ones = left >= 0
        a = np.abs(left).mean(axis=1)
        left -= np.where(ones, a[:, None], -a[:, None])
        codes.append(words(ones))
        aligns.append(a)
    return (np.stack(codes, 1), np.stack(aligns, 1), np.linalg.norm(rotated - left, axis=1), np.linalg.norm(left, axis=1))


class Query:
    """Bit planes of rotated anchors and what their rounding leaves."""

    def __init__(self, rotated: np.ndarray, planes: int = PLANES):
        half = 1 << (planes - 1)
        top = np.abs(rotated).max(axis=1, initial=0.0)
        self.step = np.where(top > 0, top / (half - 0.5), 1.0)
        k = np.clip(np.rint(rotated / self.step[:, None]), 1 - half, half - 1)
        self.error = np.linalg.norm(rotated - k * self.step[:, None], axis=1)
        self.norm = np.linalg.norm(rotated, axis=1)
        self.total = k.sum(axis=1)
        shifted = (k + half).astype(np.int64)
        self.planes = np.stack([words((shifted >> b) & 1 == 1) for b in reversed(range(planes))], 0)
        self.half = half

    def interval(self, at: slice, rows: Rows, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible score of the anchors ``at`` with the rows ``of``."""
        n = len(self.step[at])
        estimate = np.zeros((n, len(of)))
        for level in range(rows.codes.shape[1]):
            acc = np.zeros((n, len(of)), np.int32)
            for plane in self.planes:
                acc <<= 1
                for w in range(plane.shape[1]):
                    acc += np.bitwise_count(plane[at, w][:, None] & rows.codes[of, level, w][None, :])
            product = 2.0 * acc - 2.0 * self.half * rows.ones[of, level] - self.total[at][:, None]
            estimate += product * rows.aligns[of, level]
        estimate *= self.step[at][:, None]
        # <q, x> = estimate + <rounding, coded part> + <q, residual>; the last term covers float rounding
        wide = (np.outer(self.error[at], rows.coded_norm[of]) + np.outer(self.norm[at], rows.rest[of])
                + 1e-9 * np.outer(self.norm[at], rows.coded_norm[of] + rows.rest[of]) + 1e-6)
        return estimate - wide, estimate + wide


def _fixed(column, dtype: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(n, -1)


def _ints(column, dim: int) -> np.ndarray:
    return _fixed(column, "<i8", len(column)) if dim else np.zeros((len(column), 0), np.int64)


class Rows:
    """Coded rows of a cell as arrays."""

    def __init__(self, t: pa.Table, dim: int, levels: int):
        n = len(t)
        self.key, self.label = t["row_key"].to_numpy(), t["label"].to_numpy()
        self.null_id = t["vec_id"].is_null().to_numpy()
        self.id = t["vec_id"].fill_null(0).to_numpy()
        self.ints = _ints(t["ints"], dim)
        self.codes = _fixed(t["codes"], "<u8", n).reshape(n, levels, -1)
        self.ones = np.bitwise_count(self.codes).sum(axis=2, dtype=np.int64)
        self.aligns = _fixed(t["aligns"], "<f8", n)
        self.coded_norm, self.rest = t["coded_norm"].to_numpy(), t["rest"].to_numpy()


class Anchors:
    """Anchors of a cell as arrays."""

    def __init__(self, t: pa.Table, dim: int):
        self.key, self.label = t["anchor_key"].to_numpy(), t["anchor_label"].to_numpy()
        self.ints = _ints(t["anchor_ints"], dim)


class Best:
    """The best ``k`` rows of each slot: higher scores first, then smaller ids (null ids last)."""

    def __init__(self, slots: int, k: int, rows: Rows):
        self.k, self.rows, self.slots = k, rows, slots
        self.slot, self.row, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, -np.inf)  # what a further row must reach

    def add(self, slot: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        if not len(slot):
            return
        slot, row, score = (np.concatenate(x) for x in ((self.slot, slot), (self.row, row), (self.score, score)))
        order = np.lexsort((self.rows.key[row], self.rows.id[row], self.rows.null_id[row], -score, slot))
        slot, row, score = slot[order], row[order], score[order]
        first = np.searchsorted(slot, slot)
        keep = np.arange(len(slot)) - first < self.k
        self.slot, self.row, self.score = slot[keep], row[keep], score[keep]
        last = np.arange(len(slot)) - first == self.k - 1
        self.least[slot[last]] = score[last]


def _scores(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs."""
    out = np.empty(len(a), np.int64)
    step = max(1, (1 << 21) // max(1, rows.shape[1]))
    for i in range(0, len(a), step):
        out[i:i + step] = np.einsum("ij,ij->i", anchors[a[i:i + step]], rows[r[i:i + step]])
    return out


def _chunks(n: int) -> Iterator[tuple[int, int]]:
    """Row ranges that grow, since the first ones have no scores to compare with."""
    i, size = 0, 64
    while i < n:
        yield i, min(n, i + size)
        i, size = i + size, min(2 * size, CHUNK[1])


def _found(anchor_key: np.ndarray, best: Best, per_anchor: int) -> pa.Table:
    rows = best.rows
    return pa.table({
        "anchor_key": pa.array(anchor_key[best.slot // per_anchor], pa.int64()),
        "place": pa.array(best.slot % per_anchor, pa.int32()),
        "row_key": pa.array(rows.key[best.row], pa.int64()),
        "vec_id": pa.array(rows.id[best.row], pa.int64(), mask=rows.null_id[best.row]),
        "score": pa.array(best.score, pa.int64())})


def _positives_of_cell(dim: int, levels: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return NOTHING
        rows, anchors = Rows(left, dim, levels), Anchors(right, dim)
        best = Best(len(anchors.key), k, rows)
        rotate = Rotation(dim)
        by_label = np.argsort(rows.label, kind="stable")
        edges = {v: (i, j) for v, i, j in _groups(rows.label[by_label])}
        anchors_by = np.argsort(anchors.label, kind="stable")
        for value, s, e in _groups(anchors.label[anchors_by]):
            if value not in edges:
                continue
            mine = by_label[slice(*edges[value])]
            for p in range(s, e, CHUNK[0]):
                these = anchors_by[p:min(e, p + CHUNK[0])]
                query = Query(rotate(anchors.ints[these]))
                for i, j in _chunks(len(mine)):
                    of = mine[i:j]
                    _, high = query.interval(slice(None), rows, of)
                    a, r = np.nonzero(high >= best.least[these][:, None])
                    a, r = these[a], of[r]
                    other = anchors.key[a] != rows.key[r]
                    a, r = a[other], r[other]
                    best.add(a, r, _scores(anchors.ints, rows.ints, a, r))
        return _found(anchors.key, best, 1)
    return run


def _groups(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, start and end of each run of a sorted array."""
    if len(values):
        cuts = np.flatnonzero(np.diff(values)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
            yield int(values[i]), i, j


def _negatives_of_cell(dim: int, levels: int, places: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return NOTHING
        rows, anchors = Rows(left, dim, levels), Anchors(right, dim)
        n = len(anchors.key)
        low, high = np.full((n, places), NEVER), np.full((n, places), -NEVER)
        for i, (lows, highs) in enumerate(zip(right["lows"].to_pylist(), right["highs"].to_pylist())):
            low[i, :len(lows)], high[i, :len(highs)] = lows, highs
        best = Best(n * places, k, rows)
        rotate = Rotation(dim)
        everything = np.arange(len(rows.key))
        for p in range(0, n, CHUNK[0]):
            at = slice(p, min(n, p + CHUNK[0]))
            query = Query(rotate(anchors.ints[at]))
            for i, j in _chunks(len(everything)):
                of = everything[i:j]
                least, most = query.interval(slice(None), rows, of)
                need = np.maximum(low[at], best.least.reshape(n, places)[at])
                hit = np.zeros(least.shape, bool)
                for w in range(places):
                    hit |= (most >= need[:, w, None]) & (least <= high[at, w, None])
                hit &= anchors.label[at][:, None] != rows.label[of][None, :]
                a, r = np.nonzero(hit)
                a, r = a + p, of[r]
                score = _scores(anchors.ints, rows.ints, a, r)
                inside = (score[:, None] >= low[a]) & (score[:, None] <= high[a])
                pair, w = np.nonzero(inside)
                best.add(a[pair] * places + w, r[pair], score[pair])
        return _found(anchors.key, best, places)
    return run


def code_rows(rows: DataFrame, dim: int, levels: int = LEVELS) -> DataFrame:
    """``CODED`` rows of ``rows(vec_id, label, anchor, ints array<bigint>)``; a shorter vector ends in zeros."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotate = Rotation(dim)
        for b in batches:
            lists, n = b.column(4), b.num_rows
            sizes = lists.value_lengths().to_numpy()
            ints = np.zeros((n, dim), np.int64)
            ints[np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = \
                lists.flatten().to_numpy()
            codes, aligns, coded_norm, rest = sign_codes(rotate(ints), levels)
            raw = [[m[i].tobytes() for i in range(n)] for m in (ints.astype("<i8"), codes, aligns.astype("<f8"))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], *(pa.array(x, pa.binary()) for x in raw), pa.array(coded_norm), pa.array(rest)],
                names=[f.split()[0] for f in CODED.split(", ")])

    keyed = rows.select(F.monotonically_increasing_id().alias("row_key"), "vec_id", "label", "anchor", "ints")
    return keyed.mapInArrow(run, CODED)


def _grid(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int):
    """Both sides grouped by cell; row parts x anchor parts, each side copied along the other."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_parts = max(-(-n_rows // CELL_ROWS), min(tasks, -(-n_rows // 256)), 1)
    anchor_parts = max(1, -(-n_anchors // CELL_ANCHORS))
    part = F.pmod(F.xxhash64("row_key"), F.lit(row_parts))
    there = F.pmod(F.xxhash64("anchor_key"), F.lit(anchor_parts))
    cells = F.sequence(part * anchor_parts, part * anchor_parts + (anchor_parts - 1))
    left = rows.withColumn("cell", F.explode(cells))
    right = anchors.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(row_parts - 1)),
                                                             lambda i: i * anchor_parts + there)))
    return left.groupBy("cell").cogroup(right.groupBy("cell"))


def _ranked(found: DataFrame, k: int, *slot: str) -> DataFrame:
    order = Window.partitionBy(*slot).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 3, levels: int = LEVELS) -> DataFrame:
    """Hard negatives of ``rows(vec_id, label, anchor, ints)``; ``ints`` is array<bigint>.

    Per anchor row and each of its best ``positives`` other rows of the same
    label, the best ``negatives`` rows of another label with
    ``LOW_PERCENT * positive_score <= 100 * negative_score <= HIGH_PERCENT *
    positive_score``: ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``. Higher scores come first, ties by
    smaller ``vec_id`` (a null one last). A negative positive_score has no
    negatives, a zero one those of score zero.

    Rows with a null label, vector or component take no part. A repeated row
    is a row of its own: another row's positive, and an anchor again. A
    shorter vector counts as if it ended in zeros. An empty table gives an
    empty result. Products that might not fit a long are an error.
    """
    usable = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.coalesce("anchor", F.lit(False)).alias("anchor"),
                         "ints").where("label is not null and ints is not null and forall(ints, x -> x is not null)")
    n, n_anchors, dim, top = usable.agg(
        F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("ints")), F.lit(0)),
        F.coalesce(F.max(F.expr("aggregate(ints, cast(0 as double), (m, x) -> greatest(m, abs(cast(x as double))))")), F.lit(0.0))).first()
    if top * top * max(dim, 1) * 100 >= 2.0 ** 62:
        raise ValueError(f"inner products may not fit a long: {dim} components up to {top:.3g}")
    coded = materialise(code_rows(usable, dim, levels), "negatives-codes")
    anchors = coded.where("anchor").select(F.col("row_key").alias("anchor_key"), F.col("vec_id").alias("anchor_id"),
                                           F.col("label").alias("anchor_label"), F.col("ints").alias("anchor_ints"))
    found = _grid(coded, anchors, n, n_anchors).applyInArrow(_positives_of_cell(dim, levels, positives), FOUND)
    best = _ranked(found, positives, "anchor_key").join(anchors.select("anchor_key", "anchor_id"), "anchor_key").select(
        "anchor_key", "anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"))
    best = materialise(best, "negatives-positives")
    # ceil(LOW p / 100) to floor(HIGH p / 100); nothing lies between for p < 0
    places = F.sort_array(F.collect_list(F.struct("place", "positive_score")))
    windows = best.groupBy("anchor_key").agg(places.alias("w")).select(
        "anchor_key",
        F.expr(f"transform(w, x -> if(x.positive_score < 0, {NEVER}L, ({LOW_PERCENT} * x.positive_score + 99) div 100))").alias("lows"),
        F.expr(f"transform(w, x -> if(x.positive_score < 0, -{NEVER}L, {HIGH_PERCENT} * x.positive_score div 100))").alias("highs"))
    asked = anchors.join(windows, "anchor_key")
    found = _grid(coded, asked, n, n_anchors).applyInArrow(_negatives_of_cell(dim, levels, positives, negatives), FOUND)
    return _ranked(found, negatives, "anchor_key", "place").join(best, ["anchor_key", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
