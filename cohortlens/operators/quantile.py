"""Quantiles and upper-bound cuts.

One exact path at every size, with the linear interpolation between the two
neighbouring ranks that pandas uses by default (Q5). The wanted columns are
written once as doubles (8 bytes a value) into the shared folder, so whatever
joins lie below run once; every later pass scans those columns alone. The
first pass counts the values and takes ``percentile_approx`` (a bounded
sketch) at and around the wanted shares. The second counts the rows below and
at each of these ends and, if few lie between them, lists those. A rank then
either stands at an end, is in a list, or lies strictly between two ends, and
the next round looks there only. A round leaves about 6 / ``accuracy`` of the
rows, and the ends themselves never come back, so a value repeated a billion
times costs nothing and the search ends on any input: up to about 3 * 10^7
rows take two passes over the stored columns, 10^12 rows six. All ranks of all
columns share the passes; two numbers per end and at most ``LISTED`` values per
wanted rank reach the driver.

Nulls and NaN are skipped; infinities are values like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import round_half_even
from ..session import write_shared

ACCURACY = 10_000
#: values between two ends that a pass may list instead of looking there again
LISTED = 20_000
#: shares around a wanted one, in steps of 1 / accuracy, at which the first pass looks (the far ones for few rows)
OFFSETS = (0, 2, 512)


def _interpolate(lo_val: float, hi_val: float, pos: float) -> float:
    """Spark's percentile interpolation, term for term."""
    lower, higher = math.floor(pos), math.ceil(pos)
    if higher == lower or hi_val == lo_val:
        return float(lo_val)
    return (higher - pos) * lo_val + (pos - lower) * hi_val


def _number(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def stored_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` as doubles (NaN as null), written once to the shared folder.

    Rows are kept, nulls included, so counts over the result are counts over ``df``.
    """
    return write_shared(df.select(*[_number(c).alias(c) for c in dict.fromkeys(columns)]), "numbers")


def _pass(stored: DataFrame, aggregates: list[Column]) -> Row:
    """One pass over the stored columns."""
    return stored.agg(*aggregates).first()


def _inside(key: tuple) -> Column:
    """Values of the column strictly between the ends of a search interval."""
    column, lo, hi = key
    x = F.col(column)
    if lo is not None:
        x = F.when(x > F.lit(lo), x)
    return x if hi is None else F.when(x < F.lit(hi), x)


def _shares_of_ranks(ranks: set[int], n: int, accuracy: int) -> list[float]:
    """Shares at (or, beyond the sketch's resolution, around) each rank."""
    slack = 0 if n <= accuracy else 2 * math.ceil(n / accuracy)
    around = {min(max(r + d, 0), n - 1) for r in ranks for d in {-slack, 0, slack}}
    return [(r + 0.5) / n for r in sorted(around)]


def _shares_of(q: float, accuracy: int) -> set[float]:
    return {0.0, 1.0} | {min(max(q + d * o / accuracy, 0.0), 1.0) for o in OFFSETS for d in (-1, 1)}


def _to_list(ranks: set[int], n: int, shares: list[float], ends: list[float], accuracy: int) -> list[tuple[float, float]]:
    """For each rank the two ends that should enclose it, if few values lie between them."""
    out = set()
    for r in ranks:
        slack = 1.5 / accuracy if n > accuracy else 0.0
        low = [i for i, s in enumerate(shares) if s <= (r - 0.5) / n - slack]
        high = [i for i, s in enumerate(shares) if s >= (r + 1.5) / n + slack]
        a, b = (low[-1] if low else 0), (high[0] if high else len(shares) - 1)
        if ends[a] < ends[b] and (shares[b] - shares[a] + 2 / accuracy) * n <= LISTED:
            out.add((ends[a], ends[b]))
    return sorted(out)


def exact_quantiles(df: DataFrame, targets: list[tuple[str, float]], accuracy: int = ACCURACY,
                    stored: bool = False) -> dict[tuple[str, float], float | None]:
    """Exact ``percentile(column, q)`` for every ``(column, q)`` target (None without a value).

    ``stored`` says that ``df`` is what :func:`stored_columns` has written.
    """
    cols = sorted({c for c, _ in targets})
    data = df if stored else stored_columns(df, cols)
    shares = {(c, None, None): sorted(set().union(*[_shares_of(q, accuracy) for d, q in targets if d == c])) for c in cols}
    first = _pass(data, [x for k in shares for x in (F.count(F.col(k[0])), F.percentile_approx(_inside(k), shares[k], accuracy))])
    n_of = dict(zip(cols, first[::2]))
    # search interval -> (rows at or below its lower end, rows inside, ranks wanted inside)
    open_: dict[tuple, tuple[int, int, set[int]]] = {}
    for c, q in targets:
        if n_of[c]:
            pos = (n_of[c] - 1) * q
            open_.setdefault((c, None, None), (0, n_of[c], set()))[2].update({math.floor(pos), math.ceil(pos)})
    sketched = {k: s for k, s in zip(shares, first[1::2]) if k in open_}
    found: dict[tuple[str, int], float] = {}
    while open_:
        ends, listed, wanted = {}, {}, []
        for k, (below, n, ranks) in open_.items():
            ends[k] = sorted(set(sketched[k]))
            listed[k] = _to_list({r - below for r in ranks}, n, shares[k], sketched[k], accuracy)
            for e in ends[k]:
                wanted += [F.count_if(_inside(k) < F.lit(e)), F.count_if(_inside(k) == F.lit(e))]
            for a, b in listed[k]:
                x = _inside((k[0], a, b))
                wanted.append(F.collect_list(F.when(~x.isin(ends[k]), x)))
        counts = iter(_pass(data, wanted))
        following: dict[tuple, tuple[int, int, set[int]]] = {}
        for key, (below, n, ranks) in open_.items():
            c, lo, hi = key
            marks = [(e, below + next(counts), next(counts)) for e in ends[key]]
            lists = [(a, b, next(counts)) for a, b in listed[key]]
            for rank in ranks:
                left, seen, right, until = lo, below, hi, below + n
                for e, less, equal in marks:
                    if less <= rank < less + equal:
                        found[(c, rank)] = float(e)
                        break
                    if rank < less:
                        right, until = e, less
                        break
                    left, seen = e, less + equal
                if (c, rank) in found:
                    continue
                near = next((xs for a, b, xs in lists if left is not None and right is not None and a <= left and right <= b), None)
                if near is not None:
                    found[(c, rank)] = sorted(x for x in near if left < x < right)[rank - seen]
                else:
                    following.setdefault((c, left, right), (seen, until - seen, set()))[2].add(rank)
        open_ = following
        if open_:
            shares = {k: _shares_of_ranks({r - below for r in ranks}, n, accuracy) for k, (below, n, ranks) in open_.items()}
            sketched = dict(zip(open_, _pass(data, [F.percentile_approx(_inside(k), shares[k], accuracy) for k in open_])))
    out: dict[tuple[str, float], float | None] = {}
    for c, q in targets:
        pos = (n_of[c] - 1) * q
        out[(c, q)] = _interpolate(found[(c, math.floor(pos))], found[(c, math.ceil(pos))], pos) if n_of[c] else None
    return out


def threshold_scalar(df: DataFrame, column: str, q: float = 0.99, stored: bool = False) -> Column:
    """The ``q`` quantile as a literal (found by a few bounded aggregates when called)."""
    return F.lit(exact_quantiles(df, [(column, q)], stored=stored)[(column, q)]).cast("double")


def outlier_cut(df: DataFrame, column: str, q: float = 0.99, numbers: DataFrame | None = None) -> DataFrame:
    """Rows with ``column <= quantile(q)``; null and NaN values are dropped (Q14).

    ``numbers`` is what :func:`stored_columns` has written of ``df``, if it has.
    """
    if numbers is None:
        numbers = stored_columns(df, [column])
    return df.where(_number(column) <= threshold_scalar(numbers, column, q, stored=True))


def outlier_volume(df: DataFrame, column: str, q: float = 0.99) -> DataFrame:
    """Rows before and after the cut, and the share removed in % (2 dp).

    Counted on the stored column: what lies below ``df`` runs once.
    """
    numbers = stored_columns(df, [column])
    thr = threshold_scalar(numbers, column, q, stored=True)
    counted = numbers.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(F.col(column) <= thr).alias("rows_after"),
    )
    return counted.select(
        F.col("rows_before").cast("long"), F.col("rows_after").cast("long"),
        (F.col("rows_before") - F.col("rows_after")).cast("long").alias("rows_removed"),
        round_half_even(F.try_divide((F.col("rows_before") - F.col("rows_after")).cast("double"),
                                     F.col("rows_before")) * F.lit(100.0), 2).alias("removed_pct"),
    )
