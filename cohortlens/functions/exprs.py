"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c: str | Column, digits: int) -> Column:
    """numpy-style rounding: scale, round half to even, unscale (C4, Q6).

    Spark's ``round`` is half-up on the decimal text and disagrees on values
    such as 1.005; ``rint`` rounds the scaled binary value like numpy does.
    """
    scale = float(10 ** digits)
    return F.rint(col_(c).cast("double") * F.lit(scale)) / F.lit(scale)


def whole_days(start: str | Column, end: str | Column) -> Column:
    """Whole 24-hour days from ``start`` to ``end``.

    This is the day field of the interval ``end - start``: 23:00 -> 01:00 the
    next day gives 0, unlike ``datediff`` which counts calendar dates.
    """
    return F.extract(F.lit("DAY"), col_(end) - col_(start)).cast("int")


def weekday_monday0(ts: str | Column) -> Column:
    """Monday = 0 ... Sunday = 6 (C3); ``dayofweek`` would give Sunday = 1."""
    return F.weekday(col_(ts)).cast("int")


def left_closed_bucket(value: str | Column, edges: Sequence[float],
                       labels: Sequence[str], open_top: bool = False) -> Column:
    """Label of the bin ``[edges[i], edges[i+1])`` holding ``value``.

    Values below the first edge, at or above the last edge, and nulls get no
    label, like a right-open cut. ``open_top=True`` extends the last bin to
    infinity.
    """
    assert len(edges) == len(labels) + 1
    v = col_(value)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = v >= F.lit(lo)
        if not (open_top and i == len(labels) - 1):
            cond = cond & (v < F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def add_equal_width_bin(df: DataFrame, x: str | Column, lo: str | Column, hi: str | Column,
                        n: int, out: str) -> DataFrame:
    """Add ``out``: the 0-based equal-width bin of ``x`` over ``[lo, hi]`` with
    ``n`` bins, the top edge closed.

    The bin is found from the quotient and then corrected against the actual
    edges ``lo + i * (hi - lo) / n`` so that a value on an edge lands in the
    bin that edge opens (what a histogram over linspace edges does). A
    constant column (lo = hi) yields bin 0. Built as successive columns so
    that ``lo``/``hi`` (often scalar subqueries) are evaluated once per row.
    """
    t = "__ewb"
    step = F.when(F.col(f"{t}_hi") > F.col(f"{t}_lo"),
                  (F.col(f"{t}_hi") - F.col(f"{t}_lo")) / F.lit(float(n))).otherwise(F.lit(1.0))
    edge = lambda i: F.col(f"{t}_lo") + i.cast("double") * F.col(f"{t}_step")
    xv = F.col(f"{t}_x")
    raw = F.floor((xv - F.col(f"{t}_lo")) / F.col(f"{t}_step")).cast("int")
    raw = F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1))
    r, d = F.col(f"{t}_raw"), F.col(f"{t}_down")
    return (df.withColumn(f"{t}_x", col_(x).cast("double"))
              .withColumn(f"{t}_lo", col_(lo).cast("double"))
              .withColumn(f"{t}_hi", col_(hi).cast("double"))
              .withColumn(f"{t}_step", step)
              .withColumn(f"{t}_raw", raw)
              .withColumn(f"{t}_down", F.when((r > 0) & (xv < edge(r)), r - 1).otherwise(r))
              .withColumn(out, F.when(F.col(f"{t}_hi") == F.col(f"{t}_lo"), F.lit(0))
                                .when((d < n - 1) & (xv >= edge(d + 1)), d + 1)
                                .otherwise(d).cast("int"))
              .drop(f"{t}_x", f"{t}_lo", f"{t}_hi", f"{t}_step", f"{t}_raw", f"{t}_down"))


def bin_edge(lo: str | Column, hi: str | Column, n: int, i: str | Column) -> Column:
    """Left edge of 0-based bin ``i`` (same arithmetic as ``add_equal_width_bin``)."""
    lov, hiv = col_(lo).cast("double"), col_(hi).cast("double")
    return lov + col_(i).cast("double") * ((hiv - lov) / F.lit(float(n)))
