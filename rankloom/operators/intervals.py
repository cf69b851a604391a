"""Joins of intervals by position bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(a: DataFrame, b: DataFrame, by: list[str], width: int, starts: tuple[str, str] = ("start", "start_b"), ends: tuple[str, str] = ("end", "end_b")) -> DataFrame:
    """Pairs of rows of ``a`` and ``b``, equal in ``by``, whose closed intervals have a position in common, each pair once.

    An interval is put into every bin of ``width`` positions that it touches; both sides are joined by group and bin, and a pair counts only in
    the bin where the later start lies. Positions aren't expanded, and a group is spread over its bins. Pick a width of about an interval's length: wider
    bins hold pairs that don't meet, narrower ones more copies of a row. Intervals whose end is before their start, or null, meet none.
    """
    def binned(df, start, end):
        cut = lambda c: F.floor(F.col(c) / width)
        return df.where(F.col(start) <= F.col(end)).withColumn("__bin", F.explode(F.sequence(cut(start), cut(end))))

    joined = binned(a, starts[0], ends[0]).join(binned(b, starts[1], ends[1]), [*by, "__bin"])
    later = F.greatest(F.col(starts[0]), F.col(starts[1]))
    return joined.where((later <= F.least(F.col(ends[0]), F.col(ends[1]))) & (F.floor(later / width) == F.col("__bin"))).drop("__bin")
