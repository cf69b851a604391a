"""Conserved interaction sites: coverage of aligned positions, peaks, overlaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import saved
from .ranking import segmented


def coverage(intervals: DataFrame, by: str = "cluster", start: str = "start1", end: str = "end1", p: str = "p") -> DataFrame:
    """(by, pos, weight): sum of 1 - p over the intervals that cover a position.

    Every interval gives a step up and a step down; steps are summed per position before they are run up, so what is
    shuffled grows with distinct positions and not with the intervals' lengths. Sums run by ranges: a group can be of any size.
    """
    up = intervals.select(by, F.col(start).alias("pos"), (1 - F.col(p)).alias("d"))
    down = intervals.select(by, (F.col(end) + 1).alias("pos"), (F.col(p) - 1).alias("d"))
    steps = up.unionByName(down).groupBy(by, "pos").agg(F.sum("d").alias("d"))
    level = segmented(steps, [by], ["pos"], weight=("sum", F.col("d")), next=("next", F.col("pos"))).drop("d")
    level = level.where(F.col("next") > F.col("pos"))
    return level.select(by, F.explode(F.sequence("pos", F.col("next") - 1)).alias("pos"), "weight").where(F.col("weight") > 1e-12)


def frequency(intervals: DataFrame, by: str = "cluster", start: str = "start1", end: str = "end1") -> DataFrame:
    """(by, pos, n): intervals that cover a position."""
    return coverage(intervals.withColumn("__p", F.lit(0.0)), by, start, end, "__p").select(by, "pos", F.round("weight").cast("long").alias("n"))


def peaks(cover: DataFrame, by: str = "cluster", share: float = 0.4) -> DataFrame:
    """(by, start, end): around the outermost maxima as far as the weight stays at or above ``share`` of the maximum."""
    cover = saved(cover.select(by, "pos", F.round("weight", 9).alias("r")))
    top = cover.groupBy(by).agg(F.max("r").alias("top"))
    tops = cover.join(top, by).where("r = top").groupBy(by).agg(F.max("top").alias("top"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    high = cover.join(tops, by).where(F.col("r") >= F.round(share * F.col("top"), 9)).select(by, "pos")
    # where a run begins: a high position that doesn't follow one; where it has ended: one that follows and isn't high
    step = high.select(by, "pos", F.lit(1).alias("here"), F.lit(0).alias("after")).unionByName(high.select(by, (F.col("pos") + 1).alias("pos"), F.lit(0).alias("here"), F.lit(1).alias("after")))
    step = step.groupBy(by, "pos").agg(F.max("here").alias("here"), F.max("after").alias("after")).where("here <> after").join(tops, by)
    start = F.max(F.when((F.col("here") == 1) & (F.col("pos") <= F.col("first")), F.col("pos")))
    end = F.min(F.when((F.col("after") == 1) & (F.col("pos") > F.col("last")), F.col("pos") - 1))
    return step.groupBy(by).agg(start.alias("start"), end.alias("end"))


def two_peaks(weights: np.ndarray, share: float = 0.4, second: float = 0.9, least_values: int = 10, own_threshold: bool = False) -> list[tuple[int, int]]:
    """One or two peaks (from 1) of a coverage array.

    A second one needs more than ``least_values`` distinct weights outside the first, a maximum of at least ``second``
    of the first's, and no maximum inside the first. Its right end is scanned with the first peak's threshold, as the
    method has it; ``own_threshold`` uses its own.
    """
    w = np.asarray(weights, float)

    def reach(at: int, step: int, limit: float) -> int:
        while 0 <= at < len(w) and w[at] >= limit:
            at += step
        return at - step

    top = w.max()
    tops = np.flatnonzero(w == top)
    s, e = reach(tops[0], -1, share * top), reach(tops[-1], 1, share * top)
    found = [(int(s) + 1, int(e) + 1)]
    outside = np.delete(w, np.arange(s, e + 1))
    values = np.unique(outside)
    if len(values) > least_values:
        nxt = values[-1]
        at = np.flatnonzero(w == nxt)
        if not ((at >= s) & (at <= e)).any() and nxt / top >= second:
            right = share * (nxt if own_threshold else top)
            found.append((int(reach(at[0], -1, share * nxt)) + 1, int(reach(at[-1], 1, right)) + 1))
    return found


def peak_pairs(cover: DataFrame, by: str = "cluster", **options) -> DataFrame:
    """(by, k, start, end) with one or two peaks per group; a group is one alignment's positions."""
    kind = cover.schema[by].dataType.simpleString()

    def find(pdf):
        import pandas as pd

        first = int(pdf["pos"].min())
        w = np.zeros(int(pdf["pos"].max()) - first + 1)
        w[pdf["pos"].to_numpy() - first] = pdf["weight"].round(9)
        got = two_peaks(w, **options)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(got), "k": range(1, len(got) + 1), "start": [s + first - 1 for s, _ in got], "end": [e + first - 1 for _, e in got]})

    return cover.groupBy(by).applyInPandas(find, f"{by} {kind}, k int, start long, end long")


def site_hits(hits: DataFrame, peak: DataFrame, by: str = "cluster", start: str = "start1", end: str = "end1", least: float = 0.6) -> DataFrame:
    """Adds site: whether a hit's interval overlaps its group's peak by ``least`` of the shorter one. Joined by group."""
    from ..functions.text import overlap_share

    joined = hits.join(peak.select(by, F.col("start").alias("__s"), F.col("end").alias("__e")), by, "left")
    share = overlap_share(F.col("__s"), F.col("__e"), F.col(start), F.col(end))
    return joined.withColumn("site", F.coalesce(share >= least, F.lit(False))).drop("__s", "__e")


def plot_extents(positions: DataFrame, center: float = 200.0) -> DataFrame:
    """Smallest and largest position per group, and both seen from 1.2 times the centre."""
    out = positions.groupBy("cluster").agg(F.min("start1").alias("low"), F.max("end1").alias("high"))
    return out.withColumns({"low_shift": F.col("low") - 1.2 * center, "high_shift": F.col("high") - 1.2 * center})
