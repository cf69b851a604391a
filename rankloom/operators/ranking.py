"""Ranks over whole tables without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import folder, saved, tidy

#: Rows of a range where their number is known: what a task sorts doesn't grow with the table, whatever the number of shuffle partitions.
RANGE_ROWS = 500_000


def ranged(df: DataFrame, order: list[Column | str], partitions: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of ``order`` and written to the shared folder, with __part, the number of the range.

    Rows that are equal in the order are in one range. What is written keeps its range, so several reads agree.
    """
    spark = df.sparkSession
    n, path = partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), folder(spark)
    out = df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    with tidy(spark):
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def global_row_number(
    df: DataFrame, order: list[Column | str], out: str = "place", partitions: int | None = None, keep_part: bool = False, by: list[str] = (), total: str | None = None
) -> DataFrame:
    """Adds the 1-based place of each row in ``order``: its place within its range plus the rows of the ranges before.

    With ``by`` places count within its groups; a group of any size is spread over as many ranges as it fills. ``total``
    adds the number of the group's rows.
    """
    keys = [*by]
    saved = ranged(df, [*keys, *order], partitions)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    whole = Window.partitionBy(*keys)
    counts = saved.groupBy("__part", *keys).agg(F.count("*").alias("__n"))
    starts = counts.select("__part", *keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), *([F.sum("__n").over(whole).alias(total)] if total else []))
    own = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order))
    ranked = saved.join(starts if keys else F.broadcast(starts), ["__part", *keys]).withColumn(out, F.col("__start") + own)
    return ranked.drop("__start") if keep_part else ranked.drop("__start", "__part")


def numbered(df: DataFrame, order: list[Column | str], out: str = "place", by: list[str] = (), total: str | None = None) -> DataFrame:
    """``global_row_number`` of many rows in few groups. Ranges hold about ``RANGE_ROWS`` rows and are written sorted, with the number of each row
    in its range, so rows are dealt and sorted once: grouping ranges by their number would put several large ones into one task.

    What the ranges before hold of each group is written too (a row a range and group), so that the planner knows its size.
    """
    df, keys = saved(df), [*by]
    spark = df.sparkSession
    n, path = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS)), folder(spark)
    dealt = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("__id", F.monotonically_increasing_id())
    with tidy(spark):
        dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path).withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id")
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    counts = rows.groupBy("__part", *keys).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    start = (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__start")
    starts = saved(counts.select("__part", *keys, start, *([F.sum("__n").over(Window.partitionBy(*keys)).alias(total)] if total else [])))
    return rows.join(starts, ["__part", *keys]).withColumn(out, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def adjusted(df: DataFrame, p: str, order: list[str], out: str = "fdr", by: list[str] = ()) -> DataFrame:
    """Benjamini-Hochberg over all rows with a p, or those of each group: ranks by ranges, smallest values within and then over the ranges behind."""
    keys = [*by]
    df = saved(df)
    raw = global_row_number(df.where(F.col(p).isNotNull()), [p, *order], "__r", keep_part=True, by=keys, total="__n").withColumn("__v", F.col(p) * F.col("__n") / F.col("__r"))
    behind = Window.partitionBy(*keys).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    later = raw.groupBy("__part", *keys).agg(F.min("__v").alias("__m")).select("__part", *keys, F.min("__m").over(behind).alias("__later"))
    within = Window.partitionBy("__part", *keys).orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    value = F.least(F.lit(1.0), F.min("__v").over(within), F.col("__later"))
    done = raw.join(later if keys else F.broadcast(later), ["__part", *keys]).withColumn(out, value).select(*df.columns, out)
    return done.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def segmented(df: DataFrame, by: list[str], order: list[str], partitions: int | None = None, **outs: tuple[str, Column]) -> DataFrame:
    """Adds running values along ``order`` within ``by``, which may be of any size: ranges of (by, order) are run each by itself, and what the
    ranges before hold of the group is carried over.

    An output is ("sum" | "min" | "max" | "last", column), over the rows up to and with the present one ("last" skips nulls, which fills
    down), or ("next", column), of the row after it. ``order`` is to tell the rows of a group apart; nulls come first. A group may be null.
    """
    ends = {"sum": F.sum, "min": F.min, "max": F.max}
    saved = ranged(df.withColumns({f"__v_{k}": v for k, (_, v) in outs.items()}), [*by, *order], partitions)
    place = F.struct(*order)
    whole = {
        k: F.max_by(F.col(f"__v_{k}"), F.when(F.col(f"__v_{k}").isNotNull(), place)) if kind == "last" else F.min_by(F.col(f"__v_{k}"), place) if kind == "next" else ends[kind](f"__v_{k}")
        for k, (kind, _) in outs.items()
    }
    parts = saved.groupBy("__part", *by).agg(*[c.alias(f"__w_{k}") for k, c in whole.items()])
    line = Window.partitionBy(*by).orderBy("__part")  # over a row per range
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    carry = lambda k, kind: F.last(f"__w_{k}", ignorenulls=True).over(before) if kind == "last" else F.lead(f"__w_{k}").over(line) if kind == "next" else ends[kind](f"__w_{k}").over(before)
    carried = parts.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__b_{i}") for i, c in enumerate(by)], *[carry(k, kind).alias(f"__c_{k}") for k, (kind, _) in outs.items()])
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__b_{i}"))
    own = Window.partitionBy("__part", *by).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    x = saved.join(carried, same)
    for k, (kind, _) in outs.items():
        v, c = F.col(f"__v_{k}"), F.col(f"__c_{k}")
        if kind == "sum":
            value = F.coalesce(c, F.lit(0)) + F.coalesce(F.sum(v).over(upto), F.lit(0))
        elif kind in ("min", "max"):
            value = (F.least if kind == "min" else F.greatest)(c, ends[kind](v).over(upto))
        elif kind == "last":
            value = F.coalesce(F.last(v, ignorenulls=True).over(upto), c)
        else:
            value = F.when(F.lead(F.lit(1)).over(own).isNull(), c).otherwise(F.lead(v).over(own))
        x = x.withColumn(k, value)
    return x.select(*[c for c in df.columns if c not in outs], *outs)
