"""Intermediate tables in the shared folder, and connected components over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import delete, folder, tidy


class Workspace:
    """Tables of one run. ``drop`` deletes one early; what is left goes when the interpreter ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, folder(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it again: its lineage ends here and survives lost executors, its shuffle files go."""
        path = f"{self.root}/{name}"
        with tidy(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")


def components(ws: Workspace, links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root being the smallest node reachable.

    Alternates large-star and small-star steps; both are joins with per-node minima, so a node of any degree is
    aggregated before it is joined. The root itself has a row too.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before, step = ws.save(pairs, f"{name}0"), None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = ws.save(large, f"{name}l{step}")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = ws.save(out, f"{name}{step + 1}")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        ws.drop(f"{name}{step}")
        ws.drop(f"{name}l{step}")
        edges, step = new, step + 1
        if now == before:
            break
        before = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
