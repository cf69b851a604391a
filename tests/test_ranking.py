import pytest
from pyspark.sql import functions as F

from rankloom.functions import numerics as N
from rankloom.operators import ranking
from rankloom.operators.ranking import global_row_number, numbered


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_places_are_those_of_a_full_sort(spark, partitions):
    rows = [(i, (i * 7919) % 101 if i % 13 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = {r["k"]: r["place"] for r in global_row_number(df, [F.col("v").asc_nulls_last(), F.col("k")], partitions=partitions).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert got == {k: n for n, (k, _) in enumerate(want, 1)}
    assert global_row_number(df.limit(0), ["v", "k"]).count() == 0


def test_large_groups_are_dealt_and_sorted_once(spark, monkeypatch):
    """Places of two groups over more ranges than shuffle partitions, each range a sorted file; nothing groups rows by range."""
    monkeypatch.setattr(ranking, "RANGE_ROWS", 25)
    rows = [("x" if i % 10 else "y", i, float((i * 7919) % 97)) for i in range(500)]
    out = numbered(spark.createDataFrame(rows, "g string, k int, v double"), [F.desc("v"), "k"], "i", by=["g"], total="n")
    got = {r["k"]: (r["i"], r["n"]) for r in out.collect()}
    for g in "xy":
        own = sorted((-v, k) for o, k, v in rows if o == g)
        assert {k: got[k] for _, k in own} == {k: (i, len(own)) for i, (_, k) in enumerate(own, 1)}
    assert len([f for f in out.inputFiles() if "part-" in f]) >= 500 // 25
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert numbered(spark.createDataFrame(rows, "g string, k int, v double").limit(0), ["v"], by=["g"]).count() == 0


def test_adjustment_over_ranges_equals_the_definition(spark):
    rows = [(i, ((i * 31) % 97) / 97 if i % 11 else None) for i in range(300)]
    got = {r["k"]: r["fdr"] for r in N.bh_fdr(spark.createDataFrame(rows, "k int, p double"), "p", ["k"]).collect()}
    have = sorted((p, k) for k, p in rows if p is not None)
    low = 1.0
    for rank in range(len(have), 0, -1):
        p, k = have[rank - 1]
        low = min(low, p * len(have) / rank)
        assert got[k] == pytest.approx(low)
    assert all(got[k] is None for k, p in rows if p is None)
