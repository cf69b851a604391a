"""Running values, line numbers, intervals, substrings and deep trees against brute force; plans without a task for a whole group."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rankloom.operators import annotate as A
from rankloom.operators import phylogeny as P
from rankloom.operators.intervals import overlapping
from rankloom.operators.ranking import segmented
from rankloom.plans import catalog
from rankloom.sources import tables as TB

Q = catalog.queries()


def test_running_values(spark):
    """One group with most rows, one without a key, one row alone; nulls among the values."""
    rng = random.Random(2)
    rows = [("hot", k, rng.choice([None, rng.randint(-9, 9)])) for k in range(300)] + [(None, k, k % 3) for k in range(40)] + [("one", 7, None)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    got = segmented(df, ["g"], ["k"], 7, s=("sum", F.col("v")), lo=("min", F.col("v")), hi=("max", F.col("v")), fill=("last", F.col("v")), nxt=("next", F.col("v"))).collect()
    groups = {}
    for g, k, v in rows:
        groups.setdefault(g, []).append((k, v))
    want = []
    for g, kv in groups.items():
        kv.sort()
        for i, (k, v) in enumerate(kv):
            seen = [x for _, x in kv[: i + 1] if x is not None]
            want.append((g, k, v, sum(seen), min(seen, default=None), max(seen, default=None), seen[-1] if seen else None, kv[i + 1][1] if i + 1 < len(kv) else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert segmented(df.where("k > 999"), ["g"], ["k"], s=("sum", F.col("v"))).count() == 0


@pytest.mark.parametrize("split", ["1k", "128m"])
def test_line_numbers_of_split_files(spark, tmp_path, split):
    """The same numbers however files are cut; empty lines, carriage returns, no line feed at the end, an empty file, two files of a name."""
    files = {"a.txt": "".join(f"line {i}{' x' * (i % 90)}\n" for i in range(700)), "b.txt": "one\r\n\r\n\nlast", "c.txt": "", "d.txt": "y" * 5000 + "\nz\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text, newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        if split == "1k":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = TB.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [(n, i, x.rstrip("\r")) for n, t in files.items() for i, x in enumerate(t.removesuffix("\n").split("\n")) if t]
    assert sorted(map(tuple, got)) == sorted(want)


def test_reports_read_the_same_in_any_split(spark, tmp_path):
    report = "".join(f"score={g}.5\n" + "".join(f'afdr=0.{k}\ntermName="t{g}_{k}"\nlistHits={k}\n' for k in range(g % 4 + 1)) for g in range(150))
    (tmp_path / "r.txt").write_text(report)
    (tmp_path / "s.txt").write_text("target: g1\n" + "".join(f"l{i}\n" for i in range(1, 400)) + "target: g2\n" + "".join(f"m{i}\n" for i in range(1, 10)))
    seen = []
    for split in ("512", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        terms = TB.parse_enrichment(TB.parse_key_values(TB.numbered_lines(spark, str(tmp_path / "r.txt"))))
        blocks = TB.parse_interaction_blocks(TB.numbered_lines(spark, str(tmp_path / "s.txt")))
        seen.append((sorted((r["term_no"], r["group_id"], r["score"], r["termName"], r["listHits"]) for r in terms.collect()), sorted(map(tuple, blocks.collect()))))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(g + 1, g + 0.5, f"t{g}_{k}", str(k)) for g in range(150) for k in range(g % 4 + 1)]
    assert seen[0] == seen[1] and [x[1:] for x in seen[0][0]] == want and len(seen[0][1]) == 14 + 5


def test_interval_pairs(spark):
    rng = random.Random(5)
    a = [(i, rng.choice("xy"), s := rng.randint(-60, 400), s + rng.randint(-1, 90)) for i in range(120)] + [(500, "x", -10_000, 10_000), (501, "x", None, 5), (502, "x", 7, 7)]
    b = [(i, rng.choice("xyz"), s := rng.randint(-60, 400), s + rng.randint(0, 30)) for i in range(120)] + [(502, "x", 7, 7)]
    left, right = spark.createDataFrame(a, "i int, g string, start int, end int"), spark.createDataFrame(b, "j int, g string, start_b int, end_b int")
    want = sorted((i, j) for i, g, s, e in a for j, h, t, u in b if g == h and s is not None and s <= e and max(s, t) <= min(e, u))
    for width in (1, 16, 5000):
        assert sorted((r["i"], r["j"]) for r in overlapping(left, right, ["g"], width).collect()) == want


def test_first_containing(spark):
    texts = ["b0012", "b001", "xb001x", "zzz", "", None, "aéb", "b0013"]
    patterns = ["b001", "b0012", "00", "éb", "q", "", None, "zzzz", "b001"]
    got = A.first_containing(spark.createDataFrame([(p,) for p in patterns], "p string"), "p", spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    best = lambda p: min(((len(t), t) for t in texts if t is not None and p in t), default=(0, None))[1]
    assert {r["pattern"]: r["found"] for r in got} == {p: None if p is None else best(p) for p in set(patterns)}


def test_part_names_equal_the_nested_loop(same_rows):
    same_rows(Q["j03_substring_annotation"], catalog.oracle_sql()["j03_substring_annotation"])
    same_rows(Q["j10_interval_pairs"], catalog.oracle_sql()["j10_interval_pairs"])


def test_deep_tree(spark):
    """A chain of 1,000 inner nodes with a leaf at each: far deeper than any number of levels one would join one by one."""
    n = 1000
    edges = [(f"n{i}", f"n{i + 1}", 1.0) for i in range(n)] + [(f"n{i}", f"leaf{i}", 2.0) for i in range(n)]
    df = spark.createDataFrame(edges, "parent string, child string, length double")
    below = {r["node"]: r["below"] for r in P.subtree_lengths(df).collect()}
    assert all(below[f"n{i}"] == pytest.approx(3.0 * (n - i)) for i in range(n))
    weights = {r["organism"]: r["weight"] for r in P.leaf_weights(df).collect()}
    own = lambda i: 0.0 if i == 0 else 1.0
    for leaf in (0, 1, 500, n - 1):
        want, b = 1.0, 2.0
        for i in range(leaf, -1, -1):
            s = 3.0 * (n - i)
            want *= (b + own(i) / 2) / (s + own(i))
            b = s + own(i)
        assert weights[f"leaf{leaf}"] == pytest.approx(want, rel=1e-9)
    assert len(weights) == n + 1
    with pytest.raises(ValueError):
        P.ancestors(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "parent string, child string, length double"))


@pytest.mark.parametrize("name", ["a17_coverage", "a17_frequency", "a18_peak", "j10_interval_overlap", "o01_energy_order", "o02_o03_p_value_order", "j13_positional_zip", "s10_full_matrix", "s13_interaction_blocks"])
def test_no_task_for_a_whole_group(name, spark, sf_dir):
    """Windows over rows are by range and group; those by group alone go over a row per range."""
    p = Q[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    alone = [x for x in re.findall(r"Window \[(.*)\], \[(?:organism|cluster|file)#\d+L?\], \[(.*)\]", p)]
    assert all(order.startswith("__part#") for _, order in alone)


def test_common_positions_expand_nothing(spark, sf_dir):
    assert "sequence(" not in Q["u04_common_positions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
