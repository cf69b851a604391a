"""Merkle manifest: SQL, a plain build of the tree, changed rows, and odd inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rankloom.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, h string, key int, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])])


def tree(leaves, fan):
    """All levels of one tree, and of each leaf the siblings by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    sibs = []
    for i in range(len(leaves)):
        out, at = [], i
        for lv in levels[:-1]:
            run = at // fan * fan
            out.append((at - run, lv[run:at] + lv[at + 1 : run + fan]))
            at //= fan
        sibs.append(out)
    return levels, sibs


def brute(rows, fan):
    """{leaf: [(subroot, root, siblings by level)]}"""
    groups = {}
    for r in rows:
        groups.setdefault((r[3] is not None, (r[3] or "").encode()), []).append(r)
    names = sorted(groups)
    trees = {k: tree([leaf(r) for r in sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))], fan) for k in names}
    top, above = tree([trees[k][0][-1][0] for k in names], fan)
    out = []
    for j, k in enumerate(names):
        for h, sibs in zip(trees[k][0][0], trees[k][1], strict=True):
            out.append((h, trees[k][0][-1][0], top[-1][0], [(s, "".join(o)) for s, o in sibs + above[j]]))
    return sorted(out)


def rows_of(n, sources):
    return [(i * 7 % n, f"text {i} ÄB", "en", sources[i % len(sources)] if i % 3 else sources[0], i, "x", "y", 1, "z") for i in range(n)]


@pytest.mark.parametrize("fan, n, sources", [(16, 40, ["a", "b"]), (2, 23, ["s", "t", None, "", "é", "S", "lone"]), (3, 82, [f"s{i}" for i in range(30)]), (16, 1, ["a"])])
def test_equals_plain_tree(spark, fan, n, sources):
    data = rows_of(n, sources)
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = merkle.prove(merkle.build_manifest(docs, fan=fan), fan=fan)
    got = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert sorted((r["leaf"], r["subroot"], r["root"], [(s["slot"], s["others"]) for s in r["path"]]) for r in got) == brute(data, fan)
    assert all(r["folded"] == r["root"] and r["claim"] == r["leaf"] for r in got)


def test_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing names; an empty table."""
    none = (None,) * 9
    data = [none, none, (1, "", None, "s", 0, None, None, None, None), (1, "b", "en", "s", None, "", "", 0, ""), (2, "x" * 300_000, "en", "s", 3, "", "", 0, ""), (2, "x", "", "", 3, "", "", 0, "")] + [(3, "same", "en", "s", 4, "", "", 0, "")] * 20
    docs = spark.createDataFrame(data, SCHEMA)
    claim = F.when(F.col("doc_id") == 1, merkle.leaf_digest([F.lit("other")]))
    got = merkle.prove(merkle.build_manifest(docs, claim=claim))
    got = got.withColumn("good", merkle.fold(F.col("claim"), F.col("path")) == F.col("root")).collect()
    assert sorted((r["leaf"], r["subroot"], r["root"], [(s["slot"], s["others"]) for s in r["path"]]) for r in got) == brute(data, 16)
    assert all(r["good"] == (r["id"] != 1) for r in got)
    assert merkle.prove(merkle.build_manifest(docs.where("doc_id > 9"))).count() == 0


def test_query(same_rows, spark, sf_dir):
    same_rows(queries.op11_merkle_manifest, queries.oracle_sql()["op11_merkle_manifest"])
    rows = queries.op11_merkle_manifest(spark, sf_dir).collect()
    assert 0 < sum(not r["verified"] for r in rows) < len(rows) / 3 and len({r["root"] for r in rows}) == 1
