import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import numerics as N
from rankloom.operators import combine as CB
from rankloom.operators import hits as H
from rankloom.operators import phylogeny as P


def test_normal_functions_are_close_to_exact(spark):
    ps = [1e-14, 1e-9, 1e-4, 0.02, 0.3, 0.5, 0.77, 0.99, 1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", N.probit_col("p").alias("z")).withColumn("back", N.tail_col("z")).collect()
    for r in rows:
        assert r["z"] == pytest.approx(-NormalDist().inv_cdf(r["p"]), abs=1e-6)
        assert r["back"] == pytest.approx(r["p"], rel=1e-5)


def test_quantile_is_clamped(spark):
    z = spark.createDataFrame([(0.0,), (1.0,)], "p double").select(N.probit_col("p").alias("z")).collect()
    assert all(math.isfinite(r["z"]) for r in z)


def test_bh_by_hand(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.5), (5, None)], "k int, p double")
    got = {r["k"]: r["fdr"] for r in N.bh_fdr(df, "p", ["k"]).collect()}
    assert got[5] is None
    for k, want in {1: 0.04, 2: 0.04, 3: 0.04, 4: 0.5}.items():
        assert got[k] == pytest.approx(want)
    assert all(got[k] >= p for k, p in [(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.5)])


def test_combined_p_of_one_organism_is_its_p(spark):
    df = spark.createDataFrame([(0.2,), (0.01,)], "p double").select("p", N.probit_col("p").alias("z"))
    for r in df.select("p", F.expr(N.combined("z", "1.0D", "1.0D", N.lit(0.0))).alias("c")).collect():
        assert r["c"] == pytest.approx(r["p"], rel=1e-5)


def test_gev_fit_finds_parameters(spark):
    """Three organisms with a tail to the right, bounded to the right, and of equal values; 25,000 values are no more special than 2,000."""
    rng, rows = np.random.default_rng(3), []
    for name, xi, n in (("a", 0.2, 25_000), ("b", -0.15, 2_000)):
        x = 5 + 2 * ((-np.log(rng.random(n))) ** -xi - 1) / xi
        rows += [(name, float(-v)) for v in x]
    rows += [("c", -1.0)] * 5
    got = {r["organism"]: r for r in H.gev_params(spark.createDataFrame(rows, "organism string, energy double")).collect()}
    for name, xi in (("a", 0.2), ("b", -0.15)):
        assert got[name]["xi"] == pytest.approx(xi, abs=0.05) and got[name]["mu"] == pytest.approx(5, abs=0.15) and got[name]["sigma"] == pytest.approx(2, abs=0.15)
        x = np.array([-e for o, e in rows if o == name])

        def cost(t):
            y = 1 + t[0] * (x - t[1]) / t[2]
            return np.inf if t[2] <= 0 or y.min() <= 0 else len(x) * np.log(t[2]) + ((1 + 1 / t[0]) * np.log(y) + y ** (-1 / t[0])).sum()

        best = np.array([got[name][k] for k in ("xi", "mu", "sigma")])
        assert all(cost(best) <= cost(best + d) + 1e-4 for h in (1e-3, 1e-2) for d in np.concatenate([np.eye(3), -np.eye(3)]) * h)
    assert (got["c"]["xi"], got["c"]["mu"]) == (0.0, 1.0)


def test_gev_fit_says_how_it_ended(spark):
    """Shapes on both sides of 0, at 0, near the bounds, values that end at a hard limit, too few and equal ones; no fit needs more than ten passes."""
    rng, rows, shapes = np.random.default_rng(8), [], {"a": 0.0, "b": 0.9, "c": -0.6, "d": -0.02, "e": 0.3}
    for name, xi in shapes.items():
        e = -np.log(rng.random(4_000))
        rows += [(name, float(-5 - 2 * ((e**-xi - 1) / xi if xi else -np.log(e)))) for e in e]
    limit = 10 - rng.exponential(3.0, 500)
    rows += [("limit", float(-v)) for v in limit] + [("few", -1.0), ("few", -2.0), ("same", -3.0), ("same", -3.0), ("same", -3.0), ("same", None)]
    got = {r["organism"]: r for r in H.gev_fit(spark.createDataFrame(rows, "organism string, energy double")).collect()}
    for name, xi in shapes.items():
        r = got[name]
        assert r["status"] == "converged" and r["passes"] <= 10 and r["slope"] < 1e-3 and r["xi"] == pytest.approx(xi, abs=0.06) and r["n"] == 4_000
    r = got["limit"]
    assert (r["status"], r["xi"]) == ("boundary", -1.0) and r["mu"] + r["sigma"] == pytest.approx(limit.max()) and r["sigma"] == pytest.approx(limit.max() - limit.mean())
    assert (got["few"]["status"], got["same"]["status"], got["same"]["n"]) == ("degenerate", "degenerate", 3)
    assert H.gev_fit(spark.createDataFrame([], "organism string, energy double")).count() == 0


def test_likelihood_derivatives():
    """The written-out second derivatives against differences."""
    steps, sums = H.likelihood_terms()

    def at(xi, mu, s, x=np.array([0.5, 1.0, 2.5, 7.0])):
        env = dict(x=x, xi=xi, mu=mu, s=s, exp=np.exp, ln=np.log)
        for name, text in steps:
            env[name] = eval(text, {}, env)
        return {k: float(np.sum(eval(text, {}, env))) for k, text in sums.items()}

    h = 1e-5
    for xi, mu, s in ((0.3, 1.0, 0.7), (-0.08, 2.0, 0.9), (0.002, 1.5, 0.2)):
        here, unit = at(xi, mu, s), {"xi": (h, 0, 0), "mu": (0, h * math.exp(s), 0), "s": (0, 0, h)}
        for a, d in unit.items():
            up, down = at(xi + d[0], mu + d[1], s + d[2]), at(xi - d[0], mu - d[1], s - d[2])
            assert (up["ll"] - down["ll"]) / 2 / h == pytest.approx(here[f"d_{a}"], rel=1e-4, abs=1e-4)
        for a, b in (("xi", "xi"), ("xi", "mu"), ("xi", "s"), ("mu", "mu"), ("s", "s")):
            d = unit[b]
            up, down = at(xi + d[0], mu + d[1], s + d[2]), at(xi - d[0], mu - d[1], s - d[2])
            assert (up[f"d_{a}"] - down[f"d_{a}"]) / 2 / h == pytest.approx(here[f"h_{a}{b}"], rel=1e-3, abs=1e-3)


def test_gev_support(spark):
    df = spark.createDataFrame([(100.0,), (-100.0,)], "x double")
    low = df.select("x", F.expr(N.gev_survival("x", N.lit(-0.5), N.lit(0.0), N.lit(1.0))).alias("p")).collect()
    assert [r["p"] for r in low] == [0.0, 1.0]


def test_prefix_subsets_and_minimum(spark):
    rows = [(1, "a", 0.01), (1, "b", 0.2), (1, "c", 0.05), (1, "d", 0.3), (2, "a", 0.1), (2, "b", 0.2), (3, "a", 0.5), (3, "b", 0.5), (3, "c", 0.5)]
    m = spark.createDataFrame(rows, "cluster int, organism string, p double")
    got = sorted((r["cluster"], r["k"], r["subset"]) for r in CB.prefix_sets(m).collect())
    assert got == [(1, 3, "a_b_c"), (1, 4, "a_b_c_d"), (3, 3, "a_b_c")]  # two organisms are too few, ties by organism
    w = spark.createDataFrame([(o, 0.25) for o in "abcd"], "organism string, weight double")
    by = CB.combine(m, w)
    balanced = {r["cluster"]: r["p"] for r in CB.balanced_p(by).collect()}
    for r in by.collect():
        assert balanced[r["cluster"]] <= r["p"]


def test_conditional_normal_by_hand():
    m, v = CB.conditional_normal(np.array([2.0]), np.array([0.0, 1.0]), np.array([[1.0, 0.5], [0.5, 2.0]]), [0], [1])
    assert m[0, 0] == pytest.approx(2.0) and v[0, 0] == pytest.approx(1.75)


def test_imputation_is_reproducible(spark):
    rng = np.random.default_rng(1)
    rows = [(k, o, float(p)) for k in range(30) for o, p in zip("abc", rng.random(3))] + [(100, "a", 0.1), (100, "b", 0.2)]
    m = spark.createDataFrame(rows, "cluster int, organism string, p double")
    cov = CB.covariance(CB.complete_probits(m, 3))
    one, two = (sorted(CB.impute(m, cov).where("sampled").collect()) for _ in range(2))
    assert one == two and [(r["cluster"], r["organism"]) for r in one] == [(100, "c")]


def test_imputed_probits_by_hand(spark):
    """Every pattern of missing organisms against the conditional normal and the draws worked out row by row."""
    import hashlib

    rng, names = np.random.default_rng(6), "abcd"
    rows = [(k, o, float(p)) for k in range(60) for o, p in zip(names, rng.random(4))] + [(100 + m, o, float(rng.random())) for m in range(1, 16) for i, o in enumerate(names) if m >> i & 1] + [(200, "a", None), (201, "a", 0.5), (201, "b", None)]
    m = spark.createDataFrame(rows, "cluster int, organism string, p double")
    cov = CB.covariance(CB.complete_probits(m, 4))
    stats = {(r["a"], r["b"]): r for r in cov.collect()}
    mean, c = np.array([stats[o, o]["mean_a"] for o in names]), np.array([[stats[a, b]["cov"] for b in names] for a in names])
    z = {(k, o): -NormalDist().inv_cdf(p) for k, o, p in rows if p is not None}
    got = CB.impute(m, cov, seed=7).collect()
    assert len(got) == 4 * len({k for k, _ in z}) and sum(r["sampled"] for r in got) == len(got) - len(z)
    for r in got:
        k, o = r["cluster"], r["organism"]
        if not r["sampled"]:
            assert r["z"] == pytest.approx(z[k, o], abs=1e-6)
            continue
        given = [i for i, n in enumerate(names) if (k, n) in z]
        mu, v = CB.conditional_normal(np.array([z[k, names[i]] for i in given]), mean, c, given, [names.index(o)])
        u = (int(hashlib.md5(f"7|{k}|{o}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert r["z"] == pytest.approx(mu[0, 0] + math.sqrt(max(v[0, 0], 0)) * NormalDist().inv_cdf(u), abs=1e-5)
    spread = spark.range(20_000).select(CB.uniform(1, F.col("id"), F.lit("x")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u"), F.stddev("u")).first()
    assert 0 < spread[0] < 1e-3 and 1 - 1e-3 < spread[1] < 1 and spread[2] == pytest.approx(0.5, abs=0.01) and spread[3] == pytest.approx(12**-0.5, abs=0.005)


def test_rank_aggregation(spark):
    """Against the binomial tails written out."""
    rows = [(1, [0.01, 0.01, 0.02]), (2, [0.2, 0.5, 0.9]), (3, []), (4, [0.3])]
    got = {r["k"]: r["s"] for r in spark.createDataFrame(rows, "k int, x array<double>").select("k", CB.rank_aggregate_score(F.col("x"), 3).alias("s")).collect()}
    for k, x in rows:
        tails = [sum(math.comb(3, j) * v**j * (1 - v) ** (3 - j) for j in range(i, 4)) for i, v in enumerate(x, 1)]
        assert got[k] == pytest.approx(min(1.0, 3 * min(tails, default=1.0)))


def test_gauss_newton_is_no_worse_than_the_grid(spark):
    rng = np.random.default_rng(4)
    common = rng.standard_normal(400)
    z = 0.7 * common[:, None] + np.sqrt(0.51) * rng.standard_normal((400, 4))
    rows = [(i, "a_b_c_d" if i % 2 else "a_b_c", float(r.sum()), 4.0, 4.0) for i, r in enumerate(z)]
    df = spark.createDataFrame(rows, "cluster int, subset string, zw double, w2 double, w double")
    loss = lambda fitted: {r["subset"]: r["loss"] for r in CB._uniform(df).join(fitted, "subset").groupBy("subset").agg(F.expr(CB.SUMS["loss"]).alias("loss")).collect()}
    newton, grid = loss(CB.fit_rho(df)), loss(CB.fit_rho_grid(df))
    assert set(newton) == {"a_b_c_d", "a_b_c"} and all(newton[k] <= grid[k] + 1e-9 for k in grid)


def test_three_leaf_tree(spark):
    edges = spark.createDataFrame([("r", "x", 1.0), ("x", "a", 1.0), ("x", "b", 1.0), ("r", "c", 2.0)], "parent string, child string, length double")
    w = {r["organism"]: r["weight"] for r in P.leaf_weights(edges).collect()}
    assert set(w) == {"a", "b", "c"} and sum(w.values()) == pytest.approx(1.0)
    assert w["a"] == pytest.approx(0.5 * 3 / 5) and w["c"] == pytest.approx(2 / 5)
    flat = edges.withColumn("length", F.lit(0.0))
    assert [r["weight"] for r in P.leaf_weights(flat).collect()] == pytest.approx([1 / 3] * 3)


def test_average_linkage():
    edges = P.upgma(["a", "b", "c"], np.array([[0, 2, 6], [2, 0, 6], [6, 6, 0]]))
    assert ("1", "a", 1.0) in edges and ("2", "c", 3.0) in edges and ("2", "1", 2.0) in edges


def test_large_linkage():
    """Heights are means over leaf pairs, the order of merges is by distance, then by the clusters' numbers; 2,000 leaves in seconds."""
    import time

    rng = np.random.default_rng(11)
    x = rng.integers(0, 6, (40, 2)).astype(float)  # many ties
    d = np.abs(x[:, None] - x[None]).sum(2)
    live, want, step = {i: [i] for i in range(40)}, [], 0
    name, height = {i: str(i) for i in range(40)}, dict.fromkeys(range(40), 0.0)
    while len(live) > 1:
        best = min((round(float(np.mean([d[p, q] for p in live[i] for q in live[j]])), 9), i, j) for i in live for j in live if i < j)
        step += 1
        new = 39 + step
        for k in best[1:]:
            want.append((f"#{step}", name[k], best[0] / 2 - height[k]))
        live[new], name[new], height[new] = live.pop(best[1]) + live.pop(best[2]), f"#{step}", best[0] / 2
    got = P.upgma([str(i) for i in range(40)], d)
    assert len(got) == len(want)
    inner = lambda edges, mark: [(mark(p), round(v, 6)) for p, _, v in edges]
    assert inner(got, int) == inner(want, lambda p: int(p[1:]))
    began = time.process_time()
    y = rng.random((2000, 3))
    assert len(P.upgma([f"l{i}" for i in range(2000)], np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)))) == 2 * 1999
    assert time.process_time() - began < 30


def test_root_transform(spark):
    w = spark.createDataFrame([("a", 0.25)], "organism string, weight double")
    assert P.rooted_weights(w, 2).first()["weight"] == pytest.approx(0.5)
    assert P.rooted_weights(w, 0).first()["weight"] == 1.0


def test_kimura_domain(spark):
    df = spark.createDataFrame([(1.0,), (0.1,)], "ident double").select(H.protein_distance(F.col("ident")).alias("d")).collect()
    assert df[0]["d"] == pytest.approx(0.0) and df[1]["d"] is None


def test_subset_sums_meet_whole_rows(spark):
    """Sums of complete rows only, the same whatever the order of their cells, without an aggregate over rows by subset."""
    import re

    ps = {"a": 0.011, "b": 0.3, "c": 0.07, "d": 0.9}
    cells = [(1, o, p) for o, p in ps.items()] + [(2, o, p) for o, p in reversed(ps.items())] + [(3, o, ps[o]) for o in "abc"] + [(4, "a", 0.5), (4, "b", None), (4, "c", 0.5)]
    weights = {"a": 0.1, "b": 0.7, "c": 0.3, "d": 0.2}
    m, w = spark.createDataFrame(cells, "cluster int, organism string, p double"), spark.createDataFrame(list(weights.items()), "organism string, weight double")
    out = CB.subset_rows(m, spark.createDataFrame([("a_b_c",), ("a_b_c_d",), ("a_b_c",)], "subset string"), w)
    got = {(r["cluster"], r["subset"]): r for r in out.collect()}
    assert set(got) == {(1, "a_b_c"), (2, "a_b_c"), (3, "a_b_c"), (1, "a_b_c_d"), (2, "a_b_c_d")}
    for (_, s), r in got.items():
        names = s.split("_")
        assert r["zw"] == pytest.approx(sum(-NormalDist().inv_cdf(ps[o]) * weights[o] for o in names), abs=1e-6)
        assert (r["w2"], r["w"]) == (pytest.approx(sum(weights[o] ** 2 for o in names)), pytest.approx(sum(weights[o] for o in names)))
    assert got[1, "a_b_c_d"]["zw"] == got[2, "a_b_c_d"]["zw"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[cluster#\w+, subset#\w+\]", plan)


def test_own_subsets_stay_with_their_rows(spark):
    """Combined p of own subsets only, correlations from all rows and values from the masked ones; no join deals the rows by row and subset."""
    import re

    rng = np.random.default_rng(5)
    cells = [(i, o, float(rng.random())) for i in range(60) for o in "abcd" if (i + ord(o)) % 9] + [(60, "a", None), (60, "b", 0.5)] + [(61, o, 0.25) for o in "abce"]
    weights = {"a": 0.1, "b": 0.7, "c": 0.3, "d": 0.2}  # none of e
    m, w = spark.createDataFrame(cells, "cluster int, organism string, p double"), spark.createDataFrame(list(weights.items()), "organism string, weight double")
    for masked in (None, m.where("(cluster + ascii(organism)) % 4 <> 0")):
        own = sorted((r["cluster"], r["subset"]) for r in CB.prefix_sets(m if masked is None else masked).collect())
        rows = CB.subset_rows(m, CB.prefix_sets(m if masked is None else masked), w)
        rho = {r["subset"]: r["rho"] for r in CB.fit_rho_grid(rows).collect()}
        sums = {(r["cluster"], r["subset"]): r for r in (rows if masked is None else CB.subset_rows(masked, CB.prefix_sets(masked), w)).collect()}
        out = CB.combine(m, w, masked=masked)
        got = {(r["cluster"], r["subset"]): r["p"] for r in out.collect()}
        assert sorted(got) == [k for k in own if "e" not in k[1]] and len(got) > 30
        for k, p in got.items():
            s, r = sums[k], rho[k[1]]
            assert p == pytest.approx(NormalDist().cdf(-s["zw"] / ((1 - r) * s["w2"] + r * s["w"] ** 2) ** 0.5), abs=1e-6)
        assert not re.search(r"Join \[cluster#", out._jdf.queryExecution().executedPlan().toString())
