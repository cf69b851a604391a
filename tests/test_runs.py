"""Result files of runs, option tables, membership matrices and printed numbers."""

import hashlib
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions.printf import printed
from rankloom.operators import combine as CB
from rankloom.operators.annotate import annotated_results
from rankloom.plans.options import BROKEN, RunOptions, choose_mode, options_table
from rankloom.plans.pipeline import MODES, Run
from rankloom.sources import tables as TB


@pytest.mark.parametrize("form", ["%.4g", "%.2f", "%.7f", "%.0f", "%.3e", "%.1g", "%.14g", "%.13e"])
def test_printed_as_c_does(spark, form):
    rng = random.Random(form)
    xs = [0.0, -0.0, 1.0, 0.125, 0.375, 2.5, 1.005, 0.045, 9.9995, 99995.0, 0.00099995, 999.95, 0.5, 1.5, 1e-4, 9.9999e-5, 1e-5, 12345.0, 12355.0, 1e14, 0.001, 5e-8, 4.9e-8, float("inf"), float("-inf"), float("nan")]
    xs += [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-3 if form[2] == "1" and form[3].isdigit() else -9, 7) for _ in range(800)]  # 14 digits at most with seven places
    xs += [round(rng.random() * 10 ** rng.randint(-3, 4), rng.randint(0, 7)) for _ in range(800)]  # many ties
    xs += [rng.randint(0, 4000) / 2.0 ** rng.randint(0, 8) for _ in range(800)]  # ties of the binary value
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").repartition(4).select("x", printed(F.col("x"), form).alias("s")).collect()
    assert len(rows) == len(xs)
    assert [(r["x"], r["s"], form % r["x"]) for r in rows if r["s"] != form % r["x"]] == []


def test_printed_null_and_wrong_forms(spark):
    assert spark.createDataFrame([(None,)], "x double").select(printed(F.col("x"), "%.4g").alias("s")).first()["s"] is None
    for form in ("%d", "%.0g", "%.16f", "%.15g", "%5.2f"):
        with pytest.raises(ValueError):
            printed(F.col("x"), form)


def lines(spark, text):
    return spark.createDataFrame([("f", i, v) for i, v in enumerate(text.split("\n"))], "file string, line_no int, value string")


def test_options_of_several_runs(spark):
    text = "srnaseq:a.fa\nregion:3utr\ntopcount:5\ntopcount:7\nnote\nsrnaseq:b:c.fa\n cons : 1\nnooi:1\ncolour:red\nwinsize:many\nsrnaseq:d.fa\ncores:0"
    a, b, c = options_table(lines(spark, text)).orderBy("run").collect()
    assert (a["srnaseq"], a["region"], a["topcount"], a["winsize"], a["mode"], a["broken"], a["unknown"]) == ("a.fa", "3utr", 7, 150, "ooi", "", "")
    assert (b["srnaseq"], b["mode"], b["broken"], b["unknown"], b["winsize"]) == ("b:c.fa", "ooi_ooiconsensus", "cons 1 needs an organism of interest", "colour; winsize", 150)
    assert c["cores"] == 1
    assert options_table(lines(spark, "nothing")).count() == 0


def test_option_rules_and_modes_are_those_of_the_class(spark):
    cases = [dict(cop1=x, cons=c, nooi=n, winsize=w, region=r, rcsize=s) for x in (False, True) for c in (0, 1, 2, 3) for n in (False, True) for w, r, s in ((150, "5utr", 0.5), (400, "cds", 0.5), (400, "x", 1.5))]
    text = "\n".join(f"srnaseq:{i}\n" + "\n".join(f"{k}:{v}" for k, v in o.items()) for i, o in enumerate(cases))
    got = {int(r["srnaseq"]): r for r in options_table(lines(spark, text)).collect()}
    for i, o in enumerate(cases):
        try:
            mode, bad = choose_mode(RunOptions(**o)), ""
        except ValueError as e:
            mode, bad = None, str(e)
        assert set(filter(None, got[i]["broken"].split("; "))) == set(filter(None, bad.split("; "))) <= set(BROKEN)
        assert mode in (None, got[i]["mode"])


def test_membership_matrix_over_blocks(spark, tmp_path):
    rng = random.Random(5)
    terms = [(f"t{i:03}", i % 4, None if i == 7 else i / 8) for i in range(150)]
    genes = [(f"g{i}", None if i == 3 else i / 100) for i in range(40)]
    pairs = [(g, t[0]) for g, _ in genes[:-1] for t in terms if rng.random() < 0.2]  # the last gene is in no term
    path = f"file://{tmp_path}/m"
    TB.write_membership(spark.createDataFrame(genes, "gene string, p double"), spark.createDataFrame(pairs + pairs[:9], "gene string, term string"), spark.createDataFrame(terms, "term string, group_id int, score double"), path, width=64)
    back = TB.read_membership(spark, path).collect()
    assert {(r["gene"], r["term"]) for r in back if r["member"]} == set(pairs)
    assert len(back) == 150 * 40 and {(r["gene"], r["p"]) for r in back} == set(genes)
    assert len(list((tmp_path / "m").glob("block=*"))) == 3
    first = sorted((tmp_path / "m" / "block=0").glob("part*"))[0].read_text().split("\n")
    assert [x.split("\t")[0] for x in first[:3]] == ["#score", "#group", "#term"] and first[3].startswith("g0\t0.0\t")
    order = [x.split("\t")[2:] for x in first[1:3]]
    assert order[0] == sorted(order[0]) and order[1][:2] == ["t000", "t004"]


def test_result_rows_of_a_mode(spark):
    result = spark.createDataFrame([(1, 0.1, 0.2), (2, None, None)], "cluster long, p double, fdr double")
    cells = spark.createDataFrame([(1, "b", "l1", 3, 9, 0.5), (1, "a", "L0", 1, 7, 0.1), (2, "b", "l2", 2, 4, 0.3)], "cluster long, organism string, locus string, start1 int, end1 int, p double")
    annot = spark.createDataFrame([("l0", "kinase, big", None, None)], "locus string, product string, note string, function string")
    members = spark.createDataFrame([(1, "L0", 1), (1, "L7", 2), (1, "L5", 3)], "cluster long, locus string, pos long")
    one, two = annotated_results(result, cells, annot, members, ["a", "b", "c"]).orderBy("cluster").collect()
    assert (one["a"], one["b"], one["c"], one["annotation"], one["homologs"], one["sampled"]) == ("L0:1-7", "l1:3-9", "", "kinase  big", "L7 L5", 1)
    assert (two["a"], two["b"], two["annotation"], two["homologs"], two["sampled"], two["p"]) == ("", "l2:2-4", "N/A", "", 2, None)


def test_evolution_table_in_order_and_as_written(spark, tmp_path):
    rng = random.Random(2)
    cells = [(c, o, f"{o}{c}", rng.random()) for c in range(30) for o in "ab" if (c + ord(o)) % 7]
    by = spark.createDataFrame([(c, o, p / 300) for c, o, _, p in cells], "cluster long, organism string, p double")
    m = spark.createDataFrame(cells, "cluster long, organism string, locus string, p double")
    path = f"file://{tmp_path}/e"
    TB.write_evolution(CB.evolution_table(by, m, ["a", "b"], top=10), path, ["a", "b"])
    rows = TB.read_evolution(spark, path, ["a", "b"]).orderBy("place").collect()
    rank = {o: {c: i + 1 for i, (_, c) in enumerate(sorted((p, c) for c, x, _, p in cells if x == o))} for o in "ab"}
    assert {r["cluster"] for r in rows} == {c for o in "ab" for c, k in rank[o].items() if k <= 10}
    assert [r["rank_p"] for r in rows] == sorted(r["rank_p"] for r in rows) and [r["place"] for r in rows] == list(range(1, len(rows) + 1))
    start = {c: i + 1 for i, (_, c) in enumerate(sorted((";".join(f"{x[2]}:{x[1]}" for x in sorted(cells, key=lambda x: x[1]) if x[0] == c), c) for c in {x[0] for x in cells}))}
    for r in rows:
        assert [r["rank_a"], r["rank_b"]] == [rank[o].get(r["cluster"]) for o in "ab"] and r["initial_sorting"] == start[r["cluster"]]
        have = {o: p for c, o, _, p in cells if c == r["cluster"]}
        assert r["p_share"] == sum(p / 300 <= 0.001 for p in have.values()) / 2 and r["single_share"] == sum(p <= 0.3 for p in have.values()) / 2
    text = "".join(f.read_text() for f in sorted((tmp_path / "e").glob("part*"))).split("\n")
    places = [int(x.split("\t")[0]) for x in text if x and not x.startswith("place")]
    assert places == sorted(places)  # files by name hold the order


def test_correlation_fit_says_how_it_ended(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, "a_b", rng.gauss(0, 1.2), 2.0, 2.0) for i in range(200)], "cluster long, subset string, zw double, w2 double, w double")
    assert CB.fit_rho(rows).first()["status"] == "converged"
    stopped = CB.fit_rho(rows.withColumn("zw", F.col("zw") * 1.5), steps=1).first()
    assert stopped["status"] == "stopped" and stopped["rho"] == 0.0 and not math.isnan(stopped["rho"])


def test_ordered_lines_below_a_header(spark, tmp_path):
    rows = [(f"line{i:04}", i * 7919 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "v string, k int").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        TB.write_ordered(df, f"file://{tmp_path}/o", ["k"], "##head")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "o").glob("part*"))
    text = "".join(f.read_text() for f in files).split("\n")
    assert len(files) > 1 and text[0] == "##head" and text[1:-1] == [v for v, _ in sorted(rows, key=lambda r: r[1])]
    TB.write_ordered(df.limit(0), f"file://{tmp_path}/e", ["k"], "##head")
    assert "".join(f.read_text() for f in (tmp_path / "e").glob("part*")) == "##head\n"


@pytest.mark.parametrize("name", ["w04_minimum_from_below", "w06_fill_down", "w07_folded_records", "w08_adjacent_duplicates", "w10_row_pairs"])
def test_running_values_need_no_task_for_a_whole_group(spark, sf_dir, name):
    from rankloom.plans import catalog

    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    own = [x for x in windows if "__c_" not in x and "__w_" not in x]  # the others run over a row per range
    assert windows and own and all("__part" in x.split("], [")[1] for x in own)


def _plain_first_version(cells, weights, rcsize):
    """p and fdr of each cluster in plain Python: missing probits drawn given the others, one correlation for all rows."""
    normal, names, own = NormalDist(), sorted(weights), {}
    for c, o, p in cells:
        if p is not None:
            own.setdefault(c, {})[o] = -normal.inv_cdf(min(max(p, 1e-15), 1 - 1e-15))
    listed = {c: sum(x == c for x, _, _ in cells) for c in own}
    own = {c: z for c, z in own.items() if listed[c] / len(names) >= rcsize}
    full = np.array([[z[o] for o in names] for z in own.values() if len(z) == len(names)])
    mean, cov = full.mean(0), np.cov(full.T)
    sums = {}
    for c, z in own.items():
        have, miss = ([i for i, o in enumerate(names) if (o in z) == k] for k in (True, False))
        x = {i: z[names[i]] for i in have}
        if miss:
            slope = cov[np.ix_(miss, have)] @ np.linalg.inv(cov[np.ix_(have, have)])
            centre = mean[miss] + slope @ (np.array([x[i] for i in have]) - mean[have])
            spread = np.sqrt(np.diag(cov[np.ix_(miss, miss)] - slope @ cov[np.ix_(have, miss)]))
            for k, i in enumerate(miss):
                u = (int(hashlib.md5(f"1|{c}|{names[i]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                x[i] = centre[k] + spread[k] * normal.inv_cdf(u)
        w = [weights[o] for o in names]
        sums[c] = (sum(x[i] * w[i] for i in x), sum(v * v for v in w), sum(w))
    tail = lambda rho: {c: 0.5 * math.erfc(zw / math.sqrt((1 - rho) * w2 + rho * w * w) / math.sqrt(2)) for c, (zw, w2, w) in sums.items()}

    def best(grid):
        loss = []
        for rho in grid:
            count = np.bincount([min(int(p * 100), 99) for p in tail(rho).values()], minlength=100)
            loss.append((((1 - count * 100 / len(sums)) ** 2).sum().round(6), rho))
        return min(loss)[1] or 0.1

    coarse = best([k / 10 for k in range(11)])
    p = tail(best([x for k in range(-10, 11) if 0 <= (x := round(coarse + k / 100, 2)) <= 1]))
    order, least, out = sorted(p, key=lambda c: (p[c], c)), 1.0, {}
    for k in range(len(order), 0, -1):
        least = min(least, p[order[k - 1]] * len(order) / k)
        out[order[k - 1]] = (p[order[k - 1]], least)
    return out


@pytest.mark.parametrize("shared,rcsize", [(0.8, 0.5), (0.2, 0.7)])
def test_first_version_by_value(spark, shared, rcsize):
    rng, weights = random.Random(int(shared * 10)), {"a": 0.2, "b": 0.5, "c": 0.9, "d": 0.4}
    normal, cells = NormalDist(), []
    for c in range(400):
        common = rng.gauss(0, 1)
        for o in weights:
            z = math.sqrt(shared) * common + math.sqrt(1 - shared) * rng.gauss(0, 1) + (c < 20)
            if c % 3 == 0 or rng.random() < 0.75:
                cells.append((c, o, None if c == 7 and o == "a" else round(1 - normal.cdf(z), 7)))
    m = spark.createDataFrame(cells, "cluster long, organism string, p double").repartition(3)
    run = Run(None, None, sorted(weights), RunOptions(cop1=True, rcsize=rcsize))
    got = {r["cluster"]: (r["p"], r["fdr"]) for r in run._first_version(m, spark.createDataFrame(list(weights.items()), "organism string, weight double")).collect()}
    want = _plain_first_version(cells, weights, rcsize)
    assert set(got) == set(want) and len(want) < len({c for c, _, _ in cells})
    for c, (p, fdr) in want.items():
        assert got[c] == (pytest.approx(p, abs=1e-6), pytest.approx(fdr, abs=1e-5))


def test_printed_beyond_fifteen_digits(spark):
    """Large numbers and ties below 1e-21, where column expressions took Java's form."""
    xs = [2.0**70, 1.5e300, 5e-324, 2.0**-80, 1e22, 123456789012345680.0]
    for form in ("%.2f", "%.13e", "%.4g"):
        rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", printed(F.col("x"), form).alias("s")).collect()
        assert [r["s"] for r in rows] == [form % r["x"] for r in rows]


def test_mode_files_and_draws_find_hits_once(spark, sf_dir, monkeypatch):
    from rankloom.plans import file_queries, hit_queries, text_queries

    calls, true = [], hit_queries.hits
    monkeypatch.setattr(hit_queries, "hits", lambda *a: calls.append(1) or true(*a))
    file_queries.k01_mode_files(spark, sf_dir)
    assert len(calls) == 1
    plan = hit_queries.a10_a11_imputed_probits(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan


def test_modes_share_one_ranking_and_fit(spark, monkeypatch):
    rng, organisms = random.Random(3), [f"o{k}" for k in range(4)]
    cells = [(c, o, rng.random() ** 2) for c in range(60) for o in organisms if rng.random() < 0.85]
    matrix = spark.createDataFrame(cells, "cluster long, organism string, p double")
    weights = spark.createDataFrame([(o, 0.3 + k / 10) for k, o in enumerate(organisms)], "organism string, weight double")
    masked = [None, matrix.where("cluster % 3 > 0"), matrix.where("organism <> 'o3' or cluster < 20")]
    values = lambda df: {(r["cluster"], r["subset"]): round(r["p"], 9) for r in df.collect()}
    want = [values(CB.combine(matrix, weights, m, fit=CB.fit_rho)) for m in masked]
    calls = []
    monkeypatch.setattr(CB, "_uniform", lambda rows, f=CB._uniform: calls.append(1) or f(rows))
    assert [values(x) for x in CB.combine_each(matrix, weights, masked)] == want and all(want)
    masks = {k: m.select("cluster", "organism") for k, m in zip(("overall", "ooi"), masked[1:])}
    calls.clear()
    out = Run(None, weights, organisms, masks=masks)._results(matrix, None)
    assert list(out) == MODES and len(calls) == 1
    of = [(0, False), (0, True), (1, False), (1, True), (2, True)]
    for mode, (k, own) in zip(MODES, of, strict=True):
        least = {}
        for (c, s), p in want[k].items():
            if not own or "o0" in s.split("_"):
                least[c] = min(p, least.get(c, 2.0))
        assert {r["cluster"]: round(r["p"], 9) for r in out[mode].collect()} == least, mode
