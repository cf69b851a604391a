"""Queries on hits, combinations and ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..functions import text as X
from ..operators import combine as CB
from ..operators import hits as H
from ..operators.ranking import global_row_number
from ..sources.workspace import saved
from . import bindings as B
from .registry import query

ORDER = ", ".join(H.ORDER)
CTE = f"""hits AS ({B.sql(B.HITS)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY organism, locus ORDER BY {ORDER}) AS k FROM hits),
opt AS (SELECT * FROM ranked WHERE k = 1), sub AS (SELECT * FROM ranked WHERE k = 2),
par AS (SELECT organism, 0.0::DOUBLE AS xi, avg(-energy) - 0.57722 * stddev_samp(-energy) * sqrt(6) / pi() AS mu, stddev_samp(-energy) * sqrt(6) / pi() AS sigma FROM opt GROUP BY organism),
scored AS (SELECT opt.*, {N.gev_survival('(-energy)', 'xi', 'mu', 'sigma')} AS p FROM opt JOIN par USING (organism)),
matrix AS (SELECT cluster, organism, p, start1, end1, start2, end2, locus, energy FROM scored),
weights AS ({B.sql(B.WEIGHTS)}),
probits AS (SELECT cluster, organism, p, weight, {N.probit('p')} AS z FROM matrix JOIN weights USING (organism))"""
SUBSETS = f"""{CTE},
pre AS (SELECT cluster, row_number() OVER w AS k, array_to_string(list_sort(list(organism) OVER (PARTITION BY cluster ORDER BY p, organism ROWS UNBOUNDED PRECEDING)), '_') AS subset
  FROM matrix WINDOW w AS (PARTITION BY cluster ORDER BY p, organism)),
own AS (SELECT cluster, k::INT AS k, subset FROM pre WHERE k >= 3),
mem AS (SELECT subset, unnest(string_split(subset, '_')) AS organism FROM (SELECT DISTINCT subset FROM own)),
sums AS (SELECT cluster, mem.subset, sum(z * weight) AS zw, sum(weight * weight) AS w2, sum(weight) AS w, count(*) AS n FROM probits JOIN mem USING (organism) GROUP BY cluster, mem.subset),
rws AS (SELECT cluster, subset, zw, w2, w FROM sums WHERE n = len(string_split(subset, '_'))),
rk AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY zw DESC, cluster) * 1.0::DOUBLE / count(*) OVER (PARTITION BY subset) AS y FROM rws),
grid AS (SELECT unnest([{', '.join(N.lit(r) for r in CB.GRID)}]) AS rho),
losses AS (SELECT subset, rho, round(sum(pow(y - ({N.combined('zw', 'w2', 'w', 'rho')}), 2)), 9) AS loss FROM rk, grid GROUP BY subset, rho),
rhos AS (SELECT subset, rho FROM losses QUALIFY row_number() OVER (PARTITION BY subset ORDER BY loss, rho) = 1),
bysub AS (SELECT own.cluster, own.subset, {N.combined('zw', 'w2', 'w', 'rho')} AS p FROM own JOIN rws USING (cluster, subset) JOIN rhos USING (subset)),
bal AS (SELECT cluster, min(p) AS p FROM bysub GROUP BY cluster),
byorg AS (SELECT cluster, organism, min(p) AS p FROM (SELECT cluster, p, unnest(string_split(subset, '_')) AS organism FROM bysub) GROUP BY cluster, organism)"""


def bh(table: str, by: str = "", cols: str = "*", p: str = "p", order: str = "cluster") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT {cols}, CASE WHEN {p} IS NOT NULL THEN least(1.0, min({p} * n / r) OVER ({part} ORDER BY r DESC NULLS LAST ROWS UNBOUNDED PRECEDING)) END AS fdr
  FROM (SELECT *, count({p}) OVER ({part}) AS n, CASE WHEN {p} IS NOT NULL THEN row_number() OVER ({part} ORDER BY {p} NULLS LAST, {order}) END AS r FROM {table}))"""


def hits(spark, d):
    return B.bind(spark, d, B.HITS)


def opt(spark, d):
    return H.best_hits(hits(spark, d))


def scored(spark, d):
    best = saved(opt(spark, d))  # once for the parameters and the values
    return H.with_p_values(best, H.moment_params(best))


def matrix(spark, d):
    return scored(spark, d).select("cluster", "organism", "p", "start1", "end1", "start2", "end2", "locus", "energy")


def weights(spark, d):
    return B.bind(spark, d, B.WEIGHTS)


def by_subset(spark, d):
    return CB.combine(matrix(spark, d), weights(spark, d))


def flagship(spark, d):
    """Hits to ranked clusters: best hits, p-values, subsets of organisms, combined p, false discovery rate, top rows."""
    out = N.bh_fdr(CB.balanced_p(by_subset(spark, d)), "p", ["cluster"])
    return out.select("cluster", F.round("p", 6).alias("p"), F.round("fdr", 6).alias("fdr")).orderBy(F.col("p").asc_nulls_last(), "cluster").limit(200)


FLAG = f"WITH {SUBSETS} SELECT cluster, round(p, 6) AS p, round(fdr, 6) AS fdr FROM {bh('bal')} ORDER BY 2 NULLS LAST, 1 LIMIT 200"
query(FLAG, "flagship_ranked_clusters")(flagship)


@query(f"WITH {CTE} SELECT organism, locus, energy, start1, end1 FROM opt")
def w01_best_hit(spark, d):
    return opt(spark, d).select("organism", "locus", "energy", "start1", "end1")


@query(f"WITH {CTE} SELECT organism, locus, energy, start1, end1 FROM sub")
def w01_second_best_hit(spark, d):
    return H.best_hits(hits(spark, d), 2).select("organism", "locus", "energy", "start1", "end1")


@query(f"WITH {CTE} SELECT organism, locus, p FROM scored")
def a07_extreme_value_p(spark, d):
    return scored(spark, d).select("organism", "locus", "p")


#: The fit where a hard limit ends the values, as in these tables: the closed form at xi = -1, marked by its likelihood being above
#: that of the distribution with the sample's first three L-moments, written out anew.
FIT = f"""{CTE}, v AS (SELECT organism, -energy AS x, row_number() OVER (PARTITION BY organism ORDER BY -energy) AS r, count(*) OVER (PARTITION BY organism) AS n FROM opt),
mo AS (SELECT organism, count(*) AS n, max(x) AS most, avg(x) AS l1, 2 * avg(x * (r - 1) / (n - 1)) - avg(x) AS l2, 6 * avg(x * (r - 1) * (r - 2) / ((n - 1) * (n - 2))) - 6 * avg(x * (r - 1) / (n - 1)) + avg(x) AS l3 FROM v GROUP BY organism),
sh AS (SELECT *, 7.859 * (2 / (3 + l3 / l2) - ln(2) / ln(3)) + 2.9554 * pow(2 / (3 + l3 / l2) - ln(2) / ln(3), 2) AS k FROM mo),
sc AS (SELECT *, l2 * k / ((1 - pow(2, -k)) * gamma(1 + k)) AS sigma FROM sh),
rival AS (SELECT sc.organism, sum(CASE WHEN 1 - k * (x - (l1 - sigma * (1 - gamma(1 + k)) / k)) / sigma > 0 THEN -ln(sigma) - (1 - 1 / k) * ln(1 - k * (x - (l1 - sigma * (1 - gamma(1 + k)) / k)) / sigma)
  - pow(1 - k * (x - (l1 - sigma * (1 - gamma(1 + k)) / k)) / sigma, 1 / k) ELSE -1e9 END) AS ll FROM v JOIN sc USING (organism) GROUP BY sc.organism),
fit AS (SELECT mo.organism, n, -1.0::DOUBLE AS xi, l1 AS mu, most - l1 AS sigma, -n * (ln(most - l1) + 1) AS ll, CASE WHEN -n * (ln(most - l1) + 1) > rival.ll THEN 'boundary' END AS status FROM mo JOIN rival USING (organism))"""


@query(f"WITH {FIT} SELECT organism, n, round(xi, 4) AS xi, round(mu, 4) AS mu, round(sigma, 4) AS sigma, round(ll / n, 6) AS mean_log_likelihood, status FROM fit")
def a06_gev_fit(spark, d):
    fit = H.gev_fit(opt(spark, d))
    return fit.select("organism", "n", *[F.round(c, 4).alias(c) for c in ("xi", "mu", "sigma")], F.round(F.col("log_likelihood") / F.col("n"), 6).alias("mean_log_likelihood"), "status")


@query(f"WITH {FIT} SELECT organism, locus, {N.gev_survival('(-energy)', 'xi', 'mu', 'sigma')} AS p FROM opt JOIN fit USING (organism)")
def a07_fitted_extreme_value_p(spark, d):
    best = saved(opt(spark, d))
    return H.with_p_values(best, H.gev_params(best)).select("organism", "locus", "p")


@query(f"WITH {CTE} SELECT cluster, organism, round(z, 6) AS z, round({N.tail('z')}, 6) AS back FROM probits")
def a08_probit(spark, d):
    z = matrix(spark, d).withColumn("z", N.probit_col("p"))
    return z.select("cluster", "organism", F.round("z", 6).alias("z"), F.round(N.tail_col("z"), 6).alias("back"))


MEMBER_CTE = f"{CTE}, mem2 AS (SELECT cluster % 300 AS cluster, organism, locus, p FROM scored)"


@query(f"WITH {MEMBER_CTE} SELECT cluster, organism, locus, p FROM mem2 QUALIFY row_number() OVER (PARTITION BY cluster, organism ORDER BY p, locus) = 1")
def a01_cluster_minimum(spark, d):
    members = scored(spark, d).select((F.col("cluster") % 300).alias("cluster"), "organism", "locus", "p")
    return H.cluster_minimum(members)


@query(f"WITH {CTE} SELECT cluster, n_organisms, n_organisms / 5 AS share FROM (SELECT cluster, count(*) AS n_organisms FROM matrix GROUP BY cluster) WHERE n_organisms / 5 >= 0.9")
def a02_cluster_size(spark, d):
    return H.cluster_sizes(matrix(spark, d), 5, 0.9)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def a03_duplicates(spark, d):
    orders = B.load(spark, d, "orders")["orders"]
    return orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def a04_first_row(spark, d):
    orders = B.load(spark, d, "orders")["orders"]
    first = orders.withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return first.where("k = 1").select("o_custkey", "o_orderkey", "o_totalprice")


BLAST = """SELECT concat('p', l_partkey) AS qid, concat('p', l_suppkey * 7) AS sid, 1 - l_discount * 6 AS ident, l_tax / 50 AS eval, l_orderkey AS ord FROM {lineitem}"""


@query(f"""WITH b AS ({B.sql(BLAST)}), x AS (SELECT least(qid, sid) AS a, greatest(qid, sid) AS b, qid, sid, ident, eval FROM b WHERE eval <= 0.001 AND qid <> sid)
SELECT a, b, ident, eval FROM x QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY eval, ident DESC, qid, sid) = 1""")
def a05_best_pair(spark, d):
    return H.best_pairs(B.bind(spark, d, BLAST)).select("a", "b", "ident", "eval")


@query("""WITH x AS (SELECT DISTINCT 1 - (1 - l_discount * 6) AS d FROM lineitem)
SELECT round(d, 6) AS d, round(CASE WHEN 1 - d - 0.2 * d * d > 0 THEN -ln(1 - d - 0.2 * d * d) * 100 END, 6) AS distance FROM x""")
def f04_protein_distance(spark, d):
    x = B.load(spark, d, "lineitem")["lineitem"].select((1 - (1 - F.col("l_discount") * 6)).alias("d")).distinct()
    return x.select(F.round("d", 6).alias("d"), F.round(H.protein_distance(1 - F.col("d")), 6).alias("distance"))


@query(f"WITH {SUBSETS} SELECT cluster, k, subset FROM own")
def a14_prefix_subsets(spark, d):
    return CB.prefix_sets(matrix(spark, d))


@query(f"WITH {SUBSETS} SELECT subset, count(*) AS n FROM own GROUP BY subset")
def a15_rows_by_subset(spark, d):
    return CB.prefix_sets(matrix(spark, d)).groupBy("subset").agg(F.count("*").alias("n"))


@query(f"WITH {SUBSETS} SELECT subset, rho FROM rhos")
def a16_correlation_grid(spark, d):
    m = matrix(spark, d)
    return CB.fit_rho_grid(CB.subset_rows(m, CB.prefix_sets(m), weights(spark, d)))


def _newton(steps: int = 25) -> str:
    """The steps of the fit one after another, each a table of the subsets' states."""
    out = ["s0 AS MATERIALIZED (SELECT DISTINCT subset, 0.0::DOUBLE AS best, 0.0::DOUBLE AS rho, 'infinity'::DOUBLE AS least FROM rk)"]
    for k in range(steps):
        sums = ", ".join(f"{e} AS {n}" for n, e in CB.SUMS.items())
        step = ", ".join(f"{e} AS {n}" for n, e in CB.STEP.items())
        out.append(f"g{k} AS MATERIALIZED (SELECT subset, {sums} FROM rk JOIN (SELECT subset, rho FROM s{k}) USING (subset) GROUP BY subset)")
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT subset, {step} FROM s{k} JOIN g{k} USING (subset))")
    return ", ".join(out)


NEWTON = f"{SUBSETS.split(', grid AS' if ', grid AS' in SUBSETS else chr(10) + 'grid AS')[0].rstrip(',')}, {_newton()}"


@query(f"WITH {NEWTON} SELECT subset, round(best, 5) AS rho, CASE WHEN abs(rho - best) <= 1e-7 THEN 'converged' ELSE 'stopped' END AS status FROM s25")
def a16_correlation_gauss_newton(spark, d):
    m = matrix(spark, d)
    return CB.fit_rho(CB.subset_rows(m, CB.prefix_sets(m), weights(spark, d))).withColumn("rho", F.round("rho", 5))


@query(f"WITH {CTE} SELECT cluster, round({N.combined('zw', 'w2', 'w', N.lit(0.3))}, 6) AS p FROM (SELECT cluster, sum(z * weight) AS zw, sum(weight * weight) AS w2, sum(weight) AS w FROM probits GROUP BY cluster)")
def a12_combined_p(spark, d):
    z = matrix(spark, d).join(weights(spark, d), "organism").withColumn("z", N.probit_col("p"))
    sums = z.groupBy("cluster").agg(F.sum(F.col("z") * F.col("weight")).alias("zw"), F.sum(F.col("weight") * F.col("weight")).alias("w2"), F.sum("weight").alias("w"))
    return sums.select("cluster", F.round(F.expr(N.combined("zw", "w2", "w", N.lit(0.3))), 6).alias("p"))


@query(f"WITH {SUBSETS} SELECT cluster, round(p, 6) AS p FROM bal")
def a20_balanced_p(spark, d):
    return CB.balanced_p(by_subset(spark, d)).select("cluster", F.round("p", 6).alias("p"))


@query(f"WITH {SUBSETS} SELECT cluster, organism, round(p, 6) AS p FROM byorg")
def a20_organism_p(spark, d):
    return CB.organism_p(by_subset(spark, d)).select("cluster", "organism", F.round("p", 6).alias("p"))


@query(f"WITH {CTE} SELECT organism, cluster, round(fdr, 6) AS fdr FROM {bh('matrix', 'organism')}")
def a21_bh_fdr(spark, d):
    return N.bh_fdr(matrix(spark, d), "p", ["cluster"], ["organism"]).select("organism", "cluster", F.round("fdr", 6).alias("fdr"))


@query(f"WITH {SUBSETS} SELECT organism, cluster, row_number() OVER (PARTITION BY organism ORDER BY p, cluster)::INT AS rank FROM byorg")
def w02_organism_rank(spark, d):
    return CB.organism_ranks(CB.organism_p(by_subset(spark, d))).select("organism", "cluster", "rank")


@query(f"""WITH {SUBSETS}, rr AS (SELECT *, row_number() OVER (PARTITION BY organism ORDER BY p, cluster) AS rank FROM byorg),
ch AS (SELECT DISTINCT cluster FROM rr WHERE rank <= 200)
SELECT rr.cluster, sum(CASE WHEN rank <= 250 THEN 1.0 ELSE 0.0 END)::DOUBLE / 5 AS rank_share, sum(CASE WHEN rr.p <= 0.001 THEN 1.0 ELSE 0.0 END)::DOUBLE / 5 AS p_share,
 sum(CASE WHEN matrix.p <= 0.3 THEN 1.0 ELSE 0.0 END)::DOUBLE / 5 AS single_share
FROM rr JOIN ch USING (cluster) LEFT JOIN matrix ON rr.cluster = matrix.cluster AND rr.organism = matrix.organism GROUP BY rr.cluster""")
def a23_agreement(spark, d):
    return CB.agreement(CB.organism_ranks(CB.organism_p(by_subset(spark, d))), matrix(spark, d), 5)


RRA = f"""rk2 AS (SELECT *, row_number() OVER (PARTITION BY organism ORDER BY p, cluster) AS rank FROM byorg),
ch AS (SELECT DISTINCT cluster FROM rk2 WHERE rank <= 200),
sm AS (SELECT cluster, organism, row_number() OVER (PARTITION BY organism ORDER BY rank) / (SELECT count(*) FROM ch) AS x FROM rk2 JOIN ch USING (cluster)),
os AS (SELECT cluster, x, row_number() OVER (PARTITION BY cluster ORDER BY x) AS k FROM sm),
wy AS (SELECT * FROM (VALUES (1, 5.0::DOUBLE), (2, 10.0), (3, 10.0), (4, 5.0), (5, 1.0)) v(j, ways)),
tl AS (SELECT cluster, k, x, sum(ways * pow(x, j) * pow(1 - x, 5 - j)) AS tail FROM os JOIN wy ON j >= k GROUP BY cluster, k, x),
ra AS (SELECT cluster, least(1.0, 5 * min(tail)) AS rank_p FROM tl GROUP BY cluster)"""


@query(f"WITH {SUBSETS}, {RRA} SELECT cluster, round(rank_p, 6) AS rank_p FROM ra")
def a22_rank_aggregation(spark, d):
    return CB.robust_rank_aggregation(CB.organism_ranks(CB.organism_p(by_subset(spark, d))), 5).withColumn("rank_p", F.round("rank_p", 6))


@query(f"""WITH {SUBSETS}, rr AS (SELECT cluster, organism, row_number() OVER (PARTITION BY organism ORDER BY p, cluster) AS rank FROM byorg)
SELECT DISTINCT cluster FROM rr WHERE rank <= 200""")
def o08_top_union(spark, d):
    r = CB.organism_ranks(CB.organism_p(by_subset(spark, d)))
    return r.where("rank <= 200").select("cluster").distinct()


MASK = "(cluster + CAST(substr(organism, 4) AS INT)) % 4 <> 0"
MASKED = SUBSETS.replace("pre AS (SELECT cluster", f"mk AS (SELECT * FROM matrix WHERE {MASK}), pre AS (SELECT cluster", 1).replace("FROM matrix WINDOW w", "FROM mk WINDOW w", 1)
MASKED = MASKED.split("bysub AS")[0] + f"""msums AS (SELECT p1.cluster, mem.subset, sum(z * weight) AS zw, sum(weight * weight) AS w2, sum(weight) AS w, count(*) AS n FROM probits p1 JOIN mem USING (organism) WHERE {MASK.replace('cluster', 'p1.cluster').replace('organism', 'p1.organism')} GROUP BY p1.cluster, mem.subset),
bysub AS (SELECT own.cluster, own.subset, {N.combined('m.zw', 'm.w2', 'm.w', 'rho')} AS p FROM own JOIN msums m USING (cluster, subset) JOIN rhos USING (subset) WHERE m.n = len(string_split(own.subset, '_')))"""


@query(f"WITH {MASKED} SELECT cluster, round(min(p), 6) AS p FROM bysub GROUP BY cluster")
def a24_consensus_p(spark, d):
    m = matrix(spark, d)
    out = CB.balanced_p(CB.combine(m, weights(spark, d), masked=m.where(F.expr(MASK))))
    return out.select("cluster", F.round("p", 6).alias("p"))


FULL = f"""{CTE}, fl AS (SELECT cluster FROM matrix GROUP BY cluster HAVING count(*) = 5), zz AS (SELECT cluster, organism, z, weight FROM probits JOIN fl USING (cluster))"""


@query(f"""WITH {FULL} SELECT x.organism AS a, y.organism AS b, round(avg(x.z), 6) AS mean_a, round(avg(y.z), 6) AS mean_b, round(covar_samp(x.z, y.z), 6) AS cov
FROM zz x JOIN zz y USING (cluster) GROUP BY x.organism, y.organism""")
def a09_covariance(spark, d):
    cov = CB.covariance(CB.complete_probits(matrix(spark, d), 5))
    return cov.select("a", "b", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "cov")])


def _imputed(spark, d):
    m = saved(matrix(spark, d))
    return CB.impute(m, CB.covariance(saved(CB.complete_probits(m, 5))))


@query(None)
def a10_a11_imputed_probits(spark, d):
    return _imputed(spark, d).select("cluster", "organism", F.round("z", 6).alias("z"), "sampled")


GRID1 = [k / 10 for k in range(1, 10)]


@query(f"""WITH {FULL}, s AS (SELECT cluster, sum(z * weight) AS zw, sum(weight * weight) AS w2, sum(weight) AS w FROM zz GROUP BY cluster),
g AS (SELECT unnest([{', '.join(N.lit(r) for r in GRID1)}]) AS rho), b AS (SELECT rho, least(floor(({N.combined('zw', 'w2', 'w', 'rho')}) * 100), 99) AS bin FROM s, g),
c AS (SELECT rho, bin, count(*) AS c FROM b GROUP BY rho, bin), e AS (SELECT rho, c * 100.0::DOUBLE / sum(c) OVER (PARTITION BY rho) AS d FROM c)
SELECT rho, round(sum(pow(1 - d, 2)) + 100 - count(*), 4) AS loss FROM e GROUP BY rho""")
def a13_density_search(spark, d):
    z = CB.complete_probits(matrix(spark, d), 5).join(weights(spark, d), "organism")
    sums = z.groupBy("cluster").agg(F.sum(F.col("z") * F.col("weight")).alias("zw"), F.sum(F.col("weight") * F.col("weight")).alias("w2"), F.sum("weight").alias("w"))
    return CB.density_rho(sums, GRID1).select("rho", F.round("loss", 4).alias("loss"))


@query(f"WITH {CTE} SELECT cluster, (5 - count(p))::BIGINT AS n_missing FROM matrix GROUP BY cluster")
def a32_missing_organisms(spark, d):
    from ..operators.annotate import missing_counts

    return missing_counts(matrix(spark, d), 5)


@query(f"WITH {CTE} SELECT cluster, organism, CASE WHEN p <= 0.001 THEN 1 WHEN p <= 0.01 THEN 2 WHEN p <= 0.1 THEN 3 WHEN p <= 0.2 THEN 4 WHEN p <= 0.3 THEN 5 ELSE 6 END AS bin FROM matrix")
def p13_p_value_bins(spark, d):
    return matrix(spark, d).select("cluster", "organism", X.p_bin(F.col("p")).alias("bin"))


@query(f"WITH {CTE}, o AS (SELECT cluster AS row_id, p FROM matrix WHERE organism = 'org0') SELECT row_id, p, row_number() OVER (ORDER BY CASE WHEN p <= 0.5 THEN 0 ELSE 1 END, row_id) AS place FROM o")
def p20_threshold_order(spark, d):
    from ..operators.annotate import ordered_by_threshold

    o = matrix(spark, d).where("organism = 'org0'").select(F.col("cluster").alias("row_id"), "p")
    return ordered_by_threshold(o, "p", 0.5).select("row_id", "p", "place")


@query(f"WITH {CTE} SELECT cluster, organism, p, weight FROM matrix JOIN weights USING (organism)")
def j05_organism_weight(spark, d):
    return matrix(spark, d).join(weights(spark, d), "organism").select("cluster", "organism", "p", "weight")


@query(f"WITH {CTE} SELECT organism, weight FROM weights WHERE weight > 0.2")
def p23_heavy_weights(spark, d):
    from ..operators.phylogeny import heavy_weights

    return heavy_weights(weights(spark, d), 0.2)


@query(f"WITH {CTE} SELECT organism, round(pow(weight, 1.0 / 2), 9) AS weight FROM weights")
def a28_weight_root(spark, d):
    from ..operators.phylogeny import rooted_weights

    return rooted_weights(weights(spark, d), 2).select("organism", F.round("weight", 9).alias("weight"))


@query(f"WITH {CTE} SELECT organism, locus, energy, row_number() OVER (PARTITION BY organism ORDER BY {ORDER}, locus)::INT AS place FROM opt")
def o01_energy_order(spark, d):
    places = global_row_number(opt(spark, d), [*H.ORDER, "locus"], by=["organism"])
    return places.select("organism", "locus", "energy", F.col("place").cast("int").alias("place"))


@query(f"WITH {CTE} SELECT organism, locus, p FROM scored ORDER BY p, organism, locus LIMIT 200")
def o06_top_count(spark, d):
    return scored(spark, d).select("organism", "locus", "p").orderBy("p", "organism", "locus").limit(200)


@query(f"WITH {CTE} SELECT organism, locus, opt.energy AS opt_energy, sub.energy AS sub_energy FROM opt LEFT JOIN sub USING (organism, locus)")
def j11_best_and_second(spark, d):
    sub = H.best_hits(hits(spark, d), 2).select("organism", "locus", F.col("energy").alias("sub_energy"))
    return opt(spark, d).select("organism", "locus", F.col("energy").alias("opt_energy")).join(sub, ["organism", "locus"], "left")


@query(f"WITH {CTE} SELECT cluster, organism, coalesce(CASE WHEN cluster % 3 <> 0 THEN p END, CASE WHEN cluster % 2 = 0 THEN p / 2 END) AS p FROM matrix")
def p19_coalesced_p(spark, d):
    m = matrix(spark, d)
    return m.select("cluster", "organism", F.coalesce(F.when(F.col("cluster") % 3 != 0, F.col("p")), F.when(F.col("cluster") % 2 == 0, F.col("p") / 2)).alias("p"))


@query(f"WITH {CTE}, z AS (SELECT cluster, bool_and(isfinite(z)) AS ok FROM probits GROUP BY cluster) SELECT cluster FROM z WHERE ok")
def p21_finite_rows(spark, d):
    z = matrix(spark, d).withColumn("z", N.probit_col("p"))
    bad = F.col("z").isNull() | F.isnan("z") | (F.abs("z") == float("inf"))
    return z.groupBy("cluster").agg(F.bool_and(~bad).alias("ok")).where("ok").select("cluster")
