"""Hits: best and second-best per gene, extreme-value p-values, homology clusters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..sources.workspace import saved
from .ranking import global_row_number

#: Columns that order hits totally: energy first, then everything that can differ.
ORDER = ["energy", "ord", "num", "start1", "end1", "start2", "end2"]


def ranked_hits(hits: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """Numbers the hits of each (organism, locus) from the lowest energy."""
    return hits.withColumn("hit_rank", F.row_number().over(Window.partitionBy("organism", "locus").orderBy(*order)))


def best_hits(hits: DataFrame, k: int = 1) -> DataFrame:
    """The k-th best hit of each gene; a filter on the rank, so a window group limit keeps partitions small."""
    return ranked_hits(hits).where(F.col("hit_rank") == k).drop("hit_rank")


def moment_params(opt: DataFrame) -> DataFrame:
    """Gumbel parameters of -energy per organism by the method of moments."""
    x = -F.col("energy")
    sigma = F.stddev_samp(x) * math.sqrt(6) / math.pi
    return opt.groupBy("organism").agg(F.lit(0.0).alias("xi"), (F.avg(x) - N.EULER * sigma).alias("mu"), sigma.alias("sigma"))


def likelihood_terms(x: str = "x", xi: str = "xi", mu: str = "mu", s: str = "s") -> tuple[list[tuple[str, str]], dict[str, str]]:
    """The log likelihood of one value of a generalised extreme value distribution (xi <> 0, scale exp(s), inside the support) and its
    derivatives as SQL that engines share: steps to be computed one after the other, and the summands by name."""
    steps = [
        ("t", f"({x} - {mu}) * exp(-{s})"), ("y", f"1 + {xi} * t"), ("l", "ln(y)"), ("w", f"exp(-l / {xi})"), ("q", "t / y"), ("a", f"(l / {xi} - q) / {xi}"),
        ("gt", f"(1 + {xi} - w) / y"), ("gtt", f"(1 + {xi}) * (w - {xi}) / (y * y)"), ("gtx", f"((1 - w * a) - (1 + {xi} - w) * q) / y"),
        ("gx", f"(1 + 1 / {xi}) * q + w * a - l / ({xi} * {xi})"),
        ("gxx", f"2 * (l / {xi} - q) / ({xi} * {xi}) - (1 + 1 / {xi}) * q * q + w * (a * a + (2 * (q - l / {xi}) / {xi} + q * q) / {xi})"),
    ]
    sums = {
        "ll": f"-({s}) - (1 + 1 / {xi}) * l - w", "d_xi": "-gx", "d_mu": "gt", "d_s": "t * gt - 1", "h_xixi": "-gxx", "h_ximu": "gtx", "h_xis": "t * gtx",
        "h_mumu": "-gtt", "h_mus": "-gt - t * gtt", "h_ss": "-t * gt - t * t * gtt",
    }
    return steps, sums  # derivatives by mu are in units of the scale: of mu / exp(s)


#: The fit ends where a Newton step promises less likelihood than this; it is marked "stopped" after so many passes over the values.
FIT_GAIN, FIT_PASSES = 1e-6, 40
#: Shapes nearer to 0 are taken for this one; there the distribution is the Gumbel's but for rounding.
FLAT = 1e-4
#: Least shape: below it the likelihood grows without bound as the support's end nears the largest value.
LEAST_XI = -1.0


def l_moment_start(l1: float, b1: float, b2: float) -> tuple[float, float, float]:
    """(xi, mu, scale) with the first three L-moments given by probability-weighted moments (Hosking's approximation)."""
    l2, l3 = 2 * b1 - l1, 6 * b2 - 6 * b1 + l1
    c = 2 / (3 + l3 / l2) - math.log(2) / math.log(3)
    k = min(max(7.859 * c + 2.9554 * c * c, -0.9), 0.9)
    k = k if abs(k) > FLAT else FLAT
    scale = l2 * k / ((1 - 2**-k) * math.gamma(1 + k))
    return -k, l1 - scale * (1 - math.gamma(1 + k)) / k, scale


class _Climb:
    """One organism's way to its greatest likelihood: Newton steps, shortened where they leave the support or lead down."""

    def __init__(self, n: int, least: float, most: float, mean: float, start: tuple[float, float, float]):
        self.n, self.least, self.most = n, least, most
        xi, mu, scale = start
        if xi < 0 and mu - scale / xi <= most:  # the end of the support beyond the largest value
            xi = -scale / (most - mu + 0.1 * scale)
        if xi > 0 and mu - scale / xi >= least:
            xi = scale / (mu - least + 0.1 * scale)
        self.at = self.best = np.array([max(xi, LEAST_XI + 0.01), mu, math.log(scale)])
        while not self.inside(self.at):  # a wider scale takes every value in
            self.at = self.best = self.at + [0, 0, 0.5]
        self.value, self.score, self.step, self.passes, self.status = -math.inf, np.zeros(3), np.zeros(3), 0, "stopped"
        # on the bound xi = -1 the density is exponential below the largest value
        self.edge = most - mean
        self.edge_value = -n * (math.log(self.edge) + 1)

    def inside(self, at: np.ndarray) -> bool:
        xi, mu, s = at
        return xi > LEAST_XI and all(1 + xi * (v - mu) * math.exp(-s) > 1e-9 for v in (self.least, self.most))

    @staticmethod
    def newton(score: np.ndarray, curve: np.ndarray) -> np.ndarray:
        size, axes = np.linalg.eigh(-curve)
        return axes @ (axes.T @ score / np.maximum(np.abs(size), 1e-9 * np.abs(size).max()))

    def move(self, value: float, score: np.ndarray, curve: np.ndarray) -> bool:
        """Takes the likelihood and its derivatives at the point asked for; whether the end is reached."""
        self.passes += 1
        if value >= self.value:
            self.best, self.value, self.score = self.at, value, score
            step = self.newton(score, curve)
            if abs(self.best[0]) <= FLAT and abs(self.best[0] + step[0]) < FLAT:  # no shape between is told from the Gumbel's
                score = score * [0, 1, 1]
                step = self.newton(score, curve * np.outer([0, 1, 1], [0, 1, 1]) - np.diag([1.0, 0, 0]))
            if score @ step / 2 < FIT_GAIN:
                self.status = "converged"
                return self.end()
            if self.best[0] + step[0] <= LEAST_XI and self.edge_value > value:
                return self.end()
            self.step = step / max(1.0, np.abs(step / [0.3, 1.0, 0.7]).max())
        else:
            self.step = self.step / 4
        while not self.inside(self.best + self.step * [1, math.exp(self.best[2]), 1]):
            self.step = self.step / 2
        self.at = self.best + self.step * [1, math.exp(self.best[2]), 1]
        if abs(self.at[0]) < FLAT:
            self.at[0] = math.copysign(FLAT, self.at[0])
        return bool(np.abs(self.step).max() < 1e-9) and self.end()

    def end(self) -> bool:
        """The bound where it is more likely than what was reached."""
        if self.edge_value > self.value:
            self.status, self.value, self.best = "boundary", self.edge_value, np.array([LEAST_XI, self.most - self.edge, math.log(self.edge)])
        return True


def gev_fit(opt: DataFrame) -> DataFrame:
    """(organism, xi, mu, sigma, n, log_likelihood, slope, passes, status): the generalised extreme value distribution of greatest likelihood with
    xi not below -1, of the negated energies of each organism.

    The start has the sample's first three L-moments, from ranks that are found by ranges. Each pass adds up the likelihood and its first and
    second derivatives over all values of all organisms in one aggregate with partial sums, and moves each organism by a Newton
    step. Whatever the number of hits, all are in every sum and no task gathers an organism; the driver holds a row per organism.
    status is "converged"; "boundary" where xi = -1 with the support ending at the largest value is more likely than any shape above
    (as for values that end at a hard limit); "degenerate" for fewer than three or equal values, which keep xi 0 and their mean; "stopped"
    if the passes ran out, the result then being the best point seen. slope is the largest derivative of the mean likelihood (by xi, mu in scales, log scale) at the result.
    """
    x = opt.select("organism", (-F.col("energy")).cast("double").alias("x")).where("x is not null")
    x = saved(global_row_number(x, ["x"], "r", by=["organism"], total="n"))
    spark, kind = opt.sparkSession, opt.schema["organism"].dataType.simpleString()
    r, n = F.col("r"), F.col("n")
    moments = [F.max("n").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("m"), F.avg(F.try_divide(F.col("x") * (r - 1), n - 1)).alias("b1"), F.avg(F.try_divide(F.col("x") * (r - 1) * (r - 2), (n - 1) * (n - 2))).alias("b2")]
    climbs, rows = {}, []
    for o in x.groupBy("organism").agg(*moments).collect():  # organisms
        if o["n"] < 3 or o["least"] == o["most"]:
            rows.append((o["organism"], 0.0, o["m"], 1.0, o["n"], None, None, 0, "degenerate"))
        else:
            climbs[o["organism"]] = _Climb(o["n"], o["least"], o["most"], o["m"], l_moment_start(o["m"], o["b1"], o["b2"]))
    steps, sums = likelihood_terms()
    live = dict(climbs)
    while live:
        now = spark.createDataFrame([(o, *map(float, c.at)) for o, c in live.items()], f"organism {kind}, xi double, mu double, s double")
        each = x.select("organism", "x").join(F.broadcast(now), "organism")
        for name, text in steps:
            each = each.withColumn(name, F.expr(text))
        for r in each.groupBy("organism").agg(*[F.sum(F.expr(text)).alias(k) for k, text in sums.items()]).collect():  # a row per organism
            curve = np.array([[r["h_xixi"], r["h_ximu"], r["h_xis"]], [r["h_ximu"], r["h_mumu"], r["h_mus"]], [r["h_xis"], r["h_mus"], r["h_ss"]]])
            climb = live[r["organism"]]
            if climb.move(r["ll"], np.array([r["d_xi"], r["d_mu"], r["d_s"]]), curve) or climb.passes >= FIT_PASSES and climb.end():
                del live[r["organism"]]
    for o, c in climbs.items():
        slope = None if c.status == "boundary" else float(np.abs(c.score).max() / c.n)
        rows.append((o, float(c.best[0]), float(c.best[1]), math.exp(c.best[2]), c.n, c.value, slope, c.passes, c.status))
    return spark.createDataFrame(rows, f"organism {kind}, xi double, mu double, sigma double, n long, log_likelihood double, slope double, passes int, status string")


def gev_params(opt: DataFrame) -> DataFrame:
    """(organism, xi, mu, sigma) of the fit."""
    return gev_fit(opt).select("organism", "xi", "mu", "sigma")


def with_p_values(hits: DataFrame, params: DataFrame) -> DataFrame:
    """Adds p from the parameters of each hit's organism (a row per organism: joined as the planner sees fit)."""
    return hits.join(params, "organism").withColumn("p", F.expr(N.gev_survival("(-energy)", "xi", "mu", "sigma"))).drop("xi", "mu", "sigma")


def cluster_minimum(members: DataFrame, order: list[str] = ("p", "locus")) -> DataFrame:
    """The member with the smallest p of each (cluster, organism); the first in ``order`` of equal ones."""
    w = Window.partitionBy("cluster", "organism").orderBy(*order)
    return members.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def cluster_sizes(matrix: DataFrame, organisms: int, least_share: float = 0.5) -> DataFrame:
    """(cluster, n_organisms, share) of clusters with at least ``least_share`` of the organisms."""
    out = matrix.groupBy("cluster").agg(F.count("*").alias("n_organisms")).withColumn("share", F.col("n_organisms") / organisms)
    return out.where(F.col("share") >= least_share)


def best_pairs(blast: DataFrame, cutoff: float = 1e-3) -> DataFrame:
    """The best row of each unordered pair of a BLAST table under the e-value cutoff; ties by the longer, then the row."""
    pair = blast.where((F.col("eval") <= cutoff) & (F.col("qid") != F.col("sid")))
    pair = pair.withColumns({"a": F.least("qid", "sid"), "b": F.greatest("qid", "sid")})
    w = Window.partitionBy("a", "b").orderBy("eval", F.desc("ident"), "qid", "sid")
    return pair.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def protein_distance(ident):
    """Kimura's protein distance of a share of identical residues, times 100; null outside its domain."""
    d = 1 - ident
    inside = 1 - d - 0.2 * d * d
    return F.when(inside > 0, -F.ln(inside) * 100)
