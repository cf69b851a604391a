"""Whole runs: from hits to the result tables of every mode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..operators import combine as CB
from ..operators import conserve as C
from ..operators import hits as H
from ..operators import phylogeny as P
from ..operators.annotate import ordered_by_threshold
from ..sources.workspace import saved
from .options import RunOptions, choose_mode

#: The five results of a run.
MODES = ["balanced", "ooi", "balanced_consensus", "ooi_consensus", "ooi_ooiconsensus"]


@dataclass
class Run:
    """Inputs of a run: hits with clusters and organism weights.

    Positions are those of the alignments. ``masks`` maps "overall" and "ooi" to (cluster, organism) frames of the cells whose
    site is conserved; without it they are made from best and second-best hits.
    """

    hits: DataFrame
    weights: DataFrame
    organisms: list[str]
    options: RunOptions = RunOptions()
    masks: dict[str, DataFrame] | None = None

    @property
    def ooi(self) -> str:
        return self.organisms[0]

    def scored(self) -> tuple[DataFrame, DataFrame]:
        """Best and second-best hits of each gene with p-values under the fit of its organism's best ones.

        With region cds the energies are the normalised ones (column e_norm).
        """
        hits = self.hits.withColumn("energy", F.col("e_norm")) if self.options.region == "cds" else self.hits
        ranked = saved(H.ranked_hits(hits).where(F.col("hit_rank") <= 2))
        best = ranked.where("hit_rank = 1").drop("hit_rank")
        params = H.gev_params(best)
        return H.with_p_values(best, params), H.with_p_values(ranked.where("hit_rank = 2").drop("hit_rank"), params)

    def matrix(self) -> DataFrame:
        """(cluster, organism, p, ...): p-values of best hits under the fit of each organism, the lowest per cluster."""
        return H.cluster_minimum(self.scored()[0])

    def site_masks(self, matrix: DataFrame, second: DataFrame) -> dict[str, DataFrame]:
        """Cells whose best hit lies on the cluster's peak of coverage by best and second-best hits ("overall"), or on the
        best hit of the organism of interest ("ooi"); clusters of one organism have no conserved sites."""
        several = matrix.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
        cells = saved(matrix.join(several, "cluster", "left_semi"))
        also = second.join(cells.select("cluster", "organism", "locus"), ["cluster", "organism", "locus"], "left_semi")
        cover = C.coverage(cells.select("cluster", "start1", "end1", "p").unionByName(also.select("cluster", "start1", "end1", "p")))
        own = cells.where(F.col("organism") == self.ooi).select("cluster", F.col("start1").alias("start"), F.col("end1").alias("end"))
        on = lambda peak: C.site_hits(cells, peak).where("site").select("cluster", "organism")
        return {"overall": on(C.peaks(cover)), "ooi": on(own)}

    def results(self) -> dict[str, DataFrame]:
        """(cluster, p, fdr) per mode, those of all five modes (or of the first version)."""
        best, second = self.scored()
        return self._results(saved(H.cluster_minimum(best)), second)

    def _results(self, matrix: DataFrame, second: DataFrame, only: str | None = None) -> dict[str, DataFrame]:
        weights = P.rooted_weights(self.weights, self.options.root)
        if self.options.cop1:
            return {"v1": self._first_version(matrix, weights)}
        masks, tables = self.masks, [(None, ["balanced", "ooi"])] if only in (None, "balanced", "ooi") else []
        if only in (None, "balanced_consensus", "ooi_consensus", "ooi_ooiconsensus"):
            masks = masks or self.site_masks(matrix, second)
            kept = {k: matrix.join(m, ["cluster", "organism"], "left_semi") for k, m in masks.items()}
            if only != "ooi_ooiconsensus":
                tables.append((kept["overall"], ["balanced_consensus", "ooi_consensus"]))
            if only in (None, "ooi_ooiconsensus"):
                tables.append((kept["ooi"], ["ooi_ooiconsensus"]))
        combined, out = CB.combine_each(matrix, weights, [m for m, _ in tables]), {}
        for by_subset, (_, modes) in zip(combined, tables, strict=True):
            out |= self._modes(by_subset, [m for m in modes if only in (None, m)])
        return out

    def _modes(self, by_subset: DataFrame, modes: list[str]) -> dict[str, DataFrame]:
        """Rows of the modes that are asked for: the least p of any subset if balanced, else of those with the organism of interest. Both come of one pass."""
        has = F.array_contains(F.split("subset", "_"), self.ooi)
        least = by_subset.groupBy("cluster").agg(F.min("p").alias("all"), F.min(F.when(has, F.col("p"))).alias("own"), F.bool_or(has).alias("has"))
        least = saved(least) if len(modes) > 1 else least
        one = {True: least.select("cluster", F.col("all").alias("p")), False: least.where("has").select("cluster", F.col("own").alias("p"))}
        return {m: N.bh_fdr(one[m.startswith("balanced")], "p", ["cluster"]) for m in modes}

    def _first_version(self, matrix: DataFrame, weights: DataFrame) -> DataFrame:
        n = len(self.organisms)
        matrix = saved(matrix)
        kept = matrix.join(H.cluster_sizes(matrix, n, self.options.rcsize).select("cluster"), "cluster")
        filled = CB.impute(kept, CB.covariance(CB.complete_probits(kept, n))).join(weights, "organism")
        z = F.col("z") * F.col("weight")
        sums = saved(filled.groupBy("cluster").agg(F.sum(z).alias("zw"), F.sum(F.col("weight") * F.col("weight")).alias("w2"), F.sum("weight").alias("w")))
        coarse = self._rho(sums, [k / 10 for k in range(11)])
        fine = self._rho(sums, [x for k in range(-10, 11) if 0 <= (x := round(coarse + k / 100, 2)) <= 1])
        p = F.expr(N.combined("zw", "w2", "w", N.lit(fine)))
        return N.bh_fdr(sums.select("cluster", F.nanvl(p, F.lit(0.0)).alias("p")), "p", ["cluster"])

    @staticmethod
    def _rho(sums: DataFrame, grid: list[float]) -> float:
        best = CB.density_rho(sums, grid).orderBy("loss", "rho").first()
        return best["rho"] if best and best["rho"] > 0 else 0.1

    def primary(self) -> DataFrame:
        """The mode the options choose, ordered, threshold rows first, cut to topcount."""
        mode, (best, second) = choose_mode(self.options), self.scored()
        matrix = saved(H.cluster_minimum(best))
        out = self._results(matrix, second, mode)[mode]
        if self.options.ooifilt > 0:  # over all rows: one under the threshold comes first wherever it stands
            single = matrix.where(F.col("organism") == self.ooi).select("cluster", F.col("p").alias("single"))
            ranked = out.join(single, "cluster", "left").withColumn("row_id", F.struct(F.col("p").isNull(), "p", "cluster"))
            return ordered_by_threshold(ranked, "single", self.options.ooifilt).where(F.col("place") <= self.options.topcount).orderBy("place").drop("row_id")
        return out.orderBy(F.col("p").asc_nulls_last(), "cluster").limit(self.options.topcount)
