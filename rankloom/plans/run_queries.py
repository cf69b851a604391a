"""Values of whole runs: the results of every mode, the evolution table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numerics as N
from ..operators import annotate as A
from ..operators import combine as CB
from ..operators import hits as H
from ..sources import tables as TB
from ..sources.workspace import folder, saved
from . import bindings as B
from .hit_queries import CTE, FIT, RRA, SUBSETS, bh, by_subset, hits, matrix, weights
from .options import RunOptions
from .pipeline import MODES, Run
from .registry import query
from .text_queries import ANN, T5

# the same steps as SQL: fitted parameters instead of moments, root weights, subsets and fits of each combination

_PAR = CTE[CTE.index("par AS (") : CTE.index("scored AS (")]
_PLAIN = f"weights AS ({B.sql(B.WEIGHTS)})"
FITTED = CTE.replace(_PAR, f"{FIT[len(CTE) + 2 :]},\npar AS (SELECT organism, xi, mu, sigma FROM fit),\n")
FITTED = FITTED.replace(_PLAIN, f"weights AS (SELECT organism, sqrt(weight) AS weight FROM ({B.sql(B.WEIGHTS)}))")


def _combination(tag: str, source: str | None = None, steps: int = 25) -> str:
    """Tables s{tag} (row by subset p) and below: subsets of ``source`` (the matrix without one), correlations fitted to the matrix."""
    sums = "SELECT q.cluster, m.subset, sum(z * weight) AS zw, sum(weight * weight) AS w2, sum(weight) AS w, count(*) AS n FROM probits q JOIN mem{0} m USING (organism) {1} GROUP BY q.cluster, m.subset"
    whole = "n = len(string_split(subset, '_'))"
    out = [
        f"""pre{tag} AS (SELECT cluster, row_number() OVER w AS k, array_to_string(list_sort(list(organism) OVER (PARTITION BY cluster ORDER BY p, organism ROWS UNBOUNDED PRECEDING)), '_') AS subset
 FROM {source or 'matrix'} WINDOW w AS (PARTITION BY cluster ORDER BY p, organism))""",
        f"own{tag} AS (SELECT cluster, subset FROM pre{tag} WHERE k >= 3)",
        f"mem{tag} AS (SELECT subset, unnest(string_split(subset, '_')) AS organism FROM (SELECT DISTINCT subset FROM own{tag}))",
        f"rows{tag} AS (SELECT cluster, subset, zw, w2, w FROM ({sums.format(tag, '')}) WHERE {whole})",
        f"y{tag} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY zw DESC, cluster) * 1.0::DOUBLE / count(*) OVER (PARTITION BY subset) AS y FROM rows{tag})",
        f"s{tag}0 AS MATERIALIZED (SELECT DISTINCT subset, 0.0::DOUBLE AS best, 0.0::DOUBLE AS rho, 'infinity'::DOUBLE AS least FROM y{tag})",
    ]
    for k in range(steps):
        go = f"(SELECT max(abs(rho - best)) FROM s{tag}{k}) > 1e-7" if k else "true"
        step = ", ".join(f"CASE WHEN {go} THEN {e} ELSE {n} END AS {n}" for n, e in CB.STEP.items())
        out.append(f"g{tag}{k} AS MATERIALIZED (SELECT subset, {', '.join(f'{e} AS {n}' for n, e in CB.SUMS.items())} FROM y{tag} JOIN (SELECT subset, rho FROM s{tag}{k}) USING (subset) GROUP BY subset)")
        out.append(f"s{tag}{k + 1} AS MATERIALIZED (SELECT subset, {step} FROM s{tag}{k} JOIN g{tag}{k} USING (subset))")
    if source:
        kept = sums.format(tag, f"JOIN {source} k ON k.cluster = q.cluster AND k.organism = q.organism").replace("USING (organism)", "ON m.organism = q.organism")
        out.append(f"kept{tag} AS (SELECT cluster, subset, zw, w2, w FROM ({kept}) WHERE {whole})")
    p = N.combined("zw", "w2", "w", "best")
    out.append(f"by{tag} AS (SELECT own{tag}.cluster, own{tag}.subset, {p} AS p FROM own{tag} JOIN {'kept' if source else 'rows'}{tag} USING (cluster, subset) JOIN s{tag}{steps} USING (subset))")
    out.append(f"bal{tag} AS (SELECT cluster, min(p) AS p FROM by{tag} GROUP BY cluster)")
    out.append(f"ooi{tag} AS (SELECT cluster, min(p) AS p FROM by{tag} WHERE list_contains(string_split(subset, '_'), 'org0') GROUP BY cluster)")
    return ",\n".join(out)


_SHARE = 'greatest(0, least(e, end1) - greatest(s, start1) + 1) / least(e - s + 1, end1 - start1 + 1) >= 0.6::DOUBLE'
SITES = f"""second AS (SELECT sub.organism, sub.cluster, sub.locus, sub.start1, sub.end1, {N.gev_survival('(-energy)', 'xi', 'mu', 'sigma')} AS p FROM sub JOIN par USING (organism)),
cells AS (SELECT * FROM matrix WHERE cluster IN (SELECT cluster FROM matrix GROUP BY cluster HAVING count(*) > 1)),
both_ AS (SELECT cluster, start1, end1, p FROM cells UNION ALL SELECT cluster, second.start1, second.end1, second.p FROM second JOIN cells USING (cluster, organism, locus)),
cov AS (SELECT cluster, pos, round(sum(1 - p), 9) AS r FROM (SELECT cluster, p, unnest(range(start1, end1 + 1)) AS pos FROM both_) GROUP BY cluster, pos HAVING sum(1 - p) > 1e-12),
tp AS (SELECT *, max(r) OVER (PARTITION BY cluster) AS top FROM cov),
fl AS (SELECT cluster, min(pos) AS f, max(pos) AS l FROM tp WHERE r = top GROUP BY cluster),
isl AS (SELECT cluster, pos, pos - row_number() OVER (PARTITION BY cluster ORDER BY pos) AS g FROM tp WHERE r >= round(0.4 * top, 9)),
rn AS (SELECT cluster, min(pos) AS s, max(pos) AS e FROM isl GROUP BY cluster, g),
pk AS (SELECT cluster, max(CASE WHEN f BETWEEN s AND e THEN s END) AS s, max(CASE WHEN l BETWEEN s AND e THEN e END) AS e FROM rn JOIN fl USING (cluster) GROUP BY cluster),
own_ AS (SELECT cluster, start1 AS s, end1 AS e FROM cells WHERE organism = 'org0'),
kov AS (SELECT cells.* FROM cells JOIN pk USING (cluster) WHERE {_SHARE}), koo AS (SELECT cells.* FROM cells JOIN own_ USING (cluster) WHERE {_SHARE})"""
COMBINED = {"a": _combination("a"), "b": _combination("b", "kov"), "c": _combination("c", "koo")}
RUN = f"WITH {FITTED}, {SITES},\n" + ",\n".join(COMBINED.values())
RESULT = dict(zip(MODES, ["bala", "ooia", "balb", "ooib", "ooic"], strict=True))
ALL_MODES = " UNION ALL ".join(f"SELECT '{m}' AS mode, cluster, p, fdr FROM {bh(t)}" for m, t in RESULT.items())
#: Genes of the clusters, for homologs: four to a group.
GENES = "SELECT DISTINCT l_partkey DIV 4 AS cluster, concat('g', l_partkey) AS locus, l_partkey AS pos FROM {lineitem}"
_OTHERS = f"(SELECT a.locus, string_agg(b.locus, ' ' ORDER BY b.pos) AS homologs FROM gn a JOIN gn b ON a.cluster = b.cluster AND a.locus <> b.locus GROUP BY a.locus)"


def run(spark, d, **options) -> Run:
    return Run(hits(spark, d), weights(spark, d), T5, RunOptions(root=2, **options))


@query(f"""{RUN}, res AS ({ALL_MODES}), gn AS ({B.sql(GENES).replace('DIV', '//')}), an AS (SELECT lower(locus) AS locus, replace(coalesce({ANN}, note, function), ',', ' ') AS annotation FROM ({B.sql(B.ANNOT)})),
wide AS (SELECT cluster, min(locus) AS locus, 5 - count(*) AS missing, {', '.join(f"coalesce(max(CASE WHEN organism = '{o}' THEN concat(locus, ':', start1, '-', end1) END), '') AS {o}" for o in T5)} FROM matrix GROUP BY cluster)
SELECT mode, cluster, round(p, 5) AS p, round(fdr, 5) AS fdr, {', '.join(T5)}, coalesce(annotation, 'N/A') AS annotation, homologs, missing::INT AS n_sampled
FROM res JOIN wide USING (cluster) LEFT JOIN an USING (locus) LEFT JOIN {_OTHERS} USING (locus)""")
def k01_run_results(spark, d):
    """The result files of all five modes of a whole run: written in order of p, annotated, and read again."""
    path, one = folder(spark), run(spark, d)
    best, second = one.scored()
    cells = saved(H.cluster_minimum(best))
    annot, members = B.bind(spark, d, B.ANNOT), B.bind(spark, d, GENES)
    out, told = None, saved(A.described(cells, annot, members, T5))
    for mode, result in one._results(cells, second).items():
        rows = result.join(told, "cluster")
        TB.write_results(rows.orderBy(F.col("p").asc_nulls_last(), "cluster"), f"{path}/{mode}", T5)
        back = TB.read_results(spark, f"{path}/{mode}", T5)
        back = back.select(
            F.lit(mode).alias("mode"), F.regexp_extract(F.coalesce(*T5), r"^g(\d+):", 1).cast("long").alias("cluster"), F.round("p-value", 5).alias("p"), F.round("fdr", 5).alias("fdr"),
            *[F.coalesce(o, F.lit("")).alias(o) for o in T5], F.col("Annotation").alias("annotation"), F.col("Additional homologs").alias("homologs"), F.col("Amount sampled").alias("n_sampled"),
        )
        out = back if out is None else out.unionByName(back)
    return out


def _primary(mode: str) -> str:
    return f"WITH {FITTED}, {SITES},\n{COMBINED[RESULT[mode][-1]]} SELECT cluster, round(p, 5) AS p, round(fdr, 5) AS fdr FROM {bh(RESULT[mode])} ORDER BY round(p, 9) NULLS LAST, cluster LIMIT 200"


def _rounded(df):
    return df.select("cluster", F.round("p", 5).alias("p"), F.round("fdr", 5).alias("fdr"))


@query(_primary("balanced"))
def run_balanced(spark, d):
    return _rounded(run(spark, d, nooi=True).primary())


@query(_primary("ooi_consensus"))
def run_consensus(spark, d):
    """From hits to the rows of the consensus mode, conserved sites found on the way."""
    return _rounded(run(spark, d, cons=2).primary())


def _pivot(name: str, value: str) -> str:
    return ", ".join(f"max(CASE WHEN organism = '{o}' THEN {value} END) AS {name}_{o}" for o in T5)


@query(f"""WITH {SUBSETS}, {RRA}, li AS (SELECT cluster, row_number() OVER (ORDER BY string_agg(locus || ':' || organism, ';' ORDER BY organism)) AS initial_sorting FROM matrix GROUP BY cluster),
full_ AS (SELECT rk2.cluster, rk2.organism, rk2.rank, rk2.p, matrix.p AS single FROM rk2 JOIN ch USING (cluster) LEFT JOIN matrix ON matrix.cluster = rk2.cluster AND matrix.organism = rk2.organism),
sh AS (SELECT cluster, sum((rank <= 250)::INT)::DOUBLE / 5 AS rank_share, sum((p <= 0.001)::INT)::DOUBLE / 5 AS p_share, coalesce(sum((single <= 0.3)::INT), 0)::DOUBLE / 5 AS single_share,
 {_pivot('rank', 'rank::INT')}, {_pivot('p', 'round(p, 6)')}, {_pivot('single', 'single')} FROM full_ GROUP BY cluster)
SELECT row_number() OVER (ORDER BY round(rank_p, 9), cluster) AS place, cluster, round(rank_p, 6) AS rank_p, rank_share, p_share, single_share, {', '.join(f'{n}_{o}' for n in ('rank', 'p', 'single') for o in T5)}, initial_sorting
FROM ra JOIN sh USING (cluster) JOIN li USING (cluster)""")
def k02_evolution_analysis(spark, d):
    """The evolution table in the order of aggregated ranks, with shares, ranks and p-values of each organism; written and read again."""
    path, m = folder(spark), saved(matrix(spark, d))
    table = CB.evolution_table(CB.organism_p(by_subset(spark, d)), m, T5)
    TB.write_evolution(table, path, T5)
    back = TB.read_evolution(spark, path, T5)
    return back.withColumns({c: F.round(c, 6) for c in ["rank_p", *[f"p_{o}" for o in T5]]})


# membership of genes in terms, option files, printed numbers

_PAIRS = "SELECT DISTINCT event_type AS term, CAST(user_id AS STRING) AS gene FROM {events}"
_GROUPS = "SELECT event_type AS term, CAST(length(event_type) % 3 + 1 AS INT) AS group_id, length(event_type) % 3 / CAST(2 AS DOUBLE) AS score FROM {events} GROUP BY event_type"


@query(f"""WITH pr AS ({B.sql(_PAIRS).replace('STRING', 'VARCHAR')}), gr AS ({B.sql(_GROUPS)}), ge AS (SELECT gene, 1.0::DOUBLE / (1 + count(*)) AS p FROM pr GROUP BY gene)
SELECT gene, p, term, group_id, score, (pr.gene IS NOT NULL)::INT AS member FROM ge CROSS JOIN gr LEFT JOIN pr USING (gene, term)""")
def k10_membership_matrix(spark, d):
    """The matrix of genes by terms in blocks of two terms, each with its meta rows, written and read again."""
    path, pairs = folder(spark), B.bind(spark, d, _PAIRS)
    genes = pairs.groupBy("gene").agg((1.0 / (1 + F.count("*"))).alias("p"))
    TB.write_membership(genes, pairs, B.bind(spark, d, _GROUPS), path, width=2)
    return TB.read_membership(spark, path)


@query("""WITH o AS (SELECT concat('run', c_custkey, '.fa') AS srnaseq, ['5utr', '3utr', 'cds'][c_custkey % 3 + 1] AS region, CASE WHEN c_custkey % 5 = 0 THEN 400 ELSE 150 END AS winsize,
 c_custkey % 4 = 0 AS cop1, (c_custkey // 4 % 3)::INT AS cons, c_nationkey % 2 = 0 AS nooi, (50 + c_custkey % 200)::INT AS topcount FROM customer)
SELECT *, CASE WHEN cop1 THEN 'v1' WHEN cons = 1 THEN 'ooi_ooiconsensus' WHEN cons = 2 THEN CASE WHEN nooi THEN 'balanced_consensus' ELSE 'ooi_consensus' END WHEN nooi THEN 'balanced' ELSE 'ooi' END AS mode,
 array_to_string(list_filter([CASE WHEN region <> 'cds' AND winsize > 300 THEN 'ntup + ntdown is less than winsize' END, CASE WHEN cons = 1 AND nooi THEN 'cons 1 needs an organism of interest' END, CASE WHEN cop1 AND cons > 0 THEN 'cop1 works without cons only' END], lambda x: x IS NOT NULL), '; ') AS broken FROM o""")
def s06_option_file(spark, d):
    """Options of a run for each customer, written as name:value lines, read to a row a run with defaults, the mode chosen and the rules broken."""
    from .options import options_table

    path, c = folder(spark), B.load(spark, d, "customer")["customer"]
    given = {
        "srnaseq": F.concat(F.lit("run"), F.col("c_custkey").cast("string"), F.lit(".fa")), "region": F.element_at(F.array(F.lit("5utr"), F.lit("3utr"), F.lit("cds")), (F.col("c_custkey") % 3 + 1).cast("int")),
        "winsize": F.when(F.col("c_custkey") % 5 == 0, "400"), "cop1": F.when(F.col("c_custkey") % 4 == 0, "1"), "cons": F.floor(F.col("c_custkey") / 4) % 3,
        "nooi": (F.col("c_nationkey") % 2 == 0).cast("int"), "topcount": F.col("c_custkey") % 200 + 50,
    }
    c.select(F.concat_ws("\n", *[F.concat(F.lit(f"{k}:"), v.cast("string")) for k, v in given.items()]).alias("value")).write.text(path)
    return options_table(TB.numbered_lines(spark, path)).select(*given, "mode", "broken")


_NUMBERS = """SELECT DISTINCT v AS x FROM (SELECT CAST(l_extendedprice AS DOUBLE) / 1000 AS v FROM {lineitem} UNION ALL SELECT l_orderkey / CAST(8000000 AS DOUBLE) FROM {lineitem}
 UNION ALL SELECT -(l_partkey * l_linenumber) / CAST(80 AS DOUBLE) FROM {lineitem} UNION ALL SELECT l_orderkey * CAST('12500000' AS DOUBLE) FROM {lineitem} UNION ALL SELECT exp(-l_quantity) FROM {lineitem})"""


@query(f"SELECT x, printf('%.4g', x) AS g4, printf('%.2f', x) AS f2, printf('%.6f', x) AS f6, printf('%.7f', x) AS f7, printf('%.3e', x) AS e3 FROM ({B.sql(_NUMBERS)}) WHERE round(x, 12) = x OR abs(x) > 1")
def f07_printed_numbers(spark, d):
    """Numbers as C prints them: shortest of fixed and exponent form, ties by the binary value."""
    from ..functions.printf import printed

    x = B.bind(spark, d, _NUMBERS).where("round(x, 12) = x OR abs(x) > 1")
    return x.select("x", *[printed(F.col("x"), f"%.{n}{k}").alias(f"{k}{n}") for k, n in (("g", 4), ("f", 2), ("f", 6), ("f", 7), ("e", 3))])
