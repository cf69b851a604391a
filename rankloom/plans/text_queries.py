"""Queries on annotation, clusters, trees, sites, sequences, files and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import annotate as A
from ..operators import conserve as C
from ..operators import phylogeny as P
from ..operators.intervals import overlapping
from ..operators.ranking import global_row_number
from . import bindings as B
from .hit_queries import CTE, hits, matrix, opt, scored
from .registry import query

T5 = ["org0", "org1", "org2", "org3", "org4"]


def t(spark, d, name):
    return B.load(spark, d, name)[name]


# annotation and cells

ANN = "CASE WHEN product NOT LIKE '%hypothetical protein%' THEN product END"


@query(f"SELECT locus, replace(coalesce({ANN}, note, function), ',', ' ') AS annotation FROM ({B.sql(B.ANNOT)})")
def p11_annotation_fallback(spark, d):
    a = B.bind(spark, d, B.ANNOT)
    return a.select("locus", X.annotation(F.col("product"), F.col("note"), F.col("function")).alias("annotation"))


@query(f"SELECT locus, translate(coalesce({ANN}, note, function), ',;', '  ') AS annotation FROM ({B.sql(B.ANNOT)})")
def p12_annotation_two_marks(spark, d):
    a = B.bind(spark, d, B.ANNOT)
    return a.select("locus", X.annotation(F.col("product"), F.col("note"), F.col("function"), ",;").alias("annotation"))


@query(f"""WITH {CTE}, a AS (SELECT lower(locus) AS k, replace(coalesce({ANN}, note, function), ',', ' ') AS annotation FROM ({B.sql(B.ANNOT)}))
SELECT organism, locus, coalesce(annotation, 'N/A') AS annotation FROM opt LEFT JOIN a ON lower(opt.locus) = a.k""")
def j03_row_annotation(spark, d):
    return A.with_annotation(opt(spark, d).select("organism", "locus"), B.bind(spark, d, B.ANNOT))


@query(f"""WITH {CTE}, a AS (SELECT lower(locus) AS k, replace(coalesce({ANN}, note, function), ',', ' ') AS annotation FROM ({B.sql(B.ANNOT)})),
f AS (SELECT l.locus, min((len(a.k), a.k)) AS m FROM (SELECT DISTINCT lower(locus) AS locus FROM opt) l JOIN a ON contains(a.k, l.locus) GROUP BY l.locus)
SELECT organism, opt.locus, m[2] AS found, coalesce(annotation, 'N/A') AS annotation FROM opt LEFT JOIN f ON lower(opt.locus) = f.locus LEFT JOIN a ON a.k = m[2]""")
def j03_substring_annotation(spark, d):
    return A.with_annotation(opt(spark, d).select("organism", "locus"), B.bind(spark, d, B.ANNOT), within=True).select("organism", "locus", "found", "annotation")


@query(f"WITH {CTE} SELECT organism, locus, coalesce(CASE WHEN p_size % 5 <> 0 THEN p_name END, 'N/A') AS gene FROM opt LEFT JOIN part ON p_partkey = cluster")
def j02_gene_name(spark, d):
    part = t(spark, d, "part").select(F.col("p_partkey").alias("cluster"), F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("gene"))
    return opt(spark, d).join(part, "cluster", "left").select("organism", "locus", F.coalesce("gene", F.lit("N/A")).alias("gene"))


@query(f"WITH {CTE} SELECT m.cluster, h.organism, h.locus, h.energy FROM (SELECT DISTINCT l_partkey % 500 AS cluster, lower(concat('G', l_partkey)) AS locus FROM lineitem) m JOIN opt h ON m.locus = lower(h.locus)")
def j01_members_and_hits(spark, d):
    members = t(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("cluster"), F.lower(F.concat(F.lit("G"), F.col("l_partkey").cast("string"))).alias("locus")).distinct()
    h = opt(spark, d).withColumn("k", F.lower("locus")).select("k", "organism", F.col("locus").alias("hl"), "energy")
    return members.join(h, members["locus"] == h["k"]).select("cluster", "organism", F.col("hl").alias("locus"), "energy")


HOMO = f"""WITH m AS ({B.sql(B.MEMBERS)}), pr AS (SELECT a.locus, b.locus AS other, min((a.cluster, b.pos)) AS place FROM m a JOIN m b ON a.cluster = b.cluster AND a.locus <> b.locus GROUP BY a.locus, b.locus)
SELECT locus, string_agg(other, ' ' ORDER BY place, other) AS homologs FROM pr GROUP BY locus"""


@query(HOMO)
def j04_homologs(spark, d):
    return A.homologs(B.bind(spark, d, B.MEMBERS))


@query("SELECT o_orderkey, c_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j06_first_replicon(spark, d):
    x = B.load(spark, d, "orders", "customer", "nation", "region")
    return (
        x["orders"].select("o_orderkey", "o_custkey").join(x["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(x["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(x["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "r_name")
    )


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j07_left_labels(spark, d):
    x = B.load(spark, d, "documents", "labels")
    return x["documents"].select("doc_id", "lang").join(x["labels"], "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@query(f"""WITH c AS ({B.sql(B.COMBINED)}), s AS ({B.sql(B.SINGLE)})
SELECT DISTINCT s.term, s.gene FROM s WHERE term IN (SELECT term FROM c) AND NOT EXISTS (SELECT 1 FROM c WHERE c.term = s.term AND c.gene = s.gene)""")
def j08_specific_terms(spark, d):
    return A.specific_terms(B.bind(spark, d, B.SINGLE), B.bind(spark, d, B.COMBINED))


LISTS = "SELECT event_type AS term, array_join(array_sort(collect_set(CAST(user_id AS STRING))), ', ') AS genes FROM {events} GROUP BY event_type"


@query("SELECT DISTINCT event_type AS term, user_id::VARCHAR AS gene FROM events")
def j09_term_genes(spark, d):
    return A.term_rows(B.bind(spark, d, LISTS))


@query("SELECT n_nationkey, r_name FROM nation CROSS JOIN region WHERE n_regionkey = r_regionkey")
def j12_work_list(spark, d):
    x = B.load(spark, d, "nation", "region")
    return x["nation"].join(x["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")


@query(f"""WITH {CTE}, o AS (SELECT organism, row_number() OVER (PARTITION BY organism ORDER BY energy, locus) AS k, locus FROM opt),
s AS (SELECT organism, row_number() OVER (PARTITION BY organism ORDER BY energy, locus) AS k, locus AS sub_locus FROM sub) SELECT o.organism, o.k::INT AS k, locus, sub_locus FROM o JOIN s ON o.organism = s.organism AND o.k = s.k""")
def j13_positional_zip(spark, d):
    from ..operators.hits import best_hits

    placed = lambda x: global_row_number(x.select("organism", "energy", "locus"), ["energy", "locus"], "k", by=["organism"])
    s = placed(best_hits(hits(spark, d), 2)).select("organism", "k", F.col("locus").alias("sub_locus"))
    return placed(opt(spark, d)).join(s, ["organism", "k"]).select("organism", F.col("k").cast("int").alias("k"), "locus", "sub_locus")


@query("SELECT b.item_id, md5(b.text) AS seq FROM benchmark b JOIN (SELECT DISTINCT doc_id AS item_id FROM documents) d USING (item_id)")
def j14_locus_sequence(spark, d):
    x = B.load(spark, d, "benchmark", "documents")
    ids = x["documents"].select(F.col("doc_id").alias("item_id")).distinct()
    return x["benchmark"].join(ids, "item_id").select("item_id", F.md5("text").alias("seq"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, substr(r_name, 1, 3) || '_' || n_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j16_display_names(spark, d):
    x = B.load(spark, d, "lineitem", "supplier", "nation", "region")
    names = x["nation"].join(x["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    names = names.select("n_nationkey", X.abbreviate(F.concat_ws("_", "r_name", "n_name")).alias("name"))
    li = x["lineitem"].select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey").join(x["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    return li.join(names, F.col("s_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "l_quantity", "name")


@query("""SELECT u.user_id, u.n, string_agg(t.event_type, ';' ORDER BY t.event_type) AS terms FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u
JOIN (SELECT DISTINCT user_id, event_type FROM events) t USING (user_id) GROUP BY u.user_id, u.n""")
def j17_genes_with_terms(spark, d):
    e = t(spark, d, "events")
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    terms = e.select("user_id", "event_type").distinct().groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_type")), ";").alias("terms"))
    return n.join(terms, "user_id").select("user_id", "n", "terms")


@query(f"WITH {CTE} SELECT organism, locus, energy FROM opt WHERE cluster IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def j18_selected_genes(spark, d):
    part = t(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("cluster"))
    return opt(spark, d).join(part, "cluster", "left_semi").select("organism", "locus", "energy")


@query(f"""WITH {CTE}, s AS (SELECT organism, locus, start1, end1 FROM sub) SELECT 'opt' AS hit, cluster, o.organism, o.start1, o.end1 FROM opt o
UNION ALL SELECT 'sub', cluster, o.organism, s.start1, s.end1 FROM opt o LEFT JOIN s ON o.organism = s.organism AND o.locus = s.locus""")
def j19_site_tables(spark, d):
    from ..operators.hits import best_hits

    o = opt(spark, d).select("cluster", "organism", "locus", "start1", "end1")
    s = best_hits(hits(spark, d), 2).select("organism", "locus", "start1", "end1")
    sub = o.select("cluster", "organism", "locus").join(s, ["organism", "locus"], "left")
    cols = ["cluster", "organism", "start1", "end1"]
    return o.select(F.lit("opt").alias("hit"), *cols).unionByName(sub.select(F.lit("sub").alias("hit"), *cols))


CELL = "concat(locus, '(', organism, '|', cast(start1 AS {s}), '|', cast(end1 AS {s}), ')')"


@query(f"WITH {CTE} SELECT cluster, " + ", ".join(f"coalesce(max(CASE WHEN organism = '{o}' THEN concat(locus, '(', start1, '-', end1, ')') END), '') AS {o}" for o in T5) + " FROM opt GROUP BY cluster")
def a37_wide_results(spark, d):
    cells = opt(spark, d).select("cluster", "organism", F.concat("locus", F.lit("("), F.col("start1").cast("string"), F.lit("-"), F.col("end1").cast("string"), F.lit(")")).alias("cell"))
    return A.wide_results(cells, T5)


def packed(spark, d, best=None):
    s = opt(spark, d) if best is None else best
    cell = X.pack_cell(F.col("locus"), F.col("organism"), F.lit(1), F.col("start1"), F.col("start1"), F.col("end1"), F.col("start2"), F.col("end2"), F.col("cluster"))
    return s.select("cluster", "organism", cell.alias("cell"))


@query(f"WITH {CTE} SELECT cluster, organism, concat(locus, '(', organism, '|1|', start1, '|', start1, '|', end1, '|', start2, '|', end2, '|GeneID:', cluster, ')') AS cell FROM opt")
def f05_pack_cells(spark, d):
    return packed(spark, d)


@query(f"WITH {CTE} SELECT cluster, organism, locus, organism AS gene, 1.0::DOUBLE AS energy, start1::DOUBLE AS p, start1, end1, start2, end2, cluster::VARCHAR AS gene_id FROM opt")
def f05_unpack_cells(spark, d):
    x = packed(spark, d).withColumn("c", X.unpack_cell(F.col("cell")))
    return x.select("cluster", "organism", *[f"c.{f}" for f in X.CELL_FIELDS])


@query(f"WITH {CTE}, r AS (SELECT cluster AS row_id, concat('L', cluster % 70) AS label FROM (SELECT DISTINCT cluster FROM opt)), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_id) AS k FROM r) SELECT row_id, label || CASE WHEN k > 1 THEN '_' || array_to_string(range(2, k + 1), '_') ELSE '' END AS label FROM k")
def w09_unique_labels(spark, d):
    # each gene has a best hit and one cluster, so the clusters of best hits are those of all hits: none is ranked, dealt or spilled
    rows = hits(spark, d).select(F.col("cluster").alias("row_id")).distinct().withColumn("label", F.concat(F.lit("L"), (F.col("row_id") % 70).cast("string")))
    return A.unique_labels(rows)


LABEL = ", ".join(f"max(CASE WHEN organism = '{o}' THEN concat(organism, '_', locus) END)" for o in T5)


@query(f"WITH {CTE} SELECT cluster, coalesce({LABEL}) AS label FROM opt GROUP BY cluster")
def p28_row_label(spark, d):
    wide = A.wide_results(packed(spark, d), T5)
    return A.row_label(wide, T5).select("cluster", "label")


@query("SELECT p_partkey, translate(p_name || '(x,y)', '(),', '') AS gene FROM part")
def p24_gene_names(spark, d):
    return t(spark, d, "part").select("p_partkey", X.gene_name(F.concat("p_name", F.lit("(x,y)"))).alias("gene"))


# filters, projections, checks


@query("SELECT count(*) AS n, count(*) FILTER (WHERE c_name LIKE '%-%') AS gaps, count(*) - count(DISTINCT c_name) AS doubled FROM customer")
def p01_input_checks(spark, d):
    c = t(spark, d, "customer")
    return c.agg(F.count("*").alias("n"), F.count_if(F.contains("c_name", F.lit("-"))).alias("gaps"), (F.count("*") - F.count_distinct("c_name")).alias("doubled"))


@query("SELECT s_suppkey, concat('ncRNA_', n_name) AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def p02_prefixed_ids(spark, d):
    x = B.load(spark, d, "supplier", "nation")
    return x["supplier"].join(x["nation"], F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("ncRNA_"), "n_name").alias("id"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id IS NOT NULL AND props IS NOT NULL")
def p03_feature_filter(spark, d):
    return t(spark, d, "events").where("event_type = 'click' AND user_id IS NOT NULL AND props IS NOT NULL").select("event_id", "user_id")


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?i)brass|small plated')")
def p04_product_pattern(spark, d):
    return t(spark, d, "part").where(F.col("p_type").rlike("(?i)brass|small plated")).select("p_partkey", "p_type")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'P') = 0 AND count(*) FILTER (WHERE o_orderstatus = 'F') <> 0")
def p05_genes_without_cds(spark, d):
    g = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return g.where("p = 0 AND f <> 0").select("o_custkey", "n")


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE contains(text, 'N')) AS with_n FROM documents GROUP BY lang")
def p06_ambiguous_bases(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.contains("text", F.lit("N"))).alias("with_n"))


@query("SELECT page_id, ends_with(rtrim(html), '</html>') AS complete FROM pages")
def p07_complete_files(spark, d):
    return t(spark, d, "pages").select("page_id", F.endswith(F.rtrim("html"), F.lit("</html>")).alias("complete"))


@query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE NOT starts_with(l_linestatus, 'F') AND l_tax <= 0.03")
def p08_p09_line_and_cutoff(spark, d):
    return t(spark, d, "lineitem").where(~F.startswith("l_linestatus", F.lit("F")) & (F.col("l_tax") <= 0.03)).select("l_orderkey", "l_linenumber", "l_tax")


@query("SELECT s_suppkey AS id1, s_name AS d1 FROM supplier")
def p10_projection(spark, d):
    return t(spark, d, "supplier").drop("s_acctbal", "s_nationkey").withColumnsRenamed({"s_suppkey": "id1", "s_name": "d1"})


STATE = "CASE WHEN m AND (a OR b) THEN 3 WHEN m THEN 1 WHEN a OR b THEN 2 ELSE 0 END"
SITES = f"""{CTE}, st AS (SELECT cluster, organism, start1 % 2 = 0 AS m, end1 % 3 = 0 AS a, start2 % 4 = 0 AS b, p FROM matrix),
ss AS (SELECT cluster, organism, start1 % 3 = 0 AS m, end1 % 2 = 0 AS a, start2 % 5 = 0 AS b FROM sub),
sts AS (SELECT st.cluster, st.organism, st.p, {STATE} AS state FROM st), sus AS (SELECT cluster, organism, {STATE} AS sub_state FROM ss),
res AS (SELECT sts.*, sub_state, CASE WHEN state IN (0, 2) AND sub_state = 3 THEN 5 WHEN state IN (0, 2) AND sub_state = 1 THEN 4 ELSE state END AS rescued FROM sts LEFT JOIN sus USING (cluster, organism))"""


def sites(spark, d):
    from ..operators.hits import best_hits

    state = lambda k, a, b: X.conservation_state(F.col("start1") % k == 0, F.col("end1") % a == 0, F.col("start2") % b == 0)
    o = matrix(spark, d).select("cluster", "organism", "p", state(2, 3, 4).alias("state"))
    s = best_hits(hits(spark, d), 2).select("cluster", "organism", state(3, 2, 5).alias("sub_state"))
    return o.join(s, ["cluster", "organism"], "left").withColumn("rescued", X.rescued_state(F.col("state"), F.col("sub_state")))


@query(f"WITH {SITES} SELECT cluster, organism, state FROM res")
def p14_conservation_state(spark, d):
    return sites(spark, d).select("cluster", "organism", "state")


@query(f"WITH {SITES} SELECT cluster, organism, rescued, CASE WHEN rescued IN (4, 5) THEN p / 2 ELSE p END AS p FROM res")
def p15_rescued_state(spark, d):
    return sites(spark, d).select("cluster", "organism", "rescued", F.when(F.col("rescued").isin(4, 5), F.col("p") / 2).otherwise(F.col("p")).alias("p"))


@query(f"WITH {SITES} SELECT cluster, organism, CASE rescued WHEN 2 THEN '-/+' WHEN 1 THEN '+/-' WHEN 0 THEN '-/-' WHEN 4 THEN '2+/-' WHEN 5 THEN '2' ELSE '' END AS label FROM res")
def p16_state_label(spark, d):
    return sites(spark, d).select("cluster", "organism", X.state_label(F.col("rescued")).alias("label"))


@query(f"WITH {SITES} SELECT cluster, organism, CASE WHEN m THEN p END AS p FROM st")
def p17_target_site_only(spark, d):
    return matrix(spark, d).select("cluster", "organism", F.when(F.col("start1") % 2 == 0, F.col("p")).alias("p"))


@query(f"WITH {SITES} SELECT cluster, organism, CASE WHEN m AND (a OR b) THEN p END AS p FROM st")
def p18_both_sites(spark, d):
    ok = (F.col("start1") % 2 == 0) & ((F.col("end1") % 3 == 0) | (F.col("start2") % 4 == 0))
    return matrix(spark, d).select("cluster", "organism", F.when(ok, F.col("p")).alias("p"))


MODE_RESULTS = dict(zip(["ooi", "balanced", "ooi_consensus", "balanced_consensus", "ooi_ooiconsensus"], T5, strict=True)) | {"v1": "org1"}


@query(f"""WITH {CTE}, o AS (SELECT cop1, cons, nooi FROM (VALUES (false), (true)) a(cop1), (VALUES (0), (1), (2)) b(cons), (VALUES (false), (true)) c(nooi) WHERE NOT (cop1 AND cons > 0) AND NOT (cons = 1 AND nooi)),
m AS (SELECT *, CASE WHEN cop1 THEN 'v1' WHEN cons = 1 THEN 'ooi_ooiconsensus' ELSE CASE WHEN nooi THEN 'balanced' ELSE 'ooi' END || CASE WHEN cons = 2 THEN '_consensus' ELSE '' END END AS mode FROM o)
SELECT cop1, cons, nooi, mode, cluster, p FROM m JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in MODE_RESULTS.items())}) r(mode, organism) USING (mode) JOIN matrix USING (organism)""")
def p22_mode_choice(spark, d):
    """The rows that a run returns first, for every allowed choice of options; an organism's rows stand for each mode's."""
    from .options import RunOptions, choose_mode

    m, out = matrix(spark, d), None
    results = {k: m.where(F.col("organism") == o) for k, o in MODE_RESULTS.items()}
    for cop1, cons, nooi in [(a, b, c) for a in (False, True) for b in range(3) for c in (False, True) if not (a and b) and not (b == 1 and c)]:
        mode = choose_mode(RunOptions(cop1=cop1, cons=cons, nooi=nooi))
        rows = results[mode].select(F.lit(cop1).alias("cop1"), F.lit(cons).alias("cons"), F.lit(nooi).alias("nooi"), F.lit(mode).alias("mode"), "cluster", "p")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT x.id, regexp_replace(x.id, '[.].*$', '') AS replicon FROM (SELECT unnest(['NC_' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '.1', 'AB' || c_custkey]) AS id FROM customer) x WHERE x.id LIKE 'N%'")
def p25_replicon_ids(spark, d):
    ids = t(spark, d, "customer").select(F.explode(F.array(F.concat(F.lit("NC_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(".1")), F.concat(F.lit("AB"), F.col("c_custkey").cast("string")))).alias("id"))
    return ids.where(F.col("id").rlike(r"^N[CZ]_")).select("id", F.regexp_replace("id", r"[./].*$", "").alias("replicon"))


GROUPS = "SELECT o_custkey AS group_id, sum(o_totalprice) / 1000000 AS score FROM {orders} GROUP BY o_custkey"


@query(f"WITH g AS ({B.sql(GROUPS)}), k AS (SELECT greatest(1, count(*) FILTER (WHERE score >= 1)) AS k FROM g) SELECT group_id, round(score, 8) AS score FROM g QUALIFY row_number() OVER (ORDER BY group_id) <= (SELECT k FROM k)")
def p26_leading_groups(spark, d):
    return A.leading_groups(B.bind(spark, d, GROUPS)).select("group_id", F.round("score", 8).alias("score"))


@query(f"WITH e AS ({B.sql(B.EDGES)}) SELECT parent, child, greatest(length, 0.00001) AS length FROM e")
def p27_zero_lengths(spark, d):
    return B.bind(spark, d, B.EDGES).withColumn("length", F.greatest("length", F.lit(1e-5)))


@query(f"WITH {CTE} SELECT cluster, organism, start1 FROM opt WHERE start1 IS NOT NULL")
def p29_display_cells(spark, d):
    return opt(spark, d).where("start1 is not null").select("cluster", "organism", "start1")


# trees

TREE = f"""RECURSIVE e AS ({B.sql(B.EDGES)}), anc AS (SELECT child AS node, parent AS ancestor, child AS via FROM e UNION ALL SELECT anc.node, e.parent, anc.ancestor FROM anc JOIN e ON e.child = anc.ancestor),
below AS (SELECT anc.ancestor AS node, sum(e.length) AS below FROM anc JOIN e ON e.child = anc.node GROUP BY anc.ancestor),
nodes AS (SELECT below.node, below, coalesce(e.length, 0) AS own FROM below LEFT JOIN e ON e.child = below.node),
leaf AS (SELECT child AS node FROM e WHERE child NOT IN (SELECT parent FROM e)),
path AS (SELECT anc.node, u.below AS s, u.own AS l, coalesce(v.below + v.own, e.length) AS b FROM anc JOIN leaf USING (node) JOIN nodes u ON u.node = anc.ancestor LEFT JOIN nodes v ON v.node = anc.via JOIN e ON e.child = anc.via)"""


@query(f"WITH {TREE} SELECT sum(length) AS tree_length FROM e")
def a25_tree_length(spark, d):
    return P.tree_length(B.bind(spark, d, B.EDGES))


@query(f"WITH {TREE} SELECT node, round(below, 6) AS below FROM below")
def a26_subtree_length(spark, d):
    return P.subtree_lengths(B.bind(spark, d, B.EDGES)).select("node", F.round("below", 6).alias("below"))


@query(f"WITH {TREE} SELECT node AS organism, round(exp(sum(ln((b + l / 2) / (s + l)))), 9) AS weight FROM path GROUP BY node")
def a27_leaf_weight(spark, d):
    return P.leaf_weights(B.bind(spark, d, B.EDGES)).select("organism", F.round("weight", 9).alias("weight"))


DIST = "SELECT a.n_name AS a, b.n_name AS b, abs(a.n_nationkey * a.n_nationkey - b.n_nationkey * 7) * 1.0D AS d FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"
DIST_SQL = B.sql(DIST).replace("1.0D", "1.0::DOUBLE")


@query(f"WITH x AS ({DIST_SQL}) SELECT a, b, d FROM x UNION SELECT b, a, d FROM x UNION SELECT n, n, 0.0 FROM (SELECT a AS n FROM x UNION SELECT b FROM x)")
def a29_symmetric(spark, d):
    return P.symmetric(B.bind(spark, d, DIST))


@query(None)
def a30_average_linkage(spark, d):
    e = t(spark, d, "embeddings").select("label", F.posexplode("embedding"))
    cen = e.groupBy("label", "pos").agg(F.avg("col").alias("v"))
    pair = cen.alias("x").join(cen.alias("y"), "pos").groupBy(F.col("x.label").cast("string").alias("a"), F.col("y.label").cast("string").alias("b")).agg(F.sqrt(F.sum(F.pow(F.col("x.v") - F.col("y.v"), 2))).alias("d"))
    return P.tree_of(pair)


# sites

IV = f"{CTE}, iv AS (SELECT cluster % 50 AS cluster, start1, end1, p FROM matrix)"
COVER = f"{IV}, cov AS (SELECT cluster, pos, sum(1 - p) AS weight, count(*) AS n FROM (SELECT cluster, p, unnest(range(start1, end1 + 1)) AS pos FROM iv) GROUP BY cluster, pos)"


def intervals(spark, d):
    return matrix(spark, d).select((F.col("cluster") % 50).alias("cluster"), "start1", "end1", "p")


@query(f"WITH {COVER} SELECT cluster, pos::INT AS pos, round(weight, 7) AS weight FROM cov WHERE weight > 1e-12")
def a17_coverage(spark, d):
    return C.coverage(intervals(spark, d)).select("cluster", F.col("pos").cast("int").alias("pos"), F.round("weight", 7).alias("weight"))


@query(f"WITH {COVER} SELECT cluster, pos::INT AS pos, n FROM cov")
def a17_frequency(spark, d):
    return C.frequency(intervals(spark, d)).select("cluster", F.col("pos").cast("int").alias("pos"), "n")


PEAK = f"""{COVER}, tp AS (SELECT cluster, pos, round(weight, 9) AS r, round(max(weight) OVER (PARTITION BY cluster), 9) AS top FROM cov WHERE weight > 1e-12),
fl AS (SELECT cluster, min(CASE WHEN r = top THEN pos END) AS f, max(CASE WHEN r = top THEN pos END) AS l FROM tp GROUP BY cluster),
isl AS (SELECT cluster, pos, pos - row_number() OVER (PARTITION BY cluster ORDER BY pos) AS g FROM tp WHERE r >= round(0.4 * top, 9)),
rn AS (SELECT cluster, g, min(pos) AS s, max(pos) AS e FROM isl GROUP BY cluster, g),
pk AS (SELECT fl.cluster, max(CASE WHEN s <= f AND f <= e THEN s END) AS start, max(CASE WHEN s <= l AND l <= e THEN e END) AS "end" FROM rn JOIN fl USING (cluster) GROUP BY fl.cluster)"""


@query(f"""WITH {PEAK} SELECT cluster, start::INT AS start, "end"::INT AS "end" FROM pk""")
def a18_peak(spark, d):
    return C.peaks(C.coverage(intervals(spark, d))).select("cluster", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


# (first position and last of a maximum) to the positions next to what falls below a threshold
_REACH = """coalesce(max(pos) FILTER (WHERE pos < f AND r < {}) + 1, min(pos)) AS start, coalesce(min(pos) FILTER (WHERE pos > l AND r < {}) - 1, max(pos)) AS "end" """


@query(f"""WITH {PEAK}, span AS (SELECT cluster, unnest(range(min(pos), max(pos) + 1)) AS pos FROM tp GROUP BY cluster),
w AS (SELECT cluster, pos, coalesce(r, 0) AS r FROM span LEFT JOIN tp USING (cluster, pos)),
ft AS (SELECT cluster, min(pos) AS f, max(pos) AS l, top FROM tp WHERE r = top GROUP BY cluster, top),
p1 AS (SELECT cluster, top, {_REACH.format("0.4::DOUBLE * top", "0.4::DOUBLE * top")} FROM w JOIN ft USING (cluster) GROUP BY cluster, top),
outer_ AS (SELECT cluster, max(r) AS nxt, count(DISTINCT r) AS n FROM w JOIN p1 USING (cluster) WHERE pos < start OR pos > "end" GROUP BY cluster),
nx AS (SELECT cluster, min(pos) AS f, max(pos) AS l, nxt, top FROM w JOIN p1 USING (cluster) JOIN outer_ USING (cluster)
 WHERE r = nxt AND n > 10 AND nxt / top >= 0.9::DOUBLE GROUP BY cluster, nxt, top HAVING NOT bool_or(pos BETWEEN start AND "end")),
p2 AS (SELECT cluster, {_REACH.format("0.4::DOUBLE * nxt", "0.4::DOUBLE * top")} FROM w JOIN nx USING (cluster) GROUP BY cluster)
SELECT cluster, 1 AS k, start::BIGINT AS start, "end"::BIGINT AS "end" FROM p1 UNION ALL SELECT cluster, 2, start::BIGINT, "end"::BIGINT FROM p2""")
def a19_two_peaks(spark, d):
    return C.peak_pairs(C.coverage(intervals(spark, d)))


@query(f"""WITH {PEAK}, h AS (SELECT cluster % 50 AS cluster, organism, locus, start1, end1 FROM matrix)
SELECT h.cluster, organism, locus, coalesce(greatest(0, least("end", end1) - greatest(start, start1) + 1) / least("end" - start + 1, end1 - start1 + 1) >= 0.6, false) AS site FROM h LEFT JOIN pk USING (cluster)""")
def j10_interval_overlap(spark, d):
    h = matrix(spark, d).select((F.col("cluster") % 50).alias("cluster"), "organism", "locus", "start1", "end1")
    return C.site_hits(h, C.peaks(C.coverage(intervals(spark, d)))).select("cluster", "organism", "locus", "site")


@query(f"WITH {CTE} SELECT cluster, min(start1) AS low, max(end1) AS high, min(start1) - 240.0::DOUBLE AS low_shift, max(end1) - 240.0::DOUBLE AS high_shift FROM matrix GROUP BY cluster")
def a35_plot_extents(spark, d):
    return C.plot_extents(matrix(spark, d))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(replace(text, ' ', '-'), '')) AS c, unnest(range(1, length(text) + 1)) AS i FROM documents),
u AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM p WHERE c <> '-') SELECT doc_id, i::INT AS aligned FROM u WHERE k = 10""")
def j15_aligned_position(spark, d):
    s = t(spark, d, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit("-")).alias("s"))
    return s.select("doc_id", X.aligned_position(F.col("s"), F.lit(10)).alias("aligned")).where("aligned is not null")


@query(f"WITH {CTE}, a AS (SELECT organism, locus, range(start1, end1 + 1) AS x FROM opt), b AS (SELECT organism, locus, range(start1, end1 + 1) AS y FROM sub) SELECT organism, locus, len(list_intersect(x, y))::INT AS n FROM a JOIN b USING (organism, locus)")
def u04_common_positions(spark, d):
    from ..operators.hits import best_hits

    a = opt(spark, d).select("organism", "locus", "start1", "end1")
    b = best_hits(hits(spark, d), 2).select("organism", "locus", F.col("start1").alias("start"), F.col("end1").alias("end"))
    common = F.least("end1", "end") - F.greatest("start1", "start") + 1
    return a.join(b, ["organism", "locus"]).select("organism", "locus", F.greatest(F.lit(0), common).alias("n"))


PAIR = "cluster % 2000"


@query(f"""WITH {CTE} SELECT o.cluster % 2000 AS grp, count(*) AS pairs, sum(least(o.end1, s.end1) - greatest(o.start1, s.start1) + 1)::BIGINT AS positions
FROM opt o JOIN sub s ON o.{PAIR} = s.{PAIR} AND o.start1 <= s.end1 AND s.start1 <= o.end1 GROUP BY o.cluster % 2000""")
def j10_interval_pairs(spark, d):
    """Every best hit with every second-best hit of its group that it overlaps."""
    from ..operators.hits import best_hits

    side = lambda x, s, e: x.select((F.col("cluster") % 2000).alias("grp"), F.col("start1").alias(s), F.col("end1").alias(e))
    pairs = overlapping(side(opt(spark, d), "start", "end"), side(best_hits(hits(spark, d), 2), "start_b", "end_b"), ["grp"], width=32)
    common = F.least("end", "end_b") - F.greatest("start", "start_b") + 1
    return pairs.groupBy("grp").agg(F.count("*").alias("pairs"), F.sum(common).cast("long").alias("positions"))
