"""Queries on sequences, files, terms and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import printer
from ..functions import text as X
from ..operators import annotate as A
from ..operators.ranking import global_row_number, segmented
from ..sources import sequences as SQ
from ..sources import tables as TB
from ..sources.workspace import folder, saved
from . import bindings as B
from .hit_queries import CTE, opt, scored
from .pipeline import MODES
from .registry import query
from .text_queries import packed, t

# sequences

SEQ = B.sql(B.SEQS).replace("translate(lower(text)", "translate(lower(text)")


def seqs(spark, d):
    return B.bind(spark, d, B.SEQS)


@query(f"SELECT id, md5(reverse(translate(seq, 'gatcGATC', 'ctagCTAG'))) AS rc FROM ({SEQ})")
def f01_reverse_complement(spark, d):
    return seqs(spark, d).select("id", F.md5(X.reverse_complement(F.col("seq"))).alias("rc"))


FIRST = "CASE WHEN strand = 1 THEN pos - 200 ELSE pos - 99 END"
INNER = "substr(seq, greatest(f, 1)::BIGINT, greatest(least(f + 299, n) - greatest(f, 1) + 1, 0)::BIGINT)"
WHOLE = f"""CASE WHEN circular THEN CASE WHEN f < 1 THEN substr(seq, (n + f)::BIGINT, (1 - f)::BIGINT) ELSE '' END || {INNER} || CASE WHEN f + 299 > n THEN substr(seq, 1, (f + 299 - n)::BIGINT) ELSE '' END ELSE {INNER} END"""


@query(f"""WITH s AS (SELECT id, seq, circular, strand, length(seq) AS n, {FIRST} AS f FROM ({SEQ})), w AS (SELECT *, {WHOLE} AS w FROM s)
SELECT id, md5(CASE WHEN n < 300 THEN NULL WHEN NOT circular AND (f < 1 OR f + 299 > n) AND length({INNER}) < 150 THEN NULL WHEN strand = 1 THEN w ELSE reverse(translate(w, 'gatcGATC', 'ctagCTAG')) END) AS region FROM w""")
def f02_region_window(spark, d):
    s = seqs(spark, d)
    return s.select("id", F.md5(X.region_window(F.col("seq"), F.col("circular"), F.col("strand"), F.col("pos"), 200, 100)).alias("region"))


@query(f"""WITH s AS (SELECT id, seq, strand, length(seq) AS n FROM ({SEQ})), w AS (SELECT id, strand, substr(seq, 51, 50) || substr(seq, 101, 60) || substr(seq, 201, 60) || substr(seq, 261, 30) AS f, substr(seq, 71, 30) || substr(seq, 101, 60) || substr(seq, 201, 60) || substr(seq, 261, 50) AS r FROM s)
SELECT id, md5(CASE WHEN strand = 1 THEN f ELSE reverse(translate(r, 'gatcGATC', 'ctagCTAG')) END) AS cds FROM w""")
def f03_cds_with_flanks(spark, d):
    s = seqs(spark, d)
    parts = F.array(F.struct(F.lit(101).alias("s"), F.lit(160).alias("e")), F.struct(F.lit(201).alias("s"), F.lit(260).alias("e")))
    return s.select("id", F.md5(X.cds_with_flanks(F.col("seq"), F.lit(False), F.col("strand"), parts, 50, 30)).alias("cds"))


@query(f"SELECT id, md5(substr(seq, 3, 8) || substr(seq, 21, 10)) AS spliced, length(seq) AS n FROM ({SEQ})")
def f16_spliced(spark, d):
    parts = F.array(F.struct(F.lit(3).alias("s"), F.lit(10).alias("e")), F.struct(F.lit(21).alias("s"), F.lit(30).alias("e")))
    return seqs(spark, d).select("id", F.md5(X.spliced(F.col("seq"), parts)).alias("spliced"), F.length("seq").cast("long").alias("n"))


PAIRS = "SELECT item_id, translate(text, 'bdefhijklmnopqrstvwxyzacgu', 'ACGUACGUACGUACGUACGUACACGU') AS a, translate(reverse(text), 'bdefhijklmnopqrstvwxyzacgu', 'ACGUACGUACGUACGUACGUACACGU') AS b FROM {benchmark}"


@query(f"""WITH p AS ({B.sql(PAIRS)}), i AS (SELECT item_id, unnest(string_split(a, '')) AS x, unnest(string_split(b, '')) AS y, unnest(range(1, length(a)::BIGINT + 1)) AS k FROM p)
SELECT item_id, string_agg(CASE WHEN x || y IN ('AU', 'UA', 'GC', 'CG') THEN '|' WHEN x || y IN ('GU', 'UG') THEN ':' ELSE ' ' END, '' ORDER BY k) AS marks FROM i GROUP BY item_id""")
def f12_pair_line(spark, d):
    p = B.bind(spark, d, PAIRS)
    return p.select("item_id", X.pair_line(F.col("a"), F.col("b")).alias("marks"))


PICTURE = f"""WITH p AS ({B.sql(PAIRS)}), c AS (SELECT item_id, regexp_replace(a, '[^ACGU]', '', 'g') AS x, regexp_replace(b, '[^ACGU]', '', 'g') AS y FROM p), n AS (SELECT *, length(x)::BIGINT AS n FROM c),
u AS (SELECT item_id, unnest(string_split(x, '')) AS c, unnest(string_split(y, '')) AS e, unnest(range(1, n + 1)) AS k FROM n),
m AS (SELECT item_id, string_agg(CASE WHEN c || e IN ('AU', 'UA', 'GC', 'CG') THEN '|' WHEN c || e IN ('GU', 'UG') THEN ':' ELSE ' ' END, '' ORDER BY k) AS marks FROM u GROUP BY item_id)
SELECT item_id, replace(
  repeat(' ', 13) || '4' || repeat(' ', n) || (n + 5) || '\\n' || repeat(' ', 13) || '|' || repeat(' ', n) || '|' || '\\n' || repeat(' ', 7) || '5' || chr(39) || '-ACGU' || repeat(' ', n) || 'AC-3' || chr(39) || '\\n' ||
  repeat(' ', 14) || x || '\\n' || repeat(' ', 14) || marks || '\\n' || repeat(' ', 14) || y || '\\n' || repeat(' ', 9) || '3' || chr(39) || '-GU' || repeat(' ', n) || 'ACGUA...CGU-5' || chr(39) || '\\n' ||
  repeat(' ', 13) || '|' || repeat(' ', n) || '|' || '\\n' || repeat(' ', 13) || (n + 3) || repeat(' ', greatest(0, 1 + n - length((n + 3)::VARCHAR))) || '2' || '\\n', ' ', '_') AS picture FROM n JOIN m USING (item_id)"""


@query(PICTURE)
def f13_interaction_picture(spark, d):
    p = B.bind(spark, d, PAIRS)
    x, y = (F.regexp_replace(c, "[^ACGU]", "") for c in ("a", "b"))
    n = F.length(x)
    top, low = F.concat(F.lit("5'-ACGU"), F.repeat(F.lit(" "), n), F.lit("AC-3'")), F.concat(F.lit("3'-GU"), F.repeat(F.lit(" "), n), F.lit("ACGUACGUACGU-5'"))
    place = lambda s: F.concat_ws(" -- ", F.lit(s).cast("string"), (n + s - 1).cast("string"))
    out = printer.picture(top, x, y, low, place(5), place(3))
    return p.select("item_id", out.alias("picture"))


HUE = "(k * 360.0::DOUBLE / 5)"
SAT = "(CASE WHEN p <= 1e-6 THEN 1.0::DOUBLE ELSE -0.15::DOUBLE * log10(p) END)"


def _hex(x: str) -> str:
    return f"lpad(lower(to_hex(floor({x} * 255)::BIGINT)), 2, '0')"


_P, _Q, _T = _hex(f"(1 - {SAT})"), _hex(f"(1 - {SAT} * f)"), _hex(f"(1 - {SAT} * (1 - f))")
COLOR = f"""CASE i % 6 WHEN 0 THEN '#ff' || {_T} || {_P} WHEN 1 THEN '#' || {_Q} || 'ff' || {_P} WHEN 2 THEN '#' || {_P} || 'ff' || {_T}
 WHEN 3 THEN '#' || {_P} || {_Q} || 'ff' WHEN 4 THEN '#' || {_T} || {_P} || 'ff' ELSE '#ff' || {_P} || {_Q} END"""


@query(f"""WITH c AS (SELECT l_orderkey AS id, l_linenumber AS num, l_linenumber % 5 AS k, (l_tax + 0.0005) / 10 AS p FROM lineitem), h AS (SELECT *, floor({HUE} / 60)::INT AS i, {HUE} / 60 - floor({HUE} / 60) AS f FROM c)
SELECT id, num, k, {COLOR} AS color FROM h""")
def f08_heat_color(spark, d):
    c = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("num"), (F.col("l_linenumber") % 5).alias("k"), ((F.col("l_tax") + F.lit(0.0005)) / 10).alias("p"))
    return c.select("id", "num", "k", X.hsv_hex(X.hue(F.col("k"), F.lit(5)), X.saturation(F.col("p"))).alias("color"))


@query(f"""WITH e AS (SELECT DISTINCT event_type AS feature, user_id::VARCHAR AS source FROM events), ids AS (SELECT feature, row_number() OVER (ORDER BY feature) AS k FROM (SELECT DISTINCT feature FROM e)),
c AS (SELECT source, feature, k, dense_rank() OVER (PARTITION BY feature ORDER BY source) AS num FROM e JOIN ids USING (feature)), v AS (SELECT *, 1.0::DOUBLE / (num + 1) AS p FROM c UNION ALL SELECT NULL, feature, k, 0, 0 FROM ids),
h AS (SELECT *, floor({HUE} / 60)::INT AS i, {HUE} / 60 - floor({HUE} / 60) AS f FROM v), x AS (SELECT *, {COLOR} AS color FROM h),
g AS (SELECT string_agg(k || ':' || printf('%.2f', k / 3.0::DOUBLE) || ':' || color, ';' ORDER BY k) AS t FROM x WHERE source IS NULL)
SELECT source, feature, '{{"flagF":1,"fMax":5,"fNum":' || k || ',"feature":"' || feature || '","flagS":' || (k = 1)::INT || ',"sMax":0,"sNum":' || num || ',"source":"' || source || '","color":"' || color || '","value":' || p || ',"group":"' || t || '"}}' AS json
FROM x, g WHERE source IS NOT NULL""")
def k07_f09_heatmap_json(spark, d):
    pairs = A.term_rows(B.bind(spark, d, "SELECT event_type AS term, array_join(collect_set(CAST(user_id AS STRING)), ',') AS genes FROM {events} GROUP BY event_type"))
    ids = pairs.select("term").distinct().withColumn("group_id", F.row_number().over(Window.orderBy("term")))
    text = A.group_text(ids.withColumn("score", F.col("group_id") / 3), 5)
    cells = pairs.join(ids, "term").withColumn("s_num", F.dense_rank().over(Window.partitionBy("term").orderBy("gene")))
    cells = cells.select(F.col("gene").alias("source"), "s_num", F.lit(0).alias("s_max"), F.col("term").alias("feature"), F.col("group_id").alias("f_num"), F.lit(5).alias("f_max"), F.lit(1).alias("member"), "group_id", F.lit(5).alias("groups"), (1.0 / (F.col("s_num") + 1)).alias("value"))
    return A.heatmap_cells(cells.crossJoin(F.broadcast(text))).select("source", "feature", "json")  # one row of text


@query("SELECT p_partkey, lower(p_name) AS lower_name, trim(substr(p_name, 2, 6)) AS part_name, regexp_replace(p_type, '[aeiou]', '', 'g') AS consonants, regexp_extract(p_brand, '([0-9]+)', 1) AS digits FROM part")
def f06_string_functions(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", F.lower("p_name").alias("lower_name"), F.trim(F.substring("p_name", 2, 6)).alias("part_name"), F.regexp_replace("p_type", "[aeiou]", "").alias("consonants"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"))


@query(f"WITH {CTE} SELECT organism, locus, round(energy, 6) AS energy, round(p, 7) AS p FROM scored")
def f07_rounded_numbers(spark, d):
    return scored(spark, d).select("organism", "locus", F.round("energy", 6).alias("energy"), F.round("p", 7).alias("p"))


@query("SELECT l_suppkey, array_to_string(list_sort(list_distinct(list(l_linenumber))), '_') AS numbers, len(list_distinct(list(l_linenumber)))::INT AS n, list_contains(list(l_linenumber), 3) AS has_three FROM lineitem GROUP BY l_suppkey")
def f10_array_functions(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("x"))
    return g.select("l_suppkey", F.array_join("x", "_").alias("numbers"), F.size("x").alias("n"), F.array_contains("x", 3).alias("has_three"))


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS log, round(exp(p_size / 50.0::DOUBLE), 6) AS e, floor(p_retailprice)::BIGINT AS f, round(pow(p_size, 1.5::DOUBLE), 6) AS pw FROM part")
def f11_math_functions(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", F.round(F.sqrt("p_retailprice"), 6).alias("root"), F.round(F.log("p_retailprice"), 6).alias("log"), F.round(F.exp(F.col("p_size") / 50), 6).alias("e"), F.floor("p_retailprice").alias("f"), F.round(F.pow("p_size", F.lit(1.5)), 6).alias("pw"))


@query("SELECT c_custkey, chr(((k // 17576) % 26 + 97)::INT) || chr(((k // 676) % 26 + 97)::INT) || chr(((k // 26) % 26 + 97)::INT) || chr((k % 26 + 97)::INT) AS code FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer)")
def f14_organism_codes(spark, d):
    c = global_row_number(t(spark, d, "customer").select("c_custkey"), ["c_custkey"], "k")
    return c.select("c_custkey", X.organism_code(F.col("k")).alias("code"))


@query("SELECT n_nationkey, substr(n_name, 1, 3) || '_' || split_part(n_name, '_', 2) || '_x' AS short FROM nation JOIN region ON n_regionkey = r_regionkey")
def f15_abbreviation(spark, d):
    x = B.load(spark, d, "nation", "region")
    full = F.concat_ws("_", "n_name", F.lit("x"), "r_name")
    return x["nation"].join(x["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", X.abbreviate(full).alias("short"))


# windows, sorts, sets


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def w03_row_number(spark, d):
    return global_row_number(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "place")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, min(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC ROWS UNBOUNDED PRECEDING) AS low FROM lineitem")
def w04_minimum_from_below(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    below = t(spark, d, "lineitem").select("l_suppkey", *order, *[(-F.col(c)).alias(f"from_{c}") for c in order])
    return segmented(below, ["l_suppkey"], [f"from_{c}" for c in order], low=("min", F.col("l_extendedprice"))).select("l_suppkey", *order[:3], "low")


@query("SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w ::BIGINT AS grp, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER w AS score FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)".replace(" OVER w ::BIGINT", " OVER w"))
def w06_fill_down(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("user"), F.length("text").cast("long").alias("n"))
    filled = segmented(c, ["conv_id"], ["turn"], grp=("sum", F.when(F.col("user"), 1).otherwise(0)), score=("last", F.when(F.col("user"), F.col("n"))))
    return filled.select("conv_id", "turn", "grp", "score")


@query("""WITH g AS (SELECT conv_id, role, length(text) AS n, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM conversations)
SELECT conv_id, grp, max(CASE WHEN role = 'user' THEN n END) AS user_n, max(CASE WHEN role = 'assistant' THEN n END) AS assistant_n FROM g GROUP BY conv_id, grp""")
def w07_folded_records(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    c = segmented(c, ["conv_id"], ["turn"], grp=("sum", F.when(F.col("role") == "user", 1).otherwise(0)))
    return c.groupBy("conv_id", "grp").agg(*[F.max(F.when(F.col("role") == r, F.col("n"))).alias(f"{r}_n") for r in ("user", "assistant")])


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def w08_adjacent_duplicates(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "event_type", (-F.col("event_id")).alias("back"))
    e = segmented(e, ["user_id"], ["back"], before=("next", F.struct("event_type")))  # a struct, so that no row before differs from a null before
    return e.where(F.col("before").isNull() | ~F.col("before.event_type").eqNullSafe(F.col("event_type"))).select("event_id", "event_type")


@query("SELECT conv_id, turn, text IS NOT NULL AS asked, md5(next) AS answer FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE turn % 2 = 0")
def w10_row_pairs(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", F.col("text").isNotNull().alias("asked"), F.md5("text").alias("digest"))
    return segmented(c, ["conv_id"], ["turn"], answer=("next", F.col("digest"))).where("turn % 2 = 0").select("conv_id", "turn", "asked", "answer")


@query(f"WITH {CTE} SELECT organism, locus, p, row_number() OVER (PARTITION BY organism ORDER BY p NULLS LAST, locus)::INT AS place FROM scored")
def o02_o03_p_value_order(spark, d):
    places = global_row_number(scored(spark, d).select("organism", "locus", "p"), [F.col("p").asc_nulls_last(), "locus"], by=["organism"])
    return places.select("organism", "locus", "p", F.col("place").cast("int").alias("place"))


@query("SELECT s_name, row_number() OVER (ORDER BY s_name) AS place FROM supplier")
def o04_line_order(spark, d):
    return global_row_number(t(spark, d, "supplier").select("s_name"), ["s_name"])


@query(f"WITH {CTE} SELECT locus FROM scored WHERE organism = 'org1' ORDER BY p, locus LIMIT 100")
def o05_o07_top_ids(spark, d):
    return scored(spark, d).where("organism = 'org1'").orderBy("p", "locus").limit(100).select("locus")


@query("SELECT DISTINCT n_name FROM nation ORDER BY n_name")
def o09_sorted_keys(spark, d):
    return t(spark, d, "nation").select("n_name").distinct().orderBy("n_name")


@query("SELECT c_custkey AS id, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def u01_union_all(spark, d):
    x = B.load(spark, d, "customer", "supplier")
    return x["customer"].select(F.col("c_custkey").alias("id"), F.lit("c").alias("kind")).unionByName(x["supplier"].select(F.col("s_suppkey").alias("id"), F.lit("s").alias("kind")))


@query("(SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def u02_symmetric_difference(spark, d):
    x = B.load(spark, d, "documents", "labels")
    a, b = x["documents"].select("doc_id"), x["labels"].select("doc_id")
    return a.subtract(b).union(b.subtract(a)).distinct()


@query("SELECT l_partkey AS id FROM lineitem UNION SELECT p_partkey FROM part")
def u03_distinct_union(spark, d):
    x = B.load(spark, d, "lineitem", "part")
    return x["lineitem"].select(F.col("l_partkey").alias("id")).union(x["part"].select("p_partkey")).distinct()


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def u05_membership(spark, d):
    x = B.load(spark, d, "lineitem", "part")
    return x["part"].select("p_partkey").join(x["lineitem"].where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@query("SELECT s_suppkey, s_name FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1")
def u06_first_of_duplicates(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return t(spark, d, "supplier").withColumn("k", F.row_number().over(w)).where("k = 1").select("s_suppkey", "s_name")


@query(f"WITH {CTE} SELECT cluster, string_agg(locus || ':' || organism, ';' ORDER BY organism) AS line FROM opt GROUP BY cluster")
def a31_cluster_lines(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("organism", F.concat_ws(":", "locus", "organism").alias("x"))))
    return opt(spark, d).groupBy("cluster").agg(F.array_join(F.transform(parts, lambda s: s["x"]), ";").alias("line"))


EVENTS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id::VARCHAR AS gene, " + ", ".join(f"max(CASE WHEN event_type = '{e}' THEN 1 ELSE 0 END) AS {e}" for e in EVENTS) + " FROM events GROUP BY user_id")
def a33_one_hot(spark, d):
    pairs = t(spark, d, "events").select(F.col("event_type").alias("term"), F.col("user_id").cast("string").alias("gene")).distinct()
    return A.one_hot(pairs, EVENTS)


TERMS = "SELECT concat('K', CAST(p_size AS STRING), ':', p_brand) AS term, p_partkey AS ord FROM {part}"


@query(f"WITH x AS ({B.sql(TERMS).replace('AS STRING', 'AS VARCHAR')}) SELECT term, ord, regexp_extract(term, '^[^:]*:(.*)$', 1) AS name FROM x QUALIFY row_number() OVER (PARTITION BY regexp_extract(term, '^[^:]*:(.*)$', 1) ORDER BY ord) = 1")
def a34_terms_by_name(spark, d):
    return A.first_by_name(B.bind(spark, d, TERMS))


@query("SELECT lang AS organism, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def a36_files_by_organism(spark, d):
    return t(spark, d, "documents").groupBy(F.col("lang").alias("organism")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# files: written to the shared folder and read again


@query("SELECT 'p' || p_partkey AS id, lower(replace(p_name, ' ', '')) AS seq FROM part")
def s01_k04_fasta(spark, d):
    path = folder(spark)
    recs = t(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lower(F.replace("p_name", F.lit(" "), F.lit("\n"))).alias("seq"))
    SQ.write_fasta(recs, path)
    return SQ.read_fasta(spark, path).select("id", "seq")


@query("SELECT 'p' || p_partkey AS id, replace(p_name, ' ', '-') AS seq FROM part")
def s11_aligned_fasta(spark, d):
    path = folder(spark)
    SQ.write_fasta(t(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("seq")), path)
    return SQ.read_fasta(spark, path).select("id", "seq")


@query("SELECT s_nationkey::INT AS organism, 's' || s_suppkey AS id, lower(s_name) AS seq FROM supplier")
def k21_fasta_by_organism(spark, d):
    path = folder(spark)
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("organism"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lower("s_name").alias("seq"))
    SQ.write_fasta(s, path, by="organism")
    back = spark.read.text(path, lineSep="\n>")
    x = back.select("organism", F.regexp_replace("value", r"^>", "").alias("v"))
    return x.select("organism", F.regexp_extract("v", r"^([^\n]*)", 1).alias("id"), F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n", ""), r"\s", "").alias("seq"))


GB = f"""SELECT 'NC_' || lpad(id::VARCHAR, 9, '0') AS replicon, length(seq)::INT AS length, circular, ft AS ftype, CASE WHEN ft = 'CDS' THEN 'T' || id END AS locus_tag,
  CASE WHEN ft = 'CDS' THEN 'some protein' END AS product, CASE WHEN ft = 'CDS' THEN -1 ELSE 1 END AS strand, CASE WHEN ft = 'CDS' THEN 2 ELSE 1 END AS n_parts
FROM ({SEQ}), (SELECT unnest(['source', 'CDS']) AS ft)"""


@query(GB)
def s02_genbank(spark, d):
    """Records written from the documents and parsed again."""
    path = folder(spark)
    s = seqs(spark, d)
    body = F.concat(
        F.lit("LOCUS       NC_"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit("  "), F.length("seq").cast("string"), F.lit(" bp    DNA     "),
        F.when(F.col("circular"), "circular").otherwise("linear"), F.lit(" BCT\nACCESSION   NC_"), F.lpad(F.col("id").cast("string"), 9, "0"),
        F.lit("\n  ORGANISM  Genus species\nFEATURES             Location/Qualifiers\n     source          1.."), F.length("seq").cast("string"),
        F.lit('\n                     /organism="Genus species"\n     CDS             complement(join(10..40,50..90))\n                     /locus_tag="T'), F.col("id").cast("string"),
        F.lit('"\n                     /product="some\n                     protein"\n                     /db_xref="GeneID:7"\nORIGIN\n        1 '), F.regexp_replace("seq", "[^acgt]", "n"), F.lit("\n//"),
    )
    s.select(body.alias("value")).write.text(path)
    return SQ.read_genbank(spark, path).select("replicon", "length", "circular", "ftype", "locus_tag", "product", "strand", F.size("parts").alias("n_parts"))


@query(f"WITH {CTE} SELECT organism AS id2, locus AS id1, start1, end1, start2, end2, energy AS \"E\", p FROM scored")
def s03_k03_hit_table(spark, d):
    path = folder(spark)
    x = scored(spark, d)
    cols = {"id1": F.col("locus"), "id2": F.col("organism"), "start1": F.col("start1"), "end1": F.col("end1"), "start2": F.col("start2"), "end2": F.col("end2"), "E": F.col("energy")}
    full = x.select(*[(cols.get(c, F.lit(None)).cast(k)).alias(c) for c, k in TB.HIT_COLUMNS.items()], F.col("p").alias("p-value"))
    TB.write_hits(full, path)
    back = TB.read_hits(spark, path, p_value=True)
    return back.select("id2", "id1", "start1", "end1", "start2", "end2", "E", F.col("p-value").alias("p"))


@query(f"WITH {CTE} SELECT cluster, organism, concat(locus, '(', organism, '|1|', start1, '|', start1, '|', end1, '|', start2, '|', end2, '|GeneID:', cluster, ')') AS cell FROM opt")
def s04_k01_result_table(spark, d):
    from .text_queries import T5

    path = folder(spark)
    wide = A.wide_results(packed(spark, d), T5)
    out = wide.select(F.lit(0.5).alias("fdr"), F.lit(0.1).alias("p-value"), *T5, F.col("cluster").cast("string").alias("Annotation"), F.lit("").alias("Additional homologs"), F.lit(0).alias("Amount sampled"))
    out.write.option("header", True).option("quote", "").option("emptyValue", "").csv(path)
    back = TB.read_results(spark, path, T5).withColumn("cluster", F.col("Annotation").cast("long"))
    return TB.long_results(back, T5, "cluster")


@query(f"WITH {CTE}, m AS (SELECT unnest({MODES!r}) AS mode), r AS (SELECT mode, cluster, min(p) AS p, count(*) AS n FROM scored, m WHERE (cluster + length(mode)) % 3 <> 0 GROUP BY mode, cluster) SELECT mode, cluster, p, (5 - n)::INT AS n_sampled FROM r")
def k01_mode_files(spark, d):
    """A wide result file per mode, written and read again."""
    from .text_queries import T5

    path, s = folder(spark), saved(scored(spark, d))  # once for all modes
    wide = saved(A.wide_results(packed(spark, d, s), T5).withColumnRenamed("cluster", "row_id"))
    for mode in MODES:
        kept = s.where((F.col("cluster") + len(mode)) % 3 != 0).groupBy(F.col("cluster").alias("row_id")).agg(F.min("p").alias("p"), (5 - F.count("*")).cast("int").alias("sampled"))
        TB.write_results(kept.join(wide, "row_id").withColumns({"fdr": F.col("p"), "annotation": F.col("row_id").cast("string"), "homologs": F.lit("")}), f"{path}/{mode}", T5)
    read = [TB.read_results(spark, f"{path}/{mode}", T5).select(F.lit(mode).alias("mode"), F.col("Annotation").cast("long").alias("cluster"), F.col("p-value").alias("p"), F.col("Amount sampled").alias("n_sampled")) for mode in MODES]
    out = read[0]
    for x in read[1:]:
        out = out.unionByName(x)
    return out


@query(f"SELECT 'c' || cluster AS cluster, 'k' || (cluster % 7) AS code, locus FROM ({B.sql(B.MEMBERS)})")
def s05_cluster_table(spark, d):
    path = folder(spark)
    m = B.bind(spark, d, B.MEMBERS)
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "locus", "cluster"))), lambda s: F.concat(F.lit("k"), (s["cluster"] % 7).cast("string"), F.lit(":"), F.upper(s["locus"]), F.lit("(1)"))), " ")
    lines = m.groupBy("cluster").agg(cell.alias("cell")).select(F.concat(F.lit("c"), F.col("cluster").cast("string"), F.lit("\t\t"), "cell").alias("value"))
    lines.write.text(path)
    return TB.read_clusters(spark, path).select("cluster", "code", "locus")


@query("SELECT 'NC_' || c_custkey AS replicon, 'n' || c_nationkey AS code, count(*) OVER (PARTITION BY c_nationkey)::INT AS n FROM customer")
def s07_organism_map(spark, d):
    path = folder(spark)
    c = t(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda k: F.concat(F.lit("NC_"), k.cast("string"))), " ").alias("ids"))
    c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("\t"), "ids").alias("value")).write.text(path)
    return TB.read_organism_map(spark, path).select("replicon", "code", F.size("replicons").alias("n"))


@query("SELECT 'r' || a.r_regionkey AS a, 'r' || b.r_regionkey AS b, (abs(a.r_regionkey - b.r_regionkey) * 1.5)::DOUBLE AS d FROM region a, region b WHERE a.r_regionkey <= b.r_regionkey")
def s08_distance_matrix(spark, d):
    """Written as an upper triangle below eight lines of header, the name in the last field."""
    path = folder(spark)
    r = t(spark, d, "region").select(F.col("r_regionkey").alias("k"))
    row = r.alias("a").crossJoin(r.alias("b")).groupBy(F.col("a.k").alias("k")).agg(F.array_sort(F.collect_list(F.col("b.k"))).alias("js"))  # five rows
    cell = lambda k: F.transform("js", lambda j: F.when(j >= k, F.format_string("%.2f", F.abs(k - j) * 1.5)).otherwise(""))
    lines = row.select("k", F.concat(F.lit("\t"), F.array_join(cell(F.col("k")), "\t"), F.lit("\t\tr"), F.col("k").cast("string"), F.lit(" "), (F.col("k") + 1).cast("string")).alias("v"))
    text = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]), "\n").alias("t"))
    text.select(F.concat(F.lit("h\n" * 8), "t").alias("value")).write.text(path)
    return TB.parse_distances(TB.numbered_lines(spark, path)).drop("file")


@query("SELECT n_name AS child, 'n' || n_regionkey AS parent, (n_nationkey % 5 + 1)::DOUBLE / 8 AS length FROM nation")
def s09_neighbour_report(spark, d):
    path = folder(spark)
    n = t(spark, d, "nation")
    n.select(F.concat_ws("  ", F.concat(F.lit("n"), F.col("n_regionkey").cast("string")), "n_name", F.format_string("%.5f", -(F.col("n_nationkey") % 5 + 1) / 8), F.lit("1.00000")).alias("value")).write.text(path)
    return TB.parse_neighbours(TB.numbered_lines(spark, path)).select("child", "parent", "length")


@query("SELECT 'n' || a.n_nationkey AS a, 'n' || b.n_nationkey AS b, abs(a.n_nationkey - b.n_nationkey)::DOUBLE AS d FROM nation a, nation b")
def s10_full_matrix(spark, d):
    path = folder(spark)
    k = t(spark, d, "nation").agg(F.array_sort(F.collect_list("n_nationkey")).alias("k"))
    line = lambda i: F.concat(F.lit("n"), i.cast("string"), F.lit("   "), F.array_join(F.transform("k", lambda j: F.format_string("%d.0", F.abs(i - j))), " "))
    k.select(F.concat(F.size("k").cast("string"), F.lit("\n"), F.array_join(F.transform("k", line), "\n")).alias("value")).write.text(path)
    return TB.parse_full_matrix(TB.numbered_lines(spark, path)).drop("file")


@query("SELECT DISTINCT 'p' || l_partkey AS qid, 's' || l_suppkey AS sid, l_quantity AS ident, l_tax AS eval FROM lineitem")
def s12_blast_table(spark, d):
    path = folder(spark)
    x = t(spark, d, "lineitem")
    z = F.lit("0")
    line = F.concat_ws("\t", F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.col("l_quantity").cast("string"), z, z, z, z, z, z, z, F.col("l_tax").cast("string"), z)
    x.select(line.alias("value")).unionByName(spark.createDataFrame([("# BLASTP",)], "value string")).write.text(path)
    return TB.read_blast(spark, path).select("qid", "sid", "ident", "eval").distinct()


@query("SELECT 'g' || item_id AS locus, o::INT AS \"offset\", 'line' || o AS value FROM benchmark, range(5, 19) r(o)")
def s13_interaction_blocks(spark, d):
    path = folder(spark)
    lines = F.concat(F.lit("target: g"), F.col("item_id").cast("string"), F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("line"), i.cast("string"))), "\n"))
    t(spark, d, "benchmark").select(lines.alias("value")).write.text(path)
    return TB.parse_interaction_blocks(TB.numbered_lines(spark, path))


@query("SELECT CAST(l_returnflag AS VARCHAR) AS organism, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def s17_files_by_organism(spark, d):
    path = folder(spark)
    x = t(spark, d, "lineitem").select("l_returnflag", F.col("l_orderkey").cast("string").alias("value"))
    x.write.partitionBy("l_returnflag").text(path)
    files = spark.read.text(f"{path}/*").select(F.regexp_extract("_metadata.file_path", "l_returnflag=([^/]*)/", 1).alias("organism"))
    return files.groupBy("organism").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size = 7")
def s18_gene_list(spark, d):
    path = folder(spark)
    p = t(spark, d, "part")
    TB.write_lines(p.where("p_size = 7").select("p_partkey"), path)
    genes = spark.read.text(f"{path}/body").select(F.col("value").cast("long").alias("p_partkey"))
    return p.select("p_partkey", "p_name").join(genes, "p_partkey", "left_semi")


KV = ["afdr", "categoryName", "termName", "listHits", "percent", "ease", "geneIds", "listTotals", "popHits", "popTotals", "foldEnrichment", "bonferroni", "benjamini"]


@query("SELECT r_regionkey + 1 AS group_id, n_name AS \"termName\", r_name AS \"categoryName\", n_nationkey::VARCHAR AS \"listHits\" FROM nation JOIN region ON n_regionkey = r_regionkey".replace("r_regionkey + 1 AS group_id", "(r_regionkey + 1)::BIGINT AS group_id"))
def s19_k09_enrichment_report(spark, d):
    """A key=value report, a score line per group, parsed to one row per term."""
    path = folder(spark)
    x = B.load(spark, d, "nation", "region")
    n = x["nation"].join(x["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    term = F.concat_ws("\n", F.lit("afdr=0.1"), F.concat(F.lit('categoryName="'), "r_name", F.lit('"')), F.concat(F.lit("termName="), "n_name"), F.concat(F.lit("listHits="), F.col("n_nationkey").cast("string")))
    groups = n.groupBy("r_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", term.alias("t")))).alias("ts"))
    body = groups.select("r_regionkey", F.concat(F.lit("score="), (F.col("r_regionkey") + 0.5).cast("string"), F.lit("\n"), F.array_join(F.transform("ts", lambda s: s["t"]), "\n")).alias("v"))
    body.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "v"))), lambda s: s["v"]), "\n").alias("value")).write.text(path)
    table = f"{path}-table"
    TB.write_enrichment(TB.parse_enrichment(TB.parse_key_values(TB.numbered_lines(spark, path))), table)
    return TB.read_enrichment(spark, table).select(F.col("group_id").cast("long").alias("group_id"), F.col("Term").alias("termName"), F.col("Category").alias("categoryName"), F.col("Count").alias("listHits"))


@query("SELECT 'p' || p_partkey AS id, length(replace(p_name, ' ', '')) AS n, p_brand AS title FROM part")
def k05_gene_lengths(spark, d):
    """Lengths and titles of genes, each a file of its own, read again and joined."""
    path = folder(spark)
    g = t(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.replace("p_name", F.lit(" "), F.lit("")).alias("seq"), F.col("p_brand").alias("title"))
    TB.write_genes(g, path)
    return TB.read_genes(spark, path).select("id", "n", "title")


@query("SELECT DISTINCT 'p' || l_partkey || ' s' || l_suppkey || ' 1.5 2.5' AS value FROM lineitem")
def k06_edge_list(spark, d):
    path = folder(spark)
    x = t(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b"), F.lit(1.5).alias("distance"), F.lit(2.5).alias("score")).distinct()
    TB.write_edge_list(x, path)
    return spark.read.text(path)


WEB_ROWS = f"""WITH {CTE}, o AS (SELECT cluster AS row_id, p, locus, organism, start1, end1, start2, end2, cluster FROM scored WHERE organism = 'org2')
SELECT row_number() OVER (ORDER BY p NULLS LAST, row_id) AS "Rank", p AS "p-value", p AS "fdr", locus AS "Locus Tag", organism AS "Gene Name", 1.0::DOUBLE AS "Energy kcal/mol", start1::DOUBLE AS "single p-value",
 concat(start1, ' -- ', end1) AS "Position mRNA", concat(start2, ' -- ', end2) AS "Position ncRNA", 'N/A' AS "Annotation", '' AS "Additional homologs", cluster::VARCHAR AS "Entrez GeneID", 0 AS "Amount sampled" FROM o"""


@query(WEB_ROWS)
def k08_web_table(spark, d):
    """The table of a web result, written as a file and read again."""
    path = folder(spark)
    return TB.read_web(spark, TB.write_web(A.web_table(_web_rows(spark, d)), path))


def _web_rows(spark, d):
    p = scored(spark, d).where("organism = 'org2'").select(F.col("cluster").alias("row_id"), "p")
    cells = packed(spark, d).where("organism = 'org2'").select(F.col("cluster").alias("row_id"), "cell")
    return p.join(cells, "row_id").withColumns({"fdr": F.col("p"), "annotation": F.lit("N/A"), "homologs": F.lit(""), "sampled": F.lit(0)})


#: Strands of a made-up interaction for six parts of seven, of 6 to 25 bases.
STRANDS = """SELECT p_partkey, substr(a, 1, CAST(6 + p_partkey % 20 AS INT)) AS x, substr(reverse(a), 1, CAST(6 + p_partkey % 20 AS INT)) AS y FROM
  (SELECT p_partkey, translate(md5(CAST(p_partkey AS STRING)), '0123456789abcdef', 'ACGUACGUACGUACGU') AS a FROM {part} WHERE p_partkey % 7 <> 0)"""
_UPPER, _LOWER = "'       5' || chr(39) || '-ACGU'", "'         3' || chr(39) || '-GU'"
_RULER = "repeat(' ', 13) || {0} || repeat(' ', greatest(0, 1 + n - length(CAST({0} AS VARCHAR)))) || {1}"


@query(f"""WITH web AS ({WEB_ROWS}), st AS (SELECT *, length(x)::BIGINT AS n FROM ({B.sql(STRANDS).replace('STRING', 'VARCHAR')})),
u AS (SELECT p_partkey, unnest(string_split(x, '')) AS c, unnest(string_split(y, '')) AS e, unnest(range(1, n + 1)) AS k FROM st),
m AS (SELECT p_partkey, string_agg(CASE WHEN c || e IN ('AU', 'UA', 'GC', 'CG') THEN '|' WHEN c || e IN ('GU', 'UG') THEN ':' ELSE ' ' END, '' ORDER BY k) AS marks FROM u GROUP BY p_partkey),
w AS (SELECT *, split_part("Position mRNA", ' -- ', 1)::INT - 1 AS t0, split_part("Position mRNA", ' -- ', 2)::INT + 1 AS t1, split_part("Position ncRNA", ' -- ', 1)::INT - 1 AS q0, split_part("Position ncRNA", ' -- ', 2)::INT + 1 AS q1 FROM web),
j AS (SELECT * FROM w LEFT JOIN st ON "Locus Tag" = concat('g', p_partkey) LEFT JOIN m USING (p_partkey))
SELECT j.* EXCLUDE (p_partkey, x, y, n, marks, t0, t1, q0, q1), coalesce(replace({_RULER.format('t0', 't1')} || '\\n' || repeat(' ', 13) || '|' || repeat(' ', n) || '|\\n' ||
 {_UPPER} || repeat(' ', n) || 'AC-3' || chr(39) || '\\n' || repeat(' ', 14) || x || '\\n' || repeat(' ', 14) || marks || '\\n' || repeat(' ', 14) || y || '\\n' ||
 {_LOWER} || repeat(' ', n) || 'ACGUA...CGU-5' || chr(39) || '\\n' || repeat(' ', 13) || '|' || repeat(' ', n) || '|\\n' || {_RULER.format('q1', 'q0')} || '\\n', ' ', '_'), '') AS "Interaction",
 CASE WHEN n IS NULL THEN '' ELSE '5 -- ' || n END AS "Position Seed - mRNA", CASE WHEN n IS NULL THEN '' ELSE '3 -- ' || (n + 1) END AS "Position Seed - ncRNA", coalesce('-' || n || '.5', '') AS "Hybridization Energy kcal/mol",
 coalesce((p_partkey % 9) || '.25', '') AS "Unfolding Energy - mRNA kcal/mol", coalesce((p_partkey % 4) || '.75', '') AS "Unfolding Energy - ncRNA kcal/mol" FROM j""")
def k08_web_interactions(spark, d):
    """All 19 columns of a web result: a report of interactions is written, read in splits and joined to the ranked rows, their pictures drawn as columns."""
    s, n = B.bind(spark, d, STRANDS), F.length("x").cast("string")
    gap, text = F.repeat(F.lit(" "), F.length("x")), lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    at = {
        0: text("target: G", F.col("p_partkey").cast("string")), 5: text("  5'-ACGU", gap, "AC-3'"), 6: text("     ", F.col("x")), 7: text("     ", F.col("y")), 8: text("  3'-GU", gap, "ACGUACGUACGU-5'"),
        11: text("seed of the target: 5 -- ", n), 14: text("seed of the query: 3 -- ", (F.length("x") + 1).cast("string")), 16: text("unfolding energy, target: ", (F.col("p_partkey") % 9).cast("string"), ".25"),
        17: text("unfolding energy, query: ", (F.col("p_partkey") % 4).cast("string"), ".75"), 18: text("hybridization energy: -", n, ".5"),
    }
    path = folder(spark)
    s.select(F.concat_ws("\n", *[at.get(k, F.lit("")) for k in range(20)]).alias("value")).write.text(f"{path}/report")
    known = TB.interactions(TB.numbered_lines(spark, f"{path}/report"))
    return TB.read_web(spark, TB.write_web(A.web_table(_web_rows(spark, d), known), f"{path}/web"), interactions=True)


@query("SELECT DISTINCT n_name AS value FROM nation UNION ALL SELECT '##RefSeq-IDs'")
def k17_organism_list(spark, d):
    path = folder(spark)
    n = t(spark, d, "nation").select("n_name")
    TB.write_ordered(n.union(n).dropDuplicates(), path, ["n_name"], "##RefSeq-IDs")
    return spark.read.text(path)


@query(f"WITH {CTE} SELECT CASE WHEN p <= 0.5 THEN 'ooi' ELSE 'balanced' END AS mode, count(*) AS n FROM scored GROUP BY 1")
def k12_modes_as_parquet(spark, d):
    path = folder(spark)
    TB.write_modes(scored(spark, d).select(F.when(F.col("p") <= 0.5, "ooi").otherwise("balanced").alias("mode"), "organism", "locus", "p"), path)
    return spark.read.parquet(path).groupBy("mode").agg(F.count("*").alias("n"))


@query(f"WITH {CTE} SELECT cluster, organism, row_number() OVER (PARTITION BY organism ORDER BY p, cluster)::INT AS rank, p FROM matrix")
def k02_evolution_table(spark, d):
    from ..operators.combine import organism_ranks
    from .hit_queries import matrix

    path = folder(spark)
    organism_ranks(matrix(spark, d)).select("cluster", "organism", "rank", "p").write.option("sep", "\t").option("header", True).csv(path)
    return spark.read.schema("cluster long, organism string, rank int, p double").option("sep", "\t").option("header", True).csv(path)


@query("SELECT event_type AS term, (row_number() OVER (ORDER BY event_type))::INT AS group_id, count(DISTINCT user_id) AS n_genes FROM events GROUP BY event_type")
def k10_membership_meta(spark, d):
    """The two meta rows of the membership matrix as a table of their own: term, group and size; the matrix is a33."""
    e = t(spark, d, "events").groupBy(F.col("event_type").alias("term")).agg(F.count_distinct("user_id").alias("n_genes"))
    return e.select("term", F.row_number().over(Window.orderBy("term")).alias("group_id"), "n_genes")


@query(f"WITH {CTE} SELECT concat('opt hit', chr(9), locus, chr(9), '-1', chr(9), start1, chr(9), end1, chr(9), organism) AS value FROM opt")
def k11_feature_text(spark, d):
    path = folder(spark)
    line = F.concat_ws("\t", F.lit("opt hit"), "locus", F.lit("-1"), F.col("start1").cast("string"), F.col("end1").cast("string"), "organism")
    opt(spark, d).select(line.alias("value")).write.text(path)
    return spark.read.text(path)


TERM_LIST = "SELECT user_id AS cluster, array_join(array_sort(collect_set(event_type)), ';') AS functional_terms FROM {events} GROUP BY user_id"


@query(f"""WITH {CTE}, tl AS (SELECT user_id AS cluster, array_to_string(list_sort(list(DISTINCT event_type)), ';') AS functional_terms FROM events GROUP BY user_id)
SELECT locus AS locus_tag, start1, end1, start2, end2, energy, p, p_name AS gene_name, cluster AS gene_id, p_type AS annotation, functional_terms FROM scored JOIN tl USING (cluster) LEFT JOIN part ON p_partkey = cluster WHERE organism = 'org0'""")
def k18_auxiliary_table(spark, d):
    terms = B.bind(spark, d, TERM_LIST)
    path = folder(spark)
    names = t(spark, d, "part").select(F.col("p_partkey").alias("cluster"), F.col("p_name").alias("gene_name"), F.col("p_type").alias("annotation"))
    x = scored(spark, d).where("organism = 'org0'").join(terms, "cluster").join(names, "cluster", "left")
    TB.write_auxiliary(x.withColumn("gene_id", F.col("cluster")), path)
    return TB.read_auxiliary(spark, path)


@query(f"WITH {CTE}, l AS (SELECT cluster, string_agg(locus || ':' || organism, ';' ORDER BY organism) AS line FROM opt GROUP BY cluster) SELECT cluster, row_number() OVER (ORDER BY line) AS initial_sorting FROM l")
def k19_initial_sorting(spark, d):
    return global_row_number(a31_cluster_lines(spark, d), ["line"], "initial_sorting").select("cluster", "initial_sorting")


@query(f"WITH {CTE} SELECT locus AS id, md5(p_name) AS seq FROM (SELECT locus, cluster FROM scored WHERE organism = 'org0' ORDER BY p, locus LIMIT 100) JOIN part ON p_partkey = cluster")
def k20_top_targets(spark, d):
    """Target sequences of the top hundred loci, as written for a second prediction."""
    path = folder(spark)
    top = scored(spark, d).where("organism = 'org0'").orderBy("p", "locus").limit(100).select("locus", "cluster")
    seqs_ = t(spark, d, "part").select(F.col("p_partkey").alias("cluster"), F.col("p_name").alias("seq"))
    SQ.write_fasta(top.join(seqs_, "cluster").select(F.col("locus").alias("id"), F.replace("seq", F.lit(" "), F.lit("~")).alias("seq")), path)
    return SQ.read_fasta(spark, path).select("id", F.md5(F.replace("seq", F.lit("~"), F.lit(" "))).alias("seq"))


@query("SELECT event_type, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%d.%m.%Y') AS last_day FROM events GROUP BY event_type")
def f17_date_stamps(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(X.date_stamp(F.min("ts")).alias("first_day"), X.date_stamp(F.max("ts"), "dd.MM.yyyy").alias("last_day"))


@query(f"WITH {CTE} SELECT organism, concat('weight of ', organism, ' is ', printf('%.2f', weight)) AS line FROM weights WHERE weight > 0.2")
def k15_weight_warnings(spark, d):
    """Warnings about heavy organisms, as lines of a log that is written and read again."""
    from ..operators.phylogeny import heavy_weights
    from .hit_queries import weights

    path = folder(spark)
    heavy = heavy_weights(weights(spark, d), 0.2)
    heavy.select(F.concat(F.lit("weight of "), "organism", F.lit(" is "), F.format_string("%.2f", "weight")).alias("value")).write.text(path)
    return spark.read.text(path).select(F.regexp_extract("value", r"^weight of (\S+) is", 1).alias("organism"), F.col("value").alias("line"))


# whole runs and streams


@query(None)
def run_first_version(spark, d):
    from .hit_queries import hits, weights
    from .options import RunOptions
    from .pipeline import Run

    return Run(hits(spark, d), weights(spark, d), [f"org{k}" for k in range(5)], RunOptions(cop1=True)).primary()


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    """Events read as a stream of files until the source is exhausted."""
    from ..streaming.intake import windowed_counts

    events = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    path = folder(spark)
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("rankloom_windowed").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("rankloom_windowed").select("start", "event_type", "n", F.round("total", 4).alias("total"))
