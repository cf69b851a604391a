"""Annotation, homologs, enrichment terms, wide results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.printer import picture
from ..functions.printf import shortest
from .ranking import global_row_number


def first_containing(patterns: DataFrame, pattern: str, texts: DataFrame, text: str) -> DataFrame:
    """(pattern, found): for each distinct pattern the first text that contains it, the shortest, then alphabetically; null if none does.

    Each distinct text gives its substrings of the lengths that patterns have; the first text of each substring is found by a minimum with partial
    sums, so what is joined has one row a substring and one a pattern, however many texts hold it. An empty pattern is in every text; null is in none.
    """
    wanted = patterns.select(F.col(pattern).alias("pattern")).distinct()
    sizes = wanted.agg(F.collect_set(F.length("pattern")).alias("sizes"))  # one row, a number a length
    t = texts.select(F.col(text).alias("text")).where("text is not null").distinct().join(F.broadcast(sizes))
    t = t.select("text", F.explode("sizes").alias("size")).where(F.length("text") >= F.col("size"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - F.col("size") + 1))
    cut = t.select("text", "size", F.explode(starts).alias("at")).select("text", F.substring("text", F.col("at"), F.col("size")).alias("pattern"))
    first = cut.groupBy("pattern").agg(F.min(F.struct(F.length("text").alias("n"), "text")).alias("m"))
    return wanted.join(first, "pattern", "left").select("pattern", F.col("m.text").alias("found"))


def with_annotation(rows: DataFrame, annot: DataFrame, key: str = "locus", within: bool = False) -> DataFrame:
    """Adds annotation by case-insensitive equality of loci; N/A where there is none.

    With ``within`` a locus may also be part of the annotated one: the first that contains it is taken, and added as found."""
    a = annot.select(F.lower(key).alias("__k"), X.annotation(F.col("product"), F.col("note"), F.col("function")).alias("annotation"))
    if within:
        part = first_containing(rows.select(F.lower(key).alias("p")), "p", a, "__k")
        out = rows.join(part.withColumnRenamed("pattern", "__p"), F.lower(rows[key]) == F.col("__p"), "left").drop("__p")
        out = out.join(a, F.col("found") == F.col("__k"), "left").drop("__k")
    else:
        out = rows.join(a, F.lower(rows[key]) == F.col("__k"), "left").drop("__k")
    return out.withColumn("annotation", F.coalesce("annotation", F.lit("N/A")))


#: Members of a cluster whose lists one task writes.
PIECE = 1000


def homologs(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """(locus, homologs): other members of a locus's clusters, once each, in the order of clusters and places.

    A list is as long as its clusters, so the result grows with the square of a cluster; what is shuffled doesn't. A cluster's sorted names meet
    ``piece`` members at a time, which leave out themselves. Only loci of several clusters have those clusters' names brought together.
    """
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = members.where("cluster is not null and locus is not null").groupBy("cluster", "locus").agg(F.min(F.struct("pos")).alias("at"))
    once = once.withColumn("alone", F.count("*").over(Window.partitionBy("locus")) == 1)
    lists = once.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("at", "locus", "alone"))).alias("x")).where(F.size("x") > 1)
    pieces = lists.select("cluster", "x", F.explode(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / piece).cast("int"))).alias("k"))
    own = F.transform(F.slice("x", F.col("k") * piece + 1, piece), lambda s: F.struct(s["locus"].alias("locus"), s["alone"].alias("alone")))
    pieces = pieces.select("cluster", "k", F.col("x.locus").alias("names"), own.alias("own")).repartition(partitions, "cluster", "k")
    each = pieces.select("cluster", "names", F.explode("own").alias("m")).select("cluster", "names", "m.locus", "m.alone")
    shared = each.where(~F.col("alone")).groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("cluster", "names"))).alias("x"))
    both = each.where("alone").select("locus", "names").unionByName(shared.select("locus", F.array_distinct(F.flatten("x.names")).alias("names")))
    return both.select("locus", F.array_join(F.array_remove("names", F.col("locus")), " ").alias("homologs"))


def wide_results(cells: DataFrame, organisms: list[str], row: str = "cluster") -> DataFrame:
    """A column per organism in the given order; "" where a row has none."""
    return cells.groupBy(row).pivot("organism", organisms).agg(F.first("cell")).fillna("", subset=organisms)


def described(cells: DataFrame, annot: DataFrame, members: DataFrame, organisms: list[str]) -> DataFrame:
    """What result files tell of each cluster besides its p, the same for every mode: a cell "locus:start-end" per organism, the annotation and the other
    cluster members of the first organism's locus ("" if it has none), and how many organisms the row lacks."""
    cell = F.concat(F.col("locus"), F.lit(":"), F.col("start1").cast("string"), F.lit("-"), F.col("end1").cast("string"))
    of = [F.max(F.when(F.col("organism") == o, F.struct(cell.alias("cell")))).alias(o) for o in organisms]
    first = [F.min_by("locus", "organism").alias("locus"), (F.lit(len(organisms)) - F.count("p")).cast("int").alias("sampled")]
    rows = cells.groupBy("cluster").agg(*of, *first).withColumns({o: F.coalesce(F.col(f"`{o}`.cell"), F.lit("")) for o in organisms})
    return with_annotation(rows, annot).join(homologs(members), "locus", "left").withColumn("homologs", F.coalesce("homologs", F.lit("")))


def annotated_results(result: DataFrame, cells: DataFrame, annot: DataFrame, members: DataFrame, organisms: list[str]) -> DataFrame:
    """A mode's rows (cluster, p, fdr) as its result file has them, with what ``described`` tells of each."""
    return result.join(described(cells, annot, members, organisms), "cluster")


def row_label(wide: DataFrame, organisms: list[str]) -> DataFrame:
    """Adds label: gene_locus of the first organism that has a cell, without slashes."""
    cell = F.coalesce(*[F.when(F.col(o) != "", F.col(o)) for o in organisms])
    x = X.unpack_cell(cell)
    return wide.withColumn("label", F.replace(F.concat_ws("_", x["gene"], x["locus"]), F.lit("/"), F.lit("")))


def unique_labels(rows: DataFrame, label: str = "label", order: str = "row_id") -> DataFrame:
    """Repeated labels get _2, _2_3, _2_3_4, ... in order.

    The n-th suffix has n numbers, so the result grows with the square of a label's rows. Places are counted and suffixes written by ranges of
    (label, order), in as many tasks as there are shuffle partitions: no task holds a label, and no row is moved once it has its suffix.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.withColumns({"__none": F.col(label).isNull(), "__label": F.coalesce(label, F.lit(""))})
    placed = global_row_number(named, [order], "__k", by=["__none", "__label"])
    placed = placed.repartitionByRange(partitions, label, order).sortWithinPartitions(label, order)
    suffix = F.when(F.col("__k") > 1, F.concat(F.lit("_"), F.array_join(F.sequence(F.lit(2), F.col("__k").cast("int")), "_"))).otherwise("")
    return placed.withColumn(label, F.concat(label, suffix)).select(*rows.columns)


def ordered_by_threshold(rows: DataFrame, p: str, threshold: float, order: str = "row_id") -> DataFrame:
    """place: rows with p up to the threshold first, all others after them, each part in its order."""
    part = F.when(F.col(p) <= threshold, 0).otherwise(1)
    return global_row_number(rows.withColumn("__t", part), ["__t", order], "place").drop("__t")


def specific_terms(single: DataFrame, combined: DataFrame) -> DataFrame:
    """(term, gene) of terms that both have, for genes that only ``single`` has under the term."""
    terms = combined.select("term").distinct()
    return single.join(terms, "term", "left_semi").join(combined, ["term", "gene"], "left_anti").select("term", "gene").distinct()


def term_rows(terms: DataFrame, genes: str = "genes") -> DataFrame:
    """(term, gene) of comma lists, ids compared whole."""
    return terms.select("term", F.explode(F.split(genes, r"\s*,\s*")).alias("gene")).where("gene <> ''").distinct()


def one_hot(pairs: DataFrame, terms: list[str]) -> DataFrame:
    """(gene, a 0/1 column per term)."""
    return pairs.groupBy("gene").pivot("term", terms).agg(F.lit(1)).fillna(0, subset=terms)


def first_by_name(terms: DataFrame, order: str = "ord") -> DataFrame:
    """Terms "prefix:name" once per name, the first in order."""
    name = F.when(F.contains("term", F.lit(":")), F.regexp_extract("term", r"^[^:]*:(.*)$", 1)).otherwise(F.col("term"))
    x = terms.withColumn("name", name)
    return x.withColumn("__k", F.row_number().over(Window.partitionBy("name").orderBy(order))).where("__k = 1").drop("__k")


def leading_groups(groups: DataFrame, least: float = 1.0) -> DataFrame:
    """The first k enrichment groups, k being the number with a score of ``least`` or more, 1 at least."""
    one = groups.agg(F.greatest(F.lit(1), F.count_if(F.col("score") >= least)).alias("k"))
    ranked = global_row_number(groups, ["group_id"], "r")
    return ranked.join(F.broadcast(one)).where("r <= k").drop("r", "k")  # one row


def heatmap_cells(cells: DataFrame) -> DataFrame:
    """JSON objects of (source, s_num, s_max, feature, f_num, f_max, member, group_id, groups, value, group_text); values below a thousandth aren't in Java's form."""
    color = F.when(F.col("member") == 1, X.hsv_hex(X.hue(F.col("group_id"), F.col("groups")), X.saturation(F.col("value")))).otherwise("#ffffff")
    head = F.struct(
        F.lit(1).alias("flagF"), F.col("f_max").alias("fMax"), F.col("f_num").alias("fNum"), F.col("feature"), F.when(F.col("f_num") == 1, 1).otherwise(0).alias("flagS"),
        F.col("s_max").alias("sMax"), F.col("s_num").alias("sNum"), F.col("source"), color.alias("color"),
    )
    inner = lambda s: F.substring(F.to_json(s), F.lit(2), F.length(F.to_json(s)) - 2)
    x = F.col("value").cast("double")
    text = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.concat(F.lit('"'), x.cast("string"), F.lit('"'))).otherwise(shortest(x))
    value = F.when(x.isNotNull(), F.concat(F.lit('"value":'), text))
    group = F.when(F.col("group_text").isNotNull(), inner(F.struct(F.col("group_text").alias("group"))))
    return cells.withColumn("json", F.concat(F.lit("{"), F.concat_ws(",", inner(head), value, group), F.lit("}")))


def group_text(groups: DataFrame, n: int) -> DataFrame:
    """One row: "id:score:colour" of every group, joined by semicolons."""
    one = F.concat_ws(":", F.col("group_id").cast("string"), F.format_string("%.2f", F.col("score")), X.hsv_hex(X.hue(F.col("group_id"), F.lit(n)), F.lit(1.0)))
    return groups.select("group_id", one.alias("t")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_id", "t"))), lambda s: s["t"]), ";").alias("group_text"))


def web_table(rows: DataFrame, interactions: DataFrame | None = None) -> DataFrame:
    """Ranked rows of the organism of interest with its packed cell taken apart; rows without a cell are left out.

    ``interactions`` (``tables.interactions``) adds the picture of each row's interaction, its seed's positions and its energies, null where its locus has no report.
    """
    x = rows.where(F.coalesce("cell", F.lit("")) != "").withColumn("c", X.unpack_cell(F.col("cell")))
    x = global_row_number(x, [F.col("p").asc_nulls_last(), F.col("row_id")], "rank")
    x = x.select(
        "rank", "p", "fdr", F.col("c.locus").alias("locus_tag"), F.col("c.gene").alias("gene_name"), F.col("c.energy").alias("energy"),
        F.col("c.p").alias("single_p"), F.concat_ws(" -- ", "c.start1", "c.end1").alias("position_target"), F.concat_ws(" -- ", "c.start2", "c.end2").alias("position_query"),
        "annotation", F.col("c.gene_id").alias("gene_id"), *[c for c in ("homologs", "sampled") if c in rows.columns],
    )
    if interactions is None:
        return x
    drawn = picture(*[F.col(f"i.line{k}") for k in (1, 2, 3, 4)], F.col("x.position_target"), F.col("x.position_query"))
    joined = x.alias("x").join(interactions.alias("i"), F.lower("x.locus_tag") == F.col("i.locus"), "left")
    return joined.select("x.*", drawn.alias("interaction"), *[f"i.{k}" for k in ("seed_target", "seed_query", "hybrid_energy", "unfolding_target", "unfolding_query")])


def missing_counts(matrix: DataFrame, organisms: int, row: str = "cluster") -> DataFrame:
    return matrix.groupBy(row).agg((F.lit(organisms) - F.count("p")).alias("n_missing"))
