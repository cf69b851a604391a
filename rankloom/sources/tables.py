"""Delimited tables and line reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number, segmented
from .workspace import saved

_STR, _INT, _DBL = "string", "int", "double"
#: Columns of the interaction table.
HIT_COLUMNS = {
    **dict.fromkeys(["id1", "id2", "seq1", "seq2", "subseq1", "subseq2", "subseqDP", "subseqDB"], _STR),
    **dict.fromkeys(["start1", "end1", "start2", "end2"], _INT),
    **dict.fromkeys(["hybridDP", "hybridDB"], _STR),
    **dict.fromkeys(["E", "ED1", "ED2", "Pu1", "Pu2", "E_init", "E_loops", "E_dangleL", "E_dangleR", "E_endL", "E_endR"], _DBL),
    **dict.fromkeys(["seedStart1", "seedEnd1", "seedStart2", "seedEnd2"], _STR),
    **dict.fromkeys(["seedE", "seedED1", "seedED2", "seedPu1", "seedPu2", "E_norm"], _DBL),
}
BLAST_COLUMNS = "qid string, sid string, ident double, alilen int, mismatch int, gap int, qstart int, qend int, sstart int, send int, eval double, score double"


def hit_schema(p_value: bool = False) -> str:
    cols = [f"`{k}` {v}" for k, v in HIT_COLUMNS.items()]
    return ", ".join([*cols, "`p-value` double"] if p_value else cols)


def read_hits(spark: SparkSession, path: str, p_value: bool = False) -> DataFrame:
    """Hit tables with a file column; no inference, so only the columns asked for are parsed."""
    df = spark.read.schema(hit_schema(p_value)).option("sep", ";").option("header", True).csv(path)
    return df.withColumn("file", F.col("_metadata.file_name"))


def write_hits(df: DataFrame, path: str) -> None:
    df.write.option("sep", ";").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, organisms: list[str]) -> DataFrame:
    """Wide result tables: fdr, p-value, a packed cell per organism, annotation."""
    cols = ["`fdr` double", "`p-value` double", *[f"`{o}` string" for o in organisms], "`Annotation` string", "`Additional homologs` string", "`Amount sampled` int"]
    return spark.read.schema(", ".join(cols)).option("header", True).option("quote", "").csv(path)


def long_results(wide: DataFrame, organisms: list[str], row: str = "row_id") -> DataFrame:
    """(row, organism, cell) of the cells that are there."""
    pairs = F.array(*[F.struct(F.lit(o).alias("organism"), F.col(f"`{o}`").alias("cell")) for o in organisms])
    return wide.select(row, F.explode(pairs).alias("x")).select(row, "x.organism", "x.cell").where(F.coalesce("cell", F.lit("")) != "")


def write_modes(df: DataFrame, path: str) -> None:
    """A folder of Parquet per mode."""
    df.write.partitionBy("mode").parquet(path)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, column, code, locus, copy) from ragged lines of tab-separated cells with space-separated members."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return parse_clusters(lines)


def parse_clusters(lines: DataFrame) -> DataFrame:
    cells = lines.select(F.split("value", "\t").alias("x")).select(F.get("x", F.lit(0)).alias("cluster"), F.posexplode(F.slice("x", 2, F.size("x"))).alias("column", "cell"))
    member = cells.select("cluster", "column", F.posexplode(F.split(F.trim("cell"), " +")).alias("pos", "m")).where("m <> ''")
    part = lambda k: F.regexp_extract("m", r"^([^:]+):([^(]+)(?:\((\d+)\))?$", k)
    return member.select("cluster", "column", "pos", part(1).alias("code"), F.lower(part(2)).alias("locus"), part(3).try_cast("int").alias("copy"))


def read_organism_map(spark: SparkSession, path: str) -> DataFrame:
    """(replicon, code, replicons): every replicon id with its organism's whole list."""
    rows = spark.read.option("sep", "\t").schema("code string, ids string").csv(path).where(~F.col("code").startswith("#"))
    return rows.withColumn("replicons", F.split(F.trim("ids"), " +")).select(F.explode("replicons").alias("replicon"), "code", "replicons")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value), lines from 0 in each file. Files are read in splits like any other: a line's place is that in its split
    after the lines of the splits before, which are counted."""
    split = F.col("_metadata.file_block_start").alias("split")
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), split, F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r", "").alias("value"))
    lines = saved(lines)  # a split's lines have consecutive numbers
    splits = lines.groupBy("path", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # over a row per split
    start = splits.select("path", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    return lines.join(start, ["path", "split"]).select("file", (F.col("start") + F.col("at")).cast("int").alias("line_no"), "value")


def parse_distances(lines: DataFrame, skip: int = 8) -> DataFrame:
    """(file, a, b, d) of an upper triangle per file, whose lines end in "name index"."""
    body = lines.where((F.col("line_no") >= skip) & (F.trim("value") != ""))
    f = body.withColumn("x", F.split("value", "\t"))
    f = global_row_number(f.select("file", "line_no", "x"), ["line_no"], "i", by=["file"])
    named = f.select("file", "i", F.regexp_extract(F.element_at("x", -1), r"^\s*(\S+)\s+\d+\s*$", 1).alias("a"), F.posexplode("x").alias("col", "v"))
    cells = named.select("file", "i", "a", "col", F.trim("v").try_cast("double").alias("d")).where("d is not null")
    names = cells.select("file", F.col("i").alias("j"), F.col("a").alias("b")).distinct()
    low = cells.groupBy("file").agg(F.min("col").alias("low"))
    placed = cells.join(low, "file").withColumn("j", F.col("col") - F.col("low") + 1)
    return placed.join(names, ["file", "j"]).where("i <= j").select("file", "a", "b", "d")


def parse_newick(text: str) -> list[tuple[str, str, float]]:
    """Edges (parent, child, length); unnamed inner nodes are numbered. Negative lengths lose their sign."""
    import re

    edges, stack, n, last = [], [], 0, None
    for tok in re.findall(r"\(|\)|,|;|[^(),;]+", re.sub(r"\s", "", text)):
        if tok == "(":
            n += 1
            stack.append(f"#{n}")
            last = None
        elif tok == ")":
            last = stack.pop()
        elif tok not in ",;":
            name, _, length = tok.partition(":")
            node = last or name
            if stack:
                edges.append((stack[-1], node, abs(float(length or 0))))
            last = None
        elif last is not None:
            last = None
    return edges


def parse_neighbours(lines: DataFrame) -> DataFrame:
    """(parent, child, length) from a report's table of From To Length Height; zero lengths become 0.00001."""
    row = r"^\s*(\S+)\s+(\S+)\s+-?(\d+\.\d+)(?:\s+-?\d+\.\d+)?\s*$"
    found = lines.where(F.col("value").rlike(row))
    length = F.regexp_extract("value", row, 3).cast("double")
    return found.select(F.regexp_extract("value", row, 1).alias("parent"), F.regexp_extract("value", row, 2).alias("child"), F.greatest(length, F.lit(1e-5)).alias("length"))


def parse_full_matrix(lines: DataFrame) -> DataFrame:
    """(file, a, b, d) of lines "name d d d", the columns in the order of the file's lines."""
    body = lines.where(F.col("value").rlike(r"^\S+\s+[-\d.]")).withColumn("x", F.split(F.trim("value"), r"\s+"))
    named = global_row_number(body.select("file", "line_no", "x"), ["line_no"], "i", by=["file"]).select("file", "i", F.get("x", F.lit(0)).alias("a"), "x")
    cells = named.select("file", "a", F.posexplode(F.slice("x", 2, F.size("x"))).alias("j", "d"))
    return cells.join(named.select("file", (F.col("i") - 1).alias("j"), F.col("a").alias("b")), ["file", "j"]).select("file", "a", "b", F.col("d").cast("double").alias("d"))


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLAST_COLUMNS).option("sep", "\t").option("comment", "#").csv(path)


def parse_key_values(lines: DataFrame) -> DataFrame:
    """(file, line_no, key, value) of key=value lines, quotes removed."""
    kv = lines.where(F.col("value").rlike(r"^\s*\w+\s*="))
    return kv.select("file", "line_no", F.trim(F.regexp_extract("value", r"^\s*(\w+)\s*=", 1)).alias("key"), F.trim(F.regexp_replace(F.regexp_replace("value", r"^\s*\w+\s*=", ""), '"', "")).alias("value"))


def parse_enrichment(kv: DataFrame) -> DataFrame:
    """One row per term of each file's key=value report: a score line opens a group, an afdr line a term, the keys until the next belong to it."""
    of = lambda key: (F.col("key") == key).cast("int")
    x = segmented(kv, ["file"], ["line_no"], group_id=("sum", of("score")), term_no=("sum", of("afdr")), score=("last", F.when(F.col("key") == "score", F.col("value").try_cast("double"))))
    keys = ["afdr", "categoryName", "termName", "listHits", "percent", "ease", "geneIds", "listTotals", "popHits", "popTotals", "foldEnrichment", "bonferroni", "benjamini"]
    terms = x.where("key <> 'score' and term_no > 0")
    return terms.groupBy("file", "term_no").agg(F.min("group_id").alias("group_id"), F.min("score").alias("score"), *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def _interaction_lines(lines: DataFrame, first: int, last: int) -> DataFrame:
    head = F.regexp_extract("value", r"^>?\s*target:?\s+(\S+)", 1)
    x = segmented(lines, ["file"], ["line_no"], locus=("last", F.when(head != "", head)), start=("last", F.when(head != "", F.col("line_no"))))
    return x.withColumn("offset", F.col("line_no") - F.col("start")).where(F.col("offset").between(first, last))


def parse_interaction_blocks(lines: DataFrame, first: int = 5, last: int = 18) -> DataFrame:
    """(locus, offset, value): the lines from ``first`` to ``last`` after a line that names a locus."""
    return _interaction_lines(lines, first, last).select("locus", "offset", "value")


#: Lines of an interaction's report after the one that names its locus.
STRANDS = {"line1": 5, "line2": 6, "line3": 7, "line4": 8}
PROPERTIES = {"seed_target": 11, "seed_query": 14, "unfolding_target": 16, "unfolding_query": 17, "hybrid_energy": 18}


def interactions(lines: DataFrame) -> DataFrame:
    """One row per locus (in lower case): the four lines of its picture, seed positions and energies, from numbered report lines.

    Of a property's line counts what follows its last ": ". A locus that is reported more than once has its first report, by file and line; what a
    report ends before is null. No row gathers more than the lines of one report.
    """
    at = STRANDS | PROPERTIES
    x = _interaction_lines(lines, min(at.values()), max(at.values())).withColumn("locus", F.lower("locus"))
    text = lambda k: F.regexp_replace("value", "^.*: ", "") if k in PROPERTIES else F.col("value")
    one = x.groupBy("locus", "file", "start").agg(*[F.max(F.when(F.col("offset") == n, text(k))).alias(k) for k, n in at.items()])
    first = one.groupBy("locus").agg(F.min_by(F.struct(*at), F.struct("file", "start")).alias("r"))
    return first.select("locus", "r.*")


def write_edge_list(df: DataFrame, path: str) -> None:
    """Lines "a b distance score"."""
    df.select(F.concat_ws(" ", "a", "b", F.col("distance").cast("string"), F.col("score").cast("string")).alias("value")).write.text(path)


def write_lines(df: DataFrame, path: str, header: str | None = None) -> None:
    """Text lines, the header in a file of its own that sorts first."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.text(f"{path}/body")
    if header is not None:
        df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.text(f"{path}/a-header")


def write_ordered(df: DataFrame, path: str, order: list[str], header: str | None = None) -> None:
    """Text lines of the first column in an order, below a header. Files by name hold one range after the other, so put together by name they are one ordered
    file with the header as its first line; the ranges are written by as many tasks as they fill."""
    lines = df.select(F.lit(1).alias("__body"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(order)], F.coalesce(F.col(df.columns[0]).cast("string"), F.lit("")).alias("value"))
    if header is not None:
        top = df.sparkSession.createDataFrame([(0, header)], "__body int, value string")
        lines = lines.unionByName(top, allowMissingColumns=True)
    lines.orderBy("__body", *[f"__{i}" for i in range(len(order))]).select("value").write.text(path)


def write_results(rows: DataFrame, path: str, organisms: list[str]) -> None:
    """Wide result file of rows (fdr, p, a cell per organism, annotation, homologs, sampled)."""
    cols = [F.col("fdr"), F.col("p").alias("p-value"), *[F.col(f"`{o}`") for o in organisms], F.col("annotation").alias("Annotation"), F.col("homologs").alias("Additional homologs"), F.col("sampled").alias("Amount sampled")]
    rows.select(*cols).write.option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_genes(genes: DataFrame, path: str) -> None:
    """Lengths and titles of (id, seq, title), in two files."""
    genes.select("id", F.length("seq").alias("n")).write.option("sep", "\t").csv(f"{path}/lengths")
    genes.select("id", "title").write.option("sep", "\t").csv(f"{path}/titles")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    lengths = spark.read.schema("id string, n long").option("sep", "\t").csv(f"{path}/lengths")
    return lengths.join(spark.read.schema("id string, title string").option("sep", "\t").csv(f"{path}/titles"), "id", "left")


#: Columns of a web result: name, type, and the column of ``annotate.web_table`` it comes from.
WEB = [
    ("Rank", "long", "rank"), ("p-value", "double", "p"), ("fdr", "double", "fdr"), ("Locus Tag", "string", "locus_tag"), ("Gene Name", "string", "gene_name"),
    ("Energy kcal/mol", "double", "energy"), ("single p-value", "double", "single_p"), ("Position mRNA", "string", "position_target"), ("Position ncRNA", "string", "position_query"),
    ("Annotation", "string", "annotation"), ("Additional homologs", "string", "homologs"), ("Entrez GeneID", "string", "gene_id"), ("Amount sampled", "int", "sampled"),
]


#: What a web result holds besides where the interactions are known; it stands before the last column.
WEB_INTERACTION = [
    ("Interaction", "string", "interaction"), ("Position Seed - mRNA", "string", "seed_target"), ("Position Seed - ncRNA", "string", "seed_query"),
    ("Hybridization Energy kcal/mol", "string", "hybrid_energy"), ("Unfolding Energy - mRNA kcal/mol", "string", "unfolding_target"), ("Unfolding Energy - ncRNA kcal/mol", "string", "unfolding_query"),
]


def _web(interactions: bool) -> list[tuple[str, str, str]]:
    return [*WEB[:-1], *WEB_INTERACTION, WEB[-1]] if interactions else WEB


def write_web(rows: DataFrame, path: str) -> str:
    """A tab-separated file of a web result's 13 columns, 19 where ``rows`` have interactions; nulls are empty."""
    rows.select(*[F.col(c).alias(n) for n, _, c in _web("interaction" in rows.columns)]).write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)
    return path


def read_web(spark: SparkSession, path: str, interactions: bool = False) -> DataFrame:
    df = spark.read.schema(", ".join(f"`{n}` {t}" for n, t, _ in _web(interactions))).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return df.fillna("", ["Additional homologs", *[n for n, _, _ in WEB_INTERACTION if interactions]])


#: Columns of the enrichment table, and the report's keys they come from.
ENRICHMENT = {
    "Category": "categoryName", "Term": "termName", "Count": "listHits", "%": "percent", "Pvalue": "ease", "Genes": "geneIds", "List Total": "listTotals", "Pop Hits": "popHits",
    "Pop Total": "popTotals", "Fold Enrichment": "foldEnrichment", "Bonferroni": "bonferroni", "Benjamini": "benjamini", "FDR": "afdr",
}


def write_enrichment(rows: DataFrame, path: str) -> None:
    """A tab-separated table of terms with their group and its score."""
    rows.select("group_id", "score", *[F.col(k).alias(n) for n, k in ENRICHMENT.items()]).write.option("sep", "\t").option("header", True).csv(path)


def read_enrichment(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(["group_id int", "score double", *[f"`{n}` string" for n in ENRICHMENT]])).option("sep", "\t").option("header", True).csv(path)


AUXILIARY = "locus_tag string, start1 int, end1 int, start2 int, end2 int, energy double, p double, gene_name string, gene_id long, annotation string, functional_terms string"


def write_auxiliary(rows: DataFrame, path: str) -> None:
    """The auxiliary table: hits of one organism with gene, annotation and functional terms."""
    names = [c.split()[0] for c in AUXILIARY.split(", ")]
    rows.withColumn("locus_tag", F.col("locus")).select(*names).write.option("sep", "\t").option("header", True).csv(path)


def read_auxiliary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUXILIARY).option("sep", "\t").option("header", True).csv(path)


def _evolution(organisms: list[str]) -> list[str]:
    each = [f"`{n}_{o}` {t}" for n, t in (("rank", "int"), ("p", "double"), ("single", "double")) for o in organisms]
    return ["`place` long", "`cluster` long", "`rank_p` double", "`rank_share` double", "`p_share` double", "`single_share` double", *each, "`initial_sorting` long"]


def write_evolution(rows: DataFrame, path: str, organisms: list[str]) -> None:
    """The evolution table, tab-separated, in the order of its places: files by name hold ranges of them."""
    rows.select(*[c.split()[0] for c in _evolution(organisms)]).orderBy("place").write.option("sep", "\t").option("header", True).csv(path)


def read_evolution(spark: SparkSession, path: str, organisms: list[str]) -> DataFrame:
    return spark.read.schema(", ".join(_evolution(organisms))).option("sep", "\t").option("header", True).csv(path)


def write_membership(genes: DataFrame, pairs: DataFrame, groups: DataFrame, path: str, width: int = 256) -> None:
    """Genes (gene, p) by terms (term, group_id, score) with 1 where ``pairs`` has (gene, term), tab-separated, a folder for each ``width`` terms.

    Terms stand in the order of groups and names, genes in that of p. Three meta rows lead each block: the terms' scores, their groups, their names. No
    list of terms is in the plan or on the driver: a row's cells come from the sorted numbers of its terms, of which a block has ``width`` at most.
    """
    terms = global_row_number(groups.select("term", "group_id", "score"), ["group_id", "term"], "at").select("term", "group_id", "score", F.expr(f"(at - 1) div {width}").alias("block"), F.expr(f"cast((at - 1) % {width} as int)").alias("col"))
    terms = saved(terms)
    each = F.array_sort(F.collect_list(F.struct("col", "term", "group_id", "score")))
    blocks = terms.groupBy("block").agg(each.alias("ts"))
    lead = [("#score", "score"), ("#group", "group_id"), ("#term", "term")]
    line = lambda mark, c: F.concat_ws("\t", F.lit(mark), F.lit(""), F.array_join(F.transform("ts", lambda s: F.coalesce(s[c].cast("string"), F.lit(""))), "\t"))
    meta = blocks.select("block", F.posexplode(F.array(*[line(m, c) for m, c in lead])).alias("kind", "value")).select("block", "kind", F.lit(None).cast("double").alias("p"), F.lit("").alias("gene"), "value")
    sizes = terms.groupBy("block").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("block", "n"))).alias("sizes"))  # one row, an entry a block
    rows = genes.select("gene", "p").join(F.broadcast(sizes)).select("gene", "p", F.explode("sizes").alias("block", "n"))
    ones = pairs.select("gene", "term").join(terms, "term").groupBy("gene", "block").agg(F.collect_set("col").alias("cols"))
    rows = rows.join(ones, ["gene", "block"], "left").withColumn("cols", F.coalesce("cols", F.array().cast("array<int>")))
    cells = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.when(F.array_contains("cols", i), "1").otherwise("0"))
    body = rows.select("block", F.lit(3).alias("kind"), "p", "gene", F.concat_ws("\t", "gene", F.coalesce(F.col("p").cast("string"), F.lit("")), F.array_join(cells, "\t")).alias("value"))
    out = meta.unionByName(body).orderBy("block", "kind", F.col("p").asc_nulls_last(), "gene")
    out.select("block", "value").write.partitionBy("block").text(path)


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """(gene, p, term, group_id, score, member) of every cell."""
    lines = spark.read.text(path).select("block", F.split("value", "\t").alias("x"))
    head = lambda mark: lines.where(F.get("x", F.lit(0)) == mark)
    cols = lambda mark, name: head(mark).select("block", F.posexplode(F.slice("x", 3, F.size("x"))).alias("col", name))
    terms = cols("#term", "term").join(cols("#group", "group_id"), ["block", "col"]).join(cols("#score", "score"), ["block", "col"])
    body = lines.where(~F.get("x", F.lit(0)).isin("#term", "#group", "#score"))
    cells = body.select("block", F.get("x", F.lit(0)).alias("gene"), F.get("x", F.lit(1)).try_cast("double").alias("p"), F.posexplode(F.slice("x", 3, F.size("x"))).alias("col", "cell"))
    joined = cells.join(terms, ["block", "col"])
    return joined.select("gene", "p", "term", F.col("group_id").try_cast("int").alias("group_id"), F.col("score").try_cast("double").alias("score"), F.col("cell").cast("int").alias("member"))
