"""The operators' inputs, derived from the driver's tables by one SQL text for all engines."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Scored hits: a part is a gene and its cluster, a region an organism.
HITS = """SELECT concat('org', n_regionkey) AS organism, l_partkey AS cluster, concat('g', l_partkey) AS locus,
  -l_extendedprice / 1000 AS energy, CAST(l_quantity AS INT) AS start1, CAST(l_quantity AS INT) + 4 + l_linenumber AS end1,
  3 * l_linenumber AS start2, 3 * l_linenumber + 10 AS end2, l_orderkey AS ord, l_linenumber AS num
  FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey"""
#: Organism weights.
WEIGHTS = """SELECT concat('org', r_regionkey) AS organism, CAST(2 + r_regionkey AS DOUBLE) / 20 AS weight FROM {region}"""
#: Annotation of genes.
ANNOT = """SELECT concat('G', p_partkey) AS locus, CASE WHEN p_size % 3 = 0 THEN 'hypothetical protein' WHEN p_size % 7 = 0 THEN NULL ELSE p_name END AS product,
  CASE WHEN p_size % 2 = 0 THEN p_type END AS note, p_brand AS function FROM {part}"""
#: Terms and genes of two runs.
COMBINED = """SELECT DISTINCT event_type AS term, CAST(user_id AS STRING) AS gene FROM {events} WHERE day(ts) <= 3"""
SINGLE = """SELECT DISTINCT event_type AS term, CAST(user_id AS STRING) AS gene FROM {events} WHERE day(ts) >= 28"""
#: A tree: the world, its regions, their nations.
EDGES = """SELECT 'root' AS parent, r_name AS child, CAST(r_regionkey + 1 AS DOUBLE) / 4 AS length FROM {region}
  UNION ALL SELECT r_name, n_name, CAST(n_nationkey % 5 + 1 AS DOUBLE) / 8 FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""
#: Sequences over acgt; every other replicon is circular.
SEQS = """SELECT doc_id AS id, translate(lower(text), 'bdefhijklmnopqrsuvwxyz', 'acgtacgtacgtacgtacgtac') AS seq, n_chars, doc_id % 2 = 0 AS circular,
  CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END AS strand, 1 + (doc_id * 37) % n_chars AS pos FROM {documents} WHERE n_chars > 0"""
#: Members of clusters: orders of a customer stand for the genes of a cluster.
MEMBERS = """SELECT o_custkey % 200 AS cluster, concat('c', o_custkey) AS locus, min(o_orderkey) AS pos FROM {orders} GROUP BY o_custkey % 200, concat('c', o_custkey)"""


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    # workers of a local master find the package where the driver has it; a cluster gets it by --py-files
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def bind(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A binding as a DataFrame: only the tables that its text names are read."""
    return spark.sql(text, **load(spark, sf_dir, *[t for t in TABLES if "{" + t + "}" in text]))


def sql(text: str) -> str:
    """A binding's text over registered views."""
    return text.format(**{t: t for t in TABLES})
