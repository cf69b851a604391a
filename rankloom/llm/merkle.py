"""Merkle manifest of a dataset, with a proof of inclusion for every row.

Rows are leaves of one tree a source, in order of their id; every ``FAN`` consecutive nodes of a level have one parent, up
to the source's subroot. The subroots, in order of source, are the leaves of the tree that ends in the root.

Proofs are looked up by coordinates: a node explodes the coordinates (source, level, index) of the others of its run from its own
index and its level's size, joins them with the written table of the level's nodes and puts what it finds in order. A leaf's proof
is its own step followed by its parent's proof, so levels are composed downwards: each parent is joined with at most
``FAN`` children and no node is fetched by all leaves under the root, however large a source is. Folding the proof over a
digest gives the root again if and only if the row is the one that the manifest was made of.

Places within a source come from ranges of (source, id, leaf) with counts before each range: no task holds a source.

Defined results: a null source comes before all others and is a source of its own, apart from the empty one; null ids come before all
others; rows equal in id are ordered by leaf, rows equal in all fields are leaves of their own with equal digests; a null field
reads as ``-``, an empty one as ``0:``; texts of any length are hashed whole; a lone leaf is its source's subroot, a lone subroot the root; an
empty table gives empty results; columns that aren't among the fields are no part of a leaf and are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from . import common as C
from .tables import Workspace

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_STEPS = "array<struct<slot:int,others:string>>"


def leaf_digest(values: list[Column]) -> Column:
    """Lowercase hex sha256 of the values as text, each ``-`` if null, else its UTF-8 bytes' number, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


@dataclass
class Manifest:
    """``levels[k]``: (key, idx, n, h) of every source's nodes of height k, the first with id and claim; ``top``: likewise
    over the subroots, key being empty. n is the number of nodes of the level in that tree, h the digest as binary."""

    ws: Workspace
    levels: list[DataFrame]
    top: list[DataFrame]


def _grow(ws: Workspace, leaves: DataFrame, fan: int, name: str) -> list[DataFrame]:
    """The levels over written ``leaves`` until one node of each tree is left."""
    levels = [leaves]
    while True:
        many = levels[-1].where("n > 1").groupBy("key", F.floor(F.col("idx") / fan).alias("idx"))
        run = F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda x: F.lower(F.hex(x["h"])))  # at most fan nodes
        up = many.agg(F.ceil(F.max("n") / fan).alias("n"), F.unhex(F.sha2(F.array_join(run, ""), 256)).alias("h"))
        up = ws.save(up, f"{name}{len(levels)}")
        if up.isEmpty():
            return levels
        levels.append(up)


def build_manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, source: str = "source", id_col: str = "doc_id", claim: Column | None = None, fan: int = FAN) -> Manifest:
    """Trees over all rows. ``claim`` is the digest that is presented for a row later on (its own by default)."""
    ws = Workspace(docs.sparkSession)
    own = leaf_digest([C.col(f) for f in fields])
    key = F.coalesce(F.concat(F.lit("="), C.col(source).cast("string")), F.lit(""))
    rows = docs.select(key.alias("key"), C.col(id_col).alias("id"), F.unhex(own).alias("h"), F.unhex(claim).alias("claim") if claim is not None else F.lit(None).cast("binary").alias("claim"))
    placed = global_row_number(rows, [F.col("id").asc_nulls_first(), "h"], "__at", by=["key"], total="n")
    leaves = ws.save(placed.select("key", (F.col("__at") - 1).alias("idx"), "n", "h", "id", F.coalesce("claim", "h").alias("claim")), "leaves")
    levels = _grow(ws, leaves, fan, "nodes")
    roots = levels[0].where("n = 1").select("key", "h")
    for up in levels[1:]:
        roots = roots.unionByName(up.where("n = 1").select("key", "h"))
    sources = global_row_number(roots.withColumn("all", F.lit("")), ["key"], "__at", by=["all"], total="n")
    top = ws.save(sources.select(F.lit("").alias("key"), (F.col("__at") - 1).alias("idx"), "n", "h", F.col("key").alias("source_key")), "top")
    return Manifest(ws, levels, _grow(ws, top, fan, "top"))


def _steps(nodes: DataFrame, payload: list[str], fan: int) -> DataFrame:
    """(key, run, idx, step, payload): of every node of trees with several, the others of its run."""
    nodes = nodes.where("n > 1").withColumn("run", F.floor(F.col("idx") / fan))
    run = F.sequence(F.col("run") * fan, F.least(F.col("run") * fan + (fan - 1), F.col("n") - 1))
    wanted = nodes.select("key", "run", "idx", F.explode(F.array_remove(run, F.col("idx"))).alias("sib"))
    found = wanted.join(nodes.select("key", F.col("idx").alias("sib"), "h"), ["key", "sib"]).select("key", "run", "idx", F.struct("sib", "h").alias("s"), *[F.lit(None).cast(nodes.schema[p].dataType).alias(p) for p in payload])
    own = nodes.select("key", "run", "idx", F.lit(None).cast(found.schema["s"].dataType).alias("s"), *payload)
    both = found.unionByName(own).repartition("key", "run").groupBy("key", "run", "idx")
    others = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: F.lower(F.hex(x["h"]))), "")
    step = F.struct((F.col("idx") - F.col("run") * fan).cast("int").alias("slot"), F.col("others"))
    return both.agg(others.alias("others"), *[F.first(p, ignorenulls=True).alias(p) for p in payload]).select("key", "run", "idx", F.array(step).alias("step"), *payload)


def _paths(levels: list[DataFrame], above: DataFrame, payload: list[str], fan: int) -> DataFrame:
    """(key, idx, path, subroot, root, payload) of the leaves; ``above``: (key, path, subroot, root) of the last node of each tree."""
    paths = None
    for k in reversed(range(len(levels))):
        own = payload if k == 0 else []
        here = levels[k].where("n = 1").select("key", "idx", *own).join(above, "key").select("key", "idx", "path", "subroot", "root", *own)
        if paths is not None:
            parents = paths.select("key", F.col("idx").alias("run"), "path", "subroot", "root")
            below = _steps(levels[k], own, fan).join(parents, ["key", "run"])
            here = here.unionByName(below.select("key", "idx", F.concat("step", "path").alias("path"), "subroot", "root", *own))
        paths = here
    return paths


def prove(m: Manifest, *, fan: int = FAN) -> DataFrame:
    """(id, leaf, claim, subroot, root, path) of every row; a path's steps hold the row's slot in its run and the others' digests."""
    last = m.top[0].where("n = 1").select("h")
    for up in m.top[1:]:
        last = last.unionByName(up.where("n = 1").select("h"))
    end = last.select(F.lit("").alias("key"), F.array().cast(_NO_STEPS).alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("h").alias("root"))
    subroots = _paths(m.top, end, ["source_key", "h"], fan) if len(m.top) > 1 else m.top[0].join(end, "key")
    above = m.ws.save(subroots.select(F.col("source_key").alias("key"), "path", F.col("h").alias("subroot"), "root"), "above")  # used at every height
    rows = _paths(m.levels, above, ["id", "h", "claim"], fan)
    text = lambda c: F.lower(F.hex(c))
    return rows.select("id", text("h").alias("leaf"), text("claim").alias("claim"), text("subroot").alias("subroot"), text("root").alias("root"), "path")


def proof_digest(path: Column) -> Column:
    """sha256 of all digests of a proof in order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["others"]), ""), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    put = lambda acc, s: F.sha2(F.concat(F.substring(s["others"], F.lit(1), s["slot"] * 64), acc, F.substring(s["others"], s["slot"] * 64 + 1, F.length(s["others"]))), 256)
    return F.aggregate(path, digest, put)


def sql() -> str:
    """Levels and proofs by recursion."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    digest = lambda text: "sha256(" + " || ".join([*map(field, FIELDS[:-1]), field(text)]) + ")"
    lower = f"translate(text, '{C.UPPER}', '{C.LOWER}')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS key, {digest('text')} AS leaf, CASE WHEN {C.crc_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {digest(lower)} ELSE {digest('text')} END AS claim FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM d),
t AS (SELECT 0 AS level, key, idx, n, leaf AS h FROM l UNION ALL
  SELECT level + 1, key, idx // {FAN}, (max(n) + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY level, key, idx // {FAN}),
s AS (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, idx, n, h FROM s UNION ALL
  SELECT level + 1, idx // {FAN}, (max(n) + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // {FAN}),
nodes AS (SELECT level, key, idx // {FAN} AS run, idx, h FROM t WHERE n > 1 UNION ALL SELECT 1000 + level, '', idx // {FAN}, idx, h FROM u WHERE n > 1),
runs AS (SELECT level, key, run, list(h ORDER BY idx) AS hs FROM nodes GROUP BY ALL),
p AS (SELECT l.key, l.idx AS place, doc_id, leaf, claim, 0 AS level, l.idx, l.key AS k, claim AS folded, [] ::VARCHAR[] AS others FROM l UNION ALL
  SELECT p.key, p.place, p.doc_id, p.leaf, p.claim, CASE WHEN runs.hs IS NULL THEN 1000 ELSE p.level + 1 END, CASE WHEN runs.hs IS NULL THEN s.idx ELSE p.idx // {FAN} END, CASE WHEN runs.hs IS NULL THEN '' ELSE p.k END,
    CASE WHEN runs.hs IS NULL THEN p.folded ELSE sha256(array_to_string(runs.hs[:p.idx % {FAN}] || [p.folded] || runs.hs[p.idx % {FAN} + 2:], '')) END,
    CASE WHEN runs.hs IS NULL THEN p.others ELSE p.others || runs.hs[:p.idx % {FAN}] || runs.hs[p.idx % {FAN} + 2:] END
  FROM p LEFT JOIN runs ON p.level = runs.level AND p.k = runs.key AND p.idx // {FAN} = runs.run LEFT JOIN s ON s.key = p.key WHERE runs.hs IS NOT NULL OR p.level < 1000),
e AS (SELECT *, row_number() OVER (PARTITION BY key, place ORDER BY level DESC) AS r FROM p)
SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(array_to_string(others, '')) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM u WHERE n = 1) AS verified
FROM e JOIN s ON s.key = e.key WHERE r = 1
"""
