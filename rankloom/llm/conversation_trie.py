"""Prefix trie of conversations by prefix doubling.

Each distinct turn gets a number, then each distinct pair of neighbouring blocks, so that after k rounds every aligned block of
2^k turns has a dense name that equal blocks share. A prefix is composed of the blocks of its length's binary digits, longest
first: in the round of digit k all prefixes whose last digit is k get the name of (prefix before, block). Each block and each prefix is
named once, in about twice log2(turns) rounds in all. Conversations with the same name at the same depth are members of one node.
Sums over subtrees double likewise: a node adds what the nodes 2^r deeper have gathered over the 2^r levels below them.

Rows hold numbers only (a turn is known by its sha256 until it has a name). Names are counted per task before they are numbered; they are joined
back by a plain equality whose named side has one row a key, which adaptive execution splits where a key is hot. Places within
conversations come from ranges, so one conversation can be of any length. A node's ends are gathered in stretches of
``STRETCH`` ids and hashed as a stream in order, with one stretch at a time in memory.

Defined results: turns are ordered by turn, nulls first, equal ones by the sha256 of role and text; repeated rows are turns of their own;
a null role or text is empty; rows with a null conv_id belong to no conversation and are left out; texts of any length count whole; an
empty table gives an empty result, without a root; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from .tables import Workspace

#: Conversations of a group of GROUP ids share the first turns of the group's first one, below MOST of them.
GROUP, MOST = 20, 4
#: Ids of one stretch of a node's ends, as a power of two.
STRETCH = 12
WORD = r"[^\x20\x09-\x0D]+"


def placed_turns(turns: DataFrame) -> DataFrame:
    """(c, i, d, words): each turn's place from 0 in its conversation, its digest and its number of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    d = F.unhex(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("c"), "turn", d.alias("d"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return global_row_number(rows, [F.col("turn").asc_nulls_first(), "d"], "i", by=["c"]).select("c", (F.col("i") - 1).alias("i"), "d", "words")


def rebuild(ws: Workspace, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of their group's first conversation, h from a hash of the id: the turns
    (c, i, d, words) and the conversations (c, n) with their numbers of turns, turnless ones too."""
    convs = placed.groupBy("c").agg(F.count("*").alias("n"))
    convs = ws.save(convs.withColumns({"base": F.col("c") - F.col("c") % GROUP, "h": F.crc32(F.col("c").cast("string")) % MOST}), "convs")
    bases = convs.select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0)))).select("c", "base", "n", "h", "k")
    convs = ws.save(convs, "convs_with_bases")
    heads = placed.where(F.col("i") < MOST - 1).select(F.col("c").alias("base"), "i", "d", "words")
    borrowed = convs.join(heads, "base").where("i < h").select("c", "i", "d", "words")
    rest = placed.join(convs.select("c", "h", "k"), "c").where("i >= h").select("c", (F.col("i") - F.col("h") + F.col("k")).alias("i"), "d", "words")
    return borrowed.unionByName(rest), convs.select("c", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _named(ws: Workspace, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with ``name`` for their keys: from 0, the same for equal keys, without gaps. Written."""
    distinct = ws.save(rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("part", F.spark_partition_id()), f"{name}_keys")
    numbered = numbered_keys(distinct, keys)
    out = ws.save(rows.join(numbered, keys).drop(*[k for k in keys if k != "depth"]), name)
    ws.drop(f"{name}_keys")
    return out


def numbered_keys(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers the rows of a written table with its parts: the place in the part after the rows of the parts before."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a part
    starts = distinct.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    return distinct.join(F.broadcast(starts), "part").select(*keys, (F.col("start") + own - 1).alias("name"))


def name_blocks(ws: Workspace, turns: DataFrame) -> list[DataFrame]:
    """Level k: (c, j, name) of the block of turns from j * 2^k to (j + 1) * 2^k, for each that is full."""
    levels = [_named(ws, turns.select("c", F.col("i").alias("j"), "d"), ["d"], "blocks0")]
    while True:
        odd = F.col("j") % 2 == 1
        pairs = levels[-1].groupBy("c", F.floor(F.col("j") / 2).alias("j")).agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b"))
        up = _named(ws, pairs.where("b IS NOT NULL"), ["a", "b"], f"blocks{len(levels)}")
        if up.isEmpty():
            return levels
        levels.append(up)


def name_prefixes(ws: Workspace, levels: list[DataFrame]) -> DataFrame:
    """(c, depth, name) of each prefix of each conversation; equal at the same depth if and only if the prefixes are."""
    done = None
    for k in reversed(range(len(levels))):
        size = 1 << k
        first = levels[k].where("j = 0").select("c", F.lit(size).cast("long").alias("depth"), "name")
        if done is not None:
            block = levels[k].where("j >= 2 AND j % 2 = 0").select("c", (F.col("j") * size).alias("before"), F.col("name").alias("b"))
            pairs = block.join(done.select("c", F.col("depth").alias("before"), F.col("name").alias("a")), ["c", "before"])
            first = first.unionByName(_named(ws, pairs.select("c", (F.col("before") + size).alias("depth"), "a", "b"), ["depth", "a", "b"], f"prefixes{k}").select("c", "depth", "name"))
        done = first if done is None else done.unionByName(first)
    return done


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) over (conv_id, depth, c): the ids of each node in order, comma-joined and hashed."""
    part = F.shiftright("c", STRETCH).alias("part")  # at most 2^STRETCH ids, in order of the ids as a whole
    text = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    parts = ends.groupBy("conv_id", "depth", part).agg(text.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for c, d, ids in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if (c, d) == node:
                    state.update(b",")
                else:
                    out += [] if node is None else [(*node, state.hexdigest())]
                    node, state = (c, d), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "ends_sha256"])
            out = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*node, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["conv_id", "depth", "ends_sha256"])

    dealt = parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part").select("conv_id", "depth", "ids")
    return dealt.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def build_trie(ws: Workspace, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    ``turns``: (c, i, d, words) with places from 0 without gaps; ``convs``: (c, n), all conversations and their numbers of turns.
    A node is known by its smallest member and its depth.
    """
    turns, convs = ws.save(turns, "turns"), ws.save(convs, "convs_rebuilt")
    levels = name_blocks(ws, turns)
    prefixes = ws.save(name_prefixes(ws, levels), "prefixes")
    groups = ws.save(prefixes.groupBy("depth", "name").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")), "groups")
    member = ws.save(prefixes.join(groups.select("depth", "name", "conv_id"), ["depth", "name"]).select("c", "depth", "conv_id"), "member")

    everyone = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"))
    above = member.select(F.col("c").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    last = turns.select(F.col("c").alias("conv_id"), (F.col("i") + 1).alias("depth"), "words")
    nodes = groups.select("conv_id", "depth", "n_convs").join(last, ["conv_id", "depth"]).join(above, ["conv_id", "depth"], "left")
    nodes = nodes.crossJoin(F.broadcast(everyone.select(F.col("conv_id").alias("top"))))  # one row
    nodes = ws.save(nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")).drop("top", "words"), "nodes")
    children = nodes.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    sums = ws.save(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")), "sums0")
    deepest, step = sums.agg(F.max("depth")).first()[0] or 0, 0
    while 1 << step < deepest:
        reach = 1 << step
        up = member.select(F.col("c").alias("conv_id"), (F.col("depth") + reach).alias("depth"), F.col("conv_id").alias("to"))
        given = sums.where(F.col("depth") > reach).select("conv_id", "depth", "n_leaves", "saved_tokens").join(up, ["conv_id", "depth"])
        given = given.groupBy(F.col("to").alias("conv_id"), (F.col("depth") - reach).alias("depth")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        more = sums.join(given, ["conv_id", "depth"], "left").withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("l", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("s", F.lit(0))})
        sums, step = ws.save(more.drop("l", "s"), f"sums{step + 1}"), step + 1
    # the root: what its children have gathered
    first = sums.where("depth = 1").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    root = everyone.where("n_convs > 0").crossJoin(first).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    columns = root.columns
    ends = convs.join(member.withColumnRenamed("depth", "n"), ["c", "n"]).select("conv_id", F.col("n").alias("depth"), "c")
    ends = ends.unionByName(convs.where("n = 0").crossJoin(F.broadcast(everyone.select("conv_id"))).select("conv_id", F.lit(0).cast("long").alias("depth"), "c"))
    out = sums.select(*columns).unionByName(root).join(_ends_digest(ends), ["conv_id", "depth"], "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    ws = Workspace(turns.sparkSession)
    return build_trie(ws, *rebuild(ws, ws.save(placed_turns(turns), "placed")))


def sql(crc) -> str:
    """Prefixes as lists; ``crc`` gives DuckDB's crc32 of a text."""
    return f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % {GROUP} AS base, {crc('CAST(c AS VARCHAR)')} % {MOST} AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT k.c, i, role, text FROM k JOIN t ON t.c = k.base AND i < h UNION ALL SELECT k.c, i + {MOST}, role, text FROM k JOIN t ON t.c = k.c AND i >= h),
l AS (SELECT k.c, list({{'role': role, 'text': text}} ORDER BY i) FILTER (WHERE i IS NOT NULL) AS l FROM k LEFT JOIN r ON r.c = k.c GROUP BY k.c),
p AS (SELECT c, l, unnest(range(coalesce(len(l), 0) + 1)) AS d FROM l),
n AS (SELECT d, CASE WHEN d > 0 THEN l[1:d] END AS pre, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = coalesce(len(l), 0)), '') AS ends FROM p GROUP BY ALL),
x AS (SELECT n.*, q.conv_id AS parent, (SELECT count(*) FROM n m WHERE m.d = n.d + 1 AND (n.d = 0 OR m.pre[1:n.d] = n.pre)) AS n_children,
  CASE WHEN n.d > 0 THEN (n.n_convs - 1) * len(regexp_extract_all(n.pre[n.d].text, '{WORD}')) ELSE 0 END AS saved FROM n LEFT JOIN n q ON q.d = n.d - 1 AND (n.d = 1 OR q.pre = n.pre[1:n.d - 1]))
SELECT x.conv_id, x.d::BIGINT AS depth, x.parent AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children, (count(*) FILTER (WHERE y.n_children = 0))::BIGINT AS n_leaves, sum(y.saved)::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN x y ON y.d >= x.d AND (x.d = 0 OR y.pre[1:x.d] = x.pre) GROUP BY x.conv_id, x.d, x.parent, x.n_convs, x.n_children, x.ends
"""
