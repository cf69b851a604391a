"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation once per turn, each time with all turns so far. Every turn gets a hash of its place, role
and text; the running combination of these hashes identifies each prefix of a conversation. A conversation whose whole
hash is a prefix hash of a longer one is left out (anti-join), as is one equal to a conversation with a smaller id
(second anti-join). The rest is rendered.

Turns are processed in parts of ``PART`` turn numbers: counts and hashes are summed per part, carried over parts, and
only then run within a part, so a conversation of any length is spread over tasks, and rendered as one row a part.

A row is a part and not a conversation, since one conversation (that of null ids, for one) can hold more than a task can: the
grain is (conv_id, part) at any length, and the parts of a conversation in order are its text.

Defined results: turns are ordered by turn, role, text, nulls first; equal rows count once; a null role reads as
"unknown", a null text as empty, in comparisons as in the rendered text; a null turn is in part -1; rows with a null conv_id are one conversation; the marker's opening in a text is broken
by a space so that no text forges a turn; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, part, turn, role, text, place, h1, h2): the place from 1 and the hashes of the prefix that ends there."""
    t = turns.select("conv_id", "turn", "role", "text").distinct().withColumn("part", F.floor(F.col("turn") / PART))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    sizes = t.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy(F.col("part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    here = lambda df: df.join(start, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("part").eqNullSafe(F.col("p"))).drop("c", "p")
    t = here(t).withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))).drop("start")
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    t = t.withColumns({"e1": F.xxhash64("place", role, text), "e2": F.xxhash64(F.lit(3), text, role, "place")})
    sums = t.groupBy("conv_id", "part").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    carry = sums.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(f"c{x}") for x in ("x1", "x2")])
    t = t.join(carry, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("part").eqNullSafe(F.col("p"))).drop("c", "p")
    run = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("conv_id", "part", "turn", "role", "text", "place", *[F.col(f"cx{k}").bitwiseXOR(F.bit_xor(f"e{k}").over(run)).alias(f"h{k}") for k in (1, 2)])


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of another; of equal ones the smallest id."""
    p = prefixes(turns)
    whole = p.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    p = p.join(whole.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    ends = p.where("place = n_turns").select("conv_id", "n_turns", "h1", "h2")
    longer = p.where("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    alone = ends.join(longer, ["n_turns", "h1", "h2"], "left_anti")
    first = alone.groupBy("n_turns", "h1", "h2").agg(F.min(F.struct("conv_id")).alias("one"))
    again = alone.join(first, ["n_turns", "h1", "h2"]).where(~F.struct("conv_id").eqNullSafe(F.col("one"))).select(F.col("conv_id").alias("c"))
    return alone.join(again, F.col("conv_id").eqNullSafe(F.col("c")), "left_anti").select("conv_id", "n_turns")


def render_conversations(turns: DataFrame) -> DataFrame:
    """One row for each part of each maximal conversation: conv_id, part, n_turns (of the conversation), rendered."""
    keep = maximal(turns)
    t = turns.select("conv_id", "turn", "role", "text").distinct().withColumn("part", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-1)).cast("long"))
    t = t.join(keep.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    parts = t.groupBy("conv_id", "part", "n_turns").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    safe = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("<|"), F.lit("< |"))
    one = lambda s: F.concat(F.lit(OPEN), safe(F.coalesce(s["role"], F.lit("unknown"))), F.lit("\n"), safe(s["text"]), F.lit(CLOSE + "\n"))
    return parts.select("conv_id", "part", F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.transform("ts", one), "").alias("rendered"))


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list(coalesce(role, 'unknown') || chr(31) || coalesce(text, '') ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l FROM t GROUP BY conv_id),
p AS (SELECT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
m AS (SELECT c.l, CASE WHEN count(*) > count(conv_id) THEN NULL ELSE min(conv_id) END AS conv_id FROM c ANTI JOIN p ON c.l = p.l GROUP BY c.l)
SELECT t.conv_id, coalesce(t.turn // {PART}, -1) AS part, any_value(len(m.l))::BIGINT AS n_turns,
  md5(string_agg('{OPEN}' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '{CLOSE}' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS rendered_md5
FROM t JOIN m ON t.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY t.conv_id, coalesce(t.turn // {PART}, -1)
"""
