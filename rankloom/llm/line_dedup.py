"""Line deduplication over overlapping windows of three lines, in DataFrame functions only.

Lines without a visible character are no part of a window; a window spans from its first to its third line. Every
window is hashed (two 64-bit hashes), hashes found more than once are joined back to their windows, and every
occurrence but the first - by id, then position - is removed. Overlapping removals merge, as lines and not windows are
taken out. Windows are counted with map-side sums before the shuffle, so a window found in a third of all rows arrives
as one row per task; the join back splits such a key where adaptive execution finds it skewed.

Defined results: a null text stays null and has no lines; a text of fewer than three visible lines has no window and
stays as it is; rows equal in id and text count as one document and keep the same lines; a null id sorts first; an empty table gives an
empty result; other columns pass through, the names n_lines and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tables import Workspace

WINDOW = 3
VISIBLE = "[^ \\t\\r\\f\\x0B]"


def _keys(id_col: str, text_col: str):
    return [F.xxhash64(id_col, text_col).alias("__k1"), F.xxhash64(F.lit(1), text_col, id_col).alias("__k2")]


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, first, last, h1, h2) of each window: its document, line span and hashes."""
    lines = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), *_keys(id_col, text_col), F.split(text_col, "\n", -1).alias("lines")
    )
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    seen = lines.select("id", "__k1", "__k2", F.filter(numbered, lambda s: s["x"].rlike(VISIBLE)).alias("v"))

    def window(k):
        part = [F.element_at("v", k + 1 + j) for j in range(WINDOW)]
        return F.struct(
            part[0]["i"].alias("first"), part[-1]["i"].alias("last"), F.xxhash64(*[s["x"] for s in part]).alias("h1"),
            F.xxhash64(F.lit(7), *[s["x"] for s in part[::-1]]).alias("h2"),
        )

    starts = F.sequence(F.lit(0), F.size("v") - WINDOW)
    wins = seen.where(F.size("v") >= WINDOW).select("id", "__k1", "__k2", F.explode(F.transform(starts, window)).alias("w"))
    return wins.select("id", "__k1", "__k2", "w.first", "w.last", "w.h1", "w.h2")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, and n_lines and n_removed."""
    ws = Workspace(docs.sparkSession)
    found = ws.save(occurrences(docs, id_col, text_col), "windows")
    repeated = (
        found.groupBy("h1", "h2").agg(F.min(F.struct("id", "__k1", "__k2", "first")).alias("one"), F.count("*").alias("n"))
        .where("n > 1").select("h1", "h2", "one")
    )
    later = found.join(repeated, ["h1", "h2"]).where(~F.struct("id", "__k1", "__k2", "first").eqNullSafe(F.col("one")))
    covered = later.groupBy("__k1", "__k2").agg(F.collect_set(F.struct("first", "last")).alias("__gone"))

    others = [C.col(c) for c in C.kept(docs.columns, [text_col, "n_lines", "n_removed"])]
    df = docs.select(*others, text_col, *_keys(id_col, text_col)).join(covered, ["__k1", "__k2"], "left")
    # a line is told from its equals by its number, so the difference of arrays works line by line
    df = df.withColumn("__lines", F.split(text_col, "\n", -1))
    numbered = F.transform("__lines", lambda x, i: F.concat(i.cast("string"), F.lit(":"), x))
    gone = F.array_distinct(F.flatten(F.transform("__gone", lambda c: F.sequence(c["first"], c["last"]))))
    gone = F.transform(gone, lambda i: F.concat(i.cast("string"), F.lit(":"), F.element_at("__lines", i + 1)))
    df = df.withColumn("__kept", F.when(F.col("__gone").isNotNull(), F.array_except(numbered, gone)))
    text = F.array_join(F.transform("__kept", lambda x: x.substr(F.instr(x, ":") + 1, F.length(x))), "\n")
    return df.select(
        *others, F.when(F.col("__kept").isNull(), F.col(text_col)).otherwise(text).alias(text_col),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.when(F.col("__kept").isNull(), 0).otherwise(F.size("__lines") - F.size("__kept")).cast("long").alias("n_removed"),
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL
), v AS (
  SELECT * FROM l WHERE regexp_matches(line, '[^ \t\r\f\x0B]')
), w AS (
  SELECT doc_id, i AS first, lead(i, 2) OVER x AS last,
         line || chr(10) || lead(line, 1) OVER x || chr(10) || lead(line, 2) OVER x AS win
  FROM v WINDOW x AS (PARTITION BY doc_id ORDER BY i)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, first) AS rn FROM w WHERE last IS NOT NULL
), g AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM o WHERE rn > 1),
k AS (
  SELECT l.doc_id, count(*) AS n, count(g.i) AS gone,
         string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_lines, coalesce(k.gone, 0)::BIGINT AS n_removed,
       md5(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END) AS text_md5
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
