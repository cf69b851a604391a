"""License scans by an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A line is what stands between line feeds, a paragraph a run of lines with words (comment leaders and rules are no words). A
block is a line and those after it in its paragraph until they hold as many words as the longest template, so a notice that
is wrapped at any width lies whole in the block of the line it begins on. A template is a license notice; both are sets of
words. A block matches a template when it
holds at least ``THRESHOLD`` of the template's words. Template words are put in one global order, by the number of
blocks that hold them. Of a template with s words that needs a of them, the first s-a+1 in this order must meet the
block (prefix filter); a block with fewer than a template words can't match (length filter); a common word at place i of
the template and j of the block leaves room for 1 + min(s-i-1, b-j-1) common words, which must be a or more (positional
filter). What is left is verified by intersection, and by the words that tell relatives apart: a block must hold all of a template's
``DECIDING`` words (one word of fifteen tells the Affero license from the plain one, which a threshold alone can't), and none of its ``BARRED`` ones. Templates are a fixed list, so their index is broadcast; blocks are
joined by word. Only documents that hold enough words of some template are cut into blocks (no block of others can match),
and of these only lines with a template word begin one (the next block holds what another would).

Texts are normalised and cut into words once; what is needed of them (counts, places, blocks) is written to the shared folder.
Besides, places where a base phrase's words stand consecutively are found in the normalised text.

Defined results: a null or empty text has no words, places or labels and score 0; any length is scanned whole; repeated
rows get equal results; an empty table gives an empty result; an input column with the name of a result is replaced.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tables import Workspace

THRESHOLD = 0.8
#: Phrases and labels of the base scan.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: License notices as their licenses word them, lower-cased, without punctuation.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
TEMPLATES += [("bsd", "released under the bsd license"), ("isc", "released under the isc license")]
#: Words of which a template that holds them can spare none, and words that make a notice one of another license.
DECIDING = set("affero lesser gnu apache mit bsd isc eclipse mozilla creative commons attribution cc nc sa unencumbered fee charge person redistribution binary redistributions disclaimer substantial compliance except obtain".split())
BARRED = {"gpl": ["affero", "lesser"], "agpl": ["lesser"], "lgpl": ["affero"], "cc-by": ["noncommercial", "sharealike", "noderivatives", "noderivs", "nc", "sa", "nd"], "cc-by-nc": ["sa", "nd"], "cc-by-sa": ["nc"]}
#: ASCII but letters, digits and the line feed, in a text without A-Z.
_GAP = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def _rules(label: str, words: list[str]) -> tuple[list[str], list[str]]:
    """The words a block must hold, and those it must not."""
    return [w for w in words if w in DECIDING], BARRED.get(label, [])


def _templates() -> list[tuple[int, str, list[str], int]]:
    """(number, label, distinct words, words needed)."""
    sets = [(label, list(dict.fromkeys(text.split()))) for label, text in TEMPLATES]
    return [(k, label, words, ceil(round(THRESHOLD * len(words), 9))) for k, (label, words) in enumerate(sets)]


#: Words of the longest template.
TAIL = max(len(text.split()) for _, text in TEMPLATES)


def _blocks(lines: str) -> Column:
    """Template words of the block that begins on each line, from (words, template words) of the lines."""
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("open"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("v"))

    def more(a, s):
        first, inside = a["at"] == 0, a["open"] & (s["n"] > 0) & (a["n"] < TAIL)
        return F.struct(
            (a["at"] + 1).alias("at"), (first | inside).alias("open"), F.when(first, 0).when(inside, a["n"] + s["n"]).otherwise(a["n"]).alias("n"),
            F.when(first, s["v"]).when(inside, F.array_union(a["v"], s["v"])).otherwise(a["v"]).alias("v"),
        )

    # a line has a word at least, so TAIL lines after the first are enough
    block = lambda i: F.aggregate(F.slice(lines, i, TAIL + 1), start, more, lambda a: a["v"])
    return F.transform(F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.size(F.element_at(lines, i)["v"]) > 0), block)


def _words_in(padded: Column) -> Column:
    """Words of a text whose every word stands between two spaces of its own."""
    return ((F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit("")))) / 2).cast("long")


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score."""
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession)
    results = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    keep = C.kept(docs.columns if keep is None else keep, results)
    own = [C.col(c) for c in keep]
    keys = [F.xxhash64(id_col, text_col).alias("__k1"), F.xxhash64(F.lit(1), text_col, id_col).alias("__k2")]
    flat = F.regexp_replace(C.ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), _GAP, "  ")
    templates = _templates()
    vocab = sorted({w for _, label, words, _ in templates for w in [*words, *BARRED.get(label, [])]})
    least = min(a for *_, a in templates)
    literal = lambda words: F.array(*[F.lit(w) for w in words])
    lines = docs.select(*own, *keys, F.split(flat, "\n", -1).alias("__l"))
    lines = lines.withColumn("__l", F.transform("__l", lambda x: F.trim(x)))

    # one pass: counts and places of the base phrases, and the blocks
    whole = F.array_join(F.filter("__l", lambda x: x != ""), "  ")
    cut = F.transform(F.transform("__l", lambda x: F.split(x, "  ")), lambda w: F.struct(F.when(F.get(w, F.lit(0)) == "", 0).otherwise(F.size(w)).alias("n"), F.array_intersect(w, literal(vocab)).alias("v")))
    df = lines.select(*own, "__k1", "__k2", F.concat(F.lit(" "), whole, F.lit(" ")).alias("__s"), cut.alias("__l"))
    df = df.withColumn("__v", F.array_distinct(F.flatten(F.transform("__l", lambda s: s["v"]))))
    df = df.withColumn("n_words", F.when(F.col("__s") == "  ", 0).otherwise(_words_in(F.col("__s"))).cast("long"))
    n, first, last = [], [], []
    for phrase in PHRASES:
        words = phrase.split()
        p = " " + "  ".join(words) + " "
        count = ((F.length("__s") - F.length(F.replace("__s", F.lit(p), F.lit("")))) / len(p)).cast("long")
        n.append(count)
        has = F.contains("__s", F.lit(p))
        first.append(F.when(has, _words_in(F.substring_index("__s", p, 1))))
        last.append(F.when(has, F.col("n_words") - len(words) - _words_in(F.substring_index("__s", p, -1))))
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.contains("__s", F.lit(" " + "  ".join(q.split()) + " ")), F.lit(label)) for q, label in PHRASES.items()])))
    enough = lambda words, need: F.size(F.array_intersect("__v", literal(words))) >= need
    possible = F.lit(False)
    for _, _, words, need in templates:
        possible = possible | enough(words, need)
    scanned = df.select(
        *own, "__k1", "__k2", "n_words", sum(n[1:], n[0]).alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"),
        base.alias("__base"), F.when((F.size("__v") >= least) & possible, F.filter(_blocks("__l"), lambda b: F.size(b) >= least)).alias("__blocks"),
    )
    scanned = ws.save(scanned, "scanned")

    # set-similarity join
    blocks = scanned.where("__blocks is not null").select("__k1", "__k2", F.explode("__blocks").alias("words"))
    counts = {r["w"]: r["n"] for r in blocks.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row per template word at most
    order = sorted(vocab, key=lambda w: (counts.get(w, 0), w))
    place = {w: k for k, w in enumerate(order)}
    index, sets = [], []
    for k, label, words, need in templates:
        words = sorted(words, key=place.__getitem__)
        index += [(w, k, i, len(words), need) for i, w in enumerate(words[: len(words) - need + 1])]
        sets.append((k, label, words, need, *_rules(label, words)))
    index = spark.createDataFrame(index, "word string, template int, i int, s int, need int")
    sets = spark.createDataFrame(sets, "template int, label string, set array<string>, need int, must array<string>, bar array<string>")
    probe = blocks.select("__k1", "__k2", F.array_intersect(literal(order), "words").alias("words")).distinct()
    probe = probe.select("__k1", "__k2", "words", F.posexplode("words").alias("j", "word"))
    pairs = probe.join(F.broadcast(index), "word").where(F.col("need") <= 1 + F.least(F.col("s") - F.col("i") - 1, F.size("words") - F.col("j") - 1))
    hits = pairs.select("__k1", "__k2", "words", "template").join(F.broadcast(sets), "template")
    both = F.size(F.array_intersect("words", "set"))
    told = (F.size(F.array_except("must", "words")) == 0) & ~F.arrays_overlap("bar", "words")
    hits = hits.where((both >= F.col("need")) & told).groupBy("__k1", "__k2").agg(F.collect_set("label").alias("__found"), F.max(both / F.size("set")).alias("__best"))

    df = scanned.drop("__blocks").join(hits, ["__k1", "__k2"], "left")
    return df.select(
        *own, "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__base", F.coalesce("__found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("__best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def sql() -> str:
    """The same by comparing every block with every template."""
    listed = lambda words: f"{words!r}::VARCHAR[]"
    rows = ", ".join(f"('{label}', {words!r}, {need}, {', '.join(map(listed, _rules(label, words)))})" for _, label, words, need in _templates())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"('{label}', {p.split()!r})" for p, label in PHRASES.items())
    return rf"""
WITH t(label, words, need, must, bar) AS (VALUES {rows}), p(label, words) AS (VALUES {phrases}),
d AS (SELECT doc_id, translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}') AS s FROM documents),
w AS (SELECT doc_id, s, regexp_extract_all(s, '{word}') AS w FROM d),
k AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w),
h AS (SELECT doc_id, i, p.label FROM k, p WHERE w[i + 1] = p.words[1] AND w[i + 1 : i + len(p.words)] = p.words),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS l FROM h GROUP BY doc_id),
r AS (SELECT doc_id, unnest(string_split(s, chr(10))) AS line, unnest(range(len(string_split(s, chr(10))))) AS i FROM d),
y AS (SELECT doc_id, i, regexp_extract_all(line, '{word}') AS ws FROM r),
z AS (SELECT doc_id, i, ws, len(ws) AS n, sum(len(ws)) OVER o AS upto, sum(CASE WHEN len(ws) = 0 THEN 1 ELSE 0 END) OVER o AS par
      FROM y WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
x AS (SELECT a.doc_id, a.i, list_distinct(flatten(list(b.ws))) AS ws FROM z a JOIN z b
      ON a.doc_id = b.doc_id AND a.par = b.par AND b.i >= a.i AND b.i <= a.i + {TAIL} AND (b.i = a.i OR b.upto - b.n - a.upto < {TAIL})
      WHERE a.n > 0 AND b.n > 0 GROUP BY a.doc_id, a.i),
m AS (SELECT doc_id, list(DISTINCT label) AS l, max(len(list_intersect(ws, t.words)) / len(t.words)) AS best
      FROM x, t WHERE len(list_intersect(ws, t.words)) >= t.need AND len(list_intersect(ws, must)) = len(must) AND len(list_intersect(ws, bar)) = 0 GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word,
  b.last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(b.l), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.l, []), coalesce(m.l, [])))), ','), '') AS labels,
  greatest(coalesce(m.best, 0.0), CASE WHEN b.n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM w LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN m ON w.doc_id = m.doc_id
"""
