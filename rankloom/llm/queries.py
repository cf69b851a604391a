"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import bpe_automaton, chat_format, conversation_trie, decontam, gru_lm, html_extract, jaccard_join, license_scan, line_dedup, merkle, quality_gbt, sentencepiece_fst, toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    model, _ = toxicity.fit_toxicity(docs, C.read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, keep=["doc_id"])
    held = C.crc_mod(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(C.read(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.render_conversations(C.read(spark, sf_dir, "conversations"))
    return out.select("conv_id", "part", "n_turns", F.md5("rendered").alias("rendered_md5"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return gru_lm.score_documents(docs, gru_lm.fit(docs), keep=["doc_id"])


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark")
    found = decontam.find_contamination(docs, bench, keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontam.items_digest("items").alias("items_sha256"), "contaminated",
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode_texts(C.read(spark, sf_dir, "documents"), keep=["doc_id"], digest=True)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(C.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    trees = quality_gbt.fit_quality(docs, C.read(spark, sf_dir, "labels"))
    scored = quality_gbt.score_quality(docs, trees, keep=["doc_id"])
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_classes(C.read(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(C.read(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    changed = merkle.leaf_digest([C.ascii_lower(F.col(f)) if f == "text" else F.col(f) for f in merkle.FIELDS])
    tampered = F.col("doc_id").isNotNull() & (C.crc_mod(F.col("doc_id"), 5) == 0)
    proofs = merkle.prove(merkle.build_manifest(docs, claim=F.when(tampered, changed)))
    return proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.fold(F.col("claim"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(C.read(spark, sf_dir, "conversations"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_texts(C.read(spark, sf_dir, "documents"), keep=["doc_id"], digest=True)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TOKENS = f"regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '[^\\x20\\x09-\\x0D]+')"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item_id, w, least(13, len(w)) AS l, unnest(range(greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, w[i + 1 : i + l] AS win FROM k), lens AS (SELECT DISTINCT l FROM win),
p AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d), dw AS (SELECT doc_id, i, l, w[i + 1 : i + l] AS win FROM p, lens WHERE i + l <= len(w)),
o AS (SELECT doc_id, i, dw.l, item_id FROM dw JOIN win ON dw.l = win.l AND dw.win = win.win),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n o ON o.doc_id = y WHERE 100 * c >= 90 * (m.n + o.n - c)),
ee AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, ee.y FROM r JOIN ee ON r.reach = ee.x),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON d.doc_id = c.doc_id
"""

SQL: dict[str, str] = {
    "op2_license_scan": license_scan.sql(), "op3_chat_format": chat_format.SQL, "op5_benchmark_decontamination": DECONTAMINATION_SQL,
    "op7_line_dedup": line_dedup.SQL, "op9_jaccard_join": JACCARD_SQL,
    "op11_merkle_manifest": merkle.sql(), "op12_conversation_trie": conversation_trie.sql(C.crc_sql),
}
