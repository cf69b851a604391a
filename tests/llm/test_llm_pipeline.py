"""The corpus pipeline: each stage against brute force on its own input, and odd inputs through all of them."""

import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rankloom.llm import common as C
from rankloom.llm import decontam, jaccard_join, line_dedup, quality_gbt
from rankloom.llm.tables import Workspace

import corpus_pipeline as P

from test_llm_operators import LONG, brute_components  # noqa: I001


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return C.read(spark, sf_dir, "documents").where("doc_id % 2 = 0 or n_chars < 500")  # a fixture, not a query


def test_stages_return_documents(spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]


def test_quality_stage(spark, small, sf_dir):
    out = P.quality(spark, small, sf_dir)
    assert out.columns == P.COLUMNS
    kept = {r["doc_id"] for r in out.collect()}
    for r in small.collect():
        counts, _ = quality_gbt.statistics([r["text"].encode()])
        n, repeats = counts[0][0], counts[0][4]
        if n < 50 or 100 * repeats > 50 * n:
            assert r["doc_id"] not in kept
    good = [r["doc_id"] for r in small.join(C.read(spark, sf_dir, "labels").where("quality = 1"), "doc_id").collect() if len(r["text"].split()) >= 80]
    assert len(kept & set(good)) >= 0.95 * len(good)


def test_line_stage(spark, small, sf_dir):
    out = {r["doc_id"]: r for r in P.lines(spark, small, sf_dir).collect()}
    seen, want = set(), {}
    rows = sorted(small.collect(), key=lambda r: r["doc_id"])
    for r in rows:
        lines = r["text"].split("\n")
        v = [i for i, x in enumerate(lines) if x.strip(" \t\r\f\x0b")]
        gone = set()
        for at in range(len(v)):
            part = v[at : at + line_dedup.WINDOW]
            if len(part) < line_dedup.WINDOW:
                continue
            key = tuple(lines[i] for i in part)
            if key in seen:
                gone.update(range(part[0], part[-1] + 1))
            seen.add(key)
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or text.strip():
            want[r["doc_id"]] = text
    assert {k: r["text"] for k, r in out.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())


def test_near_duplicate_stage(spark, small, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    want = {i for i, (_, c) in brute_components(texts, 5, 80, 100).items() if c == i}
    assert Counter(r["doc_id"] for r in P.near_duplicates(spark, small, sf_dir).collect()) == Counter(want)


def test_decontamination_stage(spark, small, sf_dir):
    some = small.where("doc_id < 60")
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    items = [(str(r["item_id"]), r["text"]) for r in C.read(spark, sf_dir, "benchmark").collect()]
    found = decontam.brute_force(list(texts.values()), items)
    want = {i for i, (n, h, _) in zip(texts, found) if not (h > 0 and 20 * h >= n)}
    assert {r["doc_id"] for r in P.decontaminate(spark, some, sf_dir).collect()} == want


def test_encoding_stage(spark, small, sf_dir):
    import sentencepiece

    from rankloom.llm.sentencepiece_fst import default_model

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    for r in P.encode(spark, small, sf_dir).collect():
        assert r["ids"] == sp.encode(texts[r["doc_id"]]) and r["round_trip"]


ODD = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, f string, spans string, ids string, n_lines int, __text string"


def test_odd_rows_in_every_stage(spark, sf_dir):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, LONG, "en", "s", len(LONG)), (3, LONG, "en", "s", len(LONG)), (None, "a b c", None, None, None), (4, "\n\n", "en", "s", 2), (None,) * 5]
    odd = spark.createDataFrame([(*r, 1, True, "x", "y", "z", 2, "q") for r in rows], ODD)
    for docs in (odd, odd.limit(0)):
        for k, (name, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, sf_dir)
            assert out.count() <= docs.count(), name
            if k < len(P.STAGES) - 1:
                assert out.columns == P.COLUMNS, name
    kept = P.near_duplicates(spark, odd, sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "4", "None", "None"]  # rows equal in id and text are one document, "a b c" and null without id are two


def test_near_duplicates_keep_texts_that_share_an_id(spark, sf_dir):
    texts = ["a b c d e f g", "h i j k l m n", "o p q r s t u", "o p q r s t u v"]
    base = " ".join(f"w{k}" for k in range(100))
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, None), (5, texts[2]), (5, base), (5, base), (6, base + " x"), (None, base + " y"), (7, ""), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, sf_dir).collect()]
    want = [(None, texts[0]), (None, texts[1]), (None, None), (5, texts[2]), (5, base), (7, ""), (7, None)]
    assert Counter(kept) == Counter(want)


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "round_trip"]
    assert 0 < out.count() < C.read(spark, sf_dir, "documents").count() and out.where("not round_trip").count() == 0


def _shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    return {p for d in env.blockManager().diskBlockManager().localDirs() for p in Path(d.getPath()).rglob("shuffle_*")}


def test_shuffle_files_of_saved_tables_go(spark):
    ws, before = Workspace(spark), _shuffle_files(spark)
    out = ws.save(spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.monotonic() + 20
    while (left := _shuffle_files(spark) - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert not left and out.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_near_duplicates_leave_their_keys_only(spark, small, sf_dir, monkeypatch):
    roots = []
    monkeypatch.setattr(Workspace, "__init__", lambda self, spark, f=Workspace.__init__: (f(self, spark), roots.append(self.root))[0])
    out = P.near_duplicates(spark, small, sf_dir)
    left = {p.name for p in Path(roots[0].removeprefix("file://")).iterdir()}
    assert "firsts" in left and not left & {"sets", "classes", "members", "wanted", "elements", "rest", "across"}
    assert out.count() > 0


def test_map_of_ids_holds_all_of_them(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MAP_BITS", (1 << 15, 1 << 17))
    ids = spark.range(3000).select(F.when(F.col("id") > 0, F.concat(F.lit("d"), F.col("id").cast("string"))).alias("id"))
    bits, at = jaccard_join.id_bits(ids), [r[0] for r in ids.select(F.xxhash64("id")).collect()]
    on = lambda h: bits[(h % (len(bits) * 8)) >> 3] >> (h & 7) & 1
    assert len(bits) * 8 == 1 << 17 and all(on(h) for h in at) and sum(int(b).bit_count() for b in bits) <= 3000
