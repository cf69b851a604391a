"""Operators of the text subpackage: brute force, round trips, held-out accuracy, and odd inputs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import chat_format, decontam, fm_index, gru_lm, html_extract, jaccard_join, license_scan, line_dedup, quality_gbt, queries, sentencepiece_fst, toxicity
from rankloom.llm import common as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, N_Words int, labels string, `a.b` string, __k1 long"
LONG = " ".join(f"w{i % 977}x{i // 3}" for i in range(40_000))
ODD = [None, "", " \n\t ", "one", "Line a\nLine b\nLine c\nLine d", "Line a\nLine b\nLine c\nLine d", LONG, "\n\n\n", "café ÉTÉ ▁ x", "idiot " * 60]


def frame(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", None if t is None else len(t), 0.5, 7, "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a row repeated, a row with null in every column."""
    df = frame(spark, ODD)
    return df.unionByName(df.where("doc_id = 4")).unionByName(spark.createDataFrame([(None,) * 10], SCHEMA)).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 9)) for i in range(10)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def table(spark, sf_dir, name):
    return C.read(spark, sf_dir, name)


# every operator takes odd and empty tables


def test_odd_quality(spark, odd, none, labels):
    trees = quality_gbt.fit_quality(odd, labels)
    out = quality_gbt.score_quality(odd, trees)
    rows = out.collect()
    assert len(rows) == 12 and "a.b" in out.columns and out.columns.count("n_words") == 1
    by = {r["doc_id"]: r for r in rows}
    assert (by[0]["n_words"], by[1]["n_words"], by[6]["n_words"]) == (0, 0, 40_000) and not by[0]["kept"] and by[9]["base_failed"]
    assert quality_gbt.score_quality(none, quality_gbt.fit_quality(none, labels)).count() == 0


def test_odd_toxicity(spark, odd, none, labels):
    model, _ = toxicity.fit_toxicity(odd, labels)
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    model, label_model = toxicity.fit_toxicity(none, labels)
    assert label_model is None and toxicity.score_toxicity(none, model).count() == 0


def test_odd_licenses(spark, odd, none):
    by = {r["doc_id"]: r for r in license_scan.scan_licenses(odd).collect()}
    assert by[0]["n_words"] == by[1]["n_words"] == by[2]["n_words"] == 0 and by[6]["n_words"] == 40_000 and by[8]["n_words"] == 4
    assert license_scan.scan_licenses(none).count() == 0


def test_odd_lm(spark, odd, none):
    lm = gru_lm.fit(odd)
    rows = gru_lm.score_documents(odd, lm).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12 and by[0]["n_tokens"] == by[1]["n_tokens"] == 1 and by[6]["n_tokens"] == 40_001
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert gru_lm.score_documents(none, gru_lm.fit(none)).count() == 0
    untrained = gru_lm.score_documents(odd, gru_lm.fit(none)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in untrained)


def test_odd_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "line a line b"), (2, None), (None, "one"), (3, ""), (1, "une")], "item_id long, text string")
    by = {r["doc_id"]: r for r in decontam.find_contamination(odd, bench).collect()}
    assert by[4]["items"] == ["1"] and by[4]["n_hit"] == 4 and by[4]["contaminated"] and by[3]["items"] == [] and by[0]["n_words"] == 0
    assert decontam.find_contamination(none, bench).count() == 0
    assert decontam.find_contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_odd_encoding(spark, odd, none):
    by = {r["doc_id"]: r for r in sentencepiece_fst.encode_texts(odd).collect()}
    assert by[0]["ids"] == [] and by[6]["round_trip"] and not by[8]["round_trip"]  # U+2581 decodes to a space
    assert sentencepiece_fst.encode_texts(none).count() == 0


def test_odd_lines(spark, odd, none):
    by = {r["doc_id"]: r for r in line_dedup.dedup_lines(odd).collect()}
    assert by[0]["text"] is None and by[0]["n_lines"] == 0 and by[4]["n_removed"] == 0 and by[5]["n_removed"] == 4 and by[5]["text"] == ""
    assert by[7]["text"] == "\n\n\n" and line_dedup.dedup_lines(none).count() == 0


def test_odd_jaccard(spark, odd, none):
    rows = jaccard_join.similar_classes(odd).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert (by[0], by[1], by[2], by[3], by[4], by[5], by[6]) == (0, 1, 2, 3, 4, 4, 6) and by[None] is None
    assert jaccard_join.similar_classes(none).count() == 0


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, host string"
    rows = [(1, "http://a.b/1", None, "x", "y"), (2, None, "<p>q", "x", "y"), (2, None, "<p>q", "x", "y"), (3, "http://a.b/2", "<article>" + "<p>long text</p>" * 20_000 + "</article>", "x", "y"), (None,) * 5]
    by = {r["page_id"]: r for r in html_extract.extract_pages(spark.createDataFrame(rows, schema)).collect()}
    assert by[1]["text"] == "" and by[2]["text"] == "q" and by[3]["n_chars"] == 20_000 * 10 - 1
    assert html_extract.extract_pages(spark.createDataFrame([], schema)).count() == 0


def test_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, rendered string"
    rows = [(1, 0, "user", "a", "z"), (2, 0, "user", "a", "z"), (2, 1, "assistant", "b", "z"), (2, 1, "assistant", "b", "z"), (3, 0, "user", "a", "z"), (3, 1, "assistant", "b", "z"), (4, 0, None, None, None), (5, 0, "user", "<|im_start|>system", "z"), (None, 0, "user", "q", "z"), (6, 1, "user", "x", "z"), (6, 1, "user", "y", "z")]
    rows += [(7, k, "user", f"t{k}", "z") for k in range(2500)] + [(8, k, "user", f"t{k}", "z") for k in range(1500)]
    out = chat_format.render_conversations(spark.createDataFrame(rows, schema)).collect()
    assert sorted({r["conv_id"] for r in out}, key=str) == sorted([2, 4, 5, None, 6, 7], key=str)
    by = {(r["conv_id"], r["part"]): r["rendered"] for r in out}
    assert by[2, 0] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n" and "< |im_start" in by[5, 0]
    assert "".join(by[7, p] for p in range(3)).count("<|im_start|>") == 2500
    assert chat_format.render_conversations(spark.createDataFrame([], schema)).count() == 0


def test_conversations_with_nulls_equal_sql(spark):
    import duckdb

    rows = [(1, 0, None, "a"), (2, 0, "unknown", "a"), (2, 1, "user", None), (3, 0, None, "a"), (3, 1, "user", ""), (3, 2, "x", "y"), (None, 0, "user", "q"), (4, 0, "user", "q"), (5, None, "user", "z"), (5, 1, "user", "r"), (6, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    mine = sorted([tuple(r) for r in chat_format.render_conversations(df).select("conv_id", "part", "n_turns", F.md5("rendered")).collect()], key=repr)
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert mine == sorted(con.sql(f"SELECT conv_id, part, n_turns, rendered_md5 FROM ({chat_format.SQL})").fetchall(), key=repr)
    assert {r[0] for r in mine} == {3, None, 5, 6}


# methods


@pytest.mark.parametrize("seed", range(5))
def test_fm_index_equals_search(seed):
    rng = np.random.default_rng(seed)
    for _ in range(30):
        s = rng.integers(1, 4, rng.integers(1, 80))
        fm = fm_index.FMIndex(s, int(rng.integers(1, 9)))
        n = rng.integers(1, 5, 10)
        p = np.zeros((10, 4), int)
        for i, k in enumerate(n):
            p[i, :k] = rng.integers(1, 5, k)
        low, high = fm.search(p, n)
        for i, k in enumerate(n):
            want = [j for j in range(len(s) - k + 1) if (s[j : j + k] == p[i, :k]).all()]
            assert sorted(fm.locate(np.arange(low[i], high[i]))) == want


def test_decontamination_equals_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_BYTES", 2500)
    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 60").collect()}
    items = [(str(r["item_id"]), r["text"]) for r in table(spark, sf_dir, "benchmark").limit(12).collect()] + [("s", "the and"), ("t", "of")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = dict(zip(texts, decontam.brute_force(list(texts.values()), items)))
    for blocks in (10_000_000, 400):
        got = decontam.find_contamination(docs.where("doc_id < 60"), bench, block_bytes=blocks).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want


def test_cut_spans(spark):
    df = spark.createDataFrame([("One, two THREE four!", [[1, 3]])], "text string, spans array<array<int>>")
    assert decontam.cut_spans(df).first()["text"] == "One,  four!"
    odd = spark.createDataFrame([(1, None, [[0, 1]], 5), (2, "a b", None, 5), (2, "a b", [], 5), (3, "", [], 5), (4, "x " * 50_000 + "y", [[0, 50_000]], 5), (4, "a b", [[0, 1], [1, 2]], 5)], "doc_id long, text string, spans array<array<int>>, n_words int")
    got = sorted([(r["doc_id"], r["text"]) for r in decontam.cut_spans(odd).collect()], key=repr)
    assert got == sorted([(1, None), (2, "a b"), (2, "a b"), (3, ""), (4, " y"), (4, " ")], key=repr) and decontam.cut_spans(odd.limit(0)).count() == 0


def test_encoder_equals_library(spark, sf_dir):
    import random

    import sentencepiece

    fst = sentencepiece_fst.compile_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_model())
    random.seed(4)
    texts = [r["text"] for r in table(spark, sf_dir, "documents").collect()]
    texts += ["".join(random.choice("ab  the\n\té€😀ing.,0123<0x0A>́") for _ in range(random.randint(0, 60))) for _ in range(500)]
    for t in texts:
        ids = fst.encode(t).tolist()
        assert ids == sp.encode(t) and fst.decode(ids) == t


def test_unigram_shortest_path():
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -3.5, 1), ("▁a", -2.5, 1)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    fst = sentencepiece_fst.Transducer(pieces, sentencepiece_fst.UNIGRAM, True)
    assert [pieces[i][0] for i in fst.encode("ab")] == ["▁", "ab"]  # -5.5 against ▁ a b: -8 and ▁a b: -5.5 (first found)
    assert fst.decode(fst.encode("aé b")) == "aé b"


def _message(number, value):
    size, out = len(value), b""
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return bytes([number << 3 | 2]) + out + bytes([size]) + value


def test_character_map_and_spaces_equal_library(tmp_path):
    """A unigram model with the library's NFKC rules, white space joined, a user-defined and an unused piece."""
    import random
    import struct

    import sentencepiece

    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.1, 1), ("b", -3.2, 1), ("ab", -3.5, 1), ("▁a", -2.6, 1), ("fi", -4.0, 1), ("▁fi", -4.1, 1), ("A1", -5.0, 1), ("ab▁", -1.0, 5), ("<x>", 0.0, 4)]
    body = b"".join(_message(1, _message(1, p.encode()) + b"\x15" + struct.pack("<f", w) + bytes([24, t])) for p, w, t in pieces)
    body += _message(2, bytes([3 << 3, 1])) + norm
    path = tmp_path / "own.model"
    path.write_bytes(body)
    fst, sp = sentencepiece_fst.compile_model(str(path)), sentencepiece.SentencePieceProcessor(model_proto=body)
    random.seed(1)
    texts = ["", " ", "ﬁ  Ａ① x ", "a\u0301b", "\u3000ab  ab\t<x>ab "] + ["".join(random.choice("ab  ﬁＡ①\t<x>½e\u0301㌔") for _ in range(random.randint(0, 30))) for _ in range(400)]
    for t in texts:
        assert fst.encode(t).tolist() == sp.encode(t), t


def test_least_weight_of_all_segmentations():
    """The path's weight is the least among all ways to cut a text, found by listing them."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        words = {"".join(rng.choice(list("abc"), rng.integers(1, 4))) for _ in range(8)} | {"a", "b", "c"}
        pieces = [("<unk>", 0.0, 2)] + [(w, -float(rng.integers(1, 40)) / 4, 1) for w in sorted(words)]
        cost = {p: -w for p, w, t in pieces if t == 1}
        fst, text = sentencepiece_fst.Transducer(pieces, sentencepiece_fst.UNIGRAM, False), "".join(rng.choice(list("abc"), 9))

        def cuts(rest):
            return min((cost[rest[:k]] + cuts(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in cost), default=0.0) if rest else 0.0

        got = [pieces[i][0] for i in fst.encode(text)]
        assert "".join(got) == text and abs(sum(cost[p] for p in got) - cuts(text)) < 1e-9


def test_op6_query_equals_library(spark, sf_dir, monkeypatch):
    """The query itself, with caches that overflow."""
    import hashlib

    import sentencepiece

    monkeypatch.setattr(sentencepiece_fst, "CACHE_BYTES", 20_000)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_model())
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op6_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(sp.encode(texts[r["doc_id"]]), "<i4")
        assert (r["n_ids"], r["ids_sha256"], r["round_trip"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), True)


def test_odd_decoding(spark):
    df = spark.createDataFrame([(1, [], "x"), (2, None, "y"), (2, None, "y"), (3, [0, 1, 2], None)], "doc_id long, ids array<int>, text string")
    by = {r["doc_id"]: r["text"] for r in sentencepiece_fst.decode_ids(df).collect()}
    assert by == {1: "", 2: "", 3: ""} and sentencepiece_fst.decode_ids(df.limit(0)).count() == 0


def brute_components(texts, n, num, den):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(C.LOWER_BYTES).split()
        sets[i] = set(zip(*[w[k:] for k in range(n)])) if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,num,ids", [(3, 90, 200_000), (5, 80, 0), (1, 50, 200_000)])
def test_jaccard_equals_brute_force(spark, monkeypatch, n, num, ids):
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", ids)
    rng = np.random.default_rng(n)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = list(rng.choice(words, rng.integers(1, 120)))
        for _ in range(rng.integers(1, 7)):
            copy = list(base)
            for _ in range(rng.integers(0, 5)):
                copy[rng.integers(len(copy))] = str(rng.choice(words))
            texts.append(" ".join(copy))
    texts += ["common opening words " + t for t in texts[:20]] + [texts[0]] * 3 + ["", " ", None]
    df = frame(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_classes(df, n=n, num=num).collect()}
    assert got == brute_components(dict(enumerate(texts)), n, num, 100)


def test_jaccard_is_exact_when_handles_collide(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HANDLE_BYTES", 1)
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(90):
        base = [f"w{i}" for i in rng.integers(0, 4000, rng.integers(20, 60))]
        texts += [" ".join(base), " ".join([*base[:-1], "other"])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_classes(frame(spark, texts), n=3, num=90).collect()}
    assert got == brute_components(dict(enumerate(texts)), 3, 90, 100)


def test_gathered_signatures_keep_every_member():
    rng = np.random.default_rng(5)
    owner, sig = rng.integers(0, 40, 500), rng.integers(0, 200, 500).astype(np.uint64)
    s, o, of = jaccard_join.gathered(owner, sig)
    heads = {int(x): int(t) for x, t, p in zip(s, o, of) if p < 0}
    assert len(heads) == int((of < 0).sum()) == len(set(sig.tolist()))
    members = {int(x): {int(t) for y, t in zip(sig, owner) if y == x} for x in set(sig.tolist())}
    for x, all_ in members.items():
        got = {int(t) for y, t, p in zip(s, o, of) if y == x and p >= 0}
        assert heads[x] in all_ and (got == all_ or not got and len([1 for y in sig if y == x]) == 1)
        assert {int(p) for y, p in zip(s, of) if y == x and p >= 0} <= {heads[x]}


@pytest.mark.parametrize("num,sets", [(90, 100), (90, 10**9), (80, 100), (80, 10**9)])
def test_signatures_miss_no_similar_pair(num, sets):
    rng, bands = np.random.default_rng(num), jaccard_join.Bands(num, 100, 100_000)
    plan = {b: (*bands.allocate(b, sets), bands.differences(b)) for b in range(len(bands.edges) - 2)}
    seen = 0
    for _ in range(300):
        a = rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.15], rng.integers(0, 1 << 63, len(a) // 12 + 1).astype(np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 100 * both < num * (len(a) + len(b) - both):
            continue
        seen += 1
        doc, h, size = np.r_[np.zeros(len(a), int), np.ones(len(b), int)], np.concatenate([a, b]), np.array([len(a), len(b)])
        band, sigs = bands.of(size), [set(), set()]
        for shift in (0, 1):
            for o, s in zip(*jaccard_join.signatures(doc, h, size, band - shift, plan)):
                sigs[o].add(int(s))
        assert sigs[0] & sigs[1]
    assert seen > 50


def test_line_dedup_merges_and_keeps_first(spark):
    texts = ["a\nb\nc\nd\ne", "x\nb\nc\nd\ne\ny", "b\n\nc\nd\nz", "p " * 60 + "\nq", "r\n" + "p " * 60, "a\nb"]
    by = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert by == {0: texts[0], 1: "x\ny", 2: "z", 3: texts[3], 4: texts[4], 5: "a\nb"}  # one long line is no window


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(3000) < 0.1)).astype(float)
    t = quality_gbt.fit_trees(x, y, {0: -1, 1: 1})
    assert ((t.probability(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.97
    for f, sign in ((0, -1), (1, 1)):
        for row in x[:50]:
            grid = np.repeat(row[None], 40, 0)
            grid[:, f] = np.linspace(0, 1, 40)
            assert (np.diff(t.probability(grid)) * sign >= -1e-12).all()


def test_quality_counts_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = queries.op8_quality_rules(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out:
        t = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_verdict_on_labels(spark, sf_dir):
    got = queries.op8_quality_rules(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("not base_failed").collect()
    good = [r for r in got if r["quality"] == 1]
    assert sum(r["kept"] for r in good) / len(good) > 0.97


def test_quality_finds_bad_documents(spark, sf_dir):
    """Bad and good documents of held-out labels, the trees fitted on the others."""
    docs, labels = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents"), table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels")
    part = C.crc_mod(F.col("doc_id"), 3)
    trees = quality_gbt.fit_quality(docs, labels.where(part != 0))
    got = quality_gbt.score_quality(docs, trees, keep=["doc_id"]).join(labels.where(part == 0), "doc_id").where("quality is not null").collect()
    good, bad = ([r["kept"] for r in got if r["quality"] == q] for q in (1, 0))
    assert len(bad) >= 10 and np.mean(bad) < 0.25 and np.mean(good) > 0.95


def test_long_lines_are_told_apart():
    """Words of a line count in full: no bound at 1,000."""
    short, long_ = (quality_gbt.statistics([b"w " * n])[1][0][quality_gbt.FEATURES.index("line_words")] for n in (1000, 5000))
    assert (short, long_) == (1000, 5000)


def test_op1_query_equals_plain_rescoring(spark, sf_dir):
    """Scores of the query worked out again for every document, word by word, from the fitted weights."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model, _ = toxicity.fit_toxicity(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    weight = {t.decode(): w for t, w in zip(model.terms, model.weights[1 + len(toxicity.DENSE) :])}
    rows = queries.op1_toxicity(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and model.terms
    for r in rows:
        t = texts[r["doc_id"]]
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        raw = [w.encode() for w in words]
        own = [[x.decode("utf-8", "surrogateescape") for x in (w, *[w[:k] + b"*" for k in (4, 6) if len(w) > k])] for w in raw]
        hit = [[x for x in o if x in weight] for o in own]
        at = [i for i, h in enumerate(hit) if h or words[i] in toxicity.LEXICON]
        listed = sum(words[i] in toxicity.LEXICON for i in at)
        addressed = sum(any(w in toxicity.ADDRESS for w in words[max(0, i - 3) : i + 4]) for i in at)
        lower, upper = len(re.findall("[a-z]", t)), len(re.findall("[A-Z]", t))
        dense = [np.log1p(len(at)), np.log1p(len({words[i] for i in at})), 100 * len(at) / max(len(words), 20), np.log1p(listed), np.log1p(addressed), upper / (lower + upper) if lower + upper else 0.0]
        z = model.weights[0] + sum(a * b for a, b in zip(dense, model.weights[1:])) + sum(weight[x] * np.log1p(n) for x, n in Counter(x for h in hit for x in h).items())
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_every_term_above_chance_is_kept(spark):
    """More terms than any fixed number; rare toxic texts and long words count as well."""
    rng = np.random.default_rng(3)
    bad, rows = [f"bad{i:03d}" + "z" * (i % 90) for i in range(600)], []
    for i in range(2500):
        toxic = i % 10 == 0
        rows.append((i, " ".join([*rng.choice(400, 30).astype(str), *([bad[k] for k in rng.choice(600, 60, replace=False)] if toxic else [])]), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model, label_model = toxicity.fit_toxicity(df, df.select("doc_id", "toxic").where("doc_id % 2 = 0"))
    assert sum(t in {b.encode() for b in bad} for t in model.terms) > 550
    got = toxicity.score_toxicity(df, model).collect()
    assert all((r["score"] >= 0.5) == (r["toxic"] == 1) for r in got) and 0.05 < label_model.balance < 0.2  # unlabelled ones take part


def test_toxicity_held_out(spark):
    """Words that mark toxic texts, none of them in the fixed lexicon, are learnt outside the fold."""
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(400)]
    texts, marks = [], []
    for _ in range(1500):
        bad = rng.random() < 0.15
        t = list(rng.choice(words, 80))
        for _ in range(4 if bad else 0):
            t[rng.integers(80)] = str(rng.choice(["zorg", "blarkest", "blarking", "frobs"]))
        texts.append(" ".join(t))
        marks.append(int(bad))
    docs = frame(spark, texts)
    lab = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    model, label_model = toxicity.fit_toxicity(docs, lab)
    rows = toxicity.score_toxicity(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == marks[r["doc_id"]] for r in held]) > 0.98
    assert label_model.correlation.shape[0] == label_model.table.shape[1] and (label_model.discount >= 1).all()


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.9, y, ~y)
    poor = np.where(rng.random(4000) < 0.6, y, ~y)
    votes = np.stack([np.where(v, 1, -1) for v in (good, good, poor, np.where(rng.random(4000) < 0.85, y, ~y))], 1)
    m = toxicity.fit_label_model(votes, np.clip(votes.mean(1) / 2 + 0.5, 0.05, 0.95))
    acc = np.exp(m.table[1][:, 2])
    assert acc[0] > acc[2] and m.discount[0] > m.discount[2] and m.correlation[0, 1] > 0.9


def test_gradient():
    rng = np.random.default_rng(1)
    p = {k: rng.standard_normal(s) * 0.3 for k, s in gru_lm.shapes().items()}
    x, y, m = rng.integers(0, gru_lm.VOCAB + 1, (4, 3)), rng.integers(0, gru_lm.VOCAB, (4, 3)), np.ones((4, 3))
    h = rng.standard_normal((3, gru_lm.HIDDEN))
    d = gru_lm.gradient(p, x, y, m, h)[0]
    for k in p:
        i = tuple(rng.integers(0, s) for s in p[k].shape)
        i = (x[0, 0], i[1]) if k == "x" else (y[0, 0] // (gru_lm.VOCAB // gru_lm.CLASSES), *i[1:]) if k in ("wo", "bo") else i
        loss = []
        for e in (1e-5, -1e-5):
            p[k][i] += e
            loss.append(gru_lm.gradient(p, x, y, m, h)[2])
            p[k][i] -= e
        assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(d[k][i], rel=1e-3, abs=1e-6)


def test_training_sees_every_token_whatever_the_partitions(spark):
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, gru_lm.VOCAB, n).astype(np.int16) for n in (1, 700, 33, 32, 64, 7)]
    assert gru_lm.train(gru_lm.initial(np.ones(gru_lm.VOCAB)), docs)[1] == sum(map(len, docs))
    texts = [(i, " ".join(f"w{k}" for k in rng.integers(0, 90, 1 + i % 300))) for i in range(600)] + [(None, None), (1000, ""), (1001, "x " * 9000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = df.where(gru_lm.C.crc_mod(gru_lm.F.col("doc_id"), 7) != 2).select("text").collect()
    scores = []
    for parts in (2, 8):
        lm = gru_lm.fit(df.repartition(parts), shard_tokens=5000)
        assert sum(lm.trained) == lm.n == sum(len(gru_lm.tokens_of((r[0] or "").encode())) for r in want) and min(lm.trained) > 0
        scores.append({r["doc_id"]: r["score"] for r in gru_lm.score_documents(df, lm).collect()})
    assert all(abs(x - scores[1][i]) <= 1e-3 for i, x in scores[0].items())


def test_probabilities_sum_to_one():
    p, h = gru_lm.initial(np.arange(gru_lm.VOCAB, dtype=float)), np.random.default_rng(0).standard_normal((1, gru_lm.HIDDEN)).astype(np.float32)
    all_ = gru_lm.log_probability(p, np.repeat(h, gru_lm.VOCAB, 0), np.arange(gru_lm.VOCAB))
    assert np.exp(all_).sum() == pytest.approx(1.0, rel=1e-4)


def test_state_is_carried_over_windows(monkeypatch):
    monkeypatch.setattr(gru_lm, "LANES", 3)
    rng = np.random.default_rng(3)
    p = {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in gru_lm.shapes().items()}
    docs = [rng.integers(0, gru_lm.VOCAB, n) for n in (1, 150, 33, 32, 64, 7)]
    got = gru_lm.score(p, docs)
    for d, s in zip(docs, got):
        h, last, total = np.zeros((1, gru_lm.HIDDEN), np.float32), gru_lm.VOCAB, 0.0
        for w in d:
            h = gru_lm._cell(p, p["x"][[last]], h)[0]
            total += gru_lm.log_probability(p, h, np.array([w]))[0]
            last = w
        assert s == pytest.approx(total, rel=1e-4)


@pytest.mark.parametrize("common", [300_000, 2500])
def test_base_score_equals_direct_count(spark, sf_dir, monkeypatch, common):
    monkeypatch.setattr(gru_lm, "COMMON", common)
    texts = {r["doc_id"]: gru_lm.tokens_of((r["text"] or "").encode()) for r in table(spark, sf_dir, "documents").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(t for i, ts in texts.items() if not held(i) for t in ts)
    n, v = sum(c.values()), len(c)
    rows = queries.op4_lm_scoring(spark, sf_dir).collect()
    for r in rows:
        ts = texts[r["doc_id"]]
        assert r["held_out"] == held(r["doc_id"]) and r["n_tokens"] == len(ts) and r["n_known"] == sum(c[t] > 0 for t in ts) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(np.log10((c[t] + 1) / (n + v + 1)) for t in ts), rel=1e-9)
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


@pytest.mark.parametrize("html,want", [
    ("<div>a<p>b <b>c</b>d<p>e</div>", [(1, "a"), (1, "b cd"), (1, "e")]), ("<article><header><h1>T</h1>by</header><p>x&nbsp;y &lt;z&gt;</p><aside>s</aside></article>", [(3, "T"), (2, "by"), (0, "x y <z>"), (2, "s")]),
    ("a < b <b>c</b>", [(1, "a < b c")]), ("<p>x<!-- <p>c --> y</p><script>var a='</p>'</script>z", [(1, "x y"), (1, "z")]), ("<nav><ul><li>m</ul></nav><main>q<form>f</form></main>t", [(2, "m"), (0, "q"), (2, "f"), (2, "t")]),
    ("<p title='a>b'>ok</p></div>&amp;amp;", [(1, "ok"), (1, "&amp;")]), ("<div class='cookie-notice'>c</div><div id=comments><article>r</article></div>body", [(2, "c"), (2, "r"), (1, "body")]),
])
def test_blocks(html, want):
    assert html_extract.blocks_of(html) == want


@pytest.mark.parametrize("shard,runs", [(6_000_000, 500_000), (300, 500_000), (300, 0)])
def test_boilerplate_of_a_host(spark, monkeypatch, shard, runs):
    """Pages without containers: what they share goes, their own text stays, whatever the shards."""
    monkeypatch.setattr(html_extract, "SHARD_BYTES", shard)
    monkeypatch.setattr(html_extract, "BROADCAST_RUNS", runs)
    own = [" ".join(f"p{i}w{k}" for k in range(12)) for i in range(12)]
    rows = [(i, f"https://h.example/{i}", f"<div>welcome to the best site of all</div><div>{t}</div><div>all rights are reserved by us here</div>") for i, t in enumerate(own)]
    rows.append((99, "https://other.example/", "<div>welcome to the best site of all</div>"))
    by = {r["page_id"]: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [by[i]["text"] for i in range(12)] == own and by[0]["n_boilerplate"] == 14
    assert by[99]["text"] == "welcome to the best site of all"


@pytest.mark.parametrize("shard,runs", [(6_000_000, 500_000), (3000, 500_000), (3000, 0)])
def test_copies_and_chance_repeats_are_no_boilerplate(spark, monkeypatch, shard, runs):
    """Near copies keep their text, in small and large groups; a sentence on few pages stays where it stands."""
    monkeypatch.setattr(html_extract, "SHARD_BYTES", shard)
    monkeypatch.setattr(html_extract, "BROADCAST_RUNS", runs)
    body = [f"b{k}" for k in range(90)]
    copies = [" ".join([*body[:40], f"x{i}", *body[41:]]) for i in range(30)]
    own = [" ".join(f"p{i}w{k}" for k in range(40)) for i in range(60)]
    own[3] += " as it was said long ago"
    own[8] += " as it was said long ago"
    foot = "all rights are reserved by us here"
    texts = {i: t for i, t in enumerate(own + copies)}
    rows = [(i, f"https://h.example/{i}", f"<div>{t}</div><div>{foot}</div>") for i, t in texts.items()]
    rows += [(200 + i, f"https://two.example/{i}", f"<div>{copies[i]}</div>") for i in range(2)] + [(300 + i, f"https://copies.example/{i}", f"<div>{c}</div>") for i, c in enumerate(copies)]
    want = texts | {200 + i: copies[i] for i in range(2)} | {300 + i: c for i, c in enumerate(copies)}
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


@pytest.mark.parametrize("shard", [6_000_000, 3000])
def test_boilerplate_in_articles(spark, monkeypatch, shard):
    """A short block on many different articles of a host goes, copies of an article stay."""
    monkeypatch.setattr(html_extract, "SHARD_BYTES", shard)
    texts = [" ".join(f"p{i}w{k}" for k in range(40)) for i in range(30)] + [" ".join(f"c{k}" for k in range(60))] * 8
    rows = [(i, f"https://h.example/{i}", f"<nav>home page of the big site</nav><article><p>{t}</p><p>subscribe to our letter of the week</p></article>") for i, t in enumerate(texts)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == dict(enumerate(texts)) and {r["n_boilerplate"] for r in got} == {13}


@pytest.mark.parametrize("html,want", [
    ("<article><div class='post-header'><h1>Title</h1></div><p>x</p></article>", "Title x"), ("<article><p>a</p><section id='related-work'>w</section><p class='share-price'>up</p></article>", "a w up"),
    ("<article><p>so <math><mi>x</mi></math> is</p></article>", "so x is"), ("<div>long text here</div><div class='sb'><a href='/a'>one</a> <a href='/b'>two</a></div>", "long text here"),
    ("<article><p>a</p><div class='share-buttons'>s</div><section id='user-comments'>c</section><div class='ad-300x250'>b</div><div class='relatedPosts'>r</div></article>", "a"),
    ("<ul><li><a href='/a'>one</a></li><li><a href='/b'>two</a></li></ul>", "one two"), ("<h2><a href='/'>Head</a></h2><p>text of it</p><p><a>menu</a></p>", "Head text of it"),
    ("<div class='site-header'>h</div><div class='article-header'>Head</div><div>text <a>link</a> more words</div>", "Head text link more words"),
])
def test_article_text_is_whole(spark, html, want):
    df = spark.createDataFrame([(1, "http://a.b/1", html)], "page_id long, url string, html string")
    assert html_extract.extract_pages(df).first()["text"] == want


BROKEN = ["<script ", "<b ", "<b \"", "<!-- ", "<![CDATA[ ", "</", "<div>", "</div>", "<a href='x", "<svg><p>", "<li>x", "< ", "<p class=\"", "<x><y></x>", "<!x ", "</div "]


@pytest.mark.parametrize("part", BROKEN)
def test_long_broken_pages(part):
    """A megabyte of any broken pattern is read in seconds, also with an end that closes it after all."""
    import time

    for end in ("", ">", "\">", "'>"):
        began = time.process_time()
        html_extract.blocks_of("<article><p>a</p>" + part * (1_000_000 // len(part)) + end)
        assert time.process_time() - began < 8


@pytest.mark.parametrize("html,want", [
    ("a<svg/>b", "ab"), ("<p title=\"x>y\" class='q'>t</p>", "t"), ("a <b 'c", "a <b 'c"), ("x<!-- y", "x"), ("<script>1</script >z", "z"), ("<p>a</P ><STYLE>q</style>b", "a b"), ("1 <2 </ 3", "1 <2 </ 3"), ("<p>a<?x y?>b<!DOCTYPE h>c", "abc"),
])
def test_scanner(html, want):
    assert " ".join(t for _, t in html_extract.blocks_of(html)) == want


@pytest.mark.parametrize("shard,runs", [(6_000_000, 500_000), (3000, 500_000), (3000, 0)])
def test_articles_keep_headings_and_shared_sentences(spark, monkeypatch, shard, runs):
    """Of an article go only whole blocks that most pages of the host have; a heading, a word between such blocks and what a third shares stay."""
    monkeypatch.setattr(html_extract, "SHARD_BYTES", shard)
    monkeypatch.setattr(html_extract, "BROADCAST_RUNS", runs)
    call, often, head = "subscribe to our letter of the week", "this is said in many of our texts", "News of the day from the town"
    rows, want = [], {}
    for i in range(30):
        own = " ".join(f"p{i}w{k}" for k in range(40))
        last = [often] if i % 3 == 0 else []
        blocks = [own, call, "So", call, *last]
        rows.append((i, f"https://h.example/{i}", f"<article><h1>{head}</h1>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"))
        want[i] = " ".join([head, own, "So", *last])
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_boilerplate_equals_brute_force(spark, monkeypatch):
    """Pages without containers on three hosts, one in shards: blocks whose n-grams are on many distinct pages go, found by counting them all."""
    rng, rows = np.random.default_rng(12), []
    shared = [" ".join(f"s{k}x{j}" for j in range(int(rng.integers(6, 14)))) for k in range(6)]
    for i in range(180):
        blocks = [" ".join(f"p{i}b{b}w{j}" for j in range(int(rng.integers(8, 30)))) for b in range(3)]
        blocks += [shared[k] for k in range(6) if rng.random() < (0.9, 0.5, 0.2, 0.08, 0.03, 0.01)[k]]
        rows.append((i, f"http://h{i % 3 if i % 2 else 0}.example/{i}", [blocks[k] for k in rng.permutation(len(blocks))]))
    by_host = {}
    for i, url, blocks in rows:
        by_host.setdefault(url.split("/")[2], {})[i] = blocks
    want = {}
    for pages in by_host.values():
        grams = {i: {tuple(w[k : k + html_extract.LEAST]) for w in [" ".join(b).split()] for k in range(len(w) - html_extract.LEAST + 1)} for i, b in pages.items()}
        count = Counter(g for x in grams.values() for g in x)
        need = max(html_extract.LEAST_PAGES, -(-len(pages) // html_extract.SHARE))
        for i, blocks in pages.items():
            words, cover = " ".join(blocks).split(), set()
            for k in range(len(words) - html_extract.LEAST + 1):
                if count[tuple(words[k : k + html_extract.LEAST])] >= need:
                    cover.update(range(k, k + html_extract.LEAST))
            at, kept = 0, []
            for b in blocks:
                n = len(b.split())
                if 100 * sum(k in cover for k in range(at, at + n)) < html_extract.COVERED * n:
                    kept.append(b)
                at += n
            want[i] = " ".join(kept or blocks)
    df = spark.createDataFrame([(i, u, "".join(f"<div>{b}</div>" for b in bs)) for i, u, bs in rows], "page_id long, url string, html string")
    for shard in (6_000_000, 20_000):
        monkeypatch.setattr(html_extract, "SHARD_BYTES", shard)
        assert {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()} == want


def test_pages_equal_their_articles(spark, sf_dir):
    from html import unescape

    from pathlib import Path

    larger = sf_dir.replace("sf0.001", "sf0.1")  # texts mustn't depend on how many pages a host has
    sf_dir = larger if Path(larger).exists() else sf_dir
    html = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    for r in queries.op10_html_extraction(spark, sf_dir).collect():
        body = re.search(r"<article>(.*)</article>", html[r["page_id"]], re.S)[1]
        parts = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", "\0", body)).split("\0")
        want = " ".join(x for x in (" ".join(unescape(p).split()) for p in parts) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, same_rows):
    same_rows(queries.queries()[name], queries.oracle_sql()[name])


WRAPPED = {
    "mit": """/*
 * Permission is hereby granted, free of charge, to any person obtaining
 * a copy of this software and associated documentation files (the
 * "Software"), to deal in the Software without restriction
 */""",
    "bsd": """# Redistribution and use in source and binary forms, with or
# without modification, are permitted provided that the
# following conditions are met:""",
    "gpl": """ * This program is free software: you can redistribute
 * it and/or modify it under the terms of the GNU
 * General Public License as published by
 * the Free Software Foundation, either version 3""",
    "apache": """// Licensed under the Apache
// License, Version 2.0 (the "License");
// you may not use this file except in
// compliance with the License.""",
    "isc": """Permission to use, copy, modify, and/or distribute this
software for any purpose with or without fee is
hereby granted, provided that the above""",
}


NOTICES = {
    "licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "licensed under CC BY-SA 4.0": "cc-by,cc-by-sa", "released under the BSD license": "bsd", "released under the MIT License": "mit",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License": "gpl",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License": "agpl",
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation": "lgpl",
    "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.": "apache",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "",
    "released under the terms of the house": "", "you may use this file under the terms of the house rules": "",
}


def test_notices_get_their_own_labels_only(spark):
    rows = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(frame(spark, list(NOTICES))).collect()}
    assert {t: rows[i] for i, t in enumerate(NOTICES)} == NOTICES


def test_wrapped_notices(spark):
    """Notices wrapped as published, behind comment leaders, in long lines and apart by an empty line."""
    texts = [f"some words before\n{t}\nand after" for t in WRAPPED.values()]
    texts += [t.replace("\n", "\n\n") for t in WRAPPED.values()] + ["word " * 300 + WRAPPED["bsd"].replace("#", " "), "\n".join(re.findall(r"\w+", WRAPPED["mit"]))]
    rows = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    for k, label in enumerate(WRAPPED):
        assert label in rows[k], (label, rows[k])
    assert "bsd" not in rows[6] and "isc" not in rows[9] and "bsd" in rows[10] and "mit" in rows[11]


def test_license_blocks_equal_sql(spark):
    import duckdb

    rng, words = np.random.default_rng(9), sorted({w for _, t in license_scan.TEMPLATES for w in t.split()} | {"x", "-", ""})
    texts = [None, "", "\n\n"] + list(WRAPPED.values())
    for _ in range(150):
        t = license_scan.TEMPLATES[rng.integers(len(license_scan.TEMPLATES))][1].split()
        t = [w if rng.random() < 0.9 else str(rng.choice(words)) for w in [*rng.choice(words, rng.integers(0, 8)), *t, *rng.choice(words, rng.integers(0, 30))]]
        texts.append("".join(w + rng.choice([" ", "\n", "\n * ", "\n\n"], p=[0.8, 0.1, 0.08, 0.02]) for w in t))
    df = frame(spark, texts)
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    mine = sorted(tuple(r) for r in license_scan.scan_licenses(df, keep=["doc_id"]).select(*cols).collect())
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t in enumerate(texts)])
    theirs = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({license_scan.sql()})").fetchall())
    assert [(*r[:-1], round(r[-1], 9)) for r in mine] == [(*r[:-1], round(r[-1], 9)) for r in theirs]


def test_license_places(spark):
    texts = ["MIT License mit license. CC-BY", "the gnu\ngeneral public license", "permission is hereby granted free of charge to any person obtaining a copy of this software and documentation files"]
    by = {r["doc_id"]: r for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert (by[0]["n_base"], by[0]["first_word"], by[0]["last_word"], by[0]["base_labels"]) == (3, 0, 4, "cc-by,mit")
    assert (by[1]["n_base"], by[1]["first_word"]) == (1, 1) and by[2]["base_labels"] == "" and by[2]["labels"] == "mit"


def test_window_in_blocks():
    """The states of a window with units before lanes are those of the cell, and a window's gradient takes a bounded number of passes over classes."""
    rng = np.random.default_rng(8)
    p = {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in gru_lm.shapes().items()}
    x, h = rng.integers(0, gru_lm.VOCAB, (5, 7)), rng.standard_normal((7, gru_lm.HIDDEN)).astype(np.float32)
    n, (uz, ug), a, at = gru_lm.HIDDEN, gru_lm._halved(p), gru_lm._inputs(p, x), np.ascontiguousarray(h.T)
    for t in range(5):
        h, z, r, g = gru_lm._cell(p, p["x"][x[t]], h)
        zr, own, out = (np.empty((k * n, 7), np.float32) for k in (2, 1, 1))
        at = gru_lm._advance(uz, ug, a[t], at, zr, own, out)
        for mine, theirs in ((at, h), (zr[:n], z), (zr[n:], r), (own, g)):
            assert np.allclose(mine.T, theirs, atol=1e-5)
    y = rng.integers(0, gru_lm.VOCAB, 300)
    states = rng.standard_normal((300, n)).astype(np.float32)
    one = [gru_lm.log_probability(p, states[i : i + 1], y[i : i + 1])[0] for i in range(300)]
    assert np.allclose(gru_lm.log_probability(p, states, y), one, atol=1e-4)


def test_model_keeps_its_arrays():
    """After the first window neither training nor scoring asks the system for arrays of a window's size; far logits and infinite exponentials are right."""
    import tracemalloc

    rng, room = np.random.default_rng(3), gru_lm.Room()
    p = gru_lm.initial(1e5 / np.arange(1, gru_lm.VOCAB + 1))
    x, y = (rng.integers(0, gru_lm.VOCAB, (gru_lm.STEPS, gru_lm.LANES)) for _ in range(2))
    m, h = np.ones(x.shape, np.float32), np.zeros((gru_lm.LANES, gru_lm.HIDDEN), np.float32)
    first = {k: a.copy() for k, a in gru_lm.gradient(p, x, y, m, h, room)[0].items()}
    tracemalloc.start()
    again = gru_lm.gradient(p, x, y, m, h, room)[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(first[k], again[k]) for k in first)
    assert most < 1_500_000  # what is left are gathered rows; the window's arrays have 8 MB
    states, y = rng.standard_normal((50, gru_lm.HIDDEN)).astype(np.float32), rng.integers(0, gru_lm.VOCAB, 50)
    far = p | {"wo": p["wo"] * 500, "wc": p["wc"] * 500}
    exact = {k: a.astype(float) for k, a in far.items()}
    assert np.allclose(gru_lm.log_probability(far, states, y), gru_lm.log_probability(exact, states.astype(float), y), rtol=1e-4, atol=1e-3)
    huge = p | {"x": p["x"] * 5000}
    assert np.isfinite(gru_lm.score(huge, [y.astype(np.int16)])).all()


def test_model_words_by_arrow():
    """The words and places that Arrow finds are those of the tokens one by one, whatever white space and bytes there are."""
    pa = gru_lm.pa
    texts = [b"", None, b"  ", b" a B\tc\x0bd\x0ce\rf\n\ng ", "x\x1cy\x85z\xa0 İ ÀB".encode(), b"q\x00r Q", b"\xff\xfe w\xc3 W", b"one"]
    want = [gru_lm.tokens_of(t or b"") for t in texts]
    for column in (pa.array(texts, pa.binary()), pa.array([b"zz", *texts], pa.binary())[1:], pa.array(texts, pa.binary()).view(pa.string())):
        words, n = gru_lm.words_of(column)
        assert n.tolist() == [len(t) - 1 for t in want] and words.to_pylist() == [w for t in want for w in t[:-1]]
        for known in ([b"b", gru_lm.END, b"q\x00r"], [b"w", b"a"], []):
            at, ends = gru_lm._places(pa.chunked_array([words]), n, pa.array(known, pa.binary()))
            assert at.tolist() == [known.index(w) if w in known else -1 for t in want for w in t]
            assert ends.tolist() == list(np.cumsum([len(t) for t in want]) - 1)


def test_window_in_pieces(monkeypatch):
    """A window's arrays are half of what they were (10.2 MB), and the gradient is that of the loss where pieces cut classes and blocks the window."""
    rng, room = np.random.default_rng(5), gru_lm.Room()
    x, y = (rng.integers(0, gru_lm.VOCAB, (gru_lm.STEPS, gru_lm.LANES)) for _ in range(2))
    gru_lm.gradient(gru_lm.initial(1e5 / np.arange(1, gru_lm.VOCAB + 1)), x, y, np.ones(x.shape, np.float32), np.zeros((gru_lm.LANES, gru_lm.HIDDEN), np.float32), room)
    assert sum(a.nbytes for a in room.held.values()) < 8_000_000
    monkeypatch.setattr(gru_lm, "PIECE", 7)
    p = {k: rng.standard_normal(s) * 0.3 for k, s in gru_lm.shapes(24, 4, 5).items()}
    x, y, m = rng.integers(0, 25, (2 * gru_lm.BLOCK + 3, 5)), rng.integers(0, 24, (2 * gru_lm.BLOCK + 3, 5)), np.ones((2 * gru_lm.BLOCK + 3, 5))
    x[:, :3] = np.where(x[:, :3] % 2, 0, 3)
    h = rng.standard_normal((5, 5))
    d = {k: a.copy() for k, a in gru_lm.gradient(p, x, y, m, h)[0].items()}
    for k in p:
        for i in [tuple(rng.integers(0, s) for s in p[k].shape) for _ in range(12)]:
            loss = []
            for e in (1e-5, -1e-5):
                p[k][i] += e
                loss.append(gru_lm.gradient(p, x, y, m, h)[2])
                p[k][i] -= e
            assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(d[k][i], rel=1e-3, abs=1e-6)
