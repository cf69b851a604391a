"""Tokenization automaton: the installed library, merges applied one by one, odd texts."""

import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import bpe_automaton, queries
from rankloom.llm import common as C

SCHEMA = "doc_id long, text string, ids string, N_Tokens int, `a.b` string, __k1 long"


@pytest.fixture(scope="module")
def machine():
    return bpe_automaton.compile_vocabulary()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_automaton.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)], lambda ids: t.decode(ids, skip_special_tokens=False)


def merged(word, merges):
    """Merges in their order, each everywhere from the left."""
    parts = [bytes([b]) for b in word]
    for a, b in merges:
        i = 0
        while i < len(parts) - 1:
            if parts[i] == a and parts[i + 1] == b:
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_any_merges(data):
    """Random vocabularies over three letters: pieces of every word up to eight letters equal those of the merges in order."""
    labels, merges = [b"a", b"b", b"c"], []
    for _ in range(data.draw(st.integers(0, 9))):
        u, v = data.draw(st.sampled_from(labels)), data.draw(st.sampled_from(labels))
        if u + v not in labels:
            labels.append(u + v)
            merges.append((u, v))
    m = bpe_automaton.Automaton(labels, [(labels.index(a), labels.index(b), labels.index(a + b)) for a, b in merges], {})
    for _ in range(30):
        word = bytes(data.draw(st.lists(st.sampled_from(b"abc"), min_size=1, max_size=12)))
        assert [labels[i] for i in m.spell(word)] == merged(word, merges)
    # one path only: of all ways to spell a short word by pieces the automaton accepts exactly one
    word = bytes(data.draw(st.lists(st.sampled_from(b"abc"), min_size=1, max_size=6)))

    def paths(at, before):
        if at == len(word):
            return 1
        return sum(paths(at + len(x), i) for i, x in enumerate(labels) if m.target[i] >= 0 and word.startswith(x, at) and (before is None or m.follows(before, i)))

    assert paths(0, None) == 1


ODD = ["", " ", "a", "<|endoftext|>", "x <|endoftext|><|endoftext|>y", "<|endoftext", "it's we'll 'S", "\r\n\t \x0b\x0c\x85 　 \x1c", "a" * 5000, " " * 3001 + "x", "é́ \U0001f600\U0001f468‍\U0001f469 � \x00", "１２ Ⅷ ½ ٣٤", "ÅnBß" * 400]


def test_odd_texts_equal_the_library(machine, library):
    encode, decode = library
    rng = random.Random(3)
    texts = ODD + [b"".join(rng.choices(machine.labels, k=rng.randint(1, 7))).decode("utf-8", "replace") for _ in range(3000)]
    texts += ["".join(rng.choices("etaoinshrd l", k=rng.randint(1, 60))) for _ in range(3000)] + ["".join(chr(c) for c in range(i, i + 500) if not 0xD800 <= c < 0xE000) for i in range(0, 0x11000, 500)]
    for text, ids in zip(texts, encode(texts), strict=True):
        mine = machine.encode(text).tolist()
        assert mine == ids, text[:50]
        assert machine.decode(mine) == decode(ids) == text
    assert machine.decode([machine.labels.index(b"\xc3"), 65]) == decode([machine.labels.index(b"\xc3"), 65])


def test_rows(spark, library):
    """Nulls, repeated rows, clashing names, a very long text, no rows; ids decode to the text."""
    long = " ".join(f"word{i % 991}x{i}" for i in range(60_000)) + "z" * 200_000
    rows = [(i, t, "x", 1, "y", 2) for i, t in enumerate([*ODD, None, long])] + [(None,) * 6, (2, "a", "x", 1, "y", 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = bpe_automaton.encode_texts(df)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "text", "N_Tokens", "a.b", "ids", "decoded"]
    assert [r["ids"] for r in got] == library[0]([r["text"] or "" for r in got]) and all(r["decoded"] == (r["text"] or "") for r in got)
    back = bpe_automaton.decode_ids(out.drop("text")).collect()
    assert sorted(r["text"] for r in back) == sorted(r["text"] or "" for r in got)
    digests = bpe_automaton.encode_texts(df, digest=True)
    assert digests.columns == ["doc_id", "text", "ids", "a.b", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe_automaton.encode_texts(df.where("doc_id > 99")).count() == 0


def test_small_memory(monkeypatch, library):
    """What is kept of earlier words doesn't change a result."""
    monkeypatch.setattr(bpe_automaton, "KEPT", 4000)
    m = bpe_automaton.compile_vocabulary()
    texts = [f"alpha{i % 50} beta{i % 7} gamma{i}" for i in range(300)]
    assert [m.encode(t).tolist() for t in texts] == library[0](texts) and len(m.words) + len(m.old) < 100


def test_refused(tmp_path):
    with open(bpe_automaton.default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        p = tmp_path / "v.json"
        p.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe_automaton.compile_vocabulary(str(p))


def test_query(spark, sf_dir, library):
    text = {r["doc_id"]: r["text"] or "" for r in C.read(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = dict(zip(text, library[0](list(text.values())), strict=True))
    rows = queries.op13_bpe(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        x = ids[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(x), sha(",".join(map(str, x))), sha(library[1](x)))
