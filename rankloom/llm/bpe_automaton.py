"""Byte-pair encoding and decoding by a tokenization automaton.

The automaton reads pieces and starts as one state with an arc for each byte. The merges are put in one after the other, each by its
gadget: where an arc ``u`` leads to a state with an arc ``v``, the arc ``uv`` is added beside ``u`` with ``v``'s target, and the arcs ``u`` are led to a copy
of that state that lacks ``v``. It stays deterministic, and of all ways to spell a word by pieces exactly one is a path from the start: the one
that applying the merges in their order gives.

By induction all arcs of a piece have the same target, and a state differs from the one it was copied from by the one piece it lacks. So a state
is kept as (copied from, lacks, when), which is a row a merge, and a piece as (left part, right part, when, target); a transition is looked up in these
tables: an arc ``uv`` leaves a state if ``u`` left it, or what it was copied from, when ``uv`` was made, and no later copy lost ``uv``.
Written out, the arcs would be pieces squared. A word is encoded by following, from each place, the arcs that spell the bytes ahead (a trie of the arc labels), the longest
first, and stepping back where none goes on; a place has one path that leads to it, so none is entered twice. Decoding emits the labels of the arcs.

Texts are cut into words by the pattern of the byte-level vocabularies, after the added tokens have been cut out. Words repeat, so their pieces are kept, in two
generations of at most ``KEPT`` bytes of words and pieces each; a word longer than ``LONG_WORD`` bytes is never kept. Memory is bounded by these, the tables, and one batch of texts.

Defined results: a null text is empty and has no pieces; texts and words of any length are encoded whole, in time proportional to their length;
equal rows get equal results; an empty table gives an empty result; other columns pass through, those named like a result give way.
Vocabularies with dropout, prefixes, unknown pieces, normalisers, one piece from two merges, or added tokens that strip or need whole words are refused.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Fixed value: how byte-level vocabularies cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of words and pieces a worker keeps in each of two generations; longest word kept.
KEPT, LONG_WORD = 96 << 20, 256
_NEVER = 1 << 40


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself where it is printable Latin-1, else the next free one from 256 on."""
    out, free = {}, 256
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 255 and b != 173
        out[chr(b if shown else free)] = b
        free += not shown
    return out


class Automaton:
    """``labels``: bytes of each piece by id; ``merges``: (left, right, whole) ids in order; ``added``: ids of texts cut out beforehand."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], added: dict[str, int]):
        self.labels, self.added = labels, added
        n = len(labels)
        self.left, self.right, self.made = [-1] * n, [-1] * n, [_NEVER] * n
        self.target = [-1] * n  # the state that the arcs of a piece lead to
        self.parent, self.lacks, self.born = [-1], [-1], [-1]  # the states; the first is the start
        self.lost: dict[int, int] = {}  # piece and lost successor to the merge that made the copy without it
        for i, b in enumerate(labels):
            if len(b) == 1 and i not in added.values():
                self.made[i], self.target[i] = -1, 0
        for when, (u, v, w) in enumerate(merges):
            self._gadget(when, u, v, w, n)
        self._trie()
        self.forget()

    def _gadget(self, when: int, u: int, v: int, w: int, n: int) -> None:
        if self.target[w] >= 0:
            raise ValueError("a piece of two merges")
        if self.target[u] < 0 or self.target[v] < 0 or not self.follows(u, v):
            return  # nothing reaches such a pair: the piece stays without arcs
        self.left[w], self.right[w], self.made[w] = u, v, when
        self.target[w] = self.target[v]
        self.parent.append(self.target[u])
        self.lacks.append(v)
        self.born.append(when)
        self.target[u] = len(self.born) - 1
        self.lost[u * n + v] = when

    def follows(self, before: int, piece: int) -> bool:
        """Whether the state behind ``before`` has an arc ``piece``: no copy on the state's line lost the piece, or a left part of it while that part
        was what the piece began with. The line of a state: the copies made for a piece, before that those of its right part up to when it was made."""
        n, left, right, made, lost = len(self.labels), self.left, self.right, self.made, self.lost
        until = _NEVER
        while piece >= 0:
            since, owner, bound = made[piece], before, _NEVER
            while owner >= 0:
                when = lost.get(owner * n + piece)
                if when is not None and since < when <= until and when < bound:
                    return False
                owner, bound = right[owner], made[owner]
            piece, until = left[piece], since
        return True

    def _trie(self) -> None:
        """Labels of arcs by byte: ``edges`` maps node * 256 + byte to a node, ``ends`` a node to its piece."""
        self.edges: dict[int, int] = {}
        self.ends = [-1]
        for i, label in enumerate(self.labels):
            if self.target[i] < 0:
                continue
            node = 0
            for b in label:
                key = node << 8 | b
                node = self.edges.get(key, 0)
                if not node:
                    node = self.edges[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = i
        self.longest = max(map(len, self.labels))
        self.whole = {label: i for i, label in enumerate(self.labels) if self.target[i] >= 0}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("edges", "ends", "whole", "longest", "words", "old", "held", "pairs", "cut")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._trie()
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.held = 0
        # a text of an added token is one match of its own
        added = "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True))
        self.cut = regex.compile(PATTERN).findall, regex.compile(f"({added})").split if added else None

    def spell(self, word: bytes) -> list[int]:
        """The pieces on the only path that spells ``word``."""
        one = self.whole.get(word)
        if one is not None:
            return [one]
        labels, size, n = self.labels, len(self.labels), len(word)
        edges, ends, pairs, longest = self.edges.get, self.ends, self.pairs.get, self.longest
        out: list[int] = []
        left: list[list[int]] = []  # the arcs at each place of the path that haven't been followed yet, longest last
        at, fresh = 0, True
        while at < n:
            if fresh:
                node, found = 0, []
                for b in word[at : at + longest]:
                    node = edges(node << 8 | b)
                    if node is None:
                        break
                    if ends[node] >= 0:
                        found.append(ends[node])
                left.append(found)
            found = left[-1]
            if not found:  # no way on from here: another arc to an earlier place
                left.pop()
                at -= len(labels[out.pop()])
                fresh = False
                continue
            piece, fresh = found.pop(), True
            if out:
                key = out[-1] * size + piece
                fresh = pairs(key)
                if fresh is None:
                    fresh = self.pairs[key] = self.follows(out[-1], piece)
            if fresh:
                out.append(piece)
                at += len(labels[piece])
        return out

    def _make(self, word: str) -> bytes:
        """The pieces of a word that isn't among those kept lately, as 32-bit numbers."""
        got = self.old.get(word)
        if got is None:
            raw = word.encode()
            got = np.array(self.spell(raw), np.int32).tobytes()
            if len(raw) > LONG_WORD:
                return got
        self.words[word] = got
        self.held += len(word) + len(got) + 200  # and what Python needs for an entry
        if self.held > KEPT:
            self.old, self.held = self.words.copy(), 0
            self.words.clear()
        if len(self.pairs) > KEPT >> 7:
            self.pairs.clear()
        return got

    def encode(self, text: str) -> np.ndarray:
        findall, split = self.cut
        get, make, out = self.words.get, self._make, []
        for k, part in enumerate(split(text) if split else [text]):
            if k % 2:
                out.append(np.int32(self.added[part]).tobytes())
            elif part:
                out += [get(w) or make(w) for w in findall(part)]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def compile_vocabulary(path: str | None = None) -> Automaton:
    """The automaton of a vocabulary file of the ``tokenizers`` library."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    byte_level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and (spec.get("decoder") or {}).get("type") == "ByteLevel"
    added = {a["content"]: a for a in spec.get("added_tokens") or []}
    if model.get("type") != "BPE" or not plain or not byte_level or spec.get("normalizer") or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added.values()):
        raise ValueError("only plain byte-level BPE vocabularies")
    letters, vocab = byte_letters(), model["vocab"]
    extra = {t: a["id"] for t, a in added.items()}
    labels = [b""] * (max([*vocab.values(), *extra.values()]) + 1)
    for t, i in vocab.items():
        labels[i] = bytes(letters[c] for c in t)
    for t, i in extra.items():
        labels[i] = t.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], extra)


def encode_texts(docs: DataFrame, *, vocabulary: str | None = None, text_col: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """Adds ids (array<int>) and decoded (the text of the ids); with ``digest`` n_tokens, ids_sha256 (of the decimal ids joined by commas)
    and decoded_sha256 stand for them."""
    shared = docs.sparkSession.sparkContext.broadcast(compile_vocabulary(vocabulary))  # a few MB, whatever the input
    names = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digest else [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def make():
        machine = shared.value

        def fn(texts):
            rows = []
            for b in texts:
                ids = machine.encode(b.decode("utf-8", "replace"))
                plain = ids.tolist()
                text = machine.decode(plain)
                rows.append((len(plain), sha(",".join(map(str, plain))), sha(text)) if digest else (ids, text))
            if digest:
                return [[r[i] for r in rows] for i in range(3)]
            offsets = np.cumsum([0] + [len(r[0]) for r in rows])
            flat = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())), [r[1] for r in rows]]

        return fn

    return C.map_texts(docs, text_col, make, T.StructType([T.StructField(n, t) for n, t in names]), docs.columns if keep is None else keep)


def decode_ids(docs: DataFrame, *, vocabulary: str | None = None, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds the text of each id sequence; null is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(compile_vocabulary(vocabulary))

    @F.pandas_udf("string")
    def decode(ids):
        return ids.map(lambda x: shared.value.decode([] if x is None else x))

    return docs.withColumn(out_col, decode(F.col(ids_col)))
