"""SentencePiece encoding and decoding by a weighted finite-state transducer.

``compile_model`` reads a model file and builds three parts. The normaliser rewrites the longest rule at each place (the
model's character map and space to U+2581, compiled to a trie with outputs), joins runs of spaces where the model asks for it
and puts the dummy prefix in front. The lexicon is a trie over the pieces whose final states put out a piece id. The byte
fallback is an arc that puts out a character's UTF-8 bytes where no piece covers it. ``encode`` composes them with an input and
takes the shortest path in the tropical semiring: arcs are relaxed from left to right, every state once.

For a unigram model an arc weighs minus the piece's log probability. A BPE model has no such weights: there the lexicon
is also composed with an acceptor over adjacent pieces, whose arcs weigh 0 for a pair that byte-pair merging (by merge ranks) leaves
apart and infinity for one that it merges across. A sequence is the BPE encoding of its text exactly if every adjacent
pair passes, so one path to each place has a finite weight and the shortest path is the encoding. Weights of pairs are worked out
lazily and kept.

No arc crosses a place between two characters that no piece holds side by side. Where no piece holds U+2581 after
another character, the starts of its runs are such places. The composition falls into segments there, and each distinct segment is composed once as long as it stays
among those last used (two generations of ``CACHE_BYTES``); a task leaves nothing behind.

Defined results: null and empty texts have no ids and decode to the empty text; U+2581 itself decodes to a space;
invalid UTF-8 is replaced first; texts of any length are encoded whole; repeated rows get equal results; round_trip is false
where the normaliser changes a text for good; an input column
with the name of a result is replaced. ``decode_ids``: null is empty, repeated rows get equal texts, the ids column stays.
Models that treat white space as a suffix or don't escape it, and BPE models with user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CACHE_BYTES, PAIRS = 48_000_000, 400_000
INF = float("inf")


def default_model() -> str:
    """Path of the installed 32k model; the package that holds it is optional, and not needed where a path is given."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(buf: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = buf[at : at + size]
            at += size
        yield key >> 3, value


def character_map(blob: bytes) -> dict[str, str]:
    """Rules of a precompiled character map: a double-array trie over UTF-8 and the texts that its values point to."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, texts, rules = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :], {}
    offset = (units >> 10) << ((units & (1 << 9)) >> 6)
    label, leaf = units & ((1 << 31) | 255), (units >> 8) & 1
    open_ = [(int(offset[0]), b"")]
    while open_:
        base, key = open_.pop()
        for c in range(1, 256):
            at = base ^ c
            if at >= len(units) or label[at] != c:
                continue
            own, path = at ^ int(offset[at]), key + bytes([c])
            if leaf[at]:
                value = int(units[own] & ((1 << 31) - 1))
                rules[path.decode()] = texts[value : texts.index(b"\0", value)].decode()
            open_.append((own, path))
    return rules


class Normaliser:
    """Longest rule at each place, runs of spaces joined on demand, spaces to U+2581, dummy prefix."""

    def __init__(self, rules: dict[str, str], dummy_prefix: bool, squeeze: bool):
        self.dummy_prefix, self.squeeze = dummy_prefix, squeeze
        self.arcs: list[dict[str, int]] = [{}]
        self.out: list[str | None] = [None]
        for k, v in rules.items():
            state = 0
            for ch in k:
                nxt = self.arcs[state].get(ch)
                if nxt is None:
                    nxt = self.arcs[state][ch] = len(self.arcs)
                    self.arcs.append({})
                    self.out.append(None)
                state = nxt
            self.out[state] = v

    def rewrite(self, text: str) -> str:
        """The composition of the text with the rules."""
        arcs, out, put, j, n = self.arcs, self.out, [], 0, len(text)
        if not arcs[0] or arcs[0].keys().isdisjoint(text):
            return text
        while j < n:
            state, end, new = 0, j + 1, text[j]
            for k in range(j, n):
                state = arcs[state].get(text[k])
                if state is None:
                    break
                if out[state] is not None:
                    end, new = k + 1, out[state]
            put.append(new)
            j = end
        return "".join(put)

    def __call__(self, text: str) -> str:
        text = self.rewrite(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE) if text else ""


class Transducer:
    """The compiled normaliser, lexicon and byte fallback."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool, rules: dict[str, str] | None = None, squeeze: bool = False):
        self.pieces, self.kind, self.dummy_prefix = pieces, kind, dummy_prefix
        self.normalise = Normaliser(rules or {}, dummy_prefix, squeeze)
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.lexicon = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        plain = [s for _, s, t in pieces if t == NORMAL]
        # a user-defined piece of a unigram model outweighs any way to spell it
        self.weight = [0.1 - len(p.encode()) * max(plain, default=0.0) if t == USER else -s for p, s, t in pieces]
        # trie: one dict of arcs per state; final[state] is the piece put out there
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        for p, i in self.lexicon.items():
            state = 0
            for ch in p:
                nxt = self.arcs[state].get(ch)
                if nxt is None:
                    nxt = self.arcs[state][ch] = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(-1)
                state = nxt
            self.final[state] = i
        multi = [p for p in self.lexicon if len(p) > 1]
        self.joined = set("".join(multi))
        self.bigrams = {p[k : k + 2] for p in multi for k in range(len(p) - 1)}
        self.local = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in multi)
        alone = "" if "\n" in self.joined else r"\n"
        self.cut = re.compile(rf"{alone or '(?!)'}|{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+")
        self.fallback_weight = -min(plain, default=0.0) + 10
        if kind == BPE:
            self._compile_merges()
        table = [b"" if t in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, _, t in pieces]
        self.out_bytes = table
        self.forget()

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "old": {}, "pairs": {}, "held": 0}

    def _compile_merges(self) -> None:
        """For each piece the chains along its edges: ids from single character to the piece, and when each is used up."""
        rank = self.weight  # minus score: the smaller merges first
        self.left: list[tuple] = [()] * len(self.pieces)
        self.right: list[tuple] = [()] * len(self.pieces)
        for p, i in sorted(self.lexicon.items(), key=lambda x: (len(x[0]), x[1])):
            split = self._last_merge(p)
            if split is None:
                self.left[i] = self.right[i] = ((p, INF),)
            else:
                a, b = (self.lexicon[x] for x in split)
                self.left[i] = (*self.left[a][:-1], (self.left[a][-1][0], rank[i]), (p, INF))
                self.right[i] = (*self.right[b][:-1], (self.right[b][-1][0], rank[i]), (p, INF))

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece that merging leaves for last; None for a single character or an unreachable piece."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(((self.weight[i], k) for k in range(len(parts) - 1) if (i := self.lexicon.get(parts[k] + parts[k + 1])) is not None and len(parts[k]) + len(parts[k + 1]) < len(piece)), default=None)
            if best is None:
                return None
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 and all(x in self.lexicon for x in parts) else None

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the pieces a and b side by side: no merge across their border ever comes first."""
        ca, cb, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, used_x), (y, used_y) = ca[i], cb[j]
            c = self.lexicon.get(x + y)
            if c is not None and (r := self.weight[c]) < used_x and r <= used_y:
                return False
            if used_x == used_y == INF:
                return True
            if used_x <= used_y:
                i += 1
            else:
                j += 1

    def shortest_path(self, text: str) -> list[int]:
        """Ids on the path of least weight through the composition with a normalised text."""
        last, start = self._relax(text, len(text))
        out: list[int] = []
        end = len(text)
        while end:
            piece, end = last[end], start[end]
            if piece >= 0:
                out.append(piece)
            else:
                raw = text[end].encode()
                out += [self.byte_id.get(b, self.unknown) for b in reversed(raw)] if self.byte_id else [self.unknown]
        return out[::-1]

    def _relax(self, text: str, n: int) -> tuple[list[int], list[int]]:
        """For each end the last piece (-1: byte fallback) of the path of least weight and that piece's start.

        Arcs are relaxed from left to right, which is a topological order of the composition. With a BPE model a state also
        knows its last piece; but all paths of finite weight to a place have the same one (the encoding of
        what is before it), so a place stands for one state there as well.
        """
        arcs, final, lexicon = self.arcs, self.final, self.lexicon
        dist, last, start = [0.0] + [INF] * n, [-1] * (n + 1), [0] * (n + 1)
        merges, size = self.kind == BPE, len(self.pieces)
        weight, borders, border = self.weight, self.pairs, self._border
        for j in range(n):
            here = dist[j]
            if here == INF:
                continue
            state, key = 0, last[j] * size if j else -1
            for end in range(j + 1, n + 1):
                state = arcs[state].get(text[end - 1])
                if state is None:
                    break
                piece = final[state]
                if piece < 0:
                    continue
                if not merges:
                    w = here + weight[piece]
                elif key < 0:
                    w = here
                else:
                    w = borders.get(key + piece)
                    w = here + (border(key, piece) if w is None else w)
                if w < dist[end]:
                    dist[end], last[end], start[end] = w, piece, j
            if text[j] not in lexicon and here + self.fallback_weight < dist[j + 1]:
                dist[j + 1], last[j + 1], start[j + 1] = here + self.fallback_weight, -1, j
        return last, start

    def _border(self, key: int, piece: int) -> float:
        """Weight of the acceptor's arc from one piece to the next, worked out when first met."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        w = self.pairs[key + piece] = 0.0 if self._apart(key // len(self.pieces), piece) else INF
        return w

    def _segment(self, seg: str) -> bytes:
        if self.held >= CACHE_BYTES:
            self.old, self.cache, self.held = self.cache, {}, 0
        out = self.old.get(seg)
        if out is None:
            pairs = self.bigrams
            cuts = [k for k in range(1, len(seg)) if seg[k - 1 : k + 1] not in pairs]
            if cuts:
                parts = [seg[a:b] for a, b in zip([0, *cuts], [*cuts, len(seg)])]
                out = b"".join([self.cache.get(p) or self._segment(p) for p in parts])
            else:
                out = array("i", self.shortest_path(seg)).tobytes()
        self.cache[seg] = out
        self.held += 2 * len(seg) + len(out) + 150  # the objects' own size
        return out

    def forget(self) -> None:
        """Frees what was kept of the texts so far."""
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[int, float] = {}
        self.held = 0

    def encode(self, text: str) -> np.ndarray:
        text = self.normalise(text)
        if self.local:
            get, make = self.cache.get, self._segment
            ids = np.frombuffer(b"".join([get(s) or make(s) for s in self.cut.findall(text)]), np.int32)
        else:
            ids = np.array(self.shortest_path(text), np.int32)
        if not self.byte_id and len(ids):  # neighbouring unknown characters are one unknown piece
            strange = ids == self.unknown
            ids = ids[~(strange & np.concatenate([[False], strange[:-1]]))]
        return ids

    def decode(self, ids) -> str:
        table = self.out_bytes
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def compile_model(path: str | None = None) -> Transducer:
    with open(path or default_model(), "rb") as f:
        buf = f.read()
    pieces, kind, norm, suffix = [], UNIGRAM, {}, 0
    for number, value in _fields(buf):
        if number == 1:
            x = dict(_fields(value))
            pieces.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            kind, suffix = trainer.get(3, UNIGRAM), trainer.get(24, 0)
        elif number == 3:
            norm |= dict(_fields(value))
    if kind not in (UNIGRAM, BPE) or suffix or not norm.get(5, 1) or kind == BPE and any(t in (USER, UNUSED) for *_, t in pieces):
        raise ValueError("only unigram and BPE models with escaped white space before words, and BPE models of normal pieces")
    return Transducer(pieces, kind, bool(norm.get(3, 1)), character_map(norm.get(2, b"")), bool(norm.get(4, 1)))


def encode_texts(docs: DataFrame, *, model: str | None = None, text_col: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """Adds ids (array<int>) and round_trip (decoding gives the text again); with ``digest`` n_ids and ids_sha256
    (of the little-endian 32-bit ids) stand for ids."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(compile_model(model))  # a few MB, whatever the input
    first = [T.StructField("n_ids", T.LongType()), T.StructField("ids_sha256", T.StringType())] if digest else [T.StructField("ids", T.ArrayType(T.IntegerType()))]

    def make():
        fst = shared.value

        def fn(texts):
            ids, good = [], []
            for b in texts:
                text = b.decode("utf-8", "replace")
                x = fst.encode(text)
                ids.append((len(x), hashlib.sha256(x.tobytes()).hexdigest()) if digest else x)
                good.append(fst.decode(x.tolist()) == text)
            if digest:
                return [[n for n, _ in ids], [h for _, h in ids], good]
            offsets = np.cumsum([0] + [len(x) for x in ids])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())), good]

        fn.done = fst.forget
        return fn

    return C.map_texts(docs, text_col, make, T.StructType([*first, T.StructField("round_trip", T.BooleanType())]), docs.columns if keep is None else keep)


def decode_ids(docs: DataFrame, *, model: str | None = None, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds the text of each id sequence; null is empty."""
    from pyspark.sql import functions as F

    shared = docs.sparkSession.sparkContext.broadcast(compile_model(model))

    @F.pandas_udf("string")
    def decode(ids):
        return ids.map(lambda x: shared.value.decode([] if x is None else x))

    return docs.withColumn(out_col, decode(F.col(ids_col)))
