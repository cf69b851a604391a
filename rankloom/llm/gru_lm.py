"""Gated recurrent language model with a class-factored softmax, in numpy.

Tokens are words of a text (A-Z lower-cased) and an end after the last. The ``vocab`` most frequent training tokens have
an embedding each, all others share symbol 0. A hidden state of ``hidden`` units passes through a gated recurrent cell;
the next symbol's probability is that of its class times that within its class (``classes`` classes of symbols with
neighbouring ranks). A token under symbol 0 has a further factor (c + 1) / (rest + types + 1) from its training
count c, so the model's probabilities of all tokens, seen or not, sum to one.

Training covers every token of every training document once. Documents are dealt by a hash of id and text into
``ROUNDS`` rounds and, within a round, into shards of about ``SHARD_TOKENS`` tokens. In a round each shard starts from
the parameters of the round before, lays its documents end to end in ``LANES`` lanes and runs truncated backpropagation
over windows of ``STEPS`` tokens (the state is carried from a window to the next until the document ends); the shards'
parameters are then averaged, weighted by tokens, block by block on the executors. What is trained on, and what is moved,
grows with the input; how the input is partitioned does not matter, and a shard's training is the same at any scale.

Scoring runs many documents side by side in lanes; a lane's state is carried across windows until its document ends,
so a document of any length is scored whole. Counts of the ``COMMON`` most frequent tokens travel to the tasks; all others
are joined by token.

Defined results: a null or empty text is one end token; texts of any length are scored whole; repeated rows get equal
scores up to rounding (rows equal in id and text may be dealt to different shards, so only with such rows can the
partitioning show in the parameters); rows with a null id are in the fold of the empty text; without training documents
every token is unknown and the model is the initial one; an input column with the name of a result is replaced.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .tables import Workspace

FOLDS, HELD_OUT = 7, 2
END = b"\n"  # no word can be a line feed
#: Symbols, their classes (a divisor of them) and units of the state unless ``fit`` is told otherwise.
VOCAB, CLASSES, HIDDEN = 2048, 32, 16
STEPS, LANES, ROUNDS = 32, 128, 2
#: Training tokens of a shard, and tokens of a scoring run.
SHARD_TOKENS, SCORE_TOKENS = 3_000_000, 3_000_000
COMMON = 300_000
#: Longer tokens are never among them, so what travels is bounded in bytes as well.
COMMON_BYTES = 64
#: Bytes of words a task gathers before it counts them and passes the counts on.
FLUSH = 48 << 20
#: Blocks of the parameters that are averaged apart.
BLOCKS = 64
RATE = 0.01
#: Rows of logits and steps of states worked on at a time; what they take stays in the processor's cache.
PIECE, BLOCK = 1024, 4
ONE = np.ones((), np.float32)


def shapes(vocab: int = VOCAB, classes: int = CLASSES, hidden: int = HIDDEN) -> dict[str, tuple[int, ...]]:
    """Shapes of the parameters; row ``vocab`` of the embeddings is the start of a document."""
    if vocab % classes or not 0 < vocab < 1 << 15:
        raise ValueError("the number of classes has to divide that of symbols, which has 15 bits at most")
    per = vocab // classes
    return {"x": (vocab + 1, 3 * hidden), "u": (hidden, 3 * hidden), "wc": (hidden, classes), "bc": (classes,), "wo": (classes, hidden, per), "bo": (classes, per)}


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.translate(C.LOWER_BYTES).split(), END]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and their number in each text: ``tokens_of`` without the ends, by Arrow's kernels, which make no object of a word."""
    if pa.types.is_binary(texts.type):
        texts = texts.view(pa.string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, ends = split.flatten(), split.offsets.to_numpy()
    full = pc.greater(pc.binary_length(words), 0)  # white space before or after a text leaves an empty word
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[ends - ends[0]]
    return words.filter(full).view(pa.binary()), np.diff(before)


def _places(words: pa.ChunkedArray, n: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The place among ``known`` of each token, ends included, or -1; and where the texts' ends lie among the tokens."""
    at, ends = np.empty(len(words) + len(n), np.int32), np.cumsum(n + 1) - 1
    word = np.ones(len(at), bool)
    word[ends] = False
    at[word] = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
    end = pc.index_in(pa.scalar(END, pa.binary()), value_set=known).as_py()
    at[ends] = -1 if end is None else end
    return at, ends


# the model


def initial(freq: np.ndarray, classes: int = CLASSES, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; output biases are the logarithms of the symbols' training frequencies."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * (0.3 if k == "u" else 0.1)).astype(np.float32) for k, s in shapes(len(freq), classes, hidden).items()}
    f = (freq + 1).reshape(classes, -1)
    p["bc"] = np.log(f.sum(1) / f.sum()).astype(np.float32)
    p["bo"] = np.log(f / f.sum(1, keepdims=True)).astype(np.float32)
    return p


class Room:
    """Arrays by name, kept from one call to the next. New ones of their size come from the system each time, and its page faults took half of the time."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}
        self.shaped: dict[tuple, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], dtype=np.float32) -> np.ndarray:
        out = self.shaped.get((name, shape, dtype))
        if out is None:
            size, a = math.prod(shape), self.held.get(name)
            if a is None or len(a) < size or a.dtype != dtype:
                a = self.held[name] = np.empty(size, dtype)
                self.shaped = {k: v for k, v in self.shaped.items() if k[0] != name}  # they lay in the former one
            if len(self.shaped) > 2000:
                self.shaped.clear()
            out = self.shaped[name, shape, dtype] = a[:size].reshape(shape)
        return out

    def copy(self, name: str, a: np.ndarray) -> np.ndarray:
        out = self(name, a.shape, a.dtype)
        out[...] = a
        return out


def _sizes(p) -> tuple[int, int, int, int]:
    """Symbols, units, classes and symbols of a class."""
    classes, hidden, per = p["wo"].shape
    return len(p["x"]) - 1, hidden, classes, per


def _sig(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _cell(p, a, h):
    """The state after an input whose embeddings are ``a``, and both gates and the proposal."""
    n = h.shape[1]
    zr = _sig(a[:, : 2 * n] + h @ p["u"][:, : 2 * n])
    z, r = zr[:, :n], zr[:, n:]
    g = np.tanh(a[:, 2 * n :] + (r * h) @ p["u"][:, 2 * n :])
    return h + z * (g - h), z, r, g


def _scaled(p) -> tuple[np.ndarray, np.ndarray]:
    """The state's weights as ``_advance`` takes them."""
    n = p["u"].shape[0]
    return np.ascontiguousarray(p["u"][:, : 2 * n].T) * np.float32(-1), np.ascontiguousarray(p["u"][:, 2 * n :].T)


_halved = _scaled  # its former name


def _table(p, room: Room) -> np.ndarray:
    """The embeddings, their gates' part negated."""
    n = p["u"].shape[0]
    return np.multiply(p["x"], np.repeat(np.float32([-1, 1]), [2 * n, n]), out=room("table", p["x"].shape, p["x"].dtype))


def _inputs(p, x: np.ndarray, room: Room | None = None, table: np.ndarray | None = None) -> np.ndarray:
    """The inputs' rows of ``_table`` as (steps, units, lanes)."""
    room = room or Room()
    table = _table(p, room) if table is None else table
    rows = np.take(table, x, axis=0, out=room("rows", (*x.shape, table.shape[1]), table.dtype), mode="clip")
    return room.copy("inputs", rows.transpose(0, 2, 1))


def _advance(uz, ug, a, h, zr, g, out):
    """``_cell`` into arrays given for the gates, the proposal and the state, with units before lanes, so that each is a whole block of memory.

    A gate is 1 / (1 + exp(-x)), which takes less time than a hyperbolic tangent, with the sign in the weights. Where an exponential is infinite the gate
    is 0, as it should be.
    """
    n = len(h)
    np.dot(uz, h, out=zr)
    zr += a[: 2 * n]
    np.exp(zr, out=zr)
    np.add(zr, ONE, out=zr)
    np.reciprocal(zr, out=zr)
    np.multiply(zr[n:], h, out=out)
    np.dot(ug, out, out=g)
    g += a[2 * n :]
    np.tanh(g, out=g)
    np.subtract(g, h, out=out)
    out *= zr[:n]
    out += h
    return out


def _exps(a: np.ndarray, pick: np.ndarray, far: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of the rows of ``a`` (in its place), their sums, the one picked of each row before, and its flat places. Rows are shifted only if ``far``."""
    if far:
        a -= a.max(1, keepdims=True)
    at = np.arange(0, a.size, a.shape[1])
    at += pick
    picked = a.reshape(-1)[at]
    np.exp(a, out=a)
    return a, a @ np.ones(a.shape[1], a.dtype), picked, at


def _by_class(cls: np.ndarray, classes: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The rows in the order of their classes, and the stretch of each class that has any."""
    order = np.argsort(cls.astype(np.uint8 if classes <= 256 else np.int16), kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=classes))]).tolist()
    return order, [(c, slice(ends[c], ends[c + 1])) for c in range(classes) if ends[c] < ends[c + 1]]


def _biased(p, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """The output weights with the biases as a last row, which meets the 1 that ends a row of ``_states``."""
    _, n, classes, per = _sizes(p)
    wc, wo = room("wc", (n + 1, classes), p["wc"].dtype), room("wo", (classes, n + 1, per), p["wo"].dtype)
    wc[:n], wc[n], wo[:, :n], wo[:, n] = p["wc"], p["bc"], p["wo"], p["bo"]
    return wc, wo


def _states(h: np.ndarray, room: Room) -> np.ndarray:
    """States (..., units) as rows that end with a 1."""
    rows = room("states", (h.size // h.shape[-1], h.shape[-1] + 1), h.dtype)
    rows[:, :-1].reshape(*h.shape)[...] = h
    rows[:, -1] = 1
    return rows


def _far(most: float, *weights: np.ndarray) -> list[bool]:
    """Whether some logit of states up to ``most`` could be so far from 0 that sums of exponentials could overflow or vanish; told without a pass over them."""
    return [bool(most * np.abs(w).sum(-2).max() > 60) for w in weights]


def _pieces(spans: list[tuple[int, slice]], rows: int):
    """Stretches of ``PIECE`` rows in the order of classes, each with its classes and where they lie in it: what is done to a stretch stays in the processor's cache."""
    k = 0
    for start in range(0, rows, PIECE):
        end, own = min(start + PIECE, rows), []
        while k < len(spans) and spans[k][1].start < end:
            c, at = spans[k]
            own.append((c, slice(max(at.start, start) - start, min(at.stop, end) - start)))
            if at.stop > end:
                break
            k += 1
        yield slice(start, end), own


def _within(wo, mine: np.ndarray, own: list[tuple[int, slice]], room: Room) -> np.ndarray:
    """Logits within their class of a stretch of states, all in one array: what follows is done once for all classes."""
    out = room("within", (len(mine), wo.shape[2]), np.result_type(mine, wo))
    for c, at in own:
        np.matmul(mine[at], wo[c], out=out[at])
    return out


def _log_probability(p, states: np.ndarray, y: np.ndarray, room: Room) -> np.ndarray:
    _, _, classes, per = _sizes(p)
    cls, word = y // per, y % per
    wc, wo = _biased(p, room)
    far, far_within = _far(np.abs(states).max(initial=1), wc, wo)
    order, spans = _by_class(cls, classes)
    cls, word = cls[order], word[order]
    states = np.take(states, order, axis=0, out=room("own", states.shape, states.dtype), mode="clip")
    logs = room("logs", (len(y),), np.result_type(states, wo))
    for at, own in _pieces(spans, len(y)):
        mine = states[at]
        _, total, picked, _ = _exps(np.matmul(mine, wc, out=room("classes", (len(mine), classes), logs.dtype)), cls[at], far)
        _, within, also, _ = _exps(_within(wo, mine, own, room), word[at], far_within)
        # apart: the product of two sums could overflow
        logs[at] = picked + also - np.log(total) - np.log(within)
    out = np.empty_like(logs)
    out[order] = logs
    return out


def log_probability(p: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray, room: Room | None = None) -> np.ndarray:
    """Natural log probability of the symbols ``y`` after the states ``h``."""
    room = room or Room()
    return _log_probability(p, _states(h, room), y, room)


def gradient(p, x, y, mask, h0, room: Room | None = None, with_loss: bool = True) -> tuple[dict, np.ndarray, float]:
    """Gradient of the mean loss over one window (steps, lanes), the last state, and the loss. The state starts anew at the input that begins a document.

    The gradient lies in ``room`` until the next call with it. The loss is 0 unless ``with_loss``.
    """
    (steps, lanes), (vocab, n, classes, per), room = x.shape, _sizes(p), room or Room()
    kind = np.result_type(h0, p["u"])
    d = {k: room(f"d_{k}", a.shape) for k, a in p.items()}
    table, fresh, h, (uz, ug) = _table(p, room), x == vocab, np.ascontiguousarray(h0.T), _scaled(p)
    begins, going = fresh.any(1).tolist(), (~fresh).astype(kind)
    before, zr, g = (room(name, (steps, k * n, lanes), kind) for name, k in (("before", 1), ("zr", 2), ("g", 1)))
    states = room("states", (steps, lanes, n + 1), kind)
    states[:, :, n] = 1
    with np.errstate(over="ignore"):
        for t in range(0, steps, BLOCK):
            at = slice(t, t + BLOCK)
            inputs = _inputs(p, x[at], room, table)
            hs = room("hs", (len(inputs), n, lanes), kind)
            for a, old, gates, own, new, goes in zip(inputs, before[at], zr[at], g[at], hs, going[at]):
                h = _advance(uz, ug, a, np.multiply(h, goes, out=old), gates, own, new)
            states[at, :, :n] = hs.transpose(0, 2, 1)
    last, states = h.T.copy(), states.reshape(-1, n + 1)
    yy, m = y.ravel(), mask.ravel()
    scale = (m / max(m.sum(), 1)).astype(np.float32)
    cls = yy // per
    order, spans = _by_class(cls, classes)
    cls, word, scale = cls[order], (yy % per)[order], scale[order]
    wc, wo = _biased(p, room)
    far, far_within = _far(np.abs(h0).max(initial=1), wc, wo)  # no later state goes beyond 1 or the first
    states = np.take(states, order, axis=0, out=room("own", states.shape, states.dtype), mode="clip")
    down, more = room("down", (len(yy), n), kind), room("more", (min(len(yy), PIECE), n), kind)
    d_wc, d_wo, loss = room("d_wc+", (classes, n + 1)), room("d_wo+", (classes, per, n + 1)), 0.0
    for a in (d_wc, d_wo, d["x"]):
        a[...] = 0

    def pull(a, pick, share, far):
        """Gradient by the logits, and the loss."""
        e, total, picked, at = _exps(a, pick, far)
        lost = float(((np.log(total) - picked) * share).sum()) if with_loss else 0.0
        e *= (share / total)[:, None]
        e.reshape(-1)[at] -= share
        return e, lost

    for at, own in _pieces(spans, len(yy)):
        mine, share = states[at], scale[at]
        back, lost = pull(np.matmul(mine, wc, out=room("classes", (len(mine), classes), kind)), cls[at], share, far)
        d_wc += back.T @ mine
        np.matmul(back, p["wc"].T, out=down[at])
        back, lost_within = pull(_within(wo, mine, own, room), word[at], share, far_within)
        loss += lost + lost_within
        for c, here in own:
            part = back[here]
            d_wo[c] += part.T @ mine[here]
            np.matmul(part, p["wo"][c].T, out=more[here])
        down[at] += more[: len(mine)]
    d["wc"][...], d["bc"][...], d["wo"][...], d["bo"][...] = d_wc[:, :n].T, d_wc[:, n], d_wo[:, :, :n].transpose(0, 2, 1), d_wo[:, :, n]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    d["u"][...] = 0
    back, dm, rows = np.zeros((n, lanes), kind), np.empty((n, lanes), kind), room("das_rows", (steps, lanes, 3 * n), kind)
    uz, ug = np.ascontiguousarray(p["u"][:, : 2 * n]), np.ascontiguousarray(p["u"][:, 2 * n :])
    for start in reversed(range(0, steps, BLOCK)):
        at = slice(start, start + BLOCK)
        old, z, r, own = before[at], zr[at, :n], zr[at, n:], g[at]
        dh = np.take(down, place[start * lanes : (start + BLOCK) * lanes], axis=0).reshape(len(old), lanes, n)
        dh = room.copy("dh", dh.transpose(0, 2, 1))
        das = room("das", (len(old), 3 * n, lanes), kind)
        to_z, to_r, to_g, keep, rb = (room(name, old.shape, kind) for name in ("to_z", "to_r", "to_g", "keep", "rb"))
        np.subtract(1, z, out=keep)
        np.multiply(own, own, out=to_g)
        np.subtract(1, to_g, out=to_g)
        to_g *= z
        np.subtract(own, old, out=to_z)
        to_z *= z
        to_z *= keep
        np.multiply(r, old, out=rb)
        np.subtract(1, r, out=to_r)
        to_r *= rb
        for t in reversed(range(len(old))):
            dt, da = dh[t], das[t]
            dt += back
            np.multiply(dt, to_z[t], out=da[:n])
            proposed = np.multiply(dt, to_g[t], out=da[2 * n :])
            np.dot(ug, proposed, out=dm)
            np.multiply(dm, to_r[t], out=da[n : 2 * n])
            np.dot(uz, da[: 2 * n], out=back)
            dt *= keep[t]
            dm *= r[t]
            back += dt
            back += dm
            if begins[start + t]:
                back *= going[start + t]
        d["u"][:, : 2 * n] += np.matmul(das[:, : 2 * n], old.transpose(0, 2, 1)).sum(0).T
        d["u"][:, 2 * n :] += np.matmul(das[:, 2 * n :], rb.transpose(0, 2, 1)).sum(0).T
        rows[at] = das.transpose(0, 2, 1)
    rows, x = rows.reshape(-1, 3 * n), x.ravel()
    d["x"][0] = (x == 0).astype(kind) @ rows  # about half of all
    order = np.argsort(x.astype(np.int16), kind="stable")
    _add_rows(d["x"], x, order[np.count_nonzero(x == 0) :], rows)
    return d, last, loss


def _add_rows(out: np.ndarray, symbol: np.ndarray, order: np.ndarray, rows: np.ndarray) -> None:
    """Puts the sum of each symbol's rows into its row of ``out``; ``order`` has a symbol's rows together. Most symbols have a row or two, for which sums by
    stretches are slow."""
    if not len(order):
        return
    symbol = symbol[order]
    new = np.ones(len(order), bool)
    np.not_equal(symbol[1:], symbol[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    size = np.diff(starts, append=len(symbol))
    symbol, many = symbol[starts], size > 2
    few = ~many
    one, two = rows[order[starts[few]]], size[few] == 2
    one[two] += rows[order[starts[few][two] + 1]]
    out[symbol[few]] = one
    if many.any():
        part = rows[order[np.repeat(many, size)]]
        size = size[many]
        out[symbol[many]] = np.add.reduceat(part, np.cumsum(size) - size, axis=0)


class Adam:
    """Moments are kept as sums, ten and a thousand times themselves, which saves passes over the parameters."""

    def __init__(self, p):
        self.p, self.t = p, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))

    def step(self, d):
        self.t += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in d.values()))
        fix = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        rate = np.float32(0.1 / np.sqrt(0.001) * RATE * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        least = np.float32(1e-8 / np.sqrt(0.001))
        for k, g in d.items():
            m, v = self.m[k], self.v[k]
            if fix < 1:
                g *= fix
            m *= np.float32(0.9)
            m += g
            g *= g
            v *= np.float32(0.999)
            v += g
            np.sqrt(v, out=g)
            g += least
            np.divide(m, g, out=g)
            g *= rate
            self.p[k] -= g


def _grid(docs: list[np.ndarray], lanes: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """Inputs and symbols (time, lane), the length of each lane and its documents' numbers, the longest lane first.

    Lanes are about equally long (the longest document goes first to the shortest lane) and have their documents mixed.
    """
    dealt: list[list[int]] = [[] for _ in range(min(lanes, len(docs)))]
    load = [(0, k) for k in range(len(dealt))]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        held, k = heapq.heappop(load)
        dealt[k].append(i)
        heapq.heappush(load, (held + len(docs[i]), k))
    dealt = [[lane[i] for i in np.random.default_rng(k).permutation(len(lane))] for k, lane in enumerate(dealt)]
    size = np.array([sum(len(docs[i]) for i in lane) for lane in dealt], np.int64)
    order = np.argsort(-size, kind="stable")
    size, dealt = size[order], [dealt[k] for k in order]
    x, y = (np.zeros((len(dealt), int(size.max(initial=0))), np.int16) for _ in range(2))
    for k, lane in enumerate(dealt):
        y[k, : size[k]] = np.concatenate([docs[i] for i in lane])
        x[k, 1 : size[k]] = y[k, : size[k] - 1]
        x[k, np.cumsum([0, *[len(docs[i]) for i in lane[:-1]]])] = start
    return np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), size, dealt


def train(p: dict, docs: list[np.ndarray]) -> tuple[dict, int]:
    """Truncated backpropagation over whole documents; the parameters and the tokens seen.

    A step takes half a full window's tokens at least: where few lanes are left, several windows make one.
    """
    p = {k: a.copy() for k, a in p.items()}
    adam, held, total, (vocab, n, _, _), room = Adam(p), 0, {}, _sizes(p), Room()
    x, y, size, lanes = _grid(docs, LANES, vocab)
    h = np.zeros((len(lanes), n), np.float32)
    for t in range(0, len(y), STEPS):
        live = int((size > t).sum())
        a, b = (w[t : t + STEPS, :live].astype(np.int64) for w in (x, y))
        mask = (t + np.arange(len(a))[:, None] < size[:live]).astype(np.float32)
        d, h, _ = gradient(p, a, b, mask, h[:live], room, with_loss=False)
        more = int(mask.sum())
        total = d if not held else {k: (total[k] * held + d[k] * more) / (held + more) for k in d}
        held += more
        if 2 * held >= STEPS * LANES:
            adam.step(total)
            held = 0
        else:  # the next window's gradient comes into the same room
            total = {k: a.copy() for k, a in total.items()}
    if held:
        adam.step(total)
    return p, int(size.sum())


def score(p: dict, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each symbol sequence, its end included. Lanes and windows don't matter to it: there are as many lanes as the longest one
    leaves full, and a window is the longer the fewer there are."""
    vocab, n, _, _ = _sizes(p)
    fair = sum(map(len, docs)) // max(map(len, docs), default=1)
    x, y, size, lanes = _grid(docs, min(max(fair, LANES), 8 * LANES), vocab)
    logs = np.zeros(y.shape, np.float32)
    h = np.zeros((n, len(lanes)), np.float32)
    (uz, ug), room = _scaled(p), Room()
    table = _table(p, room)
    t = 0
    while t < len(y):
        live = int((size > t).sum())
        end = t + max(1, 2 * STEPS * LANES // live)
        a, b, h = x[t:end, :live].astype(np.int64), y[t:end, :live].astype(np.int64), h[:, :live]
        states, gates, g = room("states", (len(a), live, n + 1)), room("gates", (2 * n, live)), room("g", (n, live))
        states[:, :, n] = 1
        fresh, many = a == vocab, max(1, BLOCK * LANES // live)
        begins = fresh.any(1).tolist()
        with np.errstate(over="ignore"):
            for s in range(0, len(a), many):
                inputs = _inputs(p, a[s : s + many], room, table)
                hs = room("hs", (len(inputs), n, live))
                for own, new, some, anew in zip(inputs, hs, begins[s : s + many], fresh[s : s + many]):
                    h = _advance(uz, ug, own, h * ~anew if some else h, gates, g, new)
                states[s : s + many, :, :n] = hs.transpose(0, 2, 1)
                h = h.copy()  # it lies where the next block's states come
        logs[t:end, :live] = _log_probability(p, states.reshape(-1, n + 1), b.ravel(), room).reshape(b.shape)
        t = end
    out, logs = np.zeros(len(docs)), np.ascontiguousarray(logs.T)
    for k, lane in enumerate(lanes):
        out[lane] = np.add.reduceat(logs[k, : size[k]].astype(float), np.cumsum([0, *[len(docs[i]) for i in lane[:-1]]]))
    return out


# Spark


def _fold(text_id: DataFrame):
    return C.crc_mod(text_id, FOLDS) == HELD_OUT


def _step():
    return F.floor(F.log2("c") * 16)


def _is_common(least: int):
    return (F.octet_length("token") <= COMMON_BYTES) & (_step() >= least)


class LanguageModel:
    """Token counts of the training documents, the trained parameters, and the tokens trained on in each round."""

    def __init__(self, ws, counts, n, v, common, least, params, trained):
        self.ws, self.counts, self.n, self.v, self.common, self.least, self.params, self.trained = ws, counts, n, v, common, least, params, trained


def fit(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocab: int = VOCAB, classes: int = CLASSES, hidden: int = HIDDEN,
    rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS,
) -> LanguageModel:
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession)
    form = shapes(vocab, classes, hidden)
    C.small_batches(spark)
    source = docs.where(~_fold(F.col(id_col))).select(F.col(text_col).alias("text"))

    def count(batches):
        have, ends = [], 0

        def out():
            found = pa.chunked_array(have, pa.binary()).value_counts()
            names = ["token", "c"]
            for k in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays(found.slice(k, 50_000).flatten(), names=names)
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=names)

        for b in batches:
            words, n = words_of(b.column(0))
            have.append(words)
            ends += len(n)
            if sum(w.nbytes for w in have) > FLUSH:
                yield from out()
                have, ends = [], 0
        if ends:
            yield from out()

    counts = ws.save(source.mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "counts")
    v, n = counts.agg(F.count("*"), F.sum("c")).first()
    # how many tokens there are by step of count (16 steps a power of two), and from which step on they are COMMON at most
    steps = counts.where(F.octet_length("token") <= COMMON_BYTES).groupBy(_step().alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    many, least = 0, 1 << 30
    for r in steps:
        many += r["n"]
        if many > COMMON:
            break
        least = r["step"]
    common = sorted(((bytes(r[0]), r[1]) for r in counts.where(_is_common(least)).collect()), key=lambda x: (-x[1], x[0]))  # COMMON rows at most
    head = common[: vocab - 1]
    freq = np.array([(n or 0) - sum(c for _, c in head), *(c for _, c in head)] + [0] * (vocab - 1 - len(head)), float)
    params = initial(freq, classes, hidden)
    symbols = pa.array([t for t, _ in head], pa.binary())
    shards = max(1, -(-(n or 0) // (rounds * shard_tokens)))
    key = F.xxhash64(F.col(id_col).cast("string"), text_col)
    keyed = docs.where(~_fold(F.col(id_col))).select(F.col(text_col).alias("text"), key.alias("key"))

    def deal(batches):
        met: Counter = Counter()
        for b in batches:
            (words, n), keys, shard = words_of(b.column(0)), b.column(1).to_pylist(), []
            for k in keys:  # rows equal in id and text go to different shards
                shard.append((k // rounds + met[k]) % shards)
                met[k] += 1
            at = (_places(pa.chunked_array([words]), n, symbols)[0] + 1).astype(np.int16)  # symbol 0 is what isn't among them
            ends = np.concatenate([[0], np.cumsum(n + 1) * at.itemsize]).astype(np.int32)
            s = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(at)])
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), b.column(1), s], names=["shard", "key", "s"])

    size, trained = sum(int(np.prod(s)) for s in form.values()), []
    groups = max(1, int(np.sqrt(shards)))
    def learner(shared):
        def learn(table: pa.Table) -> pa.Table:
            keys, rows = table["key"].to_numpy(), table["s"].to_pylist()
            p, seen = train(shared.value, [np.frombuffer(rows[i], np.int16) for i in np.argsort(keys, kind="stable")])
            parts = np.array_split(np.concatenate([p[k].ravel() for k in form]), BLOCKS)
            return pa.table([pa.array([table["shard"][0].as_py()] * BLOCKS, pa.int64()), pa.array(range(BLOCKS), pa.int32()), pa.array([seen] * BLOCKS, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["shard", "block", "seen", "w"])

        return learn

    def average(table: pa.Table) -> pa.Table:
        shard, seen, rows = table["shard"].to_numpy(), table["seen"].to_numpy(), table["w"]
        total = 0.0
        for i in np.argsort(shard, kind="stable"):
            total = total + np.frombuffer(rows[int(i)].as_py(), np.float32).astype(float) * seen[i]
        return pa.table([pa.array([int(shard.min())], pa.int64()), table["block"].slice(0, 1).combine_chunks(), pa.array([int(seen.sum())], pa.int64()), pa.array([(total / seen.sum()).astype(np.float32).tobytes()], pa.binary())], names=["shard", "block", "seen", "w"])

    for r in range(rounds):
        shared = spark.sparkContext.broadcast(params)
        schema = "shard long, block int, seen long, w binary"
        local = keyed.where(F.pmod("key", F.lit(rounds)) == r).mapInArrow(deal, "shard long, key long, s binary").groupBy("shard").applyInArrow(learner(shared), schema)
        local = ws.save(local, f"round{r}")
        # first within groups of shards, then over the groups: a task holds about the square root of their number
        some = local.withColumn("g", F.col("shard") % groups).groupBy("block", "g").applyInArrow(lambda t: average(t.drop_columns("g")), schema)
        rows = some.groupBy("block").applyInArrow(average, schema).orderBy("block").collect()  # the parameters
        ws.drop(f"round{r}")
        trained.append(rows[0]["seen"] if rows else 0)
        if rows:
            flat, at = np.concatenate([np.frombuffer(x["w"], np.float32) for x in rows]), 0
            assert len(flat) == size
            for k, s in form.items():
                params[k] = flat[at : at + int(np.prod(s))].reshape(s)
                at += int(np.prod(s))
    return LanguageModel(ws, counts, n or 0, v or 0, common, least, params, trained)


def score_documents(docs: DataFrame, lm: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark, ws = docs.sparkSession, lm.ws
    results = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = C.kept(docs.columns if keep is None else keep, results)
    n, v = lm.n, lm.v
    vocab = len(lm.params["x"]) - 1
    head = lm.common[: vocab - 1]
    rest_n, rest_v = n - sum(c for _, c in head), v - len(head)
    shared = spark.sparkContext.broadcast((lm.params, pa.array([t for t, _ in lm.common], pa.binary()), np.array([c for _, c in lm.common], float)))
    kept = T.StructType([docs.schema[c] for c in keep] + [T.StructField("held_out", T.BooleanType())])
    src = docs.select(*[C.col(c).alias(f"__{i}") for i, c in enumerate(keep)], _fold(C.col(id_col)).alias("held_out"), C.col(text_col).alias("__text"))
    schema = T.StructType([*kept.fields, T.StructField("__key", T.LongType()), T.StructField("__token", T.BinaryType()), T.StructField("__k", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    width = len(kept.fields)

    def run(batches):
        params, common, c = shared.value
        base = np.append(np.log10((c + 1) / (n + v + 1)), 0)  # the last for tokens that aren't common: their place is -1
        under = np.append(np.log10((c + 1) / (rest_n + rest_v + 1)), 0)  # factor under symbol 0
        under[: vocab - 1] = 0
        next_key = TaskContext.get().partitionId() << 36
        pending, words, sizes, held = [], [], [], 0

        def flush():
            nonlocal next_key
            all_words, size = pa.chunked_array(words, pa.binary()), np.concatenate(sizes)
            at, ends = _places(all_words, size, common)
            starts = ends - size
            ll = score(params, np.split(np.where(at < vocab - 1, at + 1, 0).astype(np.int16), ends[:-1] + 1)) / np.log(10)
            ll += np.add.reduceat(under[at], starts)
            known, bases = np.add.reduceat((at >= 0).astype(np.int64), starts), np.add.reduceat(base[at], starts)
            keys = np.arange(next_key, next_key + len(size))
            next_key += len(size)
            k = 0
            for batch in pending:
                own = slice(k, k := k + batch.num_rows)
                cols = [*batch.columns, pa.array(keys[own]), pa.nulls(batch.num_rows, pa.binary()), pa.nulls(batch.num_rows, pa.int64())]
                cols += [pa.array(x[own]) for x in ((size + 1).astype(np.int64), known, bases, ll)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
            missing = np.delete(at, ends) < 0
            rare, of = all_words.filter(pa.array(missing)), np.repeat(keys, size)[missing]
            if at[ends[0]] < 0:  # the end itself isn't common
                rare, of = pa.chunked_array([*rare.chunks, pa.array([END] * len(keys), pa.binary())], pa.binary()), np.concatenate([of, keys])
            found = pa.table({"key": of, "token": rare}).group_by(["key", "token"], use_threads=False).aggregate([([], "count_all")])
            for part in found.to_batches(50_000):
                many = part.num_rows
                cols = [pa.nulls(many, column.type) for column in pending[0].columns]
                cols += [part["key"], part["token"], part["count_all"], *[pa.nulls(many, pa.int64())] * 2, *[pa.nulls(many, pa.float64())] * 2]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
            for held_for_it in (pending, words, sizes):
                held_for_it.clear()

        for batch in batches:
            own, size = words_of(batch.column(width))
            pending.append(batch.select(list(range(width))))
            words.append(own)
            sizes.append(size)
            held += len(own) + len(size)
            if held >= SCORE_TOKENS:
                yield from flush()
                held = 0
        if held:
            yield from flush()

    both = ws.save(src.mapInArrow(run, schema), f"scored-{uuid.uuid4().hex}")
    rows = both.where("__token is null").drop("__token", "__k")
    rare = both.where("__token is not null").select("__key", "__token", "__k")
    less = lm.counts.where(~_is_common(lm.least))  # the others never are rare
    rare = rare.join(less, rare["__token"] == less["token"], "left").select("__key", "__k", F.coalesce("c", F.lit(0)).alias("c"))
    sums = rare.groupBy("__key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("__k")).otherwise(0)).alias("k"),
        F.sum(F.col("__k") * F.log10((F.col("c") + 1.0) / float(n + v + 1))).alias("b"),
        F.sum(F.col("__k") * F.log10((F.col("c") + 1.0) / float(rest_n + rest_v + 1))).alias("s"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    return rows.join(sums, "__key", "left").select(
        *[C.col(c) for c in keep], "held_out", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"),
    )
