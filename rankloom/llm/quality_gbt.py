"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Every text is reduced to counts (words, symbols, duplicate lines, repeated three-word windows, ...) and ratios of
them. A histogram-based booster with logistic loss is fitted on the driver from at most ``sample_rows`` labelled rows
(the labelled rows with the smallest hash of their id: a documented bound). Its trees are flattened into numpy node
arrays; scoring walks all trees of a batch level by level. Features in ``MONOTONE`` can only lower (or raise) the
probability of good quality.

Defined results: a null or empty text has no words and fails the base rule; a text of any length is counted whole;
repeated rows and repeated ids get equal results; an empty table gives an empty result; a column of the input whose
name is one of the results' names is replaced. Null or repeated ids among the labels: nulls are left out, of several
labels for an id the smallest counts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, MARKS = C.UPPER.encode(), b"0123456789", b"!?"
FEATURES = [
    "log_words", "word_len", "symbol_ratio", "upper_ratio", "digit_ratio", "mark_ratio", "dup_line_ratio",
    "repeat_ratio", "distinct_ratio", "line_words", "short_line_ratio", "other_ratio",
]
#: Direction in which a feature may move the probability of good quality.
MONOTONE = {"symbol_ratio": -1, "upper_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "log_words": 1}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SAMPLE_ROWS = 20_000
#: A document is rejected when its probability of good quality is below this.
KEEP_FROM = 0.35


def repeat_words(words: list[bytes]) -> int:
    """Words within three-word windows that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, n, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (one row per text, columns COUNTS) and features (columns FEATURES)."""
    counts, feats = np.zeros((len(texts), len(COUNTS)), np.int64), np.zeros((len(texts), len(FEATURES)))
    for i, b in enumerate(texts):
        words = b.split()
        if not words:
            continue
        solid = b.translate(None, SPACE)
        chars = len(solid.decode("utf-8", "replace"))
        symbols = len(b) - len(b.translate(None, SYMBOLS))
        seen: set[bytes] = set()
        lines = dups = short = 0
        for line in b.split(b"\n"):
            if line.strip(SPACE):
                lines += 1
                dups += line in seen
                seen.add(line)
                short += line.count(b" ") < 3
        repeats, n = repeat_words(words), len(words)
        counts[i] = n, chars, symbols, dups, repeats
        feats[i] = (
            np.log(n), chars / n, symbols / chars, (len(b) - len(b.translate(None, UPPER))) / chars,
            (len(b) - len(b.translate(None, DIGITS))) / chars, (len(b) - len(b.translate(None, MARKS))) / chars,
            dups / lines, repeats / n, len(set(words)) / n, n / lines, short / lines,
            (len(solid) - chars) / chars,
        )
    return counts, feats


@dataclass
class Trees:
    """All trees in flat arrays; a leaf is its own child. ``base`` is the first margin."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(self.roots) or not len(x):
            return out
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return out + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone: dict[int, int], *, n_trees: int = 80, depth: int = 4, rate: float = 0.15,
    bins: int = 64, l2: float = 1.0, min_rows: int = 10,
) -> Trees:
    """Boosting with logistic loss on quantile bins. ``monotone`` maps a feature's index to +1 or -1.

    A split on a constrained feature must order its children's values; both then inherit their midpoint as a bound,
    so no deeper leaf can undo the order.
    """
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    arrays: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    one_sided = not len(y) or y.min() == y.max()
    edges = [] if one_sided else [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]

    def add() -> int:
        k = len(arrays["value"])
        for name, v in (("feature", 0), ("threshold", 0.0), ("left", k), ("right", k), ("value", 0.0)):
            arrays[name].append(v)
        return k

    def grow(node: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        value = lambda a, b: float(np.clip(-a / (b + l2), low, high))
        score = lambda a, b, v: -(a * v + 0.5 * (b + l2) * v * v)
        own = value(gs, hs)
        arrays["value"][node] = rate * own
        if level == depth or len(rows) < 2 * min_rows:
            return
        best = (1e-6, None)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[f][rows]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
            gain = score(gl, hl, vl) + score(gs - gl, hs - hl, vr) - score(gs, hs, own)
            ok = (nl >= min_rows) & (len(rows) - nl >= min_rows)
            if f in monotone:
                ok &= (vr - vl) * monotone[f] >= 0
            gain = np.where(ok, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            return
        f, k, vl, vr = best[1]
        left, right = add(), add()
        arrays["feature"][node], arrays["threshold"][node] = f, edges[f][k]
        arrays["left"][node], arrays["right"][node] = left, right
        bound, mid = {1: ((low, "m"), ("m", high)), -1: (("m", high), (low, "m"))}.get(monotone.get(f, 0)), (vl + vr) / 2
        (ll, lh), (rl, rh) = [tuple(mid if z == "m" else z for z in s) for s in bound] if bound else [(low, high)] * 2
        go_left = binned[f][rows] <= k
        grow(left, rows[go_left], g, h, level + 1, ll, lh)
        grow(right, rows[~go_left], g, h, level + 1, rl, rh)

    margin = np.full(len(y), base)
    for _ in range(0 if one_sided else n_trees):
        p = 1 / (1 + np.exp(-margin))
        root = add()
        roots.append(root)
        grow(root, np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf)
        one = Trees(**{k: np.array(v) for k, v in arrays.items()}, roots=np.array([root]), depth=depth, base=0.0)
        margin += one.margin(x)
    ints = {k: np.array(arrays[k], np.int32) for k in ("feature", "left", "right")}
    return Trees(**ints, threshold=np.array(arrays["threshold"], float), value=np.array(arrays["value"], float), roots=np.array(roots, np.int32), depth=depth, base=base)


def _stat_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("features", T.ArrayType(T.DoubleType()))])


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fits the trees from at most ``sample_rows`` labelled documents."""
    some = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.min(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    picked = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most sample_rows ids
    stats = C.map_texts(
        picked, "text", lambda: lambda texts: [list(statistics(texts)[1])],
        T.StructType([T.StructField("features", T.ArrayType(T.DoubleType()))]), ["doc_id", "y"],
    ).orderBy(F.xxhash64("doc_id"), "doc_id", F.to_json("features")).limit(sample_rows)
    rows = stats.select("features", "y").collect()
    x = np.array([r[0] for r in rows], float).reshape(len(rows), len(FEATURES))
    y = np.array([float(r[1] == 1) for r in rows])
    return fit_trees(x, y, {FEATURES.index(k): v for k, v in MONOTONE.items()})


def score_quality(
    docs: DataFrame, trees: Trees, *, text_col: str = "text", keep: list[str] | None = None, keep_from: float = KEEP_FROM
) -> DataFrame:
    """Adds the counts, base_failed, quality_score (probability of good quality) and kept."""
    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    out = T.StructType([*fields, T.StructField("base_failed", T.BooleanType()), T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def make():
        def fn(texts):
            counts, feats = statistics(texts)
            p = trees.probability(feats)
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            return [*counts.T, failed, p, ~failed & (p >= keep_from)]

        return fn

    return C.map_texts(docs, text_col, make, out, docs.columns if keep is None else keep)
