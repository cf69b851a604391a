"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

1. From at most ``SAMPLE_ROWS`` labelled rows (outside the held-out fold; those with the smallest hash of their id: a
   documented bound) words and word beginnings are counted by label; those over-represented in toxic texts
   (by a likelihood ratio that chance would give to less than one of all terms counted, and ``LIFT`` times as frequent there
   as in clean ones, in three toxic texts at least) become terms, however many. Copies and near copies are no evidence of their own: of texts with the same label
   and the same least hash of a run of ``RUN`` words one is counted.
2. Voters say toxic, clean or nothing about a text: lexicons (a fixed list, and the terms dealt into groups) and patterns
   (density of hits, several different hits, a hit near a word of address, shouting, and absence of all).
   Labels are one more voter, which says nothing about a text without label.
3. The label model is fitted by expectation-maximisation over all documents outside the held-out fold, labelled or not, as
   counts of their vote patterns (fewer than 100,000 can occur, however many documents there are). It starts at the voters'
   majority and estimates class balance and each voter's accuracy and coverage per
   class. Correlations of the voters' votes within the classes are estimated from the posteriors; a voter's log
   likelihood ratio is divided by one plus its correlations with others, and the model fitted again.
4. A logistic regression on term counts and densities learns the posteriors of the sample of step 1 (Newton steps solved by
   conjugate gradients over sparse features, so its memory grows with the hits and not with the number of terms).

Scoring counts terms in whole texts; it needs nothing but the weights.

Defined results: null and empty texts have no hits and get the classifier's score of such a text; texts of any length
are scored whole; repeated rows get equal scores; without labelled rows or toxic ones every score is the (smoothed)
share of toxic rows; labels of an id that occur twice count as toxic if one is; an input column with the name of a
result is replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .tables import Workspace

SAMPLE_ROWS, LEAST_G2, LIFT, RUN, GROUPS = 20_000, 14.0, 8, 5, 8
FOLDS, HELD_OUT = 5, 0
PREFIXES = (4, 6)
#: Distinct terms a task counts before it passes them on.
FLUSH = 400_000
#: Plain English insults, the first lexicon.
LEXICON = ["idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "garbage", "filth", "vermin", "imbecile"]
#: Words of address in the corpus's languages.
ADDRESS = ["you", "your", "du", "ihr", "euch", "tu", "vous", "toi", "usted", "vosotros"]
DENSE = ["log_hits", "log_distinct", "hit_density", "lexicon", "addressed", "shouting"]


def _terms(word: bytes):
    yield word
    for k in PREFIXES:
        if len(word) > k:
            yield word[:k] + b"*"


def mine(sums: DataFrame) -> list[bytes]:
    """Terms of (term, p toxic texts, c clean texts) that are over-represented in toxic texts, best first; the empty term counts all texts."""
    tried, = sums.agg(F.count("*")).first()
    toxic, clean = next(((r["p"], r["c"]) for r in sums.where("term = X''").collect()), (0, 0))
    if not toxic or not clean:
        return []
    both, e = F.col("p") + F.col("c"), (F.col("p") + F.col("c")) * toxic / (toxic + clean)
    g2 = 2 * (F.col("p") * F.log(F.col("p") / e) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (both - e))).otherwise(0.0))
    least = max(LEAST_G2, 2 * float(np.log(2 * tried + 1)))
    found = sums.where("p > 2 and term <> X''").where((F.col("p") * clean >= LIFT * F.col("c") * toxic) & (g2 >= least)).select("term", F.round(g2, 6).alias("g2"))
    return [bytes(r["term"]) for r in found.orderBy(F.desc("g2"), "term").collect()]  # terms of a bounded sample


def _origin(text: bytes) -> int:
    """The least hash of a run of RUN words, which copies and most near copies have in common."""
    words = text.translate(C.ALNUM_BYTES).split()
    return min((xxhash.xxh3_64_intdigest(b" ".join(words[k : k + RUN])) for k in range(max(1, len(words) - RUN + 1))), default=0) - (1 << 63)


class Reader:
    """Hits of terms in texts."""

    def __init__(self, terms: list[bytes]):
        self.index = {t: i for i, t in enumerate(terms)}
        self.gate = {t.rstrip(b"*")[: PREFIXES[0]] for t in terms} | {w.encode()[: PREFIXES[0]] for w in LEXICON}
        self.lexicon, self.address = {w.encode() for w in LEXICON}, {w.encode() for w in ADDRESS}

    def read(self, text: bytes) -> tuple[Counter, np.ndarray]:
        """Term counts, and (words, hits, distinct hit words, lexicon hits, addressed hits, share of capitals)."""
        words, gate, k = text.translate(C.ALNUM_BYTES).split(), self.gate, PREFIXES[0]
        counts: Counter = Counter()
        hits, seen, listed, addressed = 0, set(), 0, 0
        for i in [i for i, w in enumerate(words) if w[:k] in gate]:
            own = [self.index[t] for t in _terms(words[i]) if t in self.index]
            counts.update(own)
            in_list = words[i] in self.lexicon
            if own or in_list:
                hits += 1
                seen.add(words[i])
                listed += in_list
                addressed += not self.address.isdisjoint(words[max(0, i - 3) : i + 4])
        small = len(text) - len(text.translate(None, C.LOWER.encode()))
        large = len(text) - len(text.translate(None, C.UPPER.encode()))
        return counts, np.array([len(words), hits, len(seen), listed, addressed, large / (small + large) if small + large else 0.0])


def votes_of(counts: list[Counter], stats: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 nothing; a column per voter."""
    n, hits, distinct, listed, addressed, shout = stats.T
    out = [np.where(listed > 0, 1, 0)]
    for g in range(GROUPS):
        out.append(np.array([int(any(t % GROUPS == g for t in c)) for c in counts], np.int8))
    out += [np.where(hits >= 0.01 * n, np.where(hits > 0, 1, 0), 0), np.where(distinct >= 2, 1, 0), np.where(addressed > 0, 1, 0)]
    out += [np.where(shout > 0.7, 1, 0), np.where((shout < 0.2) & (n >= 50) & (hits == 0), -1, 0), np.where(hits == 0, -1, 0), np.where(listed == 0, -1, 0)]
    return np.stack(out, 1).astype(np.int8)


@dataclass
class LabelModel:
    """log P(vote | class) per voter for votes -1, 0, 1; the class balance; each voter's discount; correlations."""

    table: np.ndarray
    balance: float
    discount: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ratio = (self.table[1] - self.table[0])[np.arange(votes.shape[1]), votes + 1]
        z = np.log(self.balance / (1 - self.balance)) + (ratio / self.discount).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def majority(votes: np.ndarray) -> np.ndarray:
    """Posteriors to begin with: the share of toxic votes, kept from 0 and 1; 0.05 where no voter says anything."""
    said = np.abs(votes).sum(1)
    return np.where(said > 0, np.clip(0.5 + 0.5 * votes.sum(1) / np.maximum(said, 1), 0.02, 0.98), 0.05)


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30, count: np.ndarray | None = None) -> LabelModel:
    """EM from the posteriors ``start`` over vote patterns that stand for ``count`` texts each; correlations are re-estimated every ten rounds."""
    k, m = votes.shape
    count = np.ones(k) if count is None else np.asarray(count, float)
    n = count.sum()
    onehot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    q, discount, corr = start.astype(float), np.ones(m), np.eye(m)
    model = None
    for r in range(rounds):
        share = np.stack([np.einsum("n,nmv->mv", w * count, onehot) + 0.5 for w in (1 - q, q)])
        table = np.log(share / share.sum(2, keepdims=True))
        balance = float(np.clip(((q * count).sum() + 1) / (n + 2), 1e-3, 1 - 1e-3))
        if r % 10 == 9:  # votes' correlations within the classes
            dev = np.zeros((k, m))
            for w in (1 - q, q):
                w = w * count
                dev += (w / count)[:, None] * (votes - (w @ votes) / max(w.sum(), 1e-9))
            sd = np.sqrt((count @ dev**2) / n) + 1e-9
            corr = ((dev * count[:, None]).T @ dev) / n / np.outer(sd, sd)
            discount = 1 + np.clip(np.abs(corr) - np.eye(m), 0, 1).sum(1)
        model = LabelModel(table, balance, discount, corr)
        q = model.posterior(votes)
    return model


@dataclass
class Classifier:
    terms: list[bytes]
    weights: np.ndarray

    def probability(self, counts: list[Counter], stats: np.ndarray) -> np.ndarray:
        z = self.weights[0] + _dense(stats) @ self.weights[1 : 1 + len(DENSE)]
        for i, c in enumerate(counts):
            for t, k in c.items():
                z[i] += self.weights[1 + len(DENSE) + t] * np.log1p(k)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _dense(stats: np.ndarray) -> np.ndarray:
    n, hits, distinct, listed, addressed, shout = stats.T
    return np.stack([np.log1p(hits), np.log1p(distinct), 100 * hits / np.maximum(n, 20), np.log1p(listed), np.log1p(addressed), shout], 1)


def fit_linear(row: np.ndarray, col: np.ndarray, value: np.ndarray, features: int, target: np.ndarray, l2: float = 1.0, steps: int = 12) -> np.ndarray:
    """Logistic regression of soft targets on sparse features; the intercept comes first and isn't penalised."""
    n = len(target)
    row, col, value = np.concatenate([np.arange(n), row]), np.concatenate([np.zeros(n, np.int64), col + 1]), np.concatenate([np.ones(n), value])
    ahead = lambda v: np.bincount(row, value * v[col], n)
    back = lambda u: np.bincount(col, value * u[row], features + 1)
    w, pen = np.zeros(features + 1), np.full(features + 1, l2)
    pen[0] = 1e-6
    w[0] = np.log((target.sum() + 0.5) / (n - target.sum() + 0.5))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(ahead(w), -30, 30)))
        d = p * (1 - p) + 1e-6
        diag = np.bincount(col, value * value * d[row], features + 1) + pen
        step, res = np.zeros_like(w), back(target - p) - pen * w
        z = res / diag
        way, now = z, float(res @ z)
        first = now
        for _ in range(200):
            if now <= 1e-14 * first or not now:
                break
            h = back(d * ahead(way)) + pen * way
            a = now / float(way @ h)
            step, res = step + a * way, res - a * h
            z = res / diag
            now, before = float(res @ z), now
            way = z + now / before * way
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    some = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (C.crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
        .groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most ``rows`` ids


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> tuple[Classifier, LabelModel | None]:
    C.small_batches(docs.sparkSession)
    sample, ws = _sample(docs, labels, sample_rows), Workspace(docs.sparkSession)

    def origin(batches):
        for b in batches:
            texts = C.texts_of(b.column(0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_origin(t) for t in texts], pa.int64())], names=["text", "y", "origin"])

    def count(batches):
        toxic, clean = Counter(), Counter()

        def out():
            keys = list(toxic | clean)
            for k in range(0, len(keys), 50_000):
                part = keys[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([toxic[t] for t in part], pa.int64()), pa.array([clean[t] for t in part], pa.int64())], names=["term", "p", "c"])
            toxic.clear()
            clean.clear()

        for b in batches:
            for text, y in zip(C.texts_of(b.column(0)), b.column(1).to_pylist()):
                words = set(text.translate(C.ALNUM_BYTES).split())
                (toxic if y == 1 else clean).update({t for w in words for t in _terms(w)})
                (toxic if y == 1 else clean)[b""] += 1
            if len(toxic) + len(clean) > FLUSH:
                yield from out()
        yield from out()

    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("y", labels.schema["toxic"].dataType), T.StructField("origin", T.LongType())])
    own = sample.select("text", "y").mapInArrow(origin, schema).groupBy("origin", "y").agg(F.min("text").alias("text"))
    sums = own.select("text", "y").mapInArrow(count, "term binary, p long, c long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("c").alias("c"))
    terms = mine(ws.save(sums, "terms"))

    def featurise(batches):
        reader = Reader(terms)
        for b in batches:
            read = [reader.read(t) for t in C.texts_of(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array([list(c) for c, _ in read], pa.list_(pa.int32())), pa.array([list(c.values()) for c, _ in read], pa.list_(pa.int32())), pa.array([list(s) for _, s in read], pa.list_(pa.float64()))], names=["y", "t", "k", "s"])

    rows = sample.select("text", "y").mapInArrow(featurise, "y int, t array<int>, k array<int>, s array<double>").orderBy("y", F.to_json(F.struct("t", "k", "s"))).collect()
    y = np.array([r[0] == 1 for r in rows], float)
    if not len(y) or y.min() == y.max():
        w = np.zeros(1 + len(DENSE) + len(terms))
        w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 4.5))
        return Classifier(terms, w), None

    # vote patterns of all documents outside the fold, with the label's vote where there is one
    def make():
        reader = Reader(terms)

        def vote(texts):
            read = [reader.read(t) for t in texts]
            return [[v.tobytes() for v in votes_of([c for c, _ in read], np.array([s for _, s in read]).reshape(len(read), 6))]]

        return vote

    learning = docs.where(F.col("doc_id").isNotNull() & (C.crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)).select("doc_id", "text")
    cast = C.map_texts(learning, "text", make, T.StructType([T.StructField("votes", T.BinaryType())]), ["doc_id"])
    gold = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    said = F.when(F.col("y").isNull(), 0).when(F.col("y") == 1, 1).otherwise(-1).alias("y")
    patterns = cast.join(gold, "doc_id", "left").select("votes", said).groupBy("votes", "y").agg(F.count("*").alias("n")).orderBy("votes", "y").collect()
    votes = np.stack([np.append(np.frombuffer(r["votes"], np.int8), np.int8(r["y"])) for r in patterns])
    model = fit_label_model(votes, majority(votes), count=np.array([r["n"] for r in patterns]))

    counts, stats = [Counter(dict(zip(r[1], r[2]))) for r in rows], np.array([r[3] for r in rows])
    votes = np.concatenate([votes_of(counts, stats), np.where(y == 1, 1, -1)[:, None].astype(np.int8)], 1)
    dense, size = _dense(stats), [len(c) for c in counts]
    at = np.concatenate([np.repeat(np.arange(len(y)), len(DENSE)), np.repeat(np.arange(len(y)), size)])
    col = np.concatenate([np.tile(np.arange(len(DENSE)), len(y)), len(DENSE) + np.array([t for c in counts for t in c], np.int64)])
    value = np.concatenate([dense.ravel(), np.log1p(np.array([k for c in counts for k in c.values()], float))])
    return Classifier(terms, fit_linear(at, col, value, len(DENSE) + len(terms), model.posterior(votes))), model


def score_toxicity(docs: DataFrame, model: Classifier, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1) and n_hits (words that are terms)."""

    def make():
        reader = Reader(model.terms)

        def fn(texts):
            read = [reader.read(t) for t in texts]
            stats = np.array([s for _, s in read]).reshape(len(read), 6)
            return [model.probability([c for c, _ in read], stats), stats[:, 1].astype(np.int64)]

        return fn

    return C.map_texts(docs, text_col, make, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType())]), docs.columns if keep is None else keep)
