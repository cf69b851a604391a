"""Benchmark decontamination: an FM-index per training shard, searched for the windows of the benchmark.

A window is ``window`` consecutive words of an item (a shorter item is one window). Each task cuts its documents into
words and packs all of them into shards of about ``SHARD_BYTES`` of text. Each shard gets an FM-index over its whole text (a symbol
for every distinct word, one for the end of a document); all windows are searched backwards together, their occurrences located
by sampled suffix positions and merged to spans of words. A document longer than a shard is a shard by itself.

The benchmark travels with the tasks in blocks of at most ``block_bytes`` of text. Where one isn't enough, every block has its
pass over the documents, of which only those with hits are written, by the hashes of their texts; their spans are merged and joined
to the documents at last. No shuffle with one block, nothing of the documents reaches the driver.

Defined results: null and empty texts have no words and no hit; texts of any length are searched whole; repeated rows
get equal results; rows of the benchmark without id or without words have no windows, rows that share an id count as
one item; without documents or without benchmark the result is empty or without hits; an input column with the name
of a result is replaced. ``cut_spans``: a null text, null or empty spans leave the text as it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C
from .fm_index import FMIndex
from .tables import Workspace

WINDOW = 13
#: Text of a shard.
SHARD_BYTES = 3_000_000
BLOCK_BYTES = 8_000_000
END = b"\x01"
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))


class Windows:
    """The windows of a block of items: vocabulary, distinct windows as symbol rows, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.ids: list[str] = sorted({i for i, _ in items})
        of, at = {}, {k: n for n, k in enumerate(self.ids)}
        for item, text in items:
            seq = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in text.translate(C.ALNUM_BYTES).split()]
            for k in range(max(1, len(seq) - window + 1) if seq else 0):
                of.setdefault(tuple(seq[k : k + window]), set()).add(at[item])
        keys = sorted(of)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.phrases = np.zeros((len(keys), window), np.int32)
        for n, k in enumerate(keys):
            self.phrases[n, : len(k)] = k
        self.item_start = np.concatenate([[0], np.cumsum([len(of[k]) for k in keys], dtype=np.int64)]).astype(np.int64)
        self.items = np.array([i for k in keys for i in sorted(of[k])], np.int64)

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words of the texts, an end after each text, and the place after each text's end.

        The windows' words keep their symbols; the others of these texts get the next ones.
        """
        words = (b" " + END + b" ").join([b.translate(C.ALNUM_BYTES) for b in texts] + [b""]).split()
        ids = dict(self.vocab)
        ids[END] = len(ids) + 1
        for w in dict.fromkeys(words):
            ids.setdefault(w, len(ids) + 1)
        seq = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        return seq, np.flatnonzero(seq == len(self.vocab) + 1) + 1


def _find(seq: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of every occurrence of a window in a shard."""
    index = FMIndex(seq)
    low, high = index.search(w.phrases, w.lengths)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]
    return which, index.locate(rows)


def _scan(batches: Iterator[pa.RecordBatch], w: Windows, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches' columns but the last, which is the text, then spans, items and words of each text."""

    def shard(texts: list[bytes]) -> tuple[list, list, list]:
        seq, ends = w.symbols(texts)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        which, pos = _find(seq, w) if len(w.lengths) else (np.zeros(0, np.int64),) * 2
        cover = np.zeros(len(seq) + 1, np.int64)
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + w.lengths[which], -1)
        hit = np.cumsum(cover)[:-1] > 0
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))  # an end stands between documents, so no span crosses them
        spans: list[list] = [[] for _ in texts]
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for d, a, b in zip(np.searchsorted(ends, low, side="right").tolist(), low.tolist(), high.tolist()):
            spans[d].append([a - int(starts[d]), b - int(starts[d])])
        n_items = np.diff(w.item_start)[which]
        docs = np.repeat(np.searchsorted(ends, pos, side="right"), n_items)
        items = w.items[np.repeat(w.item_start[which], n_items) + np.arange(len(docs)) - np.repeat(np.cumsum(n_items) - n_items, n_items)]
        named: list[list] = [[] for _ in texts]
        for k in np.unique(docs * max(1, len(w.ids)) + items).tolist():
            named[k // len(w.ids)].append(w.ids[k % len(w.ids)])
        return spans, named, (ends - starts - 1).tolist()

    for batch in batches:
        texts, k, found = C.texts_of(batch.column(batch.num_columns - 1)), 0, ([], [], [])
        while k < len(texts):
            end, held = k, 0
            while end < len(texts) and (end == k or held + len(texts[end]) <= SHARD_BYTES):
                held += len(texts[end])
                end += 1
            for all_, new in zip(found, shard(texts[k:end])):
                all_ += new
            k = end
        cols = [batch.column(i) for i in range(batch.num_columns - 1)]
        cols += [pa.array(x, t) for x, t in zip(found, (pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()), pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def _merge(a: list, b: list) -> list:
    out: list = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string"), "text").orderBy("item_id", "text")
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        block.append((item, text.encode("utf-8", "surrogatepass")))
        size += len(block[-1][1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Adds n_words, spans ([start, end) in words, merged), items (ids with occurring windows), n_hit, contaminated."""
    spark = docs.sparkSession
    C.small_batches(spark)
    new = {"n_words", "spans", "items", "n_hit", "contaminated"}
    keep = C.kept(docs.columns if keep is None else keep, new)
    results = [T.StructField("__spans", _SPANS), T.StructField("__items", T.ArrayType(T.StringType())), T.StructField("__n", T.LongType())]

    def scanned(df: DataFrame, block) -> DataFrame:
        """``df``, whose last column is the text, with the hits of a block of the benchmark in its place."""
        schema = T.StructType([*df.schema.fields[:-1], *results])
        names, shared = to_arrow_schema(schema).names, spark.sparkContext.broadcast(Windows(block, window))  # block_bytes of text
        return df.mapInArrow(lambda it: _scan(it, shared.value, names), schema)

    text, own = C.col(text_col), [C.col(c).alias(f"__{i}") for i, c in enumerate(keep)]
    key = [F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2")]
    blocks = _blocks(benchmark, block_bytes)
    first, more, ws = next(blocks, []), [], None
    for n, block in enumerate(blocks):
        ws = ws or Workspace(spark)
        hits = scanned(docs.select(*key, text.alias("__text")), block).where(F.size("__items") > 0).drop("__n")
        more.append(ws.save(hits.dropDuplicates(["__k1", "__k2"]), f"hits{n}"))
    df = scanned(docs.select(*own, *(key if more else []), text.alias("__text")), first)
    if more:
        others = more[0]
        for x in more[1:]:
            others = others.unionByName(x)
        others = others.groupBy("__k1", "__k2").agg(F.flatten(F.collect_list("__spans")).alias("s"), F.flatten(F.collect_list("__items")).alias("i"))
        df = df.join(others, ["__k1", "__k2"], "left")

        @F.pandas_udf("array<array<int>>")
        def merged(a, b):
            return type(a)([_merge([list(x) for x in p], [] if q is None else [list(x) for x in q]) for p, q in zip(a, b)])

        df = df.withColumn("__spans", F.when(F.col("s").isNull(), F.col("__spans")).otherwise(merged("__spans", "s")))
        df = df.withColumn("__items", F.array_sort(F.array_union("__items", F.coalesce("i", F.array().cast("array<string>")))))
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    df = df.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], F.col("__n").alias("n_words"), F.col("__spans").alias("spans"), F.col("__items").alias("items"), hit.alias("n_hit"))
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def items_digest(items):
    """Lowercase SHA-256 of the comma-joined ids."""
    return F.sha2(F.array_join(items, ","), 256)


def cut_spans(docs: DataFrame, *, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Replaces ``text_col`` by the text without the words of ``spans_col`` and what stands between them."""

    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for t, s in zip(texts, spans):
            if t is None or s is None or not len(s):
                out.append(t)
                continue
            b = t.encode("utf-8", "surrogatepass")
            at = [m.span() for m in _WORD.finditer(b.translate(C.ALNUM_BYTES))]
            for a, e in reversed([tuple(x) for x in s]):
                b = b[: at[a][0]] + b[at[e - 1][1] :]
            out.append(b.decode("utf-8", "replace"))
        return type(texts)(out)

    return docs.withColumn(text_col, cut(F.col(text_col), F.col(spans_col)))


def brute_force(texts: list[str | None], items: list[tuple[str, str]], window: int = WINDOW) -> list[tuple[int, int, list[str]]]:
    """(n_words, n_hit, items) by comparing every window with every place; for tests."""
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = [(i, w[k : k + window]) for i, t in items for w in [words(t)] for k in range(max(1, len(w) - window + 1) if w else 0)]
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for i, p in wins:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    ids.add(i)
        out.append((len(w), len(hit), sorted(ids)))
    return out


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
