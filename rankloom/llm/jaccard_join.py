"""N-gram Jaccard join by universe partition: all documents whose shingle sets are similar, exactly.

Texts become sets of hashed word shingles. Sets fall into size bands such that similar sets lie in the same band or in
neighbours. Two sets with Jaccard similarity t differ in at most H = (1-t)/(1+t) * (|A|+|B|) elements, so with the
universe of shingles hashed into segments that together tolerate H differences, at least one segment agrees: either
as a whole (tolerates none) or up to one element, which is found over the segment's one-deletion neighbourhood
(tolerates one). How many segments of either kind a band gets is decided by cost, from the number of its sets.

1. Each set puts out the signatures of its segments, for its own band and for the one below. Repeated sets within a
   task put theirs out once.
2. Buckets of a signature with two or more sets are kept. In each, members are compared with one pivot only; what
   links is merged into components. Where several sets of a batch share a signature, one of them is their pivot and goes on for all:
   a bucket is brought together with one row a batch, the others are dealt by their pivot. Signatures travel in lists, one a batch and part of their
   universe, and name a set by the first bytes of its fingerprint; sets that share these are compared besides.
3. In buckets that still hold several components, pairs across components are compared: the members of all but the
   largest component with all members of the others. A pair comes out of that
   join only if the parity sketches of its sets (512 bits, each the parity of a slice of the universe) differ in no more
   bits than H, which no similar pair fails.
4. All comparisons are exact intersections of the sets. Components of the links give the result.

Pairs within a component are never listed. Within a bucket step 3 looks at pairs of a member outside its largest component and
any other: the work for one very large family of texts that share a segment but aren't connected stays quadratic in these, though
its output doesn't.

Defined results: a null, empty or blank text has no shingles, links with nothing and is its own component; a text of
fewer than n words is one shingle; repeated texts are one set (a class) and links hold for all its rows; rows that share
an id but not a text are compared as different sets, and the component's id is the smallest id in it; rows with a null
id take part, and a component of such rows alone has a null id.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .tables import Workspace, components

PARITY_LONGS = 8
#: Pivots of a set that step 2 compares it with, those with the closest sketches: of its batches, and as many of all.
PIVOTS = 3
#: Ids that travel to the tasks to fetch their sets, and the bytes of the longest; for more or longer ones a map of bits goes.
BROADCAST_IDS, ID_BYTES = 200_000, 64
#: Fewest and most bits of that map, and bits an id.
MAP_BITS, BITS_PER_ID = (1 << 15, 1 << 27), 32
#: Bytes of a fingerprint that signatures carry: they are the most of what is shuffled.
HANDLE_BYTES = 8
#: Signatures of a part, and the fewest parts: they are shuffled in lists, a batch and part each, in which a set's name costs little.
PART_SIGNATURES, LEAST_PARTS = 4_000_000, 32
#: Cost of a pair in a bucket, against that of a signature.
PAIR_COST = 0.02
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S = [np.uint64(x) for x in (29, 32, 33, 31)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S[2])) * _M2
    x = (x ^ (x >> _S[0])) * _M3
    return x ^ (x >> _S[1])


class Bands:
    """Size bands for similarity ``num``/``den``: similar sets are in one band or in neighbours."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        self.edges = [1, 2]
        while self.edges[-1] <= largest:
            self.edges.append(max(self.edges[-1] + 1, (self.edges[-1] - 1) * den // num + 1))

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.edges), size, side="right") - 1

    def differences(self, band: int) -> int:
        """Most elements by which two similar sets can differ when the smaller lies in ``band``."""
        small = self.edges[band + 1] - 1
        return (self.den - self.num) * (small + small * self.den // self.num) // (self.den + self.num)

    def allocate(self, band: int, sets: int) -> tuple[int, int]:
        """(segments, those of them with a one-deletion neighbourhood) of least cost for so many sets.

        A signature costs 1, a pair to look at ``PAIR_COST``. Unrelated sets are taken to agree in a segment when both
        hold one element and this is the same frequent one (one in a thousand); where deletions are put out, when both
        hold one element at most. Without deletions there are so many segments that every set (but one in a thousand)
        has more non-empty ones than it may differ in.
        """
        need, size = self.differences(band) + 1, float(self.edges[band])
        best = None
        for two in sorted({0, need // 4, need // 2}):
            m = need - two
            if not two:
                while (full := m * (1 - np.exp(-size / m))) < need + 3 * np.sqrt(m - full) and m < 2 * need:
                    m += 1 + m // 64
            per = size / m
            same = 1e-3 * (per * np.exp(-per)) ** 2 + (np.exp(-2 * per) if two else 0)  # empty ones are put out beside deletions only
            chance = (m - two) * same + two * ((1 + per) * np.exp(-per)) ** 2
            cost = sets * (m + two * per) + PAIR_COST * sets * sets * chance
            if best is None or cost < best[0]:
                best = (cost, m, two)
        return best[1], best[2]


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every distinct shingle, ordered by both."""
    words, sizes = [], np.empty(len(texts), np.int64)
    for i, b in enumerate(texts):
        w = b.translate(C.LOWER_BYTES).split()
        sizes[i] = len(w)
        words += w
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    doc = np.repeat(np.arange(len(texts)), sizes)
    start = np.cumsum(sizes) - sizes
    at = np.arange(len(words)) - start[doc]
    first = np.flatnonzero((at + n <= sizes[doc]) | (at == 0))
    count = np.minimum(sizes[doc[first]], n)
    acc = np.zeros(len(first), np.uint64)
    for k in range(n):
        use = count > k
        acc[use] = _mix(acc[use] * _M1 + h[first[use] + k] + np.uint64(k + 1))
    acc = _mix(acc + count.astype(np.uint64))
    d = doc[first]
    order = np.lexsort((acc, d))
    d, acc = d[order], acc[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (acc[1:] != acc[:-1])
    return d[new], acc[new]


def _sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, doc, values)
    return out


def fingerprints(doc: np.ndarray, h: np.ndarray, n: int) -> list[bytes]:
    """12 bytes for each set, of two sums of differently mixed hashes: ten billion sets collide with odds of 1 to 10^9."""
    pair = np.stack([_sums(_mix(h), doc, n), _sums(_mix(h ^ _M1), doc, n)], 1)
    raw = pair.tobytes()
    return [raw[i : i + 12] for i in range(0, len(raw), 16)]


def handles(prints: list[bytes], width: int) -> np.ndarray:
    """The first bytes of each fingerprint as a number, by which signatures name their sets; sets that share one are compared besides."""
    return np.frombuffer(b"".join(p[:width].ljust(8, b"\0") for p in prints), np.int64) if prints else np.empty(0, np.int64)


def parity(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """For each set 512 bits: whether an odd number of its elements falls in each of 512 slices of the universe."""
    bits = PARITY_LONGS * 64
    slot = (_mix(h * _M3) >> np.uint64(40)).astype(np.int64) % bits
    odd = (np.bincount(doc * bits + slot, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1).view(np.int64)


def signatures(doc: np.ndarray, h: np.ndarray, size: np.ndarray, band: np.ndarray, plan: dict[int, tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) under the bands' plans (segments, with deletions, differences); texts whose band isn't in
    ``plan`` or whose set is empty have none.

    Of m segments at least m - H agree in a similar pair. Where one of the sets has more than H non-empty segments, one
    of these agrees. So a set with more than H puts out the non-empty ones only, others put out all.
    """
    m = np.array([plan.get(int(b), (0, 0))[0] if s else 0 for b, s in zip(band, size)], np.int64)
    two = np.array([plan.get(int(b), (0, 0))[1] if s else 0 for b, s in zip(band, size)], np.int64)
    most = np.array([plan.get(int(b), (0, 0, 0))[2] if s else 0 for b, s in zip(band, size)], np.int64)
    use = m[doc] > 0
    doc, h = doc[use], h[use]
    mixed = _mix(h + _M2)
    seg = ((mixed >> np.uint64(32)) * m[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    offset = np.cumsum(m) - m
    value = _mix(h ^ _M3)
    total = _sums(value, offset[doc] + seg, int(m.sum()))
    owner = np.repeat(np.arange(len(m)), m)
    index = np.arange(len(owner)) - offset[owner]
    salt = lambda d, s: _mix(band[d].astype(np.uint64) * _M1 + s.astype(np.uint64) + np.uint64(1))
    filled = np.bincount(offset[doc] + seg, minlength=len(owner)) > 0
    enough = np.bincount(owner[filled], minlength=len(m)) > most
    out = filled | ~(enough & (two == 0))[owner]
    owner, index, total_out = owner[out], index[out], total[out]
    whole = _mix(total_out ^ salt(owner, index))
    cut = seg < two[doc]
    d, s = doc[cut], seg[cut]
    less = _mix((total[offset[d] + s] - value[cut]) ^ salt(d, s))
    return np.concatenate([owner, d]), np.concatenate([whole, less])


def gathered(owner: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, text, pivot or -1): each signature's first text without a pivot, and all texts of those that several have with
    that first one as their pivot."""
    order = np.argsort(sig, kind="stable")
    s, o = sig[order], owner[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    head = o[np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))]
    shared = ~(first & np.concatenate([first[1:], [True]]))
    return np.concatenate([s[first], s[shared]]), np.concatenate([o[first], o[shared]]), np.concatenate([np.full(int(first.sum()), -1), head[shared]])


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def id_bits(ids: DataFrame) -> np.ndarray:
    """Bytes of a map of 2^k bits, set where the hash of an ``id`` falls. Parts of 2^15 bits are put together by the tasks; the driver gets the
    map, which has the same bounds for any number of ids."""
    size, part = MAP_BITS[0], MAP_BITS[0]
    wanted = min(MAP_BITS[1], ids.count() * BITS_PER_ID)
    while size < wanted:
        size *= 2
    at = F.xxhash64("id").bitwiseAND(size - 1)
    parts = ids.groupBy(F.floor(at / part).alias("part")).agg(F.bitmap_construct_agg(at % part).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in parts.collect():  # of 4 KB
        out[r["part"] * part // 8 : (r["part"] + 1) * part // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _similar(both: Column, a: Column, b: Column, num: int, den: int) -> Column:
    return F.lit(den) * both >= F.lit(num) * (a + b - both)


def similar_classes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100,
    firsts: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles and component_id, documents being linked when their shingle
    sets' Jaccard similarity is at least ``num``/``den``. Links are not counted, since pairs within a component are not
    listed. ``firsts`` gives instead (id, k1, k2) of the first row of each component, by id (null last) and then text keys
    (see ``text_keys``); a text without shingles is its own component."""
    spark, bands, width = docs.sparkSession, Bands(num, den), HANDLE_BYTES
    ws = Workspace(spark)
    C.small_batches(spark, 500)  # a batch holds all words, shingles and signatures of its texts
    keys = ["k1", "k2"] if firsts else []
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *[k.alias(c) for k, c in zip(text_keys(docs[text_col]), keys)])
    id_type = docs.schema[id_col].dataType
    longs = [f"p{k}" for k in range(PARITY_LONGS)]

    def sets(batches):
        for batch in batches:
            texts = C.texts_of(batch.column(1))
            d, h = shingles(texts, n)
            size = np.bincount(d, minlength=len(texts))
            p, f = parity(d, h, len(texts)), fingerprints(d, h, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.binary()), pa.array(handles(f, width)), pa.array(size, pa.int64()), *[pa.array(p[:, k]) for k in range(PARITY_LONGS)], *batch.columns[2:]], names=["id", "f", "h", "size", *longs, *keys])

    set_schema = T.StructType([T.StructField("id", id_type), T.StructField("f", T.BinaryType()), T.StructField("h", T.LongType()), T.StructField("size", T.LongType()), *[T.StructField(c, T.LongType()) for c in longs + keys]])
    rows = ws.save(source.mapInArrow(sets, set_schema), "sets")
    full = rows.where("size > 0")
    classes = ws.save(full.groupBy("f").agg(F.min("id").alias("id"), *[F.max(c).alias(c) for c in ["h", "size", *longs]]), "classes")

    # allocation: sets per band (one row per band, about 130 bands at 0.9)
    per_size = classes.groupBy("size").count()
    top = bisect_right(bands.edges, int(per_size.agg(F.max("size")).first()[0] or 1))
    lows = bands.edges[: top + 2]
    band_of = F.size(F.filter(F.array(*[F.lit(x) for x in lows]), lambda x: x <= F.col("size"))) - 1
    per_band = {r["band"]: r["n"] for r in per_size.groupBy(band_of.alias("band")).agg(F.sum("count").alias("n")).collect()}
    plan = {b: (*bands.allocate(b, per_band.get(b, 0) + per_band.get(b + 1, 0)), bands.differences(b)) for b in range(-1, top + 1) if b >= 0 and (b in per_band or b + 1 in per_band)}

    parts = max(LEAST_PARTS, sum(per_band.get(b + k, 0) * (m + t) for b, (m, t, _) in plan.items() for k in (0, 1)) // PART_SIGNATURES)

    def sign(batches):
        seen: set[bytes] = set()
        for batch in batches:
            texts = C.texts_of(batch.column(0))
            d, h = shingles(texts, n)
            f, size = fingerprints(d, h, len(texts)), np.bincount(d, minlength=len(texts))
            fresh = np.zeros(len(texts), bool)
            for i, x in enumerate(f):
                fresh[i] = x not in seen
                seen.add(x)
            keep = fresh[d]
            d, h, size = d[keep], h[keep], np.where(fresh, size, 0)
            band = bands.of(np.maximum(size, 1))
            for shift in (0, 1):
                sig, owner, of = gathered(*signatures(d, h, size, band - shift, plan))
                names = handles(f, width)
                pivot = np.where(of < 0, 0, names[of])
                part = (_mix(sig ^ (pivot.view(np.uint64) * _M1)) >> np.uint64(32)) % np.uint64(parts)
                order = np.lexsort((owner, part))
                ends = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
                lists = [pa.array(sig[order].view(np.int64)), pa.array(names[owner[order]]), pa.array(pivot[order], mask=of[order] < 0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), *[pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in lists]], names=["part", "sig", "h", "of"])

    signed = source.select("text").mapInArrow(sign, "part int, sig array<long>, h array<long>, of array<long>").where(F.size("sig") > 0).repartition("part")
    signed = signed.select("part", F.inline(F.arrays_zip("sig", "h", "of")))
    w = C.Window.partitionBy("part", "sig", "of").orderBy(F.xxhash64("h", "sig"), "h").rowsBetween(C.Window.unboundedPreceding, C.Window.unboundedFollowing)
    members = signed.select("sig", "h", F.coalesce("of", F.first("h").over(w)).alias("pivot"), "of", F.last("h").over(w).alias("last")).where("of is not null or pivot <> last")
    members = ws.save(members.select("sig", "h", "pivot", F.col("of").isNotNull().alias("near")).distinct(), "members")

    # different sets of one handle, of which there are hardly any
    named = classes.select("h", "f")
    twins = ws.save(named.select("h", F.col("f").alias("a")).join(named.select("h", F.col("f").alias("b")), "h").where("a > b"), "twins")

    def arrays(batches, bits=None):
        for batch in batches:
            if bits is not None:
                at = batch.column(1).to_numpy() & (len(bits) * 8 - 1)
                batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            texts = C.texts_of(batch.column(0))
            d, h = shingles(texts, n)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(texts)))])
            yield pa.RecordBatch.from_arrays([pa.array(fingerprints(d, h, len(texts)), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h.view(np.int64)))], names=["f", "set"])

    def elements(need: DataFrame) -> DataFrame:
        """(f, set) of the classes (f, id), from the texts with their ids or, where these are many, with ids that fall on a map of bits: no text is
        dealt to find them. What a map lets through besides goes in the join."""
        ids, schema = need.select(F.col("id").alias("wid")).distinct(), "f binary, set array<bigint>"
        few = ids.limit(BROADCAST_IDS + 1).agg(F.count("*").alias("n"), F.max(F.octet_length(F.col("wid").cast("string"))).alias("b")).first()
        if few["n"] <= BROADCAST_IDS and (few["b"] or 0) <= ID_BYTES:
            found = source.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("wid")), "left_semi").select("text").mapInArrow(arrays, schema)
        else:
            found = source.select("text", F.xxhash64("id")).mapInArrow(partial(arrays, bits=id_bits(need)), schema)
        return found.join(need.select("f"), "f", "left_semi").dropDuplicates(["f"])

    traits = classes.select("f", "h", "size", *longs)
    apart = lambda x, y: sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in longs[1:]), F.bit_count(F.col(f"{x}.{longs[0]}").bitwiseXOR(F.col(f"{y}.{longs[0]}"))))
    total = F.col("x.size") + F.col("y.size")
    near = (F.least("x.size", "y.size") * den >= F.greatest("x.size", "y.size") * num) & (apart("x", "y") * (den + num) <= total * (den - num))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Those of (a, b) that are similar, by their sets; only the sets of these pairs are made, and they aren't written but dealt once for both sides."""
        pairs = ws.save(pairs, f"{name}pairs")
        ends = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
        e = elements(ws.save(ends.select(F.col("a").alias("f")).join(classes.select("f", "id"), "f"), f"{name}ends"))
        got = pairs.join(e.select(F.col("f").alias("a"), F.col("set").alias("sa")), "a").join(e.select(F.col("f").alias("b"), F.col("set").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        out = ws.save(got.where(_similar(both, F.size("sa"), F.size("sb"), num, den)).select("a", "b"), name)
        ws.drop(f"{name}pairs", f"{name}ends")
        return out

    spokes = members.where("h <> pivot").select(F.greatest("h", "pivot").alias("a"), F.least("h", "pivot").alias("b"), "h", "near").distinct()
    spokes = (
        spokes.alias("s").join(traits.alias("x"), F.col("s.a") == F.col("x.h")).join(traits.alias("y"), F.col("s.b") == F.col("y.h"))
        .where(near).select(F.col("x.f").alias("a"), F.col("y.f").alias("b"), F.col("s.h").alias("own"), "s.near", apart("x", "y").alias("d"))
        .withColumn("k", F.row_number().over(C.Window.partitionBy("own", "near").orderBy("d", "a", "b"))).where(F.col("k") <= PIVOTS)
        .select("a", "b")
    )
    links = verified(spokes.unionByName(twins.select("a", "b")).distinct(), "links1")
    label = ws.save(components(ws, links, "first"), "labels1")

    rooted = classes.select("h", "f").join(label.select(F.col("node").alias("f"), "root"), "f", "left").select("h", "f", F.coalesce("root", "f").alias("root"))
    own = members.select("sig", "h").join(rooted, "h").select("sig", "f", "root")
    parts = own.distinct().groupBy("sig", "root").agg(F.count("*").alias("n")).groupBy("sig").agg(F.max(F.struct("n", "root"))["root"].alias("major"), F.count("*").alias("roots"))
    rest = ws.save(own.distinct().join(parts.where("roots > 1").drop("roots"), "sig").join(traits.drop("h"), "f"), "rest")
    across = (
        rest.where("root <> major").alias("x").join(rest.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.major")) | (F.col("x.f") > F.col("y.f"))) & near)
        .select(F.greatest("x.f", "y.f").alias("a"), F.least("x.f", "y.f").alias("b")).distinct()
    )
    ws.drop("members", "twins", "labels1")
    more = verified(across, "links2")
    label = components(ws, links.unionByName(more), "final")

    named = classes.select("f", "id").join(label.select(F.col("node").alias("f"), "root"), "f", "left").select("f", "id", F.coalesce("root", "f").alias("root"))
    if firsts:
        own = F.struct(F.col("id").isNull().alias("last"), "id", "k1", "k2")
        best = full.groupBy("f").agg(F.min(own).alias("one")).join(named.select("f", "root"), "f").groupBy("root").agg(F.min("one").alias("one"))
        out = ws.save(best.select("one.id", "one.k1", "one.k2").unionByName(rows.where("size = 0").select("id", "k1", "k2").distinct()), "firsts")
        ws.drop("sets", "classes", "rest", "links1", "links2")
        return out
    ws.drop("rest", "links1", "links2")
    lowest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = named.join(lowest, "root").select("f", "component_id")
    out = rows.select("id", "f", "size").join(of_class, "f", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
