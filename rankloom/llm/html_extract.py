"""HTML extraction: a host suffix array finds boilerplate, mark-up decides what belongs to the article.

1. Each page is cut into blocks (runs of text between block-level tags). A block is the article's own (inside an article
   container), structural boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, comments, by tag,
   role, or a class or id all of whose parts say so: "share-buttons" does, "share-price" doesn't) or open (a page without a
   container has only these). Open blocks that are links for the most part are menus. Scripts, styles and the like are no blocks.
2. The words of all blocks are concatenated, page after page, per host. A suffix array over them puts
   equal runs of ``LEAST`` words side by side. A run on ``need`` pages (``LEAST_PAGES``, or one of ``SHARE`` distinct pages
   of the host if that is more) is frequent. Only pages with other content are evidence: one whose article (or open) blocks
   have fewer than one in ``REST`` runs that aren't frequent is a (near) copy of others, and pages with equal least hash
   of those runs, as copies and near copies in smaller groups have, count once. A frequent run with ``need`` such pages is boilerplate.
3. A host above ``SHARD_BYTES`` of HTML is dealt into shards by page, each with a suffix array of its own. A run that is on ``need``
   pages of the host is, in some shard, on ``need`` times that shard's share of the pages; the runs that are go on. Each
   page then reports which of these it has, and the rules of step 2 are applied to all pages of the host by joins. No task holds
   more than a shard, and the text of such hosts is worked out page by page.
4. The text of a page without a container is its open blocks, whole, but those with ``COVERED`` of 100 words or more in boilerplate
   runs. That of a page with one is all blocks of the article, but those that stand as a whole on most pages of the host: every run that
   lies in the block is on ``MOST`` of 100 distinct pages or more (a call to subscribe in every article; a sentence that many articles share stays). Headings
   and blocks of fewer than ``LEAST`` words always stay, whatever stands around them. A page left without any block keeps them all.

Copies of an article as a whole are no evidence, so they stay. Where pages of a template differ
in less than one in ``REST`` runs they can't be told from near copies, and keep their text.

Defined results: a null or empty html gives the empty text; pages of any length are parsed whole; rows equal in page_id,
url and html count as one page; a null url is a host of its own kind; an empty table gives an empty result; other columns are
left out. Broken mark-up: a closing tag without its opening one is ignored, an element left open ends with its parent, a
tag without its end is text. Mark-up is scanned in time proportional to its length, however it is broken.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common as C
from .fm_index import suffix_array
from .tables import Workspace

LEAST = 5
#: Pages that make a run boilerplate: so many, or one of SHARE of the host's distinct pages if that is more.
LEAST_PAGES, SHARE = 3, 20
#: One in so many runs of a page that is evidence are no candidates.
REST = 5
#: Words of 100 in boilerplate runs from which a block goes.
COVERED = 80
#: Distinct pages of 100 on a host that make a whole block of an article boilerplate.
MOST = 50
#: Words of 100 in links from which an open block is a menu.
LINKED = 67
SHARD_BYTES = 6_000_000
#: HTML of a task that works on hosts or shards.
TASK_BYTES = 16_000_000
BROADCAST_HOSTS = 20_000
#: Runs that travel to the tasks; more are joined.
BROADCAST_RUNS = 500_000
OWN, OPEN, BOILER, TITLE = 0, 1, 2, 3

RAW = set("script style noscript template textarea iframe svg select object canvas audio video".split())
#: A tag without a bracket in its values, as nearly all are; a try ends at the next bracket.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^<>\"]*+\"|'[^<>']*+')*+)>")
_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = set("area base br col embed hr img input link meta source track wbr param".split())
BLOCK = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
STRUCTURAL = set("nav footer aside form menu button dialog fieldset".split())
HIDDEN = {"head", "title"}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Parts of class names and ids that mark boilerplate, and parts that say nothing beside them.
MARKS = set(
    "ad ads advert adverts advertisement adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs toolbar footer masthead header topbar comment comments disqus replies responses share sharing "
    "social related recommended newsletter subscribe signup login widget pagination pager skip search".split()
)
NEUTRAL = set(
    "box bar block list section area container wrapper wrap inner outer button buttons link links item items posts articles stories news form thread unit slot "
    "site global main page top bottom left right primary secondary user reader inline icons widgets group row col holder panel to and".split()
)
_PART = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
CONTAINER = re.compile(r"(?:^|\s)(?:article|article-body|articlebody|post-content|entry-content|post-body|story-body|main-content|article-content)(?:$|\s)", re.I)
#: A tag that ends an open element of these names on top of the stack.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}


class Scanner:
    """Tags of a page in order. Where a tag ends is remembered by the quote or bracket it is reached through, and that none follows, once a search
    has failed; so no part of the page is searched again for each tag before it."""

    def __init__(self, html: str):
        self.html, self.ends, self.none, self.stop = html, {}, set(), -1

    def find(self, text: str, at: int) -> int:
        if text in self.none:
            return -1
        found = self.html.find(text, at)
        if found < 0:
            self.none.add(text)
        return found

    def end(self, at: int) -> int:
        """Behind the bracket that closes the tag whose names and values begin at ``at``; -1 if none does."""
        seen, out = [], -1
        if self.stop < at:  # the first quote or bracket from here; places only grow
            m = _STOP.search(self.html, at)
            self.stop = m.start() if m else len(self.html)
        stop = self.stop
        while stop < len(self.html):
            if stop in self.ends:
                out = self.ends[stop]
                break
            seen.append(stop)
            if self.html[stop] == ">":
                out = stop + 1
                break
            close = self.find(self.html[stop], stop + 1)
            if close < 0:
                break
            m = _STOP.search(self.html, close + 1)
            stop = m.start() if m else len(self.html)
        for s in seen:
            self.ends[s] = out
        return out

    def tags(self):
        """(start, end, whether closing, name, attributes); comments, declarations and elements that hold no text have no name."""
        html, at, match = self.html, 0, _TAG.match
        while (at := html.find("<", at)) >= 0:
            m = match(html, at)
            if m:
                end, closing, name, attributes = m.end(), bool(m[1]), m[2].lower(), m[3]
            elif m := _OPEN.match(html, at):
                end, closing, name = self.end(m.end()), bool(m[1]), m[2].lower()
                if end < 0:
                    at += 1
                    continue
                attributes = html[m.end() : end - 1]
            if m:
                if name in RAW and not closing:
                    if not (name == "svg" and attributes.endswith("/")):
                        closed = None if name in self.none else _RAW_END[name].search(html, end)
                        if closed is None:
                            self.none.add(name)
                        end = closed.end() if closed else len(html)
                    name = ""
                yield at, end, closing, name, attributes
            else:
                if html.startswith("<!--", at):
                    end, size = self.find("-->", at + 4), 3
                elif html.startswith("<![CDATA[", at):
                    end, size = self.find("]]>", at + 9), 3
                elif html[at + 1 : at + 2] in ("!", "/", "?"):
                    end, size = self.find(">", at + 2), 1
                    if end < 0:
                        at += 1
                        continue
                else:
                    at += 1
                    continue
                end = len(html) if end < 0 else end + size
                yield at, end, False, "", ""
            at = end


@lru_cache(maxsize=10_000)
def marked(names: str, inside: bool) -> bool:
    """Whether a class or id says boilerplate: a part does and the others say nothing. An article's header isn't."""
    for name in names.split():
        parts = [p.lower() for p in _PART.split(name) if p]
        hits = [p for p in parts if p in MARKS and not (inside and p == "header")]
        if hits and all(p in MARKS or p in NEUTRAL or p[:1].isdigit() for p in parts):
            return True
    return False


def blocks_of(html: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks with text, in page order; a page without a container has no OWN block."""
    out: list[tuple[int, str, bool]] = []
    top = ("", OPEN, False, False, False, False)  # name, kind of its text (-1: none), inside a container, in a header there, in a link, in a heading
    stack: list[tuple] = []
    _, kind, inside, headed, link, title = top
    run, linked, at, found = [], 0, 0, False
    opened: dict[str, int] = {}  # elements of each name on the stack

    def flush():
        nonlocal linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text and kind >= 0:
                out.append((TITLE if title and kind == OWN else kind, text, not title and 100 * linked >= LINKED * len(text.split())))
            run.clear()
        linked = 0

    def add(text):
        nonlocal linked
        run.append(text)
        if link:
            linked += len(text.split())

    def pop():
        nonlocal kind, inside, headed, link, title
        gone = stack.pop()[0]
        opened[gone] -= 1
        _, kind, inside, headed, link, title = stack[-1] if stack else top
        return gone

    for start, end, closing, name, attributes in Scanner(html).tags():
        if start > at:
            add(html[at:start])
        at = end
        if not name:
            continue
        if name in BLOCK:
            flush()
        if closing:
            if opened.get(name):
                while pop() != name:
                    pass
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        ends = IMPLIED.get(name, {"p"} if name in BLOCK else ())
        while stack and stack[-1][0] in ends:
            pop()
        attrs = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(attributes)} if attributes else {}
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        new_kind, new_inside, new_headed = kind, inside, headed
        boiler = name in STRUCTURAL or attrs.get("role", "").lower() in ROLES or (name not in ("html", "body", "article", "main") and bool(attrs) and marked(names, inside))
        if name in HIDDEN:
            new_kind = -1
        elif kind == -1:
            pass
        elif name == "header":  # a container's header keeps its headings
            new_kind, new_headed = BOILER, inside and kind == OWN
        elif name in _HEADINGS and headed and not boiler:
            new_kind = OWN
        elif boiler:
            new_kind, new_headed = BOILER, False
        elif kind != BOILER and (name in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or CONTAINER.search(names) or attrs.get("itemprop", "").lower() == "articlebody"):
            if "comment" in names.lower():
                new_kind = BOILER
            else:
                new_kind, new_inside, found = OWN, True, True
        kind, inside, headed, link, title = new_kind, new_inside, new_headed, link or name == "a", title or name in _HEADINGS
        opened[name] = opened.get(name, 0) + 1
        stack.append((name, kind, inside, headed, link, title))
    if at < len(html):
        add(html[at:])
    flush()
    if found and any(k in (OWN, TITLE) for k, *_ in out):
        return [(BOILER if k == OPEN else k, t) for k, t, _ in out]
    menus = any(k in (OWN, OPEN) and not mostly for k, _, mostly in out)  # a page of links alone has no menu
    return [((BOILER if menus and mostly else OPEN) if k in (OWN, OPEN) else k, t) for k, t, mostly in out]


class Index:
    """Words of pages as symbols, and where runs of LEAST words start: position, page, hash, whether in the page's content."""

    def __init__(self, pages: list[list[tuple[int, str]]]):
        flat: list[bytes] = []
        self.pages, self.sizes, inside = pages, [], []
        for blocks in pages:
            kinds = (OWN, TITLE) if any(k in (OWN, TITLE) for k, _ in blocks) else (OPEN,)
            words = [t.encode().split() for _, t in blocks]
            sizes = [len(w) for w in words]
            for ws in words:
                flat += ws
            self.sizes.append(sizes)
            inside += [np.repeat(np.array([k in kinds for k, _ in blocks], bool), sizes)]
        ids = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        self.seq, size = np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat)), np.array([sum(x) for x in self.sizes], np.int64)
        self.words_before = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(pages)), size)
        start = np.arange(max(0, len(flat) - LEAST + 1))
        self.at = start[owner[start] == owner[start + LEAST - 1]]
        self.page = owner[self.at]
        self.content = (np.concatenate(inside) if inside else np.zeros(0, bool))[self.at]
        self.size = size
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))[self.seq] if ids else np.zeros(0, np.uint64)
        acc = np.zeros(len(start), np.uint64)
        for k in range(LEAST):
            acc ^= h[k : k + len(start)]
            acc *= np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
        self.hash = acc.view(np.int64)[self.at]

    def runs(self) -> np.ndarray:
        """The number of each run, equal runs having equal numbers, by a suffix array with a separator of its own after each page."""
        seq = np.insert(self.seq + 1, np.cumsum(self.size), self.seq.max(initial=0) + 2 + np.arange(len(self.pages)))
        return run_groups(seq)[self.at + self.page]

    def texts(self, marked: np.ndarray, most: np.ndarray) -> tuple[list[str], list[int]]:
        """Text and n_boilerplate of each page, given which runs are boilerplate and which are on most pages."""
        edge = np.zeros(len(self.seq) + LEAST + 1, np.int64)
        np.add.at(edge, self.at[marked], 1)
        np.add.at(edge, self.at[marked] + LEAST, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[: len(self.seq)] > 0)])
        common = np.zeros(len(self.seq) + 1, np.int64)
        common[self.at[most] + 1] = 1
        common = np.cumsum(common)
        out, n = [], []
        for blocks, sizes, at in zip(self.pages, self.sizes, self.words_before.tolist()):
            article = any(k in (OWN, TITLE) for k, _ in blocks)
            whole, kept, boiler = [], [], 0
            for (kind, t), size in zip(blocks, sizes):
                hit, runs = int(covered[at + size] - covered[at]), size - LEAST + 1
                if kind in (OWN, TITLE):
                    stays = kind == TITLE or runs < 1 or common[at + runs] - common[at] < runs
                    boiler += 0 if stays else size
                else:
                    stays = 100 * hit < COVERED * size
                    boiler += hit
                at += size
                if kind in (OWN, TITLE) if article else kind == OPEN:
                    whole.append(t)
                    if stays:
                        kept.append(t)
            n.append(boiler)
            out.append(" ".join(kept or whole))
        return out, n


def run_groups(seq: np.ndarray, least: int = LEAST) -> np.ndarray:
    """For each position the number of the run of ``least`` symbols that starts there; equal runs have equal numbers."""
    out = np.zeros(len(seq), np.int64)
    if not len(seq):
        return out
    order = suffix_array(seq)
    padded = np.concatenate([seq, -1 - np.arange(least)])
    alike = np.ones(len(order) - 1, bool)
    for k in range(least):
        alike &= padded[order[1:] + k] == padded[order[:-1] + k]
    out[order] = np.concatenate([[0], np.cumsum(~alike)])
    return out


def need_of(pages: int) -> tuple[int, int]:
    """Pages that make a run boilerplate, and a whole block of an article, on a host of so many distinct pages."""
    return max(LEAST_PAGES, -(-pages // SHARE)), max(LEAST_PAGES, -(-pages * MOST // 100))


def boilerplate_runs(run: np.ndarray, page: np.ndarray, h: np.ndarray, content: np.ndarray, same: np.ndarray, need: int) -> np.ndarray:
    """For occurrences (run number, page, hash, whether in the page's content) the number of pages that are evidence for their run.

    ``same`` gives each page's identity: pages that share it are one page. Runs on fewer than ``need`` pages are what tells pages apart.
    """
    if not len(run):
        return np.zeros(0, np.int64)
    key = (page * (int(run.max()) + 1) + run) * 2 + ~content
    order = np.argsort(key, kind="stable")
    key = key[order] >> 1
    first = np.concatenate([[True], key[1:] != key[:-1]])
    at = order[first]  # a run counts once a page, as content if it is anywhere
    r, owner, inside = run[at], same[page[at]], content[at]
    frequent = np.bincount(r, minlength=run.max() + 1) >= need
    rest = inside & ~frequent[r]
    n = np.bincount(owner[inside], minlength=same.max() + 1)
    left = np.bincount(owner[rest], minlength=len(n))
    key = np.full(len(n), np.iinfo(np.int64).max)
    np.minimum.at(key, owner[rest], h[at][rest])
    use = frequent[r] & ((left > 0) & (REST * left >= n))[owner]
    pairs = np.unique(np.stack([r[use], key[owner[use]]], 1), axis=0)
    return np.bincount(pairs[:, 0], minlength=len(frequent))[run]


def _blocks(raw: bytes) -> list[tuple[int, str]]:
    return blocks_of(raw.decode("utf-8", "replace"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_boilerplate (words outside articles in boilerplate runs of the host, and of blocks removed from articles)."""
    spark, ws = pages.sparkSession, Workspace(pages.sparkSession)
    C.small_batches(spark, 500)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[^:]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    base = pages.select("page_id", "url", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("same"), F.xxhash64("html").alias("copy"), "html")
    sizes = base.groupBy("host", "copy").agg(F.sum(F.octet_length("html")).alias("size"), F.count("*").alias("rows")).groupBy("host").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.count("*").alias("n"))
    sizes = ws.save(sizes, "hosts")
    split = sizes.where(F.col("size") > SHARD_BYTES)
    large = split.select("host", "rows", F.ceil(F.col("size") / SHARD_BYTES).cast("long").alias("shards"), F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("n") / SHARE)).cast("long").alias("need"), F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("n") * MOST / 100)).cast("long").alias("half"))
    some = lambda df: F.broadcast(df) if df.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else df  # noqa: E731  else Spark joins by host
    large = some(ws.save(large, "large"))
    total = dict(sizes.groupBy((F.col("size") > SHARD_BYTES).alias("split")).agg(F.sum("size")).collect())
    tasks = lambda split: int(-(-(total.get(split) or 1) // TASK_BYTES))
    fields = [base.schema[c] for c in ("page_id", "url")] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_boilerplate", T.LongType())]
    out_schema = T.StructType(fields)
    arrow = to_arrow_schema(out_schema)

    def result(page_id, url, index: Index, boilerplate: np.ndarray, most: np.ndarray) -> list[pa.Array]:
        texts, n = index.texts(boilerplate, most)
        return [page_id, url, pa.array(texts, arrow.field(2).type), pa.array([len(t) for t in texts], arrow.field(3).type), pa.array(n, arrow.field(4).type)]

    # hosts that fit in a task
    def whole_host(table: pa.Table) -> pa.Table:
        index = Index([_blocks(b) for b in C.texts_of(table["html"])])
        same = np.unique(table["same"].to_numpy(), return_inverse=True)[1]
        need, half = need_of(len(np.unique(table["copy"].to_numpy())))
        pages = boilerplate_runs(index.runs(), index.page, index.hash, index.content, same, need)
        return pa.Table.from_arrays(result(table["page_id"], table["url"], index, pages >= need, pages >= half), schema=arrow)

    small = base.join(large.select("host"), "host", "left_anti").repartition(tasks(False), "host").groupBy("host").applyInArrow(whole_host, out_schema)
    if not total.get(True):
        return small

    # frequent runs of the shards of the others
    def shard(table: pa.Table) -> pa.Table:
        index = Index([_blocks(b) for b in C.texts_of(table["html"])])
        run, rows = index.runs(), table.num_rows
        enough = lambda n: n * table["rows"][0].as_py() >= table["need"][0].as_py() * rows
        many = enough(np.bincount(run, minlength=1))[run]
        pairs = np.unique(run[many] * rows + index.page[many])
        often = enough(np.bincount(pairs // rows, minlength=int(run.max(initial=0)) + 1))
        h = np.unique(index.hash[often[run]])
        return pa.table([pa.array([table["host"][0].as_py()] * len(h), pa.string()), pa.array(h)], names=["host", "h"])

    dealt = base.join(large, "host").withColumn("shard", F.pmod("same", "shards"))
    maybe = dealt.select("host", "shard", "rows", "need", "html").repartition(tasks(True), "host", "shard").groupBy("host", "shard").applyInArrow(shard, "host string, h long")
    maybe = ws.save(maybe.distinct(), "maybe")

    # what each page has of them: n runs of its content, left of them with least hash key that can't be frequent, and the others
    mine = base.join(large.select("host"), "host").select("host", "same", "html")
    page_schema = "host string, same long, n long, left long, key long, hits array<long>, own array<boolean>"
    lookup = _lookup(spark, maybe)
    if lookup is not None:

        def report(batches):
            for b in filter(len, batches):
                index = Index([_blocks(x) for x in C.texts_of(b.column(2))])
                cut = np.searchsorted(index.page, np.arange(b.num_rows + 1))
                out = []
                for i, name in enumerate(b.column(0).to_pylist()):
                    h, content = _distinct(index.hash[cut[i] : cut[i + 1]], index.content[cut[i] : cut[i + 1]])
                    hit = np.isin(h, lookup.value.get(name, _NONE))
                    rest = h[content & ~hit]
                    out.append((int(content.sum()), len(rest), int(rest.min()) if len(rest) else None, h[hit].tolist(), content[hit].tolist()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_())))]], names=["host", "same", "n", "left", "key", "hits", "own"])

        reports = mine.mapInArrow(report, page_schema)
    else:

        def grams(batches):
            for b in filter(len, batches):
                index = Index([_blocks(x) for x in C.texts_of(b.column(2))])
                cut = np.searchsorted(index.page, np.arange(b.num_rows + 1))
                found = [_distinct(index.hash[cut[i] : cut[i + 1]], index.content[cut[i] : cut[i + 1]]) for i in range(b.num_rows)]
                take = pa.array(np.repeat(np.arange(b.num_rows), [len(h) for h, _ in found]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate([h for h, _ in found])), pa.array(np.concatenate([c for _, c in found]))], names=["host", "same", "h", "content"])

        runs = mine.mapInArrow(grams, "host string, same long, h long, content boolean").join(maybe.withColumn("hit", F.lit(True)), ["host", "h"], "left")
        rest = F.col("content") & F.col("hit").isNull()
        hits = F.collect_set(F.when(F.col("hit"), F.struct("h", "content")))
        reports = runs.groupBy("host", "same").agg(F.count_if("content").alias("n"), F.count_if(rest).alias("left"), F.min(F.when(rest, F.col("h"))).alias("key"), hits.alias("x"))
        reports = reports.select("host", "same", "n", "left", "key", F.col("x.h").alias("hits"), F.col("x.content").alias("own"))
    reports = ws.save(reports, "reports").dropDuplicates(["host", "same"])
    each = reports.select("host", "same", "n", "left", "key", F.explode(F.arrays_zip("hits", "own")).alias("x")).select("host", "same", "n", "left", "key", F.col("x.hits").alias("h"), F.col("x.own").alias("content"))
    often = each.groupBy("host", "h").agg(F.count("*").alias("pages")).join(large, "host").where("pages >= need").select("host", "h", F.lit(True).alias("often"))
    each = each.join(often, ["host", "h"], "left")
    rest = F.col("content") & F.col("often").isNull()
    evidence = each.groupBy("host", "same", "n", "left", "key").agg(F.count_if(rest).alias("more"), F.min(F.when(rest, F.col("h"))).alias("least"), F.collect_list(F.when(F.col("often"), F.col("h"))).alias("h"))
    evidence = evidence.select("host", "n", (F.col("left") + F.col("more")).alias("left"), F.least("key", "least").alias("key"), "h")
    evidence = evidence.where(f"left > 0 and {REST} * left >= n").select("host", "key", F.explode("h").alias("h")).distinct()
    known = ws.save(evidence.groupBy("host", "h").agg(F.count("*").alias("pages")).join(large, "host").where("pages >= need").select("host", "h", (F.col("pages") >= F.col("half")).alias("most")), "known")

    sets = _lookup(spark, known)
    ready = base.join(large.select("host"), "host").select("page_id", "url", "host", "html", "same")
    if sets is not None:
        common = _lookup(spark, known.where("most"))
        ready = ready.select("page_id", "url", "host", "html")
    else:  # each page gets those of its own runs
        own = reports.select("host", "same", F.explode("hits").alias("h")).join(known, ["host", "h"]).groupBy("host", "same")
        own = own.agg(F.collect_list("h").alias("known"), F.collect_list(F.when(F.col("most"), F.col("h"))).alias("common"))
        ready = ready.join(own, ["host", "same"], "left").select("page_id", "url", "host", "html", "known", "common")

    def page_by_page(batches):
        for b in filter(len, batches):
            index = Index([_blocks(x) for x in C.texts_of(b.column(3))])
            names = b.column(2).to_pylist()
            cut = np.searchsorted(index.page, np.arange(b.num_rows + 1))
            marks = []
            for k, lookup in enumerate((sets, common) if sets is not None else (None, None)):
                own = [lookup.value.get(x, _NONE) for x in names] if lookup is not None else [np.array(x or [], np.int64) for x in b.column(4 + k).to_pylist()]
                marks.append(np.concatenate([np.isin(index.hash[cut[i] : cut[i + 1]], own[i]) for i in range(b.num_rows)]))
            yield pa.RecordBatch.from_arrays(result(b.column(0), b.column(1), index, *marks), schema=arrow)

    return small.unionByName(ready.mapInArrow(page_by_page, out_schema))


_NONE = np.zeros(0, np.int64)


def _distinct(h: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a page, and whether each is in its content anywhere."""
    found, place = np.unique(h, return_inverse=True)
    inside = np.zeros(len(found), bool)
    inside[place[content]] = True
    return found, inside


def _lookup(spark, runs: DataFrame):
    """(host, h) as a broadcast dictionary of arrays, None where they are more than BROADCAST_RUNS."""
    if runs.limit(BROADCAST_RUNS + 1).count() > BROADCAST_RUNS:
        return None
    by_host: dict[str, list[int]] = {}
    for r in runs.collect():  # BROADCAST_RUNS at most
        by_host.setdefault(r["host"], []).append(r["h"])
    return spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in by_host.items()})
