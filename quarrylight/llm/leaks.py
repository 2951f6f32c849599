"""Passages of evaluation items inside documents, whole or in part and changed in form.

Method: an item's own wording (without an instruction that several items share) is cut into consecutive pieces of
``PIECE`` words. One passage of ``WORDS`` words holds 7 or more whole pieces, two passages together 6 or more, so with
fewer edits than that, the error budget, one piece at least is whole: pigeonhole. Exact piece hits are found for a
whole batch of documents at once in a sorted table of piece codes; hits of one item that lie in order on near diagonals
are chained; every chain, of one hit too, is extended over edits, and its widest window whose Myers distance between
the item's and the document's words stays within ``EDITS`` of the item's own words is a passage. A document holds an
item if one passage, or two in order and of any length, cover ``WORDS`` of its words; an edited word at an outer end of
a passage can't be told from one that was never there, so each edit found, up to ``ENDS``, adds one word. If passages
fall short, runs of equal words that hold no whole piece of the item are looked for too.

Words are compared after compatibility decomposition, without marks and invisible characters, in lower case, letters of
other scripts that look Latin read as Latin, markup tags and entities dropped.

The items are the stated query set: their shared wording is counted in Spark, then they are read in blocks of ``BLOCK``
words, each block's tables are broadcast; the documents are read once per block and never leave their partition.

Defined results: null and empty texts hold nothing and leak nothing; items of the same text are all reported; repeated
documents are each reported under their id; an item shorter than ``WORDS`` words can't leak; null ids of items are left out.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow, work_path

WORDS, PIECE = 25, 3
#: Words of the items of one block; also keeps the piece codes of a block apart in 63 bits.
BLOCK = 2_000_000
#: A first sentence, or a run of up to ``PIECE`` words, that so many different items hold is not an item's own wording.
SHARED = 3
#: Edits allowed for each own word that a passage covers.
EDITS = 0.34
#: Words at the outer ends of passages that may be edited ones: at most so many, and one for each edit found.
ENDS = 2
#: From so many words on a run of equal words is looked for without a hit: a piece of ``2 * PIECE - 1`` words always has one.
RUN = 2 * PIECE - 2
#: The most words that an extension steps over at once.
STEP = 7
#: The largest gap between chained hits, and how far they may leave their diagonal.
GAP, DRIFT = 16, 7

#: Letters of other scripts and the Latin letters they look like (fixed values).
LOOKS = str.maketrans(
    "аавсԁеёгһіїјкӏмпорԛгѕтυυνѡхуᴢɡ" + "αβεικνορτυχγω",
    "aabcdeerhiijklmnopqrstuuvwxyzg" + "abeiknoptuxyw",
)
TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
BREAK = re.compile(r"(?<=[^\W\d_])[-‐]\s*\n[>*#/ \t]*(?=[^\W\d_])")
ESCAPE = re.compile(r"\\\\?[nrt](?![a-z]{1,2}\b)")
TOKEN = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n+")


def words(text: str | None) -> list[str]:
    """The comparable words of a text."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if c < "\x80" or unicodedata.category(c) not in ("Mn", "Me", "Cf", "Cc") or c in "\n\t")
        text = text.lower().translate(LOOKS)
    if "\\" in text:
        text = ESCAPE.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "-\n" in text or "‐" in text:
        text = BREAK.sub("", text)
    return TOKEN.findall(text.lower())


def myers(pattern: list[int], text: list[int]) -> int:
    """Edit distance of two word lists, the pattern's rows as bits of one integer."""
    m = len(pattern)
    if not m:
        return len(text)
    eq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = mask, 0, m
    for w in text:
        e = eq.get(w, 0)
        v = e | down
        h = (((e & up) + up) ^ up) | e
        more, less = down | (~(h | up) & mask), up & h
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = (more << 1) | 1, less << 1
        up, down = (less | ~(v | more)) & mask, more & v & mask
    return score


class Items:
    """Tables of one block of items: id, own words, and for runs of one to three words the places of shared ones."""

    def __init__(self, rows: Iterable[tuple[int, list[str], list[list[int]]]]):
        own = {i: (ws, marks) for i, ws, marks in rows if len(ws) >= WORDS}
        self.code = {w: n for n, w in enumerate(sorted({w for ws, _ in own.values() for w in ws}))}
        self.size = len(self.code) + 1
        self.ids = sorted(own)
        self.own = [[self.code[w] for w in own[i][0]] for i in self.ids]
        self.shared = [[set(m) for m in own[i][1]] for i in self.ids]
        #: Words before each place that no shared run of three covers.
        self.told = []
        for ws, marks in zip(self.own, self.shared):
            covered = {q + j for q in marks[PIECE - 1] for j in range(PIECE)}
            self.told.append([0, *accumulate(q not in covered for q in range(len(ws)))])
        self._pairs: dict[int, dict[tuple[int, ...], list[int]]] = {}
        keys, item, place = [], [], []
        for n, ws in enumerate(self.own):
            for q in range(0, len(ws) - PIECE + 1, PIECE):
                keys.append(self._key(ws[q : q + PIECE]))
                item.append(n)
                place.append(q)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.item, self.place = np.array(item, dtype=np.int64)[order], np.array(place, dtype=np.int64)[order]

    def pairs_of(self, n: int) -> dict[tuple[int, ...], list[int]]:
        """The runs of two words of the n-th item, worked out once."""
        if n not in self._pairs:
            self._pairs[n] = grams(self.own[n], 2)
        return self._pairs[n]

    def _key(self, ws: list[int]) -> int:
        out = 0
        for w in ws:
            out = (out * self.size + w) & (1 << 63) - 1
        return out

    def hits(self, docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Exact piece hits: document, item, place in the item, place in the document."""
        none = np.zeros(0, dtype=np.int64)
        lens = np.array([len(d) for d in docs], dtype=np.int64)
        if not len(self.keys) or not lens.sum():
            return none, none, none, none
        flat = np.fromiter((w for d in docs for w in d), dtype=np.int64, count=int(lens.sum()))
        doc = np.repeat(np.arange(len(docs)), lens)
        begin = np.concatenate(([0], np.cumsum(lens)[:-1]))
        n = len(flat) - PIECE + 1
        if n <= 0:
            return none, none, none, none
        key, ok = np.zeros(n, dtype=np.int64), doc[:n] == doc[PIECE - 1 :]
        for j in range(PIECE):
            part = flat[j : j + n]
            key = key * self.size + np.maximum(part, 0) & (1 << 63) - 1
            ok &= part >= 0
        at = np.flatnonzero(ok)
        lo, hi = np.searchsorted(self.keys, key[at], "left"), np.searchsorted(self.keys, key[at], "right")
        some = hi > lo
        at, lo, hi = at[some], lo[some], hi[some]
        many = hi - lo
        row = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        where = np.repeat(at, many)
        return doc[where], self.item[row], self.place[row], where - begin[doc[where]]


Seed = tuple[int, int, int]


def chains(seeds: list[Seed]) -> list[list[Seed]]:
    """Chains of seeds (place in the item, in the document, words), heaviest first: in order, near one diagonal.

    Every seed lies in one chain: a chain takes its own seeds only, so that repeated and crossing copies each have theirs.
    """
    seeds = sorted(set(seeds), key=lambda h: (h[1], h[0]))
    best, back = [h[2] for h in seeds], [-1] * len(seeds)
    for j, (q, p, n) in enumerate(seeds):
        for i in range(j - 1, -1, -1):
            a, b, _ = seeds[i]
            if p - b > GAP + DRIFT + RUN:
                break
            if a < q <= a + GAP and b < p and abs((p - q) - (b - a)) <= DRIFT and best[i] + n > best[j]:
                best[j], back[j] = best[i] + n, i
    out, taken = [], [False] * len(seeds)
    for j in sorted(range(len(seeds)), key=lambda x: (-best[x], seeds[x])):
        chain = []
        while j >= 0 and not taken[j]:
            taken[j] = True
            chain.append(seeds[j])
            j = back[j]
        if chain:
            out.append(chain[::-1])
    return sorted(out, key=lambda c: (-sum(x[2] for x in c), c))


#: Gaps between matched words that an extension steps over, the cheapest first: words of the item and of the document.
GAPS = [
    (c + 1, c + 1 - k) if side else (c + 1 - k, c + 1)
    for c in range(1, STEP + 1)
    for k in range(c + 1)
    for side in ((0, 1) if k else (0,))
]


def extended(item: list[int], doc: list[int], common: set[int], q: int, p: int, step: int) -> list[tuple[int, int]]:
    """Places of the equal words that small edits lead to from a match, forward or back.

    A step over edits needs two equal words among the next three, so that a chance word alone leads nowhere; over one
    edit a single word does that isn't ``common``.
    """
    out = []
    n, m = len(item), len(doc)
    while True:
        q, p = q + step, p + step
        if not (0 <= q < n and 0 <= p < m):
            return out
        if item[q] == doc[p]:
            out.append((q, p))
            continue
        for a, b in GAPS:
            x, y = q + step * (a - 1), p + step * (b - 1)
            if 0 <= x < n and 0 <= y < m and item[x] == doc[y]:
                x1, y1, x2, y2 = x + step, y + step, x + 2 * step, y + 2 * step
                one = a <= 2 and b <= 2 and x not in common
                if one or 0 <= x1 < n and 0 <= y1 < m and item[x1] == doc[y1] or 0 <= x2 < n and 0 <= y2 < m and item[x2] == doc[y2]:
                    out.append((x, y))
                    q, p = x, y
                    break
        else:
            return out


def blocks(item: list[int], doc: list[int], common: set[int], chain: list[Seed]) -> list[tuple[int, int, int, int]]:
    """Runs of equal words along a chain and its extensions: places, length, and edits since the run before."""
    (q, p, _), (u, v, n) = chain[0], chain[-1]
    hits = [(a + j, b + j) for a, b, k in chain for j in range(k)]
    out: list[list[int]] = []
    for q, p in [*extended(item, doc, common, q, p, -1)[::-1], *hits, *extended(item, doc, common, u + n - 1, v + n - 1, 1)]:
        if not out:
            out.append([q, p, 1, 0])
            continue
        a, b = out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]
        if q == a and p == b:
            out[-1][2] += 1
        elif q >= a and p >= b:
            out.append([q, p, 1, myers(item[a:q], doc[b:p])])
    return [tuple(x) for x in out]


def passage(item: list[int], doc: list[int], told: list[int], common: set[int], chain: list[Seed]) -> tuple[int, int, int, int, int] | None:
    """The widest verified window along a chain: edits, then its spans in the item and in the document.

    A window is verified if Myers' distance between its item words and document words stays within ``EDITS`` of the item's
    own words in it; edits against wording that several items share prove nothing.
    """
    parts = blocks(item, doc, common, chain)
    best = None
    for i in range(len(parts)):
        edits, qa, pa_ = 0, parts[i][0], parts[i][1]
        for j in range(i, len(parts)):
            q, p, n, c = parts[j]
            edits += c if j > i else 0
            qb, pb = q + n - 1, p + n - 1
            if best and qb - qa <= best[2] - best[1]:
                continue
            allowed = EDITS * (told[qb + 1] - told[qa])
            # the counted edits bound the distance from above; where they are too many, the distance itself decides
            if edits <= allowed or (edits <= 2 * allowed and (d := myers(item[qa : qb + 1], doc[pa_ : pb + 1])) <= allowed):
                best = (edits if edits <= allowed else d, qa, qb, pa_, pb)
    if best and best[0]:
        exact = myers(item[best[1] : best[2] + 1], doc[best[3] : best[4] + 1])
        best = (exact, *best[1:])
    return best


def grams(item: list[int], least: int) -> dict[tuple[int, ...], list[int]]:
    """The places of each run of ``least`` words."""
    at: dict[tuple[int, ...], list[int]] = {}
    for q, gram in enumerate(zip(*(item[j:] for j in range(least)))):
        at.setdefault(gram, []).append(q)
    return at


def runs(item: list[int], doc: list[int], shared: list[set[int]], least: int, at: dict[tuple[int, ...], list[int]] | None = None) -> list[Seed]:
    """All longest runs of ``least`` or more equal words; ``at`` has the item's.

    A run shorter than a piece counts only where it is the item's own: one or two words that several items hold are chance.
    """
    at = grams(item, least) if at is None else at
    out = []
    for p, gram in enumerate(zip(*(doc[j:] for j in range(least)))):
        if gram not in at:
            continue
        for q in at[gram]:
            if q and p and item[q - 1] == doc[p - 1]:
                continue
            n = least
            while q + n < len(item) and p + n < len(doc) and item[q + n] == doc[p + n]:
                n += 1
            if n >= PIECE or q not in shared[n - 1]:
                out.append((q, p, n))
    return out


def held(found: list[tuple[int, int, int, int, int]]) -> tuple[int, int]:
    """The most item words that one passage, or two in order, cover: with the words that edited ends may add, and without.

    An edited word at the outer end of a passage can't be seen; so every edit found adds one word, up to ``ENDS`` for the
    ends of one passage or of both, and two passages of ``RUN`` words, which have four ends, one more.
    One sweep over the document: the best passage that ended before, by its end in the item, its edits and size.
    """
    worth = [(f[2] - f[1] + 1, min(f[0], ENDS), *f[1:]) for f in found]
    best = max(((n + e, n) for n, e, *_ in worth), default=(0, 0))
    ended = sorted(worth, key=lambda f: f[5])
    by: dict[tuple[int, int, bool], int] = {}
    k = 0
    for n, e, q, _, p, _ in sorted(worth, key=lambda f: f[4]):
        while k < len(ended) and ended[k][5] < p:
            a = ended[k]
            key = (a[3], a[1], a[0] >= RUN)
            by[key] = max(by.get(key, 0), a[0])
            k += 1
        best = max(best, max(((n + m + min(e + e2, ENDS) + (long and n >= RUN), n + m) for (end, e2, long), m in by.items() if end < q), default=(0, 0)))
    return best


def matches(items: Items, texts: list[str | None], least: int = WORDS) -> Iterator[tuple[int, int, int]]:
    """Row, item id and words covered, for every document row that holds an item."""
    get = items.code.get
    docs = [[get(w, -1) for w in words(t)] for t in texts]
    d, i, q, p = items.hits(docs)
    pair = d * max(1, len(items.ids)) + i
    order = np.argsort(pair, kind="stable")
    pair, q, p = pair[order], q[order], p[order]
    start = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, dtype=np.int64)
    end = np.concatenate((start[1:], [len(pair)]))
    # of two pieces the longer one covers half of the words, but for edited ends; a hit that leads nowhere covers a piece
    half = (least - ENDS) // 2
    grow = grows(items, docs, pair // max(1, len(items.ids)), pair % max(1, len(items.ids)), q, p)
    told_ = np.add.reduceat(grow, start) > 0 if len(start) and half > PIECE else np.ones(len(start), dtype=bool)
    for s, e in zip(start[told_], end[told_]):
        row, n = divmod(int(pair[s]), len(items.ids))
        own, doc, told, shared = items.own[n], docs[row], items.told[n], items.shared[n]
        lone = {(x, y) for x, y, g in zip(q[s:e].tolist(), p[s:e].tolist(), grow[s:e].tolist()) if not g}
        found = []
        for c in chains([(x, y, PIECE) for x, y in zip(q[s:e].tolist(), p[s:e].tolist())]):
            if len(c) == 1 and c[0][:2] in lone:
                found.append((0, c[0][0], c[0][0] + PIECE - 1, c[0][1], c[0][1] + PIECE - 1))
            elif f := passage(own, doc, told, shared[0], c):
                found.append(f)
        if max((f[2] - f[1] + 1 for f in found), default=0) < min(half, least - ENDS):
            continue
        with_ends, covered = held(found)
        if with_ends < least:
            # pieces without a whole piece of the item, and pieces that an extension ran into
            seeds = runs(own, doc, shared, 2, items.pairs_of(n))
            found += [f for c in chains(seeds) if (f := passage(own, doc, told, shared[0], c))]
            if with_ends + 1 >= least:
                seeds = runs(own, doc, shared, 1)
            found += [(0, x, x + k - 1, y, y + k - 1) for x, y, k in seeds]
            with_ends, covered = held(found)
        if with_ends >= least:
            yield row, items.ids[n], covered


def grows(items: Items, docs: list[list[int]], d: np.ndarray, i: np.ndarray, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether ``extended`` leads anywhere from each hit, forward or back."""

    def flat(rows: list[list[int]], fill: int) -> tuple[np.ndarray, np.ndarray]:
        pad = [fill] * (STEP + 4)
        begin = np.cumsum([len(pad)] + [len(r) + len(pad) for r in rows])[:-1]
        return np.fromiter((w for r in rows for w in (*pad, *r)), dtype=np.int64, count=sum(map(len, rows)) + len(pad) * len(rows)), begin

    out = np.zeros(len(q), dtype=bool)
    if not len(q):
        return out
    (a, at), (b, bt) = flat([*items.own, []], -2), flat([*docs, []], -1)
    for step, x, y in ((-1, at[i] + q, bt[d] + p), (1, at[i] + q + PIECE - 1, bt[d] + p + PIECE - 1)):
        out |= a[x + step] == b[y + step]
        left = np.flatnonzero(~out)
        for j, k in GAPS:
            u, v = x[left] + step * j, y[left] + step * k
            same = a[u] == b[v]
            if same.any():
                w = np.flatnonzero(same)
                u, v = u[w], v[w]
                out[left[w]] |= (a[u + step] == b[v + step]) | (a[u + 2 * step] == b[v + 2 * step]) | (max(j, k) <= 2)
    return out


def own_wording(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, own words, and for runs of one to ``PIECE`` words the places whose run ``SHARED`` different items hold.

    First sentences that ``SHARED`` different items begin with are instructions and are cut off. All counts are over all
    items and over different texts, so that repeated items don't make their own wording a shared one.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, bodies = [], []
            for t in b.column(1).to_pylist():
                first, *rest = SENTENCE.split(t.strip(), maxsplit=1)
                heads.append(words(first))
                bodies.append(words(rest[0]) if rest else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(heads, pa.list_(pa.string())), pa.array(bodies, pa.list_(pa.string()))], names=["item_id", "head", "body"])

    rows = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text")).filter("item_id is not null and length(text) > 0")
    rows = map_arrow(rows, split, "item_id bigint, head array<string>, body array<string>").dropDuplicates(["item_id"])
    at = work_path(items.sparkSession, "items")
    rows.write.parquet(at)
    rows = items.sparkSession.read.parquet(at)
    heads = rows.filter(F.size("head") > 0).groupBy("head").agg(F.count_distinct("body").alias("n")).filter(F.col("n") >= SHARED)
    cut = rows.join(heads, "head", "left").select("item_id", F.when(F.col("n").isNotNull(), F.col("body")).otherwise(F.concat("head", "body")).alias("own"))
    cut = cut.filter(F.size("own") >= WORDS)
    at = work_path(items.sparkSession, "own-wording")
    cut.write.parquet(at)
    cut = items.sparkSession.read.parquet(at)
    grams = None
    for n in range(1, PIECE + 1):
        one = cut.select("item_id", F.xxhash64("own").alias("key"), F.posexplode(F.expr(f"transform(sequence(0, size(own) - {n}), q -> slice(own, q + 1, {n}))")).alias("place", "gram"))
        grams = one if grams is None else grams.unionByName(one)
    often = grams.groupBy("gram").agg(F.count_distinct("key").alias("n")).filter(F.col("n") >= SHARED).select("gram")
    marks = grams.join(often, "gram").groupBy("item_id").agg(*[F.collect_set(F.when(F.size("gram") == n, F.col("place"))).alias(f"m{n}") for n in range(1, PIECE + 1)])
    none = F.array().cast("array<int>")
    return cut.join(marks, "item_id", "left").select("item_id", "own", *[F.coalesce(f"m{n}", none).alias(f"m{n}") for n in range(1, PIECE + 1)])


def item_blocks(rows: Iterable) -> Iterator[list]:
    """Items in blocks of ``BLOCK`` words, or of one item where that alone has more."""
    block, size = [], 0
    for r in rows:
        if block and size + len(r[1]) > BLOCK:
            yield block
            block, size = [], 0
        block.append((r[0], r[1], list(r[2:])))
        size += len(r[1])
    yield block


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = WORDS) -> DataFrame:
    """doc_id, item_id and words covered of every document that holds an item's passage."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).filter(F.length("text") > 0)
    out = None
    for block in item_blocks(own_wording(items, item_id, item_text).toLocalIterator()):
        sent = spark.sparkContext.broadcast(Items(block))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids_, texts_ = b.column(0).to_pylist(), b.column(1).to_pylist()
                got = [(ids_[r], i, k) for r, i, k in matches(sent.value, texts_, least)]
                yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], pa.int64()) for j in range(3)], names=["doc_id", "item_id", "words"])

        part = map_arrow(rows, run, "doc_id bigint, item_id bigint, words bigint")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
