"""Evaluation texts that have leaked into a corpus.

Texts are compared as streams of letters and digits: compatibility forms and accents folded, case, white space,
punctuation and mark-up dropped. Terms are character n-grams of the stream, one length for alphabetic writing and one
for Han characters.

The evaluation items are the documents of a BM25 inverted index whose postings are cut into blocks with their largest
impact. Every passage of the corpus is a query: a bound from the largest impacts of its terms rules out nearly all, the
others run block-max WAND and retrieve all items above their threshold. A threshold belongs to its item: a part of the
least weight that a stretch long enough to count can have in it. Short items, in which such a stretch may hold no long
gram, are indexed by short grams besides. For the retrieved items the shared stretch is aligned: matching runs are
chained in order, across single changed, added or dropped words, and the item's share in the chain decides.

All of every text is queried, in overlapping passages, in batches of rows and with no shuffle but one that spreads a
table read in fewer parts than there are cores. The index is broadcast; items beyond INDEX_CHARS characters are indexed
and queried in several rounds of that size, with the statistics of all items, so that the pairs are the same.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.spreading import spread
from linkloom.session import Scratch

#: Characters of items in one broadcast index.
INDEX_CHARS = 4_000_000
LATIN_GRAM, HAN_GRAM = 14, 5
#: Shorter grams for the alignment of retrieved pairs.
FINE_LATIN, FINE_HAN = 7, 3
PASSAGE, STRIDE = 256, 128
#: A passage is looked at if its BM25 weight in an item is SLACK of that of the item's lightest stretch that would count,
#: or that of so many average terms if this is less.
LEAST_TERMS, SLACK = 30, 0.35
#: Items of fewer letters, a Han character for three, are indexed by the short grams as well.
SHORT_ITEM = 120
#: The part of an aligned stretch that must match letter by letter.
DENSITY = 0.66
K1, B = 1.2, 0.75
BLOCK = 16

_TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]{0,80}>")
_ODD = re.compile(r"[\W_]+")


def stream(text: str) -> str:
    """Letters and digits of a text in comparison form."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return _ODD.sub("", text.casefold())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _is_han(points: np.ndarray) -> np.ndarray:
    return ((points >= 0x3040) & (points <= 0x9FFF)) | ((points >= 0xAC00) & (points <= 0xD7AF)) | ((points >= 0xF900) & (points <= 0xFAFF)) | (points >= 0x20000)


def _rolling(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every window of n code points."""
    size = len(points) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    h = np.full(size, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ points[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def grams(points: np.ndarray, latin: int, han: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the n-grams that are all Han or have no Han at all, by position."""
    is_han = _is_han(points)
    before = np.concatenate([[0], np.cumsum(is_han)])
    out = []
    for n, want in ((latin, 0), (han, han)):
        if len(points) >= n:
            at = np.flatnonzero((before[n:] - before[:-n]) == want)
            out.append((at, _rolling(points, n)[at]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, h = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    order = np.argsort(at, kind="stable")
    return at[order], h[order]


def index_terms(points: np.ndarray) -> np.ndarray:
    """Hashes of the index terms of one item, in order of place; short grams are terms of their own."""
    _, terms = grams(points, LATIN_GRAM, HAN_GRAM)
    if is_short(points):
        _, fine = grams(points, FINE_LATIN, FINE_HAN)
        terms = np.concatenate([terms, _as_fine(fine)])
    return terms


def is_short(points: np.ndarray) -> bool:
    return len(points) + 2 * int(_is_han(points).sum()) < SHORT_ITEM


def _as_fine(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xD6E8FEB86659FD93)


class Index:
    """Inverted BM25 index of the items with block maxima; impacts are in units of the item's threshold.

    df, n_items and mean_length are those of all items where only a part of them is indexed.
    """

    def __init__(self, items: list[tuple[int, str]], *, least_share: float = 0.4, df: tuple[np.ndarray, np.ndarray] | None = None, n_items: int | None = None, mean_length: float | None = None):
        self.ids = [i for i, _ in items]
        self.points = [_points(stream(t or "")) for _, t in items]
        placed = [index_terms(p) for p in self.points]
        per = [np.unique(t, return_counts=True) for t in placed]
        lengths = np.array([c.sum() for _, c in per], float)
        term = np.concatenate([h for h, _ in per]) if per else np.empty(0, np.uint64)
        tf = np.concatenate([c for _, c in per]) if per else np.empty(0, int)
        doc = np.repeat(np.arange(len(per)), np.array([len(h) for h, _ in per], int))
        order = np.lexsort((doc, term))
        term, tf, doc = term[order], tf[order].astype(float), doc[order]
        #: Postings of term k: documents and impacts from starts[k] to starts[k + 1].
        self.terms, first, own = np.unique(term, return_index=True, return_counts=True)
        self.starts, self.docs = np.append(first, len(term)), doc
        known = own if df is None else df[1][np.searchsorted(df[0], self.terms)]
        n = n_items or len(items)
        idf = np.log(1 + (n - known + 0.5) / (known + 0.5))
        size = lengths[doc] / max(1.0, mean_length or (lengths.mean() if len(items) else 1.0))
        weight = np.repeat(idf, own) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size))
        # Terms of one item are sorted, so a term's weight in it is found by bisection.
        by_item = np.lexsort((term, doc))
        bounds = np.searchsorted(doc[by_item], np.arange(len(items) + 1))
        self.limits = np.ones(len(items))
        for k, p in enumerate(self.points):
            at = by_item[bounds[k] : bounds[k + 1]]
            if len(at):
                self.limits[k] = self._limit(p, term[at], weight[at], least_share)
        self.impacts = weight / self.limits[doc]
        self.bound = np.maximum.reduceat(self.impacts, first) if len(first) else np.empty(0)
        #: The largest impact within each block of items, repeated for every posting of the block.
        block = doc // BLOCK
        edge = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(term) else np.empty(0, int)
        best = np.maximum.reduceat(self.impacts, edge) if len(edge) else np.empty(0)
        self.block_best = np.repeat(best, np.diff(np.append(edge, len(term))))
        self.threshold = 1.0
        self.short = any(is_short(p) for p in self.points)
        self._fine: dict[int, dict[int, list[int]]] = {}
        self._postings: dict[int, tuple] = {}

    @staticmethod
    def _limit(points: np.ndarray, terms: np.ndarray, weight: np.ndarray, least_share: float) -> float:
        """The weight from which the item is looked at. A passage holds any stretch of STRIDE characters whole."""
        length = min(int(np.ceil(least_share * len(points))), STRIDE)
        total = np.zeros(len(points) + 1)
        for latin, han, fine in ((LATIN_GRAM, HAN_GRAM, False), (FINE_LATIN, FINE_HAN, True)):
            if fine and not is_short(points):
                continue
            at, h = grams(points, latin, han)
            ends = at + np.where(_is_han(points)[at], han, latin)
            value = weight[np.searchsorted(terms, _as_fine(h) if fine else h)]
            # The weight of the grams that lie in a window is the sum of those that end in it less those begun before it.
            begun, ended = (np.concatenate([[0.0], np.cumsum(np.bincount(x, value, len(points) + 1))]) for x in (at, ends))
            windows = np.maximum(0.0, ended[length + 1 :] - begun[: len(begun) - length - 1])
            total[: len(windows)] += windows
        least = total[: max(1, len(points) - length + 1)]
        least = least[least > 0]
        common = LEAST_TERMS * float(np.mean(weight))
        return float(min(common, SLACK * least.min())) if len(least) else SLACK * float(weight.min())

    def postings(self, term: int) -> tuple[list[int], list[float], dict[int, float], float]:
        """Documents, impacts, block maxima and largest impact of a term; short lists, faster as such than as arrays."""
        found = self._postings.get(term)
        if found is None:
            a, b = self.starts[term], self.starts[term + 1]
            docs = self.docs[a:b]
            blocks = dict(zip((docs // BLOCK).tolist(), self.block_best[a:b].tolist(), strict=True))
            found = self._postings[term] = (docs.tolist(), self.impacts[a:b].tolist(), blocks, float(self.bound[term]))
        return found

    def search(self, terms: np.ndarray) -> list[int]:
        """Numbers of all items whose BM25 score for the terms reaches the threshold, by block-max WAND."""
        lists = [self.postings(t) for t in terms.tolist()]
        at = [0] * len(lists)
        out = []
        live = list(range(len(lists)))
        while live:
            live.sort(key=lambda i: lists[i][0][at[i]])
            total, pivot = 0.0, -1
            for k, i in enumerate(live):
                total += lists[i][3]
                if total >= self.threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == doc:
                pivot += 1
            head = live[: pivot + 1]
            if sum(lists[i][2].get(doc // BLOCK, 0.0) for i in head) >= self.threshold:
                score = 0.0
                for i in head:
                    docs = lists[i][0]
                    at[i] = bisect_left(docs, doc, at[i])
                    if at[i] < len(docs) and docs[at[i]] == doc:
                        score += lists[i][1][at[i]]
                if score >= self.threshold:
                    out.append(doc)
                goal = doc + 1
            else:
                # No item of this block can make it with these lists; further lists come in at their next item only.
                goal = (doc // BLOCK + 1) * BLOCK
                if pivot + 1 < len(live):
                    goal = min(goal, lists[live[pivot + 1]][0][at[live[pivot + 1]]])
                goal = max(goal, doc + 1)
            for i in head:
                at[i] = bisect_left(lists[i][0], goal, at[i])
            live = [i for i in live if at[i] < len(lists[i][0])]
        return out

    def fine(self, item: int) -> dict[int, list[int]]:
        if item not in self._fine:
            places: dict[int, list[int]] = defaultdict(list)
            for p, h in zip(*grams(self.points[item], FINE_LATIN, FINE_HAN), strict=True):
                places[int(h)].append(int(p))
            self._fine[item] = places
        return self._fine[item]


def shared_extent(points: np.ndarray, index: Index, item: int) -> float:
    """The share of the item that stands in the text in one stretch and in order."""
    places, own = index.fine(item), index.points[item]
    at, h = grams(points, FINE_LATIN, FINE_HAN)
    width_at = np.where(_is_han(own), FINE_HAN, FINE_LATIN).tolist()
    # Runs of matches on one diagonal: start in text and item, and length.
    runs: list[list[int]] = []
    last: dict[int, int] = {}
    for p, g in zip(at.tolist(), h.tolist(), strict=True):
        for q in places.get(g, ()):
            width = width_at[q]
            k = last.get(p - q)
            if k is not None and runs[k][0] + runs[k][2] >= p:
                runs[k][2] = p + width - runs[k][0]
            else:
                last[p - q] = len(runs)
                runs.append([p, q, width])
    if not runs:
        return 0.0
    r = np.array(sorted(runs))
    start, first, size = r[:, 0], r[:, 1], r[:, 2]
    han = _is_han(own[np.minimum(first, len(own) - 1)])
    reach = np.where(han, 12, 40)
    score, begin, matched = size.astype(float), first.copy(), size.copy()
    best = 0.0
    ends, stops = start + size, first + size
    low = 0
    for k in range(len(r)):
        while low < k and ends[low] + 200 < start[k] and start[low] + 4000 < start[k]:
            low += 1
        gap_t, gap_i = start[k] - ends[low:k], first[k] - stops[low:k]
        fits = (gap_t >= -6) & (gap_i >= -6) & (gap_t <= reach[k]) & (gap_i <= reach[k])
        if fits.any():
            gain = np.where(fits, score[low:k] - 0.5 * np.maximum(np.maximum(gap_t, gap_i), 0) + np.minimum(0, np.minimum(gap_t, gap_i)), -1)
            j = int(gain.argmax())
            if gain[j] > 0:
                score[k] += gain[j]
                begin[k], matched[k] = begin[low + j], matched[low + j] + size[k]
        extent = stops[k] - begin[k]
        if matched[k] >= DENSITY * extent:
            best = max(best, float(extent))
    return best / len(own)


def leaked_items(texts: list[str | None], index: Index, least_share: float) -> list[tuple[int, int]]:
    """(number of the text, number of the item) for all texts that hold enough of an item."""
    streams = [_points(stream(t)) if t else np.empty(0, np.uint64) for t in texts]
    if not len(index.terms) or not streams:
        return []
    # All texts as one array, kept apart by a character that no gram may hold: hashes come from one vectorised pass.
    gap = np.full(1, 0x10FFFF, np.uint64)
    lengths = np.array([len(s) + 1 for s in streams])
    base = np.concatenate([[0], np.cumsum(lengths)])
    whole = np.concatenate([x for s in streams for x in (s, gap)])
    at, h = grams(whole, LATIN_GRAM, HAN_GRAM)
    if index.short:
        fine_at, fine = grams(whole, FINE_LATIN, FINE_HAN)
        order = np.argsort(both := np.concatenate([at, fine_at]), kind="stable")
        at, h = both[order], np.concatenate([h, _as_fine(fine)])[order]
    slot = np.searchsorted(index.terms, h)
    slot[slot == len(index.terms)] = 0
    hit = index.terms[slot] == h
    at, slot = at[hit], slot[hit]
    found = []
    owner = np.searchsorted(base, at, "right") - 1
    for n in np.unique(owner):
        lo, hi = np.searchsorted(owner, [n, n + 1])
        places, terms = at[lo:hi] - base[n], slot[lo:hi]
        if index.bound[np.unique(terms)].sum() < index.threshold:
            continue
        items: dict[int, list[int]] = {}
        for p in range(0, max(1, len(streams[n]) - PASSAGE + STRIDE), STRIDE):
            a, b = np.searchsorted(places, [p, p + PASSAGE])
            query = np.unique(terms[a:b])
            if index.bound[query].sum() >= index.threshold:
                for item in index.search(query):
                    x = items.setdefault(item, [p, p])
                    x[1] = p
        for item, (p, q) in items.items():
            reach = PASSAGE + len(index.points[item])
            if shared_extent(streams[n][max(0, p - reach) : q + reach], index, item) >= least_share:
                found.append((int(n), item))
    return found


def _statistics(rows: DataFrame) -> DataFrame:
    """In how many items each term stands: ``term, df``, with ``size``, the number of terms of all items, in the row of
    the null term."""

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, t in zip(batch["i"], batch["t"], strict=True):
                h = index_terms(_points(stream(t)))
                yield pd.DataFrame({"i": i, "term": np.unique(h).view(np.int64)})
                yield pd.DataFrame({"i": [i], "term": pd.array([None], "Int64"), "size": [len(h)]})

    found = rows.mapInPandas(lambda b: (x.assign(size=x.get("size", 0)) for x in terms(b)), "i long, term long, size long")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("size").alias("size"))


def find_leaks(documents: DataFrame, doc_key: str, items: DataFrame, item_key: str, text: str = "text", *, least_share: float = 0.4, index_chars: int = INDEX_CHARS) -> DataFrame:
    """Documents and the items they hold: ``doc_key, item_key``, no row twice.

    Null, empty and blank texts on either side hold and leak nothing, as do rows with a null key. Further columns are
    ignored. Items of fewer characters than one short gram (7 letters, 3 Han characters) can't be found. A repeated item
    id stands for every text it is given with.
    """
    rows = items.select(F.col(item_key).cast("long").alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null").distinct()
    total = rows.agg(F.sum(F.length("t"))).head()[0] or 0
    rounds = total // index_chars + 1
    docs = spread(documents.select(F.col(doc_key).cast("long").alias("d"), F.col(text).alias("t")).filter("d is not null and t is not null"))
    schema = T.StructType([T.StructField(doc_key, T.LongType()), T.StructField(item_key, T.LongType())])
    stats, whole = None, {}
    if rounds > 1:
        stats = Scratch(items.sparkSession, "leaks").save(_statistics(rows))
        everything = stats.filter("term is null").head()
        whole = {"n_items": everything["df"], "mean_length": everything["size"] / everything["df"]}
    out = None
    for k in range(rounds):
        part = [(r["i"], r["t"]) for r in rows.filter(F.pmod(F.xxhash64("i"), F.lit(rounds)) == k).orderBy("i", "t").collect()]
        if stats is not None:
            mine = np.unique(np.concatenate([index_terms(_points(stream(t))) for _, t in part] or [np.empty(0, np.uint64)]))
            asked = items.sparkSession.createDataFrame(pd.DataFrame({"term": mine.view(np.int64)}), "term long")
            counts = stats.join(asked, "term").select("term", "df").toPandas()
            order = np.argsort(counts["term"].to_numpy(np.int64).view(np.uint64))
            whole["df"] = (counts["term"].to_numpy(np.int64).view(np.uint64)[order], counts["df"].to_numpy()[order])
        shared = documents.sparkSession.sparkContext.broadcast(Index(part, least_share=least_share, **whole))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                for lo in range(0, len(batch), 500):
                    texts, keys = batch["t"].iloc[lo : lo + 500].tolist(), batch["d"].iloc[lo : lo + 500].tolist()
                    pairs = leaked_items(texts, index, least_share)
                    yield pd.DataFrame({doc_key: [keys[n] for n, _ in pairs], item_key: [index.ids[i] for _, i in pairs]})

        found = docs.mapInPandas(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out.distinct()
