"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Words are lower-cased (A-Z) and stripped of ASCII punctuation at both ends. Shingles are 5 words (fewer words: the whole sequence) and weigh
ln(1 + items / items that hold the shingle); a shingle of no item weighs as one of a single item. A window of as many words as an item has can
only be similar to it if they share a shingle, so windows are taken around every shingle that stands in the benchmark, at every start that
covers it. A window's fingerprint is the weighted SimHash of its shingles. The fingerprints of the items are indexed by four 16-bit blocks, each
with all values within radius // 4 bits: by the pigeonhole principle no fingerprint within the radius is missed. Candidates within the radius
are verified by weighted Jaccard similarity. A text of fewer words than an item is one window, the whole text, and is verified without fingerprints.
Items of fewer than 5 words are one shingle, found where a run of as many words of the text is the same.

The index is built for blocks of `ITEMS` items and sent to the tasks (bounded by ITEMS, about 10,000 entries an item); a larger benchmark is matched in several passes.
Items and the items of each shingle are counted over the whole benchmark first, so blocks and their order change no weight. Shingles of two or more items
are sent to the tasks with their weights (16 bytes each, not bounded by ITEMS); all others weigh the same.

Rows: one per document row and item found, with the most similar window (the first of equals). Null, empty and blank texts and items match nothing.
Null ids are kept as null. Repeated rows give repeated results. Empty tables give empty results. Only the named columns are read; texts are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, groups_of, mix64, release_memory, shingle_hashes, span_hashes, utf8
from .toxicity import _PUNCT

WORDS, SIMILARITY, RADIUS = 5, 0.8, 19
ITEMS = 1000
BLOCK = 1 << 19
BLOCKS, WIDTH = 4, 16


def words_of(texts: list[bytes]) -> Words:
    """Words whose hashes leave out punctuation at both ends (a word of nothing else keeps it)."""
    w = Words(texts)
    if len(w.start):
        start, end = w.start.copy(), w.end.copy()
        for _ in range(4):
            start += (start < end - 1) & _PUNCT[w.raw[start]]
            end -= (start < end - 1) & _PUNCT[w.raw[end - 1]]
        w.hash = span_hashes(w.raw, start, end)
    return w


def fingerprints(shingles: np.ndarray, weights: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """SimHash of runs of shingles: for each of 64 bits, the sign of the weights' sum with the bit's sign."""
    bits = ((shingles[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int8) * 2 - 1
    sums = np.concatenate([np.zeros((1, 64)), np.cumsum(bits * weights[:, None], 0)])
    sign = (sums[start + count] - sums[start]) > 1e-9
    return np.packbits(sign, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


@dataclass
class Weights:
    """Weights of the shingles of two or more items (sorted); every other one has the default."""

    known: np.ndarray
    weight: np.ndarray
    default: float

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(h), self.default)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.weight[at], self.default)


def weights_of(known: np.ndarray, df: np.ndarray, items: int) -> Weights:
    """From shingles (sorted), the items that hold each, and the number of all items."""
    return Weights(known[df > 1], np.log1p(items / df[df > 1]), float(np.log1p(items)))


def count_shingles(benchmark: DataFrame) -> Weights:
    """Over the whole benchmark, column t. To the driver come only shingles of two or more items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            texts = [utf8(t) for t in df["t"]]
            for a, b in groups_of([len(t) for t in texts], BLOCK):
                w = words_of(texts[a:b])
                h, owner = shingle_hashes(w.hash, w.first)
                pairs = np.unique(np.stack([h, owner.astype(np.uint64)], 1), axis=0)
                yield pd.DataFrame({"h": pairs[:, 0].copy().view(np.int64)})

    several = benchmark.select("t").mapInPandas(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").toArrow()
    known, df = several["h"].to_numpy().astype(np.int64).view(np.uint64), several["n"].to_numpy()
    order = np.argsort(known)
    return weights_of(known[order], df[order], benchmark.count())


@dataclass
class Index:
    """Items: id, words, shingles with weights; fingerprints by blocks."""

    ids: list
    sizes: np.ndarray  # words
    shingles: list[dict]  # hash -> count
    known: np.ndarray  # all shingles of items, sorted
    weights: Weights | None  # of the whole benchmark
    marks: np.ndarray  # items' fingerprints
    heads: list[np.ndarray]  # per block: entries of value v are heads[v]..heads[v + 1]
    entries: list[np.ndarray]
    places: tuple[np.ndarray, np.ndarray, np.ndarray]  # shingle, item, place in the item
    sieve: np.ndarray
    total: np.ndarray  # weight of each item's shingles
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # words of items below WORDS -> hashes, sorted, and items
    radius: int

    def weigh(self, h: np.ndarray) -> np.ndarray:
        return self.weights.of(h)


def build_index(ids: list, texts: list[bytes], radius: int = RADIUS, words: int = WORDS, weights: Weights | None = None) -> Index | None:
    """Without weights, these items are the whole benchmark."""
    w = words_of(texts)
    h, owner = shingle_hashes(w.hash, w.first, words)
    if not len(h):
        return None
    order = np.argsort(owner, kind="stable")
    h, owner = h[order], owner[order]
    live, first, count = np.unique(owner, return_index=True, return_counts=True)
    pairs = np.unique(np.stack([h, owner.astype(np.uint64)], 1), axis=0)
    known, df = np.unique(pairs[:, 0], return_counts=True)
    weights = weights_of(known, df, len(texts)) if weights is None else weights
    weight = weights.of(h)
    sizes = np.diff(w.first)[live]
    shingles = [dict(zip(*(x.tolist() for x in np.unique(h[a : a + n], return_counts=True)), strict=True)) for a, n in zip(first, count, strict=True)]
    marks = fingerprints(h, weight, first, count)
    masks = np.array([sum(1 << b for b in c) for k in range(radius // BLOCKS + 1) for c in itertools.combinations(range(WIDTH), k)], np.int64)
    heads, entries = [], []
    for b in range(BLOCKS):
        value = ((marks >> np.uint64(WIDTH * b)) & np.uint64(0xFFFF)).astype(np.int64)
        value = (value[:, None] ^ masks).reshape(-1)
        order = np.argsort(value, kind="stable")
        entries.append((order // len(masks)).astype(np.int16))
        heads.append(np.searchsorted(value[order], np.arange((1 << WIDTH) + 1)).astype(np.int32))
    order = np.argsort(h, kind="stable")
    place = np.arange(len(h)) - np.repeat(first, count)
    item = np.repeat(np.arange(len(live)), count)
    sieve = np.zeros(1 << 20, bool)
    sieve[(h >> np.uint64(44)).astype(np.int64)] = True
    total = np.add.reduceat(weight, first)
    short = {}
    for size in np.unique(sizes[sizes < words]).tolist():
        own = np.flatnonzero(sizes == size)
        own = own[np.argsort(h[first[own]], kind="stable")]
        short[size] = (h[first[own]], own)
    return Index([ids[i] for i in live], sizes, shingles, known, weights, marks, heads, entries, (h[order], item[order], place[order]), sieve, total, short, radius)


def runs_of(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, as shingle_hashes gives a text of so many words below its shingles' size."""
    n = max(0, len(word_hash) - size + 1)
    x = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            x = mix64(x * np.uint64(31) + word_hash[k : k + n])
    return x


def match_short(w: Words, index: Index) -> dict[int, list[tuple[int, float, int, int]]]:
    """Text to (item, similarity, first word, words) of the items below WORDS words that it holds, the first place of each."""
    out: dict[int, dict[int, tuple]] = {}
    for size, (known, items) in index.short.items():
        h = runs_of(w.hash, size)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        for k in np.flatnonzero((known[at] == h) & (w.text[: len(h)] == w.text[size - 1 :])).tolist():
            t = int(w.text[k])
            for i in items[np.searchsorted(known, h[k]) : np.searchsorted(known, h[k], side="right")].tolist():
                out.setdefault(t, {}).setdefault(i, (i, 1.0, k - int(w.first[t]), size))
    return {t: list(found.values()) for t, found in out.items()}


def windows_of(hits: np.ndarray, item_words: int, words: int, total: int) -> np.ndarray:
    """Starts of the windows of item_words words that cover a shingle at a place in hits, in a text of `total` shingles."""
    span = max(1, item_words - words + 1)
    low, high = np.maximum(hits - span + 1, 0), np.minimum(hits, max(0, total - span))
    n = np.maximum(high - low + 1, 0)
    return np.unique(np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


def match_text(h: np.ndarray, index: Index, similarity: float, words: int = WORDS, radius: int | None = None) -> list[tuple[int, float, int, int]]:
    """(item, similarity, first word, words) of the items of `words` words or more found in a text with shingles h, the best window of each."""
    maybe = np.flatnonzero(index.sieve[(h >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.known, h[maybe]), len(index.known) - 1)
    hits = maybe[index.known[at] == h[maybe]]
    if not len(hits):
        return []
    radius = index.radius if radius is None else radius
    found: dict[int, tuple[float, int]] = {}
    # items that share a shingle decide which window sizes can match at all
    a, b = np.searchsorted(index.places[0], h[hits]), np.searchsorted(index.places[0], h[hits], side="right")
    sharing = index.places[1][np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)]
    owner = np.repeat(hits, b - a)
    for size in np.unique(index.sizes[sharing]).tolist():
        of_size = index.sizes[sharing] == size
        if size < words:  # match_short finds these
            continue
        span = size - words + 1
        if span > len(h):  # the text is shorter than the item: one window
            own = float(index.weigh(h).sum())
            for i in np.unique(sharing[of_size]).tolist():
                if own < similarity * index.total[i] - 1e-9:  # no more can be shared than the text has
                    continue
                s = weighted_jaccard(h, index.shingles[i], index)
                if s >= similarity:
                    found[i] = (s, 0)
            continue
        starts = windows_of(np.unique(owner[of_size]), size, words, len(h))
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 4096 + span) + 1):
            for k in range(0, len(part), 4096):
                own = part[k : k + 4096]
                low, high = int(own[0]), int(own[-1]) + span
                marks = fingerprints(h[low:high], index.weigh(h[low:high]), own - low, np.full(len(own), span)) if high - low <= 20000 else np.concatenate([fingerprints(h[s : s + span], index.weigh(h[s : s + span]), np.zeros(1, np.int64), np.array([span])) for s in own.tolist()])
                win, item = candidates(marks, index)
                right = (index.sizes[item] == size) & (bit_count(marks[win] ^ index.marks[item]) <= radius)
                for w, i in sorted(set(zip(own[win[right]].tolist(), item[right].tolist(), strict=True))):
                    s = weighted_jaccard(h[w : w + span], index.shingles[i], index)
                    if s >= similarity and s > found.get(i, (0.0, 0))[0]:
                        found[i] = (s, w)
    return [(i, s, w, min(int(index.sizes[i]), len(h) + words - 1)) for i, (s, w) in sorted(found.items())]


def candidates(marks: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, item) pairs that agree in a block up to radius // 4 bits; a superset of all within the radius."""
    wins, items = [], []
    for b in range(BLOCKS):
        v = ((marks >> np.uint64(WIDTH * b)) & np.uint64(0xFFFF)).astype(np.int64)
        a, n = index.heads[b][v], index.heads[b][v + 1] - index.heads[b][v]
        wins.append(np.repeat(np.arange(len(marks)), n))
        items.append(index.entries[b][np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64))
    return np.concatenate(wins), np.concatenate(items)


def weighted_jaccard(h: np.ndarray, item: dict, index: Index) -> float:
    own = dict(zip(*(x.tolist() for x in np.unique(h, return_counts=True)), strict=True))
    every = np.array(list(own.keys() | item.keys()), np.uint64)
    w = index.weigh(every)
    a, b = np.array([own.get(x, 0) for x in every.tolist()]), np.array([item.get(x, 0) for x in every.tolist()])
    return round(float((np.minimum(a, b) * w).sum() / (np.maximum(a, b) * w).sum()), 12)  # so that the order of the sums decides nothing


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """id_col, item_id, similarity, first_word, n_words."""
    benchmark = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).cast("string").alias("t"))
    items, weights = benchmark.toLocalIterator(), count_shingles(benchmark)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = dict(base.dtypes)["id"], dict(benchmark.dtypes)["i"]
    spark = base.sparkSession
    out, shared = None, spark.sparkContext.broadcast(weights)
    while rows := list(itertools.islice(items, ITEMS)):
        index = build_index([r["i"] for r in rows], [utf8(r["t"]) for r in rows], radius, weights=weights)
        if index is None:
            continue
        part = base.mapInPandas(_matcher(spark.sparkContext.broadcast(replace(index, weights=None)), shared, similarity), f"id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word int, n_words int")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], f"id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word int, n_words int")
    return out.withColumnRenamed("id", id_col)


def _matcher(shared, weights, similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = replace(shared.value, weights=weights.value)
        for df in batches:
            texts, rows = [utf8(t) for t in df["text"]], []
            for a, b in groups_of([len(t) for t in texts], BLOCK):
                w = words_of(texts[a:b])
                h, owner = shingle_hashes(w.hash, w.first)
                order = np.argsort(owner, kind="stable")
                h, owner = h[order], owner[order]
                maybe = np.flatnonzero(index.sieve[(h >> np.uint64(44)).astype(np.int64)])
                for t, found in match_short(w, index).items():
                    rows += [(df["id"].iloc[a + t], index.ids[i], s, first, n) for i, s, first, n in found]
                for t in np.unique(owner[maybe]).tolist():
                    own = h[np.searchsorted(owner, t) : np.searchsorted(owner, t, side="right")]
                    for i, s, first, n in match_text(own, index, similarity):
                        rows.append((df["id"].iloc[a + t], index.ids[i], s, first, n))
            yield pd.DataFrame(rows, columns=["id", "item_id", "similarity", "first_word", "n_words"])
        release_memory()

    return run
