"""Suffix-array dedup: remove every byte covered by a string of 50 bytes that also starts in a document with a smaller id.

Suffixes are dealt over the cluster by content. Every 50-byte string has an anchor, the least hash of its 24-byte strings; strings that follow
one another with the same anchor make a segment (at most 64 starts), which is keyed by the anchor. Equal strings have equal anchors, so only
keys that two documents share matter, and a key's segments are all that need comparing. Where a key's segments are all one text, its least
document owns every string of it. The distinct segments of any other key are put side by side, a suffix array is built by linear grouping
(suffix_groups.py), and neighbours in it that agree in 50 bytes are equal strings; the least document of each run owns it. Keys with more
than `HOT` distinct segments (the edges of passages that very many documents hold) are dealt anew, by the strings themselves, so that no
task gets a key's every segment. A document loses a segment whole if a smaller document holds the same segment, else those strings of it that have a smaller owner.

Disk: what grows with the input is dealt out in rounds (segments by key, documents to cut by id, strings by hash), each round's shuffle files go
when it is written, and a stage's folder goes when nothing reads it any more. Rounds share no key, so they give what one exchange would.

Rows: one per input row. Null and empty texts have 0 bytes. Null ids count as one document, which comes last. Rows that repeat an id belong to
one document: they do not remove each other's bytes. Texts shorter than 50 bytes lose nothing. Empty tables give empty results. Only the
named columns are read; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, drop_stash, groups_of, mix64, stash, utf8
from .suffix_groups import ragged, suffix_arrays
from .url_filter import bloom_filter, bloom_words

#: Bytes of a string, of an anchor, most starts of a segment, most distinct segments of a key in one block.
LENGTH, ANCHOR, STARTS, HOT = 50, 24, 64, 24
#: Bytes of text handled at once; bytes of segments in one call of the suffix array.
BLOCK, SORTED = 1 << 19, 1 << 20
#: Blocks of the filter that keeps documents without any candidate out of a join: 32 bytes each, 4 MB at most.
MOST_BLOCKS = 1 << 17
#: Rounds in which segments (each round hashes every text again), documents to cut and strings of hot keys are dealt out.
ROUNDS, CUT_ROUNDS, STRING_ROUNDS = 1, 2, 2
_ODD = np.uint64(0xA0761D6478BD642F)
_BACK = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))
_BYTES = mix64(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(99))
_powers: dict = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * BLOCK:
            _powers[int(base)] = have
    return have[:n]


class Hashes:
    """64-bit hashes of any span of a byte string."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * powers(_ODD, len(raw)))])
        self.back = powers(_BACK, len(raw) + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def segments_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Hashes]:
    """(text, key, name, start, stop of each segment, joined bytes, their hashes); name identifies key and content."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(sizes) - sizes
    hashes = Hashes(raw)
    many = np.maximum(0, sizes - LENGTH + 1)
    valid = ragged(base, many)
    if not len(valid):
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z.astype(np.uint64), z, z, raw, hashes
    low = mix64((hashes.sums[ANCHOR:] - hashes.sums[:-ANCHOR]) * hashes.back[: len(hashes.sums) - ANCHOR])
    window, span = LENGTH - ANCHOR + 1, 1
    while 2 * span <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (window - span)], low[window - span :])
    key, ends = low[valid], np.cumsum(many)
    new = np.ones(len(valid), bool)
    new[1:] = key[1:] != key[:-1]
    new[(ends - many)[many > 0]] = True
    run = np.flatnonzero(new)
    pieces = -(-np.diff(np.append(run, len(valid))) // STARTS)
    edge = np.repeat(run, pieces) + STARTS * ragged(np.zeros(len(run), np.int64), pieces)
    text = np.searchsorted(ends, edge, side="right")
    start, stop = valid[edge], valid[np.append(edge[1:], len(valid)) - 1] + LENGTH
    name = mix64(hashes.of(start, stop) ^ (key[edge] * np.uint64(0xC2B2AE3D27D4EB4F)))
    return text, key[edge], name, start, stop, raw, hashes


def all_segments(base: DataFrame, turn: int = 0, rounds: int = 1) -> DataFrame:
    """h (key), s (name), id of every segment whose key leaves the remainder `turn` by `rounds`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            texts, ids = [utf8(t) for t in df["text"]], df["id"].to_numpy()
            for a, b in groups_of([len(t) for t in texts], BLOCK):
                text, key, name, *_ = segments_of(texts[a:b])
                if rounds > 1:
                    own = key % np.uint64(rounds) == turn
                    text, key, name = text[own], key[own], name[own]
                yield pd.DataFrame({"h": key.view(np.int64), "s": name.view(np.int64), "id": ids[a:b][text]})

    return base.mapInPandas(run, "h long, s long, id long")


def cut_segments(docs: DataFrame) -> DataFrame:
    """docs: id, text, cold and hot (names to cut). kind 0: h, s, id, bytes of a cold segment. kind 1: x, y (hash), at (place) of each string of a hot one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            texts = [utf8(t) for t in df["text"]]
            for a, b in groups_of([len(t) for t in texts], BLOCK):
                text, key, name, start, stop, raw, hashes = segments_of(texts[a:b])
                edge = np.searchsorted(text, np.arange(b - a + 1))
                data = raw.tobytes()
                for kind, column in ((0, "cold"), (1, "hot")):
                    picked = []
                    for i, want in enumerate(df[column].iloc[a:b]):
                        if want is not None and len(want):
                            own = np.arange(edge[i], edge[i + 1])
                            own = own[np.isin(name[own].view(np.int64), np.asarray(want, np.int64))]
                            picked.append(own[np.unique(name[own], return_index=True)[1]])
                    if not picked:
                        continue
                    p = np.concatenate(picked)
                    ids = df["id"].to_numpy()[a:b][text[p]]
                    if kind == 0:
                        yield pd.DataFrame({"kind": 0, "h": key[p].view(np.int64), "s": name[p].view(np.int64), "id": ids, "bytes": [data[u:v] for u, v in zip(start[p].tolist(), stop[p].tolist(), strict=True)], "x": 0, "y": 0, "at": 0})
                    else:
                        many = stop[p] - start[p] - LENGTH + 1
                        first = ragged(start[p], many)
                        x = hashes.of(first, first + LENGTH)
                        y = mix64(hashes.of(first, first + LENGTH // 2) + x * np.uint64(3))
                        yield pd.DataFrame({"kind": 1, "h": 0, "s": np.repeat(name[p], many).view(np.int64), "id": np.repeat(ids, many), "bytes": None, "x": x.view(np.int64), "y": y.view(np.int64), "at": first - np.repeat(start[p], many)})

    return docs.mapInPandas(run, "kind int, h long, s long, id long, bytes binary, x long, y long, at int")


def owned_elsewhere(segments: list[bytes], owners: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place) of the strings that a segment of the same key with a smaller owner also holds. key: ascending numbers of the segments' keys."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    # letters: a key's segments one after another, 1 between them, 0 at the key's end, bytes from 2
    last = np.append(key[1:] != key[:-1], True)
    stops = np.cumsum(sizes + 1)
    letters = np.zeros(int(stops[-1]), np.int64)
    letters[ragged(stops - sizes - 1, sizes)] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 2
    letters[stops - 1] = ~last
    begin = np.concatenate([[0], stops[last][:-1]])
    order, _ = suffix_arrays(letters, begin)
    whose = np.repeat(np.arange(len(segments)), sizes + 1)
    place = np.arange(len(letters)) - np.repeat(stops - sizes - 1, sizes + 1)
    order = order[place[order] <= sizes[whose[order]] - LENGTH]
    own = whose[order]
    same = np.zeros(len(order), bool)
    near = np.flatnonzero(key[own[1:]] == key[own[:-1]]) + 1
    for a in range(0, len(near), 1 << 16):
        part = near[a : a + (1 << 16)]
        at = np.arange(LENGTH)
        same[part] = (letters[order[part][:, None] + at] == letters[order[part - 1][:, None] + at]).all(1)
    run = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(owners[own], run), np.diff(np.append(run, len(order)))) if len(run) else owners[own]
    lose = least < owners[own]
    return own[lose], place[order[lose]]


def sort_blocks(cold: DataFrame) -> DataFrame:
    """s, id, places: the strings of each distinct segment that have a smaller owner. cold is dealt by h and sorted by it."""

    def solve(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
        df = df.drop_duplicates(["h", "s"])
        size = df["bytes"].map(len)
        df = df.assign(total=size.groupby(df["h"]).transform("sum")).sort_values(["total", "h", "s"], kind="stable")  # texts of like sizes take like steps
        key = np.cumsum(np.append(False, df["h"].to_numpy()[1:] != df["h"].to_numpy()[:-1]))
        per_key = np.bincount(key, size.loc[df.index].to_numpy())
        for a, b in groups_of(per_key.tolist(), SORTED):
            rows = df.iloc[np.searchsorted(key, a) : np.searchsorted(key, b)]
            seg, place = owned_elsewhere(rows["bytes"].tolist(), rows["id"].to_numpy(), key[np.searchsorted(key, a) : np.searchsorted(key, b)])
            order = np.lexsort((place, seg))
            seg, place = seg[order], place[order].astype(np.int32)
            first = np.flatnonzero(np.diff(seg, prepend=-1))
            if len(first):
                yield pd.DataFrame({"s": rows["s"].to_numpy()[seg[first]], "id": rows["id"].to_numpy()[seg[first]], "places": np.split(place, first[1:])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, size = [], 0
        for df in batches:
            rest.append(df)
            size += int(df["bytes"].map(len).sum())
            if size > 4 * SORTED:
                whole = pd.concat(rest, ignore_index=True)
                open_ = whole["h"] == whole["h"].iloc[-1]  # this key may go on
                yield from solve(whole[~open_])
                rest = [whole[open_]]
                size = int(rest[0]["bytes"].map(len).sum())
        if rest:
            yield from solve(pd.concat(rest, ignore_index=True))

    return cold.select("h", "s", "id", "bytes").repartition("h").sortWithinPartitions("h").mapInPandas(run, "s long, id long, places array<int>")


def part(base: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be among ids, all others), by a blocked Bloom filter of at most 4 MB; larger sets only pass more rows on."""
    blocks = min(MOST_BLOCKS, max(1, ids.count() * 16 // 256 + 1))
    probe = base
    for name, c in bloom_words("id", blocks).items():
        probe = probe.withColumn(name, c)
    hit = F.lit(True)
    for i in range(4):
        hit = hit & (F.coalesce(F.col(f"f{i}"), F.lit(0)).bitwiseAND(F.col(f"w{i}")) != 0)
    probe = probe.join(F.broadcast(bloom_filter(ids, "id", blocks)), "block", "left").withColumn("maybe", hit).select(*base.columns, "maybe")
    return probe.filter("maybe").drop("maybe"), probe.filter("not maybe").drop("maybe")


def rows_without(docs: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows of docs whose key (not null) is not among ids (one column, id). Only rows that pass a filter of the ids are dealt out."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("id"))
    maybe, others = part(keyed, ids)
    return maybe.join(ids, "id", "left_anti").select("row").unionAll(others.select("row")).select("row.*")


def apply_removals(docs: DataFrame) -> DataFrame:
    """docs: own (the row's id), text, whole (names of segments to remove), some (name, places). Adds sizes, spans and what is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            texts = [utf8(t) for t in df["text"]]
            for a, b in groups_of([len(t) for t in texts], BLOCK):
                text, key, name, start, stop, raw, _ = segments_of(texts[a:b])
                sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
                base = np.cumsum(sizes) - sizes
                edge = np.searchsorted(text, np.arange(b - a + 1))
                cover = np.zeros(len(raw) + 1, np.int64)
                for i in range(b - a):
                    own = np.arange(edge[i], edge[i + 1])
                    names = name[own].view(np.int64)
                    whole, some = df["whole"].iloc[a + i], df["some"].iloc[a + i]
                    if whole is not None and len(whole):
                        gone = own[np.isin(names, np.asarray(whole, np.int64))]
                        np.add.at(cover, start[gone], 1)
                        np.add.at(cover, stop[gone], -1)
                    for row in some if some is not None else ():
                        for k in own[names == row["s"]]:
                            at = start[k] + np.asarray(row["places"], np.int64)
                            np.add.at(cover, at, 1)
                            np.add.at(cover, at + LENGTH, -1)
                gone = np.cumsum(cover)[:-1] > 0
                rows = []
                for i in range(b - a):
                    mask = gone[base[i] : base[i] + sizes[i]]
                    spans = np.count_nonzero(np.diff(mask.astype(np.int8), prepend=0) == 1)
                    rows.append((int(sizes[i]), int(mask.sum()), int(spans), raw[base[i] : base[i] + sizes[i]][~mask].tobytes()))
                out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
                out.insert(0, "own", df["own"].iloc[a:b].to_numpy())
                yield out

    return docs.mapInPandas(run, "own string, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (bytes) of every row."""
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    base = docs.select(F.col(id_col).cast("string").alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    by_name, by_key = Window.partitionBy("h", "s"), Window.partitionBy("h")
    parts = []
    for turn in range(ROUNDS):
        # one exchange, by key: keys of one document go before anything else is asked of a segment
        found = all_segments(base.select("id", "text"), turn, ROUNDS)
        for name, f, c in (("lo", F.min, "id"), ("hi", F.max, "id"), ("one", F.min, "s"), ("other", F.max, "s")):
            found = found.withColumn(name, f(c).over(by_key))
        found = found.filter("lo < hi").withColumn("first", F.min("id").over(by_name))
        found = found.select("h", "s", "id", "first", (F.col("one") != F.col("other")).alias("several"))
        parts.append(stash(found.filter("several or id > first"), "segments", free=True))
    found = reduce(DataFrame.unionAll, parts)
    distinct = stash(found.filter("several").select("h", "s", F.col("first").alias("id")).distinct(), "distinct", free=True)
    hot = distinct.groupBy("h").count().filter(F.col("count") > HOT).select("h", F.lit(True).alias("is_hot"))
    wanted = distinct.join(hot, "h", "left").groupBy("id").agg(F.collect_list(F.when(F.col("is_hot").isNull(), F.col("s"))).alias("cold"), F.collect_list(F.when(F.col("is_hot"), F.col("s"))).alias("hot"))
    wanted = stash(wanted, "wanted", free=True)
    drop_stash(distinct)
    maybe, _ = part(base.select("id", "text"), wanted.select("id"))
    turn_of = F.pmod(F.xxhash64("id"), F.lit(CUT_ROUNDS))
    cuts = [stash(cut_segments(maybe.filter(turn_of == turn).join(wanted.filter(turn_of == turn), "id")), "cut", free=True) for turn in range(CUT_ROUNDS)]
    drop_stash(wanted)
    cut = reduce(DataFrame.unionAll, cuts)
    some = [stash(sort_blocks(cut.filter("kind = 0")), "sorted", free=True)]
    for turn in range(STRING_ROUNDS):
        strings = cut.filter("kind = 1").select("x", "y", "s", "id", "at").filter(F.pmod("x", F.lit(STRING_ROUNDS)) == turn)
        owners = strings.groupBy("x", "y").agg(F.min("id").alias("owner"), F.max("id").alias("most")).filter("owner < most").drop("most")
        some.append(stash(strings.join(owners, ["x", "y"]).filter("owner < id").groupBy("s", "id").agg(F.array_sort(F.collect_set("at")).alias("places")), "strings", free=True))
    drop_stash(*cuts)
    every = reduce(DataFrame.unionByName, some, found.filter("id > first").select("id", "s", F.lit(None).cast("array<int>").alias("places")))
    gone = every.groupBy("id").agg(F.collect_set(F.when(F.col("places").isNull(), F.col("s"))).alias("whole"), F.collect_list(F.when(F.col("places").isNotNull(), F.struct("s", "places"))).alias("some"))
    gone = stash(gone, "gone", free=True)
    drop_stash(*parts, *some)
    maybe, rest = part(base, gone.select("id"))
    hit = apply_removals(maybe.join(gone, "id", "left").select("own", "text", "whole", "some"))
    zero = F.lit(0).cast("long")
    miss = rest.select("own", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.encode("text", "UTF-8").alias("kept"))
    return hit.unionByName(miss).withColumn("own", F.col("own").cast(kind)).withColumnRenamed("own", id_col)
