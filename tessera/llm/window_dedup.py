"""Substring dedup by levels: windows of words that repeat at one length alone are extended to twice that length, until none are left.

Half a window comes first. Every window of 13 words holds seven windows of 7, and picks the one with the least hash; equal windows pick equal ones. Only a window
whose pick stands in two documents can repeat, so this level deals out a quarter of the places and drops most of the text. The windows that are left are compared at 13
words, which decides what goes: each word covered by a window that starts in a document with a smaller id too. Those that repeat are extended: two of them side by side make
one of 26, named by the pair of their hashes, and so on to 52, 104, ... while any repeat. Each level reads nothing but what survived the one before, and tells how long a document's
repeated passages are (`longest`).

Whole copies are no work for levels: of equal texts the least document stands for all, the others lose every word if they have a window at all. Windows are told apart by hashes of 96 bits.
Rows are flat (document, place, two hashes). A window's owner is a smallest id, added up before rows are dealt out. What meets in one task are one window's rows, or one document's.

Rows: one per input row. Null and empty texts have no words. Null ids count as one document, which comes last. Rows that repeat an id belong to one document: they do not
remove each other's words. Texts of fewer words than a window lose nothing. Empty tables give empty results. Only the named columns are read; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Words, blocks_of_texts, drop_stash, hash128, mix64, stash, utf8
from .suffix_dedup import part
from .suffix_groups import ragged

#: Bytes of text handled at once.
BLOCK = 1 << 19
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def run_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of every run of `size` words, across texts too."""
    n = max(0, len(word) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out + np.uint64(k + 1)) * _A
        out ^= out >> np.uint64(32)
        out += word[k : k + n]
    return mix64(out)


def short(x: np.ndarray) -> np.ndarray:
    """The upper half of 64-bit hashes."""
    return (x >> np.uint64(32)).astype(np.uint32).view(np.int32)


def picks(words: Words, half: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word of each window, the least hash of its half windows); only windows inside one text."""
    many = np.maximum(0, np.diff(words.first) - window + 1)
    start = ragged(words.first[:-1], many)
    low, span, wide = run_hashes(words.hash, half), 1, window - half + 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    return start, low[start]


def half_windows(docs: DataFrame, window: int) -> DataFrame:
    """h, id: the half windows that the windows of a document pick. docs: id, text."""
    half = window // 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in blocks_of_texts(b.column(1), BLOCK):
                words = Words(texts, lower=False)
                start, low = picks(words, half, window)
                text = words.text[start]
                new = np.ones(len(start), bool)  # windows in a row mostly pick the same
                new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(low[new].view(np.int64)), b.column(0).slice(i, j - i).take(pa.array(text[new]))], names=["h", "id"])

    return docs.select("id", F.col("text").cast("binary")).mapInArrow(run, "h long, id long")


def first_windows(docs: DataFrame, window: int) -> DataFrame:
    """id, at, x, y: the windows whose picks repeat. docs: id, th, text, live (hashes that repeat)."""
    half = window // 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            live = b.column("live")
            for i, j, texts in blocks_of_texts(b.column("text"), BLOCK):
                words = Words(texts, lower=False)
                start, low = picks(words, half, window)
                edge = np.searchsorted(words.text[start], np.arange(j - i + 1))
                own = np.concatenate([np.isin(low[edge[k] : edge[k + 1]].view(np.int64), live[i + k].values.to_numpy()) for k in range(j - i)])
                at, text = start[own], words.text[start[own]]
                y = run_hashes(mix64(words.hash ^ _B), half)
                second = mix64((y[at] * _A) ^ y[at + window - half])
                place = (b.column("th").to_numpy()[i:j][text] << 32) | (at - words.first[text])
                x = run_hashes(words.hash, window)[at]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i).take(pa.array(text)), pa.array(place), pa.array(x.view(np.int64)), pa.array(short(second))], names=["id", "at", "x", "y"])

    return docs.select("id", "th", F.col("text").cast("binary"), "live").mapInArrow(run, "id long, at long, x long, y int")


def owners_of(rows: DataFrame) -> DataFrame:
    """x, y of the windows that start in two documents, with the least and the greatest of those.

    Written before rows meet it: then both sides of that join are dealt out, and Spark can split a window that very many rows hold."""
    return stash(rows.groupBy("x", "y").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi"), "owners", free=True)


def repeated(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """The windows that start in two documents; late: one of those has a smaller id, early: one has a larger one."""
    return rows.join(owners, ["x", "y"]).select("id", "at", "x", "y", (F.col("lo") < F.col("id")).alias("late"), (F.col("hi") > F.col("id")).alias("early"))


_NEXT = "id long, at long, x long, y int, doc long, th long, n long, starts array<int>"


def doubled(live: DataFrame, size: int, window: int) -> DataFrame:
    """From windows of `size` words that repeat: those of twice that (id, at, x, y), and of each document that has some with a smaller owner: doc, th, n (size), starts.

    Two windows side by side are extended only if both have a smaller holder, or both a larger one: else no other document holds the two together. The rows of a document meet in one task, in order.
    """
    fields = pa.schema([(c, pa.int32() if c == "y" else pa.int64()) for c in ("id", "at", "x", "y", "doc", "th", "n")] + [("starts", pa.list_(pa.int32()))])

    def solve(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, th, place = t["id"], t["at"] >> 32, t["at"] & 0xFFFFFFFF
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])))
        nth = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(doc))))
        key = nth << 32 | place
        other = np.minimum(np.searchsorted(key, key + size), len(key) - 1)
        a = np.flatnonzero(key[other] == key + size)
        b = other[a]
        late, early = t["late"], t["early"]
        open_ = (late[a] & late[b]) | (early[a] & early[b])
        a, b = a[open_], b[open_]
        x, y = t["x"].view(np.uint64), t["y"].view(np.uint32).astype(np.uint64)
        if len(a):
            both = mix64((x[a] + np.uint64(size)) * _A + x[b]), short(mix64((y[a] + np.uint64(size)) * _B + (y[b] ^ x[b])))
            made = doc[a], t["at"][a], both[0].view(np.int64), both[1]
            yield pa.RecordBatch.from_arrays([*map(pa.array, made), *[pa.nulls(len(a), pa.int64())] * 3, pa.nulls(len(a), pa.list_(pa.int32()))], schema=fields)
        many = np.add.reduceat(late.astype(np.int64), new)
        has = np.flatnonzero(many)
        if len(has):
            ends = pa.array(np.append(0, np.cumsum(many[has])).astype(np.int32))
            starts = pa.ListArray.from_arrays(ends, pa.array(place[late].astype(np.int32))) if size == window else pa.nulls(len(has), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(has), f.type) for f in list(fields)[:4]], pa.array(doc[new[has]]), pa.array(th[new[has]]), pa.array(np.full(len(has), size)), starts], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "at", "x", "y", "late", "early")}
            if rest is not None:
                t = {c: np.concatenate([rest[c], v]) for c, v in t.items()}
            last = (t["id"] != t["id"][-1]) | (t["at"] >> 32 != t["at"][-1] >> 32)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0  # the last document may go on
            if cut:
                yield from solve({c: v[:cut] for c, v in t.items()})
            rest = {c: v[cut:] for c, v in t.items()}
        if rest is not None and len(rest["id"]):
            yield from solve(rest)

    return live.repartition(F.col("id"), F.shiftright("at", 32)).sortWithinPartitions("id", "at").mapInArrow(run, _NEXT)


def passages(docs: DataFrame, window: int) -> tuple[DataFrame, list[DataFrame]]:
    """docs: id, th, text (no two equal). id, th, starts (of the windows that start in a document with a smaller id), longest; and the stored tables that it reads."""
    seeds = stash(half_windows(docs, window), "halves")
    live = stash(seeds.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("h"), "live", free=True)
    wanted = stash(seeds.join(live, "h").groupBy("id").agg(F.collect_set("h").alias("live")), "wanted", free=True)
    drop_stash(seeds, live)
    maybe, _ = part(docs, wanted.select("id"))
    rows, size, levels = stash(first_windows(maybe.join(wanted, "id"), window), "windows", free=True), window, []
    drop_stash(wanted)
    while not rows.isEmpty():
        owners = owners_of(rows)
        levels.append(stash(doubled(repeated(rows, owners), size, window), "doubled", free=True))
        drop_stash(owners)
        if len(levels) == 1:
            drop_stash(rows)
        rows, size = levels[-1].filter("id is not null").select("id", "at", "x", "y"), 2 * size
    none = docs.sparkSession.createDataFrame([], _NEXT)
    every = reduce(DataFrame.unionByName, levels, none).filter("doc is not null")
    return every.groupBy(F.col("doc").alias("id"), "th").agg(F.max("starts").alias("starts"), F.max("n").alias("longest")), levels


def cut(docs: DataFrame, window: int) -> DataFrame:
    """docs: own, text, copy, starts, longest. own, n_words, n_removed, kept (words joined by one space), longest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for text, copy, starts, longest in zip(df["text"], df["copy"], df["starts"], df["longest"], strict=True):
                words = utf8(text).split()  # at the six blanks
                n = len(words)
                if copy and n >= window:
                    rows.append((n, n, "", window << (n // window).bit_length() - 1))
                    continue
                if starts is not None and len(starts) and not copy:
                    cover = np.zeros(n + 2, np.int64)
                    np.add.at(cover, starts + 1, 1)
                    np.add.at(cover, starts + window + 1, -1)
                    edge = np.flatnonzero(np.diff((np.cumsum(cover)[:-1] > 0).astype(np.int8), append=0)).tolist()  # where removed runs start and end
                    words = [w for a, b in zip([0, *edge[1::2]], [*edge[0::2], n], strict=True) for w in words[a:b]]
                rows.append((n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass"), 0 if pd.isna(longest) else int(longest)))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept", "longest"])
            out.insert(0, "own", df["own"].to_numpy())
            yield out

    return docs.mapInPandas(run, "own string, n_words long, n_removed long, kept string, longest long")


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """id_col, n_words, n_removed, kept, longest of every row.

    longest: the most words (window, twice that, ...) of a window of the row that starts in a document with a smaller id too; 0 if none.
    """
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("string").alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    x, y = hash128(F.col("text"))
    low = x.bitwiseAND(F.lit(0x7FFFFFFF))  # tells texts of one id apart
    keys = base.select("id", low.alias("th"), x.alias("x"), y.alias("y"))
    leads = keys.groupBy("x", "y").agg(F.min("id").alias("lead"), F.max("id").alias("last")).filter("lead < last").drop("last")
    copies = stash(keys.join(leads, ["x", "y"]).filter("lead < id").select("id", "th").distinct(), "copies", free=True)
    base = base.withColumn("th", low)
    maybe, alone = part(base, copies.select("id"))
    firsts = maybe.join(copies, ["id", "th"], "left_anti").select(*base.columns).unionByName(alone)
    gone, levels = passages(firsts.select("id", "th", "text"), window)
    gone = stash(gone.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True), "gone", free=True)
    drop_stash(copies, *levels)
    maybe, alone = part(base, gone.select("id"))
    hit = maybe.join(gone, ["id", "th"], "left").select("own", "text", "copy", "starts", "longest")
    miss = alone.select("own", "text", F.lit(False).alias("copy"), F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("long").alias("longest"))
    out = cut(hit.withColumn("copy", F.coalesce("copy", F.lit(False))).unionByName(miss), window)
    return out.withColumn("own", F.col("own").cast(kind)).withColumnRenamed("own", id_col)
