"""Target-distribution importance resampling: documents whose hashed n-grams look like a target's are drawn more often.

A feature is a run of 1 to `longest` words, and its bucket is the CRC-32 of its bytes modulo `buckets`. No feature is ever written out: the CRC of each word is
computed once, and that of a run follows from those of its words. CRCs are linear over GF(2): crc(AB) is crc(A), shifted by the length of B, plus (exclusive or)
crc(B). A shift by n bytes is a 32 x 32 bit matrix; matrices of 2^k bytes come by squaring, and are applied through tables of the four bytes of a CRC.

Each side's features are counted in each task (as many numbers as buckets, whatever the input) and added up in Spark; the gains of the buckets are sent to every task.
A second pass scores the documents. Ranks are global without a global sort: scores are integers, so documents are counted by score, counts are summed up in two levels
(256 scores a block), and only documents that tie in their score are ordered among themselves.

Rows: one per input row. Null and empty texts have no features and weigh 0. A null id counts as an empty id in the draw and comes last among ties; rows that repeat an
id are documents of their own. Empty tables give empty results; an empty target counts nothing. Only the named columns are read; texts are read whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TO_LOWER, blocks_of_texts, stash

#: Bytes of text handled at once; words longer than this have their CRC from a call of their own.
BLOCK, SHORT = 1 << 19, 40
_IN_WORD = np.ones(256, bool)
_IN_WORD[:0x80] = False
_IN_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _applied(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The matrix with these 32 columns times bit vectors x."""
    out = np.zeros_like(x)
    for k in range(32):
        out ^= np.where((x >> np.uint32(k)) & np.uint32(1), columns[k], np.uint32(0))
    return out


def _shift_tables(levels: int = 40) -> np.ndarray:
    """[k, b, v]: byte v in place b of a CRC, shifted by 2^k bytes."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = _CRC[unit & np.uint32(255)] ^ (unit >> np.uint32(8))  # one byte of zeros
    bytes_ = (np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])).astype(np.uint32)
    out = []
    for _ in range(levels):
        out.append(_applied(columns, bytes_))
        columns = _applied(columns, columns)
    return np.stack(out)


_SHIFT = _shift_tables()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC as it is after n more bytes of zeros, without their own part."""
    out = crc.copy()
    k = 0
    while (left := n >> k).any():
        at = np.flatnonzero(left & 1)
        c, t = out[at], _SHIFT[k]
        out[at] = t[0][c & np.uint32(255)] ^ t[1][(c >> np.uint32(8)) & np.uint32(255)] ^ t[2][(c >> np.uint32(16)) & np.uint32(255)] ^ t[3][c >> np.uint32(24)]
        k += 1
    return out


def word_crcs(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of bytes."""
    order = np.argsort(-length, kind="stable")
    s, n = start[order], length[order]
    out = np.full(len(s), 0xFFFFFFFF, np.uint32)
    far = int(np.searchsorted(-n, -SHORT, side="left"))  # the first so many are longer
    for p in range(int(n[far]) if far < len(n) else 0):
        stop = int(np.searchsorted(-n, -p, side="left"))
        c = out[far:stop]
        out[far:stop] = _CRC[(c ^ raw[s[far:stop] + p]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    data = memoryview(raw)
    for k in range(far):
        out[k] = zlib.crc32(data[s[k] : s[k] + n[k]])
    back = np.empty_like(out)
    back[order] = out
    return back


def features(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, bucket of each feature, its text)."""
    raw = TO_LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _IN_WORD[raw]]).astype(np.int8)))
    start, length = edge[0::2], edge[1::2] - edge[0::2]
    text = np.searchsorted(base, start, side="right") - 1
    word = word_crcs(raw, start, length)
    blank = np.uint32(zlib.crc32(b" "))
    runs, whose, own = [word], [text], word
    after_blank = shifted(np.full(len(word), blank), length) ^ word  # of a blank and the word
    for n in range(1, longest):
        own = shifted(own[:-1], length[n:] + 1) ^ after_blank[n:]
        same = text[n:] == text[: len(text) - n]
        runs.append(own[same])
        whose.append(text[n:][same])
    return np.bincount(text, minlength=len(texts)), np.concatenate(runs) % np.uint32(buckets), np.concatenate(whose)


def bucket_counts(docs: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts each bucket holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, texts in blocks_of_texts(b.column(0), BLOCK):
                total += np.bincount(features(texts, longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["b", "n"])

    rows = docs.select(F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.b] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, a thousand times the logarithm of the smoothed ratio of its shares, floored."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    top, bottom = (target + 1.0) * (s + n), (source + 1.0) * (t + n)
    return np.array([math.floor(1000 * math.log(x)) for x in (top / bottom).tolist()], np.int64)


def weigh(docs: DataFrame, id_col: str, text_col: str, gain: np.ndarray, longest: int) -> DataFrame:
    """id, n_words, n_features, weight of every row."""
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in blocks_of_texts(b.column(1), BLOCK):
                words, bucket, text = features(texts, longest, len(gain))
                many = np.bincount(text, minlength=len(texts))
                total = np.zeros(len(texts), np.int64)
                np.add.at(total, text, gain[bucket])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(words.astype(np.int64)), pa.array(many.astype(np.int64)), pa.array(total // np.maximum(many, 1))], names=["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, draw: int) -> DataFrame:
    """The rows of scored (id, n_features, weight, score) in the first `draw` places by score, then id, with rank."""
    counts = scored.groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("score") / 256))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).collect()
    above, seen = [], 0
    for r in sorted(blocks, key=lambda r: -r.block):
        above.append((r.block, seen))
        seen += r.n
    higher = counts.sparkSession.createDataFrame([a for a in above if a[1] < draw], "block long, above long")
    inside = F.sum("n").over(Window.partitionBy("block").orderBy(F.col("score").desc())) - F.col("n")
    before = counts.withColumn("inside", inside).join(F.broadcast(higher), "block").select("score", (F.col("above") + F.col("inside")).alias("before")).filter(F.col("before") < draw)
    ties = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight")
    rank = (F.row_number().over(ties) + F.col("before")).cast("long")
    return scored.join(before, "score").withColumn("rank", F.when(rank <= draw, rank)).drop("before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 2, buckets: int = 10000, min_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """id_col, n_features, weight, score, rank (null if not drawn) of every row. The draw is without replacement: scores are weights plus noise whose largest values are such a draw."""
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weigh(docs, id_col, text_col, gain, longest).withColumn("score", F.col("weight") + noise)
    scored = stash(scored.select("id", "n_words", "n_features", "weight", "score"), "scored")
    able = scored.filter(F.col("n_words") >= min_words).drop("n_words")
    draw = able.count() * percent // 100
    drawn = ranked(able, draw) if draw else able.limit(0).withColumn("rank", F.lit(None).cast("long"))
    drawn = stash(drawn.select("id", "n_features", "weight", "score", "rank"), "drawn", free=True)
    drop_score = drawn.agg(F.min("score").alias("s")).first()["s"]
    rest = scored.filter((F.col("n_words") < min_words) | (F.lit(True) if drop_score is None else F.col("score") < drop_score)).drop("n_words")
    return drawn.unionByName(rest.withColumn("rank", F.lit(None).cast("long"))).withColumnRenamed("id", id_col).select(id_col, "n_features", "weight", "score", "rank")
