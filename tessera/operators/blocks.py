"""Block codecs of alpha planes: tags and sizes as expressions, bit streams as an Arrow-batched function over images.

A block is all zero (tag 00), all maximum (01), raw (10), or, in the bitmap codec, made of the two ends alone (11, one bit a sample).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODECS = ("warhol", "warhol2", "bitmap", *(f"resolution-{k}" for k in range(7, 0, -1)))


def prepared(codec: str, v: str = "v", depth: int = 8) -> str:
    """A sample as the codec sees it."""
    top = (1 << depth) - 1
    if codec == "warhol2":
        return f"(case when {v} = {top - 1} then {top} when {v} = 1 then 0 else {v} end)"
    if codec.startswith("resolution-"):
        return f"shiftright({v}, {depth - int(codec[-1])})"
    return v


def payload_bits(codec: str, size: int, depth: int = 8) -> dict[str, int]:
    """Bits of a block after its tag."""
    n = size * size
    return {"00": 0, "01": 0, "10": n * (int(codec[-1]) if codec.startswith("resolution-") else 8 if depth == 8 else 16), "11": n}


def block_tags(df: DataFrame, codec: str, size: int = 4, depth: int = 8) -> DataFrame:
    """image_id, block_y, block_x, tag, bits of every block of a long plane whose sides are multiples of the size."""
    top = (1 << int(codec[-1])) - 1 if codec.startswith("resolution-") else (1 << depth) - 1
    s = df.withColumn("s", F.expr(prepared(codec, depth=depth)))
    g = s.groupBy("image_id", F.expr(f"y div {size}").cast("int").alias("block_y"), F.expr(f"x div {size}").cast("int").alias("block_x"))
    out = g.agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.bool_and(F.col("s").isin(0, top)).alias("two"))
    tag = F.when(F.col("hi") == 0, "00").when(F.col("lo") == top, "01")
    tag = (tag.when(F.col("two"), "11") if codec == "bitmap" else tag).otherwise("10")
    out = out.select("image_id", "block_y", "block_x", tag.alias("tag"))
    bits = payload_bits(codec, size, depth)
    return out.withColumn("bits", F.expr("case tag " + " ".join(f"when '{t}' then {n + 2}" for t, n in bits.items()) + " end"))


def tag_counts(tags: DataFrame) -> DataFrame:
    """image_id, the count of each tag, encoded bytes."""
    return tags.groupBy("image_id").agg(*[F.count_if(F.col("tag") == t).alias(f"n{t}") for t in ("00", "01", "10", "11")], F.expr("cast((sum(bits) + 7) div 8 as bigint)").alias("n_bytes"))


def pad(image: np.ndarray, size: int) -> np.ndarray:
    """Last row and column repeated to multiples of the size."""
    h, w = image.shape
    return np.pad(image, ((0, -h % size), (0, -w % size)), mode="edge")


def encode(image: np.ndarray, codec: str, size: int, depth: int = 8) -> bytes:
    x = pad(image, size).astype(np.int64)
    top, each = (1 << depth) - 1, 8 if depth == 8 else 16
    if codec == "warhol2":
        x = np.where(x == top - 1, top, np.where(x == 1, 0, x))
    if codec.startswith("resolution-"):
        each = int(codec[-1])
        x, top = x >> (depth - each), (1 << each) - 1
    h, w = x.shape
    rows = x.reshape(h // size, size, w // size, size).swapaxes(1, 2).reshape(-1, size * size)
    out = []
    for r in rows:
        if not r.any():
            out.append([0, 0])
        elif (r == top).all():
            out.append([0, 1])
        elif codec == "bitmap" and np.isin(r, (0, top)).all():
            out.append([1, 1, *(r == top).astype(int)])
        else:
            out.append([1, 0, *((r[:, None] >> np.arange(each - 1, -1, -1)) & 1).reshape(-1)])
    return np.packbits(np.concatenate(out).astype(np.uint8)).tobytes() if out else b""


def decode(data: bytes, codec: str, h: int, w: int, size: int, depth: int = 8, restore_white: bool = False) -> np.ndarray:
    """The image, cropped; restore_white lifts a reduced maximum back to the full one."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    top, each, shift = (1 << depth) - 1, 8 if depth == 8 else 16, 0
    if codec.startswith("resolution-"):
        each = int(codec[-1])
        shift = depth - each
    ph, pw = h + -h % size, w + -w % size
    out, at, n = np.zeros((ph // size * (pw // size), size * size), np.int64), 0, size * size
    full = top if not shift or restore_white else ((1 << each) - 1) << shift
    for row in out:
        tag = tuple(bits[at : at + 2])
        at += 2
        if tag == (0, 1):
            row[:] = full
        elif tag == (1, 1):
            row[:] = bits[at : at + n].astype(np.int64) * top
            at += n
        elif tag == (1, 0):
            row[:] = (bits[at : at + n * each].reshape(n, each).astype(np.int64) << np.arange(each - 1, -1, -1)).sum(1) << shift
            at += n * each
    return out.reshape(ph // size, pw // size, size, size).swapaxes(1, 2).reshape(ph, pw)[:h, :w]


def header(h: int, w: int, space: str, codec: str, size: int) -> str:
    return f"ALPHA {h} {w} {space} {codec} {size}\n"


def encode_planes(df: DataFrame, codec: str, h: int, w: int, size: int = 4, space: str = "mono") -> DataFrame:
    """image_id, file: header and stream of array planes (column v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"image_id": part["image_id"], "file": [header(h, w, space, codec, size).encode() + encode(np.asarray(v).reshape(h, w), codec, size) for v in part["v"]]})

    return df.select("image_id", "v").mapInPandas(run, "image_id long, file binary")


def decode_planes(df: DataFrame) -> DataFrame:
    """image_id, v of files that encode_planes wrote."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for f in part["file"]:
                head, _, body = bytes(f).partition(b"\n")
                _, h, w, _, codec, size = head.decode().split(" ")
                rows.append(decode(body, codec, int(h), int(w), int(size)).reshape(-1).tolist())
            yield pd.DataFrame({"image_id": part["image_id"], "v": rows})

    return df.mapInPandas(run, "image_id long, v array<int>")
