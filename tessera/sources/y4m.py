"""Y4M streams: header, geometry, frames, planes; and back to bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import COLOUR_SPACES, frame_geometry_sql
from ..functions.sql import Spark

MAGIC, FRAME = "YUV4MPEG2", "FRAME\n"
DEFAULT_SPACE = "420"


def header_fields(line: Column) -> dict[str, Column]:
    """width, height, framerate, interlace, aspect, space, colorrange and a map of the extensions of a header line."""
    parts = F.filter(F.split(F.regexp_replace(line, r"[\r\n]+$", ""), " "), lambda p: p != MAGIC)
    first = lambda key: F.get(F.transform(F.filter(parts, lambda p: F.startswith(p, F.lit(key))), lambda p: F.substring(p, F.lit(2), F.length(p))), F.lit(0))
    ext = F.transform(F.filter(parts, lambda p: F.startswith(p, F.lit("X"))), lambda p: F.struct(F.regexp_extract(p, "^X([^=]*)", 1).alias("k"), F.regexp_extract(p, "=(.*)$", 1).alias("v")))
    extension = F.map_from_entries(ext)
    return {"width": first("W").cast("int"), "height": first("H").cast("int"), "framerate": first("F"), "interlace": first("I"), "aspect": first("A"), "space": F.coalesce(first("C"), F.lit(DEFAULT_SPACE)), "colorrange": F.try_element_at(extension, F.lit("COLORRANGE")), "extension": extension}


def header_line(w: Column, h: Column, space: Column, colorrange: Column | None = None, extension: dict[str, Column] | None = None, framerate: str = "25:1", interlace: str = "p", aspect: str = "0:0") -> Column:
    parts = [F.lit(MAGIC), F.concat(F.lit("W"), w), F.concat(F.lit("H"), h), F.lit("F" + framerate), F.lit("I" + interlace), F.lit("A" + aspect), F.concat(F.lit("C"), space)]
    if colorrange is not None:
        parts.append(F.when(F.lower(colorrange).isin("full", "limited"), F.concat(F.lit("XCOLORRANGE="), F.upper(colorrange))))
    parts += [F.concat(F.lit(f"X{k}="), v) for k, v in (extension or {}).items()]
    return F.concat(F.concat_ws(" ", *parts), F.lit("\n"))


def with_header(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds the header's length, its fields and the frame geometry. A file that is not Y4M has a null header."""
    out = files.withColumn("_end", F.expr(f"nullif(position(X'0A', {content}), 0)"))
    out = out.withColumn("header", F.when(F.expr(f"substring({content}, 1, 9)") == F.encode(F.lit(MAGIC), "UTF-8"), F.decode(F.expr(f"substring({content}, 1, _end)"), "UTF-8")))
    out = out.withColumns(header_fields(F.col("header"))).withColumnsRenamed({"width": "w", "height": "h"})
    return out.withColumns({k: F.expr(v) for k, v in frame_geometry_sql(Spark).items()})


def frames(files: DataFrame, content: str = "content") -> DataFrame:
    """One row a frame: path, frame_no, payload. Frames lie a fixed stride apart; a last frame cut short is left out."""
    f = with_header(files, content).filter("header is not null").withColumn("_n", F.expr(f"(octet_length({content}) - _end) div (frame_bytes + 6)"))
    f = f.filter("_n > 0").withColumn("frame_no", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    at = "_end + 1 + frame_no * (frame_bytes + 6)"
    head = F.expr(f"substring({content}, cast({at} as int), 6)")
    return f.filter(head == F.encode(F.lit(FRAME), "UTF-8")).withColumn("payload", F.expr(f"substring({content}, cast({at} + 6 as int), cast(frame_bytes as int))")).drop("_n", "_end", content)


def values_of(buffers: pa.Array, width: int) -> pa.ListArray:
    """Buffers as lists of samples of `width` bytes, low first; a last sample cut short is left out, null stays null."""
    kind = "u1" if width == 1 else "<u2"
    offsets = np.frombuffer(buffers.buffers()[1], np.int32)[buffers.offset : buffers.offset + len(buffers) + 1] if len(buffers) else np.zeros(1, np.int32)
    sizes = np.diff(offsets) // width
    data = memoryview(buffers.buffers()[2] or b"")
    if (np.diff(offsets) % width == 0).all():  # all buffers at once
        values = np.frombuffer(data[offsets[0] : offsets[-1]], kind)
    else:
        values = np.concatenate([np.frombuffer(data[a : a + n * width], kind) for a, n in zip(offsets[:-1].tolist(), sizes.tolist(), strict=True)])
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values.astype(np.int32)), mask=buffers.is_null())


def byte_values(content: Column) -> Column:
    """A binary column as an array of ints."""
    return sample_values(content, 8)


def sample_values(content: Column, depth: int) -> Column:
    """Samples of a plane's bytes: one byte, or two, low first. Time and memory are in proportion to the bytes."""
    width = 1 if depth == 8 else 2

    @F.arrow_udf("array<int>")
    def values(buffers: pa.Array) -> pa.Array:
        return values_of(buffers, width)

    return values(content)


def planes(frame_rows: DataFrame, depth: int = 8) -> DataFrame:
    """Adds arrays luma, u, v of frames of one depth; u and v are empty for mono."""
    each = 1 if depth == 8 else 2
    luma, chroma = f"w * h * {each}", f"chroma_w * chroma_h * {each}"
    part = lambda a, n: f"substring(payload, cast({a} + 1 as int), cast({n} as int))"
    value = lambda a, n: sample_values(F.expr(part(a, n)), depth)
    return frame_rows.withColumns({"luma": value("0", luma), "u": value(luma, chroma), "v": value(f"{luma} + {chroma}", chroma)})


def pack_samples(v: str, depth: int = 8) -> Column:
    """An array of samples as binary."""
    one = "lpad(hex(s), 2, '0')" if depth == 8 else "concat(lpad(hex(s & 255), 2, '0'), lpad(hex(shiftright(s, 8)), 2, '0'))"
    return F.expr(f"unhex(array_join(transform({v}, s -> {one}), ''))")


def file_bytes(df: DataFrame, by: list[str], w: int, h: int, space: str, planes_: list[str], depth: int = 8, order: str = "frame_no", colorrange: str | None = None, extension: dict[str, str] | None = None, numbers: str | None = None) -> DataFrame:
    """One row a stream: header and frames in order. A stream's frames meet in one row, as its file does. Bytes hold no frame's number, only its place: numbers names an array that keeps them beside the bytes."""
    head = header_line(F.lit(w), F.lit(h), F.lit(space), F.lit(colorrange) if colorrange else None, {k: F.lit(v) for k, v in (extension or {}).items()})
    body = F.concat(F.encode(F.lit(FRAME), "UTF-8"), *[pack_samples(p, depth) for p in planes_])
    own = df.withColumn("_frame", body).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.hex("_frame").alias("f")))).alias("_f"))
    kept = [F.transform(F.filter("_f", lambda s: s["f"].isNotNull()), lambda s: s["o"]).alias(numbers)] if numbers else []
    return own.select(*by, F.concat(F.encode(head, "UTF-8"), F.unhex(F.array_join(F.transform("_f", lambda s: s["f"]), ""))).alias("content"), *kept)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Frames of the streams below a folder, each file read by as many tasks as it has ranges."""
    from .video import read_video

    return read_video(spark, path)


def supported_spaces() -> list[str]:
    return list(COLOUR_SPACES)
