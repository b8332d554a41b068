"""JPEG and JPEG-LS markers: a table function over a file's bytes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Marker codes and names.
MARKERS = {0xC0 + i: f"SOF{i}" for i in range(16) if i not in (4, 8, 12)}
MARKERS |= {0xC4: "DHT", 0xC8: "JPG", 0xCC: "DAC", 0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xDD: "DRI", 0xFE: "COM", 0xF7: "SOF55", 0xF8: "LSE"}
MARKERS |= {0xE0 + i: f"APP{i}" for i in range(16)}
COMPONENTS = {1: "Y", 2: "Cb", 3: "Cr", 4: "I", 5: "Q"}
TRANSFORMS = {0: "Unknown (RGB or CMYK)", 1: "YCbCr", 2: "YCCK"}
LSE_KINDS = {1: "Preset coding parameters", 2: "Mapping table specification", 3: "Mapping table continuation", 4: "Oversize image dimensions"}
PREFIXES = {
    0xE0: {b"JFIF\0": "JFIF"}, 0xE2: {b"ICC_PROFILE\0": "ICC_PROFILE", b"MPF\0": "MPF"},
    0xE1: {b"Exif\0\0": "EXIF", b"Exif\0\xff": "EXIF", b"http://ns.adobe.com/xap/1.0/\0": "Adobe XMP", b"http://ns.adobe.com/xmp/extension/\0": "Adobe extended XMP"},
}


class Reader:
    """Big-endian fields of a segment, one after another."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise ValueError("a segment ends early")
        return self.data[self.at - n : self.at]

    def u(self, n: int = 1) -> int:
        return int.from_bytes(self.take(n), "big")

    @property
    def left(self) -> int:
        return len(self.data) - self.at


def _prefixed(marker: int, r: Reader) -> dict:
    for prefix, kind in PREFIXES[marker].items():
        if r.data.startswith(prefix):
            r.at = len(prefix)
            out = {"type": kind}
            if kind == "JFIF":
                out |= dict(zip(("version_major", "version_minor", "density_units"), (r.u(), r.u(), r.u()), strict=True)) | {"xdensity": r.u(2), "ydensity": r.u(2), "xthumbnail": r.u(), "ythumbnail": r.u()}
            elif kind == "ICC_PROFILE":
                out |= {"chunk": r.u(), "chunks": r.u()}
            return out
    return {"type": "unknown"}


def _tables(r: Reader) -> dict:
    out = []
    while r.left:
        head = r.u()
        out.append({"Pq": head >> 4, "Tq": head & 15, "Q": [r.u(1 + (head >> 4 > 0)) for _ in range(64)]})
    return {"tables": out}


def _huffman(r: Reader) -> dict:
    out = []
    while r.left:
        head, counts = r.u(), [r.u() for _ in range(16)]
        out.append({"Tc": head >> 4, "Th": head & 15, "L": counts, "V": [[r.u() for _ in range(n)] for n in counts]})
    return {"tables": out}


def _frame(number: int, r: Reader) -> dict:
    out = {"sof": number, "sample_precision": r.u(), "number_of_lines": r.u(2), "number_of_samples_per_line": r.u(2)}
    parts = []
    for _ in range(r.u()):
        cid, sampling, table = r.u(), r.u(), r.u()
        parts.append({"component_id": cid, "component": COMPONENTS.get(cid, f"Unknown({cid})"), "horizontal": sampling >> 4, "vertical": sampling & 15, "table": table})
    return out | {"components": parts}


def _scan(r: Reader) -> dict:
    parts = []
    for _ in range(r.u()):
        cid, tables = r.u(), r.u()
        parts.append({"component_id": cid, "component": COMPONENTS.get(cid, f"Unknown({cid})"), "dc": tables >> 4, "ac": tables & 15})
    start, end, bits = r.u(), r.u(), r.u()
    return {"components": parts, "spectral_selection": [start, end], "approximation": [bits >> 4, bits & 15]}


def _extension(r: Reader) -> dict:
    if not r.left:
        return {"error": "an empty segment"}
    kind = r.u()
    out = {"lse_id": kind, "type": LSE_KINDS.get(kind, "unknown")}
    if kind == 1:
        return out | {k: r.u(2) for k in ("MAXVAL", "T1", "T2", "T3", "RESET")}
    if kind in (2, 3):
        table, width = r.u(), r.u()
        out |= {"table_id": table, "entry_width": width}
        return out | ({"num_entries": r.left // width} if width in (1, 2, 3) else {"error": f"an entry width of {width}"})
    if kind == 4:
        size = r.u()
        return out | {"Wxy": size, "height": r.u(size), "width": r.u(size)}
    return out


def parse_segment(marker: int, data: bytes) -> dict:
    """What a segment says; a segment cut short has an error."""
    r = Reader(data)
    try:
        if marker in PREFIXES:
            return _prefixed(marker, r)
        if marker == 0xEE and data.startswith(b"Adobe\0"):
            r.at = 6
            return dict(zip(("version", "flags0", "flags1"), (r.u(), r.u(), r.u()), strict=True)) | {"transform": TRANSFORMS.get(r.u(), "unknown")}
        if marker == 0xED:
            return {"text": data.split(b"\0")[0].decode("ascii", "ignore")}
        if marker == 0xFE:
            return {"comment": data.decode("ascii", "ignore")}
        if marker == 0xDB:
            return _tables(r)
        if marker == 0xC4:
            return _huffman(r)
        if marker == 0xDD:
            return {"interval": r.u(2)}
        if marker == 0xDA:
            return _scan(r)
        if marker == 0xF8:
            return _extension(r)
        if marker in MARKERS and MARKERS[marker].startswith("SOF"):
            return _frame(int(MARKERS[marker][3:]), r)
        return {}
    except ValueError as e:
        return {"error": str(e)}


def scan(data: bytes) -> Iterator[tuple[int, str, int, int, dict]]:
    """(marker, name, offset, length, contents) in order; entropy-coded data follows a scan as a row of its own. Ends at EOI or where the file ends."""
    at, lossless = 0, False
    while at + 1 < len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        name = MARKERS.get(marker, "UNKNOWN")
        lossless |= marker == 0xF7
        if marker in (0xD8, 0xD9) or 0xD0 <= marker <= 0xD7:
            yield marker, name, at, 0, {}
            at += 2
            if marker == 0xD9:
                return
            continue
        if at + 4 > len(data):
            return
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, name, at, length, parse_segment(marker, data[at + 4 : at + 2 + length])
        at += 2 + max(2, length)
        if marker == 0xDA:
            start = at
            while at + 1 < len(data):
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    at = len(data)
                    break
                nxt = data[at + 1]
                # stuffing: a zero byte, or in JPEG-LS a byte below 0x80; restart markers belong to the data
                if (nxt < 0x80 if lossless else nxt == 0) or 0xD0 <= nxt <= 0xD7:
                    at += 2
                else:
                    break
            yield 0, "compressed_data", start, at - start, {}


#: Markers that are handed on at once.
ROWS = 10_000
FIELDS = "marker_id int, marker string, offset long, length int, contents string"


def markers(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, seq, marker_id, marker, offset, length, contents (JSON)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "seq", "marker_id", "marker", "offset", "length", "contents"]
        for df in batches:
            rows = []
            for p, data in zip(df["path"], df["content"], strict=True):
                rows += [(p, k, m, n, o, ln, json.dumps(c)) for k, (m, n, o, ln, c) in enumerate(scan(bytes(data or b"")))]
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, seq int, " + FIELDS)


def extract(found: DataFrame, name: str) -> DataFrame:
    """The first marker of a name in each file."""
    return found.filter(F.col("marker") == name).groupBy("path").agg(F.min_by(F.struct("seq", "offset", "length", "contents"), "seq").alias("m")).select("path", "m.*")


def markers_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(MARKERS.items()), "marker_id int, marker string")


def build(segments: list[tuple[int, bytes]]) -> bytes:
    """A file of segments: SOI, each marker with its length, EOI. Entropy data is given as marker 0."""
    parts = [b"\xff\xd8"] + [d if not m else bytes([0xFF, m]) + (2 + len(d)).to_bytes(2, "big") + d for m, d in segments] + [b"\xff\xd9"]
    return b"".join(parts)


def offsets(segments: list[bytes]) -> list[int]:
    return [0, *accumulate(map(len, segments))][:-1]
