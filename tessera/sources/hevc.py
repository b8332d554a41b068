"""HEVC configuration boxes (hvcC): fields and NAL units."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jpeg import Reader

SPS = 33


def parse_hvcc(data: bytes) -> tuple[dict, list[tuple[int, int, bytes]]]:
    """(fields, (nal type, index, bytes)) of a box."""
    r = Reader(data)
    if r.u(4) != len(data) or r.take(4) != b"hvcC" or r.u() != 1:
        raise ValueError("not an hvcC box")
    b = r.u()
    out = {"profile_space": b >> 6, "tier": b >> 5 & 1, "profile": b & 31, "compatibility": r.u(4), "constraints": r.u(6), "level": r.u(), "segmentation": r.u(2) & 4095, "parallelism": r.u() & 3, "chroma_format": r.u() & 3}
    out |= {"depth_luma": 8 + (r.u() & 7), "depth_chroma": 8 + (r.u() & 7), "frame_rate": r.u(2)}
    b = r.u()
    out |= {"constant_rate": b >> 6, "layers": b >> 3 & 7, "nested": b >> 2 & 1, "length_size": 1 + (b & 3)}
    units = []
    for _ in range(r.u()):
        kind = r.u() & 63
        for k in range(r.u(2)):
            units.append((kind, k, r.take(r.u(2))))
    return out, units


def nal_units(boxes: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, profile, level, depth_luma, nal_type, idx, nal. A box that cannot be read gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for p, data in zip(df["path"], df["content"], strict=True):
                try:
                    fields, units = parse_hvcc(bytes(data or b""))
                except ValueError:
                    continue
                rows += [(p, fields["profile"], fields["level"], fields["depth_luma"], t, k, u) for t, k, u in units]
            yield pd.DataFrame(rows, columns=["path", "profile", "level", "depth_luma", "nal_type", "idx", "nal"])

    return boxes.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, profile int, level int, depth_luma int, nal_type int, idx int, nal binary")


def colour_range(extension: str = "extension", meta: str = "meta"):
    """Colour range of a HEIF or AVIF file from its metadata map."""
    return F.when(F.lower(extension).isin(".heic", ".hif"), F.coalesce(F.try_element_at(meta, F.lit("hevc:fr")), F.lit("0"))).when(F.lower(extension) == ".avif", F.coalesce(F.try_element_at(meta, F.lit("colr:fr")), F.lit("1")))


# ---- sequence parameter sets ----


class Bits:
    """Fields of a NAL unit's payload, most significant bit first, without the bytes that only keep start codes away."""

    def __init__(self, nal: bytes):
        out, zeros = bytearray(), 0
        for b in nal:
            if zeros >= 2 and b == 3:
                zeros = 0
                continue
            zeros = zeros + 1 if b == 0 else 0
            out.append(b)
        self.value, self.size, self.at = int.from_bytes(out, "big"), 8 * len(out), 0

    def u(self, n: int = 1) -> int:
        self.at += n
        if self.at > self.size:
            raise ValueError("a parameter set ends early")
        return self.value >> (self.size - self.at) & ((1 << n) - 1)

    def ue(self) -> int:
        """An Exp-Golomb code."""
        zeros = 0
        while not self.u():
            zeros += 1
            if zeros > 32:
                raise ValueError("a code of over 32 bits")
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


def _profile(r: Bits, sub_layers: int) -> dict:
    out = {"profile_space": r.u(2), "tier": r.u(), "profile": r.u(5), "compatibility": r.u(32), "constraints": r.u(48), "level": r.u(8)}
    there = [(r.u(), r.u()) for _ in range(sub_layers)]
    if sub_layers:
        r.u(2 * (8 - sub_layers))
    for profile, level in there:
        r.u(88 * profile + 8 * level)
    return out


def _scaling_lists(r: Bits) -> None:
    for size in range(4):
        for _ in range(0, 6, 3 if size == 3 else 1):
            if not r.u():
                r.ue()
                continue
            if size > 1:
                r.se()
            for _ in range(min(64, 1 << 4 + 2 * size)):
                r.se()


def _reference_sets(r: Bits) -> list[int]:
    """The number of pictures of each short-term set."""
    out: list[int] = []
    for k in range(r.ue()):
        if k and r.u():  # as a change of the set before
            r.u()
            r.ue()
            n = 0
            for _ in range(out[-1] + 1):
                n += bool(r.u() or r.u())
            out.append(n)
            continue
        n = r.ue() + r.ue()
        if n > 32:
            raise ValueError(f"a set of {n} pictures")
        for _ in range(n):
            r.ue()
            r.u()
        out.append(n)
    return out


def _usability(r: Bits) -> dict:
    out: dict = {}
    if r.u():
        out["aspect"] = r.u(8)
        if out["aspect"] == 255:
            out |= {"sar_w": r.u(16), "sar_h": r.u(16)}
    if r.u():
        out["overscan"] = r.u()
    if r.u():
        out |= {"video_format": r.u(3), "fr": r.u()}
        if r.u():
            out |= {"cp": r.u(8), "tc": r.u(8), "mc": r.u(8)}
    return out


def parse_sps(nal: bytes) -> dict:
    """Fields of a sequence parameter set (H.265, 7.3.2.2): size after cropping, depths, profile, level, and what the usability part says of colour (fr, cp, tc, mc)."""
    if len(nal) < 2 or nal[0] >> 1 & 63 != SPS:
        raise ValueError("no sequence parameter set")
    r = Bits(nal[2:])
    out = {"vps_id": r.u(4)}
    sub_layers = r.u(3)
    r.u()
    out |= _profile(r, sub_layers) | {"sub_layers": sub_layers + 1, "sps_id": r.ue(), "chroma_format": r.ue()}
    if out["chroma_format"] == 3:
        out["separate_planes"] = r.u()
    w, h = r.ue(), r.ue()
    x, y = {1: (2, 2), 2: (2, 1)}.get(out["chroma_format"], (1, 1))
    if r.u():
        left, right, top, bottom = (r.ue() for _ in range(4))
        w, h = w - x * (left + right), h - y * (top + bottom)
    out |= {"w": w, "h": h, "depth_luma": 8 + r.ue(), "depth_chroma": 8 + r.ue()}
    order_bits = 4 + r.ue()
    for _ in range(0 if r.u() else sub_layers, sub_layers + 1):
        r.ue(), r.ue(), r.ue()
    smallest = 3 + r.ue()
    out |= {"smallest_block": 1 << smallest, "largest_block": 1 << smallest + r.ue()}
    for _ in range(4):
        r.ue()
    if r.u() and r.u():
        _scaling_lists(r)
    r.u(2)
    if r.u():
        r.u(8)
        r.ue(), r.ue(), r.u()
    out["reference_sets"] = len(_reference_sets(r))
    if r.u():
        for _ in range(r.ue()):
            r.u(order_bits + 1)
    r.u(2)
    if r.u():
        out |= _usability(r)
    return out


class _Fields:
    """Bits to be written."""

    def __init__(self):
        self.bits: list[str] = []

    def u(self, n: int, v: int) -> _Fields:
        self.bits.append(format(v, f"0{n}b") if n else "")
        return self

    def ue(self, *values: int) -> _Fields:
        for v in values:
            text = format(v + 1, "b")
            self.bits.append("0" * (len(text) - 1) + text)
        return self

    def nal(self, kind: int) -> bytes:
        text = "".join(self.bits) + "1"
        text += "0" * (-len(text) % 8)
        out, zeros = bytearray([kind << 1, 1]), 0
        for k in range(0, len(text), 8):
            b = int(text[k : k + 8], 2)
            if zeros >= 2 and b <= 3:
                out.append(3)
                zeros = 0
            zeros = zeros + 1 if b == 0 else 0
            out.append(b)
        return bytes(out)


def write_sps(w: int, h: int, depth: int = 8, profile: int = 1, level: int = 93, chroma_format: int = 1, crop: tuple[int, int] = (0, 0), sub_layers: int = 1, sets: tuple[int, ...] = (), colour: tuple[int, int, int, int] | None = None) -> bytes:
    """A parameter set. crop: samples to the right and below, in units of chroma. sets: pictures of each short-term reference set. colour: fr, cp, tc, mc."""
    f, more = _Fields(), sub_layers - 1
    f.u(4, 0).u(3, more).u(1, 1).u(3, 0).u(5, profile).u(32, 1 << 31 - profile).u(48, 0).u(8, level)
    f.u(2 * more, (1 << 2 * more) - 1).u(2 * (8 - more) if more else 0, 0).u(96 * more, 0)
    f.ue(0, chroma_format)
    if chroma_format == 3:
        f.u(1, 0)
    f.ue(w, h).u(1, any(crop))
    if any(crop):
        f.ue(0, crop[0], 0, crop[1])
    f.ue(depth - 8, depth - 8, 4).u(1, 1)
    f.ue(*[4, 2, 0] * sub_layers).ue(0, 3, 0, 3, 1, 1).u(1, 0).u(2, 3).u(1, 0).ue(len(sets))
    for k, n in enumerate(sets):
        f.u(1 if k else 0, 0).ue(n, 0)
        for _ in range(n):
            f.ue(0).u(1, 1)
    f.u(1, 0).u(2, 3).u(1, colour is not None)
    if colour is not None:
        fr, cp, tc, mc = colour
        f.u(1, 0).u(1, 0).u(1, 1).u(3, 5).u(1, fr).u(1, 1).u(8, cp).u(8, tc).u(8, mc).u(5, 0)
    return f.nal(SPS)


def write_box(units: list[tuple[int, list[bytes]]], profile: int = 1, level: int = 93) -> bytes:
    """An hvcC box of arrays of NAL units by type."""
    body = bytes([1, profile]) + bytes(4) + bytes(6) + bytes([level, 0xF0, 0, 0xFC, 0xFD, 0xF8, 0xF8, 0, 0, 0x0F, len(units)])
    for kind, nals in units:
        body += bytes([0x80 | kind]) + len(nals).to_bytes(2, "big") + b"".join(len(n).to_bytes(2, "big") + n for n in nals)
    return (len(body) + 8).to_bytes(4, "big") + b"hvcC" + body


SPS_FIELDS = ("profile", "tier", "level", "sub_layers", "chroma_format", "w", "h", "depth_luma", "depth_chroma", "smallest_block", "largest_block", "reference_sets", "video_format", "fr", "cp", "tc", "mc")
#: What a parameter set adds to a file's metadata.
SPS_COLOUR = ("profile", "level", "fr", "cp", "tc", "mc")


def parameter_sets(units: DataFrame, nal: str = "nal", nal_type: str = "nal_type") -> DataFrame:
    """The rows of sequence parameter sets (of nal_units) with the struct `sps`; fields that a set leaves out are null, and one that cannot be read has an error."""
    kind = "struct<" + ",".join(f"{c}:int" for c in SPS_FIELDS) + ",error:string>"

    @F.pandas_udf(kind)
    def read(nals: pd.Series) -> pd.DataFrame:
        rows = []
        for n in nals:
            try:
                rows.append(parse_sps(bytes(n or b"")))
            except ValueError as e:
                rows.append({"error": str(e)})
        return pd.DataFrame([{c: r.get(c) for c in (*SPS_FIELDS, "error")} for r in rows], columns=[*SPS_FIELDS, "error"]).astype({c: "Int32" for c in SPS_FIELDS})

    return units.filter(F.col(nal_type) == SPS).withColumn("sps", read(nal))


def colorimetry(boxes: DataFrame, path: str = "path", content: str = "content", prefix: str = "hvcC:") -> DataFrame:
    """path and a map of prefixed names to numbers, from the bits of each box's last readable parameter set, as of the box's order. Files without one are left out."""
    sets = parameter_sets(nal_units(boxes, path, content)).filter("sps.error is null")
    last = sets.groupBy("path").agg(F.max_by("sps", "idx").alias("sps"))
    pairs = F.array(*[F.struct(F.lit(prefix + c).alias("k"), F.col(f"sps.{c}").alias("v")) for c in SPS_COLOUR])
    return last.select("path", F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("meta"))
