"""Baseline JPEG to planes: prefix codes, dequantisation and the inverse transform, over the segments that `jpeg` finds; and an encoder for files of known planes.

Sequential files of 8 bits with one to four components of any sampling, with restart markers, in one scan or several. Other kinds (progressive, lossless, arithmetic) are told by
their status and have no planes. Codes are followed in a loop, as each starts where the last ended; coefficients of a component are transformed at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jpeg

BASELINE, NAMES = (0xC0, 0xC1), {1: "y", 2: "uv", 3: "yuv", 4: "cmyk"}


def zigzag() -> np.ndarray:
    """Where each coefficient of the stored order stands in rows and columns: along the diagonals, up and down by turns."""
    places = [(y, x) for y in range(8) for x in range(8)]
    places.sort(key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * y + x for y, x in places])


ZIGZAG = zigzag()
_C = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def half_up(x: np.ndarray) -> np.ndarray:
    """To the nearest integer; what lies within 1e-7 of a half goes up."""
    return np.floor(x + 0.5 + 1e-7).astype(np.int64)


def inverse(coefficients: np.ndarray) -> np.ndarray:
    """Blocks x 64 coefficients (rows and columns) to blocks x 8 x 8 samples."""
    return np.clip(half_up(_C.T @ coefficients.reshape(-1, 8, 8).astype(np.float64) @ _C) + 128, 0, 255)


def codes(counts: list[int], values: list[int]) -> list[tuple[int, int, int]]:
    """(length, code, value): codes of a length follow one another, shorter first."""
    out, code, at = [], 0, 0
    for n, many in enumerate(counts, 1):
        for v in values[at : at + many]:
            out.append((n, code, v))
            code += 1
        at += many
        code <<= 1
    return out


def lookup(counts: list[int], values: list[int]) -> list[int]:
    """For the next 16 bits, length * 256 + value of the code they start with; 0 where there is none."""
    table = [0] * 65536
    for n, code, v in codes(counts, values):
        low = code << 16 - n
        if low + (1 << 16 - n) > 65536:
            raise ValueError("more codes than their lengths allow")
        table[low : low + (1 << 16 - n)] = [n << 8 | v] * (1 << 16 - n)
    return table


@dataclass
class Component:
    ident: int
    across: int
    down: int
    table: int
    blocks_w: int = 0
    blocks_h: int = 0
    w: int = 0
    h: int = 0
    coefficients: list = field(default_factory=list)


class Stream:
    """Bits of entropy-coded bytes without stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self) -> None:
        """At least 32 bits; behind the end come ones."""
        while self.n < 32:
            more = self.data[self.at : self.at + 4].ljust(4, b"\xff")
            self.at += 4
            self.held = (self.held & (1 << self.n) - 1) << 32 | int.from_bytes(more, "big")
            self.n += 32
        if self.at > len(self.data) + 12:
            raise ValueError("coded data end early")

    def symbol(self, table: list[int]) -> int:
        if self.n < 16:
            self.fill()
        e = table[self.held >> self.n - 16 & 0xFFFF]
        if not e:
            raise ValueError("bits that are no code")
        self.n -= e >> 8
        return e & 255

    def signed(self, size: int) -> int:
        """A number of `size` bits; those that start with 0 are negative."""
        if not size:
            return 0
        if self.n < size:
            self.fill()
        self.n -= size
        v = self.held >> self.n & (1 << size) - 1
        return v if v >> size - 1 else v - (1 << size) + 1


def _block(s: Stream, dc: list[int], ac: list[int], last: int, out: list[int]) -> int:
    """One block's 64 coefficients, in stored order, at the end of `out`; its first one."""
    own = [0] * 64
    last += s.signed(s.symbol(dc))
    own[0] = last
    k = 1
    while k < 64:
        e = s.symbol(ac)
        run, size = e >> 4, e & 15
        if not size:
            if run < 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("a block of more than 64 coefficients")
        own[k] = s.signed(size)
        k += 1
    out.extend(own)
    return last


def _restarts(data: bytes) -> list[bytes]:
    """Coded data between restart markers, without stuffed zeros."""
    parts, at = [], 0
    while True:
        k = at
        while (k := data.find(b"\xff", k)) >= 0 and k + 1 < len(data) and not 0xD0 <= data[k + 1] <= 0xD7:
            k += 2
        stop = len(data) if k < 0 or k + 1 >= len(data) else k
        parts.append(data[at:stop].replace(b"\xff\0", b"\xff"))
        if stop == len(data):
            return parts
        at = stop + 2


def _scan(head: dict, data: bytes, parts: dict[int, Component], mcu: tuple[int, int], grid: tuple[int, int], interval: int, tables: dict) -> None:
    chosen = [(parts[c["component_id"]], tables[0, c["dc"]], tables[1, c["ac"]]) for c in head["components"]]
    alone = len(chosen) == 1
    if alone:  # blocks in rows, only those that the component has
        c = chosen[0][0]
        columns, rows = -(-c.w // 8), -(-c.h // 8)
    else:
        columns, rows = grid
    for c, _, _ in chosen:
        c.coefficients = [[0] * 64 for _ in range(c.blocks_w * c.blocks_h)]
    total, pieces = columns * rows, _restarts(data)
    step = interval or total
    for k, piece in enumerate(pieces):
        s, last = Stream(piece), [0] * len(chosen)
        for m in range(k * step, min(total, (k + 1) * step)):
            my, mx = divmod(m, columns)
            for i, (c, dc, ac) in enumerate(chosen):
                for y, x in [(my, mx)] if alone else [(my * c.down + y, mx * c.across + x) for y in range(c.down) for x in range(c.across)]:
                    own: list[int] = []
                    last[i] = _block(s, dc, ac, last[i], own)
                    c.coefficients[y * c.blocks_w + x] = own
    if len(pieces) * step < total:
        raise ValueError("coded data end early")


def decode(data: bytes) -> dict:
    """w, h, depth, planes (name to (samples, w, h)), status. Planes of a file that cannot be read are empty, and status says why."""
    out: dict = {"w": None, "h": None, "depth": None, "planes": {}, "status": "ok"}
    try:
        quant, tables, parts, interval, frame, head, scans = {}, {}, {}, 0, None, None, 0
        for marker, name, at, n, said in jpeg.scan(data):
            if "error" in said:
                raise ValueError(f"{name}: {said['error']}")
            if marker == 0xDB:
                quant |= {t["Tq"]: np.array(t["Q"]) for t in said["tables"]}
            elif marker == 0xC4:
                tables |= {(t["Tc"], t["Th"]): lookup(t["L"], [v for row in t["V"] for v in row]) for t in said["tables"]}
            elif marker == 0xDD:
                interval = said["interval"]
            elif name.startswith("SOF"):
                out |= {"w": said["number_of_samples_per_line"], "h": said["number_of_lines"], "depth": said["sample_precision"]}
                if marker not in BASELINE or out["depth"] != 8 or len(said["components"]) not in NAMES:
                    raise ValueError(f"{name} of {out['depth']} bits is not read")
                if not out["w"] or not out["h"]:
                    raise ValueError("a frame without a size")
                frame = [Component(c["component_id"], c["horizontal"], c["vertical"], c["table"]) for c in said["components"]]
                if any(not 1 <= v <= 4 for c in frame for v in (c.across, c.down)):
                    raise ValueError("a sampling factor that is not 1 to 4")
                mcu = max(c.across for c in frame), max(c.down for c in frame)
                grid = -(-out["w"] // (8 * mcu[0])), -(-out["h"] // (8 * mcu[1]))
                for c in frame:
                    c.blocks_w, c.blocks_h = grid[0] * c.across, grid[1] * c.down
                    c.w, c.h = -(-out["w"] * c.across // mcu[0]), -(-out["h"] * c.down // mcu[1])
                parts = {c.ident: c for c in frame}
            elif marker == 0xDA:
                head = said
            elif name == "compressed_data" and head is not None:
                if frame is None:
                    raise ValueError("a scan before its frame")
                _scan(head, data[at : at + n], parts, mcu, grid, interval, tables)
                scans += 1
        if frame is None or not scans or any(not c.coefficients for c in frame):
            raise ValueError("no pixels")
        for letter, c in zip(NAMES[len(frame)], frame, strict=True):
            raw = np.zeros((len(c.coefficients), 64), np.int64)
            raw[:, ZIGZAG] = np.array(c.coefficients) * quant[c.table]
            v = inverse(raw).reshape(c.blocks_h, c.blocks_w, 8, 8).swapaxes(1, 2).reshape(8 * c.blocks_h, 8 * c.blocks_w)
            out["planes"][letter] = (v[: c.h, : c.w], c.w, c.h)
    except (ValueError, KeyError, IndexError) as e:
        out["planes"], out["status"] = {}, f"{e}" if isinstance(e, ValueError) else f"a table that is not there: {e}"
    return out


KIND = "struct<w:int,h:int,depth:int,planes:map<string,struct<v:array<int>,w:int,h:int>>,status:string>"
_PLANES = pa.map_(pa.string(), pa.struct([("v", pa.list_(pa.int32())), ("w", pa.int32()), ("h", pa.int32())]))


def decoded(content: Column) -> Column:
    """A column of files as struct: w, h, depth, planes (each with its own size), status."""

    @F.arrow_udf(KIND)
    def run(files: pa.Array) -> pa.Array:
        rows = []
        for f in files:
            d = decode(f.as_py() or b"")
            rows.append(d | {"planes": [(k, {"v": v.ravel().tolist(), "w": w, "h": h}) for k, (v, w, h) in d["planes"].items()]})
        return pa.array(rows, pa.struct([("w", pa.int32()), ("h", pa.int32()), ("depth", pa.int32()), ("planes", _PLANES), ("status", pa.string())]))

    return run(content)


# ---- encoder ----


class _Out:
    def __init__(self):
        self.text: list[str] = []

    def put(self, code: str, value: int, size: int) -> None:
        self.text.append(code)
        if size:
            self.text.append(format(value if value > 0 else value + (1 << size) - 1, f"0{size}b"))

    def bytes(self) -> bytes:
        text = "".join(self.text)
        text += "1" * (-len(text) % 8)
        return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")


def _even_codes(values: list[int]) -> tuple[list[int], dict[int, str]]:
    """Counts by length and codes: all values but the last few at one length, none all ones."""
    n = int(len(values)).bit_length()
    counts = [0] * 16
    counts[n - 1] = len(values)
    return counts, {v: format(code, f"0{length}b") for length, code, v in codes(counts, values)}


def encode(planes: list[np.ndarray], sampling: list[tuple[int, int]], w: int, h: int, q: int = 1, restart: int = 0, interleaved: bool = True) -> bytes:
    """A baseline file of planes that are sampled as said (across, down) from w x h; one step of quantisation for all coefficients."""
    mcu = max(a for a, _ in sampling), max(b for _, b in sampling)
    grid = -(-w // (8 * mcu[0])), -(-h // (8 * mcu[1]))
    dc_counts, dc_codes = _even_codes(list(range(12)))
    ac_values = [0, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    ac_counts, ac_codes = _even_codes(ac_values)
    blocks = []
    for v, (a, b) in zip(planes, sampling, strict=True):
        wide = np.pad(v.astype(np.int64), ((0, 8 * b * grid[1] - v.shape[0]), (0, 8 * a * grid[0] - v.shape[1])), "edge")
        cut = wide.reshape(b * grid[1], 8, a * grid[0], 8).swapaxes(1, 2).astype(np.float64) - 128
        blocks.append(half_up(_C @ cut @ _C.T / q).reshape(b * grid[1], a * grid[0], 64)[..., ZIGZAG])

    def put(out: _Out, own: np.ndarray, last: int) -> int:
        size = abs(int(own[0]) - last).bit_length()
        out.put(dc_codes[size], int(own[0]) - last, size)
        run = 0
        for x in own[1:].tolist():
            if not x:
                run += 1
                continue
            while run > 15:
                out.put(ac_codes[0xF0], 0, 0)
                run -= 16
            out.put(ac_codes[run << 4 | abs(x).bit_length()], x, abs(x).bit_length())
            run = 0
        if run:
            out.put(ac_codes[0], 0, 0)
        return int(own[0])

    def scan(which: list[int]) -> bytes:
        if len(which) == 1:
            i = which[0]
            rows, columns = -(-planes[i].shape[0] // 8), -(-planes[i].shape[1] // 8)
            units = [[(i, y, x)] for y in range(rows) for x in range(columns)]
        else:
            units = [[(i, my * sampling[i][1] + y, mx * sampling[i][0] + x) for i in which for y in range(sampling[i][1]) for x in range(sampling[i][0])] for my in range(grid[1]) for mx in range(grid[0])]
        step, out = restart or len(units), b""
        for n, k in enumerate(range(0, len(units), step)):
            piece, last = _Out(), {i: 0 for i in which}
            for unit in units[k : k + step]:
                for i, y, x in unit:
                    last[i] = put(piece, blocks[i][y, x], last[i])
            out += (bytes([0xFF, 0xD0 + (n - 1) % 8]) if n else b"") + piece.bytes()
        return out

    frame = bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(planes)]) + b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(sampling))
    segments = [(0xDB, bytes([0] + [q] * 64)), (0xC0, frame), (0xC4, bytes([0, *dc_counts, *range(12), 0x10, *ac_counts, *ac_values]))]
    if restart:
        segments.append((0xDD, restart.to_bytes(2, "big")))
    for which in [list(range(len(planes)))] if interleaved else [[i] for i in range(len(planes))]:
        segments += [(0xDA, bytes([len(which), *(x for i in which for x in (i + 1, 0)), 0, 63, 0])), (0, scan(which))]
    return jpeg.build(segments)
