"""Media columns: lossless WebP in numpy.

`decode` reads the public lossless format whole: prefix codes, back-references, colour cache, groups of codes, and the inverse predictor,
cross-colour, subtract-green and palette transforms. A single group of codes without colour cache is decoded by array steps: the symbol and
the next symbol's place are found for every bit at once, then the chain from the first bit is followed. All else is decoded symbol by symbol.
`encode` writes the same format: back-references from sorted windows, limited prefix codes, any of the transforms, and a colour cache.

Column operators: `store_texts` turns texts into one-sample-a-pixel images and reads them back. Rows: one per input row; a null text counts
as empty, and an empty one is stored as 576 bytes of 255. Texts longer than an image holds take several images, one after another.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

# Fixed values of the format.
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
LENGTH_CODES, DISTANCE_CODES, LITERALS = 24, 40, 256
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: Extra bits and least count of the code-length symbols that repeat.
REPEATS = {16: (2, 3), 17: (3, 3), 18: (7, 11)}
CACHE_FACTOR = 0x1E35A7BD
OPAQUE = 0xFF000000
MOST_SIDE = 1 << 14
#: Distance codes 1..120 are near pixels (columns back, rows up), nearest first, then by column distance, left before right.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
#: Longest prefix code that `encode` writes, and longest copy.
MOST_BITS, MOST_COPY = 12, 4096
#: Bytes of a stream whose bit places are decoded at once.
PIECE = 1024
EVERY_PLACE, EVERY_BIT = np.arange(8 * PIECE), np.arange(8)
#: One row of a text's image.
ROW = 576


def _reversals(bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, np.int64)
    for k in range(bits):
        out |= ((np.arange(1 << bits) >> k) & 1) << (bits - 1 - k)
    return out


REVERSED = [_reversals(k) for k in range(16)]
REVERSED_SHORT = [x.tolist() for x in REVERSED[:8]]


def run_starts(x: np.ndarray) -> np.ndarray:
    """Places where a run of equal values starts."""
    starts = np.flatnonzero(x[1:] != x[:-1])
    starts += 1
    return np.concatenate([[0], starts])


# ---- prefix codes ----


class PrefixCode:
    """Table from the next `bits` bits (first bit lowest) to 16 times the symbol plus its length."""

    def __init__(self, lengths: np.ndarray | int):
        """lengths by symbol, or the only symbol."""
        if isinstance(lengths, int):
            self.bits, self.entry = 0, np.array([lengths << 4])
            return
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.bits, self.entry = 0, used << 4 if len(used) else np.zeros(1, np.int64)
            return
        own = lengths[used]
        order = own.argsort(kind="stable")
        own = own[order].astype(np.int64)
        self.bits = int(own[-1])
        fill = 1 << (self.bits - own)
        if fill.sum() != 1 << self.bits:
            raise ValueError("a prefix code is not complete")
        self.entry = np.repeat(used[order] << 4 | own, fill)[REVERSED[self.bits]]


def short_table(lengths: list[int]) -> list[tuple[int, int]]:
    """The same for a code of few symbols of at most 7 bits, as a list of (symbol, length)."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) <= 1:
        return [(used[0][1] if used else 0, 0)]
    bits = used[-1][0]
    out, word = [(0, 0)] * (1 << bits), 0
    for n, s in used:
        if word >= 1 << bits:
            raise ValueError("a prefix code is not complete")
        out[REVERSED_SHORT[bits][word] :: 1 << n] = [(s, n)] * (1 << (bits - n))
        word += 1 << (bits - n)
    if word != 1 << bits:
        raise ValueError("a prefix code is not complete")
    return out


def limited_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code for the counts, none above `most`. One used symbol gets length 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    weight = counts[used].astype(np.int64)
    while True:
        # the two lightest are joined; joints come about in ascending order, so two queues do, and equal weights go to symbols first
        order = weight.argsort(kind="stable")
        leaf, joint, parent = weight[order].tolist(), [], [0] * (2 * n - 1)
        leaf.append(1 << 62)
        i = j = 0
        for new in range(n, 2 * n - 1):
            if j == len(joint) or leaf[i] <= joint[j]:
                first, parent[i] = leaf[i], new
                i += 1
            else:
                first, parent[n + j] = joint[j], new
                j += 1
            if j == len(joint) or leaf[i] <= joint[j]:
                joint.append(first + leaf[i])
                parent[i] = new
                i += 1
            else:
                joint.append(first + joint[j])
                parent[n + j] = new
                j += 1
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[0] <= most:  # the lightest lies deepest
            out[used[order]] = depth[:n]
            return out
        weight = weight // 2 + 1


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Code words with the first bit lowest."""
    used = np.flatnonzero(lengths)
    out = np.zeros(len(lengths), np.int64)
    if len(used) <= 1:
        return out
    order = used[np.argsort(lengths[used], kind="stable")]
    own = lengths[order]
    top = int(own.max())
    fill = 1 << (top - own)
    # a word of n bits, reversed, is the reversal over `top` bits of the word moved up
    out[order] = REVERSED[top][np.cumsum(fill) - fill]
    return out


def prefix_value(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, their count) of lengths or distances, from 1."""
    v = np.asarray(value, np.int64) - 1
    top = np.maximum(np.frexp(np.maximum(v, 1).astype(float))[1] - 1, 1)
    count = np.where(v < 4, 0, top - 1)
    second = (v >> np.maximum(top - 1, 0)) & 1
    return np.where(v < 4, v, 2 * top + second), np.where(v < 4, 0, v & ((1 << count) - 1)), count


def base_of(symbol: int) -> tuple[int, int]:
    """(least value, count of extra bits) of a length or distance symbol."""
    if symbol < 4:
        return symbol + 1, 0
    count = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << count) + 1, count


# ---- reading ----


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def ahead(self) -> int:
        """At least the next 120 bits; zeros past the end."""
        a = self.at >> 3
        if a >= len(self.data) + 8:
            raise ValueError("the stream ends early")
        return int.from_bytes(self.data[a : a + 16], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        if not n:
            return 0
        x = self.ahead() & ((1 << n) - 1)
        self.at += n
        return x

    def symbol(self, code: PrefixCode) -> int:
        if not code.bits:
            return int(code.entry[0]) >> 4
        x = int(code.entry[self.ahead() & ((1 << code.bits) - 1)])
        self.at += x & 15
        return x >> 4


def read_code(b: Bits, size: int) -> PrefixCode:
    word = b.ahead()
    if word & 1:  # one or two symbols, the first of 1 or 8 bits
        wide = 8 if word & 4 else 1
        first = (word >> 3) & ((1 << wide) - 1)
        b.at += 3 + wide + (8 if word & 2 else 0)
        if not word & 2:
            return PrefixCode(first)
        lengths = np.zeros(size, np.int64)
        lengths[[first, (word >> (3 + wide)) & 255]] = 1
        return PrefixCode(lengths)
    n = 4 + ((word >> 1) & 15)
    own, word = [0] * 19, word >> 5
    for k in CODE_LENGTH_ORDER[:n]:
        own[k] = word & 7
        word >>= 3
    table = short_table(own)
    at, left = b.at + 6 + 3 * n, size
    if word & 1:
        wide = 2 + 2 * ((word >> 1) & 7)
        left = 2 + ((word >> 4) & ((1 << wide) - 1))
        at += 3 + wide
    # a length takes at most 14 bits with its repeats: all of them stand in one number, whose low bits come next
    word, most = int.from_bytes(b.data[at >> 3 : (at >> 3) + (((at & 7) + 14 * size) >> 3) + 1], "little") >> (at & 7), 8 * (len(b.data) + 8)
    mask, found, last = len(table) - 1, [], 8
    while len(found) < size and left:
        left -= 1
        s, n = table[word & mask]
        word >>= n
        at += n
        if s < 16:
            found.append(s)
            last = s or last
            continue
        extra, least = REPEATS[s]
        n = least + (word & ((1 << extra) - 1))
        word >>= extra
        at += extra
        if len(found) + n > size:
            raise ValueError("code lengths run over")
        found += [last if s == 16 else 0] * n
    if at > most:
        raise ValueError("the stream ends early")
    b.at = at
    return PrefixCode(np.frombuffer(bytes(found), np.uint8))


def read_group(b: Bits, cache: int) -> list[PrefixCode]:
    """Green (with lengths and cache), red, blue, alpha, distance."""
    return [read_code(b, n) for n in (LITERALS + LENGTH_CODES + cache, 256, 256, 256, DISTANCE_CODES)]


def distance_of(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_image(b: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels, as one row of uint32."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups_at, group_bits, count = None, 0, 1
    if main and b.read(1):
        group_bits = b.read(3) + 2
        across = (width + (1 << group_bits) - 1) >> group_bits
        down = (height + (1 << group_bits) - 1) >> group_bits
        groups_at = ((read_image(b, across, down, False) >> np.uint32(8)) & np.uint32(0xFFFF)).reshape(down, across)
        count = int(groups_at.max()) + 1
    groups = [read_group(b, (1 << cache_bits) if cache_bits else 0) for _ in range(count)]
    if count == 1 and not cache_bits:
        return read_pixels_at_once(b, groups[0], width, height)
    return read_pixels(b, groups, groups_at, group_bits, cache_bits, width, height)


def read_pixels(b: Bits, groups, groups_at, group_bits: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    """Symbol by symbol: any groups, any cache."""
    total = width * height
    out, cache, n, cached = [0] * total, [0] * ((1 << cache_bits) if cache_bits else 1), 0, 0
    shift = 32 - cache_bits
    while n < total:
        g = groups[int(groups_at[(n // width) >> group_bits, (n % width) >> group_bits])] if groups_at is not None else groups[0]
        s = b.symbol(g[0])
        if s < LITERALS:
            r, blue, a = b.symbol(g[1]), b.symbol(g[2]), b.symbol(g[3])
            out[n] = a << 24 | r << 16 | s << 8 | blue
            n += 1
        elif s < LITERALS + LENGTH_CODES:
            low, extra = base_of(s - LITERALS)
            length = low + b.read(extra)
            low, extra = base_of(b.symbol(g[4]))
            back = distance_of(low + b.read(extra), width)
            if back > n or n + length > total:
                raise ValueError("a copy is out of the image")
            for _ in range(length):
                out[n] = out[n - back]
                n += 1
        else:
            # pixels enter the cache when a cache symbol may need them
            while cached < n:
                cache[((out[cached] * CACHE_FACTOR) & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out[n] = cache[s - LITERALS - LENGTH_CODES]
            n += 1
    return np.array(out, np.uint32)


def read_pixels_at_once(b: Bits, group: list[PrefixCode], width: int, height: int) -> np.ndarray:
    """One group, no cache: piece after piece of the stream, symbols of all bit places first, then the chain of those that count."""
    total = width * height
    if not (group[0].bits or group[1].bits or group[2].bits or group[3].bits):
        if group[0].entry[0] >= LITERALS << 4:
            raise ValueError("a copy without a pixel")
        a, r, g, blue = (int(group[k].entry[0]) >> 4 for k in (3, 1, 0, 2))
        return np.full(total, a << 24 | r << 16 | g << 8 | blue, np.uint32)  # one colour, no bits at all
    out, done = np.empty(total, np.uint32), 0
    while done < total:
        value, copies = read_piece(b, group, width, done, total - done)
        if not copies and len(value) == total:
            return value
        k = 0
        for own, length, back in copies:
            out[done : done + own - k] = value[k:own]
            done += own - k
            out[done : done + length] = out[done - back : done - back + length] if back >= length else np.resize(out[done - back : done], length)
            done, k = done + length, own + 1
        out[done : done + len(value) - k] = value[k:]
        done += len(value) - k
    return out


def read_piece(b: Bits, group: list[PrefixCode], width: int, done: int, left: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Colours of the symbols that start in the next PIECE bytes, at most `left` pixels after `done`; those that are copies: which, length, distance."""
    green, distance = group[0], group[4]
    base = b.at >> 3
    size = min(PIECE, len(b.data) - base)
    places = 8 * size
    if places <= b.at & 7:
        raise ValueError("the stream ends early")
    raw = b.data[base : base + PIECE + 24] + bytes(24)
    # from each bit place the bits that follow, 8 bytes more than symbols may start in
    window = (np.ndarray(size + 8, "<i8", raw, 0, 1)[:, None] >> EVERY_BIT).reshape(-1)
    entry = green.entry.take(window[:places] & ((1 << green.bits) - 1))
    link = np.empty(places + 1, np.int64)
    step = link[:places]
    np.bitwise_and(entry, 15, out=step)
    step += EVERY_PLACE[:places]
    colour, others = 0, []
    for code, shift in ((group[1], 16), (group[2], 0), (group[3], 24)):
        if code.bits:
            x = code.entry.take(window.take(step) & ((1 << code.bits) - 1))
            others.append((x, shift))
            step += x & 15
        else:
            colour |= int(code.entry[0]) >> 4 << shift
    # eight links of the chain at a time; past the end and at a copy the chain stands still
    np.minimum(step, places, out=step)
    step[entry >= LITERALS << 4] = places
    link[places] = places
    two = link.take(link)
    four = two.take(two)
    eight, one = memoryview(four.take(four)), memoryview(link)
    chain, copies, p, more, end = [], [], b.at & 7, left, 0
    put = chain.append
    while p < places and more > 0:
        while p < places and more > 0:
            put(p)
            p = eight[p]
            more -= 8
        if p < places:
            break
        p, more = chain[-1], more + 8
        while more > 0 and one[p] < places:
            p = one[p]
            more -= 1
        x = int(entry[p])
        if more <= 0 or x < LITERALS << 4:
            break
        at = p + (x & 15)
        word = int.from_bytes(raw[at >> 3 : (at >> 3) + 16], "little") >> (at & 7)
        low, extra = base_of((x >> 4) - LITERALS)
        length = low + (word & ((1 << extra) - 1))
        word, at = word >> extra, at + extra
        x = int(distance.entry[word & ((1 << distance.bits) - 1)])
        low, extra = base_of(x >> 4)
        word >>= x & 15
        back = distance_of(low + (word & ((1 << extra) - 1)), width)
        if back > done + left - more:
            raise ValueError("a copy is out of the image")
        if length > more:
            raise ValueError("a copy runs over the image")
        copies.append((p, length, back))
        p = end = at + (x & 15) + extra
        more -= length
    at = np.empty((len(chain), 8), np.int64)
    at[:, 0] = chain
    for k in range(1, 8):
        at[:, k] = link.take(at[:, k - 1])
    at = at.reshape(-1)
    at = at[at < places]
    at = at[: left - sum(c[1] - 1 for c in copies)]
    last = int(at[-1])
    if not copies or copies[-1][0] != last:
        end = last + (int(entry[last]) & 15) + sum(int(x[last]) & 15 for x, _ in others)
    b.at = base * 8 + end
    value = entry.take(at) >> 4 << 8
    value |= colour
    for x, shift in others:
        value |= x.take(at) >> 4 << shift
    if copies:
        copies = [(k, length, back) for k, (_, length, back) in zip(np.searchsorted(at, [c[0] for c in copies]).tolist(), copies, strict=True)]
    return value.astype(np.uint32), copies


# ---- transforms ----


def split4(x: np.ndarray) -> np.ndarray:
    """uint32 pixels to int alpha, red, green, blue."""
    return np.stack([(x >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int64)


def join4(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & np.uint32(255)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predict(mode: int, left, top, top_right, top_left):
    """The value that a predictor mode expects, by component."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([255, 0, 0, 0]), np.shape(left))
    if mode == 11:
        guess = left + top - top_left
        nearer = np.abs(guess - left).sum(-1, keepdims=True) < np.abs(guess - top).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        half = mean(left, top)
        d = half - top_left
        return np.clip(half + np.where(d < 0, -((-d) >> 1), d >> 1), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left, 5: lambda: mean(mean(left, top_right), top),
        6: lambda: mean(left, top_left), 7: lambda: mean(left, top), 8: lambda: mean(top_left, top), 9: lambda: mean(top, top_right),
        10: lambda: mean(mean(left, top_left), mean(top, top_right)),
    }[mode]()


def modes_of(image: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    """The block image's value of every pixel."""
    across = (width + (1 << bits) - 1) >> bits
    return image.reshape(-1, across)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]


def undo_predictor(pixels: np.ndarray, modes: np.ndarray, width: int, height: int) -> np.ndarray:
    """Row by row; within a row, runs of modes that need no left pixel are added at once."""
    rest = split4(pixels.reshape(height, width))
    out = np.zeros((height, width, 4), np.int64)
    out[0, 0] = (rest[0, 0] + [255, 0, 0, 0]) & 255
    if width > 1:
        out[0, 1:] = (np.cumsum(rest[0, 1:], 0) + out[0, 0]) & 255
    for y in range(1, height):
        row, up = out[y], out[y - 1]
        row[0] = (rest[y, 0] + up[0]) & 255
        starts = np.flatnonzero(np.diff(modes[y, 1:], prepend=-1)) + 1
        for x, end in zip(starts.tolist(), np.append(starts, width)[1:].tolist(), strict=True):
            mode = int(modes[y, x])
            if mode in (0, 2, 3, 4, 8, 9) or mode > 13:
                ahead = np.concatenate([up[x + 1 : end + 1], row[:1]])[: end - x]
                row[x:end] = (rest[y, x:end] + predict(mode, up[x:end], up[x:end], ahead, up[x - 1 : end - 1])) & 255
            elif mode == 1:
                row[x:end] = (np.cumsum(rest[y, x:end], 0) + row[x - 1]) & 255
            else:
                for k in range(x, end):
                    row[k] = (rest[y, k] + predict(mode, row[k - 1], up[k], up[k + 1] if k + 1 < width else row[0], up[k - 1])) & 255
    return join4(out).reshape(-1)


def do_predictor(pixels: np.ndarray, modes: np.ndarray, width: int, height: int) -> np.ndarray:
    """The residuals that undo_predictor inverts."""
    c = split4(pixels.reshape(height, width))
    guess = np.zeros_like(c)
    left, up = np.roll(c, 1, 1), np.roll(c, 1, 0)
    up_left, up_right = np.roll(up, 1, 1), np.roll(up, -1, 1)
    up_right[:, -1] = c[:, 0]
    for m in np.unique(modes):
        guess = np.where((modes == m)[..., None], predict(int(m), left, up, up_right, up_left), guess)
    guess[:, 0], guess[0] = up[:, 0], left[0]
    guess[0, 0] = [255, 0, 0, 0]
    return join4((c - guess) & 255).reshape(-1)


def signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def cross_colour(pixels: np.ndarray, blocks: np.ndarray, forward: bool) -> np.ndarray:
    """blocks: the transform element of each pixel (red: red to blue, green: green to blue, blue: green to red)."""
    c, t = split4(pixels), signed(split4(blocks.reshape(-1)))
    delta = lambda a, b: (a * signed(b)) >> 5
    sign = -1 if forward else 1
    red = (c[:, 1] + sign * delta(t[:, 3], c[:, 2])) & 255
    blue = c[:, 3] + sign * (delta(t[:, 2], c[:, 2]) + delta(t[:, 1], c[:, 1] if forward else red))
    return join4(np.stack([c[:, 0], red, c[:, 2], blue & 255], -1))


def subtract_green(pixels: np.ndarray, forward: bool) -> np.ndarray:
    green = (pixels >> np.uint32(8)) & np.uint32(255)
    both, rest = pixels & np.uint32(0xFF00FF), pixels & np.uint32(0xFF00FF00)
    moved = both + np.uint32(0x1000100) - green * np.uint32(0x10001) if forward else both + green * np.uint32(0x10001)
    return (moved & np.uint32(0xFF00FF)) | rest


def palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def undo_palette(pixels: np.ndarray, colours: np.ndarray, width: int, height: int) -> np.ndarray:
    wide = palette_bits(len(colours))
    each = 8 >> wide
    index = (pixels >> np.uint32(8)).astype(np.int64) & 255
    index = (index.reshape(height, -1, 1) >> (each * np.arange(1 << wide))) & ((1 << each) - 1)
    return np.append(colours, np.zeros(256, np.uint32))[index.reshape(height, -1)[:, :width]].reshape(-1)


def decode(data: bytes) -> np.ndarray:
    """height x width uint32 pixels (alpha, red, green, blue from the high byte). A broken file gives a ValueError."""
    try:
        return _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError("a broken file") from e


def _decode(data: bytes) -> np.ndarray:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    b = Bits(data[20 : 20 + size])
    if b.read(8) != SIGNATURE:
        raise ValueError("the signature is missing")
    width, height = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise ValueError("an unknown version")
    todo, inner = [], width
    while b.read(1):
        kind = b.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = b.read(3) + 2
            side = lambda n, k=bits: (n + (1 << k) - 1) >> k
            todo.append((kind, inner, modes_of(read_image(b, side(inner), side(height), False), bits, inner, height)))
        elif kind == PALETTE:
            n = b.read(8) + 1
            colours = join4(np.cumsum(split4(read_image(b, n, 1, False)), 0) & 255)
            todo.append((kind, inner, colours))
            inner = (inner + (1 << palette_bits(n)) - 1) >> palette_bits(n)
        else:
            todo.append((kind, inner, None))
    pixels = read_image(b, inner, height, True)
    for kind, w, extra in reversed(todo):
        if kind == PREDICTOR:
            pixels = undo_predictor(pixels, ((extra >> np.uint32(8)) & np.uint32(255)).astype(np.int64), w, height)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, extra, False)
        elif kind == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, False)
        else:
            pixels = undo_palette(pixels, extra, w, height)
    return pixels.reshape(height, width)


# ---- writing ----


class Fields:
    """(value, bits) pairs in order, packed lowest bit first. No value has more bits than said, none more than 32."""

    def __init__(self):
        self.values, self.counts, self.few, self.few_counts = [], [], [], []

    def put(self, value, bits) -> None:
        """Two arrays, or a number or list with its bits as a list or one for all."""
        if isinstance(value, np.ndarray):
            self.flush()
            self.values.append(value)
            self.counts.append(bits)
            return
        value = value if isinstance(value, list) else [value]
        self.few += value
        self.few_counts += bits if isinstance(bits, list) else [bits] * len(value)

    def flush(self) -> None:
        if self.few:
            self.values.append(np.array(self.few, np.int64))
            self.counts.append(np.array(self.few_counts, np.int64))
            self.few, self.few_counts = [], []

    def bytes(self) -> bytes:
        """Each field is added to the 32-bit word it starts in and, moved down, to the next; fields share no bit, so sums are unions."""
        self.flush()
        count, value = np.concatenate(self.counts), np.concatenate(self.values)
        ends = np.cumsum(count)
        begin = ends - count
        word = begin >> 5
        first = run_starts(word)
        begin &= 31
        value <<= begin
        sums = np.add.reduceat(value, first)
        word = word[first]
        out = np.zeros(int(word[-1]) + 3, np.uint32)
        out[word] = sums.astype(np.uint32)
        out[word + 1] += (sums >> 32).astype(np.uint32)
        return out.tobytes()[: (int(ends[-1]) + 7) // 8]


def write_only(f: Fields, symbol: int) -> None:
    """The code of one symbol, which then takes no bits."""
    f.put([1, 0, int(symbol > 1), symbol], [1, 1, 1, 8 if symbol > 1 else 1])


def write_code(f: Fields, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        write_only(f, int(used[0]) if len(used) else 0)
        return
    tokens, extras, counts, held = [], [], [], [0] * 19
    edge = run_starts(lengths)
    edges = [*edge.tolist(), len(lengths)]
    for i, v in enumerate(lengths[edge].tolist()):
        n = edges[i + 1] - edges[i]
        while n:
            if v == 0 and n >= 3:
                k = min(n, 138)
                t = (17, k - 3, 3) if k < 11 else (18, k - 11, 7)
            elif v and n >= 4 and tokens and tokens[-1] == v:
                k = min(n, 6)
                t = (16, k - 3, 2)
            else:
                k, t = 1, (v, 0, 0)
            tokens.append(t[0])
            extras.append(t[1])
            counts.append(t[2])
            held[t[0]] += 1
            n -= k
    code = limited_lengths(np.array(held), 7)
    words, own = code_words(code).tolist(), code.tolist()
    n = max(4, 1 + max(k for k, s in enumerate(CODE_LENGTH_ORDER) if own[s]))
    f.put([0, n - 4], [1, 4])
    f.put([own[s] for s in CODE_LENGTH_ORDER[:n]], 3)
    f.put(0, 1)
    if sum(map(bool, held)) == 1:
        own = [0] * 19
    f.put([x for t, e in zip(tokens, extras, strict=True) for x in (words[t], e)], [x for t, e in zip(tokens, counts, strict=True) for x in (own[t], e)])


def write_counts(f: Fields, counts: np.ndarray) -> np.ndarray | None:
    """Writes a prefix code for the counts. By symbol, 64 times its word plus its length; None if no symbol takes bits."""
    own = limited_lengths(counts, MOST_BITS)
    write_code(f, own)
    return code_words(own) << 6 | own if np.count_nonzero(own) > 1 else None


def find_copies(key: np.ndarray, least: int = 16, window: int = 8) -> list[tuple[int, int, int]]:
    """(start, length, distance) of repeats, apart from each other: runs of places whose window last occurred equally far back."""
    n = len(key)
    if n < 2 * window:
        return []
    if key.dtype == np.uint8 and window == 8:
        x = np.ndarray(n - 7, "<u8", key, 0, 1) * np.uint64(0x9E3779B97F4A7C15)
    else:
        x, step = key.astype(np.uint64), 1
        while step < window:  # hashes of 1, 2, 4 and 8 places
            x = x[:-step] * np.uint64(0x100000001B3 + 2 * step) + x[step:]
            step *= 2
        x *= np.uint64(0x9E3779B97F4A7C15)
    # hash above, place below: one plain sort; equal hashes of different windows are found out below
    bits = max(1, (len(x) - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    x &= ~low
    x |= np.arange(len(x), dtype=np.uint64)
    x.sort()
    same = np.flatnonzero((x[1:] ^ x[:-1]) <= low)
    if not len(same):
        return []
    place, before = (x[same + 1] & low).astype(np.int64), (x[same] & low).astype(np.int64)
    order = place.argsort()
    place = place[order]
    back = place - before[order]
    edge = np.concatenate([[0], np.flatnonzero((place[1:] - place[:-1] != 1) | (back[1:] != back[:-1])) + 1])
    length = np.append(edge[1:], len(place)) - edge + (window - 1)
    start, back = place[edge], back[edge]
    keep = (length >= least) & (back < (1 << 20) - 120)
    start, end, back = start[keep], start[keep] + length[keep], back[keep]
    if not len(start):
        return []
    start = np.maximum(start, np.concatenate([[0], np.maximum.accumulate(end)[:-1]]))
    out = []
    for a, e, d in zip(start.tolist(), end.tolist(), back.tolist(), strict=True):
        if e - a >= 4 and (key[a:e] == key[a - d : e - d]).all():
            while a < e:
                m = min(MOST_COPY, e - a)
                out.append((a, m, d))
                a += m
    return out


def write_image(f: Fields, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0) -> None:
    n = len(pixels)
    rest = pixels & np.uint32(0xFFFF00FF)
    plain_green = bool((rest == rest[0]).all())  # grey after subtract-green, palettes, block images
    green = (pixels >> np.uint32(8)).astype(np.uint8)
    copies = find_copies(green if plain_green else pixels)
    at, own = None, pixels
    if copies or cache_bits:
        literal = np.ones(n, bool)
        for a, m, _ in copies:
            literal[a : a + m] = False
        at = np.flatnonzero(literal)
        green, own = green[at], pixels[at]
    green = green.astype(np.int64)
    f.put(int(cache_bits > 0), 1)
    cached = np.zeros(len(green), bool)
    if cache_bits:
        f.put(cache_bits, 4)
        place = ((pixels.astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - cache_bits)
        cache, lit = {}, dict(zip(at.tolist(), range(len(at)), strict=True))
        for i in range(n):
            k, v = int(place[i]), int(pixels[i])
            if i in lit and cache.get(k, 0) == v:
                cached[lit[i]], green[lit[i]] = True, LITERALS + LENGTH_CODES + k
            cache[k] = v
    if main:
        f.put(0, 1)
    count = np.bincount(green, minlength=LITERALS + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0))
    if copies:
        cp = np.array(copies, np.int64)
        len_sym, len_extra, len_bits = prefix_value(cp[:, 1])
        dist_sym, dist_extra, dist_bits = prefix_value(cp[:, 2] + 120)
        count += np.bincount(LITERALS + len_sym, minlength=len(count))
    code = write_counts(f, count)
    # by literal, a row of what its components take: 64 times the word plus its length
    parts = [] if code is None else [code[green]]
    if plain_green:
        for shift in (16, 0, 24):
            write_only(f, (int(rest[0]) >> shift) & 255 if not cached.all() else 0)
    else:
        for c in split4(own)[:, [1, 3, 0]].T:
            other = write_counts(f, np.bincount(c[~cached], minlength=256))
            if other is not None:
                parts.append(other[c] * ~cached)
    fields = parts[0] if len(parts) == 1 else np.stack(parts, 1).reshape(-1) if parts else np.zeros(0, np.int64)
    if not copies:
        write_only(f, 0)
    else:
        far = write_counts(f, np.bincount(dist_sym, minlength=DISTANCE_CODES))
        pairs = np.empty((len(cp), 2), np.int64)
        for k, (x, extra, bits) in enumerate(((0 if code is None else code[LITERALS + len_sym], len_extra, len_bits), (0 if far is None else far[dist_sym], dist_extra, dist_bits))):
            pairs[:, k] = ((x >> 6) | extra << (x & 63)) << 6 | (x & 63) + bits
        # literals before each copy
        cut = (len(parts) * (cp[:, 0] - np.cumsum(cp[:, 1]) + cp[:, 1])).tolist()
        runs = [fields[: cut[0]]]
        for pair, a, e in zip(pairs, cut, [*cut[1:], len(fields)], strict=True):
            runs += [pair, fields[a:e]]
        fields = np.concatenate(runs)
    f.put(fields >> 6, fields & 63)


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (SUBTRACT_GREEN,), cache_bits: int = 0, block_bits: int = 3, modes: np.ndarray | None = None, elements: np.ndarray | None = None) -> bytes:
    """A lossless WebP file of height x width uint32 pixels. modes and elements: block images of the predictor and cross-colour transforms."""
    height, width = pixels.shape
    f = Fields()
    f.put([SIGNATURE, width - 1, height - 1, int(bool((pixels >> np.uint32(24) != 255).any())), 0], [8, 14, 14, 1, 3])
    x, inner = pixels.reshape(-1).astype(np.uint32), width
    for kind in transforms:
        f.put([1, kind], [1, 2])
        side = lambda n: (n + (1 << block_bits) - 1) >> block_bits
        blocks = side(inner) * side(height)
        if kind == PREDICTOR:
            own = np.resize(np.array([11]) if modes is None else modes, blocks).astype(np.int64)
            f.put(block_bits - 2, 3)
            image = (np.uint32(OPAQUE) | (own.astype(np.uint32) << np.uint32(8))).astype(np.uint32)
            write_image(f, image, side(inner), False)
            x = do_predictor(x, modes_of(own, block_bits, inner, height), inner, height)
        elif kind == CROSS_COLOUR:
            own = np.resize(np.array([OPAQUE | 0x081008], np.uint32) if elements is None else elements, blocks).astype(np.uint32)
            f.put(block_bits - 2, 3)
            write_image(f, own, side(inner), False)
            x = cross_colour(x, modes_of(own, block_bits, inner, height), True)
        elif kind == SUBTRACT_GREEN:
            x = subtract_green(x, True)
        else:
            colours, index = np.unique(x, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("a palette holds 256 colours")
            f.put(len(colours) - 1, 8)
            parts = split4(colours)
            write_image(f, join4(np.diff(parts, axis=0, prepend=np.zeros((1, 4), np.int64)) & 255), len(colours), False)
            wide = palette_bits(len(colours))
            each = 8 >> wide
            grid = index.reshape(height, inner)
            inner = (inner + (1 << wide) - 1) >> wide
            grid = np.pad(grid, ((0, 0), (0, (inner << wide) - grid.shape[1]))).reshape(height, inner, 1 << wide)
            x = (np.uint32(OPAQUE) | ((grid << (each * np.arange(1 << wide))).sum(-1).astype(np.uint32) << np.uint32(8))).reshape(-1)
    f.put(0, 1)
    write_image(f, x, inner, True, cache_bits)
    body = f.bytes()
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


# ---- texts as images ----


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * ((-len(text)) % ROW or (0 if text else ROW))


def transforms_for(grey: np.ndarray) -> tuple[int, ...]:
    """Up to 16 different bytes: a palette. Else green is taken from red and blue, and where the differences of neighbouring bytes ask
    for fewer bits than the bytes themselves, each byte is predicted by the one before it."""
    flat = grey.reshape(-1)
    count = np.bincount(flat, minlength=256)
    if np.count_nonzero(count) <= 16:
        return (PALETTE,)
    step = np.bincount(flat[1:] - flat[:-1], minlength=256)
    bits = [-float((c * np.log2(c / c.sum())).sum()) for c in (count[count > 0], step[step > 0])]
    return (PREDICTOR, SUBTRACT_GREEN) if bits[1] < bits[0] else (SUBTRACT_GREEN,)


def store(payload: bytes) -> bytes:
    """Grey pixels, one byte a pixel, ROW pixels a row."""
    out = []
    for a in range(0, len(payload), ROW * MOST_SIDE):
        grey = np.frombuffer(payload[a : a + ROW * MOST_SIDE], np.uint8).reshape(-1, ROW)
        pixels = np.uint32(OPAQUE) | grey.astype(np.uint32) * np.uint32(0x010101)
        out.append(encode(pixels, transforms_for(grey), block_bits=9, modes=np.array([1])))
    return b"".join(out)


def load(media: bytes) -> list[np.ndarray]:
    """Pixel arrays of the images that stand one after another."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append(decode(media[at : at + size]))
        at += size
    return out


def samples(images: list[np.ndarray]) -> bytes:
    return b"".join(x.astype(np.uint8).tobytes() for x in images)


def feature(images: list[np.ndarray]) -> str:
    """Size, mean, deviation, entropy and row contrast of the pixels read back."""
    grey = np.concatenate([x.astype(np.uint8) for x in images])
    count = np.bincount(grey.reshape(-1), minlength=256)
    share = count[count > 0] / grey.size
    value = np.arange(256)
    mean = float((count * value).sum() / grey.size)
    std = float((count * (value - mean) ** 2).sum() / grey.size) ** 0.5
    step = float(np.abs(np.diff(grey.astype(np.int16), axis=1)).sum(dtype=np.int64) / (grey.size - len(grey)))
    return f"h={grey.shape[0]};w={grey.shape[1]};mean={mean:.4f};std={std:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};step={step:.4f}"


FIELDS = "media binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """id_col, the stored media (unless keep_media is false) and what is read back from it."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for a in range(0, len(df), 256):
                part = df.iloc[a : a + 256]
                rows = []
                for t in part["text"]:
                    text = utf8(t)
                    media = store(payload_of(text))
                    images = load(media)
                    back = samples(images)
                    rows.append((media if keep_media else None, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(images)))
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in FIELDS.split(", ")])
                out.insert(0, "id", part["id"].to_numpy())
                yield out

    out = base.mapInPandas(run, f"id {dict(base.dtypes)['id']}, {FIELDS}").withColumnRenamed("id", id_col)
    return out if keep_media else out.drop("media")
