"""Array kernels on planes, for Arrow functions: all take arrays of ints whose last two axes are rows and columns, so that many small images, or one
large one, go through at once. They work inside tasks; Spark deals out the images (representations.py) or their tiles (tiles.py).

Arithmetic is signed. Formulas are written here once more, in numpy, beside the SQL of `functions`, which checks them.
"""

from __future__ import annotations

import numpy as np

from ..functions.formats import Format
from ..functions.packing import CODECS, UNSUPPORTED

Planes = dict[str, np.ndarray]
AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def ring(v: np.ndarray, n: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A plane with n more rows and columns on each side, edges repeated, and the row and column each place was taken from."""
    h, w = v.shape[-2:]
    ys, xs = np.clip(np.arange(-n, h + n), 0, h - 1), np.clip(np.arange(-n, w + n), 0, w - 1)
    return v[..., ys[:, None], xs], ys, xs


def demosaic_block(ext: np.ndarray, ys: np.ndarray, xs: np.ndarray, order: str, adaptive: bool = False) -> Planes:
    """r, g, b of the places inside a ring of one sample; ys and xs are the places of the image that rows and columns come from.

    Missing samples are the mean of those of their colour among the 8 neighbours, cut. adaptive: green is the mean along the smaller gradient.
    """
    h, w = ext.shape[-2] - 2, ext.shape[-1] - 2
    inside = lambda a, dy=0, dx=0: a[..., 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    cell, own, out = (ys[:, None] % 2) * 2 + xs[None, :] % 2, ext[..., 1:-1, 1:-1], {}
    for c in "rgb":
        mask = np.isin(cell, [k for k, o in enumerate(order) if o.lower() == c])
        masked, ones = np.where(mask, ext, 0), mask.astype(ext.dtype)
        mean = lambda places, v=masked, n=ones: sum(inside(v, *p) for p in places) // np.maximum(1, sum(inside(n, *p) for p in places))
        if c == "g" and adaptive:
            left, right, above, below = (0, -1), (0, 1), (-1, 0), (1, 0)
            across, along = np.abs(inside(masked, *left) - inside(masked, *right)), np.abs(inside(masked, *above) - inside(masked, *below))
            fill = np.where(across < along, mean((left, right)), np.where(across > along, mean((above, below)), mean((left, right, above, below))))
        else:
            fill = mean(AROUND)
        out[c] = np.where(inside(mask), own, fill)
    return out


def demosaic(mosaic: np.ndarray, order: str, adaptive: bool = False) -> Planes:
    return demosaic_block(*ring(mosaic), order, adaptive)


def demosaic_inner_block(ext: np.ndarray, ys: np.ndarray, xs: np.ndarray, order: str) -> Planes:
    """By rounded means; for places that have all their neighbours."""
    h, w = ext.shape[-2] - 2, ext.shape[-1] - 2
    cell, out = (ys[:, None] % 2) * 2 + xs[None, :] % 2, {}
    for c in "rgb":
        mask = np.isin(cell, [k for k, o in enumerate(order) if o.lower() == c])
        masked = np.where(mask, ext, 0)
        total = sum(masked[..., 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in AROUND)
        n = sum(mask[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w].astype(ext.dtype) for dy, dx in AROUND)
        out[c] = np.where(mask[1:-1, 1:-1], ext[..., 1:-1, 1:-1], (total + n // 2) // np.maximum(1, n))
    return out


def demosaic_inner(mosaic: np.ndarray, order: str) -> Planes:
    """As demosaic_inner_block; the outermost pixels copy the one beside them inside. At least 3 x 3."""
    h, w = mosaic.shape[-2:]
    inner = demosaic_inner_block(mosaic, np.arange(h), np.arange(w), order)
    return {k: ring(v)[0] for k, v in inner.items()}


def remosaic(rgb: Planes, order: str) -> np.ndarray:
    out = np.empty_like(rgb["r"])
    for k, c in enumerate(order):
        out[..., k // 2 :: 2, k % 2 :: 2] = rgb[c.lower()][..., k // 2 :: 2, k % 2 :: 2]
    return out


def split(mosaic: np.ndarray, order: str) -> Planes:
    return {c: mosaic[..., k // 2 :: 2, k % 2 :: 2] for k, c in enumerate(order)}


def merge(planes: Planes, order: str) -> np.ndarray:
    first = planes[order[0]]
    out = np.empty((*first.shape[:-2], 2 * first.shape[-2], 2 * first.shape[-1]), first.dtype)
    for k, c in enumerate(order):
        out[..., k // 2 :: 2, k % 2 :: 2] = planes[c]
    return out


def to_differences(p: Planes, depth: int) -> Planes:
    """R, G, g, B to luma Y and the differences D (greens), C (red and blue) and c (green and the others), halved around the middle."""
    half, r, g1, g2, b = 1 << depth - 1, p["R"], p["G"], p["g"], p["B"]
    store = lambda x: (x >> 1) + half
    return {"Y": (r >> 2) + (g1 >> 2) + (g2 >> 2) + (b >> 2), "D": store(g2 - g1), "C": store(r - b), "c": store((g1 >> 1) + (g2 >> 1) - (r >> 1) - (b >> 1))}


def from_differences(p: Planes, depth: int) -> Planes:
    half, top, y = 1 << depth - 1, (1 << depth) - 1, p["Y"]
    d, orange, green = (2 * (p[k] - half) for k in "DCc")
    out = {"R": y - (green >> 1) + (orange >> 1), "G": y - (d >> 1) + (green >> 1), "g": y + (d >> 1) + (green >> 1), "B": y - (green >> 1) - (orange >> 1)}
    return {k: np.clip(v, 0, top) for k, v in out.items()}


def _deep(depth: int) -> tuple[int, int, int]:
    """(bits to scale up by, largest value, middle): 10 to 14 bits are computed at 16."""
    up = 0 if depth in (8, 16) else 16 - depth
    return up, (1 << depth + up) - 1, 1 << depth + up - 1


def to_yuv(p: Planes, depth: int) -> Planes:
    """Rounded luma; chroma from the rounded luma."""
    up, top, off = _deep(depth)
    r, g, b = (p[k].astype(np.int64) << up for k in "rgb")
    y = np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).astype(np.int64)
    u, v = (np.clip(np.floor((x - y) * f + off + 0.5).astype(np.int64), 0, top) for x, f in ((b, 0.492), (r, 0.877)))
    return {k: (x >> up).astype(p["r"].dtype) for k, x in zip("yuv", (y, u, v), strict=True)}


def to_rgb(p: Planes, depth: int) -> Planes:
    up, top, off = _deep(depth)
    y, u, v = (p[k].astype(np.int64) << up for k in "yuv")
    parts = (y + 1.14 * (v - off), y - 0.395 * (u - off) - 0.581 * (v - off), y + 2.032 * (u - off))
    return {k: (np.clip(np.floor(x + 0.5).astype(np.int64), 0, top) >> up).astype(p["y"].dtype) for k, x in zip("rgb", parts, strict=True)}


def subsample(v: np.ndarray, kind: str) -> np.ndarray:
    """Mean of 2 x 2 (420) or 1 x 2 (422) samples, edges repeated, cut."""
    if kind == "444":
        return v
    h, w = v.shape[-2:]
    ys, xs = np.minimum(np.arange(h + h % 2), h - 1), np.minimum(np.arange(w + w % 2), w - 1)
    v = v[..., xs]
    v = v[..., 0::2] + v[..., 1::2]
    if kind == "422":
        return v // 2
    v = v[..., ys, :]
    return (v[..., 0::2, :] + v[..., 1::2, :]) // 4


def upsample(v: np.ndarray, kind: str, h: int, w: int) -> np.ndarray:
    """Each sample for the places it covers, cut to h x w."""
    if kind == "444":
        return v
    v = v.repeat(2, -1)
    return (v.repeat(2, -2) if kind == "420" else v)[..., :h, :w]


def shift_depth(planes: Planes, source: int, target: int) -> Planes:
    return {k: v << target - source if target >= source else v >> source - target for k, v in planes.items()}


# ---- buffers ----


def read_samples(raw: np.ndarray, codec: str) -> np.ndarray:
    """Samples of packed bytes; the last axis holds bytes, then samples."""
    if codec in UNSUPPORTED:
        raise NotImplementedError(f"samples packed as {codec} cannot be read")
    c = CODECS[codec]
    if c.depth == 8:
        return raw.astype(np.int32)
    b = raw.reshape(*raw.shape[:-1], -1, c.n_bytes).astype(np.int64)
    if ".packed" in codec:
        k = c.depth - 8
        rest = sum(b[..., c.n_samples + i] << 8 * i for i in range(c.n_bytes - c.n_samples))
        out = np.stack([b[..., i] << k | rest >> k * i & (1 << k) - 1 for i in range(c.n_samples)], -1)
    else:
        low, high = (1, 0) if codec == "16be" else (0, 1)
        out = b[..., low::2] | (b[..., high::2] & (1 << c.depth - 8) - 1) << 8
    return out.reshape(*raw.shape[:-1], -1).astype(np.int32)


def write_samples(v: np.ndarray, codec: str) -> np.ndarray:
    if codec in UNSUPPORTED:
        raise NotImplementedError(f"samples packed as {codec} cannot be written")
    c = CODECS[codec]
    if c.depth == 8:
        return v.astype(np.uint8)
    s = v.reshape(*v.shape[:-1], -1, c.n_samples).astype(np.int64)
    if ".packed" in codec:
        k = c.depth - 8
        rest = sum((s[..., i] & (1 << k) - 1) << k * i for i in range(c.n_samples))
        out = np.concatenate([s >> k, np.stack([rest >> 8 * i & 255 for i in range(c.n_bytes - c.n_samples)], -1)], -1)
    else:
        low, high = s & 255, s >> 8 & (1 << c.depth - 8) - 1
        out = np.stack([high, low] if codec == "16be" else [low, high], -1)
    return out.astype(np.uint8).reshape(*v.shape[:-1], -1)


def plane_shapes(f: Format, w: int, h: int) -> dict[str, tuple[int, int]]:
    """Rows and columns of each plane of a format, in order."""
    if f.component in ("bayer", "ydgcocg"):
        cell = 4 if f.subsample == "420" else 2
        if h % cell or w % cell:
            raise ValueError(f"{f.name}: sides of {w} x {h} are no multiples of {cell}")
        small = {c: (h // 4, w // 4) for c in "Cc"} if f.subsample == "420" else {}
        return {c: (h // 2, w // 2) for c in f.order} | small
    if f.component == "yuv" and f.subsample != "444":
        chroma = ((h + 1) // 2 if f.subsample == "420" else h, (w + 1) // 2)
        return {"y": (h, w), "u": chroma, "v": chroma}
    return {c: (h, w) for c in f.order}


def _planar(f: Format) -> str:
    return "8" if f.depth == 8 else "16le"


def read_buffer(raw: np.ndarray, f: Format, w: int, h: int) -> Planes:
    """raw: images x bytes. The planes of a format, images first."""
    shapes = plane_shapes(f, w, h)
    if f.layout == "packed":
        return split(read_samples(raw, f.codec).reshape(-1, h, w), f.order)
    s, at, out = read_samples(raw, _planar(f)), 0, {}
    beside = "Cc" if f.component == "ydgcocg" and f.subsample == "420" else ""
    for c, (ph, pw) in shapes.items():
        if c in beside:
            continue
        out[c] = s[:, at : at + ph * pw].reshape(-1, ph, pw)
        at += ph * pw
    if beside:
        ph, pw = shapes["C"]
        both = s[:, at : at + 2 * ph * pw].reshape(-1, ph, 2 * pw)
        out |= {"C": both[..., :pw], "c": both[..., pw:]}
    return {c: out[c] for c in f.order}


def write_buffer(planes: Planes, f: Format) -> np.ndarray:
    if f.layout == "packed":
        v = merge(planes, f.order)
        return write_samples(v.reshape(len(v), -1), f.codec)
    parts = [planes[c] for c in f.order]
    if f.component == "ydgcocg" and f.subsample == "420":
        parts = [planes["Y"], planes["D"], np.concatenate([planes["C"], planes["c"]], -1)]
    return write_samples(np.concatenate([p.reshape(len(p), -1) for p in parts], -1), _planar(f))


# ---- windows ----


def window_sums(v: np.ndarray, m: int, k: int) -> np.ndarray:
    """Sums of all m x k windows, by a summed-area table."""
    s = np.zeros((*v.shape[:-2], v.shape[-2] + 1, v.shape[-1] + 1), np.int64)
    s[..., 1:, 1:] = v.astype(np.int64).cumsum(-2).cumsum(-1)
    return s[..., m:, k:] - s[..., :-m, k:] - s[..., m:, :-k] + s[..., :-m, :-k]


def products(v: np.ndarray, needle: np.ndarray) -> np.ndarray:
    """Sums of products of a needle with the window at each place, exactly: by Fourier transforms of bytes, whose rounding errors stay far below a half."""
    m, k = needle.shape
    shape = [1 << int(n - 1).bit_length() for n in v.shape]
    turned = np.fft.rfft2(needle[::-1, ::-1].astype(np.float64), shape)
    out = np.zeros((v.shape[0] - m + 1, v.shape[1] - k + 1), np.int64)
    for shift in (0, 8) if v.max(initial=0) > 255 else (0,):
        part = np.fft.irfft2(np.fft.rfft2((v >> shift & 255).astype(np.float64), shape) * turned, shape)
        out += np.rint(part[m - 1 : v.shape[0], k - 1 : v.shape[1]]).astype(np.int64) << shift
    return out


def correlation(v: np.ndarray, needle: np.ndarray) -> np.ndarray:
    """Normalised correlation, means removed, of a needle with the window at each place where it fits; 0 where either is flat. Nine places."""
    m, k = needle.shape
    n, t, v = m * k, needle.astype(np.int64), v.astype(np.int64)
    si, sii, sti = window_sums(v, m, k), window_sums(v * v, m, k), products(v, t)
    own = float(n * int((t * t).sum()) - int(t.sum()) ** 2)
    var = own * (n * sii - si * si).astype(np.float64)
    return np.round(np.where(var > 0, (n * sti - int(t.sum()) * si) / np.sqrt(np.where(var > 0, var, 1)), 0.0), 9)


def best_place(v: np.ndarray, needle: np.ndarray) -> tuple[int, int, float]:
    """(y, x, score) of the best correlation; the topmost, then leftmost, of equals. The products there are counted again one by one."""
    scores = correlation(v, needle)
    y, x = divmod(int(scores.argmax()), scores.shape[1])
    m, k = needle.shape
    if int((v[y : y + m, x : x + k].astype(np.int64) * needle).sum()) != products(v[y : y + m, x : x + k], needle)[0, 0]:
        raise ArithmeticError("a product was rounded wrongly")
    return y, x, float(scores[y, x])


def gaussian(size: int, sigma: float = 1.5) -> np.ndarray:
    x = np.arange(size) - (size - 1) / 2
    g = np.exp(-(x * x) / (2 * sigma * sigma))
    return g / g.sum()


def similarity(a: np.ndarray, b: np.ndarray, top: int, size: int = 11, sigma: float = 1.5) -> np.ndarray:
    """Structural similarity of the window at each place where it fits, with Gaussian weights (Wang et al. 2004)."""
    g = gaussian(size, sigma)

    def smooth(v: np.ndarray) -> np.ndarray:
        rows = sum(g[i] * v[..., i : v.shape[-2] - size + 1 + i, :] for i in range(size))
        return sum(g[i] * rows[..., i : v.shape[-1] - size + 1 + i] for i in range(size))

    a, b = a.astype(np.float64), b.astype(np.float64)
    ma, mb = smooth(a), smooth(b)
    va, vb, cov = smooth(a * a) - ma * ma, smooth(b * b) - mb * mb, smooth(a * b) - ma * mb
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def warp(v: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Each place read bilinearly where the 2 x 3 inverse takes it, 0 outside, rounded half to even."""
    h, w = v.shape[-2:]
    y, x = np.mgrid[:h, :w].astype(np.float64)
    (a, b, c), (d, e, f) = np.asarray(inverse).tolist()
    sx, sy = a * x + b * y + c, d * x + e * y + f
    fx, fy = np.floor(sx), np.floor(sy)
    ax, ay, out = sx - fx, sy - fy, 0.0
    for dy in (0, 1):
        for dx in (0, 1):
            px, py = fx.astype(np.int64) + dx, fy.astype(np.int64) + dy
            inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
            near = np.where(inside, v[..., np.clip(py, 0, h - 1), np.clip(px, 0, w - 1)], 0)
            out = out + near * (ax if dx else 1 - ax) * (ay if dy else 1 - ay)
    return np.rint(out).astype(np.int32)
