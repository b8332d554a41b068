"""Range maps between full and limited samples, and stored signed values."""

from __future__ import annotations

from .sql import clip

#: Limited ranges by depth: luma and chroma.
LIMITS = {8: {"luma": (16, 235), "chroma": (16, 240)}, 10: {"luma": (64, 940), "chroma": (64, 960)}}


def full_to_limited(d, x: str, top: int) -> str:
    """0..255 to 16..top (235 or 240), cut; outside, the ends."""
    return f"case when {x} <= 0 then 16 when {x} >= 255 then {top} else {d.trunc(f'{d.num((top - 16) / 255)} * {x} + {d.num(16.0)}')} end"


def limited_to_full(d, x: str, top: int, compat: bool = True) -> str:
    """16..top to 0..255, cut. compat: what is at or outside the limits stays at them; else it becomes 0 or 255."""
    a = 255 / (top - 16)
    low, high = (16, top) if compat else (0, 255)
    return f"case when {x} <= 16 then {low} when {x} >= {top} then {high} else {d.trunc(f'{d.num(a)} * {x} + {d.num(-a * 16)}')} end"


def rescale(d, x: str, source: tuple[int, int], target: tuple[int, int]) -> tuple[str, str]:
    """(value, whether it was out of the target): the linear map, rounded half to even, then clipped."""
    a = (target[1] - target[0]) / (source[1] - source[0])
    raw = d.even(f"{d.num(a)} * {x} + {d.num(target[0] - a * source[0])}")
    return f"cast({clip(raw, target[0], target[1])} as int)", f"({raw} < {target[0]} or {raw} > {target[1]})"


def rescale_clipped(d, x: str, source: tuple[int, int], target: tuple[int, int], bounds: tuple[int, int]) -> str:
    """The linear map, clipped to the bounds, then rounded half to even."""
    a = (target[1] - target[0]) / (source[1] - source[0])
    return f"cast({d.even(clip(f'(({x} - {source[0]}) * {d.num(a)} + {target[0]})', d.num(float(bounds[0])), d.num(float(bounds[1]))))} as int)"


def ends(depth: int, kind: str, limited: bool) -> tuple[int, int]:
    return LIMITS[depth][kind] if limited else (0, (1 << depth) - 1)


def store_signed(d, x: str, depth: int) -> str:
    """A difference of two samples as a sample: halved, around the middle."""
    return f"({d.shr(x, 1)} + {1 << (depth - 1)})"


def load_signed(x: str, depth: int) -> str:
    return f"(({x} - {1 << (depth - 1)}) * 2)"
