"""Sample packing: byte groups to samples and back, as integer SQL over the bytes b0, b1, ... of a group or its samples c0, c1, ..."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Codec:
    depth: int
    n_bytes: int
    n_samples: int

    def unpack(self, d, b: list[str]) -> list[str]:
        raise NotImplementedError

    def pack(self, d, c: list[str]) -> list[str]:
        raise NotImplementedError


@dataclass(frozen=True)
class Plain(Codec):
    """One byte a sample."""

    def unpack(self, d, b):
        return list(b)

    def pack(self, d, c):
        return [f"({x} & 255)" for x in c]


@dataclass(frozen=True)
class Wide(Codec):
    """Two bytes a sample; bits above the depth are dropped."""

    big: bool = False

    def unpack(self, d, b):
        mask = (1 << (self.depth - 8)) - 1
        pairs = [(b[i + 1], b[i]) if self.big else (b[i], b[i + 1]) for i in range(0, len(b), 2)]
        return [f"({low} | (({high} & {mask}) * 256))" for low, high in pairs]

    def pack(self, d, c):
        mask = (1 << (self.depth - 8)) - 1
        out = []
        for x in c:
            low, high = f"({x} & 255)", f"({d.shr(x, 8)} & {mask})"
            out += [high, low] if self.big else [low, high]
        return out


@dataclass(frozen=True)
class Packed(Codec):
    """High bits of each sample in a byte of its own, then bytes that hold the low bits, first sample lowest."""

    @property
    def low_bits(self) -> int:
        return self.depth - 8

    def unpack(self, d, b):
        n, k = self.n_samples, self.low_bits
        rest = "(" + " | ".join(f"({x} * {1 << (8 * i)})" for i, x in enumerate(b[n:])) + ")"
        return [f"(({b[i]} * {1 << k}) | ({d.shr(rest, k * i)} & {(1 << k) - 1}))" for i in range(n)]

    def pack(self, d, c):
        k = self.low_bits
        rest = "(" + " | ".join(f"(({x} & {(1 << k) - 1}) * {1 << (k * i)})" for i, x in enumerate(c)) + ")"
        return [f"({d.shr(x, k)} & 255)" for x in c] + [f"({d.shr(rest, 8 * i)} & 255)" for i in range(self.n_bytes - self.n_samples)]


CODECS: dict[str, Codec] = {
    "8": Plain(8, 2, 2), "10": Wide(10, 4, 2), "10.packed": Packed(10, 5, 4), "12": Wide(12, 4, 2), "12.packed": Packed(12, 3, 2), "14": Wide(14, 4, 2),
    "14.packed": Packed(14, 7, 4), "16le": Wide(16, 4, 2), "16be": Wide(16, 4, 2, big=True),
}
UNSUPPORTED = ("10.alaw", "10.dpcm", "10.ipu3")


def codec(name: str) -> Codec:
    if name in UNSUPPORTED:
        raise NotImplementedError(f"samples packed as {name} cannot be read")
    return CODECS[name]
