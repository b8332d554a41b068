"""SentencePiece encoding by forward filtering and backward sampling; lossless decoding.

A text with a blank put before it, blanks written as the marker U+2581, is cut where no piece can cross: before each run of markers. In the
lattice of a segment's pieces, forward sums of weights are kept at every place; going back from the end, a piece is drawn in proportion to
what the forward sums say of it, which samples a segmentation in proportion to the product of its pieces' weights. A piece of rank r weighs
(r + 8) ** -alpha. Draws are a hash of the row's key, the segment's number and the step, so a row always gets the same pieces, wherever it
runs. Characters without a piece become their UTF-8 bytes' pieces, also a marker that stands in the text itself, so that decoding gives back
every byte. Forward sums of a segment are kept by each worker for the next rows; the store has a bound and starts anew when full.

Rows: one per input row. Null and empty texts have no pieces. Null keys share one seed; repeated rows get equal pieces. Texts are encoded
whole, whatever their length. Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, mix64, release_memory, utf8

MARK = "▁"
#: Stands for a marker of the text itself; no valid text holds a lone surrogate.
OWN_MARK = "\udc81"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Edges of the segments that a worker remembers.
MOST_EDGES = 2_500_000
#: Characters sampled at once.
BLOCK = 1 << 18
#: Steps of a share between 0 and 1.
GRID = float(1 << 24)


@dataclass
class Vocabulary:
    pieces: dict[str, tuple[int, float]]  # of usable pieces: id and weight; of their prefixes: (-1, 0)
    bytes_: list[int]  # id of each byte's piece
    text: list[bytes]  # what each id decodes to
    cuts: bool  # whether segments may be cut before markers

    @staticmethod
    def load(path: str = MODEL, alpha: float = 1.0) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, bytes_, text = {}, [0] * 256, []
        plain = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-m.get_score(i), i)))}
        cuts = True
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if i in rank:
                cuts &= MARK not in p.lstrip(MARK)
                pieces[p] = (i, float(rank[i] + 8) ** -alpha)
                text.append(p.replace(MARK, " ").encode())
            elif m.is_byte(i):
                bytes_[int(p[3:5], 16)] = i
                text.append(bytes([int(p[3:5], 16)]))
            else:
                text.append(b"")
        for p in list(pieces):
            for k in range(1, len(p)):
                pieces.setdefault(p[:k], (-1, 0.0))
        return Vocabulary(pieces, bytes_, text, cuts)


def raw_char(c: str) -> bytes:
    return MARK.encode() if c == OWN_MARK else c.encode("utf-8", "surrogatepass")


def string_keys(chars: np.ndarray, start: np.ndarray, length: int, before: np.ndarray) -> np.ndarray:
    """Hashes of strings one character longer than those hashed in `before`."""
    with np.errstate(over="ignore"):
        x = (before ^ (chars[start + length - 1].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9FB21C651E98DF25)
        return x ^ (x >> np.uint64(32))


class Lattices:
    """Forward sums of segments: for each place its incoming edges with cumulative shares, places numbered on from segment to segment.

    first: a place's first edge; key: cumulative share of a place's edges; back: characters an edge spans; id: its piece.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        by_length: dict[int, list[str]] = {}
        for p in vocabulary.pieces:
            by_length.setdefault(len(p), []).append(p)
        self.longest = max(by_length)
        keys, ids, weights = [], [], []
        for n, own in sorted(by_length.items()):
            chars = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
            start, h = np.arange(len(own)) * n, np.zeros(len(own), np.uint64)
            for k in range(1, n + 1):
                h = string_keys(chars, start, k, h)
            keys.append(h)
            ids += [vocabulary.pieces[p][0] for p in own]
            weights += [vocabulary.pieces[p][1] for p in own]
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        # an entry more that no string has: buckets by the first 20 bits of the hash end at the next bucket's start
        self.known, self.ids, self.weights = np.append(keys[order], np.uint64(2**64 - 1)), np.append(np.array(ids, np.int32)[order], np.int32(-1)), np.append(np.array(weights)[order], 0.0)
        heads = np.searchsorted(self.known[:-1], np.arange(1 << 20, dtype=np.uint64) << np.uint64(44))
        self.head, self.deepest = heads.astype(np.int32), int(np.diff(np.append(heads, len(order))).max())
        if (self.known[1:] == self.known[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.clear()

    def clear(self) -> None:
        self.last: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.key, self.back, self.id, self.first = np.zeros(1 << 16, np.float32), np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def add(self, segments: list[str]) -> None:
        """Lattices of segments that are not known yet, all at once."""
        lengths = np.fromiter(map(len, segments), np.int32, len(segments))
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        total = len(chars)
        base = (np.cumsum(lengths + 1) - lengths - 1).astype(np.int32)  # first place of each segment
        own_base = np.repeat(base, lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(total)  # characters to the segment's end
        place = np.arange(total, dtype=np.int32) + np.repeat(np.arange(len(segments), dtype=np.int32), lengths)
        alive, h = np.arange(total), np.zeros(total, np.uint64)
        starts, spans, ids, weights = [], [], [], []
        for n in range(1, self.longest + 1):
            if n > 1:
                go = left[alive] >= n
                alive, h = alive[go], h[go]
            h = string_keys(chars, alive, n, h)
            at = self.head[(h >> np.uint64(44)).astype(np.int32)]
            for _ in range(self.deepest - 1):
                more = np.flatnonzero(self.known[at] < h)
                if not len(more):
                    break
                at[more] += 1
            found = self.known[at] == h
            piece = found & (self.ids[at] >= 0)
            starts.append(alive[piece])
            spans.append(np.full(len(starts[-1]), n, np.int32))
            ids.append(self.ids[at[piece]])
            weights.append(self.weights[at[piece]])
            if n == 1:  # -1 - code point: bytes of the character
                lone = alive[~piece]
                starts.append(lone)
                spans.append(np.ones(len(lone), np.int32))
                ids.append((-1 - chars[lone].astype(np.int64)).astype(np.int32))
                weights.append(np.full(len(lone), 1e-6))
            alive, h = alive[found], h[found]
        start, span, ids, weight = np.concatenate(starts), np.concatenate(spans), np.concatenate(ids), np.concatenate(weights)
        end = place[start] + span
        weight = weight * (40.0 ** np.arange(self.longest + 1))[span]  # the same for all ways through a segment; keeps sums near 1
        level = end - own_base[start]
        order = np.argsort(level.astype(np.int64) * (int(end.max()) + 1) + end, kind="stable")
        end, span, ids, weight, level = end[order], span[order], ids[order], weight[order], level[order]
        begin = end - span
        group = np.flatnonzero(np.diff(end, prepend=-1))  # edges into one place
        group_end = end[group]
        edge_at = np.searchsorted(level, np.arange(1, level[-1] + 2))
        group_at = np.searchsorted(group, edge_at)
        alpha, share = np.zeros(int(base[-1] + lengths[-1] + 1)), np.zeros(len(end))
        alpha[base] = 1.0
        first_place = base[np.searchsorted(base, np.arange(len(alpha)), side="right") - 1]
        sizes = np.diff(np.append(group, len(end)))
        for a, b, ga, gb in zip(edge_at[:-1].tolist(), edge_at[1:].tolist(), group_at[:-1].tolist(), group_at[1:].tolist(), strict=True):
            v = alpha[begin[a:b]] * weight[a:b]
            t = np.add.reduceat(v, group[ga:gb] - a)
            to = group_end[ga:gb]
            alpha[to] = t
            share[a:b] = v / np.repeat(t, sizes[ga:gb])
            if t.min() < 1e-90 or t.max() > 1e90:  # only ratios among near places matter
                far = (t < 1e-90) | (t > 1e90)
                near = np.maximum(to[far, None] - np.arange(self.longest + 1), first_place[to[far], None])
                alpha[near] = alpha[near] / t[far, None]
        order = np.argsort(end + 0.75 * (1 - share), kind="stable")  # likely pieces first: few steps find the drawn one
        end, share = end[order], share[order]
        group = np.flatnonzero(np.diff(end, prepend=-1))
        # cumulative shares on a grid that both the key and the draw hold exactly, whatever the place's number
        sizes, total, key = np.diff(np.append(group, len(end))), np.zeros(len(group)), np.zeros(len(end))
        for k in range(int(sizes.max())):
            own = np.flatnonzero(sizes > k)
            total[own] += share[group[own] + k]
            key[group[own] + k] = total[own]
        key = np.minimum(np.round(key * GRID) / GRID, 1.0)
        key[group + sizes - 1] = 1.0
        need, places = self.edges + len(key), self.nodes + len(alpha)
        if need > len(self.key):
            self.key, self.back, self.id = (np.concatenate([x, np.zeros(need + need // 2 - len(x), x.dtype)]) for x in (self.key, self.back, self.id))
        if places > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(2 * places - len(self.first), np.int32)])
        self.first[end[group] + self.nodes] = group + self.edges
        self.key[self.edges : need], self.back[self.edges : need], self.id[self.edges : need] = key, span[order], ids[order]
        self.last.update(zip(segments, (self.nodes + base + lengths).tolist(), strict=True))
        self.edges, self.nodes = need, places


def segments_of(text: str, cuts: bool) -> list[str]:
    marked = MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK)
    return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked) if cuts else [marked]


def sample(texts: list[str], seeds: np.ndarray, store: Lattices) -> list[np.ndarray]:
    """Piece ids of each text."""
    per_text = [segments_of(t, store.v.cuts) if t else [] for t in texts]
    every = [s for own in per_text for s in own]
    if not every:
        return [np.zeros(0, np.int32) for _ in texts]
    counts = [len(own) for own in per_text]
    ends = list(map(store.last.get, every))
    new = {s for s, at in zip(every, ends, strict=True) if at is None}
    if new:
        store.add(list(new))
        ends = list(map(store.last.__getitem__, every))
    lengths = list(map(len, every))
    key, back, ids, first = store.key, store.back, store.id, store.first
    node, left = np.fromiter(ends, np.int32, len(ends)), np.fromiter(lengths, np.int32, len(lengths))
    counts = np.array(counts)
    number = np.arange(len(node)) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        seed = mix64(np.repeat(seeds, counts) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    live, picks, whose, step = np.arange(len(node)), [], [], 0
    while len(live):
        if step % 2 == 0:  # one hash gives the draws of two steps
            with np.errstate(over="ignore"):
                drawn = mix64(seed[live] + np.uint64(step))
        u = ((drawn >> np.uint64(40 - 24 * (step % 2))) & np.uint64(0xFFFFFF)).astype(np.float32) / np.float32(GRID)
        e = first[node[live]]
        todo = np.flatnonzero(key[e] <= u)
        while len(todo):  # the key of a place's last edge is 1, which no draw reaches
            e[todo] += 1
            todo = todo[key[e[todo]] <= u[todo]]
        picks.append(ids[e])
        whose.append(live)
        node[live] -= back[e]
        left[live] -= back[e]
        on = left[live] > 0
        live, drawn = live[on], drawn[on]
        step += 1
    whose_all = np.concatenate(whose)
    many = np.bincount(whose_all, minlength=len(node))
    begin = np.cumsum(many) - many
    steps = np.repeat(np.arange(len(whose)), [len(w) for w in whose])
    out = np.empty(len(whose_all), np.int32)
    out[begin[whose_all] + many[whose_all] - 1 - steps] = np.concatenate(picks)
    edge = np.append(begin, len(out))[np.concatenate([[0], np.cumsum(counts)])]
    raw = np.flatnonzero(out < 0)
    if len(raw):  # characters without a piece, as many ids as they have bytes
        chars, which = np.unique(out[raw], return_inverse=True)
        own = [[store.v.bytes_[b] for b in raw_char(chr(-1 - p))] for p in chars.tolist()]
        wide = np.ones(len(out), np.int64)
        wide[raw] = np.array([len(x) for x in own])[which]
        moved = np.concatenate([[0], np.cumsum(wide)])
        out = np.repeat(out, wide)
        for k, x in enumerate(own):
            at = moved[raw[which == k]]
            for j, piece in enumerate(x):
                out[at + j] = piece
        edge = moved[edge]
    return [out[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def decode(ids, vocabulary: Vocabulary) -> bytes:
    """UTF-8 bytes of the text; the first blank is the one that encoding put there."""
    table = vocabulary.text
    return b"".join([table[i] for i in ids])[1:]


def seed_of(key, seed: int) -> int:
    import zlib

    text = b"" if key is None or key != key else str(int(key) if isinstance(key, (int, float, np.integer, np.floating)) else key).encode()
    return zlib.crc32(text) << 32 | (zlib.crc32(text, 77) ^ (seed & 0xFFFFFFFF))


_STORES: dict = {}


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, alpha: float = 1.0, seed: int = 1) -> DataFrame:
    """id_col, pieces, n_pieces, n_bytes, pieces_sha256 (of the ids as 32-bit little-endian), decoded_sha256, lossless."""
    import hashlib

    vocabulary = Vocabulary.load(path, alpha)  # read by the driver: executors need no file
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # 32,000 pieces whatever the input
    name = (path, alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import pieces

        store = pieces._STORES.get(name) or pieces._STORES.setdefault(name, Lattices(shared.value))
        for batch in batches:
            keys, column = batch.column("key"), batch.column("text")
            for at, to in groups_of(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), BLOCK):
                texts = [t or "" for t in column.slice(at, to - at).to_pylist()]
                own = keys.slice(at, to - at)
                if store.edges > MOST_EDGES:
                    store.clear()
                found = sample(texts, np.array([seed_of(k, seed) for k in own.to_pylist()], np.uint64), store)
                rows = []
                for t, ids in zip(texts, found, strict=True):
                    raw, back = utf8(t), decode(ids.tolist(), store.v)
                    rows.append((len(ids), len(raw), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == raw))
                many, *rest = zip(*rows, strict=True)
                edges = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(edges, pa.array(np.concatenate(found).astype(np.int32)))
                arrays = [own, lists, *(pa.array(x, k) for x, k in zip((many, *rest), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "pieces", "n_pieces", "n_bytes", "pieces_sha256", "decoded_sha256", "lossless"])
        release_memory()

    base = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = dict(docs.select(F.col(id_col).alias("key")).dtypes)["key"]
    out = base.mapInArrow(run, "key string, pieces array<int>, n_pieces long, n_bytes long, pieces_sha256 string, decoded_sha256 string, lossless boolean")
    return out.select(F.col("key").cast(kind).alias(id_col), "pieces", "n_pieces", "n_bytes", "pieces_sha256", "decoded_sha256", "lossless")
