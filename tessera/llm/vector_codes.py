"""Vector code compression: codebooks of vector parts by Lloyd's rounds, with Elkan's bounds so that most distances are never computed.

Components become integers (floor of 4096 times the value), vectors are cut into equal consecutive parts, and each part position has a codebook of
integer entries. A round assigns every part to its nearest entry (squared distance, ties to the lower index) and then moves each entry to the
floored mean of its parts. What a part knows is kept from round to round beside its vector: its entry, an upper bound of the distance to it, and one
lower bound of the distance to each entry. When entries have moved, the upper bound grows and the lower bounds shrink by the distance moved. An entry is passed over only if
a bound says that it is strictly farther than the own one: its lower bound is above the upper bound, or it lies more than twice the upper bound from
the own entry. All bounds are integers (upper ones rounded up, lower ones down), and what they leave open is decided by exact integer distances, so results equal those of a full search, ties included.

A round is one pass of map tasks over the rows, which write the next round's rows and one row of sums for each task; sums are added up in Spark,
and only codebooks (entries times dimensions, whatever the number of vectors) come to the driver. No vector is ever dealt out, so a hot label or vector costs nothing more.
The rows of the round before are deleted when the next are written.

Rows: one per kept row. Null vectors and vectors with null or non-finite components are dropped. Vectors of unequal lengths, or of a length that the parts do not
divide, are filled up with zeros to the next common length. Components beyond 16384 in size count as 16384 (squares stay in 64 bits). Null ids come last among the first entries, repeated ids are
ordered by their vectors; with fewer kept rows than entries, there are as many entries as rows. Null labels are one label. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash

#: Components are cut off at this size, as integers.
LARGEST = 1 << 26
#: Vectors handled at once. Lower bounds are kept in 16 bits: a larger one is still one when cut off.
BLOCK, LOWER_MOST = 2048, 65535
#: Labels up to which their sums are sent to every task; more are joined by an exchange.
FEW_LABELS = 1 << 16
_STATE = "row struct<id: {0}, label: {1}>, vector binary, codes binary, upper binary, lower binary, sums array<bigint>"


def root(x: np.ndarray) -> np.ndarray:
    """The integer part of the square root, exactly."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    r += (r + 1) * (r + 1) <= x
    return r


def root_up(x: np.ndarray) -> np.ndarray:
    r = root(x)
    return r + (r * r < x)


def all_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every entry."""
    return ((x[:, None, :] - entries[None]) ** 2).sum(-1)


def full_search(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, squared distances, upper bounds, lower bounds) without any bound known before."""
    d = all_distances(x, entries)
    code = d.argmin(1)
    own = d[np.arange(len(x)), code]
    return code, own, root_up(own), root(d)


def bounded_search(x, entries, code, upper, lower, between) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """As full_search, from bounds that hold for these entries; last, the number of distances computed.

    between: distances of the entries from one another, rounded down. Bounds and codes are changed in place.
    """
    rows, known = np.arange(len(x)), np.full(len(x), -1, np.int64)
    computed = 0

    def open_entries(at):
        u = upper[at, None]
        out = (u >= lower[at]) & (2 * u >= between[code[at]])
        out[np.arange(len(at)), code[at]] = False
        return out

    at = rows[open_entries(rows).any(1)]
    known[at] = ((x[at] - entries[code[at]]) ** 2).sum(1)
    upper[at], lower[at, code[at]] = root_up(known[at]), root(known[at])
    computed += len(at)
    left = open_entries(at)
    at, left = at[left.any(1)], left[left.any(1)]
    i, j = np.nonzero(left)
    pair = ((x[at[i]] - entries[j]) ** 2).sum(1)
    computed += len(pair)
    d = np.full((len(at), len(entries)), np.iinfo(np.int64).max)
    d[i, j] = pair
    d[np.arange(len(at)), code[at]] = known[at]
    lower[at[i], j] = root(pair)
    code[at] = d.argmin(1)
    known[at] = d[np.arange(len(at)), code[at]]
    upper[at] = root_up(known[at])
    return code, known, upper, lower, computed


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of `width` integer components from lists of doubles."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.clip(np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 4096), -LARGEST, LARGEST).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _matrix(column: pa.Array, kind, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _binary(m: np.ndarray) -> pa.Array:
    """One binary value a row."""
    data = np.ascontiguousarray(m)
    size = data.nbytes // max(1, len(data))
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * size), pa.py_buffer(data)])


class Codebooks:
    """entries: parts x entries x positions. moved: how far each entry went in the last round, rounded up; None before any assignment."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray | None = None):
        self.entries, self.moved = entries, moved

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def after(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries at the floored means of their parts; entries without any stay."""
        new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        return Codebooks(new, root_up(((new - self.entries) ** 2).sum(-1)))

    def assign(self, x: np.ndarray, codes=None, upper=None, lower=None):
        """x: rows x parts x positions. (codes, upper, lower) of all parts; with what was known before, by bounds. Last, distances computed."""
        parts, many = self.entries.shape[:2]
        if codes is None:
            found = [full_search(x[:, p], self.entries[p]) for p in range(parts)]
            return *(np.stack([f[k] for f in found], 1) for k in (0, 2, 3)), x.shape[0] * parts * many
        codes, upper, lower = codes.astype(np.int64), upper + self.moved[np.arange(parts), codes], np.maximum(lower.astype(np.int64) - self.moved, 0)
        computed = 0
        for p in range(parts):
            between = root(all_distances(self.entries[p], self.entries[p]))
            c, _, u, w, n = bounded_search(x[:, p], self.entries[p], codes[:, p].copy(), upper[:, p].copy(), lower[:, p].copy(), between)
            codes[:, p], upper[:, p], lower[:, p] = c, u, w
            computed += n
        return codes, upper, lower, computed


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), BLOCK):
            yield b.slice(at, BLOCK)


def assign_round(rows: DataFrame, books: Codebooks, width: int, first: bool) -> DataFrame:
    """The rows with new codes and bounds, and one row of sums and counts (`sums`) for each task."""
    parts, many, size = books.entries.shape
    schema = _STATE.format(*(f.dataType.simpleString() for f in rows.schema["row"].dataType.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, kind = np.zeros((parts, many, size), np.int64), np.zeros((parts, many), np.int64), None
        for b in _blocks(batches):
            kind = b.schema.field("row").type
            if first:
                x = integers(b.column("vector"), width)
                known = ()
            else:
                x = _matrix(b.column("vector"), np.int32, (width,)).astype(np.int64)
                known = _matrix(b.column("codes"), np.uint8, (parts,)), _matrix(b.column("upper"), np.int64, (parts,)), _matrix(b.column("lower"), np.uint16, (parts, many))
            codes, upper, lower, _ = books.assign(x.reshape(-1, parts, size), *known)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], x.reshape(-1, parts, size)[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=many)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), _binary(x.astype(np.int32)), _binary(codes.astype(np.uint8)), _binary(upper), _binary(np.minimum(lower, LOWER_MOST).astype(np.uint16)), pa.nulls(len(x), pa.list_(pa.int64()))],
                names=["row", "vector", "codes", "upper", "lower", "sums"],
            )
        if kind is not None:
            total = np.concatenate([sums.ravel(), counts.ravel()])
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), none, none, none, none, pa.array([total], pa.list_(pa.int64()))], names=["row", "vector", "codes", "upper", "lower", "sums"])

    return rows.mapInArrow(run, schema)


def next_books(books: Codebooks, state: DataFrame) -> Codebooks:
    """Reads the sums alone; as many numbers come to the driver as the codebooks hold."""
    parts, many, size = books.entries.shape
    rows = state.filter("sums is not null").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(parts * many * (size + 1), np.int64)
    for r in rows:
        total[r.k] = r.v
    return books.after(total[: parts * many * size].reshape(parts, many, size), total[parts * many * size :].reshape(parts, many))


def final_codes(state: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """row, code, error: the last assignment, with exact distances to the own entries."""
    parts, many, size = books.entries.shape
    kinds = [f.dataType.simpleString() for f in state.schema["row"].dataType.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            x = _matrix(b.column("vector"), np.int32, (width,)).astype(np.int64).reshape(-1, parts, size)
            codes, *_ = books.assign(x, _matrix(b.column("codes"), np.uint8, (parts,)), _matrix(b.column("upper"), np.int64, (parts,)), _matrix(b.column("lower"), np.uint16, (parts, many)))
            error = ((x - books.entries[np.arange(parts), codes]) ** 2).sum((1, 2))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([r.tobytes().hex() for r in codes.astype(np.uint8)], pa.string()), pa.array(error, pa.int64())], names=["row", "code", "error"])

    return state.filter("sums is null").mapInArrow(run, f"row struct<id: {kinds[0]}, label: {kinds[1]}>, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """id_col, code (two hex digits a part), error, label_error, codebooks_sha256. entries: at most 256."""
    base = vectors.select(F.struct(F.col(id_col).alias("id"), F.col(label_col).alias("label")).alias("row"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    base = base.filter(F.col("vector").isNotNull() & sound)
    longest = base.agg(F.max(F.size("vector")).alias("n")).first()["n"]
    if longest is None:
        kind = dict(vectors.select(F.col(id_col).alias("id")).dtypes)["id"]
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    width = max(1, -(-longest // parts)) * parts
    seeds = [r["vector"] for r in base.orderBy(F.col("row.id").asc_nulls_last(), "vector").limit(entries).collect()]
    start = integers(pa.array(seeds, pa.list_(pa.float64())), width).reshape(len(seeds), parts, width // parts)
    books, state = Codebooks(start.transpose(1, 0, 2).copy()), None
    for k in range(rounds):
        rows = base if k == 0 else state.filter("sums is null")
        new = stash(assign_round(rows, books, width, k == 0), "codes")
        if state is not None:
            drop_stash(state)
        state, books = new, next_books(books, new)
    coded = stash(final_codes(state, books, width), "coded")
    drop_stash(state)
    sums = stash(coded.groupBy(F.col("row.label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    out = coded.join(sums, F.col("row.label").eqNullSafe(F.col("of")))
    return out.select(F.col("row.id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
