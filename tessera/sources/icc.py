"""ICC profiles: put together from the chunks that a JPEG file's APP2 segments hold, their tags, and the values of tone curves."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jpeg

PREFIX, APP2 = b"ICC_PROFILE\0", 0xE2
#: Bytes of profile that one segment holds.
CHUNK = 65533 - len(PREFIX) - 2
# Numbers of parameters of the parametric curve types.
PARAMETERS = (1, 3, 4, 5, 7)


def from_chunks(chunks: list[bytes]) -> tuple[bytes | None, str]:
    """(profile, status) of the segments after their prefix, in any order; each starts with its number and how many there are."""
    if not chunks:
        return None, "no profile"
    totals = {c[1] for c in chunks if len(c) > 1}
    if any(len(c) < 2 for c in chunks) or len(totals) != 1:
        return None, "chunks of different profiles"
    (total,), numbers = totals, sorted(c[0] for c in chunks)
    if numbers != list(range(1, total + 1)):
        return None, f"chunks {', '.join(map(str, numbers))} of {total}"
    profile = b"".join(c[2:] for c in sorted(chunks, key=lambda c: c[0]))
    if len(profile) < 132 or profile[36:40] != b"acsp" or int.from_bytes(profile[:4], "big") != len(profile):
        return None, "not a profile"
    return profile, "ok"


def to_chunks(profile: bytes, size: int = CHUNK) -> list[tuple[int, bytes]]:
    """APP2 segments of a profile, in order."""
    parts = [profile[k : k + size] for k in range(0, len(profile), size)]
    return [(APP2, PREFIX + bytes([k + 1, len(parts)]) + p) for k, p in enumerate(parts)]


def profiles(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, status, profile of JPEG files: one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                whole = data.as_py() or b""
                chunks = [s[len(PREFIX) :] for m, _, at, n, _ in jpeg.scan(whole) if m == APP2 and (s := whole[at + 4 : at + 2 + n]).startswith(PREFIX)]
                profile, status = from_chunks(chunks)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.string()), pa.array([status], pa.string()), pa.array([profile], pa.binary())], names=["path", "status", "profile"])

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, "path string, status string, profile binary")


def _u(b: str, at: int | str, n: int) -> str:
    """An unsigned number of n bytes at an offset (from 0) of a binary, in SQL."""
    return f"cast(conv(hex(substring({b}, {at} + 1, {n})), 16, 10) as bigint)"


def _fixed(b: str, at: str) -> str:
    """A signed number with 16 bits behind the point."""
    v = _u(b, at, 4)
    return f"(({v} - case when {v} >= 2147483648 then 4294967296 else 0 end) / 65536D)"


def header(profile: str = "profile") -> dict[str, Column]:
    """Columns of a profile's header."""
    text = lambda at: F.trim(F.decode(F.expr(f"substring({profile}, {at + 1}, 4)"), "US-ASCII"))
    version = F.concat_ws(".", F.expr(_u(profile, 8, 1)), F.expr(f"shiftright({_u(profile, 9, 1)}, 4)"))
    return {"profile_version": version, "profile_class": text(12), "color_space": text(16), "profile_connection_space": text(20), "xyz_illuminant": F.array(*[F.expr(_fixed(profile, str(68 + 4 * k))) for k in range(3)])}


def tags(found: DataFrame, profile: str = "profile") -> DataFrame:
    """One row a tag of each profile: the other columns, tag, data. Tags that reach beyond the profile are left out."""
    rest = [c for c in found.columns if c != profile]
    at = "(132 + 12 * k)"
    one = found.filter(f"{profile} is not null").select(*rest, profile, F.explode(F.expr(f"sequence(0, cast({_u(profile, 128, 4)} as int) - 1)")).alias("k")).filter(f"k >= 0 and {at} <= octet_length({profile})")
    place = one.select(*rest, profile, F.rtrim(F.decode(F.expr(f"substring({profile}, {at} + 1, 4)"), "US-ASCII")).alias("tag"), F.expr(_u(profile, f"{at} + 4", 4)).alias("_from"), F.expr(_u(profile, f"{at} + 8", 4)).alias("_n"))
    return place.filter(f"_from + _n <= octet_length({profile})").select(*rest, "tag", F.expr(f"substring({profile}, cast(_from + 1 as int), cast(_n as int))").alias("data"))


#: Metadata keys of tone curves.
CURVE_KEYS = ("icc:red_trc", "icc:green_trc", "icc:blue_trc")


def curve_values(data: str) -> Column:
    """Values of a tone curve: the parameters of a parametric one; of a sampled one nothing (straight), its gamma, or its samples. Null for other data."""
    return F.expr(_curve_sql(data))


def _curve_sql(data: str) -> str:
    kind, n, form = f"decode(substring({data}, 1, 4), 'US-ASCII')", _u(data, 8, 4), _u(data, 8, 2)
    wanted = "case " + form + " " + " ".join(f"when {k} then {v}" for k, v in enumerate(PARAMETERS)) + " end"
    many = lambda count, e: f"case when {count} > 0 then transform(sequence(0, cast({count} as int) - 1), i -> {e}) else cast(array() as array<double>) end"
    sampled = f"case when {n} = 1 then array({_u(data, 12, 2)} / 256D) else {many(n, f'cast({_u(data, '12 + 2 * i', 2)} as double)')} end"
    return f"case {kind} when 'para' then {many(wanted, _fixed(data, '12 + 4 * i'))} when 'curv' then {sampled} end"


def text_of(data: str) -> Column:
    """The text of a text or description tag; of one in several languages the first."""
    kind = F.decode(F.expr(f"substring({data}, 1, 4)"), "US-ASCII")
    plain = F.decode(F.expr(f"substring({data}, 9)"), "UTF-8")
    described = F.decode(F.expr(f"substring({data}, 13, cast({_u(data, 8, 4)} as int))"), "UTF-8")
    wide = F.decode(F.expr(f"substring({data}, cast({_u(data, 24, 4)} + 1 as int), cast({_u(data, 20, 4)} as int))"), "UTF-16BE")
    return F.when(kind == "mluc", wide).when(kind.isin("text", "desc"), F.regexp_replace(F.when(kind == "text", plain).otherwise(described), "\u0000+$", ""))


def decoded_curves(df: DataFrame, column: str) -> DataFrame:
    """Metadata maps whose tone curves are `base64:...` texts get their numbers instead, blanks between; other values stay. A curve that cannot be read becomes empty."""
    pairs = df.withColumn("_e", F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"), F.unbase64(F.when(e["key"].isin(*CURVE_KEYS) & F.startswith(e["value"], F.lit("base64:")), F.substring_index(e["value"], ":", -1))).alias("b"))))
    number = "array_join(transform({}, x -> cast(x as string)), ' ')"
    values = _curve_sql("e.b")
    return pairs.withColumn(column, F.expr(f"map_from_entries(transform(_e, e -> struct(e.k, case when e.b is null then e.v else coalesce({number.format(values)}, '') end)))")).drop("_e")


def build(tags_: dict[str, bytes], version: tuple[int, int] = (4, 3), kind: bytes = b"mntr", space: bytes = b"RGB ", connection: bytes = b"XYZ ") -> bytes:
    """A profile of these tags."""
    head = bytearray(128)
    head[8], head[9], head[12:16], head[16:20], head[20:24], head[36:40] = version[0], version[1] << 4, kind, space, connection, b"acsp"
    for k, v in enumerate((0.9642, 1.0, 0.8249)):
        head[68 + 4 * k : 72 + 4 * k] = round(v * 65536).to_bytes(4, "big")
    table, body, at = len(tags_).to_bytes(4, "big"), b"", 132 + 12 * len(tags_)
    for name, data in tags_.items():
        table += name.encode().ljust(4) + (at + len(body)).to_bytes(4, "big") + len(data).to_bytes(4, "big")
        body += data + bytes(-len(data) % 4)
    out = bytes(head) + table + body
    return len(out).to_bytes(4, "big") + out[4:]


def parametric(form: int, *values: float) -> bytes:
    return b"para" + bytes(4) + form.to_bytes(2, "big") + bytes(2) + b"".join((round(v * 65536) & 0xFFFFFFFF).to_bytes(4, "big") for v in values)


def sampled(*values: int) -> bytes:
    """No value: straight. One: a gamma with 8 bits behind the point. More: samples."""
    return b"curv" + bytes(4) + len(values).to_bytes(4, "big") + b"".join(v.to_bytes(2, "big") for v in values)
