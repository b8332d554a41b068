"""Where queries and their SQL are registered, and the relations both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_PLACES = "(SELECT unnest(range(64)) AS p)"
_YX = "CAST(p // 8 AS INT) AS y, CAST(p % 8 AS INT) AS x"


def _sample(array: str, factor: float, top: int) -> str:
    return f"CAST(least({top}, greatest(0, floor(({array}[p + 1]::DOUBLE + 0.6::DOUBLE) * {factor}::DOUBLE))) AS INT)"


def _images(*next_: str) -> str:
    """Images beside the one or two that follow them; the last is followed by the first. Joined as whole arrays, by equal ids."""
    ids = ", ".join(f"(vec_id + {k}) % n AS next{k}" for k in range(1, len(next_) + 1))
    own = f"(SELECT vec_id, embedding, {ids} FROM embeddings, (SELECT max(vec_id) + 1 AS n FROM embeddings)) i0"
    return own + "".join(f" JOIN embeddings i{k} ON i{k}.vec_id = i0.next{k}" for k in range(1, len(next_) + 1))


def _plane(name: str, factor: float, top: int) -> str:
    return f"{name} AS (SELECT vec_id AS image_id, label, {_YX}, {_sample('embedding', factor, top)} AS v FROM embeddings, {_PLACES})"


def _beside(name: str, factor: float, top: int, *columns: str) -> str:
    values = ", ".join(f"{_sample(f'i{k}.embedding', factor, top)} AS {c}" for k, c in enumerate(columns))
    return f"{name} AS (SELECT i0.vec_id AS image_id, {_YX}, {values} FROM {_images(*columns[1:])}, {_PLACES})"


#: Relations of the check's SQL; each may use those before it. spot: each place beside its image's samples as a list, to read neighbours without a join.
RELATIONS = {
    "plane": _plane("plane", 212.5, 255),
    "plane10": _plane("plane10", 852.5, 1023),
    "ext": "ext AS (SELECT image_id, label, y, x, CAST(CASE WHEN v < 110 THEN 0 WHEN v > 145 THEN 255 ELSE v END AS INT) AS v FROM plane)",
    "pair": _beside("pair", 212.5, 255, "a", "b"),
    "pair10": _beside("pair10", 852.5, 1023, "a", "b"),
    "rgb": _beside("rgb", 212.5, 255, "r", "g", "b"),
    "spot": f"spot AS (SELECT vec_id AS image_id, {_YX}, list_transform(embedding, lambda e: CAST(least(255, greatest(0, floor((e::DOUBLE + 0.6::DOUBLE) * 212.5::DOUBLE))) AS INT)) AS l FROM embeddings, {_PLACES})",
    "rgb10": _beside("rgb10", 852.5, 1023, "r", "g", "b"),
}
_NEEDS = {"ext": ("plane",)}


def with_relations(sql: str, *names: str) -> str:
    order: list[str] = []
    for n in names:
        order += [m for m in (*_NEEDS.get(n, ()), n) if m not in order]
    if not order:
        return sql
    body = sql.strip()
    rest = f", {body[5:]}" if body.upper().startswith("WITH ") else f" {body}"
    return "WITH " + ", ".join(RELATIONS[n] for n in order) + rest


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, *relations: str) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_relations(sql, *relations)
