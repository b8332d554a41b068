"""Scalar SQL in two dialects: Spark's, which runs, and DuckDB's, which checks it.

A formula is a function of a dialect and of column names or expressions, and returns SQL text. `spark(formula, ...)` makes a Column of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Spark:
    name = "spark"

    @staticmethod
    def num(x: float) -> str:
        """A double."""
        return f"({x!r}D)" if x < 0 else f"{x!r}D"

    @staticmethod
    def trunc(x: str) -> str:
        """Toward zero, as an int."""
        return f"cast({x} as int)"

    @staticmethod
    def shr(x: str, n) -> str:
        return f"shiftright({x}, {n})"

    @staticmethod
    def div(a: str, b) -> str:
        """Integer quotient of numbers that are not negative."""
        return f"({a} div {b})"

    @staticmethod
    def even(x: str) -> str:
        """Half-even round."""
        return f"bround({x}, 0)"

    @staticmethod
    def item(a: str, i: str) -> str:
        """Element of an array, from 0."""
        return f"get({a}, cast({i} as int))"


class Duck(Spark):
    name = "duck"

    @staticmethod
    def num(x: float) -> str:
        return f"({x!r}::DOUBLE)"

    @staticmethod
    def trunc(x: str) -> str:
        return f"cast(trunc({x}) as int)"

    @staticmethod
    def shr(x: str, n) -> str:
        return f"(({x}) >> {n})"

    @staticmethod
    def div(a: str, b) -> str:
        return f"(({a}) // {b})"

    @staticmethod
    def even(x: str) -> str:
        return f"round_even({x}, 0)"

    @staticmethod
    def item(a: str, i: str) -> str:
        return f"({a})[({i}) + 1]"


def clip(x: str, low, high) -> str:
    return f"least({high}, greatest({low}, {x}))"


def floor_int(x: str) -> str:
    return f"cast(floor({x}) as int)"


def away(x: str) -> str:
    """Half away from zero, as an int."""
    return f"cast(sign({x}) * floor(abs({x}) + 0.5) as int)"


def columns(**parts: str) -> list[Column]:
    return [F.expr(v).alias(k) for k, v in parts.items()]
