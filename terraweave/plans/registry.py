"""How a family of queries is put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 5


class Family:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        """Registers a function (spark, sf_dir) -> DataFrame; sql: the same for DuckDB, None where SQL can't say it."""

        def keep(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.oracle[name] = shifted(sql)
            return f

        return keep


#: Added before rounding, so that values in the middle between two roundings, which are common here, are no longer.
SHIFT = 1.3e-7


def rounded(c: Column, digits: int = DIGITS) -> Column:
    """For outputs whose last digits depend on the engine; adding 0 turns -0 into 0."""
    return F.rint((c + SHIFT) * 10.0**digits) / 10.0**digits + 0.0  # round() of a double goes through a decimal, at many times the price


def shifted(sql: str) -> str:
    """SQL in which round(x, n) rounds as rounded() does."""
    out, at = [], 0
    while (found := sql.find("round(", at)) >= 0:
        depth, k = 0, found + 6
        while depth or sql[k] != ",":
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(sql[k], 0)
            k += 1
        out += [sql[at : found + 6], "(", shifted(sql[found + 6 : k]), f") + {SHIFT}::DOUBLE"]
        at = k
    return "".join([*out, sql[at:]])
