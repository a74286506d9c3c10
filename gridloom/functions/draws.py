"""Random numbers as a function of a seed and a key: the same on every machine, in every order, and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that make a number: 52 bits, which a double holds.
DIGITS = 13
#: The same in DuckDB's SQL, of a comma-separated list of a seed and texts.
SQL_UNIFORM = "CAST(CAST('0x' || md5(concat_ws(':', {0}))[1:13] AS BIGINT) AS DOUBLE) / 4503599627370496"


def number(seed: int | str | Column, *key: Column | str) -> Column:
    """A whole number of 52 bits for a seed and a key."""
    head = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", head, *[p.cast("string") for p in parts])), 1, DIGITS), 16, 10).cast("bigint")


def uniform(seed: int | str | Column, *key: Column | str) -> Column:
    """At least 0, less than 1."""
    return number(seed, *key) / F.lit(float(1 << 4 * DIGITS))


def _poisson_edges() -> list[float]:
    """P(X <= k) of Poisson's law with mean 1, as far as doubles tell them apart."""
    edges, p, total, k = [], 0.36787944117144233, 0.0, 0
    while total + p > total:
        total += p
        edges.append(total)
        k += 1
        p /= k
    return edges


POISSON_EDGES = _poisson_edges()


def poisson(u: Column) -> Column:
    """How often a row is drawn if each is drawn once on average."""
    return F.aggregate(F.array(*[F.lit(e) for e in POISSON_EDGES]), F.lit(0), lambda n, e: n + F.when(u >= e, 1).otherwise(0))


def sql_poisson(u: str) -> str:
    return f"len(list_filter([{', '.join(map(repr, POISSON_EDGES))}]::DOUBLE[], lambda e: {u} >= e))"
