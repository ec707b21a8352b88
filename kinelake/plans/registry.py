"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """The queries of one module, and the SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put


def r6(c: Column | str) -> Column:
    """Rounded to six decimals, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def r9(c: Column) -> Column:
    """Rounded to nine decimals as C does, halves of the scaled double away from zero; without a negative zero.

    ``round`` goes by the shortest decimal text of the double, which can give
    another last decimal, and makes a BigDecimal of every value.
    """
    a = F.abs(c * F.lit(1e9))
    even = F.rint(a)
    return F.signum(c) * (even + (a - even == 0.5).cast("int")) / F.lit(1e9) + F.lit(0.0)


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without a zone (the session's zone is UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))
