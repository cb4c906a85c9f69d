"""Orders and caps. A cap is an error, never a cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


class IncompleteResult(RuntimeError):
    """There is more than was asked for."""


def sort_key(date: Column, identity: Column, *, descending: bool = False) -> list[Column]:
    """By date text ('' for none), then identity; descending turns both round."""
    parts = [F.coalesce(date.cast("string"), F.lit("")), identity]
    return [p.desc() if descending else p.asc() for p in parts]


def intervention_order(date: str, starts: str, document: str, identity: str) -> list[Column]:
    return [F.coalesce(F.col(date), F.lit("0001-01-01").cast("date")), F.coalesce(F.col(starts), F.lit("")), F.coalesce(F.col(document), F.lit("")), F.col(identity)]


def ensure_at_most(df: DataFrame, n: int) -> DataFrame:
    """`df` if it has at most `n` rows; counts no further than n + 1."""
    if (found := df.limit(n + 1).count()) > n:
        raise IncompleteResult(f"more than {n} records ({found} seen)")
    return df


def collect_at_most(df: DataFrame, n: int) -> list[Row]:
    rows = df.limit(n + 1).collect()
    if len(rows) > n:
        raise IncompleteResult(f"more than {n} records")
    return rows


def examples(df: DataFrame, order: Sequence[str], n: int = 50) -> DataFrame:
    """The first rows of a report."""
    return df.orderBy(*order).limit(n)


def last_k(values: Column, k: int) -> Column:
    return F.when(F.size(values) <= k, values).otherwise(F.slice(values, -k, k))
