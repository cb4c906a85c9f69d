"""Aggregates: run metrics, reconciliation, repeated lines, unique values, candidate groups, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_metrics(df: DataFrame, identity: str, unmatched: Column) -> DataFrame:
    """One row: records, duplicates (records less different identities), unmatched."""
    return df.agg(F.count("*").alias("records"), (F.count("*") - F.count_distinct(identity)).alias("duplicates"), F.count_if(unmatched).alias("unmatched"))


def category_counts(df: DataFrame, keys: Sequence[str], category: str, categories: Sequence[str]) -> DataFrame:
    """A row a key: a count for each category, their total, and whether they cover all rows."""
    counts = [F.count_if(F.col(category) == c).alias(f"n_{c}") for c in categories]
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), *counts)
    return out.withColumn("reconciled", sum((F.col(f"n_{c}") for c in categories), F.lit(0)) == F.col("total"))


def repeated_lines(lines: DataFrame, keys: Sequence[str], line: str, page: str, least: int) -> DataFrame:
    """Lines of a key that stand on `least` different pages or more: keys, line, pages."""
    return lines.select(*keys, line, page).distinct().groupBy(*keys, line).agg(F.count("*").alias("pages")).where(F.col("pages") >= least)


def unique_values(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Keys with exactly one different value: it, and the last evidence for it by `order`."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value), F.max(order).alias(order)).where("_n = 1").drop("_n")


def group_candidates(df: DataFrame, keys: Sequence[str], evidence: str, order: str) -> DataFrame:
    """A row for each kind and value: first (by `order`) of the rows, and the different pieces of evidence."""
    return df.groupBy(*keys).agg(F.min(order).alias("first"), F.array_sort(F.collect_set(evidence)).alias("evidence"))


def mean_or(c: Column, default: float | None) -> Column:
    return F.avg(c) if default is None else F.coalesce(F.avg(c), F.lit(default))


def gates(df: DataFrame, named: Mapping[str, Column]) -> DataFrame:
    """One row of booleans over aggregates of `df`, and `passed`, whether all hold."""
    out = df.agg(*(c.alias(n) for n, c in named.items()))
    every = F.lit(True)
    for n in named:
        every = every & F.coalesce(F.col(n), F.lit(False))
    return out.withColumn("passed", every)


def ordered_fingerprint(df: DataFrame, keys: Sequence[str], row_text: Column) -> DataFrame:
    """A key's rows as one hash that does not depend on their order: the exact sum of the rows' 60-bit hashes, and their number.

    Both combine before the shuffle, so a key of any size needs no list of its rows.
    """
    bits = F.conv(F.substring(F.sha2(row_text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.sum(bits).alias("bits"), F.count("*").alias("n"))


def column_counts(lines: Column, separator: str = r"\s{2,}|\t|\|") -> Column:
    """The most cells that a line of a block has."""
    return F.coalesce(F.array_max(F.transform(lines, lambda x: F.size(F.split(F.trim(x), separator)))), F.lit(0))
