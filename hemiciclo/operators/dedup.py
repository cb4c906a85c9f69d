"""One row a key: most complete, first, last, preferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _empty(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind == "string":
        return c.isNull() | (c == "")
    if kind.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def completeness(df: DataFrame, but: Sequence[str] = ("source",)) -> Column:
    """Fields that are not empty; 0 and false are not empty."""
    out = F.lit(0)
    for name in df.columns:
        if name not in but:
            out = out + (~_empty(df, name)).cast("int")
    return out


def most_complete(df: DataFrame, keys: Sequence[str], order: Sequence[str], but: Sequence[str] = ("source",)) -> DataFrame:
    """One row a key: the most complete, the first in `order` of several. An aggregate, so copies of a hot key combine before the shuffle."""
    ranked = df.withColumn("_full", completeness(df, but))
    best = ranked.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*df.columns), F.struct(-F.col("_full"), *order)).alias("r"))
    return best.select("r.*")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    best = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    best = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def preferred(df: DataFrame, keys: Sequence[str], column: str, ranking: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: of the value that stands first in `ranking`; rows with other values go."""
    rank = F.array_position(F.array(*map(F.lit, ranking)), F.col(column))
    return first_per_key(df.where(F.col(column).isin(*ranking)), keys, [rank, *order])


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: n, n_distinct, duplicates."""
    n, d = F.sum("_n"), F.count("*")
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.coalesce(n, F.lit(0)).alias("n"), d.alias("n_distinct"), F.coalesce(n - d, F.lit(0)).alias("duplicates"))


def distinct_list(c: Column) -> Column:
    """Order-preserving distinct of an array."""
    return F.array_distinct(c)


def keep_order(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last row of each key, in order of each key's first."""
    whole = W.partitionBy(*keys)
    ranked = df.withColumn("_first", F.min(order).over(whole)).withColumn("_last", F.max(order).over(whole))
    return ranked.where(F.col(order) == F.col("_last")).orderBy("_first").drop("_first", "_last")
