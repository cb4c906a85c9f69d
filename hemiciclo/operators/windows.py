"""Operators over ordered rows and over ordered text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def occurrence_index(df: DataFrame, keys: Sequence[str], identity: Sequence[str], out: str = "occurrence") -> DataFrame:
    """0-based dense rank of the different identities of a key; NULL parts order as ''."""
    order = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]
    return df.withColumn(out, F.dense_rank().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def renumber(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "ordinal") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def running_offsets(df: DataFrame, keys: Sequence[str], order: Sequence[str], length: Column, separator: int = 1, out: str = "start") -> DataFrame:
    """Where each part starts when a key's parts are joined with `separator` characters between them."""
    up_to = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(length + separator).over(up_to), F.lit(0)).cast("long"))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, least: int = 1) -> DataFrame:
    """Runs of rows with one value: keys, value, run (0-based), n, first and last of the first order column; runs shorter than `least` go."""
    by = W.partitionBy(*keys).orderBy(*order)
    v = df.withColumn("_v", value)
    changed = (~F.col("_v").eqNullSafe(F.lag("_v").over(by)) | (F.row_number().over(by) == 1)).cast("int")
    runs = v.withColumn("_c", changed).withColumn("run", F.sum("_c").over(by.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return runs.groupBy(*keys, "run").agg(F.first("_v").alias("value"), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")).where(F.col("n") >= least)


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, *, strictly_before: bool = False) -> DataFrame:
    """The last value that is not NULL up to (or before) each row."""
    by = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if strictly_before else 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(by))


def between_markers(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Column, stop: Column) -> DataFrame:
    """The rows after a key's first start marker and before the first stop marker that follows it."""
    by = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    on = df.withColumn("_on", F.max(start.cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)))
    off = on.withColumn("_off", F.max(((F.col("_on") == 1) & stop).cast("int")).over(by))
    return off.where((F.col("_on") == 1) & (F.coalesce("_off", F.lit(0)) == 0)).drop("_on", "_off")


def nearest_neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, *, reach: int = 3, following_first: bool = False) -> DataFrame:
    """The nearest value that is not NULL within `reach` rows: before, after, two before, two after, and so on."""
    by = W.partitionBy(*keys).orderBy(*order)
    v = df.withColumn("_v", value)
    steps = [x for k in range(1, reach + 1) for x in ((F.lead("_v", k), F.lag("_v", k)) if following_first else (F.lag("_v", k), F.lead("_v", k)))]
    return v.withColumn(out, F.coalesce(*(s.over(by) for s in steps))).drop("_v")


def nearest_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, *, back: int = 4, ahead: int = 4) -> DataFrame:
    """previous and next: the nearest values that are not NULL within so many rows."""
    by = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("previous", F.last(value, True).over(by.rowsBetween(-back, -1))).withColumn("next", F.first(value, True).over(by.rowsBetween(1, ahead)))


def char_windows(df: DataFrame, text: str, *, size: int = 24_000, overlap: int = 500, most: int | None = 100) -> DataFrame:
    """Windows of `size` characters that overlap: chunk, start (0-based), piece; the last one ends with the text.

    More than `most` windows are an error, unless it is None; an empty text has none.
    """
    step = size - overlap
    n = F.length(text)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1)
    checked = count.cast("int") if most is None else F.when(count > most, F.raise_error(F.format_string("text needs %s windows, more than %s", count, F.lit(most))).cast("int")).otherwise(count.cast("int"))
    ordinals = F.when(checked > 0, F.sequence(F.lit(0), checked - 1)).otherwise(F.array().cast("array<int>"))
    chunks = df.withColumn("chunk", F.explode(ordinals)).withColumn("start", (F.col("chunk") * step).cast("long"))
    return chunks.withColumn("piece", F.substring(F.col(text), F.col("start").cast("int") + 1, F.lit(size)))


def fold_lines(lines: Column, joins: "callable") -> Column:
    """Logical lines: each line joins the one that has grown before it where `joins(grown, line)` is true."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("grown"))

    def step(acc, line):
        grown = F.when(acc["grown"].isNull(), line).when(joins(acc["grown"], line), F.concat_ws(" ", acc["grown"], line)).otherwise(line)
        closed = acc["grown"].isNotNull() & ~joins(acc["grown"], line)
        done = F.when(closed, F.array_append(acc["done"], acc["grown"])).otherwise(acc["done"])
        return F.struct(done.alias("done"), grown.alias("grown"))

    return F.aggregate(lines, empty, step, lambda acc: F.when(acc["grown"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["grown"])))


def last_match(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))
