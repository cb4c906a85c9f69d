"""Mixing sources to target weights by hash-random keys, range order and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hemiciclo.llm.common import WORD, range_offsets, stash

WEIGHTS = (5, 2, 1)
CAP = 3
#: Rows of a source that one key range holds, about.
RANGE_ROWS = 1000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column) -> Column:
    """60 bits of the md5 of the id's text: uniform, the same on each run and in any engine."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), text).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes: source, source_size, a row a source. Adds `target`, the source's share of the words of all.

    A source whose weight would give it more than `cap` times its size stops there and the others share its excess by
    weight, until none is above. That is the level x with sum(min(cap * size, weight * x)) = all words; in order of
    cap * size / weight, x is the first row's (words left) / (weights left) that does not exceed its own ratio.
    The two windows run over one row a source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", cap * F.col("source_size").cast("double"))
    ranked = ranked.withColumn("ratio", F.col("limit") / F.col("weight"))
    every = W.partitionBy()
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("level", (F.sum("source_size").over(every) - before) / left)
    ranked = ranked.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(every)["level"])
    return ranked.select("source", "source_size", F.least("limit", F.col("weight") * F.col("level")).alias("target"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    carry: bool = False,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """What a mix takes of every document: doc_id, size, source_size, target, taken; with `carry` also `row`, the input row.

    Within a source, documents stand in the order of a hash-random key. The key's values are cut into ranges of equal
    width, so a source's words are summed by range, the ranges' sums give each range's offset (in two levels, as a hot
    source has very many ranges), and a running sum inside a range gives each document's place. The
    source's budget is its rounded target; it takes whole epochs of all its documents and then, in key order, exactly
    what is left, so one document a source may be taken in part.

    NULL text counts no words, NULL sources are a source of their own (last in order), documents without words take
    0, repeated rows are documents of their own (ties by size and a hash of the text), an empty table gives no rows.
    """
    key = random_key(F.col(id_col))
    ranges = max(1, -(-docs.count() // range_rows))
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"),
        F.xxhash64(text_col).alias("tie"), F.shiftright(F.shiftright(key, 20) * F.lit(ranges).cast("long"), 40).alias("range"),
        *([F.struct("*").alias("row")] if carry else []),
    )
    if not carry:  # the words are counted once, not for the sums and again for the order
        base = stash(base, "sizes")
    sums = base.groupBy("source", "range").agg(F.sum("size").alias("words"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    offsets = range_offsets(sums, "source", "range", "words").drop("words")
    plan = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.*", "source_size", "target")
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = base.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    b, p = placed.alias("b"), plan.alias("p")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("inside")))
    return b.join(p, F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.range") == F.col("p.range"))).select(
        "doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *(["row"] if carry else [])
    )


def mixed_documents(docs: DataFrame, **kwargs) -> DataFrame:
    """The mix as documents, a row for each copy, with the columns of `docs`.

    Documents are not cut here: the one that a source's budget ends in is taken whole if at least half of it is
    within the budget, so a source misses its target by half a document at most. Documents without words go.
    """
    copies = F.when(F.col("size") > 0, F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2))).otherwise(0).cast("int")
    taken = mix(docs, carry=True, **kwargs).select("row", copies.alias("copies"))
    return taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def mix_sql(weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> str:
    """The same in DuckDB SQL."""
    case = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return rf"""
    WITH a AS (
      SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
      FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM a GROUP BY source),
    w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {case} END AS DOUBLE) AS weight FROM s),
    l AS (
      SELECT *, {cap} * CAST(source_size AS DOUBLE) AS lim, {cap} * CAST(source_size AS DOUBLE) / weight AS ratio,
        (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum({cap} * CAST(source_size AS DOUBLE)) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW r AS (ORDER BY {cap} * CAST(source_size AS DOUBLE) / weight, source NULLS LAST)),
    x AS (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, source NULLS LAST LIMIT 1),
    t AS (SELECT source, source_size, least(lim, weight * x.level) AS target FROM l, x),
    b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
    p AS (
      SELECT doc_id, size, source_size, target,
        CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs,
        budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size AS rest,
        CAST(coalesce(sum(size) OVER (PARTITION BY a.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM a JOIN b ON a.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p"""
