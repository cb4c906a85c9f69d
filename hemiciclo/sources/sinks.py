"""Exports: JSON lines, JSON arrays, CSV and Parquet in shards; Spark's commit makes them whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("json", "jsonl", "csv", "parquet")


def json_line() -> Column:
    return F.to_json(F.struct("*"))


def flat(df: DataFrame) -> DataFrame:
    """Columns in order of name; arrays, maps and structs as JSON."""
    nested = ("array", "map", "struct")
    return df.select(*(F.to_json(F.col(f"`{n}`")).alias(n) if k.startswith(nested) else F.col(f"`{n}`") for n, k in sorted(df.dtypes)))


def export_records(df: DataFrame, output: str, *, format_name: str, batch_size: int = 1000) -> None:
    """Shards of at most `batch_size` rows; an existing output is never overwritten."""
    kind = format_name.casefold()
    if kind not in FORMATS:
        raise ValueError(f"no export format: {format_name}")
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    to = lambda d: d.write.mode("errorifexists").option("maxRecordsPerFile", batch_size)
    if kind == "jsonl":
        to(df).option("ignoreNullFields", "false").json(output)
    elif kind == "json":
        shards = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
        numbered = shards.withColumn("b", F.floor(F.col("i").bitwiseAND(F.lit((1 << 33) - 1)) / batch_size))
        arrays = numbered.groupBy("p", "b").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("r"))
        arrays.select(F.concat(F.lit("["), F.array_join("r.j", ","), F.lit("]")).alias("value")).write.mode("errorifexists").option("maxRecordsPerFile", 1).text(output)
    elif kind == "csv":
        to(flat(df)).option("header", "true").option("escape", '"').csv(output)
    else:
        to(df).option("compression", "zstd").parquet(output)


def read_export(spark, path: str, format_name: str, schema) -> DataFrame:
    kind = format_name.casefold()
    if kind == "csv":
        return spark.read.schema(",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted(schema, key=lambda f: f.name))).option("header", "true").option("escape", '"').csv(path)
    if kind == "json":
        return spark.read.text(path).select(F.explode(F.from_json("value", f"array<{schema.simpleString()}>")).alias("r")).select("r.*")
    return spark.read.schema(schema).json(path) if kind == "jsonl" else spark.read.parquet(path)
