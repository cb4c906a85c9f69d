"""What the operators of this package share: the shared folder, bounded samples, tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hemiciclo.session import shared_dir

#: A word everywhere in this package: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of an Arrow batch where tasks read whole texts: a batch lies in the executor and in its Python worker at once.
TEXT_ROWS = 1_000
_held: dict[str, Callable[[], object]] = {}


def give_back() -> None:
    """Memory that this process has freed goes back to the system, where its allocator can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def hold(owner: str, forget: Callable[[], object]) -> None:
    """In a Python worker: what `owner` remembers from task to task may stay, what others left is forgotten, so that a worker that serves many stages holds one memory."""
    for other in [k for k in _held if k != owner]:
        _held.pop(other)()
    give_back()
    _held[owner] = forget


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send at most `rows` rows of a batch to Python, fewer if the session says so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stash(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs a reread. texts: its tasks send whole texts to Python."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with arrow_rows(df.sparkSession, TEXT_ROWS) if texts else contextlib.nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most `n` rows, those of the least xxhash64 of `key`: a bounded sample that reruns agree on.

    `key` must not repeat. Of larger tables only rows whose hash is below the share that leaves about 1.2 n are
    ordered, so however many tasks there are, no more rows meet in one.
    """
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(key)), 33)
    total = df.count()
    share = min(1.0, 1.2 * n / max(total, 1) + 100 / max(total, 1))
    return df.where(place < F.lit(int(share * (1 << 31)))).orderBy(place, key).limit(n)


def range_offsets(sums: DataFrame, group: str, at: str, value: str, fan: int = 1000) -> DataFrame:
    """sums: group (may be NULL), at (a whole number), value. Adds `offset`: the group's values at all lower places.

    In two levels, so that a group of very many places is no one task's: runs of `fan` places are summed, the runs' sums
    are added up along the group, the values along their run.
    """
    runs = sums.withColumn("_offset_run", F.floor(F.col(at) / fan))
    upto = W.unboundedPreceding, -1
    whole = runs.groupBy(group, "_offset_run").agg(F.sum(value).alias("_offset_sum"))
    whole = whole.select(F.col(group).alias("_offset_group"), F.col("_offset_run").alias("_offset_at"), F.coalesce(F.sum("_offset_sum").over(W.partitionBy(group).orderBy("_offset_run").rowsBetween(*upto)), F.lit(0)).alias("_offset_before"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(group, "_offset_run").orderBy(at).rowsBetween(*upto)), F.lit(0))
    found = runs.withColumn("_offset_inside", inside).join(whole, F.col(group).eqNullSafe(F.col("_offset_group")) & (F.col("_offset_run") == F.col("_offset_at")))
    return found.select(*sums.columns, (F.col("_offset_before") + F.col("_offset_inside")).alias("offset"))
