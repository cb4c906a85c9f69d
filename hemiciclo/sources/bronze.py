"""Stored source artifacts: paths, checks against their manifests, format contracts."""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemiciclo.functions.ids import canonical_json
from hemiciclo.functions.text import safe_token

#: Declared types that go with each format, and pages that are errors.
CONTENT_TYPES = {
    "json": ("application/json", "text/json", "text/plain", "application/octet-stream"), "csv": ("text/csv", "application/csv", "text/plain", "application/octet-stream"),
    "xml": ("application/xml", "text/xml"), "html": ("text/html", "application/xhtml+xml"), "pdf": ("application/pdf",), "zip": ("application/zip", "application/x-zip-compressed"),
}
ERROR_PAGES = ("access denied", "acceso denegado", "service unavailable", "servicio no disponible", "internal server error", "error 404", "página no encontrada", "pagina no encontrada")
ERROR_ROOTS = frozenset({"body", "error", "exception", "fault", "html", "login", "serviceunavailable"})


def _json(data: bytes) -> bool:
    return isinstance(json.loads(data.decode("utf-8-sig")), (dict, list))


def _html(data: bytes) -> bool:
    page = data.decode("utf-8-sig", "replace").casefold()
    body = re.search(r"<body\b[^>]*>(.*\S.*)</body\s*>", page, re.S)
    shown = " ".join(re.sub(r"<[^>]+>", " ", page).split())
    return bool(re.search(r"<(!doctype\s+html|html|body)\b", page) and body and len(shown) >= 40 and not (len(shown) < 2000 and any(e in shown for e in ERROR_PAGES)))


def _xml(data: bytes) -> bool:
    if b"<!ENTITY" in data:
        return False
    return ET.fromstring(data).tag.rpartition("}")[2].casefold() not in ERROR_ROOTS


def _csv(data: bytes) -> bool:
    if b"\0" in data or not data.strip():
        return False
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("cp1252")
    first = text.split("\n", 1)[0]
    widths = {len(r) for r in csv.reader(io.StringIO(text), delimiter=max(";,\t|", key=first.count)) if r}
    return len(widths) == 1 and widths.pop() >= 2


def _zip(data: bytes) -> bool:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = z.infolist()
        unsafe = any(p.flag_bits & 1 or p.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", p.filename) for p in parts)
        return bool(parts) and not unsafe and sum(p.file_size for p in parts) <= 200 * max(1, len(data))


CONTRACTS = {"json": _json, "html": _html, "htm": _html, "xml": _xml, "csv": _csv, "zip": _zip, "pdf": lambda d: b"%PDF-" in d[:1024], "png": lambda d: d.startswith(b"\x89PNG\r\n\x1a\n")}


def keeps_contract(data: bytes | None, kind: str | None) -> bool:
    """Whether bytes look like their format; unknown formats only must not be empty."""
    try:
        return bool(data) and CONTRACTS.get((kind or "").casefold(), bool)(data)
    except (ValueError, ET.ParseError, zipfile.BadZipFile, csv.Error):
        return False


@F.arrow_udf(T.BooleanType())
def format_valid(data: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for contents, kinds in data:
        yield pa.array([keeps_contract(c, k) for c, k in zip(contents.to_pylist(), kinds.to_pylist(), strict=True)], pa.bool_())


def content_type_valid(content_type: Column, kind: Column) -> Column:
    """A declared type that goes with the format; formats without a list take any, none declared is false."""
    declared = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    out = F.lit(True)
    for name, types in CONTENT_TYPES.items():
        out = F.when(F.lower(kind) == name, declared.isin(*types)).otherwise(out)
    return (declared != "") & out


def object_path() -> Column:
    """family/dataset/date/token-hash.format of a manifest; a request body adds 12 digits of its hash."""
    body = F.when(F.col("request_parameters_sha256").isNotNull(), F.concat(F.lit("-"), F.substring("request_parameters_sha256", 1, 12))).otherwise("")
    name = F.concat(F.coalesce("snapshot_token", F.lit("latest")), F.lit("-"), F.substring("sha256", 1, 16), body, F.lit("."), F.col("format"))
    return F.concat_ws("/", safe_token(F.col("family")), safe_token(F.col("dataset")), F.col("run_date"), name)


def request_parameters(parameters: Column) -> Column:
    return canonical_json(parameters)


def read_objects(spark: SparkSession, root: str, *, most: int = 256 << 20, pattern: str = "*") -> DataFrame:
    """path, length, sha256, content of the files below `root` of at most `most` bytes; length and path are read without the content where it is not used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.where(F.col("length") <= most).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def checked(manifests: DataFrame, objects: DataFrame, *, checksum: bool = True) -> DataFrame:
    """Manifests with `valid`: the object is there, its size, format and, on demand, hash agree."""
    o = objects.select(F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("sha256").alias("_sha"), F.col("content").alias("_content"))
    both = manifests.join(o, F.substring_index("_path", "/", -4) == F.col("bronze_path"), "left")
    good = (F.col("_length") == F.col("bytes")) & format_valid(F.col("_content"), F.col("format"))
    if checksum:
        good = good & (F.col("_sha") == F.col("sha256"))
    return both.withColumn("valid", F.coalesce(good, F.lit(False))).drop("_path", "_length", "_sha", "_content")


def persist(fetched: DataFrame, root: str) -> DataFrame:
    """fetched: family, dataset, run_date, source_url, format, sha256, content. Appends what the store does not have yet, by address and hash; returns the manifests of all that was fetched.

    `fetched` is read twice, so it should be a table or cached, not a plan that fetches. Partitions are family, dataset and date; Spark's commit makes an append whole or absent, and a second run adds nothing.
    """
    spark = fetched.sparkSession
    keys = ["source_url", "sha256"]
    once = fetched.dropDuplicates(keys).withColumn("bytes", F.length("content").cast("long"))
    try:
        known = spark.read.parquet(root).select(*keys)
    except AnalysisException:  # nothing is stored yet
        known = once.select(*keys).limit(0)
    once.join(known, keys, "left_anti").write.mode("append").partitionBy("family", "dataset", "run_date").parquet(root)
    stored = spark.read.schema(once.schema).parquet(root)
    return stored.join(once.select(*keys), keys, "left_semi").drop("content")
