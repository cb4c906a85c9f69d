"""Catalogues of source resources: from links, from request plans, from a Python data source with an injected transport."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hemiciclo.functions import urls

CATALOG = "family string, dataset string, format string, url string, snapshot_token string, legislature string, session string, vote_number string"
FORMATS = ("json", "csv", "xml", "html", "pdf", "zip")
BASE = "https://www.congreso.es"
#: The static transparency pages and the fixed organ codes.
TRANSPARENCY = (("organos", "Organos"), ("organos", "Mesa"), ("organos", "JuntaPortavoces"), ("organos", "DiputacionPermanente"), ("organos", "Comisiones"), ("transparencia", "RetribucionesCargosMesa"))
ORGAN_CODES = ("1", "300", "401", "402")


def resources_from_links(links: DataFrame) -> DataFrame:
    """links: family, text, url. Open-data files only; the first of each (family, url, format) stays."""
    url = F.col("url")
    context = urls.vote_context(url)
    rows = links.where(F.contains(url, F.lit("/webpublica/opendata/"))).withColumn("format", urls.format_of(url)).where(F.col("format").isin(*FORMATS))
    dataset = F.when(context["vote"].isNotNull(), "Votacion").when((F.col("format") == "zip") & context["session"].isNotNull(), "SesionVotaciones").otherwise(urls.dataset_name(url))
    return rows.select("family", dataset.alias("dataset"), "format", "url", urls.snapshot_token(url).alias("snapshot_token"), context["legislature"].alias("legislature"), context["session"].alias("session"), context["vote"].alias("vote_number")).dropDuplicates(["family", "url", "format"])


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A frozen catalogue: a bare list or an envelope with `resources`."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.when(F.col("v").startswith("["), F.col("v")).otherwise(F.get_json_object("v", "$.resources"))
    return text.select(F.explode(F.from_json(listed, f"array<struct<{CATALOG}>>")).alias("r")).select("r.*")


def union_catalogs(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates(["family", "dataset", "format", "url"])


def transparency_resources(spark: SparkSession, base: str = BASE) -> DataFrame:
    return spark.createDataFrame([(f, d, "html", f"{base}/{f}/{d}") for f, d in TRANSPARENCY], "family string, dataset string, format string, url string")


def select_resources(catalog: DataFrame, families: Sequence[str] = (), datasets: Sequence[str] = (), formats: Sequence[str] = ()) -> DataFrame:
    """Empty selections take all."""
    for column, values in (("family", families), ("dataset", datasets), ("format", formats)):
        if values:
            catalog = catalog.where(F.col(column).isin(*values))
    return catalog


def composition_requests(spark: SparkSession, legislatures: Sequence[int], scraped: DataFrame | None = None) -> DataFrame:
    """legislature x organ code: the fixed codes, 300 to 402, and those found on a page, in order of number."""
    codes = spark.createDataFrame([(c,) for c in ORGAN_CODES], "code string").union(spark.range(300, 403).select(F.col("id").cast("string")))
    codes = (codes if scraped is None else codes.union(scraped.select("code"))).distinct()
    terms = spark.createDataFrame([(n,) for n in legislatures], "legislature int")
    return terms.crossJoin(F.broadcast(codes)).orderBy("legislature", F.col("code").cast("int"))


def export_pages(totals: DataFrame, *, page: int = 100, most: int | None = None) -> DataFrame:
    """totals: legislature, total, filters (MAP). A request a page: file_index from 1, last_result, token of the filters; more than `most` is an error."""
    total = F.col("total")
    if most is not None:
        total = F.when(total > most, F.raise_error(F.concat(F.lit("total above the cap: "), total.cast("string"))).cast("long")).otherwise(total)
    body = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("filters"))))
    rows = totals.withColumn("total", total).where("total > 0").withColumn("file_index", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("total") / page))))
    return rows.withColumn("last_result", F.least(F.col("file_index") * page, F.col("total"))).withColumn("query_token", F.substring(F.sha2(body, 256), 1, 16))


def filter_body(filters: Mapping[str, Column | None], names: Sequence[str]) -> Column:
    """A request body with every field; blanks for those that are not asked for."""
    return F.create_map(*(x for n in names for x in (F.lit(n), F.lit("") if filters.get(n) is None else F.coalesce(filters[n].cast("string"), F.lit("")))))


def initiative_scopes(spark: SparkSession, detailed: Sequence[str], legislatures: Sequence[int], general: Sequence[int], laws: bool = True) -> DataFrame:
    """dataset x legislature of the historical lists, the general list, and approved laws."""
    rows = [(d, n) for d in detailed for n in legislatures] + [("GeneralInitiatives", n) for n in general] + ([("ApprovedLaws", None)] if laws else [])
    return spark.createDataFrame(rows, "dataset string, legislature int")


def list_pages(totals: DataFrame, *, page: int = 25) -> DataFrame:
    """totals: dataset, legislature, total: a row a page, one at least."""
    return totals.withColumn("page", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / page)))))


def vote_dates(content: Column) -> Column:
    """The days of a calendar's script, each once, in order; none is an error."""
    found = F.array_distinct(F.regexp_extract_all(F.regexp_extract(content, r"\[([\s\d,'\"]*)\]", 1), F.lit(r"\b(\d{8})\b"), F.lit(1)))
    return F.when(F.size(found) == 0, F.raise_error(F.lit("no vote dates")).cast("array<string>")).otherwise(found)


class _Page(InputPartition):
    def __init__(self, row: dict):
        self.row = row


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[dict], bytes]):
        self.rows, self.fetch = json.loads(options["resources"]), fetch

    def partitions(self) -> list[InputPartition]:
        return [_Page(r) for r in self.rows]

    def read(self, partition: _Page) -> Iterator[tuple]:
        import hashlib

        r = partition.row
        data = self.fetch(r)
        yield r["url"], r.get("format"), len(data), hashlib.sha256(data).hexdigest(), data


def resource_source(fetch: Callable[[dict], bytes], name: str = "hemiciclo_resources") -> type[DataSource]:
    """A data source over a plan of resources (option `resources`: JSON list), a partition each, read by `fetch`.

    The transport is the caller's: a client with its own pacing and retries, or a dictionary in tests. Acquire into
    a table once; a task that is run again fetches again.
    """

    class ResourceSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "url string, format string, bytes long, sha256 string, content binary"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options, fetch)

    return ResourceSource
