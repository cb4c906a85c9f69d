"""Which resources to fetch, from what was fetched before: text documents of interventions, laws by year, profiles, votes by date, organs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.functions import urls
from hemiciclo.functions.ids import stable_id
from hemiciclo.operators import dedup

#: Lists that may be empty, and what each organ is fetched as.
EMPTY_SCOPES = frozenset({("PropuestasDeReforma", 0), ("PropuestasDeReforma", 1), ("PropuestasDeReforma", 4), ("PropuestasDeReforma", 11), ("PropuestasDeReforma", 13), ("ProyectosDeLey", 13)})
ORGAN_FORMATS = ("ajax", "json", "csv", "xml")
OWNERS = ("ProyectosDeLey", "ProposicionesDeLey", "PropuestasDeReforma")


def _explain(ok: Column, value: Column, kind: str, why: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(why)).cast(kind))


def text_resources(interventions: DataFrame) -> DataFrame:
    """interventions: document_id, full_text_url, pdf_url, ordinal. One resource a document (its last row counts), the full text before the PDF, each address once, in order."""
    last = dedup.last_per_key(interventions.where("document_id is not null"), ["document_id"], ["ordinal"])
    url = F.coalesce(F.nullif("full_text_url", F.lit("")), F.nullif("pdf_url", F.lit("")))
    kind = F.when(F.coalesce(F.nullif("full_text_url", F.lit("")), F.lit("")) != "", "html").otherwise("pdf")
    return last.select("document_id", F.regexp_replace(url, "#.*$", "").alias("url"), kind.alias("format")).where("url is not null").dropDuplicates(["url"]).orderBy("document_id", "url")


def law_years(page: Column, most: int | None = None) -> Column:
    """The years of a page's selector, newest first; none is an error."""
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(page, F.lit(r"<option[^>]*>\s*((?:19|20)\d\d)\s*<"), F.lit(1)), lambda y: y.cast("int"))), lambda a, b: b - a)
    kept = years if most is None else F.filter(years, lambda y: y <= most)
    return _explain(F.size(years) > 0, kept, "array<int>", "no years on the page")


def profile_resources(rows: DataFrame, legislature: int, base: str) -> DataFrame:
    """rows: codParlamentario, idLegislatura, apellidosNombre of an identity index. Missing codes, other legislatures and repeated codes are errors."""
    code = _explain(F.coalesce(F.col("codParlamentario").rlike(r"^\d+$"), F.lit(False)), F.col("codParlamentario"), "string", "a row without a numeric code")
    term = _explain(F.coalesce(F.col("idLegislatura") == legislature, F.lit(False)), F.col("idLegislatura"), "int", "a row of another legislature")
    out = rows.select(code.alias("code"), term.alias("legislature"), F.col("apellidosNombre").alias("full_name"))
    counted = out.groupBy("code", "legislature").agg(F.min("full_name").alias("full_name"), F.count("*").alias("n"))
    once = _explain(F.col("n") == 1, F.col("code"), "string", "a code stands twice")
    return counted.select(once.alias("code"), "legislature", "full_name", F.concat(F.lit(f"{base}/busqueda-de-diputados?codParlamentario="), "code", F.lit("&idLegislatura="), F.col("legislature").cast("string")).alias("url"))


def vote_resources(pages: DataFrame, legislature: int) -> DataFrame:
    """pages: page_url, links (ARRAY<STRUCT<text, url>>). Artifacts of votes and sessions of the legislature, each address once, in order."""
    link = pages.select("page_url", F.explode("links").alias("l")).select("page_url", F.col("l.url").alias("url")).withColumn("c", urls.vote_context(F.col("url")))
    mine = link.where((F.col("c.legislature").cast("int") == legislature) & F.col("c.session").isNotNull()).withColumn("format", urls.format_of(F.col("url"))).where(F.col("format").isin("json", "xml", "pdf", "zip", "png"))
    return mine.dropDuplicates(["url"]).select("page_url", "url", "format", F.when(F.col("c.vote").isNotNull(), "Votacion").otherwise("SesionVotaciones").alias("dataset"), F.col("c.session").alias("session"), F.col("c.day").alias("day"), F.col("c.vote").alias("vote_number")).orderBy("url")


def uncovered_dates(days: DataFrame, resources: DataFrame, summaries: DataFrame) -> DataFrame:
    """Planned days with neither a JSON vote nor a valid summary; there should be none."""
    covered = resources.where("format = 'json'").select("day").union(summaries.where("valid").select("day"))
    return days.select("day").distinct().join(covered, "day", "left_anti")


def summary_votes(text: Column) -> Column:
    """ARRAY<STRUCT<yes, no, abstentions>> of the blocks of a page's vote summary that has no data files."""
    block = r"(?is)s[ií]\s*:?\s*(\d+)\D{1,40}?no\s*:?\s*(\d+)\D{1,60}?abstenci[oó]n(?:es)?\s*:?\s*(\d+)"
    found = F.regexp_extract_all(text, F.lit(block), F.lit(0))
    part = lambda x, k: F.regexp_extract(x, block, k).cast("int")
    return F.transform(found, lambda x: F.struct(part(x, 1).alias("yes"), part(x, 2).alias("no"), part(x, 3).alias("abstentions")))


def summary_valid(votes: Column, members: int = 350) -> Column:
    return F.coalesce((F.size(votes) > 0) & F.forall(votes, lambda v: (v["yes"] + v["no"] + v["abstentions"]).between(1, members)), F.lit(False))


def supporting_resources(calendars: DataFrame, date_pages: DataFrame, variants: DataFrame) -> DataFrame:
    """url of calendar pages, date pages and variants that are not JSON, each once, in order."""
    return calendars.select("url").union(date_pages.select("url")).union(variants.where("format != 'json'").select("url")).distinct().orderBy("url")


def organ_descriptors(rows: DataFrame) -> DataFrame:
    """rows: name, sup, sub of an inventory: one descriptor a slug (sup-sub), the first by name."""
    return dedup.first_per_key(rows.withColumn("slug", F.concat_ws("-", "sup", "sub")), ["slug"], ["name"])


def organ_resources(descriptors: DataFrame, base: str) -> DataFrame:
    """Four resources a descriptor: the page's own data and the three exports."""
    rows = descriptors.select("slug", "name", F.explode(F.array(*map(F.lit, ORGAN_FORMATS))).alias("format"))
    return rows.withColumn("url", F.concat(F.lit(f"{base}/organos/"), "slug", F.lit("."), "format")).withColumn("resource_id", stable_id(F.col("slug"), F.col("format")))


def owner_resources(catalog: DataFrame, owners: Sequence[str] = OWNERS) -> DataFrame:
    """Exactly one JSON resource for each owner dataset, in the owners' order; anything else is an error."""
    counted = catalog.where(F.col("format") == "json").where(F.col("dataset").isin(*owners)).groupBy("dataset").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    rank = F.array_position(F.array(*map(F.lit, owners)), F.col("dataset"))
    whole = counted.agg(F.collect_list(F.struct(rank.alias("rank"), "dataset", "url", "n")).alias("r"))  # three rows
    ok = (F.size("r") == len(owners)) & F.forall("r", lambda x: x["n"] == 1)
    checked = whole.select(_explain(ok, F.array_sort("r"), "array<struct<rank: bigint, dataset: string, url: string, n: bigint>>", "not exactly one JSON resource for each owner").alias("r"))
    return checked.select(F.posexplode("r").alias("pos", "x")).select("x.dataset", "x.url")


def document_resources(assets: DataFrame, mime_types: Sequence[str] = ("application/pdf",)) -> DataFrame:
    """Assets of the wanted types, the last of each (dataset, url), in order."""
    return dedup.last_per_key(assets.where(F.col("mime_type").isin(*mime_types)), ["dataset", "url"], ["document_id"]).orderBy("dataset", "url")


def empty_is_expected(dataset: Column, legislature: Column) -> Column:
    out = F.lit(False)
    for d, n in sorted(EMPTY_SCOPES):
        out = out | ((dataset == d) & (legislature == n))
    return F.coalesce(out, F.lit(False))


def fallback_url(url: Column, host: str = "www.congreso.es") -> Column:
    """Where an official diary that is missing may stand as well; NULL for other addresses."""
    moved = F.when(F.contains(url, F.lit("/public_oficiales/L15/CONG/DS/")), F.replace(url, F.lit("/CONG/DS/"), F.lit("/CORT/DS/"))).when(F.contains(url, F.lit("/CORT/DS/")), F.replace(url, F.lit("/CORT/DS/"), F.lit("/CONG/DS/")))
    return F.when(urls.host(url) == host, moved)
