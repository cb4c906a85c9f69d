"""Audits of acquired sources: one aggregate row of counters and gates each; `passed` is whether all gates hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.functions import urls
from hemiciclo.operators import aggregates, joins
from hemiciclo.sources.bronze import content_type_valid


def _all(out: DataFrame, gates: Sequence[str]) -> DataFrame:
    every = F.lit(True)
    for g in gates:
        every = every & F.coalesce(F.col(g), F.lit(False))
    return out.withColumn("passed", every)


def manifest_states(manifests: DataFrame, host: str = "www.congreso.es") -> DataFrame:
    """One row: manifests with a bad status, an invalid payload, another hash, a type that is not their format's, a request that is not told whole, an address elsewhere.

    A POST names the hash of its parameters, a GET names none. Of columns that manifests do not have nothing is counted.
    """
    have = set(manifests.columns)
    post = F.upper(F.coalesce("request_method", F.lit("GET"))) == "POST" if "request_method" in have else F.lit(False)
    tests = {
        "bad_status": ({"status_code"}, lambda: F.col("status_code") != 200), "invalid": ({"valid"}, lambda: ~F.col("valid")), "bad_hash": ({"hash_valid"}, lambda: ~F.col("hash_valid")),
        "bad_type": ({"content_type", "format"}, lambda: ~content_type_valid(F.col("content_type"), F.col("format"))),
        "bad_request": ({"request_method", "request_parameters_sha256"}, lambda: post != F.col("request_parameters_sha256").isNotNull()),
        "foreign_url": ({"source_url"}, lambda: urls.host(F.col("source_url")) != host),
    }
    return manifests.agg(*(F.count_if(F.coalesce(test(), F.lit(True)) if needs <= have else F.lit(False)).alias(name) for name, (needs, test) in tests.items()))


#: Gates over manifest_states().
STATES = {"fetched": "bad_status", "intact": "invalid", "hashes_agree": "bad_hash", "types_agree": "bad_type", "requests_told": "bad_request", "official": "foreign_url"}


def organ_sources(expected: DataFrame, manifests: DataFrame, rows: DataFrame, formats: int = 3) -> DataFrame:
    """expected: slug, format. manifests: slug, format and what manifest_states() looks at. rows: slug, format, row_text (canonical).

    Gates: nothing missing, unexpected or twice; the manifests' states; each organ in all formats; the formats of an
    organ hold the same rows.
    """
    keys = joins.reconcile(expected, manifests, ["slug", "format"])
    states = manifest_states(manifests)
    prints = aggregates.ordered_fingerprint(rows, ["slug", "format"], F.col("row_text")).where(F.col("format") != "ajax")
    alike = prints.groupBy("slug").agg(F.count_distinct("bits", "n").alias("versions"), F.count("*").alias("formats"))
    same = alike.agg(F.count_if(F.col("versions") > 1).alias("different"), F.count_if(F.col("formats") < formats).alias("incomplete"))
    out = keys.crossJoin(states).crossJoin(same)  # one row each
    gates = {"complete": F.col("missing") == 0, "exact": F.col("unexpected") == 0, "unique": F.col("duplicates") == 0, "all_formats": F.col("incomplete") == 0, "formats_agree": F.col("different") == 0} | {g: F.col(c) == 0 for g, c in STATES.items()}
    return _all(out.withColumns(gates), list(gates))


def initiative_owners(records: DataFrame, owned: Mapping[str, Sequence[str]], legislature: str, manifests: DataFrame | None = None) -> DataFrame:
    """records: dataset, legislature, file_number. Counts and gates: all datasets there, one legislature, no number twice, prefixes owned by their dataset.

    manifests: dataset and what manifest_states() looks at; then each dataset has exactly one, of a good state.
    """
    prefix = F.regexp_extract("file_number", r"^(\d{3})/", 1)
    mine = F.lit(False)
    for d, prefixes in owned.items():
        mine = mine | ((F.col("dataset") == d) & prefix.isin(*prefixes))
    rows = records.withColumns({"_p": prefix, "_mine": F.coalesce(mine, F.lit(False))})
    twice = rows.groupBy("dataset", "legislature", "file_number").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"))
    whole = rows.agg(F.count("*").alias("records"), F.count_distinct("dataset").alias("datasets"), F.count_distinct("_p").alias("prefixes"), F.count_if(F.col("legislature") != legislature).alias("other_legislatures"), F.count_if(F.col("legislature").isNull()).alias("no_legislature"), F.count_if(~F.col("_mine")).alias("foreign_prefixes"), F.count_if(F.col("_p") == "").alias("malformed"))
    gates = {"some": F.col("records") > 0, "all_datasets": F.col("datasets") == len(owned), "one_legislature": F.col("other_legislatures") + F.col("no_legislature") == 0, "unique": F.col("duplicate_keys") == 0, "owned": F.col("foreign_prefixes") == 0, "well_formed": F.col("malformed") == 0}
    out = whole.crossJoin(twice)  # one row each
    if manifests is not None:
        each = manifests.groupBy("dataset").agg(F.count("*").alias("n")).agg(F.count_if((F.col("n") == 1) & F.col("dataset").isin(*owned)).alias("single_manifests"), F.count("*").alias("manifest_datasets"))
        out = out.crossJoin(each).crossJoin(manifest_states(manifests))
        gates |= {"one_manifest_each": (F.col("single_manifests") == len(owned)) & (F.col("manifest_datasets") == len(owned))} | {g: F.col(c) == 0 for g, c in STATES.items()}
    return _all(out.withColumns(gates), list(gates))


def owner_anomalies(records: DataFrame, legislature: str, n: int = 50) -> DataFrame:
    """The first `n` records that break a gate."""
    bad = F.when(F.col("legislature").isNull() | (F.col("legislature") != legislature), "legislature").when(~F.col("file_number").rlike(r"^\d{3}/\d{6}/\d{4}$"), "file_number")
    return records.withColumn("reason", bad).where("reason is not null").orderBy("reason", "dataset", "file_number").limit(n)


def profile_sources(index: DataFrame, profiles: DataFrame, planned: DataFrame, documents: DataFrame) -> DataFrame:
    """index, profiles: code; profiles with links too; planned, documents: url, code. Gates: profiles for the whole index, documents as planned, an address belongs to one person, each profile links something."""
    p = joins.reconcile(index.select("code"), profiles.select("code"), ["code"]).select(*(F.col(c).alias(f"profiles_{c}") for c in ("expected", "actual", "missing", "unexpected", "duplicates")))
    d = joins.reconcile(planned.select("url"), documents.select("url"), ["url"]).select(*(F.col(c).alias(f"documents_{c}") for c in ("expected", "actual", "missing", "unexpected", "duplicates")))
    owners = planned.groupBy("url").agg(F.count_distinct("code").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_documents"))
    bare = profiles.agg(F.count_if(F.coalesce(F.size("links"), F.lit(0)) < 1).alias("profiles_without_links"))
    gates = {"index_covered": F.col("profiles_missing") == 0, "no_other_profiles": F.col("profiles_unexpected") == 0, "profiles_unique": F.col("profiles_duplicates") == 0, "documents_complete": F.col("documents_missing") == 0, "no_other_documents": F.col("documents_unexpected") == 0, "documents_unique": F.col("documents_duplicates") == 0, "one_owner": F.col("shared_documents") == 0, "all_linked": F.col("profiles_without_links") == 0}
    return _all(p.crossJoin(d).crossJoin(owners).crossJoin(bare).withColumns(gates), list(gates))


def required_inventories(manifests: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: which of the inventories there are, and whether all."""
    return manifests.agg(F.array_sort(F.collect_set(F.when(F.col("dataset").isin(*names), F.col("dataset")))).alias("found")).withColumn("passed", F.size("found") == len(set(names)))


def discovery_state(requested: DataFrame, dates: DataFrame, pages: DataFrame, variants: DataFrame, *, calendars: DataFrame | None = None, completed: DataFrame | None = None, resources: DataFrame | None = None, unstructured: DataFrame | None = None) -> DataFrame:
    """requested: legislature. dates: legislature, day. pages: day, url. variants: day, url, page_url. Counts that must be 0, and `passed`.

    calendars: legislature, day of the whole calendars. completed: day. resources: legislature, day, url, format.
    unstructured: day of those without data files. Each brings its own counts.
    """
    n = lambda df, name: df.agg(F.count("*").alias(name))
    twice = lambda df, keys: df.groupBy(*keys).count().where("count > 1")
    parts = [
        n(dates.join(requested, "legislature", "left_anti"), "foreign_dates"), n(requested.join(dates, "legislature", "left_anti"), "legislatures_without_dates"), n(twice(dates, ["legislature", "day"]), "duplicate_dates"),
        n(dates.where(~F.coalesce(F.col("day").rlike(r"^\d{8}$") & F.try_to_date("day", "yyyyMMdd").isNotNull(), F.lit(False))), "invalid_dates"), n(pages.join(dates, "day", "left_anti"), "foreign_pages"), n(twice(pages, ["url"]), "duplicate_pages"),
        n(variants.join(pages.select(F.col("url").alias("page_url")), "page_url", "left_anti"), "variants_without_page"), n(twice(variants, ["url"]), "duplicate_variants"), n(dates.join(pages, "day", "left_anti"), "dates_without_page"),
    ]
    parts.append(n(variants.join(dates, "day", "left_anti"), "foreign_variants"))
    if calendars is not None:
        known = calendars.select("legislature", "day")
        parts += [n(dates.join(known, ["legislature", "day"], "left_anti"), "dates_off_calendar"), n(twice(known, ["legislature", "day"]), "duplicate_calendar_days"), n(requested.join(known, "legislature", "left_anti"), "empty_calendars")]
    if completed is not None:
        parts += [n(completed.join(dates, "day", "left_anti"), "unplanned_completed"), n(twice(completed, ["day"]), "duplicate_completed"), n(completed.join(pages, "day", "left_anti"), "completed_without_page")]
    if resources is not None:
        parts += [n(twice(resources, ["url"]), "duplicate_resources"), n(resources.join(requested, "legislature", "left_anti"), "foreign_resources"), n(resources.where(~F.col("format").isin("json", "xml", "pdf", "zip", "png")), "odd_resources"), n(resources.join(dates, ["legislature", "day"], "left_anti"), "unplanned_resources")]
        if completed is not None:
            parts.append(n(resources.join(completed, "day", "left_anti"), "resources_of_open_dates"))
            covered = resources.where("format = 'json'").select("day")
            covered = covered if unstructured is None else covered.union(unstructured.select("day"))
            parts.append(n(completed.join(covered, "day", "left_anti"), "completed_without_votes"))
    if unstructured is not None:
        parts += [n(unstructured.join(dates, "day", "left_anti"), "foreign_unstructured"), n(twice(unstructured, ["day"]), "duplicate_unstructured")]
        if resources is not None:
            parts.append(n(unstructured.join(resources.where("format = 'json'"), "day", "left_semi"), "unstructured_with_json"))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.withColumn("passed", sum((F.col(c) for c in out.columns), F.lit(0)) == 0)


def completion(results: DataFrame, expected: Column) -> DataFrame:
    """One row of a run: records, failures, whether it is complete (as many as expected, nothing failed)."""
    return results.agg(F.count("*").alias("records"), F.count_if(F.col("error").isNotNull()).alias("failures")).withColumn("complete", (F.col("records") == expected) & (F.col("failures") == 0))
