"""More queries, of page texts, scans, source maps and model adapters; readers, engines and models are injected."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from hemiciclo.plans import extraction
from hemiciclo.plans.queries import query, read
from hemiciclo.sources import pages

S = "string"
QUALITY = r"greatest(0.0, 0.55 * least(1.0, len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')) / 30.0) + 0.45 * least(1.0, length({0}) / 400.0))"


def _objects(spark, sf):
    """Documents as bytes of two pages; every fifth is one that no reader can open."""
    t = F.col("text")
    body = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("%PDF BT ( Hola ) Tj (que) Tj ( ) Tj"), F.col("doc_id").cast(S))).otherwise(F.concat(F.regexp_replace(t, "\f", " "), F.lit("\f"), F.lit("pie de página "), F.col("doc_id").cast(S)))
    return read(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.encode(body, "UTF-8").alias("content"))


def _open(data: bytes) -> list[str]:
    if data.startswith(b"%PDF"):
        raise ValueError("damaged")
    return data.decode().split("\f")


def _second(data: bytes) -> list[str]:
    """A reader that finds the first page only, and not all of it in some documents."""
    first, foot = _open(data)
    return [first if int(foot.split()[-1]) % 2 else ""]


@query(rf"""
WITH d AS (SELECT doc_id, regexp_replace(text, '\f', ' ', 'g') AS t, doc_id % 2 = 1 AS twice, 'pie de página ' || doc_id AS foot FROM documents WHERE text IS NOT NULL),
q AS (SELECT *, {QUALITY.format("t")} AS q, {QUALITY.format("foot")} AS qf FROM d WHERE doc_id % 5 <> 0)
SELECT doc_id AS doc, CAST(1 AS INT) AS page, md5(t) AS digest, 'one' AS method, round(CASE WHEN trim(t) = '' THEN 0 WHEN twice THEN greatest(least(0.99, q), 0.92) ELSE least(0.99, q) END, 6) AS confidence, CASE WHEN trim(t) = '' THEN 'empty_page' WHEN twice THEN '' ELSE 'two_empty' END AS issues FROM q
UNION ALL SELECT doc_id, 2, md5(foot), 'one', round(least(0.99, qf), 6), 'two_empty' FROM q UNION ALL SELECT doc_id, 1, md5('Hola' || chr(10) || 'que'), 'literal', 0.3, 'literal_fallback' FROM d WHERE doc_id % 5 = 0""")
def page_readers(spark, sf):
    """The better of two readers' texts of each page; the literal text where neither reads the document."""
    found = pages.page_texts(_objects(spark, sf), ("one", _open), ("two", _second))
    return found.select("doc", "page", F.md5(F.col("text").cast("binary")).alias("digest"), "method", F.round("confidence", 6).alias("confidence"), F.array_join("issues", " ").alias("issues"))


@query(rf"""
WITH d AS (SELECT doc_id, regexp_replace(text, '\f', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN true WHEN trim(t) = '' THEN false WHEN doc_id % 2 = 1 THEN true ELSE length(trim(t)) >= 80 AND len(regexp_extract_all(t, '\S+')) >= 8 AND {QUALITY.format("t")} >= 0.7 END AS safe FROM d)
SELECT doc_id AS doc, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END AS pages, CASE WHEN safe AND doc_id % 3 = 0 THEN 'ok' ELSE 'needs_review' END AS status, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS scanned FROM s""")
def scanned_documents(spark, sf):
    """Scans stand for unsafe pages where they are as good: of each third document its last page, in two columns."""
    objects = _objects(spark, sf)
    page = F.when(F.col("doc") % 5 == 0, 1).otherwise(2)
    columns = np.full((120, 200), 255, np.uint8)
    columns[12:110:6, 10:90] = columns[12:110:6, 110:190] = 0
    image = bytes(columns.tobytes())
    images = objects.where("doc % 3 = 0").select("doc", page.alias("page"), F.lit(120).alias("height"), F.lit(200).alias("width"), F.lit(image).alias("pixels"))

    def engine(region: np.ndarray):
        side = "izquierda" if region.shape[1] < 100 else "derecha"
        return [(0, 30, 9, 39), (0, 10, 9, 19)], [f"segunda línea {side} " * 12, f"primera línea {side} " * 12], [0.9, 0.8]

    found = pages.page_texts(objects, ("one", _open), ("two", _second), pages.scan_pages(images, engine))
    scanned = found.groupBy("doc").agg(F.count_if((F.col("method") == "scan") & F.col("text").rlike(r"^primera línea (izquierda|derecha)[^\n]+\nsegunda")).alias("scanned"))
    return pages.document_status(found).join(scanned, "doc").select("doc", F.col("pages").cast("int").alias("pages"), "status", "scanned")


@query("""
SELECT vec_id, 'c' || vec_id || ' a b' AS said, round(0.25 + 0.5 + 0.75, 6) AS score FROM embeddings""")
def reading_orders(spark, sf):
    """Lines of an engine's parallel arrays, from top to bottom and left to right, blank ones left out."""
    box = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    texts = F.array(F.lit("b"), F.lit(" "), F.lit("a"), F.concat(F.lit("c"), F.col("vec_id").cast(S)))
    lines = pages.engine_lines(F.array(box(50, 20, 60, 30), box(0, 0, 1, 1), box(5, 20, 15, 30), box(90, 1, 99, 9)), texts, F.array(*map(F.lit, (0.25, 0.9, 0.5, 0.75))))
    ordered = pages.reading_order(lines)
    return read(spark, sf, "embeddings").select("vec_id", F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("said"), F.round(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["score"]), 6).alias("score"))


@query("""
SELECT p_partkey, CAST(8 AS INT) AS start, CAST(8 + length(p_name) + 2 * (length(p_name) - length(replace(p_name, ' ', ''))) AS INT) AS "end", CAST(1 + 2 * (length(p_name) - length(replace(p_name, ' ', ''))) AS BIGINT) AS runs, true AS exact FROM part""")
def source_maps(spark, sf):
    """Where a source with other white space says a text, and the exact place of each of its words and gaps."""
    said = F.replace("p_name", F.lit(" "), F.lit(" \n\t"))
    source = F.concat(F.lit("Número. "), said, F.lit(". Fin"))
    at = pages.located(source, F.col("p_name"))
    rows = read(spark, sf, "part").select("p_partkey", "p_name", source.alias("source"), at.alias("at"))
    rows = rows.withColumn("map", pages.source_map(F.substring("source", F.col("at.start") + 1, F.col("at.end") - F.col("at.start")), F.col("p_name")))
    piece = lambda c, a, b: F.substring(c, a + 1, b - a)
    alike = F.forall("map", lambda m: (m["kind"] == "space") | (piece(F.col("p_name"), m["content_start"], m["content_end"]) == piece(F.col("source"), F.col("at.start") + m["source_start"], F.col("at.start") + m["source_end"])))
    return rows.select("p_partkey", "at.start", "at.end", F.size("map").cast("long").alias("runs"), alike.alias("exact"))


@query("""
SELECT c_custkey, kind, value, CAST(start AS BIGINT) AS start FROM (
  SELECT c_custkey, 'ORG' AS kind, c_mktsegment AS value, 5 AS start FROM customer UNION ALL SELECT c_custkey, 'text', 'resumen ' || c_custkey, NULL FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 'place', 'NATION_' || c_nationkey, 9 + length(c_mktsegment) FROM customer)""")
def model_adapters(spark, sf):
    """Three kinds of model behind one interface: entities with their places, free text without any, a provider's JSON."""

    def entities(text: str) -> object:
        return SimpleNamespace(ents=[SimpleNamespace(text=text.split()[1], label_="ORG"), SimpleNamespace(text=text.split()[0], label_="OTHER")])

    def generate(instructions: str, text: str) -> str:
        n = int(text.split()[-1])
        return f"{instructions} {n}\n\n" if n % 2 == 0 else ""

    def call(model: str, prompt: str, schema: dict) -> str:
        place = prompt.split()[-2]
        assert schema["required"] == ["candidates"] and model == "m"
        return f'{{"candidates": [{{"kind": "place", "value": "{place}", "quote": "{place}", "confidence": 0.5}}]}}'

    texts = read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Casa "), "c_mktsegment", F.lit(" en NATION_"), F.col("c_nationkey").cast(S), F.lit(" "), F.col("c_custkey").cast(S)).alias("text"))
    out, task = None, extraction.Task("find", instructions="resumen")
    for backend in (extraction.entity_backend(entities, ("ORG",)), extraction.generative_backend(generate), extraction.provider_backend(call, "m")):
        found = extraction.model_candidates(texts, task, [backend], key="c_custkey").select("c_custkey", "kind", "value", F.array_min("evidence.start").alias("start"))
        out = found if out is None else out.union(found)
    return out
