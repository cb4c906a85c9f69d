"""More queries, of the text, date, address and artifact functions: inputs are made from the tables' rows, the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemiciclo.functions import dates, ids, references, text, urls
from hemiciclo.operators import filters
from hemiciclo.plans import domains, speech
from hemiciclo.plans.queries import FOLD, query, read
from hemiciclo.sources import bronze, discovery, records

DAY = "CAST(o_orderdate AS DATE)"


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE {DAY} END AS java, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {DAY} END AS law,
  CASE WHEN o_orderkey % 2 = 0 THEN {DAY} ELSE DATE '2001-02-01' END AS first_day FROM orders""")
def java_and_law_dates(spark, sf):
    o, d, k = read(spark, sf, "orders"), F.to_date("o_orderdate"), F.col("o_orderkey")
    short = F.date_format(d, "d/M/yyyy")
    java = F.when(k % 4 == 0, short).when(k % 4 == 1, "sin fecha").otherwise(F.concat(F.lit("Alta: "), F.date_format(d, "EEE MMM dd"), F.lit(" 00:00:00 CET "), F.year(d).cast("string")))
    month = F.element_at(F.array(*(F.lit(m) for m in list(dates.MONTHS)[:9] + list(dates.MONTHS)[10:])), F.month(d))
    said = F.concat(F.lit(", de "), F.day(d).cast("string"), F.lit(" de "), F.initcap(month))
    title = F.concat(F.lit("Ley "), k.cast("string"), F.when(k % 3 == 0, "").when(k % 3 == 1, said).otherwise(F.concat(said, F.lit(" de "), F.year(d).cast("string"))), F.lit(", de 12 medidas"))
    record = F.create_map(F.lit("a"), F.when(k % 2 == 0, "").otherwise("1/2/2001"), F.lit("b"), short)
    return o.select("o_orderkey", dates.java_date(java).alias("java"), dates.law_date(title, F.year(d).cast("string")).alias("law"), dates.first_date(record, "a", "c", "b").alias("first_day"))


@query(rf"""
SELECT doc_id, source || '-' || lang AS token, md5({FOLD.format("text")}) AS folded, md5(trim(regexp_replace(regexp_replace(text, '[•·|]+', ' ', 'g'), '[\s ]+', ' ', 'g'))) AS line,
  md5(substr(text, 21, CAST(greatest(0, least(length(text), 200) - 20) AS BIGINT))) AS around, md5(text) AS repaired, md5(regexp_replace({FOLD.format("text")}, '[^a-z0-9]+', '', 'g')) AS compact FROM documents""")
def text_cleanup(spark, sf):
    t = F.col("text")
    damaged = F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")
    h = lambda c: F.md5(c.cast("binary"))
    return read(spark, sf, "documents").select(
        "doc_id", text.safe_token(F.concat(F.lit(" /"), "source", F.lit(" / "), "lang", F.lit("!"))).alias("token"), h(text.fold(t)).alias("folded"), h(text.clean_line(t)).alias("line"),
        h(text.evidence_window(t, F.lit(100), F.lit(120))).alias("around"), h(text.repair_mojibake(damaged)).alias("repaired"), h(text.compact(t)).alias("compact"),
    )


@query("""
SELECT p_partkey, lower(p_name) || ' don' AS key, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) > 2), ' ') AS tokens,
  lower(p_name) AS person, CASE WHEN p_size % 2 = 0 THEN 'ministro de hacienda' ELSE lower(p_name) END AS office FROM part""")
def speaker_names(spark, sf):
    raw = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit("), Don"))
    key = text.speaker_key(raw)
    heading = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("El señor MINISTRO DE HACIENDA ("), F.upper("p_name"), F.lit("):"))).otherwise(F.concat(F.lit("La señora "), F.upper("p_name"), F.lit(":")))
    return read(spark, sf, "part").select("p_partkey", key.alias("key"), F.array_join(text.speaker_match_tokens(raw), " ").alias("tokens"), text.speaker_key(F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))).alias("person"), speech.role_key(heading).alias("office"))


@query("""
SELECT o_orderkey, true AS padded, o_orderkey = o_custkey AS people, true AS letters, false AS nothing, o_orderstatus = 'F' AS contains, CAST(strftime(o_orderdate, '%Y%m%d') AS VARCHAR) AS day, o_orderkey % 2 = 0 AS valid FROM orders""")
def same_identifiers(spark, sf):
    k, same = F.col("o_orderkey").cast("string"), text.same_identifier
    day = F.date_format("o_orderdate", "yyyyMMdd")
    shown = F.when(F.col("o_orderkey") % 2 == 0, day).otherwise(F.concat(F.substring(day, 1, 4), F.lit("1341")))
    return read(spark, sf, "orders").select("o_orderkey", same(F.lpad(k, 12, "0"), k).alias("padded"), same(k, F.col("o_custkey").cast("string")).alias("people"), same(F.col("o_orderstatus"), F.lower("o_orderstatus")).alias("letters"), same(k, F.lit(None).cast("string")).alias("nothing"), text.contains_folded(F.concat(F.lit("Votación "), "o_orderstatus"), "votacion f").alias("contains"), day.alias("day"), filters.valid_day(shown).alias("valid"))


@query("""
SELECT o_orderkey, 'VOT_' || strftime(o_orderdate, '%Y%m%d') || '101112' AS dataset, strftime(o_orderdate, '%Y%m%d') || '101112' AS token, '15' AS legislature, CAST(o_custkey AS VARCHAR) AS session, strftime(o_orderdate, '%Y%m%d') AS day,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS vote, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'DSCD-15-PL-' || o_orderkey ELSE 'L5-ABC' || o_orderkey END AS document,
  'https://a.es/' || o_orderkey || '#page=2 https://b.es/y' AS links, 'https://www.congreso.es/x/' || o_orderkey AS canonical, CASE WHEN o_orderkey % 2 = 0 THEN 'https://www.congreso.es/public_oficiales/L15/CORT/DS/' || o_orderkey || '.PDF' END AS fallback FROM orders""")
def artifact_urls(spark, sf):
    k, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyyMMdd")
    folder = F.concat(F.lit("https://www.congreso.es/webpublica/opendata/votaciones/Leg15/Sesion"), F.col("o_custkey").cast("string"), F.lit("/"), day)
    url = F.concat(folder, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/Votacion"), k)).otherwise(""), F.lit("/VOT_"), day, F.lit("101112__es.json?x=1"))
    context = urls.vote_context(url)
    kind = F.col("o_orderkey") % 3
    full = F.when(kind == 0, F.concat(F.lit("https://www.congreso.es/t?p=1&_intervenciones_id_texto=("), k, F.lit(")")))
    pdf = F.when(kind == 1, F.concat(F.lit("https://www.congreso.es/public_oficiales/L15/CONG/DS/DSCD-15-PL-"), k, F.lit(".PDF#page=3"))).otherwise(F.concat(F.lit("https://www.congreso.es/L5/CONG/ABC"), k, F.lit(".pdf")))
    said = F.concat(F.lit("véase https://a.es/"), k, F.lit("\n #page=2 y https://b.es/y fin"))
    place = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "https://www.congreso.es/public_oficiales/L15/CONG/DS/").otherwise("https://otro.es/CONG/DS/"), k, F.lit(".PDF"))
    return read(spark, sf, "orders").select(
        "o_orderkey", urls.dataset_name(url).alias("dataset"), urls.snapshot_token(url).alias("token"), context["legislature"].alias("legislature"), context["session"].alias("session"), context["day"].alias("day"), context["vote"].alias("vote"),
        urls.document_id(full, pdf).alias("document"), F.array_join(urls.split_links(said), " ").alias("links"), urls.canonical_url(F.concat(F.lit("http://x.es/https://www.congreso.es:443/x/"), k, F.lit("#f")), "https://www.congreso.es").alias("canonical"), discovery.fallback_url(place).alias("fallback"),
    )


@query("""
SELECT o_orderkey, o_orderkey AS total, CAST(0 AS BIGINT) AS missing, lpad(CAST(o_orderkey % 900 + 100 AS VARCHAR), 3, '0') || '/' || lpad(CAST(o_custkey % 1000000 AS VARCHAR), 6, '0') || '/0000' AS number,
  CASE WHEN o_orderkey % 3 = 1 THEN '0007' END AS qualifier, '"' || o_orderstatus || '" y "x"' AS cell, CASE WHEN o_orderkey % 5 = 0 THEN '1' WHEN o_orderkey % 5 = 1 THEN '2' END AS gender FROM orders""")
def official_values(spark, sf):
    k = F.col("o_orderkey")
    number = F.concat_ws("/", (k % 900 + 100).cast("string"), (F.col("o_custkey") % 1000000).cast("string"), F.when(k % 3 == 1, "7").when(k % 3 == 2, "0"))
    reference = references.file_reference(number)
    full = F.when(k % 3 == 0, references.file_number(F.concat(number, F.lit("/0")))).otherwise(reference["file_number"])
    sex = F.element_at(F.array(*map(F.lit, ("Varón ", "MUJER", "no consta", "", "x"))), (k % 5 + 1).cast("int"))
    return read(spark, sf, "orders").select(
        "o_orderkey", records.total_of(F.concat(F.lit("Hay "), F.replace(F.format_number(k, 0), F.lit(","), F.lit(".")), F.lit(" resultados")), default=None).alias("total"), records.total_of(F.lit("ninguno"), default=0).alias("missing"),
        full.alias("number"), reference["qualifier"].alias("qualifier"), text.unwrap_csv_value(F.concat(F.lit('""'), "o_orderstatus", F.lit('"" y ""x""'))).alias("cell"), domains.gender(sex).alias("gender"),
    )


@query("""
SELECT p_partkey, p_size % 6 IN (0, 2, 3, 5) AS declared, p_size % 9 IN (0, 2, 4, 6, 8) AS content FROM part""")
def format_contracts(spark, sf):
    n = F.col("p_size")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (n % len(x) + 1).cast("int"))
    kind, declared = pick("json", "json", "pdf", "csv", "xml", "otro"), pick("Application/JSON; charset=utf-8", "text/html", "application/pdf", "text/csv", "text/csv", "x/y")
    body = pick('{"k": 1}', '{"k": ', "a;b\n1;2", "a;b\n1;2;3", "<r><a/></r>", "<error/>", "%PDF-1.7 x", "no pdf", "<!doctype html><html><body><p>Una página con bastante texto para valer de algo.</p></body></html>")
    return read(spark, sf, "part").select("p_partkey", bronze.content_type_valid(declared, kind).alias("declared"), bronze.format_valid(F.encode(F.concat(body, F.lit("")), "UTF-8"), pick("json", "json", "csv", "csv", "xml", "xml", "pdf", "pdf", "html")).alias("content"))


@query("""
SELECT o_orderkey, 'votos/' || o_orderstatus || '-x/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'latest' END || '-' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16)
  || CASE WHEN o_orderkey % 3 = 0 THEN '-' || substr(sha256('{"a":"' || o_orderkey || '","b":""}'), 1, 12) ELSE '' END || '.json' AS path FROM orders""")
def object_paths(spark, sf):
    k = F.col("o_orderkey").cast("string")
    body = bronze.request_parameters(F.create_map(F.lit("b"), F.lit(""), F.lit("a"), k))
    m = read(spark, sf, "orders").select(
        "o_orderkey", F.lit("votos").alias("family"), F.concat("o_orderstatus", F.lit(" x")).alias("dataset"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_date"), F.when(F.col("o_orderkey") % 2 == 0, k).alias("snapshot_token"),
        F.sha2(k, 256).alias("sha256"), F.when(F.col("o_orderkey") % 3 == 0, F.sha2(body, 256)).alias("request_parameters_sha256"), F.lit("json").alias("format"),
    )
    return m.select("o_orderkey", bronze.object_path().alias("path"))


@query("""
SELECT c_custkey, sha256('Ana|' || CASE WHEN c_nationkey = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END || '|true') AS of_values, sha256('Ana|' || c_nationkey) AS of_text, sha256('congreso|intervention|' || c_custkey || '|' || c_mktsegment) AS intervention,
  c_mktsegment || ', ' || c_name AS joined FROM customer""")
def identities(spark, sf):
    from hemiciclo.plans import declarations

    n = F.col("c_nationkey")
    return read(spark, sf, "customer").select(
        "c_custkey", ids.stable_id_of_values(F.lit(" Ana "), n, F.lit(True)).alias("of_values"), ids.stable_id("Ana", n.cast("string")).alias("of_text"), ids.stable_id("congreso", "intervention", F.col("c_custkey").cast("string"), F.col("c_mktsegment")).alias("intervention"),
        declarations.human_join(F.col("c_mktsegment"), F.lit(" "), F.col("c_name"), F.lit(None).cast("string")).alias("joined"),
    )
