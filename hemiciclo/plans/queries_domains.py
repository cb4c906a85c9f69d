"""More queries, of the domain projections: official records, lists, payloads and pages are made from the tables' rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemiciclo.plans import declarations, domains
from hemiciclo.plans.queries import query, read
from hemiciclo.sources import records

S = "string"


def _map(**fields: Column) -> Column:
    return F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v)))


def _raw(df, record: Column, key: str):
    return df.select(record.alias("record"), F.col(key).cast(S).alias("source_sha256"), F.lit("2024-06-15").alias("snapshot_date"))


@query("""
SELECT c_custkey, sha256(c_name || '|15/06/2020|Inicial|Cargo||' || c_mktsegment || '|||' || c_phone || '|' || c_custkey || ' cargos|') AS interest_id, sha256(c_name) AS deputy_id, c_name AS full_name, DATE '2020-06-15' AS registered_at,
  c_mktsegment AS employer, c_phone AS benefactor, c_custkey || ' cargos' AS description FROM (SELECT *, CAST(c_nationkey AS VARCHAR) AS c_phone FROM customer)""")
def interest_rows(spark, sf):
    c = read(spark, sf, "customer")
    record = _map(Nombre=F.col("c_name"), FechaRegistro=F.lit("15/06/2020"), Declaracion=F.lit("Inicial"), Tipo=F.lit("Cargo"), Empleador=F.concat(F.lit(" "), "c_mktsegment"), Benefactor=F.col("c_nationkey").cast(S), Descripcion=F.concat(F.col("c_custkey").cast(S), F.lit("  cargos")))
    rows = domains.interests(_raw(c, record, "c_custkey"))
    return rows.select(F.col("source_file_sha256").cast("long").alias("c_custkey"), "interest_id", "deputy_id", "full_name", "registered_at", "employer", "benefactor", "description")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN sha256('congreso|initiative|XV|' || n || '/0000') ELSE sha256('ApprovedLaws|' || leg || '|' || o_orderkey || '|Ley ' || o_orderkey || '|' || d || '|b|') END AS initiative_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'XV' ELSE leg END AS legislature, CASE WHEN o_orderkey % 2 = 0 THEN 'Asunto ' ELSE 'Ley ' END || o_orderkey AS subject, CASE WHEN o_orderkey % 2 = 0 THEN n || '/0000' ELSE CAST(o_orderkey AS VARCHAR) END AS file_number,
  CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderdate AS DATE) END AS law_date, CASE WHEN o_orderkey % 2 = 0 THEN '121/000007/0000 122/000009/0001' ELSE '' END AS origin, CASE WHEN o_orderkey % 2 = 0 THEN 'https://a.es/' || o_orderkey || '#p1' ELSE '' END AS links
FROM (SELECT *, '121/' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS n, strftime(o_orderdate, '%d/%m/%Y') AS d,
  CASE WHEN o_orderdate >= DATE '2000-04-05' THEN 'VII' WHEN o_orderdate >= DATE '1996-03-27' THEN 'VI' WHEN o_orderdate >= DATE '1993-04-13' THEN 'V' WHEN o_orderdate >= DATE '1989-11-21' THEN 'IV' ELSE 'III' END AS leg FROM orders)""")
def initiative_rows(spark, sf):
    o, k = read(spark, sf, "orders"), F.col("o_orderkey").cast(S)
    project = _map(
        Legislatura=F.lit("XV"), Objeto=F.concat(F.lit("Asunto "), k), NumExpediente=F.concat(F.lit("121/"), (F.col("o_orderkey") % 1000000).cast(S)), IniciativasDeOrigen=F.lit("121/7 y 122/9/1, otra vez 121/7"),
        EnlacesBOCG=F.concat(F.lit("https://a.es/"), k, F.lit(" #p1 nada")),
    )
    law = _map(Numero_ley=k, Titulo_ley=F.concat(F.lit("Ley "), k), Fecha_ley=F.date_format("o_orderdate", "dd/MM/yyyy"), Numero_boletin=F.lit("b"))
    rows = domains.initiatives(_raw(o.where("o_orderkey % 2 = 0"), project, "o_orderkey"), "ProyectosDeLey").unionByName(domains.initiatives(_raw(o.where("o_orderkey % 2 = 1"), law, "o_orderkey"), "ApprovedLaws"))
    return rows.select(F.col("source_file_sha256").cast("long").alias("o_orderkey"), "initiative_id", "legislature", "subject", "file_number", "law_date", F.array_join("origin_file_numbers", " ").alias("origin"), F.array_join("bocg_links", " ").alias("links"))


@query("""
SELECT o_orderkey, 'Leg.' || (o_orderkey % 15 + 1) AS "LEGISLATURA", CASE WHEN g THEN 'Iniciativas' ELSE 'Iniciativas legislativas' END AS "SUPERTIPO", CASE WHEN g THEN o_orderstatus ELSE 'Proyectos de ley' END AS "AGRUPACION",
  CASE WHEN g THEN o_orderstatus ELSE 'Proyecto de ley' END AS "TIPO", 'T' || o_orderkey AS "OBJETO", lpad(CAST(121 + o_orderkey % 3 AS VARCHAR), 3, '0') || '/' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || '/0000' AS "NUMEXPEDIENTE"
FROM orders, (VALUES (true), (false)) AS v(g) WHERE NOT g OR o_orderkey % 3 <> 0""")
def historical_lists(spark, sf):
    """The lists' own envelopes, half with a map and half with an array of entries; the general list leaves out the prefix that a dataset owns."""
    k = F.col("o_orderkey")
    item = F.struct(F.concat_ws("/", (k % 3 + 121).cast(S), (k % 1000000).cast(S)).alias("id_iniciativa"), (k % 15 + 1).cast(S).alias("legislatura"), F.concat(F.lit("T"), k.cast(S)).alias("titulo"), F.col("o_orderstatus").alias("atis"), k.cast(S).alias("key"))
    content = F.when(k % 2 == 0, F.to_json(F.struct(F.array(item).alias("lista_iniciativas")))).otherwise(F.to_json(F.struct(F.create_map(F.lit("i1"), item).alias("lista_iniciativas"))))
    envelopes = read(spark, sf, "orders").select(F.concat(F.lit("﻿"), content).alias("content"), k.cast(S).alias("source_sha256"), F.lit("2024-06-15").alias("snapshot_date"))
    items = records.historical_items(envelopes)
    rows = domains.historical_initiatives(items, "GeneralInitiatives", ("121",)).unionByName(domains.historical_initiatives(items, "ProyectosDeLey"))
    names = ("LEGISLATURA", "SUPERTIPO", "AGRUPACION", "TIPO", "OBJETO", "NUMEXPEDIENTE")
    return rows.select(F.col("source_sha256").cast("long").alias("o_orderkey"), *(F.element_at("record", n).alias(n) for n in names))


@query("""
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS law_number, CASE WHEN o_orderkey % 2 = 0 THEN 'Ley Organica' ELSE 'X' END AS type, CAST(o_orderdate AS DATE) AS law_date,
  CASE WHEN o_orderdate >= DATE '2000-04-05' THEN 'VII' WHEN o_orderdate >= DATE '1996-03-27' THEN 'VI' WHEN o_orderdate >= DATE '1993-04-13' THEN 'V' WHEN o_orderdate >= DATE '1989-11-21' THEN 'IV' ELSE 'III' END AS legislature,
  CASE WHEN o_orderkey % 2 = 0 THEN 'https://www.congreso.es/constitucion/ficheros/leyes_espa/l_' || o_orderkey || '.pdf' END AS pdf_url FROM orders""")
def approved_law_rows(spark, sf):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    months = F.array(*(F.lit(m) for m in ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")))
    title = F.concat(F.lit("Ley "), k.cast(S), F.lit(", de "), F.day(d).cast(S), F.lit(" de "), F.element_at(months, F.month(d)), F.lit(" de "), F.year(d).cast(S), F.lit(", de cosas"))
    law = F.struct(k.cast(S).alias("numLey"), F.when(k % 2 == 0, F.concat(F.lit("l_"), k.cast(S), F.lit(".pdf "))).otherwise("").alias("pdf"), title.alias("titulo"))
    payloads = read(spark, sf, "orders").select(F.create_map(F.when(k % 2 == 0, "LO").otherwise("X"), F.array(law)).alias("data"), k.cast(S).alias("source_sha256"), F.lit("2024-06-15").alias("snapshot_date"))
    return domains.approved_laws(payloads).select(F.col("source_sha256").cast("long").alias("o_orderkey"), "law_number", "type", "law_date", "legislature", "pdf_url")


@query("""
SELECT o_orderkey, sha256('XV|' || d || '|Pleno||' || o_orderstatus || '|09:00||||180/7/2|https://a.es/t?_intervenciones_id_texto=(' || o_orderkey || ')|') AS intervention_id, 'Leg.15' AS legislature, CAST(o_orderdate AS DATE) AS session_date,
  o_orderstatus AS speaker, '09:00' AS starts_at, '180/000007/0000' AS file_number, '0002' AS file_qualifier, CAST(o_orderkey AS VARCHAR) AS document_id FROM (SELECT *, strftime(o_orderdate, '%d/%m/%Y') AS d FROM orders)""")
def intervention_rows(spark, sf):
    link = F.concat(F.lit("https://a.es/t?_intervenciones_id_texto=("), F.col("o_orderkey").cast(S), F.lit(")"))
    record = _map(LEGISLATURA=F.lit("XV"), FECHA=F.date_format("o_orderdate", "dd/MM/yyyy"), NOMBRESESION=F.lit("Pleno"), ORADOR=F.col("o_orderstatus"), HORAINICIO=F.lit("09:00"), NUMEROEXPEDIENTE=F.lit("180/7/2"), ENLACETEXTOINTEGRO=link)
    rows = domains.interventions(_raw(read(spark, sf, "orders"), record, "o_orderkey"))
    return rows.select(F.col("source_file_sha256").cast("long").alias("o_orderkey"), "intervention_id", "legislature", "session_date", "speaker", "starts_at", "file_number", "file_qualifier", "document_id")


@query("""
SELECT l_orderkey AS file, CAST(ordinal AS INT) AS ordinal, l_partkey, sha256(l_orderkey || '|' || ordinal) AS occurrence_id FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ordinal FROM lineitem)""")
def occurrence_rows(spark, sf):
    files = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("records")).select(F.col("l_orderkey").cast(S).alias("source_sha256"), "records")
    return domains.occurrences(files).select(F.col("source_sha256").cast("long").alias("file"), "ordinal", "record.l_partkey", "occurrence_id")


@query("""
WITH j AS (SELECT o_orderkey, o_orderdate, o_custkey, unnest([1, 2, 3, 4]) AS item_order FROM orders),
e AS (SELECT *, sha256('Congreso|vote_event|XV|' || o_custkey || '|' || o_orderkey || '|' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS vote_id FROM j)
SELECT vote_id, o_orderkey, CAST(item_order AS INT) AS item_order, CASE item_order WHEN 1 THEN 'primary' ELSE 'joint' END AS kind, CASE item_order WHEN 1 THEN 'Texto' ELSE 'C' || item_order END AS item_text,
  sha256('Congreso|vote_item|' || vote_id || '|' || item_order || '|' || CASE item_order WHEN 1 THEN 'primary' ELSE 'joint' END) AS vote_item_id, CASE WHEN o_orderkey % 2 = 0 THEN 'assent' ELSE 'recorded_vote' END AS decision_method,
  CASE WHEN o_orderkey % 2 = 0 THEN 'official_json_assent' ELSE 'official_json_totals_only' END AS source_mode FROM e WHERE item_order <> 3""")
def vote_item_rows(spark, sf):
    """The third text is blank: it keeps its number and has no row."""
    o = read(spark, sf, "orders")
    joint = F.array(*(F.struct(F.lit(t).alias("textoExpediente")) for t in (" C2", "  ", "C4 ")))
    votes = o.select(
        F.lit("XV").alias("legislature"), F.col("o_orderkey").cast(S).alias("source_url"), F.lit(None).cast("array<struct<asiento: string, diputado: string, grupo: string, voto: string>>").alias("votaciones"),
        F.struct(F.date_format("o_orderdate", "d/M/yyyy").alias("fecha"), F.col("o_custkey").alias("sesion"), F.col("o_orderkey").alias("numeroVotacion"), F.lit("t").alias("titulo"), F.lit("Texto").alias("textoExpediente"), F.lit("s").alias("tituloSubGrupo"), joint.alias("votacionesConjuntas")).alias("informacion"),
        F.struct(F.lit(1).alias("presentes"), F.lit(1).alias("afavor"), F.lit(0).alias("enContra"), F.lit(0).alias("abstenciones"), F.lit(0).alias("noVotan"), F.when(F.col("o_orderkey") % 2 == 0, " SÍ ").otherwise("No").alias("asentimiento")).alias("totales"),
    )
    items = domains.vote_items(votes).select("vote_id", F.col("source_url").cast("long").alias("o_orderkey"), "item_order", F.col("source_item_kind").alias("kind"), "item_text", "vote_item_id")
    return items.join(domains.vote_events(votes).select("vote_id", "decision_method", "source_mode"), "vote_id")


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_suppkey AS VARCHAR) AS who, sha256('Congreso|vote_event|XV|1|' || l_orderkey || '|2024-01-02') AS vote_id FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, vote_id, sha256('Congreso|nominal_vote|' || vote_id || '|S' || who) AS nominal_vote_id, 'S' || who AS deputy_name, CASE WHEN l_linenumber % 2 = 0 THEN 'Sí' ELSE 'No' END AS vote FROM v""")
def nominal_vote_rows(spark, sf):
    ballot = F.struct(F.concat_ws(":", *(F.col(c).cast(S) for c in ("l_linenumber", "l_partkey", "l_suppkey"))).alias("asiento"), F.concat(F.lit("S"), F.col("l_suppkey").cast(S)).alias("diputado"), F.lit("G").alias("grupo"), F.when(F.col("l_linenumber") % 2 == 0, "Sí").otherwise("No").alias("voto"))
    votes = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(ballot).alias("votaciones")).select(
        F.lit("XV").alias("legislature"), F.col("l_orderkey").cast(S).alias("source_url"), "votaciones", F.struct(F.lit("2/1/2024").alias("fecha"), F.lit(1).alias("sesion"), F.col("l_orderkey").alias("numeroVotacion")).alias("informacion"))
    part = lambda k: F.split("seat", ":")[k].cast("long")
    return domains.nominal_votes(votes).select(F.col("source_url").cast("long").alias("l_orderkey"), part(0).cast("int").alias("l_linenumber"), part(1).alias("l_partkey"), part(2).alias("l_suppkey"), "vote_id", "nominal_vote_id", "deputy_name", "vote")


@query("""
WITH m AS (SELECT c_custkey, c_name, c_mktsegment, CASE c_nationkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '401' WHEN 2 THEN '310' ELSE 'x' END AS code FROM customer)
SELECT c_custkey, code AS organ_code, sha256(code) AS organ_id, CASE code WHEN '1' THEN 'Mesa' WHEN '401' THEN 'Diputación Permanente - titulares' END AS organ_name, CASE code WHEN '1' THEN 'governing_body' WHEN '401' THEN 'permanent_deputation' WHEN '310' THEN 'commission' END AS organ_type,
  sha256('15|' || sha256(code) || '|' || c_name || '|Vocal|01/02/2024|') AS membership_id, sha256(c_name) AS deputy_id, DATE '2024-02-01' AS started_at, CAST(NULL AS DATE) AS ended_at, c_mktsegment AS parliamentary_group FROM m""")
def organ_membership_rows(spark, sf):
    code = F.element_at(F.array(*map(F.lit, ("1", "401", "310", "x"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    member = F.struct(F.col("c_name").alias("apellidosNombre"), F.lit("Vocal").alias("descCargo"), F.col("c_mktsegment").alias("siglas"), F.lit("01/02/2024").alias("fechaAltaFormat"), F.lit("").alias("fechaBajaFormat"))
    url = F.concat(F.lit("https://x.es/o?_organos_selectedSuborgano="), code, F.lit("&_organos_selectedLegislatura=15&n="), F.col("c_custkey").cast(S))
    rows = domains.organ_memberships(read(spark, sf, "customer").select(url.alias("source_url"), F.array(member).alias("data")))
    return rows.select(F.regexp_extract("source_url", r"n=(\d+)", 1).cast("long").alias("c_custkey"), "organ_code", "organ_id", "organ_name", "organ_type", "membership_id", "deputy_id", "started_at", "ended_at", "parliamentary_group")


@query("""
WITH l AS (SELECT c_custkey AS pos, CASE c_custkey % 4 WHEN 0 THEN 'Comisión de ' || c_mktsegment WHEN 1 THEN 'Mesa' WHEN 2 THEN 'Secretaría General' ELSE 'Otra' END AS text,
  CASE c_custkey % 4 WHEN 0 THEN 'https://x.es/c?_organos_codComision=' || c_nationkey ELSE 'https://x.es/' || (c_custkey % 4) || '/' || c_nationkey END AS url, c_custkey % 4 AS k, c_nationkey FROM customer),
o AS (SELECT *, sha256(CASE WHEN k = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE url END) AS organ_id, row_number() OVER (PARTITION BY CASE WHEN k = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE url END ORDER BY pos DESC) AS r FROM l WHERE k <> 3)
SELECT organ_id, text AS name, CASE k WHEN 0 THEN 'commission' WHEN 1 THEN 'governing_body' ELSE 'administration' END AS organ_type, url FROM o WHERE r = 1""")
def organ_link_rows(spark, sf):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat(F.lit("Comisión de "), "c_mktsegment")).when(k == 1, "Mesa").when(k == 2, "Secretaría General").otherwise("Otra")
    url = F.when(k == 0, F.concat(F.lit("https://x.es/c?_organos_codComision="), F.col("c_nationkey").cast(S))).otherwise(F.concat(F.lit("https://x.es/"), k.cast(S), F.lit("/"), F.col("c_nationkey").cast(S)))
    return domains.organs_from_links(read(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), name.alias("text"), url.alias("url"))).select("organ_id", "name", "organ_type", "url")


@query("""
SELECT p_partkey, role, concept, amount_eur, DATE '2024-03-05' AS effective_date, sha256(role || '|' || concept || CASE WHEN concept = 'Sueldo' THEN ':' ELSE '' END || '|' || CASE WHEN amount_eur = floor(amount_eur) THEN CAST(CAST(amount_eur AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(amount_eur AS VARCHAR) END || '|2024-03-05') AS entitlement_id FROM (
  SELECT p_partkey, 'Directores' AS role, 'Sueldo' AS concept, CAST(p_size * 100 AS DOUBLE) + 0.25 AS amount_eur FROM part
  UNION ALL SELECT p_partkey, 'Secretario General', 'Complemento', CAST(p_size AS DOUBLE) + 1000.5 FROM part WHERE p_size % 2 = 0)""")
def salary_rows(spark, sf):
    """The amount that follows no concept of its role has no row."""
    n = F.col("p_size")
    euro = lambda whole, cents: F.concat(F.replace(F.format_number(whole, 0), F.lit(","), F.lit(".")), F.lit(f",{cents} €"))
    text = F.concat_ws("\n", F.lit("Información actualizada el 5 de marzo de 2024"), F.lit("77,00 €"), F.lit("Directores"), F.lit("Una frase que no es concepto."), F.lit("Sueldo:"), euro(n * 100, "25"), F.lit(""), F.when(n % 2 == 0, F.concat_ws("\n", F.lit("Secretario General"), F.lit("Complemento"), euro(n + 1000, "50"))), F.lit("99,00 €"))
    rows = domains.salaries(read(spark, sf, "part").select(F.col("p_partkey").cast(S).alias("source_url"), text.alias("text")))
    return rows.select(F.col("source_url").cast("long").alias("p_partkey"), "role", "concept", "amount_eur", "effective_date", "entitlement_id")


@query("""
WITH u AS (SELECT o_orderkey, 'https://a.es/' || o_orderkey || '.pdf#page=2' AS url, 'enlacesbocg' AS kind, 'application/pdf' AS mime_type, CAST(2 AS INT) AS page_hint FROM orders
  UNION ALL SELECT o_orderkey, 'https://a.es/v/' || o_orderkey || '.mp4', 'enlacediferido', 'video/mp4', NULL FROM orders WHERE o_orderkey % 2 = 0)
SELECT u.o_orderkey, sha256('iniciativas|Proyectos|' || number || '|' || url) AS document_id, number AS entity_id, 'Asunto' AS title, kind AS document_kind, url, mime_type, page_hint
FROM u JOIN (SELECT o_orderkey, '121/' || o_orderkey AS number FROM orders) n ON n.o_orderkey = u.o_orderkey""")
def document_asset_rows(spark, sf):
    k = F.col("o_orderkey").cast(S)
    record = F.map_concat(
        _map(NumExpediente=F.concat(F.lit("121/"), k), Objeto=F.lit("Asunto"), EnlacesBOCG=F.concat(F.lit("https://a.es/"), k, F.lit(".pdf #page=2"))),
        F.when(F.col("o_orderkey") % 2 == 0, _map(EnlaceDiferido=F.concat(F.lit("https://a.es/v/"), k, F.lit(".mp4 y nada más")))).otherwise(_map(Autor=F.lit("https://no.es"))),
    )
    rows = domains.document_assets(_raw(read(spark, sf, "orders"), record, "o_orderkey"), "iniciativas", "Proyectos")
    return rows.select(F.regexp_extract("entity_id", r"/(\d+)$", 1).cast("long").alias("o_orderkey"), "document_id", "entity_id", "title", "document_kind", "url", "mime_type", "page_hint")


@query("""
WITH l AS (SELECT c_custkey, c_name, unnest(['activities', 'assets_income']) AS kind FROM customer)
SELECT c_custkey, sha256(c_custkey || '|XV|' || kind || '|' || url) AS document_id, kind AS document_kind, CASE kind WHEN 'activities' THEN DATE '2024-01-30' ELSE DATE '2023-05-02' END AS registered_at,
  CASE kind WHEN 'activities' THEN 'Declaración de Actividades' ELSE 'Bienes y Rentas: modificación' END AS declaration_kind, url AS source_url FROM (SELECT *, 'https://x.es/' || CASE kind WHEN 'activities' THEN 'a/' ELSE 'docbienes/' END || c_custkey AS url FROM l)""")
def financial_document_rows(spark, sf):
    k = F.col("c_custkey").cast(S)
    link = lambda label, folder: F.struct(F.lit(label).alias("text"), F.concat(F.lit(f"https://x.es/{folder}/"), k).alias("url"))
    links = F.array(link("Declaración de Actividades (Tue Jan 30 00:00:00 CET 2024)", "a"), link("Bienes y Rentas: modificación (2/5/2023)", "docbienes"), link("Agenda (1/1/2024)", "agenda"))
    rows = domains.financial_documents(read(spark, sf, "customer").select(k.alias("deputy_id"), F.col("c_name").alias("full_name"), F.lit("XV").alias("legislature"), links.alias("links")))
    return rows.select(F.col("deputy_id").cast("long").alias("c_custkey"), "document_id", "document_kind", "registered_at", "declaration_kind", "source_url")


@query("""
SELECT c_custkey, c_name || ', Ana' AS full_name, sha256(c_name || ', Ana') AS deputy_id, sha256(c_name || ', Ana|XV|' || c_custkey) AS profile_id, CAST(c_custkey AS VARCHAR) AS parliamentary_code, DATE '1970-03-04' AS birth_date, 'Soria' AS birth_place, c_mktsegment AS constituency,
  'G.P. ' || c_mktsegment AS parliamentary_group, 'GX' || c_nationkey AS parliamentary_group_code, CASE WHEN c_custkey % 2 = 0 THEN 'Partido' END AS electoral_party, 'a' || c_custkey || '@congreso.es' AS email, DATE '2023-08-17' AS full_condition_date FROM customer""")
def profile_rows(spark, sf):
    k = F.col("c_custkey").cast(S)
    lines = [
        F.lit("Congreso - Ficha"), F.lit("Uno, Otro, Tres comas"), F.lit("Diputados"), F.lit("Buscar"), F.concat("c_name", F.lit(", Ana")), F.concat(F.lit("Diputada por "), "c_mktsegment"), F.concat(F.lit("G.P. "), "c_mktsegment"), F.lit("("),
        F.concat(F.lit("GX"), F.col("c_nationkey").cast(S)), F.lit(")"), F.lit("Nacida el Wed Mar 04 00:00:00 CET 1970"), F.lit("en Soria"), F.concat(F.lit("a"), k, F.lit("@congreso.es")), F.when(F.col("c_custkey") % 2 == 0, "Partido").otherwise("Ficha personal"),
        F.lit("Condición plena: Thu Aug 17 00:00:00 CEST 2023"), F.lit("XV Legislatura (2023- )"),
    ]
    url = F.concat(F.lit("https://x.es/f?codParlamentario="), k, F.lit("&idLegislatura=XV"))
    rows = domains.profile(read(spark, sf, "customer").select(F.array_join(F.array(*lines), "\n ").alias("visible_text"), url.alias("source_url")))
    return rows.select(F.col("parliamentary_code").cast("long").alias("c_custkey"), "full_name", "deputy_id", "profile_id", "parliamentary_code", "birth_date", "birth_place", "constituency", "parliamentary_group", "parliamentary_group_code", "electoral_party", "email", "full_condition_date")


@query("""
SELECT doc_id, md5(coalesce(text, '') || chr(10) || chr(10) || 'fin') AS digest, CAST(3 AS BIGINT) AS page_count, CAST(CASE WHEN trim(coalesce(text, '')) = '' THEN 1 ELSE 2 END AS BIGINT) AS pages_with_text,
  round((CASE WHEN trim(coalesce(text, '')) = '' THEN 0.2 ELSE 0.92 END + 0.2 + 0.5) / 3, 6) AS confidence, 'native ocr native' AS methods FROM documents""")
def document_text_rows(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.array("text", F.lit(""), F.lit("fin")).alias("page_texts"), F.array(F.lit(None).cast(S), F.lit("ocr")).alias("methods"), F.array(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.5)).alias("confidences"))
    pages = declarations.pages(docs)
    whole = domains.document_texts(pages.select(F.col("doc").cast(S).alias("source_sha256"), "page", "text", "confidence"))
    how = pages.groupBy(F.col("doc").cast(S).alias("source_sha256")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "method"))), lambda x: x["method"]), " ").alias("methods"))
    return whole.join(how, "source_sha256").select(F.col("source_sha256").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest"), "page_count", "pages_with_text", F.round("confidence", 6).alias("confidence"), "methods")
