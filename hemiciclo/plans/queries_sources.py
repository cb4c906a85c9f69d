"""More queries, of catalogues, discovery, stored artifacts, readers and run state."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemiciclo.functions.text import redact
from hemiciclo.operators import filters, joins, limits
from hemiciclo.plans.queries import query, read
from hemiciclo.session import shared_dir
from hemiciclo.sources import bronze, catalog, discovery, records, sinks, state, transport
from hemiciclo.streaming import ingest

S = "string"


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _links(spark, sf) -> DataFrame:
    """Addresses of vote artifacts, sessions' archives, other exports, and pages that are none."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    base = F.lit("https://www.congreso.es/webpublica/opendata/")
    vote = F.concat(base, F.lit("votaciones/Leg"), (k % 5 + 11).cast(S), F.lit("/Sesion"), F.col("o_custkey").cast(S), F.lit("/"), day, F.lit("/Votacion"), k.cast(S), F.lit("/VOT_"), day, F.lit("101112.json"))
    session = F.concat(base, F.lit("votaciones/Leg15/Sesion"), F.col("o_custkey").cast(S), F.lit("/"), day, F.lit("/VOT_"), k.cast(S), F.lit(".zip"))
    other = F.concat(base, F.lit("interventions/Pleno__"), day, F.lit("101112_"), k.cast(S), F.lit(".csv"))
    url = F.when(k % 4 == 0, vote).when(k % 4 == 1, session).when(k % 4 == 2, other).otherwise(F.concat(F.lit("https://www.congreso.es/p/"), k.cast(S), F.lit(".json")))
    rows = read(spark, sf, "orders").select(F.lit("votos").alias("family"), k.cast(S).alias("text"), url.alias("url"))
    return rows.union(rows)


CATALOG_SQL = """
SELECT o_orderkey, 'votos' AS family, CASE o_orderkey % 4 WHEN 0 THEN 'Votacion' WHEN 1 THEN 'SesionVotaciones' ELSE 'Pleno' END AS dataset, CASE o_orderkey % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'zip' ELSE 'csv' END AS format,
  CASE WHEN o_orderkey % 4 IN (0, 2) THEN strftime(o_orderdate, '%Y%m%d') || '101112' END AS snapshot_token, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 5 + 11 AS VARCHAR) WHEN 1 THEN '15' END AS legislature,
  CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_custkey AS VARCHAR) END AS session, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS vote_number FROM orders WHERE o_orderkey % 4 <> 3"""


def _keyed(rows: DataFrame) -> DataFrame:
    key = F.regexp_extract("url", r"(?:VOT_|_)(\d+)\.(?:zip|csv)$", 1)
    return rows.select(F.coalesce("vote_number", key).cast("long").alias("o_orderkey"), "family", "dataset", "format", "snapshot_token", "legislature", "session", "vote_number")


@query(CATALOG_SQL)
def resource_catalog(spark, sf):
    return _keyed(catalog.resources_from_links(_links(spark, sf)))


@query(f"SELECT * FROM ({CATALOG_SQL}) WHERE format <> 'csv' AND (legislature IS NULL OR legislature IN ('15', '14'))")
def frozen_catalog(spark, sf):
    """Written as an envelope and as a bare list, read, united, selected and pruned."""
    rows = catalog.resources_from_links(_links(spark, sf))
    listed = rows.groupBy(F.pmod(F.xxhash64("url"), F.lit(64)).alias("p")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("j"))
    envelope, bare = _place(spark, "catalog"), _place(spark, "catalog")
    listed.select(F.concat(F.lit('{"resources":'), "j", F.lit("}")).alias("value")).write.option("maxRecordsPerFile", 1).text(envelope)
    listed.select(F.col("j").alias("value")).write.option("maxRecordsPerFile", 1).text(bare)
    both = catalog.union_catalogs(catalog.read_catalog(spark, envelope), catalog.read_catalog(spark, bare))
    chosen = catalog.select_resources(both, families=("votos",), formats=("json", "zip"))
    return _keyed(filters.resources_for(chosen, family="votos", formats=("json", "zip", "csv"), legislatures=("XV", "XIV")))


@query("""
WITH s AS (SELECT unnest(['Organos', 'Mesa', 'JuntaPortavoces', 'DiputacionPermanente', 'Comisiones', 'RetribucionesCargosMesa']) AS name),
c AS (SELECT CAST(unnest(range(300, 403)) AS VARCHAR) AS code UNION SELECT '1' UNION SELECT CAST(n_nationkey + 500 AS VARCHAR) FROM nation)
SELECT 'pages' AS plan, name AS item, CAST(NULL AS BIGINT) AS n FROM s UNION ALL SELECT 'composition', code, CAST(2 AS BIGINT) FROM c
UNION ALL SELECT 'scope', unnest(['ProyectosDeLey', 'PropuestasDeReforma']), CAST(unnest([3, 3]) AS BIGINT) UNION ALL SELECT 'scope', 'GeneralInitiatives', CAST(1 AS BIGINT) UNION ALL SELECT 'scope', 'ApprovedLaws', CAST(1 AS BIGINT)
UNION ALL SELECT 'list', CAST(n_nationkey AS VARCHAR), greatest(CAST(1 AS BIGINT), CAST(ceil(count(c_custkey) / 25.0) AS BIGINT)) FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey
UNION ALL SELECT 'empty', 'PropuestasDeReforma', CAST(3 AS BIGINT) UNION ALL SELECT 'empty', 'ProyectosDeLey', CAST(1 AS BIGINT)""")
def request_plans(spark, sf):
    n = lambda d, plan, item: d.groupBy(F.lit(plan).alias("plan"), F.col(item).alias("item")).agg(F.count("*").alias("n"))
    pages = catalog.transparency_resources(spark).select(F.lit("pages").alias("plan"), F.col("dataset").alias("item"), F.lit(None).cast("long").alias("n"))
    scraped = read(spark, sf, "nation").select((F.col("n_nationkey") + 500).cast(S).alias("code"))
    composition = n(catalog.composition_requests(spark, [14, 15], scraped), "composition", "code")
    scopes = catalog.initiative_scopes(spark, ("ProyectosDeLey", "PropuestasDeReforma"), (4, 11, 13), (15,))
    totals = read(spark, sf, "nation").join(read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("total")), "n_nationkey", "left").select(F.col("n_nationkey").cast(S).alias("dataset"), F.coalesce("total", F.lit(0)).alias("total"))
    empty = scopes.where(discovery.empty_is_expected(F.col("dataset"), F.col("legislature")))
    return pages.union(composition).union(n(scopes, "scope", "dataset")).union(n(catalog.list_pages(totals), "list", "dataset")).union(n(empty, "empty", "dataset"))


@query("""
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS leg, '' AS speaker, c_mktsegment AS text, 1 + (c_acctbal > 0)::INT AS pages, substr(sha256('{"legislatura":"' || c_custkey || '","orador":"","texto":"' || c_mktsegment || '"}'), 1, 16) AS token FROM customer""")
def request_bodies(spark, sf):
    """The same fields in every body; a request for each hundred results, its token the hash of the body."""
    body = catalog.filter_body({"legislatura": F.col("c_custkey"), "texto": F.col("c_mktsegment"), "orador": F.lit(None)}, ("texto", "legislatura", "orador"))
    totals = read(spark, sf, "customer").select(F.col("c_custkey").alias("legislature"), F.when(F.col("c_acctbal") > 0, 150).otherwise(20).cast("long").alias("total"), body.alias("filters"))
    rows = catalog.export_pages(totals, most=200)
    of = lambda k: F.first(F.element_at("filters", k))
    return rows.groupBy(F.col("legislature").alias("c_custkey")).agg(of("legislatura").alias("leg"), of("orador").alias("speaker"), of("texto").alias("text"), F.count("*").cast("int").alias("pages"), F.min("query_token").alias("token"))


@query("SELECT DISTINCT o_custkey, strftime(o_orderdate, '%Y%m%d') AS day, true AS valid FROM orders")
def vote_calendars(spark, sf):
    days = read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.date_format("o_orderdate", "yyyyMMdd")).alias("d"))
    script = F.concat(F.lit("var x = 12345678; var dias = ['"), F.array_join("d", "', '"), F.lit("'];"))
    return days.select("o_custkey", F.explode(catalog.vote_dates(script)).alias("day")).withColumn("valid", filters.valid_day(F.col("day")))


@query("""
SELECT 'D' || l_orderkey AS document_id, CASE WHEN l_orderkey % 2 = 0 THEN 'https://a.es/t/' ELSE 'https://a.es/p/' END || l_orderkey || '/' || last AS url, CASE WHEN l_orderkey % 2 = 0 THEN 'html' ELSE 'pdf' END AS format
FROM (SELECT l_orderkey, max(l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey % 100000) AS last FROM lineitem GROUP BY l_orderkey)""")
def intervention_resources(spark, sf):
    """One text a document, that of its last intervention; the text's address before the PDF's."""
    at = F.col("l_linenumber") * F.lit(10_000_000_000) + F.col("l_partkey") * 100_000 + F.col("l_suppkey") % 100_000
    tail = F.concat(F.col("l_orderkey").cast(S), F.lit("/"), at.cast(S))
    rows = read(spark, sf, "lineitem").select(F.concat(F.lit("D"), F.col("l_orderkey").cast(S)).alias("document_id"), F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("https://a.es/t/"), tail, F.lit("#p2"))).otherwise("").alias("full_text_url"), F.concat(F.lit("https://a.es/p/"), tail).alias("pdf_url"), at.alias("ordinal"))
    return discovery.text_resources(rows).select("document_id", "url", "format")


@query("""
SELECT dataset, url, max(document_id) AS document_id FROM (SELECT c_mktsegment AS dataset, 'https://a.es/' || c_nationkey AS url, lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS document_id FROM customer WHERE c_custkey % 3 = 0) GROUP BY ALL""")
def document_resources(spark, sf):
    assets = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("dataset"), F.concat(F.lit("https://a.es/"), F.col("c_nationkey").cast(S)).alias("url"), F.lpad(F.col("c_custkey").cast(S), 12, "0").alias("document_id"), F.when(F.col("c_custkey") % 3 == 0, "application/pdf").otherwise("video/mp4").alias("mime_type"))
    return discovery.document_resources(assets).select("dataset", "url", "document_id")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS code, CAST(15 AS INT) AS legislature, c_name AS full_name, 'https://x.es/busqueda-de-diputados?codParlamentario=' || c_custkey || '&idLegislatura=15' AS url FROM customer""")
def profile_resources(spark, sf):
    rows = read(spark, sf, "customer").select(F.col("c_custkey").cast(S).alias("codParlamentario"), F.lit(15).alias("idLegislatura"), F.col("c_name").alias("apellidosNombre"))
    return discovery.profile_resources(rows, 15, "https://x.es")


@query("""
WITH v AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y%m%d') AS day FROM orders WHERE o_orderkey % 4 < 2 AND (o_orderkey % 4 = 1 OR o_orderkey % 5 + 11 = 15))
SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Votacion' ELSE 'SesionVotaciones' END AS dataset, CAST(o_custkey AS VARCHAR) AS session, day, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS vote_number, CASE o_orderkey % 4 WHEN 0 THEN 'json' ELSE 'zip' END AS format FROM v""")
def vote_resources(spark, sf):
    pages = _links(spark, sf).groupBy(F.pmod(F.xxhash64("url"), F.lit(50)).cast(S).alias("page_url")).agg(F.collect_list(F.struct("text", "url")).alias("links"))
    return discovery.vote_resources(pages, 15).select("dataset", "session", "day", "vote_number", "format")


@query("""
WITH d AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS day FROM orders), j AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS day FROM orders WHERE o_orderkey % 3 = 0),
s AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS day FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey % 300 + 2 BETWEEN 1 AND 250)
SELECT day, CAST(NULL AS VARCHAR) AS votes FROM d WHERE day NOT IN (SELECT day FROM j) AND day NOT IN (SELECT day FROM s)
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), (o_custkey % 300) || ' 1 1' FROM orders WHERE o_orderkey % 3 = 1""")
def vote_summaries(spark, sf):
    """Days that neither a JSON vote nor a valid summary covers, and what the summaries say."""
    o = read(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyyMMdd"))
    said = F.concat(F.lit("Resultado. Sí: "), (F.col("o_custkey") % 300).cast(S), F.lit(" votos; No: 1 voto; Abstenciones: 1"))
    summaries = o.where("o_orderkey % 3 = 1").select("o_orderkey", "day", discovery.summary_votes(said).alias("votes"))
    open_ = discovery.uncovered_dates(o, o.where("o_orderkey % 3 = 0").select("day", F.lit("json").alias("format")), summaries.withColumn("valid", discovery.summary_valid(F.col("votes"), 250)))
    said = summaries.select(F.col("o_orderkey").cast(S).alias("day"), F.array_join(F.transform("votes", lambda v: F.concat_ws(" ", v["yes"].cast(S), v["no"].cast(S), v["abstentions"].cast(S))), ";").alias("votes"))
    return open_.select("day", F.lit(None).cast(S).alias("votes")).union(said)


@query("""
SELECT 'https://c.es/' || c_nationkey AS url FROM customer UNION SELECT 'https://d.es/' || o_custkey FROM orders UNION SELECT 'https://v.es/' || o_orderkey FROM orders WHERE o_orderkey % 2 = 1""")
def supporting_resources(spark, sf):
    u = lambda d, host, key: d.select(F.concat(F.lit(f"https://{host}.es/"), F.col(key).cast(S)).alias("url"))
    o = read(spark, sf, "orders")
    variants = o.select(F.concat(F.lit("https://v.es/"), F.col("o_orderkey").cast(S)).alias("url"), F.when(F.col("o_orderkey") % 2 == 0, "json").otherwise("pdf").alias("format"))
    return discovery.supporting_resources(u(read(spark, sf, "customer"), "c", "c_nationkey"), u(o, "d", "o_custkey"), variants)


@query("""
WITH o AS (SELECT slug, min(name) AS name FROM (SELECT (c_nationkey % 5) || '-' || c_nationkey AS slug, c_name AS name FROM customer) GROUP BY slug), f AS (SELECT unnest(['ajax', 'json', 'csv', 'xml']) AS format)
SELECT slug, name, format, 'https://x.es/organos/' || slug || '.' || format AS url, sha256(slug || '|' || format) AS resource_id FROM o, f
UNION ALL SELECT d, NULL, 'json', 'https://x.es/' || d, NULL FROM (SELECT unnest(['ProyectosDeLey', 'ProposicionesDeLey', 'PropuestasDeReforma']) AS d)""")
def organ_and_owner_resources(spark, sf):
    inventory = read(spark, sf, "customer").select(F.col("c_name").alias("name"), (F.col("c_nationkey") % 5).cast(S).alias("sup"), F.col("c_nationkey").cast(S).alias("sub"))
    organs = discovery.organ_resources(discovery.organ_descriptors(inventory), "https://x.es").select("slug", "name", "format", "url", "resource_id")
    names = F.array(*map(F.lit, (*discovery.OWNERS, "Otros", *discovery.OWNERS)))
    rows = read(spark, sf, "region").limit(1).select(F.posexplode(names).alias("pos", "dataset")).select("dataset", F.when(F.col("pos") < 4, "json").otherwise("csv").alias("format"), F.concat(F.lit("https://x.es/"), "dataset").alias("url"))
    owners = discovery.owner_resources(rows)
    return organs.unionByName(owners.select(F.col("dataset").alias("slug"), F.lit(None).cast(S).alias("name"), F.lit("json").alias("format"), "url", F.lit(None).cast(S).alias("resource_id")))


@query("SELECT DISTINCT c_nationkey, CAST(1990 + c_nationkey AS INT) AS newest, CAST(2 AS BIGINT) AS n FROM customer")
def law_years(spark, sf):
    years = [F.col("c_nationkey") + 1990, F.lit(1978), F.col("c_nationkey") + 1990, F.lit(2099)]
    page = F.concat(F.lit("<select>"), *(F.concat(F.lit('<option value="x"> '), y.cast(S), F.lit(" </option>")) for y in years), F.lit("</select>"))
    found = discovery.law_years(page, 2050)
    return read(spark, sf, "customer").select("c_nationkey").distinct().select("c_nationkey", found[0].alias("newest"), F.size(found).cast("long").alias("n"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'POST' ELSE 'GET' END AS request_method, 'https://a.es/' || s_suppkey AS requested_url, 'fixture' AS method, 'json' AS format, CAST(s_nationkey AS BIGINT) AS bytes, CASE WHEN s_suppkey % 3 = 0 THEN '[REDACTED]' ELSE s_name END AS shown FROM supplier""")
def source_manifests(spark, sf):
    """Manifests of two ages on disk: the older ones lack the request's method and address."""
    path, k = _place(spark, "manifests"), F.col("s_suppkey")
    old = F.struct(F.concat(F.lit("https://a.es/"), k.cast(S)).alias("source_url"), F.lit("json").alias("format"), F.col("s_nationkey").alias("bytes"), F.col("s_name").alias("etag"), F.when(k % 2 == 0, "POST").otherwise("").alias("request_method"))
    rows = read(spark, sf, "supplier").select(F.to_json(old).alias("value"), "s_suppkey")
    rows.select("value").write.option("maxRecordsPerFile", 1).text(path)
    m = records.read_manifests(spark, path)
    ref = records.source_ref("fixture")
    rows = m.withColumn("ref", ref).withColumn("s_suppkey", F.regexp_extract("source_url", r"(\d+)$", 1).cast("long"))
    key = F.when(F.col("s_suppkey") % 3 == 0, "api_key").otherwise("name")
    return rows.select("s_suppkey", "request_method", F.col("ref.requested_url").alias("requested_url"), F.col("ref.method").alias("method"), "format", "bytes", F.element_at(redact(F.create_map(key, "etag")), key).alias("shown"))


@query("""
SELECT n_nationkey, CAST(length(n_name) + 1 AS BIGINT) AS length, sha256(n_name || chr(10)) AS sha256, n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 1 AS valid FROM nation""")
def bronze_scan(spark, sf):
    """Objects on disk against their manifests: some manifests have another hash, some another size."""
    root = _place(spark, "bronze")
    n = read(spark, sf, "nation").select("n_nationkey", "n_name")
    n.select(F.col("n_name").alias("value"), F.lit("f").alias("a"), F.lit("d").alias("b"), F.col("n_nationkey").alias("k")).write.partitionBy("a", "b", "k").text(root)
    objects = bronze.read_objects(spark, root, pattern="*.txt")
    stored = objects.select(F.substring_index("path", "/", -4).alias("bronze_path"), F.regexp_extract("path", r"/k=(\d+)/", 1).cast("long").alias("n_nationkey"))
    text = F.concat("n_name", F.lit("\n"))
    manifests = n.join(stored, "n_nationkey").select("n_nationkey", "bronze_path", (F.length(text) + (F.col("n_nationkey") % 7 == 1).cast("int")).cast("long").alias("bytes"), F.when(F.col("n_nationkey") % 5 == 0, "0").otherwise(F.sha2(text, 256)).alias("sha256"), F.lit("txt").alias("format"))
    checked = bronze.checked(manifests, objects).select("n_nationkey", "valid", "bronze_path")
    return checked.join(objects.select(F.substring_index("path", "/", -4).alias("bronze_path"), "length", "sha256"), "bronze_path").select("n_nationkey", "length", "sha256", "valid")


@query("""
SELECT c_mktsegment AS dataset, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT DISTINCT c_mktsegment, c_nationkey, length(c_mktsegment || c_nationkey) AS b FROM customer) GROUP BY 1""")
def persisted_artifacts(spark, sf):
    """Persisted twice: a second run finds everything there and adds nothing."""
    root, body = _place(spark, "store"), F.concat("c_mktsegment", F.col("c_nationkey").cast(S))
    fetched = read(spark, sf, "customer").select(F.lit("f").alias("family"), F.col("c_mktsegment").alias("dataset"), F.lit("2024-01-01").alias("run_date"), F.concat(F.lit("https://a.es/"), body).alias("source_url"), F.lit("txt").alias("format"), F.sha2(body, 256).alias("sha256"), F.encode(body, "UTF-8").alias("content"))
    bronze.persist(fetched, root)
    manifests = bronze.persist(fetched, root)
    return manifests.groupBy("dataset").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("""
SELECT s_suppkey, '{"balance":"' || s_nationkey || '","name":"' || s_name || '","note":"a;b \\"c\\""}' AS row_text, CAST(3 AS BIGINT) AS formats FROM supplier""")
def cross_format_rows(spark, sf):
    """The same rows as JSON, CSV and XML files read alike; each canonical row comes from all three."""
    rows = read(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit(" "), F.col("s_nationkey").cast(S)).alias("balance"), F.lit('a;b "c"').alias("note"))
    made = {k: _place(spark, k) for k in ("json", "csv", "xml")}
    sinks.export_records(rows, made["json"], format_name="json")
    rows.write.option("sep", ";").option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").csv(made["csv"])
    rows.write.format("xml").option("rootTag", "rows").option("rowTag", "row").save(made["xml"])
    found = {"json": records.read_json(spark, made["json"]), "csv": records.read_csv(spark, made["csv"]), "xml": records.read_xml(spark, made["xml"], "row")}
    out = None
    for kind, d in found.items():
        one = d.select(records.canonical_row(F.col("record")).alias("row_text"), F.lit(kind).alias("kind"))
        out = one if out is None else out.union(one)
    name = F.regexp_extract("row_text", r"#0*(\d+)", 1).cast("long")
    return out.groupBy("row_text").agg(F.count_distinct("kind").alias("formats")).select(name.alias("s_suppkey"), "row_text", "formats")


@query("""
SELECT n_nationkey, CAST(length(n_name) AS BIGINT) AS bytes, sha256(n_name) AS sha256, 'json' AS format, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE reverse(n_name) END AS shown FROM nation""")
def fetched_resources(spark, sf):
    """A data source with an injected transport: a partition a resource; the client tries again after 503, waits as told after 429, and goes to the other address after 404."""
    wanted = read(spark, sf, "nation").collect()  # the driver's own plan of 25 resources
    plan = [{"url": f"https://x.es/{r.n_nationkey}/{r.n_name}", "format": "json"} for r in wanted]

    def fetch(resource: dict) -> bytes:
        seen: list[str] = []
        key = int(resource["url"].split("/")[3])

        def open_(url: str) -> transport.Response:
            seen.append(url)
            status = 404 if key % 3 == 0 and not url.endswith("?b") else (503, 429)[key % 2] if len(seen) == 1 and key % 3 else 200
            body = [url.split("/")[4].removesuffix("?b").encode()]
            return transport.Response(status, lambda n: body.pop() if body else b"", {"Retry-After": "0"}, url)

        pacer = transport.Pacer(0.0, clock=lambda: 0.0, sleep=lambda s: None)
        return transport.Client(open_, pacer=pacer, fallback=lambda url: url + "?b").get(resource["url"], most=1000).content

    spark.dataSource.register(catalog.resource_source(fetch))
    got = spark.read.format("hemiciclo_resources").option("resources", json.dumps(plan)).load()
    key, name = F.split("url", "/")[3].cast("long"), F.decode("content", "UTF-8")
    return got.select(key.alias("n_nationkey"), "bytes", "sha256", "format", F.when(key % 2 == 0, name).otherwise(F.reverse(name)).alias("shown"))


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'ValueError' END AS failure, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 10 END AS value, 'failed' AS first_status, 'completed' AS last_status, 25 AS events, 'StateMismatch' AS other FROM nation""")
def run_checkpoint(spark, sf):
    """A run that fails in part and is resumed, its event log, and a checkpoint that another request may not use."""
    from pathlib import Path

    base = Path(_place(spark, "run").removeprefix("file:"))
    keys = [str(r.n_nationkey) for r in read(spark, sf, "nation").select("n_nationkey").collect()]  # the driver's own plan
    run = state.Checkpoint(base / "state.json", {"plan": 1})
    for k in run.pending(keys):
        run.failed(k, ValueError(k)) if int(k) % 4 == 0 else run.done(k, int(k) * 10)
        state.append_event(base / "events.jsonl", {"key": k})
    rows = [(int(k), run.state["failures"].get(k, {}).get("type"), run.state["done"].get(k), run.finish()) for k in keys]
    again = state.Checkpoint(base / "state.json", {"plan": 1})
    for k in again.pending(keys):
        again.done(k, None)
    try:
        state.Checkpoint(base / "state.json", {"plan": 2})
        other = None
    except state.StateMismatch as e:
        other = type(e).__name__
    events = len((base / "events.jsonl").read_text().splitlines())
    return spark.createDataFrame([(*r, again.finish(), events, other) for r in rows], "n_nationkey long, failure string, value long, first_status string, last_status string, events int, other string")


@query("""
SELECT count(*) AS planned, count(*) FILTER (o_orderstatus = 'F') AS reused, count(*) FILTER (o_orderstatus = 'O') AS downloaded, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS completed,
  (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS pending FROM orders""")
def run_status(spark, sf):
    o = read(spark, sf, "orders")
    named = F.when(F.col("o_orderstatus") == "F", "reused").when(F.col("o_orderstatus") == "O", "downloaded").otherwise("failed")
    manifests = o.where("o_orderkey % 3 <> 1").select("o_orderkey", F.lit(1).alias("at"), (F.col("o_orderkey") % 3 == 0).alias("ok"))
    pending = joins.pending(o.select("o_orderkey"), manifests, ["o_orderkey"], at="at", valid=F.col("ok"))
    return ingest.status_counts(o.select(named.alias("status"))).crossJoin(pending.agg(F.count("*").alias("pending")))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1 AND event_id >= 0")
def incremental_manifests(spark, sf):
    """A stream over two batches of files, run twice with one checkpoint: each key's first row comes out once."""
    source, out, done = _place(spark, "in"), _place(spark, "out"), _place(spark, "state")
    first = read(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    first.repartition(2).write.parquet(source)
    rows = lambda: ingest.distinct_stream(ingest.stream_table(spark, source, "user_id long, event_id long"), ["user_id"])
    ingest.run_available(rows(), out, done)
    first.withColumn("event_id", -F.col("event_id") - 1).write.mode("append").parquet(source)
    ingest.run_available(rows(), out, done)
    return limits.ensure_at_most(spark.read.parquet(out), 100_000_000).select("event_id", "user_id")
