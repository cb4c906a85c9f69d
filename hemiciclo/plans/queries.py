"""Queries over the driver's tables, each applying operators of the library, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemiciclo.functions import dates, ids, money, references, text, urls
from hemiciclo.operators import aggregates, dedup, filters, joins, limits, windows
from hemiciclo.plans import declarations, domains, extraction, services, speech, votes_text
from hemiciclo.session import shared_dir
from hemiciclo.sources import catalog, html, records, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FOLD = "strip_accents(lower({0}))"
STOP = "['de','del','la','las','los','y']"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, list_sort(t)[1] AS first_token, array_to_string(list_sort(t), ' ') AS token_key
FROM (SELECT doc_id, list_filter(list_distinct(regexp_extract_all({FOLD.format("text")}, '[a-z0-9]+')), lambda x: NOT list_contains({STOP}, x)) AS t FROM documents)""")
def fold_tokens(spark, sf):
    t = text.identity_tokens(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_min(t).alias("first_token"), text.token_key(F.col("text")).alias("token_key"))


@query("""
SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS id, substr(sha256('customer|' || c_custkey), 1, 32) AS short_id FROM customer""")
def stable_ids(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", ids.stable_id(F.col("c_name"), F.col("c_mktsegment")).alias("id"), ids.short_id("customer", F.col("c_custkey").cast("string")).alias("short_id"))


@query("""
SELECT p_partkey, regexp_replace(regexp_replace(strip_accents(lower(trim(p_name || ' - ' || p_brand))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key,
  replace(regexp_replace(regexp_replace(strip_accents(lower(trim(p_name || ' - ' || p_brand))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '_', '') AS compact FROM part""")
def key_normalization(spark, sf):
    raw = F.concat_ws(" - ", "p_name", "p_brand")
    key = text.norm_key(raw)
    return read(spark, sf, "part").select("p_partkey", key.alias("key"), F.replace(key, F.lit("_"), F.lit("")).alias("compact"))


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS short_date, CAST(o_orderdate AS DATE) AS with_time, CAST(o_orderdate AS DATE) AS two_digits, CAST(o_orderdate AS DATE) AS long_date,
  CAST(NULL AS DATE) AS bad, strftime(o_orderdate, '%d/%m/%Y') AS shown FROM orders""")
def spanish_dates(spark, sf):
    d = F.col("o_orderdate")
    names = F.array(*(F.lit(m) for m in list(dates.MONTHS)[:9] + list(dates.MONTHS)[10:]))
    spoken = F.concat(F.day(d).cast("string"), F.lit(" de "), F.element_at(names, F.month(d)), F.lit(" de "), F.year(d).cast("string"))
    p = dates.spanish_date
    return read(spark, sf, "orders").select(
        "o_orderkey", p(F.date_format(d, "d/M/yyyy")).alias("short_date"), p(F.date_format(d, "dd/MM/yyyy HH:mm")).alias("with_time"), p(F.date_format(d, "dd/MM/yy")).alias("two_digits"),
        dates.long_spanish_date(spoken).alias("long_date"), p(F.concat(F.lit("31/02/"), F.year(d).cast("string"))).alias("bad"), dates.date_text(d).alias("shown"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS amount, round(l_tax * 100, 2) AS percent, round(l_extendedprice, 2) AS mixed FROM lineitem""")
def euro_roundtrip(spark, sf):
    price = F.round("l_extendedprice", 2)
    shown = F.regexp_replace(money.format_eur(price), " EUR$", " €")
    share = F.concat(F.lit("un "), F.replace(F.round(F.col("l_tax") * 100, 2).cast("string"), F.lit("."), F.lit(",")), F.lit(" % más"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(money.euro_amount(shown), 2).alias("amount"), F.round(money.first_percentage(share), 2).alias("percent"), F.round(money.mixed_amount(money.format_eur(price)), 2).alias("mixed"))


@query("""
SELECT o_orderkey, 2024 - year(o_orderdate) - CAST(strftime(o_orderdate, '%m%d') > '0615' AS INT) AS age, CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH AS DATE) AS three_months_before,
  CASE WHEN o_orderdate >= DATE '2000-04-05' THEN 'VII' WHEN o_orderdate >= DATE '1996-03-27' THEN 'VI' WHEN o_orderdate >= DATE '1993-04-13' THEN 'V' WHEN o_orderdate >= DATE '1989-11-21' THEN 'IV' ELSE 'III' END AS legislature FROM orders""")
def ages_and_terms(spark, sf):
    d = F.to_date("o_orderdate")
    return read(spark, sf, "orders").select("o_orderkey", dates.age_at(d, F.lit("2024-06-15").cast("date")).alias("age"), dates.months_before(d, 3).alias("three_months_before"), dates.legislature_on(d).alias("legislature"))


@query("""
WITH r(n, v) AS (VALUES (0,'0'),(1,'I'),(2,'II'),(3,'III'),(4,'IV'),(5,'V'),(6,'VI'),(7,'VII'),(8,'VIII'),(9,'IX'),(10,'X'),(11,'XI'),(12,'XII'),(13,'XIII'),(14,'XIV'),(15,'XV'),(16,'XVI'),(17,'XVII'),(18,'XVIII'),(19,'XIX'),(20,'XX'),(21,'XXI'),(22,'XXII'),(23,'XXIII'),(24,'XXIV'))
SELECT n_nationkey, v AS roman, v AS again, CASE WHEN n_nationkey <= 15 THEN 'Leg.' || n_nationkey ELSE v END AS label FROM nation JOIN r ON n = n_nationkey""")
def roman_legislatures(spark, sf):
    n = F.col("n_nationkey").cast("string")
    roman = dates.legislature_roman(F.concat(F.lit("Leg."), n))
    return read(spark, sf, "nation").select("n_nationkey", roman.alias("roman"), dates.legislature_roman(roman).alias("again"), F.when(roman == "0", F.lit("Leg.0")).otherwise(dates.legislature_label(roman)).alias("label"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lpad(CAST(l_linenumber + 120 AS VARCHAR), 3, '0') || '/' || lpad(CAST(l_orderkey % 100000 AS VARCHAR), 6, '0') || '/0000' AS number,
  CAST(2 AS BIGINT) AS mentioned, lpad(CAST(l_linenumber + 120 AS VARCHAR), 3, '0') AS prefix FROM lineitem""")
def file_numbers(spark, sf):
    raw = F.concat_ws("/", (F.col("l_linenumber") + 120).cast("string"), (F.col("l_orderkey") % 100000).cast("string"))
    number = references.file_number(raw)
    said = F.concat(F.lit("véase "), raw, F.lit(" y 130/7/2, otra vez "), raw)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", number.alias("number"), F.size(references.file_numbers_in(said)).cast("long").alias("mentioned"), references.file_prefix(number).alias("prefix"))


@query(r"""
SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
  nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment, regexp_replace(url, '#.*$', '') AS canonical, CASE WHEN regexp_replace(url, '[?#].*$', '') LIKE '%.html' THEN 'html' WHEN regexp_replace(url, '[?#].*$', '') LIKE '%.net' THEN 'net' END AS format FROM pages""")
def url_parts(spark, sf):
    u = F.col("url")
    fmt = F.when(urls.path(u).endswith(".html"), urls.format_of(u))
    return read(spark, sf, "pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query_param(u, "page").alias("page"), urls.fragment(u).alias("fragment"), urls.canonical_url(F.concat(F.lit("https://x.example "), u), "https://x.example").alias("canonical"), fmt.alias("format"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'application/pdf' WHEN p_size % 4 = 1 THEN 'video/mp4' WHEN p_size % 4 = 2 THEN 'application/xml' END AS mime, CAST(p_size AS INT) AS page,
  CASE WHEN p_size % 3 = 0 THEN 'assets_income' WHEN p_size % 3 = 1 THEN 'activities' ELSE 'economic_interests' END AS kind,
  CASE WHEN p_size IN (1) THEN 'governing_body' ELSE 'commission' END AS organ_type FROM part""")
def mime_and_kind(spark, sf):
    size = F.col("p_size")
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".mp4", ".xml", ".html"))), size % 4 + 1)
    url = F.concat(F.lit("https://x.example/docs/f"), ext, F.lit("#page="), size.cast("string"))
    label = F.element_at(F.array(*map(F.lit, ("Bienes y Rentas", "Declaración de Actividades", "Intereses económicos"))), size % 3 + 1)
    return read(spark, sf, "part").select("p_partkey", urls.mime_type(url).alias("mime"), urls.page_hint(url).alias("page"), domains.financial_kind(label, url).alias("kind"), domains.organ_type(size.cast("string")).alias("organ_type"))


@query(r"""
SELECT doc_id, round(greatest(0.0, 0.55 * least(1.0, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) / 30.0) + 0.45 * least(1.0, length(text) / 400.0)), 6) AS quality, length(trim(text)) < 80 OR len(regexp_extract_all(text, '\S+')) < 8 AS needs_ocr FROM documents""")
def page_quality(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", F.round(text.page_quality(t), 6).alias("quality"), filters.needs_ocr(t).alias("needs_ocr"))


@query("""
SELECT event_id, '[REDACTED]' AS api_key, event_type AS kind FROM events""")
def redaction(spark, sf):
    m = text.redact(F.create_map(F.lit("Api-Key"), F.col("props"), F.lit("kind"), F.col("event_type")))
    return read(spark, sf, "events").select("event_id", F.element_at(m, "Api-Key").alias("api_key"), F.element_at(m, "kind").alias("kind"))


@query("""
SELECT c_custkey, c_name, c_mktsegment, n_name AS constituency FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_mktsegment), 'build')
  AND (c_custkey % 3 = 0 OR c_custkey % 15 + 1 IN (14, 15))""")
def domain_filter(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("constituency"))
    c = read(spark, sf, "customer").join(n, "c_nationkey")
    c = c.withColumn("legislature", F.when(F.col("c_custkey") % 3 == 0, None).otherwise((F.col("c_custkey") % 15 + 1).cast("string"))).withColumn("parliamentary_group", F.col("c_mktsegment"))
    kept = c.where(filters.matches(c, {"parliamentary_group": "Build"}, legislatures=("XIV", "XV")))
    return kept.select("c_custkey", "c_name", "c_mktsegment", "constituency")


@query(f"""
WITH p AS (SELECT p_partkey, list_distinct(regexp_extract_all({FOLD.format("p_name")}, '[a-z0-9]+')) AS t FROM part),
w AS (SELECT DISTINCT p_type, list_filter(list_distinct(regexp_extract_all({FOLD.format("split_part(p_name, ' ', 1)")}, '[a-z0-9]+')), lambda x: NOT list_contains({STOP}, x)) AS t FROM part)
SELECT DISTINCT p_partkey, p_type, len(list_filter(p.t, lambda x: NOT list_contains({STOP}, x))) = len(w.t) AS matched_exactly FROM p JOIN w ON len(w.t) > 0 AND list_has_all(p.t, w.t)""")
def token_subset_join(spark, sf):
    part = read(spark, sf, "part")
    wanted = part.select("p_type", F.split("p_name", " ")[0].alias("wanted")).distinct()
    return joins.token_subset_join(part.select("p_partkey", "p_name"), wanted, name="p_name", wanted_name="wanted", exact_first=False).select("p_partkey", "p_type", "matched_exactly").distinct()


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND lower(o_orderstatus) = 'f' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31')""")
def vote_scope(spark, sf):
    import datetime as dt

    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("vote_id"), F.col("o_orderstatus").alias("session"), F.to_date("o_orderdate").alias("vote_date"))
    lines = read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "vote_id")
    kept = filters.scoped_votes(o, lines, {"session": "f"}, date_from=dt.date(1995, 1, 1), date_to=dt.date(1996, 12, 31))
    return kept.select(F.col("vote_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def resume_pending(spark, sf):
    plan = read(spark, sf, "documents").select("doc_id", "source")
    return joins.pending(plan, read(spark, sf, "labels"), ["doc_id"], at="quality", valid=F.col("quality") == 1)


@query("""
SELECT count(e) AS expected, count(a) AS actual, count(*) FILTER (a IS NULL) AS missing, count(*) FILTER (e IS NULL) AS unexpected, count(*) FILTER (a > 1) AS duplicates
FROM (SELECT doc_id, count(*) e FROM documents GROUP BY 1) x FULL JOIN (SELECT doc_id, count(*) a FROM labels GROUP BY 1) y USING (doc_id)""")
def reconcile(spark, sf):
    return joins.reconcile(read(spark, sf, "documents"), read(spark, sf, "labels"), ["doc_id"])


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
s AS (SELECT doc_id, k, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT doc_id, CAST(k - 1 AS INT) AS line_no, CAST(start AS BIGINT) AS start, CAST(start // 1000 + 1 AS BIGINT) AS page FROM s""")
def interval_pages(spark, sf):
    docs = read(spark, sf, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    points = windows.running_offsets(lines, ["doc_id"], ["line_no"], F.length("line")).select("doc_id", "line_no", "start")
    n = F.floor(F.length("text") / 1000)
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("p")).select("doc_id", (F.col("p") + 1).alias("page"), (F.col("p") * 1000).alias("from"), (F.col("p") * 1000 + 1000).alias("to"))
    return joins.range_join(points, pages, ["doc_id"], at="start", start="from", end="to").select("doc_id", "line_no", "start", "page")


@query("""
WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
b AS (SELECT label, vec_id AS box_id, x - 0.05 - (vec_id % 3) * 0.05 AS x0, y - 0.05 - (vec_id % 3) * 0.05 AS y0, x + 0.1 AS x1, y + 0.1 AS y1 FROM p),
h AS (SELECT p.vec_id, box_id, row_number() OVER (PARTITION BY p.vec_id ORDER BY (x1 - x0) * (y1 - y0), box_id) AS k FROM p JOIN b ON p.label = b.label AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)
SELECT p.vec_id, box_id FROM p LEFT JOIN h ON h.vec_id = p.vec_id AND k = 1""")
def containment_argmin(spark, sf):
    p = read(spark, sf, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    m = (F.col("vec_id") % 3) * 0.05
    b = p.select("label", F.col("vec_id").alias("box_id"), F.array(F.col("x") - 0.05 - m, F.col("y") - 0.05 - m, F.col("x") + 0.1, F.col("y") + 0.1).alias("box"))
    return joins.smallest_container(p, b, ["label"], x="x", y="y", box="box", order=["box_id"]).select("vec_id", "box_id")


@query("""
SELECT o_orderkey, o_totalprice FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND abs(l_extendedprice - o_totalprice) <= 20000)""")
def overlap_suppress(spark, sf):
    g = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    s = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_extendedprice")
    out = joins.suppress_overlaps(g, s, ["k"], F.abs(F.col("s.l_extendedprice") - F.col("g.o_totalprice")) <= 20000, near=("o_totalprice", "l_extendedprice", 20000.0))
    return out.select(F.col("k").alias("o_orderkey"), "o_totalprice")


@query("""
WITH u AS (SELECT conv_id, turn, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS occ FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.turn, u.occ AS occurrence, a.text AS reply FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.k = least(u.occ, a.n - 1)""")
def nth_match(spark, sf):
    c = read(spark, sf, "conversations")
    u = windows.occurrence_index(c.where("role = 'user'").withColumn("at", F.lpad(F.col("turn").cast("string"), 9, "0")), ["conv_id"], ["at"])
    a = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("reply"))
    return joins.nth_match(u.select("conv_id", "turn", "occurrence"), a, ["conv_id"], occurrence="occurrence", order=["t"]).select("conv_id", "turn", "occurrence", "reply")


@query("""
SELECT l_orderkey, min(l_suppkey) AS l_suppkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1""")
def unique_role(spark, sf):
    return aggregates.unique_values(read(spark, sf, "lineitem"), ["l_orderkey"], "l_suppkey", "l_linenumber").select("l_orderkey", "l_suppkey", "l_linenumber")


@query("""
SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'purchase') AS n_purchase,
  count(*) FILTER (event_type IN ('click', 'view', 'purchase')) = count(*) AS reconciled FROM events GROUP BY user_id""")
def category_reconcile(spark, sf):
    return aggregates.category_counts(read(spark, sf, "events"), ["user_id"], "event_type", ["click", "view", "purchase"])


@query("""
SELECT (SELECT count(*) = 0 FROM lineitem WHERE l_quantity <= 0) AS quantities, (SELECT max(l_discount) <= 0.2 FROM lineitem) AS discounts, (SELECT count(*) > 0 FROM lineitem) AS there,
  (SELECT count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem) AS unique_keys, false AS passed""")
def audit_gates(spark, sf):
    named = {"quantities": F.count_if(F.col("l_quantity") <= 0) == 0, "discounts": F.max("l_discount") <= 0.2, "there": F.count("*") > 0, "unique_keys": F.count("*") == F.count_distinct("l_orderkey", "l_linenumber")}
    return aggregates.gates(read(spark, sf, "lineitem"), named)


@query("""
SELECT c_mktsegment, CAST(sum(CAST('0x' || substr(sha256(c_custkey || '|' || c_name), 1, 15) AS HUGEINT)) AS VARCHAR) AS bits, count(*) AS n FROM customer GROUP BY 1""")
def cross_format_semantics(spark, sf):
    row = F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name")
    return aggregates.ordered_fingerprint(read(spark, sf, "customer"), ["c_mktsegment"], row).withColumn("bits", F.col("bits").cast("string"))


@query("""
SELECT source, line, count(DISTINCT doc_id) AS pages FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 3 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3""")
def repeated_lines(spark, sf):
    lines = read(spark, sf, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).where("length(line) >= 3")
    return aggregates.repeated_lines(lines, ["source"], "line", "doc_id", 3)


@query("""
SELECT user_id, event_type, min(event_id) AS first, count(DISTINCT props) AS n_evidence FROM events GROUP BY 1, 2""")
def candidate_groups(spark, sf):
    return aggregates.group_candidates(read(spark, sf, "events"), ["user_id", "event_type"], "props", "event_id").select("user_id", "event_type", "first", F.size("evidence").cast("long").alias("n_evidence"))


@query("""
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(value > 50 AS INT) DESC, event_id) AS k FROM events) WHERE k = 1""")
def completeness_dedup(spark, sf):
    e = read(spark, sf, "events").withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return dedup.most_complete(e, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("""
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_id) AS k FROM events WHERE event_type IN ('purchase', 'click', 'view')) WHERE k = 1""")
def preferred_format(spark, sf):
    return dedup.preferred(read(spark, sf, "events"), ["user_id"], "event_type", ["purchase", "click", "view"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def last_wins(spark, sf):
    return dedup.last_per_key(read(spark, sf, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT count(*) AS n, count(DISTINCT (user_id, event_type)) AS n_distinct, count(*) - count(DISTINCT (user_id, event_type)) AS duplicates FROM events")
def run_duplicates(spark, sf):
    return dedup.duplicate_count(read(spark, sf, "events"), ["user_id", "event_type"])


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY CAST(CAST(o_orderdate AS DATE) AS VARCHAR) DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 50""")
def newest_examples(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.orderBy(*limits.sort_key(F.col("day"), F.col("o_orderkey").cast("string"), descending=True)).limit(50)


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked_at FROM conversations""")
def carry_forward(spark, sf):
    c = read(spark, sf, "conversations")
    return windows.carry_forward(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "asked_at").select("conv_id", "turn", "asked_at")


@query("""
WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, event_type AS value, count(*) AS n FROM a GROUP BY user_id, event_type, g HAVING count(*) >= 3""")
def islands(spark, sf):
    return windows.islands(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"), 3).select("user_id", "value", "n")


@query("""
WITH v AS (SELECT user_id, ts, event_id, CASE WHEN value > 80 THEN event_id END AS v FROM events),
w AS (SELECT *, lag(v, 1) OVER o AS p1, lead(v, 1) OVER o AS n1, lag(v, 2) OVER o AS p2, lead(v, 2) OVER o AS n2, lag(v, 3) OVER o AS p3, lead(v, 3) OVER o AS n3 FROM v WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, coalesce(p1, n1, p2, n2, p3, n3) AS near FROM w""")
def neighbour_lookup(spark, sf):
    value = F.when(F.col("value") > 80, F.col("event_id"))
    return windows.nearest_neighbour(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], value, "near").select("event_id", "near")


@query("""
WITH n AS (SELECT doc_id, text, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 2000 THEN 1 ELSE CAST(ceil((length(text) - 2000) / 1900.0) AS BIGINT) + 1 END AS k FROM documents),
c AS (SELECT doc_id, text, unnest(range(k)) AS chunk FROM n)
SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(chunk * 1900 AS BIGINT) AS start, CAST(length(substr(text, CAST(chunk * 1900 + 1 AS BIGINT), 2000)) AS INT) AS length, md5(substr(text, CAST(chunk * 1900 + 1 AS BIGINT), 2000)) AS digest FROM c""")
def char_windows(spark, sf):
    w = windows.char_windows(read(spark, sf, "documents").select("doc_id", "text"), "text", size=2000, overlap=100, most=None)
    return w.select("doc_id", "chunk", "start", F.length("piece").alias("length"), F.md5(F.col("piece").cast("binary")).alias("digest"))


@query("""
SELECT 'both' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_ops(spark, sf):
    c, s = read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    n = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return n(c.intersect(s), "both").union(n(c.subtract(s), "customers")).union(n(c.union(s).distinct(), "either"))


@query("""
SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'a' END AS none, least(0.9, greatest(0.35, round(0.62 + CASE WHEN p_size % 2 = 0 THEN 0.12 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.12 ELSE 0 END, 6))) AS confidence,
  CASE WHEN p_size % 3 = 0 THEN 'real_estate' WHEN p_size % 3 = 1 THEN 'vehicle' ELSE 'income' END AS family FROM part""")
def rule_cascade(spark, sf):
    words = F.element_at(F.array(*map(F.lit, ("una vivienda", "un automóvil", "sueldo anual"))), F.col("p_size") % 3 + 1)
    amount = F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice"))
    return read(spark, sf, "part").select("p_partkey", F.when(F.contains("p_type", F.lit("STEEL")), "a").alias("none"), declarations.line_confidence(words, amount, F.col("p_size") % 3 == 0).alias("confidence"), declarations.classify(text.fold(words))["family"].alias("family"))


@query(r"""
SELECT doc_id, m AS value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS m FROM documents) GROUP BY 1, 2""")
def regex_candidates(spark, sf):
    rules = [extraction.Rule("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")]
    found = extraction.regex_candidates(read(spark, sf, "documents").select("doc_id", "text"), rules, key="doc_id")
    return found.groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, sha256('{"key":"' || o_orderkey || '","status":"' || o_orderstatus || '"}') AS digest FROM orders""")
def fingerprint(spark, sf):
    m = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("key"), F.col("o_orderkey").cast("string"))
    return read(spark, sf, "orders").select("o_orderkey", ids.fingerprint(m).alias("digest"))


@query()
def visible_text(spark, sf):
    pages = html.visible_html(read(spark, sf, "pages").select("page_id", "url", "html"), "html")
    return pages.select("page_id", "visible.visible_text", F.size("visible.links").alias("n_links"), "visible.content_selector")


@query()
def fuzzy_names(spark, sf):
    names = read(spark, sf, "part").select(text.speaker_key(F.col("p_name")).alias("wanted")).distinct()
    other = names.select(F.concat_ws(" ", F.reverse(F.split("wanted", " "))).alias("found"), "wanted")
    return other.select("wanted", "found", speech.speakers_match("wanted", "found").alias("same"), F.round(speech.similarity("wanted", "found"), 6).alias("ratio"))


@query("""SELECT conv_id, count(*) AS n_turns FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def speech_blocks(spark, sf):
    c = read(spark, sf, "conversations").where("role in ('user', 'assistant')")
    line = F.concat(F.when(F.col("role") == "user", "La señora RUIZ (Ana): ").otherwise("El señor VEGA (Luis): "), F.regexp_replace("text", r"[\s():]+", " "))
    docs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return speech.speech_blocks(docs, key="conv_id").where("turn_kind = 'formal_turn'").groupBy("conv_id").agg(F.count("*").alias("n_turns"))


@query("""
WITH a AS (SELECT conv_id, turn, text, role FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, CASE role WHEN 'user' THEN 'RUIZ' ELSE 'VEGA' END AS speaker, count(*) AS n, CAST(0.9 AS DOUBLE) AS confidence FROM a GROUP BY ALL""")
def intervention_text(spark, sf):
    c = read(spark, sf, "conversations").where("role in ('user', 'assistant')")
    who = F.when(F.col("role") == "user", "RUIZ").otherwise("VEGA")
    blocks = c.select(F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("ordinal"), text.speaker_key(who).alias("normalized_speaker"), "text")
    rows = c.select(F.col("conv_id").alias("document_id"), who.alias("speaker"), F.lpad(F.col("turn").cast("string"), 5, "0").alias("starts_at"), F.lit("").alias("ends_at"))
    found = speech.with_text(rows, blocks).where("text_status = 'matched'")
    return found.groupBy(F.col("document_id").alias("conv_id"), "speaker").agg(F.count_distinct("ordinal").alias("n"), F.min("match_confidence").alias("confidence"))


@query("""
WITH v AS (SELECT o_orderkey, o_orderdate, l_suppkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, 'official_json_nominal' AS source_mode, 'recorded_vote' AS decision_method, strftime(any_value(o_orderdate), '%Y-%m-%d') AS day, count(*) AS n FROM v GROUP BY o_orderkey""")
def vote_normalization(spark, sf):
    o, n = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    rows = n.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit("1").alias("asiento"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("diputado"), F.lit("G").alias("grupo"), F.lit("Sí").alias("voto"))).alias("votaciones"))
    votes = o.join(rows, o.o_orderkey == rows.l_orderkey).select(
        F.lit("XV").alias("legislature"), F.lit(None).cast("string").alias("source_url"), "votaciones", "o_orderkey",
        F.struct(F.date_format("o_orderdate", "d/M/yyyy").alias("fecha"), F.lit(1).alias("sesion"), F.col("o_orderkey").alias("numeroVotacion"), F.lit("t").alias("titulo"), F.lit("e").alias("textoExpediente"), F.lit("s").alias("tituloSubGrupo"), F.lit(None).cast("array<struct<textoExpediente: string>>").alias("votacionesConjuntas")).alias("informacion"),
        F.struct(F.lit(1).alias("presentes"), F.lit(1).alias("afavor"), F.lit(0).alias("enContra"), F.lit(0).alias("abstenciones"), F.lit(0).alias("noVotan"), F.lit("No").alias("asentimiento")).alias("totales"),
    )
    e = domains.vote_events(votes).select("vote_id", F.col("vote_number").cast("long").alias("o_orderkey"), "source_mode", "decision_method", F.col("vote_date").cast("string").alias("day"))
    return e.join(domains.nominal_votes(votes).groupBy("vote_id").agg(F.count("*").alias("n")), "vote_id").drop("vote_id")


@query("""
SELECT c_custkey, c_name || ', ' || c_mktsegment AS full_name, sha256(c_name || ', ' || c_mktsegment) AS deputy_id, CAST(30 AS INT) AS age_at_snapshot, CASE WHEN c_custkey % 2 = 0 THEN '2' END AS gender FROM customer""")
def deputy_rows(spark, sf):
    c = read(spark, sf, "customer")
    record = F.create_map(F.lit("Nombre"), F.col("c_mktsegment"), F.lit("APELLIDOS"), F.col("c_name"), F.lit("Fecha Nacimiento"), F.lit("1/2/1994"), F.lit("Sexo"), F.when(F.col("c_custkey") % 2 == 0, "Mujer").otherwise(""))
    raw = c.select("c_custkey", record.alias("record"), F.col("c_custkey").cast("string").alias("source_sha256"), F.lit("2024-06-15").alias("snapshot_date"))
    return domains.deputies(raw).select(F.col("source_file_sha256").cast("long").alias("c_custkey"), "full_name", "deputy_id", "age_at_snapshot", "gender")


@query("""
SELECT c_custkey AS deputy_id, c_name AS full_name, c_mktsegment AS parliamentary_group, n_name AS constituency FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'""")
def deputy_search(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("constituency"))
    people = read(spark, sf, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("deputy_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("parliamentary_group"), "constituency")
    return services.search(people, services.Query(filters={"parliamentary_group": "building"}, max_results=None), identity="deputy_id", service="deputies")


@query("""SELECT o_orderkey AS doc, CAST(3 + o_orderkey % 2 AS INT) AS present, o_orderkey % 3 <> 0 AS reconciled, CAST(3 + o_orderkey % 2 AS BIGINT) AS n, CAST(o_orderkey AS INT) AS vote_number, CAST(o_orderdate AS DATE) AS vote_date FROM orders""")
def vote_sheets(spark, sf):
    """Sheets of two sizes; every third one's totals are not those of its names."""
    k = F.col("o_orderkey")
    total = F.concat((3 + k % 2).cast("string"), F.when(k % 3 == 0, " 3 ").otherwise(" 2 "), F.when(k % 3 == 0, "0 ").otherwise("1 "), (k % 2).cast("string"), F.lit(" 0"))
    first = F.concat(k.cast("string"), F.lit(" Votación: Sesión: 2 Fecha: "), F.date_format("o_orderdate", "d-M-yyyy"), F.lit("\nPresentes Sí No Abstenciones No votan\n"), total)
    second = F.concat_ws("\n", F.lit("Sí\nGrupo Uno\n-Pérez Gil, Ana 12\n-Ruiz Sol, Luis TELEMÁTICO\nNo\n-Vega Paz, Eva 7"), F.when(k % 2 == 1, "Abstenciones\n-Mar Río, Noa 9"))
    docs = read(spark, sf, "orders").select(k.alias("doc"), F.array(first, second).alias("pages"))
    return votes_text.reconciled_sheets(docs).select("doc", "present", "reconciled", F.col("rows").alias("n"), "vote_number", "vote_date")


@query("SELECT c_nationkey AS legislature, count(*) AS total, CAST(ceil(count(*) / 100.0) AS BIGINT) AS pages, max(n) AS last FROM (SELECT c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) GROUP BY 1")
def request_pages(spark, sf):
    totals = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("legislature")).agg(F.count("*").alias("total")).withColumn("filters", F.create_map(F.lit("leg"), F.col("legislature").cast("string")))
    return catalog.export_pages(totals).groupBy("legislature").agg(F.max("total").alias("total"), F.count("*").alias("pages"), F.max("last_result").alias("last"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def export_roundtrip(spark, sf):
    import uuid

    region, out = read(spark, sf, "region"), None
    for kind in sinks.FORMATS:
        path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
        sinks.export_records(region, path, format_name=kind)
        back = sinks.read_export(spark, path, kind, region.schema).select(F.col("r_regionkey").cast("int"), "r_name")
        out = back if out is None else out.union(back)
    return out


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    import uuid

    from hemiciclo.streaming import ingest

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = read(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    ingest.run_available(ingest.distinct_stream(rows.select("user_id", "event_type"), ["user_id", "event_type"]), f"{base}/out", f"{base}/state")
    return spark.read.schema("user_id long, event_type string").parquet(f"{base}/out")


@query("SELECT o_orderstatus, o_orderkey, o_custkey FROM orders")
def json_records(spark, sf):
    o = read(spark, sf, "orders")
    files = o.groupBy(F.floor(F.col("o_orderkey") / 50).alias("f")).agg(F.to_json(F.collect_list(F.struct("o_orderkey", "o_custkey", "o_orderstatus"))).alias("content"))
    r = lambda k: F.element_at("record", k)
    return records.json_records(files).select(r("o_orderstatus").alias("o_orderstatus"), r("o_orderkey").cast("long").alias("o_orderkey"), r("o_custkey").cast("long").alias("o_custkey"))


@query("SELECT item_id, doc_id, CAST(instr(d.text, b.text) - 1 AS INT) AS first_at FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_evidence(spark, sf):
    """Quotes of three words or more are found by their words but the first and the last, at most six, then confirmed: an equi-join on a hash.

    Words at a quote's ends may be parts of a text's words, those inside are whole. Quotes of fewer words have none
    inside; they are the stated query set, each looked for in every text.
    """
    most = 6
    words = lambda c: F.split(F.regexp_replace(c, "\n", " "), " ")
    gram = lambda w, i, n: F.xxhash64(F.array_join(F.slice(w, i, n), " "))
    quotes = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"), words(F.col("text")).alias("w"))
    long = quotes.where(F.size("w") > 2).select("item_id", F.least(F.size("w") - 2, F.lit(most)).alias("n"), "w").select("item_id", "n", gram(F.col("w"), 2, F.col("n")).alias("g"))
    sizes = [r.n for r in long.select("n").distinct().collect()]  # six at most
    docs = read(spark, sf, "documents").select("doc_id", "text")
    found = None
    for n in sizes:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        grams = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(F.transform(starts, lambda i: gram(F.col("w"), i, F.lit(n))))).alias("g"))  # noqa: B023
        hits = grams.join(long.where(F.col("n") == n).select("item_id", "g"), "g").select("doc_id", "item_id")
        found = hits if found is None else found.union(hits)
    at = (F.instr("text", F.col("quote")) - 1).alias("first_at")
    short = docs.join(quotes.where(F.size("w") < 3).select("item_id", "quote"), F.contains("text", F.col("quote"))).select("item_id", "doc_id", at)
    if found is None:
        return short
    pairs = found.distinct().join(quotes.select("item_id", "quote"), "item_id").join(docs, "doc_id").where(F.contains("text", F.col("quote"))).select("item_id", "doc_id", at)
    return pairs.union(short)


# These register their own queries here.
from hemiciclo.plans import queries_domains, queries_pages, queries_rules, queries_sources, queries_text  # noqa: E402, F401
