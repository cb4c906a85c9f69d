"""More queries, of relational operators, extraction, declarations, transcripts, audits and search services."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hemiciclo.functions.text import fold, identity_tokens, is_subset
from hemiciclo.operators import aggregates, dedup, filters, joins, limits, windows
from hemiciclo.plans import audits, declarations, extraction, services, speech, votes_text
from hemiciclo.plans.queries import query, read

S = "string"


def _key(*names: str):
    return F.concat_ws(":", *(F.col(n).cast(S) for n in names))


@query("""
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY coalesce(d, DATE '0001-01-01'), s, CAST(o_orderkey AS VARCHAR)) AS INT) AS place, CASE WHEN n <= 2 THEN '1' || CASE n WHEN 2 THEN ' 2' ELSE '' END ELSE (n - 1) || ' ' || n END AS tail, CAST(o_orderkey + 1 AS VARCHAR) AS emitted
FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS d, o_orderstatus AS s, o_custkey % 4 + 1 AS n FROM orders)""")
def ordered_interventions(spark, sf):
    """Interventions in order of day, hour, document and id; the last two of a list; the last figure that a text gives."""
    from pyspark.sql import Window as W

    o = read(spark, sf, "orders").withColumns({"d": F.when(F.col("o_orderkey") % 3 > 0, F.to_date("o_orderdate")), "doc": F.lit(None).cast(S), "id": F.col("o_orderkey").cast(S)})
    rows = limits.ensure_at_most(o, 1_000_000_000).withColumn("place", F.row_number().over(W.orderBy(*limits.intervention_order("d", "o_orderstatus", "doc", "id"))))
    said = F.concat(F.lit("Votos emitidos: 12. Votos emitidos: "), (F.col("o_orderkey") + 1).cast(S), F.lit("."))
    return rows.select("o_orderkey", "place", F.array_join(limits.last_k(F.sequence(F.lit(1), (F.col("o_custkey") % 4 + 1).cast("int")), 2), " ").alias("tail"), windows.last_match(said, r"emitidos: (\d+)").alias("emitted"))


@query("""
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS ordinal, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, turn IN (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id GROUP BY role) AS last_of_role FROM conversations c""")
def renumbered_turns(spark, sf):
    c = read(spark, sf, "conversations")
    placed = windows.running_offsets(windows.renumber(c, ["conv_id"], ["turn"]), ["conv_id"], ["turn"], F.length("text"))
    last = dedup.keep_order(c, ["conv_id", "role"], "turn").select("conv_id", "turn", F.lit(True).alias("last_of_role"))
    return placed.join(last, ["conv_id", "turn"], "left").select("conv_id", "turn", "ordinal", "start", F.coalesce("last_of_role", F.lit(False)).alias("last_of_role"))


@query("""
WITH m AS (SELECT *, min(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id) AS a FROM events), s AS (SELECT *, min(CASE WHEN event_type = 'purchase' AND event_id > a THEN event_id END) OVER (PARTITION BY user_id) AS b FROM m)
SELECT event_id, user_id, max(CASE WHEN value > 60 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS previous, min(CASE WHEN value > 60 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS next
FROM s WHERE event_id > a AND (b IS NULL OR event_id < b)""")
def between_markers(spark, sf):
    """The events after a user's first click and before the first purchase that follows, each with the nearest large ones."""
    inside = windows.between_markers(read(spark, sf, "events"), ["user_id"], ["event_id"], F.col("event_type") == "click", F.col("event_type") == "purchase")
    return windows.nearest_within(inside, ["user_id"], ["event_id"], F.when(F.col("value") > 60, F.col("event_id")), back=3, ahead=2).select("event_id", "user_id", "previous", "next")


@query("""
SELECT doc_id, CAST(list_sum(list_transform(l, lambda x: CAST(regexp_matches(x, '^[^a-z]') OR x = l[1] AS INT))) AS INT) AS groups, l[1] AS first FROM (SELECT doc_id, list_filter(string_split(lower(source || chr(10) || lang || chr(10) || 'x' || chr(10) || (doc_id % 7) || chr(10) || 'y'), chr(10)), lambda x: x <> '') AS l FROM documents)""")
def folded_lines(spark, sf):
    """Lines that begin with a letter join the line before; the first line begins a group anyway."""
    lines = F.split(F.lower(F.concat_ws("\n", "source", "lang", F.lit("x"), (F.col("doc_id") % 7).cast(S), F.lit("y"))), "\n")
    grown = windows.fold_lines(lines, lambda grown, line: line.rlike("^[a-z]"))
    return read(spark, sf, "documents").select("doc_id", F.size(grown).alias("groups"), F.split(grown[0], " ")[0].alias("first"))


@query("""
SELECT c_custkey, CAST(1 + c_custkey % 4 AS INT) AS cells, c_custkey % 4 > 0 OR c_custkey % 2 = 0 AS table_row, list_contains(['BUILDING', 'MACHINERY'], c_mktsegment) AS any_token, c_nationkey % 2 = 0 AS subset FROM customer""")
def line_shapes(spark, sf):
    k = F.col("c_custkey")
    row = F.concat(F.array_join(F.sequence(F.lit(0), (k % 4).cast("int")).cast("array<string>"), "   "), F.when((k % 4 == 0) & (k % 2 == 0), " total 1.234,50 €").otherwise(""))
    return read(spark, sf, "customer").select(
        "c_custkey", aggregates.column_counts(F.array(F.array_join(F.sequence(F.lit(0), (k % 4).cast("int")).cast("array<string>"), "   "), F.lit("uno"))).alias("cells"), filters.looks_like_table_row(row).alias("table_row"),
        filters.any_token(F.lower("c_mktsegment"), ("building", "machin")).alias("any_token"), is_subset(identity_tokens(F.when(F.col("c_nationkey") % 2 == 0, "Pérez de la Ana").otherwise("de la")), identity_tokens(F.lit("Ana Pérez Gil"))).alias("subset"),
    )


@query("""
SELECT count(*) AS records, count(*) - count(DISTINCT (user_id, event_type)) AS duplicates, count(*) FILTER (value > 50) AS unmatched, round(avg(CASE WHEN value > 1e9 THEN value END), 6) AS none, 0.75 AS mean, count(*) AS n, CAST(0 AS BIGINT) AS failures, true AS complete, true AS equal, false AS other FROM events""")
def run_reports(spark, sf):
    """One run's metrics, its completion, and whether two reads of a table are the same set."""
    e = read(spark, sf, "events").withColumn("id", _key("user_id", "event_type"))
    m = aggregates.run_metrics(e, "id", F.col("value") > 50)
    means = e.agg(aggregates.mean_or(F.when(F.col("value") > 1e9, F.col("value")), None).alias("none"), aggregates.mean_or(F.when(F.col("value") > 1e9, F.col("value")), 0.75).alias("mean"))
    done = audits.completion(e.withColumn("error", F.lit(None).cast(S)), F.col("records")).withColumnRenamed("records", "n")
    ids = e.select("event_id")
    same = joins.sets_equal(ids, ids.union(ids)).crossJoin(joins.sets_equal(ids, ids.where("event_id > 3")).withColumnRenamed("equal", "other"))
    return m.crossJoin(means).crossJoin(done).crossJoin(same)


@query("""
SELECT 'first' AS how, CAST(user_id AS VARCHAR) AS k, CAST(min(event_id) AS BIGINT) AS v FROM events GROUP BY user_id UNION ALL SELECT 'distinct', CAST(doc_id AS VARCHAR), 2 FROM documents UNION ALL SELECT 'children', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey
UNION ALL SELECT 'without', CAST(o_orderkey AS VARCHAR), o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'examples', CAST(o_orderkey AS VARCHAR), o_custkey FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)""")
def keyed_rows(spark, sf):
    """First rows of keys, distinct values in order, children of some parents, rows without a partner, a report's examples."""
    row = lambda d, how, k, v: d.select(F.lit(how).alias("how"), F.col(k).cast(S).alias("k"), F.col(v).cast("long").alias("v"))
    o, items = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    first = dedup.first_per_key(read(spark, sf, "events"), ["user_id"], ["event_id"])
    twice = read(spark, sf, "documents").select("doc_id", F.size(dedup.distinct_list(F.array(F.lit("b"), F.lit("a"), F.lit("b")))).alias("n"))
    children = joins.children_of(items, o.where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    alone = joins.without(o.select("o_orderkey", "o_custkey"), items.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])
    top = limits.examples(o, [F.desc("o_totalprice"), "o_orderkey"], 20)
    return row(first, "first", "user_id", "event_id").union(row(twice, "distinct", "doc_id", "n")).union(row(children, "children", "l_orderkey", "n")).union(row(alone, "without", "o_orderkey", "o_custkey")).union(row(top, "examples", "o_orderkey", "o_custkey"))


@query("""
WITH w AS (SELECT doc_id, c, substr(text, CAST(c * 900 + 1 AS BIGINT), 1000) AS piece FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1000 THEN 1 ELSE CAST(ceil((length(text) - 1000) / 900.0) AS BIGINT) + 1 END)) AS c FROM documents))
SELECT doc_id, kind, value, error, min(start) AS first, max(sure) AS confidence, 'review_required' AS status FROM (
  SELECT doc_id, CASE WHEN n % 5 > 0 THEN 'length' END AS kind, CASE WHEN n % 5 > 0 THEN CAST(n // 100 AS VARCHAR) END AS value, CASE WHEN n % 5 = 0 THEN 'ValueError: second' END AS error, CASE WHEN n % 5 > 0 THEN c * 900 END AS start, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 2 = 0 THEN 0.25 ELSE 0.5 END AS sure FROM (SELECT *, length(piece) AS n FROM w)) GROUP BY doc_id, kind, value, error""")
def model_answers(spark, sf):
    """User models over windows: the first declines even lengths, the second answers them, both fail on lengths that five divides; a candidate quotes the window's beginning."""

    def one(task: extraction.Task, piece: str) -> object:
        if len(piece) % 2 == 0:
            raise RuntimeError("first")
        return two(task, piece) | {"x": 1} if len(piece) % 5 else two(task, piece)

    def two(task: extraction.Task, piece: str) -> dict:
        if len(piece) % 5 == 0:
            raise ValueError("second")
        return {"candidates": [{"kind": task.name, "value": str(len(piece) // 100), "quote": piece, "confidence": 0.25 if len(piece) % 2 == 0 else 0.5}]}

    models = extraction.Registry()
    models.register("one", one)
    models.register("two", two)
    task = extraction.Task("length", size=1000, overlap=100, most=1_000_000)
    found = extraction.model_candidates(read(spark, sf, "documents").select("doc_id", "text"), task, [models.get(n) for n in models.names()], key="doc_id")
    return found.select("doc_id", "kind", "value", "error", F.array_min("evidence.start").alias("first"), "confidence", "status")


@query("""
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'real_estate' WHEN 1 THEN 'liability' WHEN 2 THEN 'income' WHEN 3 THEN 'vehicle' END AS family, p_size % 5 = 4 AS boilerplate, CASE p_size % 5 WHEN 2 THEN 'interest' END AS income, CASE p_size % 2 WHEN 0 THEN 'Soria' END AS city FROM part""")
def declaration_lines(spark, sf):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_size") % len(x) + 1).cast("int"))
    line = fold(pick("Vivienda con garaje", "Préstamo sobre la vivienda", "Intereses de su capital", "Un turismo", "Firma y página 3"))
    return read(spark, sf, "part").select("p_partkey", declarations.classify(line)["family"].alias("family"), declarations.is_boilerplate(line).alias("boilerplate"), declarations._category(line, declarations.INCOME_WORDS).alias("income"), declarations.known_city(pick("Piso en Soria", "Piso en el campo")).alias("city"))


PAGE_SQL = "SELECT p_partkey AS doc, CAST(1 AS INT) AS page, p_size AS n FROM part"


def _pages(spark, sf, *lines):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), F.concat_ws("\n", *lines).alias("text"))


def _euro(whole):
    return F.concat(F.replace(F.format_number(whole, 0), F.lit(","), F.lit(".")), F.lit(",50 €"))


@query(f"""
SELECT doc, page, family, amount, percentage, round(confidence, 6) AS confidence, needs_review FROM (
  SELECT doc, page, 'real_estate' AS family, CAST(n * 1000 AS DOUBLE) + 0.5 AS amount, CAST(25 AS DOUBLE) AS percentage, 0.86 AS confidence, false AS needs_review FROM ({PAGE_SQL})
  UNION ALL SELECT doc, page, 'income', NULL, NULL, 0.62, true FROM ({PAGE_SQL}) WHERE n % 2 = 0)""")
def declaration_items(spark, sf):
    """Logical lines to items: a line goes on in lower case; boilerplate and lines of no family have none."""
    n = F.col("p_size")
    pages = _pages(spark, sf, F.lit("Registro de Intereses del Congreso de los Diputados"), F.lit("Vivienda del 25 % en"), F.concat(F.lit("la costa por "), _euro(n * 1000)), F.when(n % 2 == 0, "Sueldo de Director."), F.lit("Nada que decir"))
    return declarations.items(pages).select("doc", "page", "family", "amount", "percentage", "confidence", "needs_review")


@query(f"""
SELECT CAST(doc AS VARCHAR) AS doc, page, entity_type, value, amount FROM (
  SELECT doc, page, 'amount' AS entity_type, CASE WHEN n * 1000 >= 1000 THEN n || '.000' ELSE '0' END || ',50 €' AS value, CAST(n * 1000 AS DOUBLE) + 0.5 AS amount FROM ({PAGE_SQL})
  UNION ALL SELECT doc, page, 'date', '05/03/2024', NULL FROM ({PAGE_SQL}) UNION ALL SELECT doc, page, 'percentage', '25 %', NULL FROM ({PAGE_SQL}) UNION ALL SELECT doc, page, 'location', 'Soria', NULL FROM ({PAGE_SQL}) UNION ALL SELECT doc, page, 'registry', 'finca nº ' || n, NULL FROM ({PAGE_SQL}))""")
def declaration_entities(spark, sf):
    n = F.col("p_size")
    pages = _pages(spark, sf, F.concat(F.lit("comprada el 05/03/2024 por "), _euro(n * 1000)), F.concat(F.lit("el 25 % de la finca nº "), n.cast(S), F.lit(" en Soria")))
    return declarations.entities(pages).select("doc", "page", "entity_type", "value", "amount")


@query(f"""
SELECT doc, 'income' AS family, 'salary' AS category, 'Sueldo anual' AS description, CAST(n * 1000 AS DOUBLE) + 0.5 AS amount, CAST(NULL AS DOUBLE) AS pending, 0.86 AS confidence FROM ({PAGE_SQL})
UNION ALL SELECT doc, 'asset', 'fund', 'Fondo de inversión', CAST(n AS DOUBLE) + 0.5, NULL, 0.86 FROM ({PAGE_SQL}) WHERE n % 2 = 0
UNION ALL SELECT doc, 'liability', NULL, 'Préstamo del banco', CAST(n * 3 AS DOUBLE) + 0.5, CASE WHEN n % 3 = 0 THEN CAST(n AS DOUBLE) + 0.5 END, NULL FROM ({PAGE_SQL})
UNION ALL SELECT doc, 'real_estate', NULL, 'Piso de ' || n || ' metros; Soria; Compraventa', NULL, NULL, 0.86 FROM ({PAGE_SQL}) WHERE n % 2 = 1""")
def declaration_forms(spark, sf):
    """The four parts of a structured form, each on lines of its own."""
    n = F.col("p_size")
    lines = lambda *x: declarations.logical_lines(_pages(spark, sf, *x))
    nothing = F.lit(None)
    incomes = declarations.structured_income(lines(F.lit("Sueldo anual"), _euro(n * 1000)))
    assets = declarations.structured_assets(lines(F.lit("Fondo de inversión"), F.when(n % 2 == 0, _euro(n))))
    debts = declarations.structured_liabilities(lines(F.lit("Préstamo del banco"), F.concat(F.lit("Concedido "), _euro(n * 3)), F.lit("Plazo"), F.when(n % 3 == 0, F.concat(F.lit("Pendiente "), _euro(n)))))
    homes = declarations.structured_real_estate(lines(F.concat(F.lit("Piso de "), n.cast(S), F.lit(" metros")), F.lit("Soria"), F.when(n % 2 == 1, "Compraventa").otherwise("Otro")))
    one = lambda d, **more: d.select("doc", "family", *(more.get(c, F.col(c) if c in d.columns else nothing).cast(k).alias(c) for c, k in (("category", S), ("description", S), ("amount", "double"), ("pending", "double"), ("confidence", "double"))))
    return one(incomes).union(one(assets)).union(one(debts, amount=F.col("granted"))).union(one(homes))


@query(f"""
SELECT doc, 'generic' AS kind FROM ({PAGE_SQL}) WHERE n % 3 = 0 UNION ALL SELECT doc, 'structured' FROM ({PAGE_SQL})""")
def merged_items(spark, sf):
    """A generic item stays where its amount is not that of the structured one, which otherwise stands for both."""
    base = read(spark, sf, "part").select(F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), F.lit("income").alias("family"), F.col("p_size").cast("double").alias("amount"), F.lit(None).cast("double").alias("percentage"), F.lit("Sueldo").alias("description"), F.lit(0).alias("pos"))
    structured = base.withColumn("item_id", F.concat(F.lit("s"), F.col("doc").cast(S)))
    generic = base.withColumn("item_id", F.concat(F.lit("g"), F.col("doc").cast(S))).withColumn("amount", F.col("amount") + F.when(F.col("amount") % 3 == 0, 1.0).otherwise(0.005))
    return declarations.merged(structured, generic).select("doc", F.when(F.col("item_id").startswith("g"), "generic").otherwise("structured").alias("kind"))


@query(f"""SELECT doc, page, CAST(1 AS INT) AS first_line, CAST(3 AS INT) AS last_line, CAST(3 AS BIGINT) AS n FROM ({PAGE_SQL}) WHERE n % 2 = 0""")
def table_blocks(spark, sf):
    third = F.when(F.col("p_size") % 2 == 0, "c   3").otherwise("sin celdas")
    return declarations.table_blocks(_pages(spark, sf, F.lit("Título"), F.lit("a   1"), F.lit("b   2"), third, F.lit("fin"))).select("doc", "page", "first_line", "last_line", "n")


@query(f"""
SELECT doc, line, raw, CAST(replace(raw, ',', '.') AS DOUBLE) AS amount, quarantine FROM (
  SELECT doc, CAST(0 AS INT) AS line, n || ',50' AS raw, CAST(NULL AS VARCHAR) AS quarantine FROM ({PAGE_SQL}) UNION ALL SELECT doc, 1, '7', 'bare_number' FROM ({PAGE_SQL}) UNION ALL SELECT doc, 2, '9,25', 'outside_eligible_block' FROM ({PAGE_SQL}) UNION ALL SELECT doc, 3, '8,25', 'low_score' FROM ({PAGE_SQL}))""")
def scanned_amounts(spark, sf):
    """Lines of a scan with the smallest block around their centre; numbers of figures, of weak lines and bare ones are set apart."""
    box = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    block = lambda label, *x: F.struct(F.lit(label).alias("label"), box(*x).alias("bbox"))
    results = read(spark, sf, "part").select(
        F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"),
        F.array(F.concat(F.lit("Total "), F.col("p_size").cast(S), F.lit(",50")), F.lit("Hoja 7"), F.lit("Sello 9,25"), F.lit("Borroso 8,25")).alias("texts"), F.array(*map(F.lit, (0.99, 0.95, 0.99, 0.5))).alias("scores"),
        F.array(box(10, 10, 20, 14), box(10, 20, 20, 24), box(60, 60, 70, 64), box(10, 30, 20, 34)).alias("boxes"), F.array(block("text", 0, 0, 100, 100), block("text", 5, 5, 40, 40), block("figure", 50, 50, 80, 80)).alias("blocks"),
    )
    return declarations.numeric_candidates(declarations.layout_lines(results)).select("doc", "line", "raw", "amount", "quarantine")


@query("""
SELECT doc_id AS doc, category FROM documents, (VALUES ('fr', 'le la'), ('es', 'el la'), ('en', 'the and')) AS s(category, t) WHERE contains(strip_accents(lower(text)), split_part(t, ' ', 1)) AND contains(strip_accents(lower(text)), split_part(t, ' ', 2))""")
def economic_interests(spark, sf):
    specs = read(spark, sf, "region").limit(1).select(F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.array(*map(F.lit, t)).alias("tokens")) for c, t in (("fr", ("le", "LA")), ("es", ("él", "la")), ("en", ("the", "and")))))).alias("s")).select("s.*")
    return declarations.economic_interests(read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"), specs)


@query("""
SELECT o_orderkey AS doc, deputy_name, vote, section, footnote, page FROM (
  SELECT o_orderkey, 'García Ruiz, Ana' AS deputy_name, 'Sí' AS vote, 'floor' AS section, CAST(NULL AS VARCHAR) AS footnote, CAST(1 AS INT) AS page FROM orders
  UNION ALL SELECT o_orderkey, 'Vega Paz, Eva', 'Sí', 'floor', '2', CAST(1 AS INT) FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 'Sol Gil, Luis', 'No', 'government', NULL, CAST(2 AS INT) FROM orders UNION ALL SELECT o_orderkey, 'Mar Río, Noa', 'Abstención', 'telematic', NULL, CAST(2 AS INT) FROM orders)""")
def roll_calls(spark, sf):
    """Names under the headers of a roll call over two pages; a numbered line opens a note, which ends with its page."""
    return _roll_call(spark, sf).select("doc", "deputy_name", "vote", "section", "footnote", "page")


def _roll_call(spark, sf):
    first = F.concat_ws("\n", F.lit("Diario de Sesiones"), F.lit("Fuera, Antes"), F.lit("Comienza la votación por llamamiento"), F.lit("García Ruiz , Ana"), F.when(F.col("o_orderkey") % 2 == 0, "Vega Paz, Eva 2"), F.lit("2 Nota que sigue"), F.lit("Nota, Segunda"))
    second = F.concat_ws("\n", F.lit("Núm. 12 Pág. 3"), F.lit("Miembros del Gobierno que dijeron «no»:"), F.lit("Sol Gil, Luis"), F.lit("Señores diputados que se abstuvieron telemáticamente:"), F.lit("Mar Río, Noa"), F.lit("La señora PRESIDENTA: Resultado"), F.lit("Fuera, Después"))
    return votes_text.roll_call(read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.array(first, second).alias("pages")))


@query("""
SELECT o_orderkey AS doc, CAST(3 + (o_orderkey % 2 = 0)::INT AS BIGINT) AS n, o_orderkey % 2 = 0 AS reconciled, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'decisions_differ emitted_differ' END AS reasons, CAST(1 AS INT) AS page_start, CAST(2 AS INT) AS page_end FROM orders""")
def reconciled_roll_calls(spark, sf):
    expected = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(2).alias("yes"), F.lit(1).alias("no"), F.lit(1).alias("abstentions"), F.lit(4).alias("emitted"))
    return votes_text.reconciled_roll_call(_roll_call(spark, sf), expected).select("doc", "n", "reconciled", F.array_join("reasons", " ").alias("reasons"), "page_start", "page_end")


@query("""
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS ordinal, CASE role WHEN 'user' THEN 'RUIZ' ELSE 'VEGA' END AS speaker, md5(said) AS digest, CASE role WHEN 'user' THEN 'La señora RUIZ (Ana):' ELSE 'El señor VEGA (Luis):' END AS heading
FROM (SELECT *, 'turno ' || turn || ' con ' || length(text) || ' letras' AS said FROM conversations WHERE role IN ('user', 'assistant'))""")
def speech_turns(spark, sf):
    """Every turn of a transcript: number, heading, speaker and what was said."""
    c = read(spark, sf, "conversations").where("role in ('user', 'assistant')")
    said = F.concat(F.lit("turno "), F.col("turn").cast(S), F.lit(" con "), F.length("text").cast(S), F.lit(" letras"))
    line = F.concat(F.when(F.col("role") == "user", "La señora RUIZ (Ana): ").otherwise("El señor VEGA (Luis): "), said)
    docs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    blocks = speech.speech_blocks(docs, key="conv_id")
    return blocks.select("conv_id", F.regexp_extract("text", r"^turno (\d+)", 1).cast("int").alias("turn"), "ordinal", F.upper(F.when(F.col("speaker") == "Ana", "Ruiz").otherwise("Vega")).alias("speaker"), F.md5(F.col("text").cast("binary")).alias("digest"), F.col("speaker_heading").alias("heading"))


@query("""
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1 AS INT) AS ordinal, kind AS turn_kind, lower(speaker) AS speaker, text, page_start, embedded FROM (
  SELECT p_partkey, 0 AS k, 'formal_turn' AS kind, 'RUIZ GIL' AS speaker, 'Hablo de ' || p_name || '. (El señor VEGA: ¡No!). (Aplausos).' AS text, CAST(12 AS INT) AS page_start, false AS embedded FROM part
  UNION ALL SELECT p_partkey, 1, 'interruption', 'VEGA', '¡No!', 12, false FROM part
  UNION ALL SELECT p_partkey, 2, 'formal_turn', 'SOL PAZ', 'Sigo yo.', 12, false FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, 3, 'formal_turn', 'el REY', 'Señorías.', 12, false FROM part WHERE p_size % 3 = 0
  UNION ALL SELECT p_partkey, 4, 'formal_turn', 'MAR CID', 'Voto ' || p_brand || '.', 12, false FROM part WHERE p_size % 5 = 0
  UNION ALL SELECT p_partkey, 5, 'formal_turn', 'MAR PAZ', '¿Está de acuerdo, señor Vega? (Asentimiento).', 12, false FROM part WHERE p_size % 7 = 0
  UNION ALL SELECT p_partkey, 6, 'formal_turn', 'PRESIDENTA', 'Gracias.' || chr(10) || 'Hemos terminado.', 13, false FROM part)""")
def transcript_forms(spark, sf):
    """A page mark, an agenda title, an interruption in parentheses, headings that a scan ran together or misread, the Crown, a name alone on its line, and the chair."""
    n = F.col("p_size")
    text = F.concat_ws(
        "\n", F.lit("Página 12"), F.lit("PREGUNTAS ORALES"), F.concat(F.lit("La señora RUIZ GIL: Hablo de "), "p_name", F.lit(". (El señor VEGA: ¡No!). (Aplausos).")),
        F.when(n % 2 == 0, F.when(n % 4 == 0, "Elseñor SOL PAZ: Sigo yo.").otherwise("81 señorSOL PAZ: Sigo yo.")), F.when(n % 3 == 0, "Su Majestad el REY: Señorías."),
        F.when(n % 5 == 0, F.concat(F.lit("La señora MAR CID.\nVoto "), "p_brand", F.lit("."))), F.when(n % 7 == 0, "El señor MAR PAZ: ¿Está de acuerdo, señor Vega? (Asentimiento)."),
        F.lit("Página 13"), F.lit("La PRESIDENTA: Gracias."), F.lit("Hemos terminado."),
    )
    blocks = speech.speech_blocks(read(spark, sf, "part").select("p_partkey", text.alias("text")), key="p_partkey")
    return blocks.select("p_partkey", "ordinal", "turn_kind", F.col("normalized_speaker").alias("speaker"), "text", "page_start", speech.has_embedded_heading(F.col("text")).alias("embedded"))


@query("""
SELECT p_partkey AS doc, page, line_no, line, CAST(NULL AS VARCHAR) AS margin FROM (
  SELECT p_partkey, CAST(p AS INT) AS page, CAST(0 AS INT) AS line_no, 'Diario núm. ' || (p_size + p) AS line FROM part, (VALUES (1), (2), (3)) AS v(p))
UNION ALL SELECT p_partkey, 1, CAST(unnest([0, 1, 2]) AS INT), unnest(['Arriba', 'Abajo', 'Lado']), unnest(['header', 'footer', 'side']) FROM part""")
def page_margins(spark, sf):
    """What repeats at the pages' tops, and lines outside the text's frame."""
    part, n = read(spark, sf, "part"), F.col("p_size")
    page = lambda p: F.concat_ws("\n", F.concat(F.lit("Diario núm. "), (n + p).cast(S)), *(F.concat(F.lit(f"texto {'abc'[p - 1] * (k + 3)} "), F.lit("xyz"[p - 1] * 4)) for k in range(6)))
    often = speech.repeated_margins(part.select(F.col("p_partkey").alias("doc"), F.array(*(page(p) for p in (1, 2, 3))).alias("pages")))
    line = lambda t, *b: F.struct(F.lit(t).alias("text"), F.array(*(F.lit(float(x)) for x in b)).alias("bbox"))
    pages = part.select(F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), F.lit(100.0).alias("width"), F.lit(200.0).alias("height"), F.array(line("Arriba", 10, 5, 50, 20), line("Abajo", 10, 190, 50, 198), line("Lado", 95, 80, 99, 120), line("Dentro", 10, 80, 50, 90)).alias("lines"))
    placed = speech.geometric_margins(pages).select("doc", "page", "line_no", F.col("text").alias("line"), "margin")
    return often.select("doc", "page", "line_no", "line", F.lit(None).cast(S).alias("margin")).union(placed)


@query("""
SELECT conv_id, '{"chars":' || sum(length(text)) || ',"turns":' || count(*) || '}' AS diagnostic, CASE WHEN count(DISTINCT role) = 1 THEN min(role) END AS only_role FROM conversations WHERE turn < 2 GROUP BY conv_id""")
def page_diagnostics(spark, sf):
    c = read(spark, sf, "conversations").where("turn < 2")
    only = aggregates.unique_values(c, ["conv_id"], "role", "turn").select("conv_id", F.col("role").alias("only_role"))
    sums = c.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("t")).select("conv_id", speech.page_diagnostic(turns=F.col("t"), chars=F.col("n")).alias("diagnostic"))
    return sums.join(only, "conv_id", "left")


@query("""
SELECT 'VEGA Y RUIZ ' || c_custkey AS speaker, c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'speaker_not_found' ELSE 'document_unavailable' END AS text_status, CASE c_custkey % 3 WHEN 0 THEN 0.9 ELSE 0.0 END AS match_confidence, CASE c_custkey % 3 WHEN 0 THEN 'dijo ' || c_name END AS text FROM customer""")
def matched_interventions(spark, sf):
    """Interventions whose speaker has a turn in the document, has none, or whose document is not there."""
    c, k = read(spark, sf, "customer"), F.col("c_custkey")
    speaker = F.concat(F.lit("VEGA Y RUIZ "), k.cast(S))
    rows = c.select(k.alias("document_id"), speaker.alias("speaker"), F.lit("09:00").alias("starts_at"), F.lit("").alias("ends_at"), k.alias("c_custkey"))
    blocks = c.where("c_custkey % 3 <> 2").select(k.alias("document_id"), F.lit(0).alias("ordinal"), F.when(k % 3 == 0, "vega y ruiz").otherwise("sol paz").alias("normalized_speaker"), F.concat(F.lit("dijo "), "c_name").alias("text"))
    return speech.with_text(rows, blocks).select("speaker", "c_custkey", "text_status", "match_confidence", "text")


@query("""
WITH e AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
SELECT CAST(count(*) * 2 AS BIGINT) AS expected, CAST(count(*) * 2 AS BIGINT) AS actual, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS different, true AS passed, false AS broken, (SELECT count(*) FROM customer) AS records, CAST(1 AS BIGINT) AS datasets, true AS owned, false AS all_datasets, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0) AS anomalies,
  CAST(count(*) AS BIGINT) AS profiles_expected, CAST(0 AS BIGINT) AS shared_documents, true AS profiles_passed, CAST(0 AS BIGINT) AS foreign_dates, true AS discovered, true AS inventories, (SELECT count(*) FROM customer WHERE c_custkey % 9 = 0) AS bad_type, (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0) AS bad_request, (SELECT count(*) FROM customer WHERE c_custkey % 4 = 0) AS foreign_url, (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0) AS bad_hash,
  false AS one_manifest_each, (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey % 3 = 0) AS completed_without_votes, CAST(0 AS BIGINT) AS unplanned_resources FROM e""")
def source_audits(spark, sf):
    """The audits of acquired sources: organs in two formats that hold the same rows (and once with a row changed), initiative owners, profiles, vote discovery, inventories."""
    c = read(spark, sf, "customer").withColumn("slug", F.col("c_nationkey").cast(S))
    both = F.explode(F.array(F.lit("json"), F.lit("csv"))).alias("format")
    expected = c.select("slug").distinct().select("slug", both)
    manifests = expected.withColumns({"status_code": F.lit(200), "valid": F.lit(True)})
    rows = c.select("slug", "c_custkey", F.col("c_name").alias("row_text"), both)
    good = audits.organ_sources(expected, manifests, rows.drop("c_custkey"), formats=2)
    changed = rows.withColumn("row_text", F.when((F.col("c_custkey") == 3) & (F.col("format") == "csv"), "otro").otherwise(F.col("row_text")))
    bad = audits.organ_sources(expected, manifests, changed.drop("c_custkey"), formats=2).select(F.col("passed").alias("broken"))
    records = c.select(F.lit("ProyectosDeLey").alias("dataset"), F.lit("XV").alias("legislature"), F.concat(F.lit("121/"), F.lpad(F.col("c_custkey").cast(S), 6, "0"), F.lit("/0000")).alias("file_number"))
    owners = audits.initiative_owners(records, {"ProyectosDeLey": ("121",), "ProposicionesDeLey": ("122",)}, "XV").select("records", "datasets", "owned", "all_datasets")
    odd = audits.owner_anomalies(records.withColumn("legislature", F.when(F.col("file_number").rlike("0/0000$"), "XIV").otherwise("XV")), "XV", 1_000_000).agg(F.count("*").alias("anomalies"))
    index = c.select(F.col("slug").alias("code")).distinct()
    planned = index.select(F.concat(F.lit("https://x.es/"), "code").alias("url"), "code")
    people = audits.profile_sources(index, index.withColumn("links", F.array(F.lit("a"))), planned, planned).select("profiles_expected", "shared_documents", F.col("passed").alias("profiles_passed"))
    days = index.select(F.lit("XV").alias("legislature"), F.lpad((F.lit(20240100) + F.col("code").cast("int") + 1).cast(S), 8, "0").alias("day"))
    pages = days.select("day", F.concat(F.lit("https://x.es/"), "day").alias("url"))
    terms, variants = days.select("legislature").distinct(), pages.select("day", F.concat("url", F.lit("/v")).alias("url"), F.col("url").alias("page_url"))
    found = audits.discovery_state(terms, days, pages, variants, calendars=days).select("foreign_dates", F.col("passed").alias("discovered"))
    votes = days.withColumns({"url": F.concat(F.lit("https://x.es/v/"), "day"), "format": F.when(F.col("day").cast("int") % 100 % 3 != 1, "json").otherwise("pdf")})
    late = audits.discovery_state(terms, days, pages, variants, completed=days.select("day"), resources=votes).select("completed_without_votes", "unplanned_resources")
    k = F.col("c_custkey")
    kept = c.select(
        F.lit("ProyectosDeLey").alias("dataset"), F.lit(200).alias("status_code"), F.lit(True).alias("valid"), (k % 7 != 0).alias("hash_valid"), F.lit("json").alias("format"), F.when(k % 9 == 0, "text/html").otherwise("application/json").alias("content_type"),
        F.when(k % 2 == 0, "POST").otherwise("GET").alias("request_method"), F.when((k % 2 == 0) != (k % 5 == 0), "abc").alias("request_parameters_sha256"), F.when(k % 4 == 0, "https://x.es/a").otherwise("https://www.congreso.es/a").alias("source_url"),
    )
    states = audits.initiative_owners(records, {"ProyectosDeLey": ("121",)}, "XV", kept).select("bad_type", "bad_request", "foreign_url", "bad_hash", "one_manifest_each")
    stock = audits.required_inventories(manifests.select(F.col("format").alias("dataset")), ("json", "csv")).select(F.col("passed").alias("inventories"))
    out = good.select("expected", "actual", "missing", "different", "passed")
    for part in (bad, owners, odd, people, found, stock, late, states):
        out = out.crossJoin(part)  # one row each
    return out


@query("""
SELECT 'profiles' AS service, c_custkey AS id FROM customer WHERE c_custkey % 50 = 7 UNION ALL SELECT 'interests', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'financial_documents', c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'mach')
UNION ALL SELECT 'initiatives', o_orderkey FROM orders WHERE o_orderkey % 15 + 1 = 15 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-06-15' AND DATE '1996-12-15' UNION ALL SELECT 'organs', n_nationkey FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'salaries', s_suppkey FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'documents', p_partkey FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'interventions', o_orderkey FROM orders WHERE o_orderstatus = 'P'""")
def service_searches(spark, sf):
    """Each service with one of its own filters; initiatives also by legislature and by the last six months before a day."""
    c, o, n = read(spark, sf, "customer"), read(spark, sf, "orders"), lambda t: read(spark, sf, t)
    k = F.col("c_custkey")
    find = lambda d, service, wanted, **more: services.search(d, services.Query(filters=wanted, max_results=None, **more), identity="id", service=service).select(F.lit(service).alias("service"), "id")
    orders = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 15 + 1).cast(S).alias("legislature"), F.to_date("o_orderdate").alias("presented_at"), F.concat(F.lit("Asunto de ley "), F.col("o_orderkey").cast(S)).alias("subject"), F.col("o_orderstatus").alias("phase"))
    parts = [
        find(c.select(k.alias("id"), F.concat(F.lit("x"), (k % 50).cast(S), F.lit("x")).alias("parliamentary_code"), F.lit("z").alias("deputy_id")), "profiles", {"deputy_id": "X7x"}),
        find(c.select(k.alias("id"), F.concat(F.lit("Declaración "), "c_mktsegment").alias("declaration_kind")), "interests", {"declaration_kind": "declaracion building"}),
        find(c.select(k.alias("id"), F.col("c_mktsegment").alias("document_kind")), "financial_documents", {"document_kind": "mach"}),
        find(orders, "initiatives", {"title": "ASUNTO"}, legislatures=("15",), last_months=6, today=dt.date(1996, 12, 15)),
        find(n("nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, "Comisión de Hacienda").otherwise("Mesa").alias("name")), "organs", {"name": "hacienda comision"}),
        find(n("supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "Directores").otherwise("Otro").alias("role")), "salaries", {"role": "director"}),
        find(n("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "application/pdf").otherwise("video/mp4").alias("mime_type")), "documents", {"mime_type": "pdf"}),
        find(orders.drop("subject"), "interventions", {"phase": "p"}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""
SELECT 'nominal' AS what, l_orderkey AS vote_id, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_suppkey = 3 GROUP BY l_orderkey UNION ALL SELECT 'events', o_orderkey, 1 FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'items', l_orderkey, count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY l_orderkey UNION ALL SELECT 'person', 3, 1""")
def vote_searches(spark, sf):
    """Votes of a session with their items, one deputy's own rows, and the one person who answers to a name."""
    events = read(spark, sf, "orders").select(F.col("o_orderkey").alias("vote_id"), F.col("o_orderstatus").alias("session"))
    ballots = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("vote_id"), F.concat(F.lit("Vega, Deputy"), F.col("l_suppkey").cast(S)).alias("deputy_name"))
    rows = services.search_votes(events, ballots, ballots, services.Query(filters={"session": "F"}))
    mine = services.search_votes(events, ballots, ballots, services.Query(filters={"session": "F", "deputy": "deputy3 Vega"}))["nominal"]
    people = read(spark, sf, "customer").select(F.col("c_custkey").cast(S).alias("deputy_id"), F.concat(F.lit("Vega, Deputy"), F.col("c_custkey").cast(S)).alias("full_name"))
    who = services.resolve_person(people, name="DEPUTY3 de Vega")
    n = lambda d, what: d.groupBy(F.lit(what).alias("what"), "vote_id").agg(F.count("*").alias("n"))
    person = read(spark, sf, "region").limit(1).select(F.lit("person").alias("what"), F.lit(int(who)).cast("long").alias("vote_id"), F.lit(1).cast("long").alias("n"))
    return n(mine, "nominal").union(n(rows["events"], "events")).union(n(rows["items"], "items")).union(person)
