"""Declarations of assets and interests: page texts to lines, line rules to reviewable items, spatial layout of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.functions.ids import stable_id
from hemiciclo.functions.money import first_percentage, mixed_amount
from hemiciclo.functions.text import fold, page_quality, squeeze
from hemiciclo.operators import dedup, joins, windows

#: Fixed values: (family, category, words of which one must stand in the folded line), in order of precedence.
RULES = (
    ("liability", "loan", ("hipoteca", "prestamo", "credito", "deuda", "saldo pendiente")),
    ("real_estate", "property", ("vivienda", "piso", "finca", "garaje", "solar", "local comercial", "inmueble", "trastero")),
    ("vehicle", "vehicle", ("vehiculo", "automovil", "turismo", "motocicleta", "embarcacion", "matricula")),
    ("asset", "financial", ("cuenta corriente", "deposito", "acciones", "fondo de inversion", "plan de pensiones", "bonos", "saldo", "seguro de vida")),
    ("company_interest", "shareholding", ("participacion", "sociedad", "empresa", "consejo de administracion", "s.l.", "s.a.")),
    ("position", "office", ("cargo", "patron", "presidente de", "vocal", "concejal", "alcalde", "administrador")),
    ("income", "income", ("sueldo", "retribucion", "salario", "percepcion", "rendimiento", "intereses", "dividendo", "pension", "nomina", "dieta")),
)
BOILERPLATE = ("declaracion de bienes", "registro de intereses", "congreso de los diputados", "firma", "pagina", "nombre y apellidos", "legislatura", "instrucciones", "reglamento")
REVIEW_BELOW = 0.7


def pages(texts: DataFrame) -> DataFrame:
    """texts: doc, page_texts, methods, confidences: a row a page, with defaults for what is not given."""
    rows = texts.select("doc", F.posexplode("page_texts").alias("p", "text"), "methods", "confidences")
    return rows.select("doc", (F.col("p") + 1).alias("page"), "text", F.coalesce(F.get("methods", F.col("p")), F.lit("native")).alias("method"), F.coalesce(F.get("confidences", F.col("p")), F.when(F.trim(F.coalesce("text", F.lit(""))) != "", 0.92).otherwise(0.2)).alias("confidence"), page_quality(F.coalesce("text", F.lit(""))).alias("quality"))


def classify(line: Column) -> Column:
    """STRUCT<family, category> of the first rule with a word in the folded line; NULL for none."""
    out = F.lit(None).cast("struct<family: string, category: string>")
    for family, category, words in reversed(RULES):
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(line, w))
        out = F.when(hit, F.struct(F.lit(family).alias("family"), F.lit(category).alias("category"))).otherwise(out)
    return out


def is_boilerplate(line: Column) -> Column:
    return F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda w: F.contains(line, w)) & ~line.rlike(r"\d[\d.]*,\d{2}")


def line_confidence(line: Column, amount: Column, specific: Column) -> Column:
    """.62, .12 more with an amount, .12 more for a specific category, .08 less for a long line; between .35 and .9."""
    score = 0.62 + F.when(amount.isNotNull(), 0.12).otherwise(0.0) + F.when(specific, 0.12).otherwise(0.0) - F.when(F.length(line) > 180, 0.08).otherwise(0.0)
    return F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.35), score)), 6)


def logical_lines(page_rows: DataFrame) -> DataFrame:
    """doc, page, pos, line: a line joins the one before it while that ends without a stop and it begins in lower case."""
    lines = F.filter(F.transform(F.split("text", "\n"), squeeze), lambda x: x != "")
    grows = lambda grown, line: ~grown.rlike(r"[.!?;:)]$") & line.rlike(r"^\p{Ll}") & (F.length(grown) < 400)
    return page_rows.select("doc", "page", F.posexplode(windows.fold_lines(lines, grows)).alias("pos", "line"))


def items(page_rows: DataFrame) -> DataFrame:
    """Reviewable items of the pages' lines: family, category, amount, percentage, confidence, needs_review (below .7)."""
    rows = logical_lines(page_rows).withColumn("f", fold(F.col("line"))).where((F.length("line") >= 4) & ~is_boilerplate(F.col("f")))
    rows = rows.withColumn("c", classify(F.col("f"))).where("c is not null")
    amount = F.when(F.col("line").rlike(r"\d[\d.]*,\d{2}|\d+\s*(€|EUR|euros)"), mixed_amount(F.regexp_extract("line", r"(\d[\d.]*,\d{2}|\d[\d.]*(?=\s*(?:€|EUR|euros)))", 1)))
    rows = rows.withColumns({"amount": amount, "percentage": first_percentage(F.col("line"))})
    rows = rows.withColumn("confidence", line_confidence(F.col("line"), F.col("amount"), F.col("c.category") != F.col("c.family")))
    return rows.select(
        stable_id(F.col("doc").cast("string"), F.col("page").cast("string"), F.col("c.family"), F.col("line")).alias("item_id"), "doc", "page", "pos", "c.family", "c.category", F.col("line").alias("description"),
        "amount", "percentage", "confidence", (F.col("confidence") < REVIEW_BELOW).alias("needs_review"),
    )


def merged(structured: DataFrame, generic: DataFrame) -> DataFrame:
    """Structured items, and the generic ones that overlap none: same document, page and family, then amounts within a cent, else percentages, else one text within the other."""
    near = lambda c: (F.col(f"g.{c}") - F.col(f"s.{c}")).between(-0.01, 0.01)
    text = lambda a: F.regexp_replace(fold(F.col(f"{a}.description")), "[^a-z0-9]+", "")
    within = F.contains(text("g"), text("s")) | F.contains(text("s"), text("g"))
    both = lambda c: F.col(f"g.{c}").isNotNull() & F.col(f"s.{c}").isNotNull()
    overlap = F.when(both("amount"), near("amount")).when(both("percentage"), near("percentage")).otherwise(within)
    rest = joins.suppress_overlaps(generic, structured, ["doc", "page", "family"], overlap)
    return dedup.last_per_key(structured.unionByName(rest), ["item_id"], ["pos"])


def table_blocks(page_rows: DataFrame, least: int = 3) -> DataFrame:
    """doc, page, first and last line of runs of at least `least` lines that look like rows of a table."""
    from hemiciclo.operators.filters import looks_like_table_row

    lines = page_rows.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    runs = windows.islands(lines, ["doc", "page"], ["pos"], looks_like_table_row(F.col("line")), least)
    return runs.where("value").select("doc", "page", F.col("first").alias("first_line"), F.col("last").alias("last_line"), "n")


def layout_lines(results: DataFrame, *, tolerance: float = 2.0) -> DataFrame:
    """results: doc, page, width, height, texts, scores, boxes ([x0, y0, x1, y1]), blocks (ARRAY<STRUCT<label, bbox>>): a row a page.

    A row a line with the label of the smallest block that holds its centre and whether it may be read (it is in a
    block that is no figure or header). Arrays of different lengths and boxes outside the page are errors. A line meets
    the blocks of its own row, so whole pages pass through without a shuffle.
    """
    same = (F.size("texts") == F.size("scores")) & (F.size("texts") == F.size("boxes"))
    rows = results.withColumn("_z", F.when(same, F.arrays_zip("texts", "scores", "boxes")).otherwise(F.raise_error(F.lit("texts, scores and boxes differ in length")).cast("array<struct<texts: string, scores: double, boxes: array<double>>>")))
    lines = rows.select("doc", "page", "width", "height", "blocks", F.posexplode("_z").alias("line", "z")).select("doc", "page", "line", F.col("z.texts").alias("text"), F.col("z.scores").alias("score"), F.col("z.boxes").alias("box"), "width", "height", "blocks")
    b = F.col("box")
    inside = (b[0] >= -tolerance) & (b[1] >= -tolerance) & (b[2] <= F.col("width") + tolerance) & (b[3] <= F.col("height") + tolerance)
    lines = lines.withColumn("x", F.when(inside, (b[0] + b[2]) / 2).otherwise(F.raise_error(F.lit("a box lies outside its page")).cast("double"))).withColumn("y", (b[1] + b[3]) / 2)
    out = lines.withColumn("block", joins.smallest_box(F.col("blocks"), x=F.col("x"), y=F.col("y"), box="bbox"))
    k = F.get("blocks", F.col("block"))
    out = out.withColumns({"label": k["label"], "bbox": k["bbox"]}).drop("blocks")
    return out.withColumn("eligible", F.coalesce(~F.col("label").isin("figure", "image", "header", "footer", "seal"), F.lit(False)))


def numeric_candidates(lines: DataFrame, *, min_score: float = 0.85) -> DataFrame:
    """Numbers of eligible lines with the first reason for quarantine, if there is one."""
    found = lines.select("doc", "page", "line", "text", "score", "eligible", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\d[\d.,]*)"), F.lit(1))).alias("k", "raw"))
    reason = F.when(~F.col("eligible"), "outside_eligible_block").when(F.col("score") < min_score, "low_score").when(F.col("text").rlike(r"\d{1,2}/\d{1,2}/\d{2,4}"), "date").when(F.col("raw").rlike(r"^\d{1,2}$"), "bare_number")
    return found.withColumns({"amount": mixed_amount(F.col("raw")), "quarantine": reason})


#: What entities look like in a declaration.
ENTITY_PATTERNS = {
    "amount": r"\d{1,3}(?:\.\d{3})*,\d{2}\s*(?:€|EUR|euros)?",
    "date": r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    "percentage": r"\b\d{1,3}(?:[.,]\d+)?\s*%",
    "iban": r"\bES\d{2}[\s\d*Xx]{4,30}",
    "company": r"\b[A-ZÁÉÍÓÚÑ][\w&. ]{2,60}?,?\s+S\.?\s?[AL]\.?(?:U\.?)?(?=\W|$)",
    "registry": r"(?i)\b(?:finca|registro)\s+n(?:º|o|úm)\.?\s*\d+",
}
CITIES = ("Madrid", "Barcelona", "Valencia", "Sevilla", "Zaragoza", "Málaga", "Murcia", "Bilbao", "Alicante", "Córdoba", "Valladolid", "Vigo", "Gijón", "Granada", "Soria", "Cádiz", "Toledo", "Burgos", "Salamanca", "León")
#: Words of the parts of a structured form.
INCOME_WORDS = {"salary": ("sueldo", "salario", "retribucion", "nomina"), "pension": ("pension",), "allowance": ("dieta", "indemnizacion"), "interest": ("intereses", "rendimiento"), "dividend": ("dividendo",)}
ASSET_WORDS = {"account": ("cuenta", "deposito", "saldo"), "fund": ("fondo",), "shares": ("accion", "participacion"), "pension_plan": ("plan de pensiones",), "insurance": ("seguro",)}


def entities(page_rows: DataFrame) -> DataFrame:
    """Amounts, dates, percentages, account numbers, companies, registry numbers and places of page texts: spans and 80 characters around."""
    from hemiciclo.plans.extraction import Rule, regex_candidates

    rules = [Rule(k, p) for k, p in ENTITY_PATTERNS.items()] + [Rule("location", r"\b(?:" + "|".join(CITIES) + r")\b")]
    keyed = page_rows.select(F.concat_ws(":", F.col("doc").cast("string"), F.col("page").cast("string")).alias("page_key"), "text")
    found = regex_candidates(keyed, rules, key="page_key")
    part = F.split("page_key", ":")
    return found.select("candidate_id", part[0].alias("doc"), part[1].cast("int").alias("page"), F.col("rule").alias("entity_type"), F.trim("value").alias("value"), "start", "end", "evidence", F.when(F.col("rule") == "amount", mixed_amount(F.col("value"))).alias("amount"))


def _category(line: Column, words: dict) -> Column:
    out = F.lit(None).cast("string")
    for name, tokens in reversed(words.items()):
        out = F.when(F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(line, t)), F.lit(name)).otherwise(out)
    return out


def structured_amounts(lines: DataFrame, words: dict, family: str, *, confidence: float = 0.86, following_first: bool = False) -> DataFrame:
    """lines: doc, page, pos, line. Lines that are an amount, with the nearest line of words within three that says what it is."""
    amount = F.when(F.col("line").rlike(r"^\d{1,3}(\.\d{3})*,\d{2}\s*(€|EUR)?$"), mixed_amount(F.col("line")))
    rows = lines.withColumns({"amount": amount, "f": fold(F.col("line"))})
    said = F.when(F.col("amount").isNull() & _category(F.col("f"), words).isNotNull(), F.col("line"))
    rows = windows.nearest_neighbour(rows, ["doc", "page"], ["pos"], said, "description", following_first=following_first).where("amount is not null and description is not null")
    return rows.select("doc", "page", "pos", F.lit(family).alias("family"), _category(fold(F.col("description")), words).alias("category"), "description", "amount", F.lit(confidence).alias("confidence"), F.lit(confidence < REVIEW_BELOW).alias("needs_review"))


def structured_income(lines: DataFrame) -> DataFrame:
    return structured_amounts(lines, INCOME_WORDS, "income")


def structured_assets(lines: DataFrame) -> DataFrame:
    return structured_amounts(lines, ASSET_WORDS, "asset")


def structured_liabilities(lines: DataFrame) -> DataFrame:
    """A mortgage or loan line and the amounts of the four lines after it: the first was granted, the last is pending."""
    from pyspark.sql import Window as W

    amount = F.when(F.col("line").rlike(r"\d[\d.]*,\d{2}"), mixed_amount(F.regexp_extract("line", r"(\d[\d.]*,\d{2})", 1)))
    ahead = W.partitionBy("doc", "page").orderBy("pos").rowsBetween(0, 4)
    rows = lines.withColumn("amounts", F.collect_list(amount).over(ahead)).where(fold(F.col("line")).rlike("hipoteca|prestamo|credito"))
    rows = rows.where(F.size("amounts") > 0)
    return rows.select("doc", "page", "pos", F.lit("liability").alias("family"), F.col("line").alias("description"), F.col("amounts")[0].alias("granted"), F.when(F.size("amounts") > 1, F.element_at("amounts", -1)).alias("pending"))


def structured_real_estate(lines: DataFrame, reach: int = 7) -> DataFrame:
    """From a property marker to the purchase marker within `reach` lines: the lines between describe one property."""
    from pyspark.sql import Window as W

    f = fold(F.col("line"))
    opens = f.rlike(r"\b(vivienda|piso|finca|garaje|solar|local|trastero)\b")
    closes = f.rlike("compraventa|herencia|donacion|adquisicion")
    rows = windows.carry_forward(lines, ["doc", "page"], ["pos"], F.when(closes, F.lit(-1)).when(opens, F.col("pos")), "_last", strictly_before=True)
    by = W.partitionBy("doc", "page").orderBy("pos")
    ahead = F.min(F.when(closes, F.col("pos"))).over(by.rangeBetween(0, reach - 1))
    span = F.when(opens & (F.coalesce("_last", F.lit(-1)) < 0) & ahead.isNotNull(), F.struct(F.col("pos").alias("start"), ahead.alias("end")))
    rows = windows.carry_forward(rows, ["doc", "page"], ["pos"], span, "_span")
    inside = rows.where(F.col("pos") <= F.col("_span.end")).select("doc", "page", F.col("_span.start").alias("start"), "pos", "line")
    parts = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return inside.groupBy("doc", "page", "start").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "; ").alias("description")).withColumns({"family": F.lit("real_estate"), "confidence": F.lit(0.86)})


def economic_interests(texts: DataFrame, specs: DataFrame, *, most: int = 1_000) -> DataFrame:
    """texts: doc, text. specs: category, tokens (ARRAY<STRING>), a caller's table of at most `most` rows. Documents whose text has all tokens of a spec.

    The specs become part of the expression, so texts are read once and meet no join; more specs are an error.
    """
    from hemiciclo.operators.limits import collect_at_most

    wanted = [F.struct(F.lit(r["category"]).alias("category"), F.array(*(fold(F.lit(t)) for t in r["tokens"])).alias("tokens")) for r in collect_at_most(specs.select("category", "tokens"), most)]
    if not wanted:
        return texts.select("doc", F.lit(None).cast("string").alias("category")).limit(0)
    folded = texts.select("doc", fold(F.col("text")).alias("f"))
    hits = F.filter(F.array(*wanted), lambda s: F.forall(s["tokens"], lambda t: F.contains(F.col("f"), t)))
    return folded.select("doc", F.explode(F.transform(hits, lambda s: s["category"])).alias("category"))


def human_join(*parts: Column) -> Column:
    """The parts that are not empty, with commas."""
    return F.concat_ws(", ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def known_city(line: Column) -> Column:
    hits = F.filter(F.array(*map(F.lit, CITIES)), lambda c: F.contains(line, c))
    return F.get(hits, F.lit(0))
