"""Roll calls and vote sheets in page texts, read as ordered line tables.

Input: documents with `doc` and `pages` (ARRAY<STRING>). Lines are exploded in order, the current category, section
and group are carried forward, and counts are reconciled with the totals; nothing is filled in that the text lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.functions.text import fold, squeeze
from hemiciclo.operators import windows

#: The labels of the official texts.
CATEGORIES = {"si": "Sí", "no": "No", "abstencion": "Abstención", "abstenciones": "Abstención", "no votan": "No vota"}
START = r"^comienza la votacion|senores diputados que dijeron «si»:?$"
LABELS = ("Sí", "No", "Abstención", "Nulo", "No vota")
NAME = r"^\p{Lu}[\p{L} \-.'’]*, *\p{Lu}[\p{L} \-.'’]*$"
NOISE = r"^(cve:|diario de sesiones)|^congreso de los diputados$|^pleno y diputacion permanente$|^num\. \d+( (.+ )?pag\. \d+)?$|^pag\. \d+$|^\d{1,2} de \w+ de \d{4}$"


def page_lines(docs: DataFrame, pages: str = "pages", first_page: Column | None = None) -> DataFrame:
    """doc, page (from 1), pos (over the document), line: squeezed lines that are not blank."""
    rows = docs.select("doc", *([first_page.alias("_from")] if first_page is not None else []), F.posexplode(pages).alias("p", "text"))
    if first_page is not None:
        rows = rows.where("p + 1 >= _from").drop("_from")
    lines = rows.select("doc", (F.col("p") + 1).alias("page"), F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", squeeze(F.col("line"))).where("line != ''")
    return windows.renumber(lines, ["doc"], ["page", "i"], "pos").drop("i")


def header_vote(folded: Column) -> Column:
    """The category that a roll-call header begins."""
    has = lambda t: F.contains(folded, F.lit(t))
    found = F.when(has("votos nulos"), "Nulo").when(has("ausentes"), "No vota").when(has("abstuv"), "Abstención").when(has("«si»"), "Sí").when(has("«no»"), "No")
    return F.when(folded.endswith(":"), found)


def header_section(folded: Column) -> Column:
    has = lambda t: F.contains(folded, F.lit(t))
    return F.when(has("telematicamente"), "telematic").when(has("miembros del gobierno"), "government").when(has("miembros de la mesa"), "bureau").otherwise("floor")


def roll_call(docs: DataFrame, *, start: str = START, first_page: Column | None = None) -> DataFrame:
    """docs: doc, pages. A row a name: doc, pos, page, deputy_name, vote, section, footnote; from the start header to the result's speaker.

    A line that begins with a number opens a footnote, which lasts to the next header or page.
    """
    lines = page_lines(docs, first_page=first_page).withColumn("f", fold(F.col("line")))
    begins = F.col("f").rlike(start)
    ends = F.col("f").rlike("^(la senora presidenta:|el senor vicepresidente)")
    lines = lines.withColumn("_begin", F.when(begins, F.struct(F.lit("Sí").alias("v"), F.lit("floor").alias("s"))))
    body = windows.between_markers(lines, ["doc"], ["pos"], begins, ends)
    vote = header_vote(F.col("f"))
    body = body.withColumn("_head", F.when(vote.isNotNull(), F.struct(vote.alias("v"), header_section(F.col("f")).alias("s"))))
    note = F.when(F.col("_head").isNotNull(), F.lit("")).when(F.col("line").rlike(r"^\d+\s+") & ~F.col("line").rlike(NAME), F.regexp_extract("line", r"^(\d+)", 1))
    body = windows.carry_forward(body, ["doc"], ["pos"], F.col("_head"), "head")
    body = windows.carry_forward(body, ["doc", "page"], ["pos"], note, "_note")
    names = body.where((F.col("_head").isNull()) & (F.coalesce("_note", F.lit("")) == "") & ~F.col("f").rlike(NOISE))
    bare = F.trim(F.regexp_replace("line", r"(?<=\D)\d+$", ""))
    named = names.withColumns({"deputy_name": F.regexp_replace(bare, r"\s*,\s*", ", "), "footnote": F.nullif(F.regexp_extract("line", r"\D(\d+)$", 1), F.lit(""))})
    return named.select("doc", "pos", "page", "deputy_name", F.coalesce("head.v", F.lit("Sí")).alias("vote"), F.coalesce("head.s", F.lit("floor")).alias("section"), "footnote", bare.rlike(NAME).alias("valid_name"))


def reconciled_roll_call(names: DataFrame, expected: DataFrame, *, members: int | None = None) -> DataFrame:
    """expected: doc, yes, no, abstentions, emitted. A row a document: counts, first and last page, and the reasons that it does not reconcile."""
    n = {"yes": "Sí", "no": "No", "abstentions": "Abstención", "null": "Nulo", "absent": "No vota"}
    counts = names.groupBy("doc").agg(*(F.count_if(F.col("vote") == v).alias(f"n_{k}") for k, v in n.items()), F.count("*").alias("n"), F.count_distinct(fold(F.col("deputy_name"))).alias("d"), F.count_if(~F.col("valid_name")).alias("bad"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    both = expected.join(counts, "doc", "left")
    c = lambda k: F.coalesce(F.col(k), F.lit(0))
    reasons = [
        F.when(c("n") == 0, "no_roll_call"), F.when(c("bad") > 0, "unexpected_text"), F.when(c("n") != c("d"), "duplicate_names"),
        F.when((c("n_yes") != F.col("yes")) | (c("n_no") != F.col("no")) | (c("n_abstentions") != F.col("abstentions")), "decisions_differ"),
        F.when(c("n_yes") + c("n_no") + c("n_abstentions") + c("n_null") != F.col("emitted"), "emitted_differ"),
    ]
    if members is not None:
        reasons += [F.when(c("n_absent") != members - F.col("emitted"), "absences_differ"), F.when(c("n") != members, "coverage")]
    return both.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("reconciled", F.size("reasons") == 0)


def vote_sheets(docs: DataFrame) -> DataFrame:
    """Metadata of page 1 and totals of the first three pages: a row a document, `reconciled` if yes, no and abstentions make up those present."""
    folded = fold(F.array_join(F.slice("pages", 1, 3), "\n"))
    meta, total = r"(?m)^\s*(\d+)\s*votacion:\s*sesion:\s*(\d+)\s+fecha:\s*(\d{1,2})-(\d{1,2})-(\d{4})\s*$", r"presentes\s+si\s+no\s+abstenciones\s+no\s+votan\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)"
    m = lambda k: F.nullif(F.regexp_extract(fold(F.get("pages", F.lit(0))), meta, k), F.lit(""))
    t = lambda k: F.nullif(F.regexp_extract(folded, total, k), F.lit("")).cast("int")
    rows = docs.select("doc", m(1).cast("int").alias("vote_number"), m(2).cast("int").alias("session_number"), F.try_to_date(F.concat_ws("-", m(5), F.lpad(m(4), 2, "0"), F.lpad(m(3), 2, "0")), "yyyy-MM-dd").alias("vote_date"), t(1).alias("present"), t(2).alias("yes_votes"), t(3).alias("no_votes"), t(4).alias("abstentions"), t(5).alias("not_voting"), F.size("pages").alias("page_count"))
    return rows.withColumn("reconciled", F.coalesce(F.col("present") == F.col("yes_votes") + F.col("no_votes") + F.col("abstentions"), F.lit(False)))


def sheet_rows(docs: DataFrame) -> DataFrame:
    """Nominal lines from page 2 on: doc, pos, page, deputy_name, seat, vote, parliamentary_group, valid."""
    lines = page_lines(docs, first_page=F.lit(2)).withColumn("f", fold(F.col("line")))
    category = F.element_at(F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv)), F.col("f"))
    lines = windows.carry_forward(lines.withColumn("_c", category), ["doc"], ["pos"], F.col("_c"), "vote")
    plain = F.col("_c").isNull() & ~F.col("line").startswith("-") & ~F.col("f").rlike("^(pagina |total:)")
    group = F.when(F.col("_c").isNotNull(), F.lit("")).when(plain, F.col("line"))
    lines = windows.carry_forward(lines, ["doc"], ["pos"], group, "_g")
    text = F.trim(F.regexp_replace("line", "^-", ""))
    row = r"(?i)^(.+?)\s*(\d{1,4}|TELEM[AÁ]TICO)$"
    out = lines.where(F.col("line").startswith("-") & (F.col("line") != "-")).withColumns({"deputy_name": F.regexp_extract(text, row, 1), "seat": F.upper(F.regexp_extract(text, row, 2))})
    seat = F.when(F.col("seat").startswith("TELEM"), "TELEMÁTICO").otherwise(F.col("seat"))
    return out.select("doc", "pos", "page", "deputy_name", seat.alias("seat"), "vote", F.nullif("_g", F.lit("")).alias("parliamentary_group"), (F.col("vote").isNotNull() & (F.regexp_count("deputy_name", F.lit(",")) == 1)).alias("valid"))


def reconciled_sheets(docs: DataFrame) -> DataFrame:
    """vote_sheets with the counts of nominal rows, and whether they agree with the totals."""
    rows = sheet_rows(docs)
    n = {"yes_votes": "Sí", "no_votes": "No", "abstentions": "Abstención", "not_voting": "No vota"}
    counts = rows.groupBy("doc").agg(*(F.count_if(F.col("vote") == v).alias(f"n_{k}") for k, v in n.items()), F.count("*").alias("rows"), F.count_distinct(F.struct(fold(F.col("deputy_name")), "vote")).alias("d"), F.count_if(~F.col("valid")).alias("bad"))
    both = vote_sheets(docs).join(counts, "doc", "left")
    agree = F.col("rows").isNull() | ((F.col("rows") == F.col("d")) & (F.col("bad") == 0))
    for k in n:
        agree = agree & (F.col("rows").isNull() | (F.col(f"n_{k}") == F.col(k)))
    return both.withColumn("reconciled", F.col("reconciled") & F.coalesce(agree, F.lit(False))).drop("d", "bad")
