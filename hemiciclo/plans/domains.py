"""Raw records to typed rows. Input: `record` (MAP<STRING, STRING>) with `source_sha256` and `snapshot_date` beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.functions import dates, money, references, urls
from hemiciclo.functions.ids import stable_id
from hemiciclo.functions.text import fold, normalized_record, squeeze
from hemiciclo.operators import windows

#: What the export calls things.
ORGAN_NAMES = {"1": "Mesa", "300": "Junta de Portavoces", "401": "Diputación Permanente - titulares", "402": "Diputación Permanente - suplentes"}
GOVERNING = ("1", "300")
PERMANENT = ("401", "402", "403", "404", "405", "406", "407")
SALARY_ROLES = ("Secretario General", "Secretarios Generales Adjuntos", "Directores")
INITIATIVE_GROUPS = {"ProyectosDeLey": "Proyectos de ley", "ProposicionesDeLey": "Proposiciones de ley", "PropuestasDeReforma": "Propuestas de reforma de Estatutos de Autonomia"}
INITIATIVE_TYPES = {"ProyectosDeLey": "Proyecto de ley", "ProposicionesDeLey": "Proposicion de ley", "PropuestasDeReforma": "Propuesta de reforma de Estatuto de Autonomia"}
LAW_GROUPS = {"L": "Ley", "LO": "Ley Organica", "RD": "Real Decreto-ley", "RDL": "Real Decreto Legislativo"}


def _case(c: Column, table: dict[str, str], default: Column) -> Column:
    out = default
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def _records(df: DataFrame) -> DataFrame:
    return df.withColumn("_r", normalized_record(F.col("record")))


def _f(name: str) -> Column:
    return F.element_at(F.col("_r"), name)


def gender(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("1", "h", "hombre", "varon", "varón", "masculino", "v"), "1").when(t.isin("2", "f", "mujer", "femenino"), "2")


def deputies(raw: DataFrame, default_legislature: str | None = None) -> DataFrame:
    """A deputy's term: names composed or split at the comma, dates, age at the snapshot, identities."""
    whole = F.coalesce(dates.first_present(F.col("_r"), "apellidosnombre", "nombrecompleto", "nombre"), F.lit(""))
    both = F.coalesce(_f("apellidos"), F.lit("")) != ""
    first = F.when(both & (F.coalesce(_f("nombre"), F.lit("")) != ""), _f("nombre")).when(F.contains(whole, F.lit(",")) & ~both, F.nullif(F.trim(F.regexp_extract(whole, ",(.*)$", 1)), F.lit("")))
    last = F.when(both, _f("apellidos")).when(F.contains(whole, F.lit(",")), F.nullif(F.trim(F.regexp_extract(whole, "^([^,]*),", 1)), F.lit("")))
    full = F.when(both & (F.coalesce(_f("nombre"), F.lit("")) != ""), F.concat_ws(", ", _f("apellidos"), _f("nombre"))).otherwise(whole)
    legislature = F.coalesce(F.nullif(_f("legislatura"), F.lit("")), F.lit(default_legislature).cast("string"))
    birth = dates.first_date(F.col("_r"), "fechanacimiento", "fecha_nacimiento", "nacimiento")
    rows = _records(raw).withColumns({"_full": full, "_leg": legislature, "_birth": birth})
    return rows.select(
        stable_id(F.col("_full"), F.col("_leg"), _f("fechalta"), _f("circunscripcion"), _f("grupoparlamentario"), _f("fechaaltaengrupoparlamentario"), _f("fechabajaengrupoparlamentario")).alias("deputy_term_id"),
        stable_id(F.col("_full")).alias("deputy_id"), F.col("_full").alias("full_name"), first.alias("first_name"), last.alias("last_names"),
        F.col("_birth").alias("birth_date"), gender(dates.first_present(F.col("_r"), "genero", "sexo", "gender")).alias("gender"),
        dates.age_at(F.col("_birth"), F.to_date("snapshot_date")).alias("age_at_snapshot"), F.col("_leg").alias("legislature"),
        _f("circunscripcion").alias("constituency"), _f("formacionelectoral").alias("electoral_party"), _f("grupoparlamentario").alias("parliamentary_group"),
        dates.spanish_date(_f("fechaalta")).alias("term_start_date"), dates.spanish_date(_f("fechabaja")).alias("term_end_date"),
        dates.spanish_date(_f("fechaaltaengrupoparlamentario")).alias("group_start_date"), dates.spanish_date(_f("fechabajaengrupoparlamentario")).alias("group_end_date"),
        _f("biografia").alias("biography"), dates.first_present(F.col("_r"), "urlficha", "urlfichadiputado", "ficha").alias("profile_url"),
        F.col("source_sha256").alias("source_file_sha256"), "snapshot_date",
    )


def interests(raw: DataFrame) -> DataFrame:
    """Interest declarations; the identity covers all eleven fields."""
    names = ("nombre", "fecharegistro", "declaracion", "tipo", "periodo", "empleador", "sector", "destinatario", "benefactor", "descripcion", "observaciones")
    return _records(raw).select(
        stable_id(*map(_f, names)).alias("interest_id"), stable_id(_f("nombre")).alias("deputy_id"), _f("nombre").alias("full_name"),
        dates.spanish_date(_f("fecharegistro")).alias("registered_at"), _f("declaracion").alias("declaration_kind"), _f("tipo").alias("item_type"),
        _f("periodo").alias("period"), _f("empleador").alias("employer"), _f("sector").alias("sector"), _f("destinatario").alias("recipient"),
        _f("benefactor").alias("benefactor"), _f("descripcion").alias("description"), _f("observaciones").alias("observations"),
        F.col("source_sha256").alias("source_file_sha256"), "snapshot_date",
    )


def initiatives(raw: DataFrame, dataset: str) -> DataFrame:
    """Initiatives and approved laws. A file number with a slash identifies one within its legislature; laws need seven fields."""
    number = references.file_number(dates.first_present(F.col("_r"), "numexpediente", "numero_ley"))
    subject = dates.first_present(F.col("_r"), "objeto", "titulo_ley")
    law = dates.spanish_date(_f("fecha_ley"))
    rows = _records(raw).withColumns({"_no": number, "_subject": subject, "_law": law})
    rows = rows.withColumn("_leg", F.coalesce(F.nullif(_f("legislatura"), F.lit("")), dates.legislature_on(F.col("_law")) if dataset == "ApprovedLaws" else F.lit(None).cast("string")))
    identity = F.when(F.contains(F.coalesce("_no", F.lit("")), F.lit("/")), stable_id("congreso", "initiative", F.col("_leg"), F.col("_no"))).otherwise(
        stable_id(dataset, F.col("_leg"), F.col("_no"), F.col("_subject"), _f("fecha_ley"), _f("numero_boletin"), _f("pdf"))
    )
    plain = {
        "super_type": "supertipo", "grouping": "agrupacion", "type": "tipo", "law_number": "numero_ley", "gazette_number": "numero_boletin", "author": "autor",
        "procedure_type": "tipotramitacion", "current_status": "situacionactual", "processing_result": "resultadotramitacion",
        "competent_committee": "comisioncompetente", "deadlines": "plazos", "rapporteurs": "ponentes", "processing_history": "tramitacionseguida",
    }
    days = {"gazette_date": "fecha_boletin", "presented_at": "fechapresentacion", "qualified_at": "fechacalificacion"}
    return rows.select(
        identity.alias("initiative_id"), F.lit(dataset).alias("source_dataset"), F.col("_leg").alias("legislature"), F.col("_subject").alias("subject"), F.col("_no").alias("file_number"), F.col("_law").alias("law_date"),
        *(_f(v).alias(k) for k, v in plain.items()), *(dates.spanish_date(_f(v)).alias(k) for k, v in days.items()),
        references.file_numbers_in(_f("iniciativasdeorigen")).alias("origin_file_numbers"), references.file_numbers_in(_f("iniciativasrelacionadas")).alias("related_file_numbers"),
        urls.split_links(dates.first_present(F.col("_r"), "enlacesbocg", "pdf")).alias("bocg_links"), urls.split_links(_f("enlacesds")).alias("ds_links"), urls.split_links(_f("pdf")).alias("pdf_links"),
        F.col("source_sha256").alias("source_file_sha256"), "snapshot_date",
    )


def historical_initiatives(payloads: DataFrame, dataset: str, owned_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """payloads: lista (MAP or ARRAY of structs as MAP<STRING, STRING>). Rows shaped like the export; the general list leaves out prefixes that detailed datasets own."""
    item = F.col("item")
    get = lambda k: F.element_at(item, k)
    rows = payloads.select(F.explode("items").alias("item"), "source_sha256", "snapshot_date").withColumn("_no", references.file_number(get("id_iniciativa")))
    general = dataset == "GeneralInitiatives"
    if general and owned_prefixes:
        rows = rows.where(~F.coalesce(references.file_prefix(F.col("_no")).isin(*owned_prefixes), F.lit(False)))
    names = {
        "LEGISLATURA": dates.legislature_label(get("legislatura")),
        "SUPERTIPO": F.lit("Iniciativas" if general else "Iniciativas legislativas"),
        "AGRUPACION": F.coalesce(get("atis"), get("tipo")) if general else F.lit(INITIATIVE_GROUPS.get(dataset, dataset)),
        "TIPO": F.coalesce(get("tipo"), get("atis")) if general else F.lit(INITIATIVE_TYPES.get(dataset, dataset)),
        "OBJETO": get("titulo"), "NUMEXPEDIENTE": F.col("_no"), "FECHAPRESENTACION": get("fecha_presentado"), "FECHACALIFICACION": get("fecha_calificado"),
        "AUTOR": get("autores"), "SITUACIONACTUAL": get("resultado_tram"), "RESULTADOTRAMITACION": get("resultado_tram"),
    }
    return rows.select(F.create_map(*(x for k, v in names.items() for x in (F.lit(k), v))).alias("record"), "source_sha256", "snapshot_date")


def approved_laws(payloads: DataFrame, *, default_year: str | None = None, base: str = "https://www.congreso.es") -> DataFrame:
    """payloads: data (MAP<STRING, ARRAY<STRUCT<numLey, pdf, titulo, ...>>>): a row a law, its date from its title, its legislature from the date."""
    rows = payloads.select(F.explode("data").alias("code", "laws"), "source_sha256", "snapshot_date").select("code", F.explode("laws").alias("law"), "source_sha256", "snapshot_date")
    day = dates.law_date(F.col("law.titulo"), F.lit(default_year).cast("string"))
    return rows.withColumn("_day", day).select(
        F.col("law.numLey").alias("law_number"), F.col("law.titulo").alias("title"), _case(F.col("code"), LAW_GROUPS, F.col("code")).alias("type"), F.col("_day").alias("law_date"),
        dates.legislature_on(F.col("_day")).alias("legislature"),
        F.when(F.col("law.pdf") != "", F.concat(F.lit(f"{base}/constitucion/ficheros/leyes_espa/"), F.trim("law.pdf"))).alias("pdf_url"), "source_sha256", "snapshot_date",
    )


def interventions(raw: DataFrame) -> DataFrame:
    """Interventions of both export layouts; the document id from the text's address or the PDF's."""
    number = references.file_reference(_f("numeroexpediente"))
    full, pdf = dates.first_present(F.col("_r"), "enlacetextointegro", "enlace_texto_integro"), dates.first_present(F.col("_r"), "enlacepdf", "enlace_pdf")
    rows = _records(raw).withColumns({"_ref": F.coalesce(number, number), "_text": full, "_pdf": pdf})
    parts = ("legislatura", "fecha", "nombresesion", "objetoiniciativa", "orador", "horainicio", "horafin", "fase", "tipo", "numeroexpediente")
    return rows.select(
        stable_id(*map(_f, parts), F.col("_text"), F.col("_pdf")).alias("intervention_id"),
        dates.legislature_label(_f("legislatura")).alias("legislature"), dates.spanish_date(_f("fecha")).alias("session_date"), _f("nombresesion").alias("session_name"),
        _f("objetoiniciativa").alias("title"), _f("orador").alias("speaker"), _f("horainicio").alias("starts_at"), _f("horafin").alias("ends_at"), _f("fase").alias("phase"),
        _f("tipo").alias("initiative_type"), F.col("_ref.file_number").alias("file_number"), F.col("_ref.qualifier").alias("file_qualifier"), F.col("_text").alias("full_text_url"), F.col("_pdf").alias("pdf_url"),
        urls.document_id(F.col("_text"), F.col("_pdf")).alias("document_id"), F.col("source_sha256").alias("source_file_sha256"), "snapshot_date",
    )


def occurrences(rows: DataFrame, records: str = "records") -> DataFrame:
    """A row for each element of a file's record array, with its 0-based ordinal and an identity of file and ordinal."""
    exploded = rows.select("source_sha256", F.posexplode(records).alias("ordinal", "record"))
    return exploded.withColumn("occurrence_id", stable_id(F.col("source_sha256"), F.col("ordinal").cast("string")))


def _vote_base(votes: DataFrame) -> DataFrame:
    day = dates.spanish_date(F.col("informacion.fecha"))
    session, number = F.col("informacion.sesion").cast("string"), F.col("informacion.numeroVotacion").cast("string")
    event = stable_id("Congreso", "vote_event", F.col("legislature"), session, number, F.coalesce(day.cast("string"), F.col("informacion.fecha")))
    return votes.withColumns({"_day": day, "vote_id": event, "_session": session, "_number": number})


def vote_events(votes: DataFrame) -> DataFrame:
    """votes: informacion, totales, votaciones (arrays of structs), legislature, source_url: a row a vote."""
    nominal = F.coalesce(F.size("votaciones"), F.lit(-1)) > 0
    assent = F.coalesce(fold(F.trim("totales.asentimiento")) == "si", F.lit(False))
    filled = lambda field: F.forall("votaciones", lambda x: F.coalesce(F.trim(x[field]), F.lit("")) != "")
    return _vote_base(votes).select(
        "vote_id", "legislature", F.col("_session").alias("session"), F.col("_number").alias("vote_number"), F.col("_day").alias("vote_date"),
        F.col("informacion.titulo").alias("title"), F.col("informacion.textoExpediente").alias("file_text"), F.col("informacion.tituloSubGrupo").alias("subgroup_title"),
        F.col("totales.presentes").alias("present"), F.col("totales.afavor").alias("yes_votes"), F.col("totales.enContra").alias("no_votes"),
        F.col("totales.abstenciones").alias("abstentions"), F.lit(0).alias("null_votes"), F.col("totales.noVotan").alias("not_voting"),
        F.when(nominal, "official_json_nominal").when(assent, "official_json_assent").otherwise("official_json_totals_only").alias("source_mode"),
        F.when(assent, "assent").otherwise("recorded_vote").alias("decision_method"), nominal.alias("nominal_data_available"),
        (nominal & filled("grupo")).alias("nominal_group_data_available"), (nominal & filled("asiento")).alias("nominal_seat_data_available"), "source_url",
    )


def nominal_votes(votes: DataFrame) -> DataFrame:
    rows = _vote_base(votes).select("vote_id", "legislature", "_day", "source_url", F.explode("votaciones").alias("v"))
    return rows.select(
        stable_id("Congreso", "nominal_vote", F.col("vote_id"), F.col("v.diputado")).alias("nominal_vote_id"), "vote_id", "legislature", F.col("_day").alias("vote_date"),
        F.col("v.asiento").cast("string").alias("seat"), F.col("v.diputado").alias("deputy_name"), F.col("v.grupo").alias("parliamentary_group_code"), F.col("v.voto").alias("vote"), "source_url",
    )


def vote_items(votes: DataFrame) -> DataFrame:
    """The primary text, then the joint ones: numbered from 1, and only then without the blank ones."""
    joint = F.coalesce(F.transform("informacion.votacionesConjuntas", lambda x: F.struct(F.lit("joint").alias("kind"), x["textoExpediente"].alias("text"))), F.array().cast("array<struct<kind: string, text: string>>"))
    items = F.concat(F.array(F.struct(F.lit("primary").alias("kind"), F.col("informacion.textoExpediente").alias("text"))), joint)
    rows = _vote_base(votes).select("vote_id", "legislature", "_day", "source_url", F.posexplode(items).alias("pos", "i")).where(F.trim("i.text") != "")
    order = (F.col("pos") + 1).cast("string")
    return rows.select(
        stable_id("Congreso", "vote_item", F.col("vote_id"), order, F.col("i.kind")).alias("vote_item_id"), "vote_id", "legislature", F.col("_day").alias("vote_date"),
        (F.col("pos") + 1).alias("item_order"), F.col("i.kind").alias("source_item_kind"), F.trim("i.text").alias("item_text"), "source_url",
    )


def organ_name(code: Column) -> Column:
    return _case(code, ORGAN_NAMES, F.lit(None).cast("string"))


def organ_type(code: Column) -> Column:
    return F.when(code.isin(*GOVERNING), "governing_body").when(code.isin(*PERMANENT), "permanent_deputation").when(code.rlike(r"^\d+$"), "commission")


def organ_memberships(payloads: DataFrame) -> DataFrame:
    """payloads: data (ARRAY<STRUCT<apellidosNombre, descCargo, siglas, fechaAltaFormat, fechaBajaFormat>>), source_url."""
    rows = payloads.select("source_url", F.explode("data").alias("m")).withColumns({"organ_code": urls.query_param(F.col("source_url"), "_organos_selectedSuborgano"), "legislature": urls.query_param(F.col("source_url"), "_organos_selectedLegislatura")})
    rows = rows.withColumn("organ_id", stable_id(F.col("organ_code")))
    return rows.select(
        stable_id(F.col("legislature"), F.col("organ_id"), F.col("m.apellidosNombre"), F.col("m.descCargo"), F.col("m.fechaAltaFormat"), F.col("m.fechaBajaFormat")).alias("membership_id"),
        "organ_id", "organ_code", organ_name(F.col("organ_code")).alias("organ_name"), organ_type(F.col("organ_code")).alias("organ_type"), "legislature",
        stable_id(F.col("m.apellidosNombre")).alias("deputy_id"), F.col("m.apellidosNombre").alias("full_name"), F.col("m.descCargo").alias("role"), F.col("m.siglas").alias("parliamentary_group"),
        dates.spanish_date(F.col("m.fechaAltaFormat")).alias("started_at"), dates.spanish_date(F.col("m.fechaBajaFormat")).alias("ended_at"), "source_url",
    )


def organs_from_links(links: DataFrame) -> DataFrame:
    """links: pos, text, url. The last link of each organ counts."""
    both = F.lower(F.concat_ws(" ", "text", "url"))
    begins = F.lower("text").rlike("^(comisión|subcomisión|ponencia)")
    kind = F.when(F.contains(both, F.lit("codcomision")) | begins, "commission").when(F.col("text").isin("Mesa", "Junta de Portavoces", "Diputación Permanente"), "governing_body").when(F.contains(both, F.lit("secretaría general")), "administration")
    rows = links.withColumn("organ_type", kind).where("organ_type is not null").withColumn("organ_id", stable_id(F.coalesce(urls.query_param(F.col("url"), "_organos_codComision"), F.col("url"))))
    return rows.groupBy("organ_id").agg(F.max_by(F.struct(F.col("text").alias("name"), "organ_type", "url"), "pos").alias("o")).select("organ_id", "o.*")


def financial_kind(text: Column, url: Column) -> Column:
    both = F.lower(F.concat_ws(" ", text, url))
    has = lambda *words: F.contains(both, F.lit(words[0])) | F.contains(both, F.lit(words[1]))
    return F.when(has("declaración de actividades", "registro_intereses"), "activities").when(has("bienes y rentas", "/docbienes/"), "assets_income").when(has("intereses económicos", "/docacteco/"), "economic_interests")


def financial_documents(profiles: DataFrame) -> DataFrame:
    """profiles: deputy_id, full_name, legislature, links (ARRAY<STRUCT<text, url>>): a row for each link to a declaration."""
    rows = profiles.select("deputy_id", "full_name", "legislature", F.explode("links").alias("l")).withColumn("document_kind", financial_kind(F.col("l.text"), F.col("l.url"))).where("document_kind is not null")
    return rows.select(
        stable_id(F.col("deputy_id"), F.col("legislature"), F.col("document_kind"), F.col("l.url")).alias("document_id"), "deputy_id", "full_name", "legislature", "document_kind",
        dates.java_date(F.regexp_extract("l.text", r"\(([^)]+)\)", 1)).alias("registered_at"), F.trim(F.regexp_replace("l.text", r"\s*\(.+\)\s*$", "")).alias("declaration_kind"),
        F.col("l.url").alias("source_url"), F.lit("linked").alias("extraction_status"),
    )


def document_assets(raw: DataFrame, family: str, dataset: str) -> DataFrame:
    """A row for each address in the link fields of each record; the last of one identity counts."""
    entity = dates.first_present(F.col("_r"), "numexpediente", "numeroexpediente", "nombre", "objetoiniciativa")
    title = F.coalesce(dates.first_present(F.col("_r"), "objeto", "titulo_ley"), entity)
    rows = _records(raw).withColumns({"_e": entity, "_t": title}).select("_e", "_t", "snapshot_date", F.explode(F.map_entries("_r")).alias("f"))
    rows = rows.where(F.contains("f.key", F.lit("enlace")) | (F.col("f.key") == "pdf")).select("_e", "_t", "snapshot_date", "f.key", F.explode(urls.split_links(F.col("f.value"))).alias("url"))
    rows = rows.withColumn("document_id", stable_id(family, dataset, F.col("_e"), F.col("url")))
    made = F.struct(F.lit(family).alias("family"), F.lit(dataset).alias("dataset"), F.col("_e").alias("entity_id"), F.regexp_replace("key", "[^a-z0-9]+", "").alias("document_kind"), F.col("_t").alias("title"), "url", urls.mime_type(F.col("url")).alias("mime_type"), urls.page_hint(F.col("url")).alias("page_hint"), "snapshot_date")
    return rows.groupBy("document_id").agg(F.max_by(made, "key").alias("d")).select("document_id", "d.*")


def profile(pages: DataFrame) -> DataFrame:
    """pages: visible_text, source_url. The profile's fields by line rules."""
    lines = F.filter(F.transform(F.split("visible_text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.withColumn("_l", lines)
    line, none = F.col("_l"), F.lit(None).cast("string")
    first = lambda keep: F.get(F.filter(line, keep), F.lit(0))
    after = lambda at: F.when(at > 0, F.get(line, at))  # noqa: E731  the line that follows the 1-based place `at`
    name = "^[^,]{1,80}, [^,]{1,80}$"
    marker = F.array_position(line, "Diputados").cast("int")
    near = F.get(F.filter(F.slice(line, marker + 1, F.lit(11)), lambda x: x.rlike(name)), F.lit(0))
    full = F.coalesce(F.when(marker > 0, near), first(lambda x: x.rlike(name)), F.split(F.get(line, F.lit(0)), " - ")[0], F.lit(""))
    born = first(lambda x: x.rlike("^Nacid[oa] el "))
    place = after(F.array_position(line, F.coalesce(born, F.lit(" "))).cast("int"))
    mail = first(lambda x: F.contains(x, F.lit("@congreso.es")))
    party = after(F.array_position(line, F.coalesce(mail, F.lit(" "))).cast("int"))
    code = "[A-Z][A-Z0-9-]{1,8}"
    alone = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(line) - 1, F.lit(1))), lambda i: F.when((F.get(line, i - 1) == "(") & F.get(line, i).rlike(f"^{code}$"), F.get(line, i))), lambda x: x.isNotNull()), F.lit(0))
    inline = F.regexp_extract(first(lambda x: x.rlike(rf"\({code}\)")), rf"\(({code})\)", 1)
    rows = rows.withColumns({"full_name": full, "parliamentary_code": urls.query_param(F.col("source_url"), "codParlamentario"), "legislature": urls.query_param(F.col("source_url"), "idLegislatura")})
    return rows.select(
        stable_id(F.col("full_name"), F.col("legislature"), F.col("parliamentary_code")).alias("profile_id"), stable_id(F.col("full_name")).alias("deputy_id"), "full_name", "parliamentary_code", "legislature",
        dates.java_date(born).alias("birth_date"), F.when(place.startswith("en "), F.substring(place, 4, 1000)).otherwise(none).alias("birth_place"),
        F.nullif(F.regexp_extract(first(lambda x: x.rlike("^Diputad[ao] por .+$")), "^Diputad[ao] por (.+)$", 1), F.lit("")).alias("constituency"),
        first(lambda x: x.rlike(r"^G\.P\.")).alias("parliamentary_group"), F.coalesce(alone, F.nullif(inline, F.lit(""))).alias("parliamentary_group_code"),
        F.when(party != "Ficha personal", party).alias("electoral_party"), mail.alias("email"),
        dates.java_date(first(lambda x: fold(x).startswith("condicion plena:"))).alias("full_condition_date"),
        first(lambda x: F.contains(x, F.lit("Legislatura")) & F.contains(x, F.lit("(")) & F.contains(x, F.lit(")"))).alias("legislature_history"), "source_url",
    )


def salaries(pages: DataFrame) -> DataFrame:
    """pages: source_url, text. Role and concept are carried forward over the lines to the amount that follows them."""
    lines = pages.select("source_url", F.nullif(F.regexp_extract("text", "(?i)Información actualizada el (\\d{1,2} de [a-záéíóú]+ de \\d{4})", 1), F.lit("")).alias("_upd"), F.posexplode(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "line"))
    lines = lines.withColumns({"_amount": money.euro_amount(F.col("line")), "_role": F.when(F.col("line").isin(*SALARY_ROLES), F.col("line"))})
    keys, order = ["source_url"], ["pos"]
    lines = windows.carry_forward(lines, keys, order, F.col("_role"), "role")
    named = F.col("role").isNotNull() & F.col("_role").isNull() & F.col("_amount").isNull() & ~F.col("line").endswith(".") & dates.spanish_date(F.col("line")).isNull()
    reset = F.col("_role").isNotNull() | F.col("_amount").isNotNull()
    mark = F.when(reset, F.struct(F.lit(None).cast("string").alias("c"))).when(named, F.struct(F.col("line").alias("c")))
    lines = windows.carry_forward(lines, keys, order, mark, "_concept", strictly_before=True)
    day = dates.long_spanish_date(F.col("_upd"))
    return lines.where("_amount is not null and role is not null and _concept.c is not null").select(
        stable_id(F.col("role"), F.col("_concept.c"), F.col("_amount").cast("string"), day.cast("string")).alias("entitlement_id"), "role", F.lit("Administración parlamentaria").alias("body"),
        F.regexp_replace("_concept.c", ":+$", "").alias("concept"), F.col("_amount").alias("amount_eur"), F.lit("monthly_gross").alias("periodicity"), day.alias("effective_date"), "source_url",
    )


def document_texts(pages: DataFrame) -> DataFrame:
    """pages: source_sha256, page, text, method, confidence: a row a document, its pages joined in order, the mean confidence."""
    parts = F.sort_array(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("source_sha256").agg(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n").alias("text"), F.count("*").alias("page_count"), F.avg("confidence").alias("confidence"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("pages_with_text"))


def squeezed(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: squeeze(F.col(n)) for n in names})
