from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hemiciclo.plans import declarations, domains, extraction, speech, votes_text
from hemiciclo.sources import bronze, catalog, html, records, sinks


def record(spark, *maps, **beside):
    rows = [(m, "sha", "2024-06-15") for m in maps]
    return spark.createDataFrame(rows, "record map<string, string>, source_sha256 string, snapshot_date string")


def test_deputies(spark):
    raw = record(spark, {"NOMBRE": "Ruiz Gil, Ana", "LEGISLATURA": "XV", "FECHAALTA": "17/08/2023", "SEXO": "Mujer", "FECHANACIMIENTO": "1/7/1980"}, {"APELLIDOS": "Sol", "NOMBRE": "Luis"})
    a, b = domains.deputies(raw).orderBy("full_name").collect()
    assert (a.full_name, a.first_name, a.last_names, a.age_at_snapshot, a.gender, a.term_start_date) == ("Ruiz Gil, Ana", "Ana", "Ruiz Gil", 43, "2", dt.date(2023, 8, 17))
    assert (b.full_name, b.first_name, b.last_names) == ("Sol, Luis", "Luis", "Sol")


def test_interest_identity_covers_recipient(spark):
    base = {"NOMBRE": "Sol, Luis", "DECLARACION": "x"}
    out = domains.interests(record(spark, base | {"DESTINATARIO": "a"}, base | {"DESTINATARIO": "b"})).select("interest_id").distinct()
    assert out.count() == 2


def test_initiative_identity_ignores_title(spark):
    out = domains.initiatives(record(spark, {"LEGISLATURA": "XV", "NUMEXPEDIENTE": "121/1", "OBJETO": "a", "INICIATIVASRELACIONADAS": "122/2"}, {"LEGISLATURA": "XV", "NUMEXPEDIENTE": "121/000001/0000", "OBJETO": "b"}), "ProyectosDeLey")
    assert out.select("initiative_id").distinct().count() == 1
    assert out.where("subject = 'a'").first().related_file_numbers == ["122/000002/0000"]


def votes(spark, *payloads):
    schema = "informacion struct<fecha string, sesion int, numeroVotacion int, titulo string, textoExpediente string, tituloSubGrupo string, votacionesConjuntas array<struct<textoExpediente string>>>, totales struct<presentes int, afavor int, enContra int, abstenciones int, noVotan int, asentimiento string>, votaciones array<struct<asiento string, diputado string, grupo string, voto string>>, legislature string, source_url string"
    return spark.createDataFrame(payloads, schema)


def test_votes_number_items_before_blanks_go(spark):
    v = votes(spark, (("1/2/2024", 5, 7, "t", " ", None, [("uno",), ("",), ("dos",)]), (3, 2, 1, 0, 0, "No"), [("1", "Ruiz, Ana", "G", "Sí"), ("", "Sol, Luis", "G", "No")], "XV", "u"))
    e = domains.vote_events(v).first()
    assert (e.source_mode, e.decision_method, e.nominal_group_data_available, e.nominal_seat_data_available, e.session) == ("official_json_nominal", "recorded_vote", True, False, "5")
    assert [(r.item_order, r.source_item_kind, r.item_text) for r in domains.vote_items(v).orderBy("item_order").collect()] == [(2, "joint", "uno"), (4, "joint", "dos")]
    assert domains.nominal_votes(v).select("nominal_vote_id").distinct().count() == 2


def test_votes_by_assent_and_totals_only(spark):
    info = ("1/2/2024", 5, 7, "t", "e", None, None)
    v = votes(spark, (info, (3, 3, 0, 0, 0, "Sí"), [], "XV", "u"), (info, (3, 3, 0, 0, 0, None), None, "XIV", "u"))
    assert sorted(r.source_mode for r in domains.vote_events(v).collect()) == ["official_json_assent", "official_json_totals_only"]


def test_salaries_carry_role_and_concept(spark):
    text = "Información actualizada el 3 de mayo de 2024\nDirectores\nSueldo:\n1.234,56 €\nsin concepto.\n2,00 €\nComplemento\n10,00 €"
    out = domains.salaries(spark.createDataFrame([("u", text)], "source_url string, text string")).orderBy("amount_eur").collect()
    assert [(r.role, r.concept, r.amount_eur, r.effective_date) for r in out] == [("Directores", "Complemento", 10.0, dt.date(2024, 5, 3)), ("Directores", "Sueldo", 1234.56, dt.date(2024, 5, 3))]


def test_profile(spark):
    text = "Diputados\nRuiz Gil, Ana\nDiputada por Soria\nG.P. Mixto\n(\nGMX\n)\nana@congreso.es\nPartido X\nNacida el Tue Jan 30 00:00:00 CET 1962\nen Soria\nXV Legislatura (2023)"
    p = domains.profile(spark.createDataFrame([(text, "https://x?codParlamentario=12&idLegislatura=XV")], "visible_text string, source_url string")).first()
    assert (p.full_name, p.parliamentary_code, p.constituency, p.parliamentary_group, p.parliamentary_group_code, p.electoral_party, p.birth_date, p.birth_place) == ("Ruiz Gil, Ana", "12", "Soria", "G.P. Mixto", "GMX", "Partido X", dt.date(1962, 1, 30), "Soria")


def test_organs_last_link_wins(spark):
    links = spark.createDataFrame([(0, "Comisión A", "u?_organos_codComision=3"), (1, "Comisión B", "u?_organos_codComision=3"), (2, "Otro", "v")], "pos int, text string, url string")
    assert [r.name for r in domains.organs_from_links(links).collect()] == ["Comisión B"]


def test_turns():
    text = "La señora PRESIDENTA: Abrimos.\nPágina 2\nEl señor RUIZ GIL (don Luis): Gracias. (El señor SOL: ¡No!)\nmás texto\nPREGUNTAS\nfinal"
    turns = speech.split_turns(text)
    assert [(t["turn_kind"], t["speaker"], t["text"]) for t in turns] == [("formal_turn", "PRESIDENTA", "Abrimos."), ("formal_turn", "don Luis", "Gracias. (El señor SOL: ¡No!)\nmás texto\nfinal"), ("interruption", "SOL", "¡No!")]
    assert turns[1]["page_start"] == 2 and text[turns[2]["source_start"] : turns[2]["source_end"]] == "(El señor SOL: ¡No!)"
    assert speech.split_turns(None) == [] == speech.split_turns("sin cabeceras")


def test_headings_inside_and_over_lines():
    text = "El señor RUIZ (don Luis): Acabo. La señora SOL: Empiezo (dijo alto. El señor VEGA: ¡Bien!) y sigo.\nEl señor SECRETARIO DE ESTADO\nDE COMERCIO (Gil Paz): Hola."
    turns = [t for t in speech.split_turns(text) if t["turn_kind"] == "formal_turn"]
    assert [(t["speaker"], t["text"]) for t in turns] == [("don Luis", "Acabo."), ("SOL", "Empiezo (dijo alto. El señor VEGA: ¡Bien!) y sigo."), ("Gil Paz", "Hola.")]
    assert text[turns[1]["source_start"] :].startswith("La señora SOL") and turns[2]["speaker_heading"].endswith("(Gil Paz):")


def test_collapsed_headings_and_geometry(spark):
    assert speech.repaired_heading("Elseñor RUIZ: Hola") == "El señor RUIZ: Hola" and speech.repaired_heading("E1senor RUIZ GIL: Hola") == "El señor RUIZ GIL: Hola"
    assert speech.repaired_heading("El SENADO dice: x") == "El SENADO dice: x" and speech.repaired_heading("Elseñor RUIZ") == "Elseñor RUIZ"
    assert [t["speaker"] for t in speech.split_turns("Laseñora SOL: Uno\nE1senor RUIZ: Dos")] == ["SOL", "RUIZ"]
    pages = spark.createDataFrame([(1, 1, 100.0, 200.0, [("h", [0.0, 5.0, 50.0, 20.0]), ("b", [0.0, 50.0, 50.0, 60.0]), ("f", [0.0, 190.0, 50.0, 199.0]), ("s", [95.0, 50.0, 99.0, 60.0])])], "doc int, page int, width double, height double, lines array<struct<text string, bbox array<double>>>")
    assert [(r.text, r.margin) for r in speech.geometric_margins(pages).orderBy("line_no").collect()] == [("h", "header"), ("f", "footer"), ("s", "side")]
    assert pages.select(speech.page_diagnostic(page=F.col("page"), issues=F.array())).first()[0] == '{"issues":[],"page":1}'


def test_speaker_matching():
    assert speech._names_match("ruiz gil", "luis ruiz gil") and speech._names_match("zapatero zapatero", "zapatero roldan")
    assert speech._names_match("echenike landiribar", "echenique landiribar") and not speech._names_match("ruiz gil", "sol paz") and not speech._names_match("", "sol")


def test_intervention_text_statuses(spark):
    blocks = spark.createDataFrame([("d", 0, "ruiz", "a"), ("d", 1, "ruiz", "b")], "document_id string, ordinal int, normalized_speaker string, text string")
    rows = spark.createDataFrame([("d", "RUIZ", "1", ""), ("d", "RUIZ", "2", ""), ("d", "RUIZ", "3", ""), ("d", "SOL", "1", ""), ("x", "RUIZ", "1", "")], "document_id string, speaker string, starts_at string, ends_at string")
    out = {(r.document_id, r.speaker, r.starts_at): (r.text, r.text_status) for r in speech.with_text(rows, blocks).collect()}
    assert out == {("d", "RUIZ", "1"): ("a", "matched"), ("d", "RUIZ", "2"): ("b", "matched"), ("d", "RUIZ", "3"): ("b", "matched"), ("d", "SOL", "1"): (None, "speaker_not_found"), ("x", "RUIZ", "1"): (None, "document_unavailable")}


def test_repeated_margins(spark):
    pages = [f"DIARIO NÚM. {i}\ntexto {c}\nmás {c}\nsigue {c}\nfin {c}\nPág. {i}" for i, c in enumerate("abcd")]
    out = speech.repeated_margins(spark.createDataFrame([(1, pages)], "doc int, pages array<string>"), edge=1)
    assert sorted((r.page, r.line_no) for r in out.collect()) == [(p, n) for p in range(1, 5) for n in (0, 5)]


ROLL = ["comienza\nComienza la votación\nRuiz Gil, Ana\nSol Paz, Luis1\n1 Rectifica.\n", "Diputados que dijeron «no»:\nVega, Eva\nDiputados que se abstuvieron:\nGil, Juan\nLa señora PRESIDENTA: Resultado"]


def test_roll_call_reconciles(spark):
    docs = spark.createDataFrame([(1, ROLL)], "doc int, pages array<string>")
    names = votes_text.roll_call(docs, start="^comienza la votacion$")
    assert [(r.deputy_name, r.vote, r.page, r.footnote) for r in names.orderBy("pos").collect()] == [("Ruiz Gil, Ana", "Sí", 1, None), ("Sol Paz, Luis", "Sí", 1, "1"), ("Vega, Eva", "No", 2, None), ("Gil, Juan", "Abstención", 2, None)]
    expected = spark.createDataFrame([(1, 2, 1, 1, 4)], "doc int, yes int, no int, abstentions int, emitted int")
    assert votes_text.reconciled_roll_call(names, expected).first().reconciled
    worse = votes_text.reconciled_roll_call(names, expected.withColumn("no", F.lit(2))).first()
    assert worse.reasons == ["decisions_differ"]


def test_regex_candidates(spark):
    df = spark.createDataFrame([(1, "ñ a1 b22"), (2, None)], "k int, text string")
    out = extraction.regex_candidates(df, [extraction.Rule("n", r"[a-z](\d+)", 0, 1)], key="k").orderBy("start").collect()
    assert [(r.value, r.start, r.end, r.status) for r in out] == [("1", 3, 4, "review_required"), ("22", 6, 8, "review_required")]


def test_models_fall_back_and_group(spark):
    def broken(task, text):
        raise RuntimeError("no")

    def answers(task, text):
        return {"candidates": [{"kind": "word", "value": "uno", "quote": "uno", "confidence": 0.5}, {"kind": "word", "value": "x", "quote": "absent"}]}

    df = spark.createDataFrame([(1, "uno dos uno")], "k int, text string")
    out = {r.value: r for r in extraction.model_candidates(df, extraction.Task("t"), [broken, answers], key="k").collect()}
    assert [(e.start, e.end, e.literal) for e in out["uno"].evidence] == [(0, 3, True), (8, 11, True)]
    assert [(e.start, e.literal) for e in out["x"].evidence] == [(None, False)]
    failed = extraction.model_candidates(df, extraction.Task("t"), [broken], key="k").first()
    assert failed.error == "RuntimeError: no"
    with pytest.raises(ValueError):
        extraction.parse_envelope('{"candidates": [{"kind": 1}]}')


def test_registry():
    r = extraction.Registry()
    r.register("a", len)
    assert r.get("a") is len
    for bad in ("a", "regex"):
        with pytest.raises(ValueError):
            r.register(bad, len)
    with pytest.raises(LookupError):
        r.get("b")


def test_declaration_items(spark):
    pages = spark.createDataFrame([(1, 1, "Hipoteca sobre vivienda con saldo\npendiente de 12.345,67 €\nRegistro de Intereses\nAutomóvil Seat\nnada")], "doc int, page int, text string")
    out = declarations.items(pages).orderBy("pos").collect()
    assert [(r.family, r.amount) for r in out] == [("liability", 12345.67), ("vehicle", None)]
    assert not out[0].needs_review


def test_layout(spark):
    results = spark.createDataFrame([(1, 1, 100, 100, ["a", "1.234,5", "z"], [0.9, 0.9, 0.9], [[1.0, 1.0, 5.0, 5.0], [12.0, 12.0, 14.0, 14.0], [90.0, 90.0, 95.0, 95.0]], [("text", [0.0, 0.0, 50.0, 50.0]), ("figure", [10.0, 10.0, 20.0, 20.0])])], "doc int, page int, width int, height int, texts array<string>, scores array<double>, boxes array<array<double>>, blocks array<struct<label string, bbox array<double>>>")
    lines = declarations.layout_lines(results)
    assert [(r.text, r.label, r.eligible) for r in lines.orderBy("line").collect()] == [("a", "text", True), ("1.234,5", "figure", False), ("z", None, False)]
    assert declarations.numeric_candidates(lines).first().quarantine == "outside_eligible_block"


def test_layout_meets_the_blocks_of_its_own_row(spark):
    kinds = "doc int, page int, width int, height int, texts array<string>, scores array<double>, boxes array<array<double>>, blocks array<struct<label: string, bbox: array<double>>>"
    one = lambda doc, *blocks: (doc, 1, 100, 100, ["12,50"], [0.9], [[1.0, 1.0, 5.0, 5.0]], list(blocks))
    whole = [0.0, 0.0, 50.0, 50.0]
    lines = declarations.layout_lines(spark.createDataFrame([one(1, ("text", whole), ("figure", whole)), one(2, ("seal", whole), ("text", [2.0, 2.0, 4.0, 4.0])), one(3), one(None, ("text", whole))], kinds))
    assert {(r.doc, r.block, r.label, r.eligible) for r in lines.collect()} == {(1, 0, "text", True), (2, 1, "text", True), (3, None, None, False), (None, 0, "text", True)}
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_visible_html():
    page = "<html><head><title>t</title><style>x</style></head><body><p>a <b>b</b></p><script>no</script><a href='/x'> l  i </a><div class='c textoIntegro'>El señor X: hola<br>más</div></body></html>"
    out = html.read_visible(page, base_url="https://h", container="textoIntegro")
    assert out["visible_text"] == "El señor X: hola\nmás" and out["links"] == [{"text": "l i", "url": "https://h/x"}] and out["content_selector"] == ".textoIntegro"
    assert html.read_visible(page.replace("</body>", "<p class=textoIntegro>z</p></body>"), base_url="", container="textoIntegro")["quality_issues"] == ["multiple_intervention_text_containers"]
    assert out["projection"] == [{"start": 0, "end": 16, "path": "/html[1]/body[1]/div[1]"}, {"start": 17, "end": 20, "path": "/html[1]/body[1]/div[1]"}]
    assert html.read_visible(None, base_url="", container="t")["visible_text"] == ""


@pytest.mark.parametrize(("data", "kind", "good"), [(b'{"a":1}', "json", True), (b"1", "json", False), (b"%PDF-1.7", "pdf", True), (b"<html><body>Error 404 page is not to be found here, sorry for that</body></html>", "html", False), (b"<html><body>" + b"word " * 20 + b"</body></html>", "html", True), (b"<a><b/></a>", "xml", True), (b"<error/>", "xml", False), (b"a;b\n1;2\n", "csv", True), (b"a;b\n1\n", "csv", False), (b"PK", "zip", False), (b"", "json", False), (None, "pdf", False)])
def test_format_contracts(data, kind, good):
    assert bronze.keeps_contract(data, kind) is good


def test_checked_objects(spark, tmp_path):
    import hashlib

    body = b'[{"a": 1}]'
    (tmp_path / "f" / "d" / "2024-01-01").mkdir(parents=True)
    (tmp_path / "f" / "d" / "2024-01-01" / "x.json").write_bytes(body)
    sha = hashlib.sha256(body).hexdigest()
    m = spark.createDataFrame([("f/d/2024-01-01/x.json", len(body), sha, "json"), ("f/d/2024-01-01/x.json", len(body), "0", "json"), ("f/d/2024-01-01/y.json", 1, sha, "json")], "bronze_path string, bytes long, sha256 string, format string")
    assert sorted(r.valid for r in bronze.checked(m, bronze.read_objects(spark, str(tmp_path))).collect()) == [False, False, True]


def test_formats_agree(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"A": "1", "B": "x"}]')
    (tmp_path / "a.csv").write_text("﻿A;B\n1;x\n")
    (tmp_path / "a.xml").write_text("<r><i><A>1</A><B>x</B></i></r>")
    c = lambda df: df.select(records.canonical_row(F.col("record"))).first()[0]
    assert c(records.read_json(spark, f"{tmp_path}/a.json")) == c(records.read_csv(spark, f"{tmp_path}/a.csv")) == c(records.read_xml(spark, f"{tmp_path}/a.xml", "i"))


def test_manifests_of_any_age(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"family": "f", "dataset": "d", "format": "json", "source_url": "u", "sha256": "s", "bytes": 3}')
    m = records.read_manifests(spark, str(tmp_path)).first()
    assert (m.request_method, m.requested_url, m.etag) == ("GET", "u", None)


def test_catalog(spark, tmp_path):
    links = spark.createDataFrame([("v", "a", "https://h/webpublica/opendata/votaciones/Leg15/Sesion9/20240201/Votacion003/VOT_20240201000000.json"), ("v", "b", "https://h/webpublica/opendata/votaciones/Leg15/Sesion9/20240201/VOT.zip"), ("d", "c", "https://h/other.json")], "family string, text string, url string")
    out = {r.dataset: r for r in catalog.resources_from_links(links).collect()}
    assert set(out) == {"Votacion", "SesionVotaciones"} and (out["Votacion"].session, out["Votacion"].vote_number) == ("9", "003")
    (tmp_path / "c.json").write_text('{"resources": [{"family": "f", "url": "u"}]}')
    assert catalog.read_catalog(spark, f"{tmp_path}/c.json").first().url == "u"
    with pytest.raises(Exception, match="above the cap"):
        catalog.export_pages(spark.createDataFrame([("XV", 500, {"a": "b"})], "legislature string, total long, filters map<string, string>"), most=100).count()


def test_injected_transport(spark):
    import json

    spark.dataSource.register(catalog.resource_source(lambda r: ("body of " + r["url"]).encode()))
    out = spark.read.format("hemiciclo_resources").option("resources", json.dumps([{"url": "a", "format": "json"}, {"url": "b"}])).load()
    assert sorted((r.url, bytes(r.content)) for r in out.collect()) == [("a", b"body of a"), ("b", b"body of b")]


def test_export_refuses(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x"])], "a int, b array<string>")
    sinks.export_records(df, f"{tmp_path}/o", format_name="CSV", batch_size=1)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.export_records(df, f"{tmp_path}/o", format_name="csv")
    for bad in ({"format_name": "xls"}, {"format_name": "csv", "batch_size": 0}):
        with pytest.raises(ValueError):
            sinks.export_records(df, f"{tmp_path}/p", **bad)
