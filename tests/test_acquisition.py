from __future__ import annotations

import io

import pytest
from pyspark.sql import functions as F

from hemiciclo import cli
from hemiciclo.plans import audits, declarations
from hemiciclo.sources import discovery, transport


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(round(s, 3))
        self.now += s


def client(script, **kwargs):
    clock, calls = Clock(), []

    def open_(url):
        calls.append(url)
        status, body, headers = script.pop(0)
        if status == "error":
            raise OSError("down")
        return transport.Response(status, io.BytesIO(body).read, headers)

    return transport.Client(open_, pacer=transport.Pacer(0.2, clock, clock.sleep), **kwargs), clock, calls


def test_client_retries_paces_and_waits():
    c, clock, calls = client([(503, b"", {}), ("error", b"", {}), (200, b"ok", {})])
    assert c.get("u").content == b"ok" and len(calls) == 3 and clock.slept == [0.6, 1.2]
    c, clock, _ = client([(429, b"", {"Retry-After": "90"}), (200, b"", {})])
    c.get("u")
    assert clock.slept == [90.0]


def test_client_gives_up_and_falls_back():
    c, _, calls = client([(404, b"", {})])
    with pytest.raises(transport.Unavailable):
        c.get("u")
    assert len(calls) == 1
    c, _, calls = client([(404, b"", {}), (200, b"x", {})], fallback=lambda u: u + "/other")
    assert c.get("u").content == b"x" and calls == ["u", "u/other"]
    c, _, _ = client([(500, b"", {})] * 3)
    with pytest.raises(transport.Unavailable):
        c.get("u")
    c, _, _ = client([(200, b"x" * 11, {})])
    with pytest.raises(transport.TooLarge):
        c.get("u", most=10)


def test_retry_after():
    assert transport.retry_after("5") == 5.0 and transport.retry_after(None) == 0.0 == transport.retry_after("soon")
    assert transport.retry_after("Thu, 01 Jan 1970 00:01:00 GMT", now=30) == 30.0


def test_discovery(spark):
    i = spark.createDataFrame([("d", "", "p1.pdf", 0), ("d", "t#x", "p2.pdf", 1), ("e", None, "p3.pdf", 2), (None, "z", None, 3)], "document_id string, full_text_url string, pdf_url string, ordinal int")
    assert [tuple(r) for r in discovery.text_resources(i).collect()] == [("d", "t", "html"), ("e", "p3.pdf", "pdf")]
    page = spark.createDataFrame([("<select><option value=1>2023</option><option>2024</option><option>2023</option></select>",)], "p string")
    assert page.select(discovery.law_years(F.col("p"))).first()[0] == [2024, 2023] and page.select(discovery.law_years(F.col("p"), 2023)).first()[0] == [2023]
    with pytest.raises(Exception, match="no years"):
        page.select(discovery.law_years(F.substring("p", 1, 20))).collect()
    index = spark.createDataFrame([("1", 15, "A"), ("2", 15, "B")], "codParlamentario string, idLegislatura int, apellidosNombre string")
    assert discovery.profile_resources(index, 15, "https://h").count() == 2
    for bad, why in ((index.union(index), "twice"), (index.withColumn("idLegislatura", F.lit(14)), "another"), (index.withColumn("codParlamentario", F.lit("x")), "numeric")):
        with pytest.raises(Exception, match=why):
            discovery.profile_resources(bad, 15, "https://h").collect()


def test_vote_discovery(spark):
    base = "https://h/opendata/votaciones/Leg15/Sesion9/20240201"
    pages = spark.createDataFrame([("p", [("a", f"{base}/Votacion003/V.json"), ("b", f"{base}/Votacion003/V.json"), ("c", f"{base}/todo.zip"), ("d", f"{base.replace('Leg15', 'Leg14')}/Votacion1/V.json")])], "page_url string, links array<struct<text string, url string>>")
    out = discovery.vote_resources(pages, 15)
    assert [(r.dataset, r.vote_number) for r in out.collect()] == [("Votacion", "003"), ("SesionVotaciones", None)]
    text = spark.createDataFrame([("Sí: 10 No: 5 Abstenciones: 1 texto SI 3 NO 4 ABSTENCIONES 0",), ("nada",)], "t string")
    votes = discovery.summary_votes(F.col("t"))
    assert [[tuple(v) for v in r[0]] for r in text.select(votes).collect()] == [[(10, 5, 1), (3, 4, 0)], []]
    assert [r[0] for r in text.select(discovery.summary_valid(votes)).collect()] == [True, False]
    days = spark.createDataFrame([("20240201",), ("20240202",)], "day string")
    none = spark.createDataFrame([], "day string, valid boolean")
    assert [r.day for r in discovery.uncovered_dates(days, out, none).collect()] == ["20240202"]


def test_organs_and_owners(spark):
    d = discovery.organ_descriptors(spark.createDataFrame([("A", "1", "2"), ("B", "1", "2"), ("C", "1", "3")], "name string, sup string, sub string"))
    assert discovery.organ_resources(d, "https://h").count() == 8
    good = spark.createDataFrame([(n, "json", f"u{n}") for n in discovery.OWNERS] + [("ProyectosDeLey", "csv", "x")], "dataset string, format string, url string")
    assert [r.dataset for r in discovery.owner_resources(good).collect()] == list(discovery.OWNERS)
    with pytest.raises(Exception, match="exactly one"):
        discovery.owner_resources(good.union(good)).collect()


def test_organ_audit(spark):
    keys = [("a", f) for f in ("json", "csv", "xml")]
    expected = spark.createDataFrame(keys, "slug string, format string")
    manifests = spark.createDataFrame([(*k, 200, True) for k in keys], "slug string, format string, status_code int, valid boolean")
    rows = spark.createDataFrame([(*k, t) for k in keys for t in ("x", "y")], "slug string, format string, row_text string")
    assert audits.organ_sources(expected, manifests, rows).first().passed
    worse = audits.organ_sources(expected, manifests.where("format != 'csv'"), rows.withColumn("row_text", F.when(F.col("format") == "csv", F.lit("z")).otherwise(F.col("row_text")))).first()
    assert (worse.complete, worse.formats_agree, worse.passed) == (False, False, False)


def test_owner_profile_and_state_audits(spark):
    r = spark.createDataFrame([("P", "XV", "121/000001/0000"), ("Q", "XV", "122/000001/0000")], "dataset string, legislature string, file_number string")
    owned = {"P": ("121",), "Q": ("122",)}
    assert audits.initiative_owners(r, owned, "XV").first().passed
    bad = audits.initiative_owners(r.union(r).union(spark.createDataFrame([("P", None, "x")], r.schema)), owned, "XV").first()
    assert (bad.unique, bad.one_legislature, bad.well_formed, bad.passed) == (False, False, False, False)
    assert audits.owner_anomalies(r.withColumn("legislature", F.lit("XIV")), "XV", 1).count() == 1
    code = spark.createDataFrame([("1",)], "code string")
    profiles = spark.createDataFrame([("1", ["l"])], "code string, links array<string>")
    docs = spark.createDataFrame([("u", "1")], "url string, code string")
    assert audits.profile_sources(code, profiles, docs, docs).first().passed
    assert not audits.profile_sources(code, profiles, docs.union(spark.createDataFrame([("u", "2")], docs.schema)), docs).first().one_owner
    legs = spark.createDataFrame([(15,)], "legislature int")
    dates = spark.createDataFrame([(15, "20240201")], "legislature int, day string")
    pages = spark.createDataFrame([("20240201", "p")], "day string, url string")
    variants = spark.createDataFrame([("20240201", "v", "p")], "day string, url string, page_url string")
    assert audits.discovery_state(legs, dates, pages, variants).first().passed
    assert audits.discovery_state(legs, dates.union(dates), pages, variants.withColumn("page_url", F.lit("?"))).first().variants_without_page == 1


def test_structured_declarations(spark):
    text = ["Sueldo anual", "1.000,00 €", "Hipoteca casa", "100.000,00", "50.000,50 €", "Vivienda en Soria", "50%", "Compraventa", "Cuenta corriente", "20,00"]
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(text)], "doc int, page int, pos int, line string")
    assert [(r.category, r.amount) for r in declarations.structured_income(lines).orderBy("pos").collect()][0] == ("salary", 1000.0)
    assert [(r.granted, r.pending) for r in declarations.structured_liabilities(lines).collect()] == [(100000.0, 50000.5)]
    assert [r.description for r in declarations.structured_real_estate(lines).collect()] == ["Vivienda en Soria; 50%; Compraventa"]
    assert ("account", 20.0) in [(r.category, r.amount) for r in declarations.structured_assets(lines).collect()]
    found = declarations.entities(spark.createDataFrame([(1, 1, "Piso en Soria, 1.000,00 € el 1/2/2024 al 5 %, Acme Iberia S.A.")], "doc int, page int, text string"))
    assert {r.entity_type for r in found.collect()} == {"location", "amount", "date", "percentage", "company"}
    specs = spark.createDataFrame([("union", ["cuota", "sindicato"])], "category string, tokens array<string>")
    assert declarations.economic_interests(spark.createDataFrame([(1, "Cuota de SINDICATO"), (2, "cuota")], "doc int, text string"), specs).collect() == [(1, "union")]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d.json").write_text('[{"NOMBRE": "Ruiz, Ana", "LEGISLATURA": "XV"}, {"NOMBRE": "Sol, Luis", "LEGISLATURA": "XIV"}]')
    assert cli.main(["search", "deputies", f"{tmp_path}/d.json", "--filter", "name=ana", "--legislature", "15"]) == 0
    assert '"full_name":"Ruiz, Ana"' in capsys.readouterr().out
    assert cli.main(["export", "deputies", f"{tmp_path}/d.json", f"{tmp_path}/out", "--format", "jsonl"]) == 0
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_state_files(tmp_path):
    import json

    from hemiciclo.sources import state

    path = tmp_path / "a" / "s.json"
    c = state.Checkpoint(path, {"legislature": 15})
    assert c.pending(["x", "y", "x"]) == ["x", "y"]
    c.done("x", {"sha": "1"})
    c.failed("y", ValueError("no"))
    assert c.finish() == "failed" and json.loads(path.read_text())["failures"]["y"] == {"type": "ValueError", "message": "no"}
    again = state.Checkpoint(path, {"legislature": 15})
    assert again.pending(["x", "y"]) == ["y"]
    again.done("y", 1)
    assert again.finish() == "completed"
    with pytest.raises(state.StateMismatch):
        state.Checkpoint(path, {"legislature": 14})
    state.append_event(tmp_path / "e.jsonl", {"b": 1})
    state.append_event(tmp_path / "e.jsonl", {"a": "ñ"})
    assert (tmp_path / "e.jsonl").read_text().splitlines() == ['{"b": 1}', '{"a": "ñ"}']
    with pytest.raises(TypeError):
        state.write_json(path, {1: 2, "a": 1})
    assert json.loads(path.read_text())["status"] == "completed" and not list(path.parent.glob(".*"))


def test_contracts(tmp_path):
    from hemiciclo.sources import state

    (tmp_path / "c.toml").write_text("[votes]\nreview_threshold = 0.8\n")
    assert state.load_contracts(tmp_path / "c.toml")["votes"] == state.CONTRACT | {"review_threshold": 0.8}
    for bad in ("[votes]\nnope = 1\n", "[votes]\nreview_threshold = 2\n"):
        (tmp_path / "c.toml").write_text(bad)
        with pytest.raises(ValueError):
            state.load_contracts(tmp_path / "c.toml")


def test_persist_is_idempotent(spark, tmp_path):
    from hemiciclo.sources import bronze

    df = spark.createDataFrame([("f", "d", "2024-01-01", "u", "json", "s1", b"{}"), ("f", "d", "2024-01-01", "u", "json", "s1", b"{}"), ("f", "e", "2024-01-01", "v", "json", "s2", b"[]")], "family string, dataset string, run_date string, source_url string, format string, sha256 string, content binary")
    for _ in range(2):
        out = bronze.persist(df, f"{tmp_path}/b")
        assert sorted((r.source_url, r.bytes) for r in out.collect()) == [("u", 2), ("v", 2)]
    assert spark.read.parquet(f"{tmp_path}/b").count() == 2
