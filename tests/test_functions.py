from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from hemiciclo.functions import dates, ids, money, references, text, urls

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(v):
    return F.lit(v).cast("string") if v is None else F.lit(v)


@pytest.mark.parametrize(("value", "expected"), [("27/07/77", D(1977, 7, 27)), ("1/2/05", D(2005, 2, 1)), ("30/1/2026", D(2026, 1, 30)), ("30/01/2026 09:15", D(2026, 1, 30)), ("31/02/2026", None), ("30/01/2026 99:00", None), ("", None), (None, None), ("2026-01-30", None)])
def test_spanish_date(spark, value, expected):
    assert one(spark, dates.spanish_date(lit(value))) == expected


@pytest.mark.parametrize(("value", "expected"), [("30 de enero de 2026", D(2026, 1, 30)), ("1 de Setiembre de 1999", D(1999, 9, 1)), ("31 de febrero de 2020", None), ("30 de foo de 2026", None)])
def test_long_date(spark, value, expected):
    assert one(spark, dates.long_spanish_date(lit(value))) == expected


def test_other_dates(spark):
    assert one(spark, dates.java_date(F.lit("Nacido el Tue Jan 30 00:00:00 CET 1962"))) == D(1962, 1, 30)
    assert one(spark, dates.law_date(F.lit("Ley 3/2020, de 29 de diciembre"), F.lit("2020"))) == D(2020, 12, 29)
    assert one(spark, dates.law_date(F.lit("Ley, de 2 mayo de 1999"))) == D(1999, 5, 2)
    assert one(spark, dates.law_date(F.lit("Ley de 2 mayo"))) is None
    assert one(spark, dates.age_at(F.lit(D(1990, 6, 16)), F.lit(D(2020, 6, 15)))) == 29
    assert one(spark, dates.legislature_on(F.lit(D(1976, 1, 1)))) is None
    assert one(spark, dates.legislature_on(F.lit(D(2023, 8, 17)))) == "XV"


@pytest.mark.parametrize(("value", "expected"), [("15", "XV"), ("Leg.15", "XV"), ("xv", "XV"), ("0", "0"), ("99", "XCIX"), ("100", None), ("IIII", None), ("foo", None), ("015", "XV")])
def test_roman(spark, value, expected):
    assert one(spark, dates.legislature_roman(lit(value))) == expected


@pytest.mark.parametrize(("value", "expected"), [("C", "Leg.0"), ("XIV", "Leg.14"), ("Legislatura 3", "Leg.3"), ("foo", "foo"), ("", None)])
def test_legislature_label(spark, value, expected):
    assert one(spark, dates.legislature_label(lit(value))) == expected


def test_text(spark):
    assert one(spark, text.squeeze(F.lit(" a  b\n c "))) == "a b c"
    assert one(spark, text.fold(F.lit("ÁÑandÜ"))) == "anandu"
    assert one(spark, text.norm_key(F.lit(" Fecha de Alta (G.P.) "))) == "fecha_de_alta_g_p"
    assert sorted(one(spark, text.key_aliases(F.lit("Fecha de Alta")))) == ["fecha_de_alta", "fechaalta", "fechadealta"]
    assert sorted(one(spark, text.identity_tokens(F.lit("De la Peña y García, Peña")))) == ["garcia", "pena"]
    assert one(spark, text.identity_tokens(F.lit(None).cast("string"))) == []
    assert one(spark, text.speaker_key(F.lit("GARCÍA-Page (don José)"))) == "garcia page"
    assert one(spark, text.same_identifier(F.lit("007"), F.lit("7")))
    assert not one(spark, text.same_identifier(F.lit("a7"), F.lit("7")))
    assert one(spark, text.evidence_window(F.lit("0123456789"), F.lit(4), F.lit(5), 2)) == "23456"
    assert one(spark, text.unwrap_csv_value(F.lit('a ""b"" c'))) == 'a "b" c'
    assert one(spark, text.repair_mojibake(F.lit("sesiÃ³n"))) == "sesión"
    assert one(spark, text.page_quality(F.lit(""))) == 0.0


def test_record_keys_first_writer_wins(spark):
    record = F.create_map(F.lit("Fecha de Alta"), F.lit(" 1 "), F.lit("FECHAALTA"), F.lit("2"))
    assert one(spark, text.normalized_record(record)) == {"fecha_de_alta": "1", "fechadealta": "1", "fechaalta": "1"}


def test_ids(spark):
    expected = hashlib.sha256(b"a b||0").hexdigest()
    assert one(spark, ids.stable_id(F.lit(" a  b"), F.lit(None).cast("string"), F.lit("0"))) == expected
    assert one(spark, ids.stable_id_of_values(F.lit(0), F.lit("x"))) == hashlib.sha256(b"|x").hexdigest()
    assert one(spark, ids.canonical_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == '{"a":"2","b":"1"}'


@pytest.mark.parametrize(("value", "expected"), [("total 1.234,56 €", 1234.56), ("12,00 â\x82¬", 12.0), ("1234", None)])
def test_euro(spark, value, expected):
    assert one(spark, money.euro_amount(lit(value))) == expected


@pytest.mark.parametrize(("value", "expected"), [("1.234,56", 1234.56), ("1,234.5", 1234.5), ("1.234", 1234.0), ("12,5 y 3", 12.5), ("no", None)])
def test_mixed_amount(spark, value, expected):
    assert one(spark, money.mixed_amount(lit(value))) == expected


def test_references_and_urls(spark):
    assert one(spark, references.file_number(F.lit("121/1"))) == "121/000001/0000"
    assert one(spark, references.file_number(F.lit(" Ley 3 "))) == "Ley 3"
    assert one(spark, references.file_numbers_in(F.lit("121/1, 122/2/3 y 121/000001/0000"))) == ["121/000001/0000", "122/000002/0003"]
    assert one(spark, urls.dataset_name(F.lit("https://x/a/Diputados__20260101000000.json?x=1"))) == "Diputados"
    assert one(spark, urls.snapshot_token(F.lit("https://x/a/D__20260101000000.json"))) == "20260101000000"
    assert one(spark, urls.document_id(F.lit("https://x/p?_intervenciones_id_texto=(CD1.CODI.)"), F.lit(None).cast("string"))) == "CD1.CODI."
    assert one(spark, urls.document_id(F.lit(None).cast("string"), F.lit("https://x/L3/CONG/DS/PL_12.PDF#page=2"))) == "L3-PL_12"
    assert one(spark, urls.document_id(F.lit(None).cast("string"), F.lit("https://x/L15/DSCD-15-PL-1.pdf"))) == "DSCD-15-PL-1"
    assert one(spark, urls.split_links(F.lit("https://a/b.pdf #page=2 x http://c"))) == ["https://a/b.pdf#page=2", "http://c"]
    assert one(spark, urls.canonical_url(F.lit("http://a.eshttps://b.es:443/c#d"), "https://b.es")) == "https://b.es/c"
    assert one(spark, urls.page_hint(F.lit("https://a/b.pdf#page=12"))) == 12
