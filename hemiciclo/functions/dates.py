"""Spanish dates, ages and legislatures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemiciclo.functions.text import fold

#: Month names, English abbreviations, and the first day of each legislature.
MONTHS = {"enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12}
ENGLISH_MONTHS = {"Jan": 1, "Feb": 2, "Mar": 3, "Apr": 4, "May": 5, "Jun": 6, "Jul": 7, "Aug": 8, "Sep": 9, "Oct": 10, "Nov": 11, "Dec": 12}
LEGISLATURE_STARTS = (
    ("1977-07-13", "0"), ("1979-03-23", "I"), ("1982-11-18", "II"), ("1986-07-15", "III"), ("1989-11-21", "IV"), ("1993-04-13", "V"),
    ("1996-03-27", "VI"), ("2000-04-05", "VII"), ("2004-04-02", "VIII"), ("2008-04-01", "IX"), ("2011-12-13", "X"), ("2016-01-13", "XI"),
    ("2016-07-19", "XII"), ("2019-05-21", "XIII"), ("2019-12-03", "XIV"), ("2023-08-17", "XV"),
)


def _roman(n: int) -> str:
    tens, ones = divmod(n, 10)
    digits = ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")
    return ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")[tens] + digits[ones]


ROMAN = {str(n): _roman(n) for n in range(1, 100)} | {"0": "0"}


def _lookup(table: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def spanish_date(c: Column) -> Column:
    """d/M/yyyy, d/M/yy (69-99 are in the 1900s) and d/M/yyyy H:m, else NULL."""
    t = F.trim(c)
    part = lambda k: F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?:\s+(\d{1,2}):(\d{1,2}))?$", k)
    year = part(3)
    full = F.when(F.length(year) == 2, F.when(year >= "69", F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))).otherwise(year)
    time_ok = (part(4) == "") | ((F.length(year) == 4) & (F.lpad(part(4), 2, "0") <= "23") & (F.lpad(part(5), 2, "0") <= "59"))
    return F.when(time_ok & (year != ""), _day(full, F.nullif(part(2), F.lit("")), part(1)))


def long_spanish_date(c: Column) -> Column:
    """'30 de enero de 2026'."""
    pattern = r"^(\d{1,2}) de ([a-záéíóú]+) de (\d{4})$"
    t = F.lower(c)
    return _day(F.nullif(F.regexp_extract(t, pattern, 3), F.lit("")), F.element_at(_lookup(MONTHS), F.regexp_extract(t, pattern, 2)), F.regexp_extract(t, pattern, 1))


def java_date(c: Column) -> Column:
    """'Tue Jan 30 00:00:00 CET 2026' anywhere in the text, else spanish_date."""
    pattern = r"\b[A-Z][a-z]{2}\s+([A-Z][a-z]{2})\s+(\d{1,2}).*(\d{4})\b"
    found = _day(F.nullif(F.regexp_extract(c, pattern, 3), F.lit("")), F.element_at(_lookup(ENGLISH_MONTHS), F.regexp_extract(c, pattern, 1)), F.regexp_extract(c, pattern, 2))
    return F.when(c.rlike(pattern), found).otherwise(spanish_date(c))


def law_date(title: Column, default_year: Column | None = None) -> Column:
    """The first 'de D [de] month [de YYYY]' of a title whose month is known; the default year where none is given."""
    pattern = r"\bde\s+(\d{1,2})\s+(?:de\s+)?([a-z]+)(?:\s+de\s+(\d{4}))?"
    t, months = fold(title), _lookup(MONTHS)
    hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    parts = F.transform(hits, lambda h: F.struct(F.regexp_extract(h, pattern, 1).alias("d"), F.element_at(months, F.regexp_extract(h, pattern, 2)).alias("m"), F.coalesce(F.nullif(F.regexp_extract(h, pattern, 3), F.lit("")), F.lit(None).cast("string") if default_year is None else default_year).alias("y")))
    first = F.get(F.filter(parts, lambda p: p["m"].isNotNull() & p["y"].isNotNull()), F.lit(0))
    return _day(first["y"], first["m"], first["d"])


def date_text(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def age_at(birth: Column, snapshot: Column) -> Column:
    """Completed years."""
    early = F.date_format(snapshot, "MMdd") < F.date_format(birth, "MMdd")
    return F.year(snapshot) - F.year(birth) - early.cast("int")


def first_date(record: Column, *keys: str) -> Column:
    """Of the first field that is there and not empty."""
    value = first_present(record, *keys)
    return F.coalesce(spanish_date(value), long_spanish_date(value))


def first_present(record: Column, *keys: str) -> Column:
    return F.coalesce(*(F.nullif(F.element_at(record, k), F.lit("")) for k in keys))


def legislature_number(c: Column) -> Column:
    """15 of '15', 'XV', 'Leg.15'; 0 of 'C'; NULL for other text."""
    t = F.trim(F.regexp_replace(F.upper(F.trim(c)), r"LEG\.|LEGISLATURA", ""))
    t = F.regexp_replace(t, r"^LEG(?=\d+$)", "")
    known = {"C": 0} | {_roman(n): n for n in range(1, 16)}
    return F.when(t.rlike(r"^\d+$"), t.try_cast("int")).otherwise(F.element_at(_lookup(known), t))


def legislature_label(c: Column) -> Column:
    """'Leg.15'; text that names no legislature stays, '' is NULL."""
    n = legislature_number(c)
    return F.when(n.isNotNull(), F.concat(F.lit("Leg."), n.cast("string"))).otherwise(F.nullif(c, F.lit("")))


def legislature_roman(c: Column) -> Column:
    """'XV' of '15', 'XV', 'Leg.15'; '0' stays; NULL for anything else, numbers above 99 and Roman ones that are not canonical too."""
    raw = F.regexp_replace(F.upper(F.trim(c)), r"^LEG[.\s_-]*", "")
    digits = F.regexp_replace(raw, "^0+(?=.)", "")
    return F.when(raw.rlike(r"^\d+$"), F.element_at(_lookup(ROMAN), digits)).when(raw.isin(*ROMAN.values()), raw)


def legislature_on(day: Column) -> Column:
    """The legislature that a day falls into."""
    out = F.lit(None).cast("string")
    for start, name in LEGISLATURE_STARTS:
        out = F.when(day >= F.lit(start).cast("date"), F.lit(name)).otherwise(out)
    return out


def months_before(day: Column, months: int) -> Column:
    return F.add_months(day, -months)
