"""Amounts and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euro_amount(c: Column) -> Column:
    """'1.234,56 €' (the sign possibly damaged) anywhere in the text."""
    raw = F.nullif(F.regexp_extract(c, "(\\d{1,3}(?:\\.\\d{3})*,\\d{2})\\s*(?:€|â.{0,3}¬)", 1), F.lit(""))
    return F.translate(raw, ",.", ".").try_cast("double")


def mixed_amount(c: Column) -> Column:
    """The first number with any separators: the last one is a decimal point if one or two digits follow it."""

    def value(raw: Column) -> Column:
        last = F.length(F.substring_index(F.translate(raw, ",", "."), ".", -1))
        places = F.when(raw.rlike("[.,]") & last.between(1, 2), last).otherwise(0)
        return F.translate(raw, ".,", "").try_cast("double") / F.pow(F.lit(10.0), places)

    raw = F.rtrim(F.nullif(F.regexp_extract(c, r"(\d[\d.,]*)", 1), F.lit("")), F.lit(".,"))
    return F.transform(F.array(raw), value)[0]  # the pattern is searched once


def format_eur(c: Column) -> Column:
    return F.concat(F.translate(F.format_number(c, 2), ",.", ".,"), F.lit(" EUR"))


def first_percentage(c: Column) -> Column:
    return F.replace(F.nullif(F.regexp_extract(c, r"(\d{1,3}(?:[.,]\d+)?)\s*%", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
