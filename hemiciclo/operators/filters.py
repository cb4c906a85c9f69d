"""Predicates: domain queries compiled to Columns, and line classifiers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.functions.dates import legislature_roman
from hemiciclo.functions.text import contains_folded, identity_tokens, is_subset, same_identifier

#: Where a filter looks; any other filter looks in the column of its own name.
ALIASES = {"name": ("name", "full_name", "title", "label"), "deputy": ("deputy_name", "name", "full_name")}
DATE_COLUMNS = ("session_date", "vote_date", "presented_at", "effective_date", "date")


def legislature_filter(c: Column, wanted: Sequence[str]) -> Column:
    """NULL passes; text that names no legislature fails."""
    return c.isNull() | F.coalesce(legislature_roman(c.cast("string")).isin(*wanted), F.lit(False))


def token_filter(columns: Sequence[Column], wanted: str) -> Column:
    """One of the columns holds all tokens of `wanted`."""
    w = identity_tokens(F.lit(wanted))
    out = F.lit(False)
    for c in columns:
        out = out | (c.isNotNull() & is_subset(w, identity_tokens(c.cast("string"))))
    return out


def text_filter(columns: Sequence[Column], wanted: str) -> Column:
    """One of the columns contains `wanted`, both folded."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(contains_folded(c.cast("string"), wanted), F.lit(False))
    return out


def date_filter(c: Column, first: dt.date | None, last: dt.date | None) -> Column:
    """NULL passes."""
    out = F.lit(True)
    if first is not None:
        out = out & (c >= F.lit(first))
    if last is not None:
        out = out & (c <= F.lit(last))
    return c.isNull() | out


def record_date(df: DataFrame) -> Column | None:
    there = [F.col(c) for c in DATE_COLUMNS if c in df.columns]
    return F.coalesce(*there) if there else None


def matches(df: DataFrame, filters: Mapping[str, str | None], *, legislatures: Sequence[str] = (), date_from: dt.date | None = None, date_to: dt.date | None = None, aliases: Mapping[str, Sequence[str]] = ALIASES) -> Column:
    """The predicate of a domain query over the columns of `df`.

    A filter that is set and finds no column, or only NULLs, fails the row; names match by token subset, everything
    else by folded substring. NULL legislatures and NULL dates pass.
    """
    out = F.lit(True)
    if legislatures and "legislature" in df.columns:
        out = out & legislature_filter(F.col("legislature"), legislatures)
    for key, wanted in filters.items():
        if wanted is None:
            continue
        there = [F.col(c) for c in aliases.get(key, (key,)) if c in df.columns]
        out = out & (token_filter(there, wanted) if key in ("name", "deputy") else text_filter(there, wanted))
    day = record_date(df)
    return out if day is None or (date_from is None and date_to is None) else out & date_filter(day, date_from, date_to)


def resources_for(catalog: DataFrame, *, family: str | None = None, dataset: str | None = None, formats: Sequence[str] = (), legislatures: Sequence[str] = (), session: str | None = None, vote_number: str | None = None) -> DataFrame:
    """Source pruning: the catalogue's rows that a query can need, before anything is read."""
    out = F.lit(True)
    for column, value in (("family", family), ("dataset", dataset)):
        if value is not None:
            out = out & (F.col(column) == value)
    if formats:
        out = out & F.col("format").isin(*formats)
    if legislatures:
        out = out & legislature_filter(F.col("legislature"), legislatures)
    for column, value in (("session", session), ("vote_number", vote_number)):
        if value is not None:
            out = out & same_identifier(F.col(column).cast("string"), F.lit(value))
    return catalog.where(out)


def scoped_votes(events: DataFrame, children: DataFrame, filters: Mapping[str, str | None], *, deputy: str | None = None, **bounds) -> DataFrame:
    """Nominal rows or items of the events that match; with a deputy, the rows of theirs only."""
    kept = events.where(matches(events, {k: v for k, v in filters.items() if k != "deputy"}, **bounds))
    out = children.join(kept.select("vote_id"), "vote_id", "left_semi")
    return out if deputy is None else out.where(token_filter([F.col("deputy_name")], deputy))


def looks_like_table_row(line: Column) -> Column:
    """Two cells or more, or an amount at the end."""
    return F.coalesce(line.rlike(r"\S(\s{2,}|\t|\s\|\s)\S") | line.rlike(r"\d[\d.]*,\d{2}\s*(€|EUR)?\s*$"), F.lit(False))


def needs_ocr(text: Column) -> Column:
    """Fewer than 80 characters or 8 words."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) < 80) | (F.regexp_count(t, F.lit(r"\S+")) < 8)


def valid_day(c: Column) -> Column:
    """A real calendar day in yyyymmdd."""
    return F.coalesce(c.rlike(r"^\d{8}$") & F.try_to_date(c, "yyyyMMdd").isNotNull(), F.lit(False))


def any_token(line: Column, tokens: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(line, t))
