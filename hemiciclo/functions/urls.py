"""URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemiciclo.functions.text import fold


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def dataset_name(url: Column) -> Column:
    """The file's stem before '__'."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^.*/", ""), r"\.[^.]*$", "")
    return F.split(stem, "__")[0]


def snapshot_token(url: Column) -> Column:
    """The 14-digit time stamp of a file name."""
    return _found(url, r"(?<!\d)(\d{14})(?!\d)")


def query_param(url: Column, key: str) -> Column:
    """The first value of a query parameter, decoded."""
    return F.try_url_decode(_found(url, rf"[?&]{key}=([^&#]*)"))


def fragment(url: Column) -> Column:
    return _found(url, "#(.*)$")


def page_hint(url: Column) -> Column:
    """The page of '#page=12' or 'Página 12'."""
    return F.coalesce(_found(url, r"(?i)#page=(\d+)"), _found(fold(url), r"pagina\s+(\d+)")).try_cast("int")


def mime_type(url: Column) -> Column:
    path = F.regexp_replace(F.lower(url), "[?#].*$", "")
    return F.when(path.endswith(".pdf"), "application/pdf").when(path.endswith(".mp4"), "video/mp4").when(path.endswith(".xml"), "application/xml")


def format_of(url: Column) -> Column:
    return F.lower(_found(F.regexp_replace(url, "[?#].*$", ""), r"\.([A-Za-z0-9]{2,5})$"))


def canonical_url(url: Column, base: str) -> Column:
    """The last http(s) address of a concatenated string, else the text under `base`; without ':443' and fragment."""
    last = F.regexp_replace(url, r"^.*(?=https?://)", "")
    absolute = F.when(last.rlike("^https?://"), last).when(last.startswith("/"), F.concat(F.lit(base), last)).otherwise(F.concat(F.lit(base + "/"), last))
    return F.when(F.trim(url) != "", F.regexp_replace(F.regexp_replace(absolute, r"(?<=://[^/]{1,200}):443(?=/|$)", ""), "#.*$", ""))


def absolute_url(value: Column, base: str) -> Column:
    return F.when(value.rlike("^https?://"), value).when(value.startswith("/"), F.concat(F.lit(base), value)).when(value != "", F.concat(F.lit(base + "/"), value))


def split_links(value: Column) -> Column:
    """The http addresses of a text between white space; a fragment that stands apart joins the address before it."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+#", "#")
    return F.filter(F.split(text, r"\s+"), lambda x: x.rlike("^https?://"))


def document_id(full_text_url: Column, pdf_url: Column) -> Column:
    """The text's id parameter without parentheses, else the PDF's stem, scoped by its legislature unless it names that itself."""
    text_id = F.nullif(F.regexp_replace(query_param(full_text_url, "_intervenciones_id_texto"), r"^[()]+|[()]+$", ""), F.lit(""))
    path_ = F.regexp_replace(pdf_url, "[?#].*$", "")
    stem = F.nullif(F.regexp_replace(F.regexp_replace(path_, "^.*/", ""), r"(?i)\.pdf$", ""), F.lit(""))
    scope = _found(path_, r"(?i)/L(\d+)/")
    own = F.lower(stem).startswith(F.concat(F.lit("dscd-"), scope, F.lit("-"))) | (F.lower(stem) == F.concat(F.lit("dscd-"), scope))
    return F.coalesce(text_id, F.when(scope.isNull() | (scope == "0") | own, stem).otherwise(F.concat(F.lit("L"), scope, F.lit("-"), stem)))


def vote_context(url: Column) -> Column:
    """STRUCT<legislature, session, day, vote> of a vote artifact's address."""
    p = r"(?i)/Leg(\d+)/Sesion(\d+)/(\d{8})(?:/Votacion(\d+))?"
    return F.struct(_found(url, p, 1).alias("legislature"), _found(url, p, 2).alias("session"), _found(url, p, 3).alias("day"), _found(url, p, 4).alias("vote"))


def host(url: Column) -> Column:
    return F.lower(_found(url, r"^[a-z]+://([^/?#]+)"))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
