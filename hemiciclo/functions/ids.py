"""Identities: hashes over normalized parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemiciclo.functions.text import squeeze


def _part(c: Column | str) -> Column:
    """A part's text; NULL, '' and zero count as nothing."""
    c = F.lit(c) if isinstance(c, str) else c
    text = F.coalesce(squeeze(c.cast("string")), F.lit(""))
    return F.when(text.isin("0", "0.0", "false"), F.lit("")).otherwise(text)


def text_part(c: Column | str) -> Column:
    """For parts that are text already: '0' stays."""
    c = F.lit(c) if isinstance(c, str) else c
    return F.coalesce(squeeze(c), F.lit(""))


def stable_id(*parts: Column | str) -> Column:
    """sha256 of the squeezed parts between bars. Text parts keep '0'; parts of other types that are zero vanish."""
    return F.sha2(F.concat_ws("|", *(text_part(p) for p in parts)), 256)


def stable_id_of_values(*parts: Column) -> Column:
    """stable_id for parts that may be numbers or booleans."""
    return F.sha2(F.concat_ws("|", *(_part(p) for p in parts)), 256)


def short_id(*parts: Column | str) -> Column:
    """The first 32 hexadecimal digits of stable_id."""
    return F.substring(stable_id(*parts), 1, 32)


def canonical_json(m: Column) -> Column:
    """A string map as compact JSON in order of keys; NULL for NULL and for the empty map."""
    entries = F.map_from_entries(F.array_sort(F.map_entries(m)))
    return F.when(F.size(m) > 0, F.to_json(entries))


def fingerprint(m: Column) -> Column:
    return F.sha2(canonical_json(m), 256)
