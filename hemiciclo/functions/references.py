"""Initiative file numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^(\d{2,3})/(\d{1,6})(?:/(\d{1,4}))?$"
_IN_TEXT = r"(\d{2,3}/\d{1,6}(?:/\d{1,4})?)"


def _canonical(c: Column) -> Column:
    """The parts of a file number, filled with zeros; the text is cut once."""
    whole = F.transform(F.array(F.split(c, "/")), lambda p: F.concat_ws("/", F.lpad(p[0], 3, "0"), F.lpad(p[1], 6, "0"), F.lpad(F.coalesce(F.get(p, F.lit(2)), F.lit("")), 4, "0")))
    return whole[0]


def file_number(c: Column) -> Column:
    """'121/1' as '121/000001/0000'; other text only trimmed."""
    t = F.trim(c)
    return F.when(t.rlike(_NUMBER), _canonical(t)).otherwise(F.nullif(t, F.lit("")))


def file_reference(c: Column) -> Column:
    """STRUCT<file_number, qualifier>: the number and a trailing third part other than zeros."""
    canonical = file_number(c)
    last = F.regexp_extract(canonical, r"^\d{3}/\d{6}/(\d{4})$", 1)
    return F.struct(F.regexp_replace(canonical, r"/\d{4}$", "/0000").alias("file_number"), F.when((last != "") & (last != "0000"), last).alias("qualifier"))


def file_numbers_in(c: Column) -> Column:
    """All file numbers of a text, canonical, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_IN_TEXT), F.lit(1)), _canonical))


def file_prefix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(\d{3})/", 1), F.lit(""))
