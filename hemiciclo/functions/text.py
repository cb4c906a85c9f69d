"""Text as Column expressions: folding, tokens, keys, speaker names, page quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with a mark and their base letters (what NFKD without combining marks gives), lower case.
ACCENTED = "áàâäãåāăąçćčďéèêëēėęěíìîïīįñńňóòôöõōőŕřśšťúùûüūůűýÿźžż"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiinnnooooooorrsstuuuuuuuyyzzz"
#: Particles that never identify a person.
PARTICLES = ("de", "del", "la", "las", "los", "y")
KEY_PARTICLES = ("de", "del", "la", "las", "el", "los")
SPACE = r"[\s ]+"


def squeeze(c: Column) -> Column:
    """NBSP and runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def fold(c: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def norm_key(c: Column) -> Column:
    """A field name: folded, everything but letters and digits as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def key_aliases(c: Column) -> Column:
    """The names under which a field can be looked up: its key, without underscores, without particles as well."""
    key = norm_key(c)
    kept = F.filter(F.split(key, "_"), lambda p: ~p.isin(*KEY_PARTICLES))
    names = F.array(key, F.replace(key, F.lit("_"), F.lit("")), F.array_join(kept, ""))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def normalized_record(record: Column) -> Column:
    """MAP<STRING, STRING>: every alias of every key with its squeezed value; the first writer of an alias wins."""
    pairs = F.flatten(F.transform(F.map_entries(record), lambda e: F.transform(key_aliases(e["key"]), lambda a: F.struct(a.alias("key"), squeeze(e["value"]).alias("value")))))
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    first = F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == n), 1)["value"].alias("value")))
    return F.map_from_entries(first)


def word_list(c: Column) -> Column:
    """Folded runs of letters a-z and digits, in order, with repeats."""
    return F.regexp_extract_all(fold(c), F.lit("([a-z0-9]+)"), F.lit(1))


def identity_tokens(c: Column) -> Column:
    """The set of folded words of a name without particles; empty for NULL."""
    return F.array_except(F.array_distinct(word_list(F.coalesce(c, F.lit("")))), F.array(*map(F.lit, PARTICLES)))


def token_key(c: Column) -> Column:
    """The identity tokens in order, as one string: equal for the same person however the name is written."""
    return F.array_join(F.array_sort(identity_tokens(c)), " ")


def is_subset(wanted: Column, found: Column) -> Column:
    """Whether `wanted` is not empty and all its tokens are in `found`."""
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, found)) == 0)


def speaker_key(c: Column) -> Column:
    """A speaker's name for comparison: format characters and a change from four small letters to a capital split words,
    hyphens join over a line break and split elsewhere, parentheses go, letters and spaces stay."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"\p{Cf}", " ")
    x = F.regexp_replace(x, "(?<=[a-záéíóúüñ]{4})(?=[A-ZÁÉÍÓÚÜÑ])", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?<=[\p{L}\p{N}_])-\s+(?=[\p{L}\p{N}_])", ""), r"(?<=[\p{L}\p{N}_])[-\u2010-\u2014](?=[\p{L}\p{N}_])", " ")
    x = F.replace(fold(squeeze(F.regexp_replace(x, r"\([^)]*\)", ""))), F.lit(","), F.lit(" "))
    return squeeze(F.regexp_replace(x, "[^a-z ]+", ""))


def speaker_match_tokens(c: Column) -> Column:
    """Words of a speaker key with more than two letters that are no particle; repeats stay."""
    return F.filter(F.split(speaker_key(c), " "), lambda t: (F.length(t) > 2) & ~t.isin(*PARTICLES, "don", "dona", "doa"))


def same_identifier(left: Column, right: Column) -> Column:
    """Equal as numbers when both are digits, else equal when folded; NULL equals nothing."""
    digits = left.rlike(r"^\d+$") & right.rlike(r"^\d+$")
    same = F.when(digits, F.ltrim(left, F.lit("0")) == F.ltrim(right, F.lit("0"))).otherwise(fold(left) == fold(right))
    return F.coalesce(same, F.lit(False))


def contains_folded(c: Column, wanted: str | Column) -> Column:
    wanted = F.lit(wanted) if isinstance(wanted, str) else wanted
    return F.contains(fold(c), fold(wanted))


def page_quality(c: Column) -> Column:
    """.55 for 30 words and .45 for 400 characters, less four times the shares of replacement and control characters; 0 at least."""
    chars = F.length(c)
    words = F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+"))
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / F.greatest(chars, F.lit(1))
    score = 0.55 * F.least(F.lit(1.0), words / 30.0) + 0.45 * F.least(F.lit(1.0), chars / 400.0) - 4 * share("�") - 4 * share(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    return F.greatest(F.lit(0.0), score)


def evidence_window(c: Column, start: Column, end: Column, margin: int = 80) -> Column:
    """The text from `margin` characters before `start` (0-based) to `margin` after `end` (past the last)."""
    begin = F.greatest(F.lit(0), start - margin)
    return F.substring(c, begin + 1, F.least(F.length(c), end + margin) - begin)


def repair_mojibake(c: Column) -> Column:
    """Text read as Latin-1 that was UTF-8, read again; as it is unless that removes traces of damage."""
    again = F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")
    damage = lambda x: F.regexp_count(x, F.lit("[ÂÃâ�]"))
    return F.when((damage(c) > 0) & (damage(again) < damage(c)), again).otherwise(c)


def clean_line(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"[•·|]+", " "))


def compact(c: Column) -> Column:
    """Folded, letters and digits only."""
    return F.regexp_replace(fold(c), "[^a-z0-9]+", "")


def ocr_compact(c: Column) -> Column:
    """compact() with digits that stand for letters in scans."""
    return F.translate(compact(c), "061", "ooi")


def safe_token(c: Column) -> Column:
    """For file names: everything but letters, digits, dot, dash and underscore becomes a dash."""
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")


def redact(c: Column) -> Column:
    """MAP<STRING, STRING> with the values of secret-like keys hidden."""
    secret = "(?i)api[-_]?key|token|secret|password|authorization|credential"
    return F.transform_values(c, lambda k, v: F.when(k.rlike(secret), F.lit("[REDACTED]")).otherwise(v))


def unwrap_csv_value(c: Column) -> Column:
    """Undoes the extra layer of quotes in a cell; a single doubled quote at the end closes one that was lost at the start."""
    lone = c.endswith('""') & (F.regexp_count(c, F.lit('""')) == 1)
    whole = F.when(lone, F.concat(F.lit('"'), F.regexp_replace(c, '""$', ""), F.lit('"'))).otherwise(c)
    return F.replace(whole, F.lit('""'), F.lit('"'))
