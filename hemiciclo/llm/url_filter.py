"""URL filters: host rules natively, and a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemiciclo.llm.common import ascii_lower

#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: One of these is enough to reject a URL.
STRICT = (
    "casino", "casinos", "gambling", "jackpot", "malware", "phishing", "poker", "porn", "porno", "roulette",
    "scam", "spam", "viagra", "cialis", "warez", "xxx",
)
#: Of these, `soft_limit` different ones are.
SOFT = (
    "adult", "ads", "bet", "bets", "betting", "bonus", "buy", "cheap", "click", "clicks", "coupon", "crack", "dating",
    "deal", "deals", "discount", "farm", "free", "keygen", "loan", "loans", "lottery", "pharmacy", "pill", "pills",
    "popup", "prize", "sex", "slots", "torrent", "track", "tracker", "win", "winner",
)
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (0, strict)):  # a term in both lists is strict
        for t in terms:
            a.add_word(t, (t, weight))
    a.make_automaton()
    return a


def bounded_hits(text: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[set[str], set[str]]:
    """The different strict and soft terms in `text` (lower case) that no ASCII letter or digit touches."""
    found: tuple[set[str], set[str]] = set(), set()
    for end, (term, is_soft) in _automaton(strict, soft).iter(text):
        before = end - len(term)
        if (before < 0 or text[before] not in _ALNUM) and (end + 1 == len(text) or text[end + 1] not in _ALNUM):
            found[is_soft].add(term)
    return found


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one or for NULL."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain, and a path that starts with its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def judge_urls(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Iterable[tuple[str, str, str]] = RULES,
    vocabulary: Mapping[str, tuple[str, ...]] | None = None,
    soft_limit: int = 2,
) -> DataFrame:
    """A verdict on every row's URL; one narrow pass, nothing is shuffled.

    The vocabulary weighs terms: a strict one weighs as much as `soft_limit` soft ones, each term counts once, and a
    URL that weighs `soft_limit` or more is blocked unless a rule says otherwise. NULL and schemeless URLs have an
    empty host and path and fit no rule, but the vocabulary still sees their text; NULL and '' are allowed. Repeated
    rows are judged each; other columns are not looked at.
    """
    terms = vocabulary or {"strict": STRICT, "soft": SOFT}
    strict, soft = tuple(terms["strict"]), tuple(terms["soft"])

    @F.pandas_udf("struct<strict: array<string>, soft: array<string>>")
    def hits(urls: pd.Series) -> pd.DataFrame:
        found = [bounded_hits(u, strict, soft) if u else ((), ()) for u in urls]
        return pd.DataFrame({"strict": [sorted(a) for a, _ in found], "soft": [sorted(b) for _, b in found]})

    url = F.col(url_col)
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    weight = F.size("hit.strict") * soft_limit + F.size("hit.soft")
    return (
        pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), hits(ascii_lower(url)).alias("hit"))
        .withColumns({"rule": rule, "ruled": ruled})
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce("ruled", F.when(weight >= soft_limit, "block").otherwise("allow")).alias("verdict"),
            F.size("hit.strict").cast("long").alias("n_strict"), F.size("hit.soft").cast("long").alias("n_soft"),
        )
    )


def judge_sql(rules: Iterable[tuple[str, str, str]] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = 2) -> str:
    """The same in DuckDB SQL: boundary checks as regular expressions, one a term."""
    has = lambda t: rf"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS BIGINT)"
    fits = [(h + p, v, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    return f"""
    WITH a AS (
      SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
        coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS u
      FROM pages),
    b AS (
      SELECT *, CASE {' '.join(f"WHEN {f} THEN '{r}'" for r, _, f in fits)} END AS rule,
        CASE {' '.join(f"WHEN {f} THEN '{v}'" for _, v, f in fits)} END AS ruled,
        {' + '.join(map(has, strict))} AS n_strict, {' + '.join(map(has, soft))} AS n_soft
      FROM a)
    SELECT page_id, host, path, rule, n_strict, n_soft,
      coalesce(ruled, CASE WHEN n_strict * {soft_limit} + n_soft >= {soft_limit} THEN 'block' ELSE 'allow' END) AS verdict
    FROM b"""
