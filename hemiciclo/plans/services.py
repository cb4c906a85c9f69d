"""Domain queries: what a caller asks for, compiled to one lazy plan over a domain's rows."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemiciclo.functions.dates import ROMAN
from hemiciclo.operators import dedup, filters, limits


class QueryError(ValueError):
    """The query itself is wrong."""


class AmbiguousIdentity(LookupError):
    """More than one person answers to the name."""


class IdentityNotFound(LookupError):
    """No person answers to the name."""


def roman(value: str | int) -> str:
    """'XV' of 15, '15', 'XV' and 'Leg.15'; 0 stays '0'."""
    import re

    raw = re.sub(r"^LEG[.\s_-]*", "", str(value).strip().upper())
    raw = raw.lstrip("0") or "0" if raw.isdigit() else raw
    if raw in ROMAN:
        return ROMAN[raw]
    if raw in ROMAN.values():
        return raw
    raise QueryError(f"no legislature: {value!r}")


def months_back(day: dt.date, months: int) -> dt.date:
    """The same day `months` earlier, or its month's last."""
    at = day.year * 12 + day.month - 1 - months
    first = dt.date(at // 12, at % 12 + 1, 1)
    last = (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
    return first.replace(day=min(day.day, last.day))


@dataclass(frozen=True)
class Query:
    """Common bounds. `filters` are the domain's own: name, deputy, session, title, ..."""

    legislatures: tuple[str, ...] = ()
    filters: dict[str, str | None] = field(default_factory=dict)
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    last_months: int | None = None
    today: dt.date | None = None
    descending: bool = False
    max_results: int | None = 50_000

    def __post_init__(self):
        if self.max_results is not None and not 1 <= self.max_results <= 1_000_000:
            raise QueryError("max_results must lie between 1 and 1,000,000")
        object.__setattr__(self, "legislatures", tuple(dict.fromkeys(map(roman, self.legislatures))))
        if self.last_months is not None:
            if self.date_from is not None or self.today is None or self.last_months < 1:
                raise QueryError("last_months needs `today`, and no date_from")
            object.__setattr__(self, "date_from", months_back(self.today, self.last_months))
            object.__setattr__(self, "date_to", self.date_to or self.today)
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise QueryError("date_from is after date_to")


#: The filters that each service takes.
SERVICES = {
    "deputies": ("name", "deputy_id", "constituency", "parliamentary_group"),
    "profiles": ("name", "deputy_id"),
    "interests": ("deputy", "declaration_kind"),
    "financial_documents": ("deputy", "document_kind"),
    "initiatives": ("title", "text", "author", "file_number", "initiative_type"),
    "votes": ("session", "vote_number", "deputy"),
    "organs": ("name", "organ_type"),
    "salaries": ("role",),
    "documents": ("family", "dataset", "document_kind", "entity_id", "mime_type"),
    "interventions": ("speaker", "deputy_id", "title", "text", "initiative_type", "file_number", "phase", "organ", "author"),
}


def search(rows: DataFrame, query: Query, *, identity: str, service: str | None = None) -> DataFrame:
    """The matching rows, the most complete of each identity, in order; more than the cap is an error, None is no cap."""
    if service is not None and (odd := set(query.filters) - set(SERVICES[service])):
        raise QueryError(f"{service} does not take {sorted(odd)}")
    aliases = dict(filters.ALIASES)
    if service == "profiles":
        aliases["deputy_id"] = ("deputy_id", "parliamentary_code")
    if service == "initiatives":
        aliases["title"] = ("title", "subject")
    if service == "interventions":
        aliases["deputy"] = ("speaker",)
    kept = rows.where(filters.matches(rows, query.filters, legislatures=query.legislatures, date_from=query.date_from, date_to=query.date_to, aliases=aliases))
    day = filters.record_date(kept)
    best = dedup.most_complete(kept, [identity], [c for c in sorted(kept.columns) if dict(kept.dtypes)[c] in ("string", "date", "int", "bigint")])
    out = best if query.max_results is None else limits.ensure_at_most(best, query.max_results)
    return out.orderBy(*limits.sort_key(day if day is not None else F.lit(""), F.col(identity), descending=query.descending))


def search_votes(events: DataFrame, nominal: DataFrame, items: DataFrame, query: Query) -> dict[str, DataFrame]:
    """The matching events with their nominal rows and items; with a deputy, only that deputy's rows."""
    deputy = query.filters.get("deputy")
    wanted = {k: v for k, v in query.filters.items() if k != "deputy"}
    bounds = {"legislatures": query.legislatures, "date_from": query.date_from, "date_to": query.date_to}
    mine = filters.scoped_votes(events, nominal, wanted, deputy=deputy, **bounds)
    if deputy is not None:
        return {"nominal": mine}
    return {"events": events.where(filters.matches(events, wanted, **bounds)), "nominal": mine, "items": filters.scoped_votes(events, items, wanted, **bounds)}


def resolve_person(index: DataFrame, *, name: str | None = None, deputy_id: str | None = None) -> str:
    """The id of the one person of the index (deputy_id, full_name) with this id, or whose name has all the tokens: one with exactly these first."""
    if deputy_id is not None:
        found = index.where(F.col("deputy_id") == deputy_id).select("deputy_id", F.lit(True).alias("exact"))
    else:
        from hemiciclo.functions.text import identity_tokens

        wanted = identity_tokens(F.lit(name or ""))
        found = index.where(filters.token_filter([F.col("full_name")], name or "")).select("deputy_id", (F.size(identity_tokens(F.col("full_name"))) == F.size(wanted)).alias("exact"))
    rows = found.groupBy("deputy_id").agg(F.max("exact").alias("exact")).orderBy(F.desc("exact"), "deputy_id").limit(2).collect()
    if not rows:
        raise IdentityNotFound(name or deputy_id)
    if len(rows) > 1 and rows[0]["exact"] == rows[1]["exact"]:
        raise AmbiguousIdentity(name or deputy_id)
    return rows[0]["deputy_id"]
