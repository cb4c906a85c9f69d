"""Queries that SQL can express, against it."""

from __future__ import annotations

import duckdb
import pytest

from hemiciclo.llm import queries
from llm_helpers import SF1, SF2


@pytest.mark.parametrize("sf", [SF1, SF2])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name, sf):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, sf).toPandas(), db.sql(queries.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    plain = lambda f: sorted((tuple(None if v != v else round(v, 6) if isinstance(v, float) else v for v in r) for r in f[columns].astype(object).itertuples(index=False, name=None)), key=repr)
    assert plain(ours) == plain(theirs)
