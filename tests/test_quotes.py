from __future__ import annotations

import duckdb

from hemiciclo.plans import queries


def test_quotes_of_any_length(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven, eight nine ten."), (2, "three"), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    quotes = ["one two three four five six seven", "two three four", "three", "ee", "three four five six seven, eight nine ten", "one two three four five six seven eight", None]
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    expected = sorted(db.sql(queries.ORACLES["quote_evidence"]).fetchall())
    assert sorted((r.item_id, r.doc_id, r.first_at) for r in queries.QUERIES["quote_evidence"](spark, str(tmp_path)).collect()) == expected
    assert {i for i, _, _ in expected} == {0, 1, 2, 3, 4}
