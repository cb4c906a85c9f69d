from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hemiciclo.llm.common import range_offsets
from hemiciclo.llm.mixing import mix, mixed_documents, source_targets
from llm_helpers import DOCS, SF2, filled, mixed, words


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in source_targets(df).orderBy("source").collect()]
    assert got == pytest.approx(filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]), abs=1e-6)


def test_documents_mix(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    rows = mix(docs, range_rows=7).collect()
    for again in (mix(docs, range_rows=7), mix(docs.repartition(5)), mix(docs.orderBy(docs.text), range_rows=3)):
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert {r.doc_id: r.taken for r in rows} == mixed([(r.doc_id, r.text, r.source) for r in docs.collect()])
    sources, taken, target = {r.doc_id: r.source for r in docs.collect()}, {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[sources[r.doc_id]] = taken.get(sources[r.doc_id], 0) + r.taken
        target[sources[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", None, None, 0), (1, "a b c", None, None, 0), (2, None, "x", "s", 0), (None, "w " * 50, "x", "s", 0), (4, "", "x", "t", 0)], DOCS)
    rows = mix(docs).collect()
    assert len(rows) == 5 and sum(r.taken for r in rows) == pytest.approx(56, abs=2)
    assert {r.source_size for r in rows if r.doc_id == 1} == {6} and {r.target for r in rows if r.doc_id == 4} == {0.0}
    assert mix(docs.where("false")).count() == 0
    copies = mixed_documents(docs.withColumn("n", docs.n_chars).selectExpr("*", "1 as size", "2 as range", "3 as key"))
    assert copies.columns == ["doc_id", "text", "lang", "source", "n_chars", "n", "size", "range", "key"]
    assert all(words(r.text) for r in copies.collect())


def test_range_offsets_in_two_levels(spark):
    rows = [(g, at, (at * 7) % 5) for g in ("a", None) for at in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "source string, range long, words long")
    got = {(r.source, r.range): r.offset for r in range_offsets(df, "source", "range", "words", fan=7).collect()}
    assert got == {(g, at): sum(w for h, b, w in rows if h == g and b < at) for g, at, _ in rows}
    assert range_offsets(df.where("false"), "source", "range", "words").count() == 0


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, "x", "a", 0), (2, "one two", "x", "b", 0)], DOCS)
    assert {r.doc_id: (r.size, r.taken) for r in mix(docs).collect()} == {i: (n, t) for i, n, t in ((1, 300_000, 300_000 - 4), (2, 2, 6))}
