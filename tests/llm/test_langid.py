from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from hemiciclo.llm import langid
from hemiciclo.llm.queries import op9_language
from llm_helpers import DOCS, SF1, code_lengths


TRAIN = [("en", "The other day, then the 2 others."), ("en", "the end\nof it all; a man, a plan"), ("de", "Der Tag, an dem die Tür der Halle zu war."), ("de", "über 12 % der Leute"), ("zz", "a")]


def trained(texts):
    rows = []
    for lang, t in texts:
        found, n = langid.longest_strings(np.frombuffer(t.encode(), np.uint8), np.arange(len(t.encode())))
        rows += [(lang, s, c) for s, c in zip(found.tolist(), n.tolist(), strict=True)]
    return langid.ContextTrees(rows)


@pytest.mark.parametrize("cells", [3, 12, 4_000_000])
def test_code_lengths_of_whole_texts(monkeypatch, cells):
    monkeypatch.setattr(langid, "CELLS", cells)
    monkeypatch.setattr(langid, "LEAST_BYTES", 1)
    trees = trained(TRAIN)
    texts = ["the man of 12 halls", "über die Tür, the end", "zebra 漢字 \x00\t..", "", "a", "The other day, then the 2 others."]
    got = trees.of_texts(*langid.text_bytes(pa.array(["cut", *texts, None])[1:]))
    assert got == pytest.approx(np.array([[code_lengths(TRAIN, trees.langs, t)[k] for k in range(len(trees.langs))] for t in [*texts, ""]]), rel=1e-5)


def test_query_equals_brute_force(spark):
    """op9 at the smallest size: which texts train, and the code lengths that decide."""
    docs = spark.read.parquet(f"{SF1}/documents.parquet").collect()
    train = [(r.lang, r.text) for r in docs if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    rows = {r.doc_id: r for r in op9_language(spark, SF1).collect()}
    assert len(rows) == len(docs)
    langs = sorted({lang for lang, _ in train})
    for r in sorted(docs, key=lambda r: len(r.text))[:20]:
        bits = code_lengths(train, langs, r.text)
        assert rows[r.doc_id].lang_pred == langs[int(np.argmin(bits))] and rows[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert rows[r.doc_id].score == pytest.approx(1 / sum(2 ** (min(bits) - b) for b in bits), abs=1e-2)


def test_letters():
    assert [langid.has_letter(t) for t in (None, "", "½ ² + 3", "١٢ Ⅷ", "ª", "1é", "漢")] == [False, False, False, False, True, True, True]


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = langid.identify(docs, langid.train_trees(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.99


def test_held_out_labels_are_never_read(spark):
    docs = spark.createDataFrame([(i, "der die das" if i % 2 else "the of and", "de" if i % 2 else "en", "s", 0) for i in range(40)], DOCS)
    turned = docs.withColumn("lang", langid.F.when(langid.crc_fold(langid.F.col("doc_id"), 4) == 2, "zz").otherwise(docs.lang))
    out = lambda d: sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(d, langid.train_trees(d)).collect())
    assert out(docs) == out(turned) and all(p == ("de" if i % 2 else "en") for i, p, _ in out(docs))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, 0), (2, "12 + ##", "x", "s", 0), (3, "the", None, "s", 0), (4, "the " * 20000, "en", "s", 0), (None, "der", "de", "s", 0), (5, "der", "de", "s", 0), (6, "½ ² + 3", "en", "s", 0)], DOCS).selectExpr("*", "1 as score", "2 as row")
    rows = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.train_trees(docs)).collect()}
    assert rows[1] == ("und", 0.0) == rows[2] == rows[6] and 0 <= rows[3][1] <= 1 and len(rows) == 7
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, None).collect()} == {("und", 0.0)}
    assert langid.in_known_language(docs).columns == docs.columns
    empty = docs.where("false")
    assert langid.identify(empty, langid.train_trees(empty)).count() == 0
