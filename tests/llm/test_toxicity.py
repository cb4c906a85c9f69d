from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np

from hemiciclo.llm import toxicity
from hemiciclo.llm.queries import op5_toxicity
from llm_helpers import DOCS, SF1, terms_of, toxicity_scores


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    labels = np.array(labels)
    up, down = labels.sum(), len(labels) - labels.sum()
    return (order[labels == 1].sum() - up * (up + 1) / 2) / (up * down)


def test_search_equals_brute_force():
    rng = random.Random(5)
    vectors = []
    for _ in range(700):
        raw = {t: rng.choice([1.0, 2.0, rng.random()]) for t in rng.sample(range(40), rng.randint(1, 6))}
        size = sum(x * x for x in raw.values()) ** 0.5
        vectors.append({t: x / size for t, x in raw.items()})
    ids = list(range(1000, 1700))
    index = toxicity.BlockMaxIndex(vectors, [i % 2 for i in ids], ids, 40)
    for q in vectors[:60]:
        at, cosines = index.search(q, 15)
        every = sorted(((-round(sum(w * v.get(t, 0) for t, w in q.items()), 12), i) for i, v in zip(ids, vectors, strict=True)))[:15]
        assert [(-round(c, 12), i) for c, i in zip(cosines, index.ids[at], strict=True)] == [x for x in every if x[0] < 0]


def test_terms_of_long_texts_are_the_same_in_pieces(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdéñßx") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 400))) for _ in range(12)]
    texts += [None, "", "İSTANBUL ſß 12_ab", "x" * 5000]
    for chunk in (100, 1 << 20):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        doc, slot, n = toxicity.term_counts(texts)
        got = [Counter() for _ in texts]
        for d, s, c in zip(doc.tolist(), slot.tolist(), n.tolist(), strict=True):
            got[d][s] += c
        assert got == [terms_of(t) for t in texts]


def test_query_equals_brute_force(spark):
    """Scores and neighbours of op5 at the smallest size, from term counts, cosines and votes computed one by one."""
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    want = toxicity_scores({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()})
    rows = op5_toxicity(spark, SF1).collect()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    for r in rows:
        near, score = want[r.doc_id]
        assert [(e.doc_id, e.toxic) for e in r.evidence] == [(e, y) for e, y, _ in near]
        assert np.allclose([e.cosine for e in r.evidence], [c for _, _, c in near])
        assert abs(r.score - score) < 1e-9 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert auc([r.score for r in rows], [r.toxic for r in rows]) > 0.93
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.85 and hit / sum(r.predicted for r in rows) > 0.88


def test_held_out_labels_are_never_read(spark):
    docs = spark.createDataFrame([(i, f"gut wort{i} {'idiot' if i % 2 else 'rose'}", "de", "s", 0) for i in range(60)], DOCS)
    fold = {r.doc_id: r.held_out for r in toxicity.score_toxicity(docs, None).collect()}
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    turned = spark.createDataFrame([(i, 1, 1 - i % 2 if fold[i] else i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    score = lambda y: sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, y)).collect())
    assert score(labels) == score(turned)
    assert all((s >= 0.7) == bool(i % 2) for i, s in score(labels))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, 0), (2, "", "x", "s", 0), (None, "IDIOT! " * 5000, "x", "s", 0), (2, "idiot", "x", "s", 0), (2, "idiot", "x", "s", 0)], DOCS).selectExpr("*", "1 as score", "'x' as evidence")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, none)).collect()} == {(0.0, 0)}
    many = spark.createDataFrame([(i, "idiot tor" if i % 2 else "rose tor", "de", "s", 0) for i in range(40)], DOCS)
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(40)] + [(None, 1, 1), (41, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(many, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and {r.predicted for r in rows if r.doc_id is None} == {1}
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert toxicity.score_toxicity(docs.where("false"), model).count() == 0


def test_a_query_pays_for_the_terms_it_shares_with_an_example(monkeypatch):
    """Examples with many words of their own: only frequent terms are looked up again for the cosines, however long the examples are."""
    rng = np.random.default_rng(5)
    vectors = []
    for i in range(400):
        slots = np.concatenate([rng.choice(30, 6, replace=False), 100 + 500 * i + np.arange(500), rng.choice(np.arange(40, 100), 2, replace=False)])
        w = rng.random(len(slots)) + 0.1
        vectors.append((slots, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex(vectors, [i % 2 for i in range(400)], list(range(400)), 210_000)
    queries = [vectors[3], (np.array([1, 2, 50, 209_999]), np.full(4, 0.5)), vectors[7]]
    place = int(np.flatnonzero(index.ids == 7)[0])
    found = index.search_many(queries, 10, [-1, -1, place])
    for (slots, w), (at, cosines), but in zip(queries, found, [-1, -1, 7], strict=True):
        full = np.zeros(210_000)
        full[slots] = w
        every = sorted((-round(float(full[s] @ x), 12), i) for i, (s, x) in enumerate(vectors) if i != but)[:10]
        assert [(-round(c, 12), i) for c, i in zip(cosines.tolist(), index.ids[at].tolist(), strict=True)] == every
    assert (index.dense_last - index.first[:-1]).max() <= 30 < np.diff(index.first).min()
