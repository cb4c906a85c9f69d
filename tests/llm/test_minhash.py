from __future__ import annotations

import random

import numpy as np
import pytest

from hemiciclo.llm.components import connected_components
from hemiciclo.llm.minhash import near_duplicates, shingle_set, signature, without_near_duplicates
from llm_helpers import DOCS, SF2, components, near_links, shingles


@pytest.mark.parametrize("size", [2, 5])
def test_equals_brute_force(spark, size):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = components(texts, near_links(texts, size))
    rows = near_duplicates(docs, shingle_words=size).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.kept == (r.doc_id == want[r.doc_id]) and r.n_shingles == len(shingles(texts[r.doc_id], size)) for r in rows)


def test_chains_join_through_members_that_the_centre_does_not_reach(spark):
    rng = random.Random(2)
    now = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        texts[(i * 37) % 60] = " ".join(now)
        now[rng.randrange(120)] = f"x{i}"
        now[rng.randrange(120)] = f"y{i}"
    docs = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in texts.items()], DOCS)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, shingle_words=2).collect()} == components(texts, near_links(texts, 2))


def test_passages_that_many_share_and_small_blocks(spark, monkeypatch):
    from hemiciclo.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_SETS", 7)
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {i: passage + " " + " ".join(f"o{rng.randrange(4000)}" for _ in range(40)) for i in range(150)}
    for i in range(150, 190):
        base = texts[rng.randrange(150)].split(" ")
        for _ in range(rng.randrange(1, 6)):
            base[rng.randrange(100)] = f"e{rng.random()}"
        texts[i] = " ".join(base)
    docs = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in texts.items()], DOCS)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, shingle_words=2).collect()} == components(texts, near_links(texts, 2))


def test_tiles_find_all_components():
    from hemiciclo.llm.minhash import linked_in_tile

    rng = random.Random(8)
    for _ in range(30):
        sets = [np.array(sorted(rng.sample(range(24), rng.randrange(8, 22))), np.uint64) for _ in range(24)]
        own = np.array([rng.choice([i, 0, 1]) for i in range(24)])
        link = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))  # noqa: B023, E731
        for split in (None, 10):
            pairs = [(i, j) for i in range(24) for j in range(i) if link(i, j) and own[i] != own[j] and (split is None or (i < split) != (j < split))]
            want = components(range(24), [(int(own[i]), int(own[j])) for i, j in pairs])
            got = components(range(24), [(int(own[i]), int(own[j])) for i, j in linked_in_tile(sets, own, split, 80, width=5)])
            assert got == want


def test_short_texts_and_edges(spark):
    rows = [(1, "A b", "x", "s", 0), (2, "a B", "x", "s", 0), (3, None, "x", "s", 0), (4, "", "x", "s", 0), (5, " \n\t", "x", "s", 0), (6, "One", "x", "s", 0), (7, "one", None, None, 0), (None, "a b", "x", "s", 0), (8, "Á b", "x", "s", 0), (9, "á b", "x", "s", 0), (10, "w " * 20000, "x", "s", 0), (10, "w " * 20000, "x", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as rep", "'p' as print", "0 as kept")
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, shingle_words=2).collect()}
    assert out == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (1, 6, True), 7: (1, 6, False), None: (1, None, True), 8: (1, 8, True), 9: (1, 9, True), 10: (1, 10, True)}
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 8, 9, 10, None]))
    assert near_duplicates(docs.where("false")).count() == 0


def test_every_text_of_an_id_is_compared(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(5, b, "x", "s", 0), (5, a, "x", "s", 0), (5, a, "x", "s", 0), (7, a + " one", "x", "s", 0), (8, b + " more", "x", "s", 0)], DOCS)
    out = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs, shingle_words=2).collect()}
    assert out == {(5, 5, True), (7, 5, False), (8, 5, False)}
    assert sorted((r.doc_id, r.text) for r in without_near_duplicates(docs).collect()) == [(5, a), (5, b)]


def test_hot_keys_are_dealt_over_parts(spark, monkeypatch):
    from hemiciclo.llm import minhash

    monkeypatch.setattr(minhash, "SPREAD_ROWS", 3)
    monkeypatch.setattr(minhash, "SPREAD_KEYS", 1_000)
    rows = spark.createDataFrame([(k, m) for k in range(5) for m in range(10**k // 100 + 1)], "key long, rep long")
    sums = rows.groupBy("key").agg({"*": "count"}).withColumnRenamed("count(1)", "n")
    got = minhash.with_sums(rows, sums, "key", "rep").collect()
    assert sorted((r.key, r.rep, r.n) for r in got) == sorted((k, m, 10**k // 100 + 1) for k in range(5) for m in range(10**k // 100 + 1))
    rng = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    texts = {i: " ".join(f"z{rng.random()}" if rng.random() < 0.03 else w for w in base) for i in range(80)}
    docs = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in texts.items()], DOCS)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, shingle_words=2).collect()} == components(texts, near_links(texts, 2))


def test_signature_agreement_estimates_similarity():
    rng = random.Random(1)
    a = [f"t{rng.random()}" for _ in range(400)]
    b = a[:360] + [f"u{rng.random()}" for _ in range(40)]
    x, y = shingle_set(" ".join(a), 2), shingle_set(" ".join(b), 2)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((signature(x) == signature(y)).mean() - true) < 0.12
    assert (signature(shingle_set("a b", 2)) == signature(shingle_set("a b", 2))).all()


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (2000, 2000)]
    ids = {i for p in links for i in p if p[0] != p[1]}
    got = connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long"))
    want = components(range(3000), links)
    assert {r.node: r.component for r in got.collect()} == {i: want[i] for i in ids}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
