from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from hemiciclo.llm import langid, mixing, tokens, toxicity
from llm_helpers import DOCS, SF1, SF2, code_lengths, components, mixed, near_links, toxicity_scores, words
from tokenizers import Tokenizer


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF2)
        out.write.parquet(f"{tmp_path}/{k}")
        kept[name] = docs, spark.read.parquet(f"{tmp_path}/{k}")
        docs = kept[name][1]
        if k < 4:
            assert docs.columns == kept[name][0].columns
    ids = lambda d: Counter(r.doc_id for r in d.select("doc_id").collect())

    before, after = kept["toxicity"]
    judged = toxicity.score_toxicity(before, toxicity.train_toxicity(before, labels))
    assert ids(after) == ids(judged.where("score < 0.7"))
    before, after = kept["language"]
    judged = langid.identify(before, langid.train_trees(before))
    assert ids(after) == ids(judged.where("lang_pred != 'und' and score >= 0.5"))
    before, after = kept["near_duplicates"]
    texts = {r.doc_id: r.text for r in before.collect()}
    group = components(texts, near_links(texts, 5))
    assert ids(after) == Counter(i for i in texts if group[i] == i)
    before, after = kept["mixing"]
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(before).collect()}
    assert ids(after) == Counter({i: (2 * t + n) // (2 * n) for i, (t, n) in taken.items() if n and (2 * t + n) // (2 * n)})
    before, after = kept["packing"]
    assert sum(r.length for r in after.collect()) > sum(len(words(r.text)) for r in before.collect())
    assert Counter((r.doc_id, r.piece) for r in after.where("piece = 0").collect()) == Counter({(i, 0): n for i, n in ids(before).items()})


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SF2)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    sizes = Counter()
    for r in out.collect():
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 1024


def test_run_equals_brute_force(spark):
    """Every stage by plain loops at the smallest size: what is scored, coded, linked, mixed and cut is what run() packs."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    scores = toxicity_scores({i: r.text for i, r in docs.items()}, labels)
    docs = {i: r for i, r in docs.items() if scores[i][1] < 0.7}
    train = [(r.lang, r.text) for r in docs.values() if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    langs = sorted({lang for lang, _ in train})
    kept = {}
    for i, r in docs.items():
        if any(map(str.isalpha, r.text or "")):
            bits = np.array(code_lengths(train, langs, r.text))
            if 1 / np.exp2(-np.minimum(bits - bits.min(), 1000)).sum() >= 0.5:
                kept[i] = r
    group = components(kept, near_links({i: r.text for i, r in kept.items()}, 5))
    kept = {i: r for i, r in kept.items() if group[i] == i}
    taken = mixed([(i, r.text, r.source) for i, r in kept.items()])
    library, want = Tokenizer.from_file(tokens.vocabulary_path()), Counter()
    for i, n in taken.items():
        size = len(words(kept[i].text))
        if not size:
            continue
        ids = [*library.encode(kept[i].text, add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 1024 + 1
        for k, at in enumerate([0, *range(head, len(ids), 1024)]):
            part = ids[at : head if k == 0 else at + 1024]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += (2 * n + size) // (2 * size)
    rows = corpus_pipeline.run(spark, SF1).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == +want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024


@pytest.mark.parametrize("empty", [False, True])
def test_stages_with_nulls_repeats_and_clashing_columns(spark, tmp_path, empty):
    """Every stage runs on rows of NULLs, empty, long and repeated texts, and keeps columns of any name; an empty table stays empty."""
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, 0), (3, "the word " * 9000, "en", "s", 0), (3, "the word " * 9000, "en", "s", 0), (None, "der das die", "de", None, 0), (4, "der das die", "de", "t", 0)]
    rows += [(i, f"the other words of text {i} " * 9, "en", "s", 0) for i in range(10, 40)] + [(i, f"der die das und {i} oder nicht " * 9, "de", "t", 0) for i in range(40, 70)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as score", "'r' as row", "2 as size", "3 as piece", "4 as rep", "5 as _id", "6 as key", "7 as _text").where("false" if empty else "true")
    spark.createDataFrame([(i, 1, i % 2) for i in range(10, 70)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}")
        assert (docs.count() == 0) == empty
