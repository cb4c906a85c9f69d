from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hemiciclo.llm import quality
from hemiciclo.llm.queries import op8_quality
from llm_helpers import DOCS, SF1, words


def statistics(text: str) -> tuple:
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é#\n\t| \x1c", max_size=60))
def test_statistics(text):
    assert quality.text_statistics(text) == statistics(text)


def test_statistics_of_a_long_text():
    text = "\n".join(" ".join(f"w{(i * j) % 97}" for i in range(30)) for j in range(700))
    assert quality.text_statistics(text) == statistics(text)


def test_words_that_differ_in_the_middle_are_different_features():
    words = [f"so{a}{b}n" for a in "abcdefgh" for b in "abcdefgh"]
    assert len({int(quality.features(w)[1][0]) for w in words}) > 60
    assert [f.tolist() for f in quality.features("one two\tone")][1][0] == [f.tolist() for f in quality.features("xyz one")][1][1]
    assert [len(f) for f in quality.features("ñañá é")] == [4, 3]


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train_quality(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.judge_quality(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept for r in rows if r.quality) / sum(r.quality for r in rows) > 0.98
    assert sum(r.kept for r in rows if not r.quality) / sum(1 - r.quality for r in rows) < 0.1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, 0), (2, "", "x", "s", 0), (2, "a " * 60, "x", "s", 0), (None, " ".join(f"w{i}" for i in range(9000)), "x", "s", 0)], DOCS).selectExpr("*", "1 as kept", "2 as n_words")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.judge_quality(docs, quality.train_quality(docs, none)).collect()]
    assert out == [(1, 0, True, False), (2, 0, True, False), (2, 60, True, False), (None, 9000, False, True)]
    assert quality.judge_quality(docs.where("false"), None).count() == 0


def hashed(text: str) -> np.ndarray:
    """Shares of the two kinds of n-grams, one hash at a time."""
    mix, base, top = int(quality.MIX), int(quality.BASE), (1 << 64) - 1
    row = np.zeros(2 * quality.HALF)
    grams = [((ord(a) | ord(b) << 21 | ord(c) << 42) & top) * mix % (1 << 64) >> (65 - quality.BITS) for a, b, c in zip(text, text[1:], text[2:], strict=False)]
    one = [sum((ord(c) + 1) * pow(base, k, 1 << 64) for k, c in enumerate(w)) % (1 << 64) for w in words(text)]
    one = [(h ^ h >> 32) * mix % (1 << 64) for h in one]
    two = [(a * mix % (1 << 64)) ^ b for a, b in zip(one, one[1:], strict=False)]
    both = [quality.HALF + (h >> (65 - quality.BITS)) for h in one + [(h ^ h >> 32) * mix % (1 << 64) for h in two]]
    for part in (grams, both):
        for h in part:
            row[h] += 1 / len(part)
    return row


def test_query_equals_brute_force(spark):
    """Every probability and verdict of op8 at the smallest size, from n-grams hashed one by one and the fitted weights."""
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    model = quality.train_quality(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = {r.doc_id: r for r in op8_quality(spark, SF1).collect()}
    assert set(rows) == set(texts) and len({r.kept for r in rows.values()}) == 2
    for i, text in texts.items():
        z = model.bias + float(hashed(text) @ model.weights)
        p = 1 / (1 + np.exp(-(model.slope * z + model.intercept)))
        assert rows[i].probability == pytest.approx(p, abs=1e-4)
        w = words(text)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert (rows[i].n_words, rows[i].n_repeat_words, rows[i].base_failed) == (len(w), len(again), failed)
        assert rows[i].kept == (not failed and rows[i].probability >= quality.THRESHOLD)
