from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hemiciclo.llm import packing, tokens
from llm_helpers import DOCS, SF1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 30), max_size=20))
def test_plan_places_each_piece_once(histogram):
    plan = packing.plan_bins(histogram, 64)
    placed = Counter()
    for b in plan:
        assert b.count > 0 and sum(b.lengths) <= 64 and sum(3 * n > 64 for n in b.lengths) <= 2
        for n in b.lengths:
            placed[n] += b.count
    assert placed == +Counter(histogram)
    slots, seen = packing.bin_slots(plan), defaultdict(list)
    for n, low, high, _, _ in slots:
        seen[n].append((low, high))
    for n, spans in seen.items():
        assert [x for low, high in sorted(spans) for x in range(low, high)] == list(range(histogram[n]))


def test_plan_is_near_the_bound():
    histogram = {n: 1 + (n * 7919) % 13 for n in range(1, 1025)}
    total = sum(n * c for n, c in histogram.items())
    assert sum(b.count for b in packing.plan_bins(histogram)) <= 1.01 * math.ceil(total / 1024)


def check(spark, docs):
    library = Tokenizer.from_file(tokens.vocabulary_path())
    texts = Counter()
    rows = packing.pack(docs, range_rows=11, with_ids=True).collect()
    bins = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) <= 1024 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
        texts[r.doc_id, r.piece, r.start, r.ids_crc32] += 1
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    want = Counter()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 1024 + 1
        for k, at in enumerate([0, *range(head, len(ids), 1024)]):
            part = ids[at : (head if k == 0 else at + 1024)]
            want[r.doc_id, k, at, zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert texts == want
    return rows, len(bins)


def test_documents(spark):
    rows, n = check(spark, spark.read.parquet(f"{SF1}/documents.parquet"))
    assert n <= 1.05 * math.ceil(sum(r.length for r in rows) / 1024)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x", "s", 0), (1, "", "x", "s", 0), (2, "a b", None, None, 0), (2, "a b", None, None, 0), (None, "z", "x", "s", 0), (3, "word " * 5000, "x", "s", 0), (4, "a <|endoftext|> b", "x", "s", 0)], DOCS).selectExpr("*", "1 as piece", "'x' as length", "2 as at", "3 as sequence_id")
    check(spark, docs)
    assert packing.pack(docs.where("false")).count() == 0


def test_sequences(spark):
    packed = packing.pack(spark.read.parquet(f"{SF1}/documents.parquet"), with_ids=True)
    sizes = {r.sequence_id: r.n for r in packed.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert {r.sequence_id: len(r.ids) for r in packing.sequences(packed).collect()} == sizes


def test_whole_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """A batch lies in the executor and in its worker at once, so the session's 10,000 rows are too many of whole texts."""
    from hemiciclo.llm import common, minhash, tokens

    docs = spark.range(50).selectExpr("id as doc_id", "repeat(concat('word', char(97 + id % 26), ' '), 40) as text").coalesce(1)
    monkeypatch.setattr(common, "TEXT_ROWS", 7)
    monkeypatch.setattr(tokens, "TEXT_ROWS", 7)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), []
    write = type(docs.write).parquet
    monkeypatch.setattr(type(docs.write), "parquet", lambda self, path, *a, **k: (seen.append((path.rsplit("/")[-1].split("-")[0], self._spark.conf.get(key))), write(self, path, *a, **k))[1])
    assert packing.pack(docs).count() == 50 and tokens.token_digests(docs).count() == 50 and minhash.near_duplicates(docs).count() == 50
    assert {("pieces", "7"), ("tokens", "7"), ("signed", "7"), ("lengths", before)} <= set(seen) and spark.conf.get(key) == before
