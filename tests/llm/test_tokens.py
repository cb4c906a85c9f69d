from __future__ import annotations

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hemiciclo.llm import tokens
from llm_helpers import DOCS, SF1

ENCODER = tokens.encoder(tokens.vocabulary_path())
LIBRARY = Tokenizer.from_file(tokens.vocabulary_path())


def direct(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aéZ1'.,$ \n\t-ß漢", max_size=40), max_size=4))
def test_encoder_equals_library(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER(texts)] == [direct(t) for t in texts]


def test_strings_of_special_tokens():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b c", "plain words", "<|endof", "text|> x", "x <|endoftext|><|endoftext|> y"]
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER(texts)] == [direct(t) for t in texts]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """The Thue-Morse word and its complement have one polynomial hash modulo 2**64, whatever the multiplier."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for room in (800_000, 1):  # kept in the memory of words; more words in a text than it holds
        monkeypatch.setattr(tokens, "MEMORY", room)
        encode = tokens.Encoder(tokens.vocabulary_path())
        for texts in ([f"x {word} y {other} z"], [f"x {other} y", f"{word} {other}\n{word}"]):
            assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [direct(t) for t in texts]


def test_same_bytes():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2, 3000).astype(np.uint8)
    at, to, size = rng.integers(0, 1200, 4000), rng.integers(0, 1200, 4000), rng.integers(0, 20, 4000)
    to[:50], at[50:60], size[50:60] = at[:50], to[50:60], 1000
    a[1800:] = a[:1200]
    got = tokens.same_bytes(a, at, a, to, size)
    assert got.tolist() == [bytes(a[i : i + n]) == bytes(a[j : j + n]) for i, j, n in zip(at, to, size, strict=True)] and got.any() and not got.all()


def test_files_stand_in_order_of_their_numbers(spark):
    rows = [(f"part-{n:05d}-0f0f0f0f-c{c:03d}.zstd.parquet", 1) for n in (0, 99999, 100000, 100001) for c in (0, 1, 1000)]
    got = {r.at: r.offset for r in tokens.file_offsets(spark.createDataFrame(rows, "at string, n_tokens int")).collect()}
    assert [got[name] for name, _ in rows] == list(range(12))


def test_encoder_on_documents_and_after_forgetting(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()]
    for room in (50, 3000):
        monkeypatch.setattr(tokens, "MEMORY", room)
        small = tokens.Encoder(tokens.vocabulary_path())
        for at in range(0, len(texts), 20):
            assert [np.frombuffer(x, "<u4").tolist() for x in small(texts[at : at + 20])] == [direct(t) for t in texts[at : at + 20]]


def test_files_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(5, "b c", "x", "s", 0), (None, "n", None, None, 0), (2, None, "x", "s", 0), (5, "a", "x", "s", 0), (9, "", "x", "s", 0), (7, "lang " * 3000, "x", "s", 0)], DOCS).repartition(3)
    path = f"{tmp_path}/t"
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.token_digests(docs.selectExpr("*", "1 as place", "'x' as file"), path).collect()))
    want, start = [], 0
    for doc_id, text in [(None, "n"), (2, ""), (5, "a"), (5, "b c"), (7, "lang " * 3000), (9, "")]:
        ids = [*direct(text), 2]
        want.append((start, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    spans = {(r.doc_id, r.start): r.n_tokens for r in tokens.read_spans(spark, path).collect()}
    assert spans == {(d, s): n for s, d, n, _ in want}
    one = spark.read.parquet(path).where("doc_id = 7").select("ids").collect()
    assert one[0].ids == [*direct("lang " * 3000), 2]


def test_empty_table(spark):
    assert tokens.token_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_files_have_page_indexes_and_dictionaries(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    tokens.write_tokens(spark.read.parquet(f"{SF1}/documents.parquet"), f"{tmp_path}/t")
    group = pq.ParquetFile(glob.glob(f"{tmp_path}/t/*.parquet")[0]).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    assert any("DICT" in e for e in columns["ids.list.element"].encodings)


def test_many_files_stand_in_order(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = tokens.token_digests(spark.read.parquet(f"{SF1}/documents.parquet").repartition(5)).orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens


def test_words_met_again_stay_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 60)
    encode, asked = tokens.Encoder(tokens.vocabulary_path()), []
    made = encode._made
    monkeypatch.setattr(encode, "_made", lambda *words: asked.append(len(words[-1])) or made(*words))
    usual = " and ".join(f"usual{chr(97 + i)} word{chr(97 + i)}" for i in range(10))
    for n in range(40):
        text = f"so {usual} " + " ".join(f"rare{chr(97 + n % 26)}{chr(97 + n // 26)}{chr(97 + i)}" for i in range(15))
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == direct(text)
    assert sum(asked) == 40 * 15 + 22


def test_words_of_letters_need_no_cutting(monkeypatch):
    words = ["été", "straße", "Ünïcödé", "словоѿ", "a×b", "a÷b", "ŉſ", "naïve2", "x'll", "ıİ", "Αθήνα", "plain", "ſtop.", "ĀÿƀƁ", "a" * 3000]
    text = "so " + " ".join(words * 3) + "\n" + " ".join(w + "," for w in words)
    encode, lines = tokens.Encoder(tokens.vocabulary_path()), []
    by_line = encode._by_line
    monkeypatch.setattr(encode, "_by_line", lambda some, before: lines.extend((before, w) for w in some) or by_line(some, before))
    assert np.frombuffer(encode([text])[0], "<u4").tolist() == direct(text)
    assert not {"été", "straße", "Ünïcödé", "plain", "словоѿ", "ŉſ"} & {w for before, w in lines if before} and (" ", "a×b") in lines
