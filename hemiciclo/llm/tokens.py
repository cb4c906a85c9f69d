"""Token ids of whole texts by a public tokenizer, and their file format."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hemiciclo.llm.common import TEXT_ROWS, arrow_rows, give_back, hold, shared_dir

VOCABULARY = "byte_bpe_50k.json"
END = 2
#: Words whose ids a worker remembers; beyond it forgets those that it did not meet again (all, if they are fewer than half), which changes no result.
MEMORY = 400_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_SPACE, _FEED = 32, 10
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
#: Bytes of a buffer that is cut into words at a time.
CHUNK = 1 << 18
#: Slots of the memory of words; more than MEMORY words never stand in it.
SLOTS = 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes of words of letters alone: ASCII, U+00C0 to U+017F, U+0400 to U+047F; of these only two signs are no letters.
_WORD_BYTE = _LETTER.copy()
_WORD_BYTE[[*range(0x80, 0xC0), 0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True
#: The code point that stands for each byte in a byte-level vocabulary: its own if it can be seen, else one from 256 on.
_POINT = np.arange(256, dtype=np.uint16)
_UNSEEN = [*range(33), *range(127, 161), 173]
_POINT[_UNSEEN] = range(256, 256 + len(_UNSEEN))
#: Words of a text that goes to the library; longer ones cost it more a word.
LINE = 50
_ODD_BYTE = np.zeros(256, bool)
_ODD_BYTE[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True  # the last four begin all white space beyond ASCII


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64."""
    up, down = np.full(n, _MULTIPLIER, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def single_spaced(octets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For texts that follow each other in `octets` (ends: len + 1 places), whether all white space of a text is single spaces and line feeds between other characters; bytes that may begin other white space, and empty texts, are a no."""
    gap = (octets == _SPACE) | (octets == _FEED)
    bad = _ODD_BYTE[octets]
    bad[1:] |= gap[1:] & gap[:-1]
    starts, stops = ends[:-1], ends[1:]
    some = stops > starts
    bad[starts[some]] |= gap[starts[some]]
    bad[stops[some] - 1] |= gap[stops[some] - 1]
    count = np.concatenate([[0], np.cumsum(bad)])
    return some & (count[stops] == count[starts])


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes of `a` from each place `at` are those of `b` from each place `to`; eight bytes at a time, so both arrays have seven to spare."""
    x, y = (np.ndarray(len(c) - 7, "<u8", c, strides=(1,)) for c in (a, b))
    same, left, k = np.ones(len(at), bool), np.arange(len(at)), 0
    while len(left) and k < 512:
        mask = _MASKS[np.minimum(size[left] - k, 8)]
        same[left] &= ((x[at[left] + k] ^ y[to[left] + k]) & mask) == 0
        k += 8
        left = left[size[left] > k]
    for i in left.tolist():
        same[i] = same[i] and np.array_equal(a[at[i] + k : at[i] + size[i]], b[to[i] + k : to[i] + size[i]])
    return same


class Encoder:
    """Ids of texts, the same as `Tokenizer.encode(text, add_special_tokens=False)` gives.

    A byte-level BPE never merges over a pre-token's edge, and a single space or line feed between two characters
    that are not white space is always such an edge, as is that between a letter and a comma or full stop that ends
    a word. So most texts can be put together from the ids of their words, each with the space or line feed before
    it; words repeat, and the library encodes each different one once, many in a text of a word a line. Words are
    cut, hashed (64 bits of a polynomial of the bytes, with length and lead) and looked up for many texts at a time
    as arrays. A word that is found has its bytes compared; one whose hash belongs to another word is encoded by
    itself. A text with other white space, or with the string of a special token, goes to the library whole.

    A space and letters are one pre-token. Such words go to the library's model in the vocabulary's own alphabet, a
    pre-token a line, which spares the library to normalize and cut them; each one's first id is one that begins with
    the space.
    """

    def __init__(self, path: str):
        import json
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = [c.encode() for c in added]
        self.by_words = not any(any(map(str.isspace, c)) for c in added)  # else a token could lie over two words
        if resize := getattr(self.whole.model, "_resize_cache", None):
            resize(1)  # words that come here are new, so its own memory of words would only cost time
        self.feed = int(self._encode("\n")[0])
        cut = json.loads(self.whole.pre_tokenizer.__getstate__()) if self.whole.pre_tokenizer else {}
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        self.bytewise = bool(usual) and self.whole.normalizer is None and all(self.whole.token_to_id(chr(c)) is not None for c in _POINT.tolist())
        self.letters = Tokenizer(self.whole.model)  # the same model in memory
        self.letters.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        space = chr(int(_POINT[_SPACE]))
        self.spaced = np.array([(self.whole.id_to_token(i) or "").startswith(space) for i in range(self.whole.get_vocab_size())])
        self._forget()

    def _forget(self) -> None:
        self.keys, self.places = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)
        self.words = 0
        self.first, self.count = np.zeros(MEMORY, np.int64), np.zeros(MEMORY, np.int32)  # of a word's ids in `ids`
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.kind = np.zeros(MEMORY, np.int64)  # 4 * length in bytes + lead
        self.bytes_at = np.zeros(MEMORY, np.int64)  # of its bytes in `bytes`
        self.bytes, self.bytes_used = np.zeros(1 << 16, np.uint8), 0
        self.key, self.again = np.zeros(MEMORY, np.uint64), np.zeros(MEMORY, bool)

    def _forget_rare(self) -> None:
        """Forgets words that were not met again since the last time, all if others are more than half of the memory."""
        keep = np.flatnonzero(self.again[: self.words])
        keep = keep[: len(keep) * (2 * len(keep) <= len(self.first))]
        key, kind, count = self.key[keep], self.kind[keep], self.count[keep].astype(np.int64)
        flat = self.ids[_spans(self.first[keep], self.first[keep] + count)]
        raw = self.bytes[_spans(self.bytes_at[keep], self.bytes_at[keep] + (kind >> 2))]
        self._forget()
        self._add(key, (flat, np.cumsum(count) - count, count), raw, kind >> 2, kind & 3)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _by_line(self, words: list[str], lead: str) -> list[np.ndarray]:
        """The ids of each word after `lead`, encoded as lines of one text; no other token of these holds a line feed."""
        if not words:
            return []
        texts = [lead + ("\n" + lead).join(words[at : at + 2000]) for at in range(0, len(words), 2000)]
        found: list[np.ndarray] = []
        for e in self.whole.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            ends = [*np.flatnonzero(ids == self.feed).tolist(), len(ids)]
            found += [ids[i:j] for i, j in zip([0, *(x + 1 for x in ends[:-1])], ends, strict=True)]
        return found

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The word that each key stands for, -1 for none."""
        out = np.full(len(keys), -1, np.int32)
        slot, open_ = (keys >> np.uint64(64 - SLOTS)).astype(np.int64), np.arange(len(keys))
        while len(open_):
            at = slot[open_]
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.places[at[hit]]
            open_ = open_[~hit & (there != 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << SLOTS) - 1)
        return out

    def _add(self, keys: np.ndarray, made: tuple[np.ndarray, np.ndarray, np.ndarray], raw: np.ndarray, lengths: np.ndarray, leads: np.ndarray) -> None:
        """Different new keys with what _made() gave for their words, and these words' bytes, one after the other."""
        n, (flat, first, sizes) = len(keys), made
        if self.bytes_used + len(raw) + 8 > len(self.bytes):
            self.bytes = np.concatenate([self.bytes[: self.bytes_used], np.zeros(max(len(self.bytes), len(raw)) + 8, np.uint8)])
        self.bytes[self.bytes_used : self.bytes_used + len(raw)] = raw
        self.kind[self.words : self.words + n] = 4 * lengths + leads
        self.bytes_at[self.words : self.words + n] = self.bytes_used + np.cumsum(lengths) - lengths
        self.bytes_used += len(raw)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(flat)), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[self.words : self.words + n] = self.used + first
        self.count[self.words : self.words + n] = sizes
        self.key[self.words : self.words + n] = keys
        place = np.arange(self.words, self.words + n, dtype=np.int32)
        self.words, self.used = self.words + n, self.used + len(flat)
        slot, open_ = (keys >> np.uint64(64 - SLOTS)).astype(np.int64), np.arange(n)
        while len(open_):
            at = slot[open_]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[open_[free]]
            mine = self.keys[at] == keys[open_]
            self.places[at[mine]] = place[open_[mine]]
            open_ = open_[~mine]
            slot[open_] = (slot[open_] + 1) & ((1 << SLOTS) - 1)

    def _single_spaced(self, octets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that single_spaced() accepts, one after the other, and where each ends."""
        n = len(octets)
        gap = (octets == _SPACE) | (octets == _FEED)
        stop = (octets == 44) | (octets == 46)
        stop[0] = False
        stop[1:] &= _LETTER[octets[:-1]]
        last = np.zeros(n + 1, bool)
        last[ends[1:]] = True
        stop &= last[1:] | np.append(gap[1:], True)
        stop[ends[:-1]] = False
        begins, closes = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        begins[1:] = gap
        begins[:-1] |= stop
        begins[ends[:-1]] = True
        begins[n] = False
        closes[:-1] = gap | stop
        closes[ends[1:]] = True
        start, end = np.flatnonzero(begins), np.flatnonzero(closes)
        padded = np.concatenate([octets, np.zeros(8, np.uint8)])
        lead = np.where(stop[start], 3, np.where(octets[start - 1] == _SPACE, 1, 2))
        text_start = np.searchsorted(start, ends[:-1])
        lead[text_start] = 0
        up, down = _powers(max(n, CHUNK + 1) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(octets * up[:n])])
        key = (total[end] - total[start]) * down[start]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (end - start).astype(np.uint64) * np.uint64(0x94D049BB133111EB) + lead.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
        key[key == 0] = 1
        kind = 4 * (end - start) + lead
        word = self._find(key)
        new = np.flatnonzero(word < 0)
        self.again[word[word >= 0]] = True
        if len(new):
            kinds, one = np.unique(key[new], return_index=True)
            for forget in (self._forget_rare, self._forget):
                if self.words + len(kinds) > len(self.first):
                    forget()
                    new = np.flatnonzero(self._find(key) < 0)
                    kinds, one = np.unique(key[new], return_index=True)
            at = new[one]
            made = self._made(octets, start[at], end[at], lead[at])
            if len(kinds) > len(self.first):  # more different words in one text than are ever remembered
                ids, first, count = made  # nothing is remembered now, so `new` are all words
                word = np.searchsorted(kinds, key)
                same = (kind == kind[at][word]) & same_bytes(padded, start, padded, start[at][word], np.where(kind == kind[at][word], end - start, 0))
                return self._joined(ids, first[word], count[word], same, octets, start, end, lead, np.append(text_start, len(word)))
            self._add(kinds, made, octets[_spans(start[at], end[at])], end[at] - start[at], lead[at])
            word = self._find(key)
        alike = kind == self.kind[word]
        same = alike & same_bytes(padded, start, self.bytes, self.bytes_at[word], np.where(alike, end - start, 0))
        return self._joined(self.ids, self.first[word], self.count[word].astype(np.int64), same, octets, start, end, lead, np.append(text_start, len(word)))

    def _made(self, octets: np.ndarray, start: np.ndarray, end: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words of `octets` with their leads, and where in these ids each word's begin and how many they are."""
        odd = ~_WORD_BYTE[octets]
        odd[1:] |= (octets[:-1] == 0xC3) & ((octets[1:] == 0x97) | (octets[1:] == 0xB7))  # multiplied by, divided by
        odds = np.concatenate([[0], np.cumsum(odd)])
        plain = (lead == 1) & (odds[end] == odds[start]) & self.bytewise
        first, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        flat, at = self._of_letters(octets, start[plain] - 1, end[plain])
        first[plain], count[plain] = at[:-1], np.diff(at)
        found, used = [flat], len(flat)
        for group, before in (((0, 2, 3), ""), ((1,), " ")):
            mine = np.flatnonzero(np.isin(lead, group) & ~plain)
            words = [octets[i:j].tobytes().decode() for i, j in zip(start[mine].tolist(), end[mine].tolist(), strict=True)]
            made = self._by_line(words, before)
            made = [np.concatenate([[np.uint32(self.feed)], ids]) if x == 2 else ids for ids, x in zip(made, lead[mine].tolist(), strict=True)]
            size = np.fromiter(map(len, made), np.int64, len(made))
            first[mine], count[mine] = used + np.cumsum(size) - size, size
            found += made
            used += int(size.sum())
        return np.concatenate(found), first, count

    def _of_letters(self, octets: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are a space and letters, one after the other, and where each begins, with the end of all."""
        n = len(start)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        size = end - start
        ends = np.cumsum(size + 1)
        points = np.full(int(ends[-1]), _FEED, np.uint16)
        points[_spans(ends - size - 1, ends - 1)] = _POINT[octets[_spans(start, end)]]
        text, stops = points.astype("<u2", copy=False).tobytes().decode("utf-16-le"), [0, *ends[LINE - 1 : n - 1 : LINE].tolist(), int(ends[-1])]
        lines = [text[i : j - 1] for i, j in zip(stops[:-1], stops[1:], strict=True)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.letters.encode_batch_fast(lines, add_special_tokens=False)])
        return flat, np.append(np.flatnonzero(self.spaced[flat]), len(flat))

    def _joined(self, ids: np.ndarray, first: np.ndarray, count: np.ndarray, same: np.ndarray, octets: np.ndarray, start: np.ndarray, end: np.ndarray, lead: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_gather() of all words; those that are not the `same` as what their hash found are encoded here."""
        if not same.all():
            other = np.flatnonzero(~same)
            made, at, size = self._made(octets, start[other], end[other], lead[other])
            first, count = first.copy(), count.copy()
            first[other], count[other] = len(ids) + at, size
            ids = np.concatenate([ids, made])
        return _gather(ids, first, count, groups)

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (NULL: none), one after the other, and where each ends (len + 1 places)."""
        texts = texts.fill_null("").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        octets = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        plain = single_spaced(octets, ends) if len(octets) and self.by_words else np.zeros(len(texts), bool)
        raw = octets.tobytes() if self.special else b""
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                plain[np.searchsorted(ends, at, "right") - 1] = False  # a token over two texts only sends the first one whole
                at = raw.find(token, at + 1)
        parts, sizes, at = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64), 0
        while at < len(texts):
            if not plain[at]:
                ids = self._encode(octets[ends[at] : ends[at + 1]].tobytes().decode())
                sizes[at] = len(ids)
                parts.append(ids)
                at += 1
                continue
            to = at + 1
            while to < len(texts) and plain[to] and ends[to + 1] - ends[at] <= CHUNK:
                to += 1
            ids, stops = self._single_spaced(octets[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
            sizes[at:to] = np.diff(stops)
            parts.append(ids)
            at = to
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, ends = self.arrays(pa.array(texts, pa.string()))
        return [ids[i:j].astype("<u4").tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0] .. last[0] - 1, first[1] .. last[1] - 1 and so on, in one array."""
    n = last - first
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _gather(ids: np.ndarray, first: np.ndarray, count: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids[first : first + count] of every word, one after the other, and where each group of words ends."""
    return ids[_spans(first, first + count)], np.concatenate([[0], np.cumsum(count)])[groups]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(path: str, text_at: int, end: int | None, make: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], step: int = 512) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: `make(rows, ids, ends)` for `step` rows at a time; NULL texts are empty, `end` closes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("tokens", encoder.cache_clear)
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                ids, ends = encode.arrays(rows.column(text_at))
                if end is not None:
                    ids, ends = np.insert(ids, ends[1:], np.uint32(end)), ends + np.arange(len(ends))
                yield make(rows, ids, ends)
        rows = ids = ends = batch = None
        give_back()

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end: int = END,
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 64 << 10,
) -> None:
    """Token ids of all documents as Parquet files in ascending order of id.

    Columns: doc_id, place (in its file), n_tokens, ids (list of int). One range shuffle orders the raw rows;
    encoding comes after it and keeps the order. Row groups and pages are small and carry min/max indexes over
    doc_id, so that a reader of some documents, or of n_tokens alone, touches few pages. Ids are dictionary-encoded;
    format version 2 packs doc_id and place as deltas. NULL text is empty (one id, the end), NULL ids come first,
    rows that share an id stay next to each other in order of a hash of the text, over several files if they are many;
    columns of any other name are not read; an empty table gives files without rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def make(rows: pa.RecordBatch, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
        return pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(1), pa.array(np.diff(ends), pa.int32()), tokens], schema=schema)

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    placed = ordered.select("doc_id", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), "text")
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        (
            placed.mapInArrow(encoded(tokenizer or vocabulary_path(), 2, end, make), "doc_id long, place long, n_tokens int, ids array<int>")
            .write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
            .option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true").option("compression", "zstd")
            .parquet(path)
        )


def file_offsets(rows: DataFrame) -> DataFrame:
    """rows: at (file name), n_tokens. at, offset: the ids in all files before, in order of the numbers in the names.

    The window runs over one row a file. Names count their task (part-00012-...) and the file of a task (...-c000).
    """
    number = [F.coalesce(F.regexp_extract("at", rule, 1).try_cast("long"), F.lit(0)) for rule in (r"part-(\d+)", r"-c(\d+)\.")]
    before = F.sum("n").over(W.orderBy(*number, "at").rowsBetween(W.unboundedPreceding, -1))
    return rows.groupBy("at").agg(F.sum("n_tokens").alias("n")).select("at", F.coalesce(before, F.lit(0)).alias("offset"))


def read_spans(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, from the small columns alone; start by prefix sums.

    A file holds a range of ids. Its sum of n_tokens gives the next file's offset (a window over one row a file), and
    a running sum inside a file the rest.
    """
    rows = spark.read.parquet(path).select("doc_id", "place", "n_tokens", F.col("_metadata.file_name").alias("file"))
    offsets = file_offsets(rows.select(F.col("file").alias("at"), "n_tokens"))
    inside = F.sum("n_tokens").over(W.partitionBy("file").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, F.col("file") == F.col("at")).select("doc_id", "place", "file", (F.col("offset") + F.col("inside")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"))


def read_digests(spark, path: str) -> DataFrame:
    """doc_id, place, file, ids_crc32, n_read: from the ids column of the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("file", pa.string()), ("ids_crc32", pa.int64()), ("n_read", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64()), pa.array(np.diff(ends), pa.int64())], schema=schema)

    rows = spark.read.parquet(path).select("doc_id", "place", F.col("_metadata.file_name").alias("file"), "ids")
    return rows.mapInArrow(digest, "doc_id long, place long, file string, ids_crc32 long, n_read long")


def token_digests(docs: DataFrame, path: str | None = None, **kwargs) -> DataFrame:
    """Writes the files (to the shared folder unless `path` is given) and reads from them, per document: doc_id, start, n_tokens, ids_crc32.

    The files' list of row digests is made in one pass over ids; n_tokens is the length of the ids that were read.
    """
    import uuid

    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, **kwargs)
    rows = read_digests(spark, path)
    offsets = file_offsets(spark.read.parquet(path).select(F.col("_metadata.file_name").alias("at"), "n_tokens"))
    inside = F.sum("n_read").over(W.partitionBy("file").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, F.col("file") == F.col("at")).select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), F.col("n_read").alias("n_tokens"), "ids_crc32")
